import base64
import re
import subprocess
import sys
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fieldwarden.functions import text as tx
from fieldwarden.functions.vocab import EOS_ID, PAD_ID, UNK_ID

HAN = "".join(
    f"{chr(lo)}-{chr(hi)}" if lo != hi else chr(lo) for lo, hi in tx.HAN_RANGES
)


def clean(text):
    """Plain Python form of the cleaning rules."""
    normal = unicodedata.normalize("NFKC", text)
    kept = re.sub(rf"[^A-Za-z0-9(),!?'\"{HAN}]", " ", normal)
    return re.sub(r"\s{2,}", " ", kept).strip().upper()


def column(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def values(df, expression):
    return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def test_normal_ranges_are_left_alone():
    composing = set()
    for point in range(0x30000):
        if 0xD800 <= point < 0xE000:
            continue
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            composing.add(int(parts[1], 16))
    composing |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for lo, hi in tx.NORMAL_RANGES:
        for point in range(lo, hi + 1):
            char = chr(point)
            assert unicodedata.normalize("NFKC", char) == char, hex(point)
            assert unicodedata.combining(char) == 0 and point not in composing, hex(point)


def test_normaliser_needs_no_package_on_the_executors():
    code = base64.b64encode(cloudpickle.dumps(tx.nfkc.func)).decode()
    script = (
        "import base64, pickle, pyarrow as pa\n"
        f"f = pickle.loads(base64.b64decode('{code}'))\n"
        "print(f(pa.array(['\\uff21', None])).to_pylist())"
    )
    bare = subprocess.run(
        [sys.executable, "-c", script], capture_output=True, text=True, cwd="/", check=True
    )
    assert bare.stdout.strip() == "['A', None]"


def test_strip_equals_python(spark):
    texts = ["　 a ", "\x1c\x85b c ", "", " \t\n", "中​"]
    df = column(spark, texts)
    assert values(df, tx.strip(F.col("t"))) == [t.strip() for t in texts]


def test_clean_text_literals(spark):
    texts = [
        "ＡＢＣ１２３",
        "　中文。english.　",
        "ﬁne",
        "\U00020000x〇",
        "été été",
        "ｶﾞ①½㎏",
        "a  b\t\nc_d",
        "",
        "(x),y!?'\"",
        "2018-07-01 10:20:02",
        "가각",
    ]
    df = column(spark, [*texts, None])
    assert values(df, tx.clean_text(F.col("t"))) == [*[clean(t) for t in texts], None]


@settings(max_examples=15, deadline=None)
@given(
    st.lists(
        st.text(
            st.one_of(
                st.sampled_from("aZ09 ,!?'\"()_-\t\n　中文〇éﬁＡ１①́̈가ᅡ"),
                st.characters(exclude_categories=["Cs"], exclude_characters="\x00"),
            ),
            max_size=30,
        ),
        min_size=20,
        max_size=60,
    )
)
def test_clean_text_equals_python(spark, texts):
    df = column(spark, texts)
    assert values(df, tx.clean_text(F.col("t"))) == [clean(t) for t in texts]


def test_punctuation(spark):
    assert len(tx.ZH_PUNCTUATION) == len(tx.EN_PUNCTUATION)
    df = column(spark, ["中文。english.", "（你好），「世界」！"])
    assert values(df, tx.zh_punc_to_en_punc(F.col("t"))) == ["中文.english.", "(你好),(世界)!"]


def test_split_num(spark):
    df = column(spark, ["english123中文456balabala", "", "12"])
    assert values(df, tx.split_num(F.col("t"))) == [
        ["english", "1", "2", "3", "中文", "4", "5", "6", "balabala"],
        [],
        ["1", "2"],
    ]
    assert values(df, tx.split_num(F.col("t"), num_to_digits=False))[0] == [
        "english",
        "123",
        "中文",
        "456",
        "balabala",
    ]


def test_tokenize(spark):
    df = column(spark, ["我是中文this is 12 (ok)", "  "])
    assert values(df, tx.tokenize(tx.clean_text(F.col("t")))) == [
        ["我", "是", "中", "文", "this", "is", "1", "2", "(", "ok", ")"],
        [],
    ]


def test_sequences_around_the_cap(spark):
    ids = {"A": 3, "中": 4, "\U00020000": 5, " ": 6}
    table = tx.id_table(ids)
    df = column(spark, ["", "A", "AAA", "AAAA", "AAAAA", "A中Z", "\U00020000 \U0002F800"])
    got = values(df, tx.text_sequence(F.col("t"), 4, table))
    e, p, u = EOS_ID, PAD_ID, UNK_ID
    assert got == [
        [e, p, p, p],
        [3, e, p, p],
        [3, 3, 3, e],
        [3, 3, 3, 3],
        [3, 3, 3, 3],
        [3, 4, u, e],
        [5, 6, u, e],
    ]


def test_sequence_equals_dictionary_join(spark):
    """The dense lookup against a join of exploded characters with the dictionary."""
    texts = ["AB A", "CAB", "中A", "", "BBBBBBBB"]
    ids = {"A": 3, "B": 4, " ": 5, "中": 6}
    df = column(spark, texts)
    dense = values(df, tx.text_sequence(F.col("t"), 6, tx.id_table(ids)))
    dictionary = spark.createDataFrame(list(ids.items()), "c string, id int")
    chars = df.select("i", F.posexplode(tx.characters(F.substring("t", 1, 6))).alias("at", "c"))
    joined = chars.join(dictionary, "c", "left").groupBy("i").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(UNK_ID)).alias("id")))).alias("x")
    )
    by_row = {r.i: [x.id for x in r.x] for r in joined.collect()}
    padded = [(by_row.get(i, []) + [EOS_ID] + [PAD_ID] * 6)[:6] for i in range(len(texts))]
    assert dense == padded


def test_dictionary_rejects_words():
    import pytest

    with pytest.raises(ValueError):
        tx.id_table({"AB": 3})


def test_full_width_forms_stay_in_the_jvm(spark):
    settled = ["客户（联系人）：手机号，必填", "ＡＢＣ１２３　ｘ", "plain", "“引号”—·", ""]
    seen = ["ﬁrst", "①", "é", "ｶﾞ", "（½）"]
    df = spark.createDataFrame([(s,) for s in settled + seen], "s string")
    rows = df.select("s", tx.unsettled(F.col("s")).alias("sent"), tx.normalise(F.col("s")).alias("n")).collect()
    assert {r.s for r in rows if r.sent is not None} == set(seen)
    assert all(r.n == unicodedata.normalize("NFKC", r.s) for r in rows)


def test_every_full_width_form_is_folded():
    assert tx.HALF_WIDTH == unicodedata.normalize("NFKC", tx.FULL_WIDTH)
