"""Words of a lexicon: published examples, a plain search, both ways to look words up."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from fieldwarden.functions.segment import MORE, path_finder
from fieldwarden.operators import segmentation as seg

WORDS = {
    "this": 9, "is": 9, "a": 9, "test": 3, "another": 2, "with": 5, "slash": 2, "also": 2, "english": 2, "text": 3,
    "我": 9, "是": 9, "中文": 3, "还是": 3, "还": 2, "这": 5, "斯坦福": 2, "分词": 2, "器": 2, "测试": 2, "tex": 1, "he": 6,
}

EXAMPLES = {
    "thisisatest.": "this is a test",
    "this-is-anothertest-withslash": "this is another test with slash",
    "": "",
    " ": "",
    "这是斯坦福中文分词器测试": "这 是 斯坦福 中文 分词 器 测试",
    "this is another test": "this is another test",
    "我是中文thisisenglishtext我还是中文this is also english-text": "我 是 中文 this is english text 我 还是 中文 this is also english text",
    "我是中文thisis123englishtext": "我 是 中文 this is 1 2 3 english text",
}


@pytest.fixture(scope="module")
def lexicon(spark):
    return seg.lexicon(spark.createDataFrame(list(WORDS.items()), "token string, n long"))


@pytest.mark.parametrize("max_words", [seg.MAX_WORDS, 0])
def test_published_examples(spark, lexicon, max_words):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(EXAMPLES)] + [(99, None)], "i int, text string")
    got = {r.i: " ".join(r.tokens) for r in seg.tokenized(rows, lexicon, max_words=max_words).collect()}
    assert got == {**dict(enumerate(EXAMPLES.values())), 99: ""}


def test_whole_numbers(spark, lexicon):
    rows = spark.createDataFrame([("thisis123text",)], "text string")
    assert seg.tokenized(rows, lexicon, num_to_digits=False).first().tokens == ["this", "is", "123", "text"]


def plain_split(run, costs, unknown):
    """The best of all ways to cut a run."""
    best = None
    for cuts in itertools.product([False, True], repeat=len(run) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        words = [run[a:b] for a, b in itertools.pairwise(at)]
        cost = 0
        for w in words:
            ways = [costs[w]] if w in costs else []
            if run[0].isascii() or len(w) == 1:
                ways.append(unknown + (MORE * (len(w) - 1) if run[0].isascii() else 0))
            cost += min(ways, default=1 << 60)
        # fewest words, then the longest last word and so on back
        key = (cost, len(words), at[::-1][1:])
        best = min(best or key, key)
    return [run[a:b] for a, b in itertools.pairwise([*best[2][::-1], len(run)])]


def test_against_all_ways_to_cut():
    pick, best_split = random.Random(2), path_finder()
    for letters in ("abc", "中文字"):
        for _ in range(400):
            costs = {"".join(pick.choices(letters, k=pick.randrange(1, 5))): pick.randrange(0, 6000) for _ in range(6)}
            unknown = pick.choice([0, 1000, 6000])
            run = "".join(pick.choices(letters, k=pick.randrange(1, 11)))

            def words_at(run, at, costs=costs):
                return [(at + k, costs[run[at : at + k]]) for k in range(1, 5) if run[at : at + k] in costs and at + k <= len(run)]

            assert best_split(run, words_at, unknown) == plain_split(run, costs, unknown)


def test_counts_and_both_lookups_agree(spark, lexicon):
    rows = [("thisisatest this 12",), ("THISIS a(test)",), (None,), ("",), ("zzzz我我是",)] * 3
    texts = spark.createDataFrame(rows, "text string").withColumns({"run": F.lit("x"), "words": F.lit(1), "n": F.lit(5)})
    got = [
        {r.token: r.n for r in seg.lexicon_word_counts(texts, lexicon, max_words=m).collect()} for m in (seg.MAX_WORDS, 0)
    ]
    assert got[0] == got[1]
    expected = {"this": 9, "is": 6, "a": 6, "test": 6, "1": 3, "2": 3, "(": 3, ")": 3, "zzzz": 3, "我": 6, "是": 3}
    assert got[0] == expected
    assert seg.lexicon_word_counts(texts.limit(0), lexicon).collect() == []


def test_costs(spark):
    counts = spark.createDataFrame([("This", 2), ("this", 1), ("x" * 25, 9), ("1", 9), ("(", 9), ("中", 1)], "token string, n long")
    made = seg.lexicon(counts)
    assert {r.word: r.cost for r in made.words.collect()} == {"this": round(1000 * math.log(4 / 3)), "中": round(1000 * math.log(4))}
    assert made.unknown == MORE
    nothing = seg.lexicon(counts.limit(0))
    texts = spark.createDataFrame([("thisis",)], "text string")
    assert seg.tokenized(texts, nothing).first().tokens == ["thisis"]


def test_a_large_lexicon_costs_no_more_per_character(spark):
    pick = random.Random(4)
    many = {"".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randrange(3, 12))) for _ in range(100_000)}
    some = dict.fromkeys(pick.sample(sorted(many), 100), 5)
    runs = ["".join(pick.choices(sorted(some), k=6)) for _ in range(3000)]

    class Held:
        def __init__(self, words):
            self.value = {"words": list(words), "costs": [5000] * len(words), "unknown": 12_000}

    took = []
    for words in (some, many):
        function = seg.segmenter(Held(words)).func
        import pyarrow as pa

        function(pa.array(["warm"]))
        start = time.process_time()
        function(pa.array(runs))
        took.append(time.process_time() - start)
    assert took[1] < 4 * took[0]
