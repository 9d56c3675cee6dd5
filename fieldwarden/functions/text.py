"""Text expressions: strip, clean, punctuation, tokens, id sequences.

Everything runs inside the JVM but Unicode normalisation, which Spark lacks.
That one goes through an Arrow function, and only rows holding characters that
normalisation could touch are sent there; the others travel as nulls.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.vocab import EOS_ID, MAX_LEN, PAD_ID, UNK_ID

# ---- Fixed values -----------------------------------------------------------

# ideographs that count as characters
HAN_RANGES = [
    (0x3007, 0x3007),
    (0x4E00, 0x9FFF),
    (0x3400, 0x4DBF),
    (0xF900, 0xFAFF),
    (0x20000, 0x2A6DF),
    (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F),
    (0x2F800, 0x2FA1F),
]
KEPT_ASCII = "A-Za-z0-9(),!?'\""

# Chinese punctuation and its ASCII counterpart, group by group
ZH_PUNCTUATION = (
    "＂＃＄％＆＇（）＊＋，－"
    "／：；＜＝＞＠［＼］＾＿"
    "｀｛｜｝～｟｠"
    "｢｣､"
    "　、〃"
    "〈〉《》「」『』【】"
    "〔〕〖〗〘〙〚〛〜〝〞〟"
    "〰"
    "〾〿"
    "–—"
    "‘’‛“”„‟"
    "…‧"
    "﹏"
    "﹑﹔"
    "·"
    "！？｡。"
)
EN_PUNCTUATION = (
    "\"#$%&'()*+,-"
    "/:;<=>@[\\]^_"
    "`{|}~()"
    "(),"
    " , "
    "()()()()()"
    "()()()()~\"\"\""
    " "
    "  "
    "--"
    "'''\"\"\"\""
    "  "
    "_"
    ",;"
    " "
    "!?.."
)

# blocks whose characters normalisation leaves alone, alone or side by side:
# ASCII, Latin letters with marks (around the few compatibility letters),
# basic Cyrillic letters, dashes and quotes, Han punctuation and unified ideographs
NORMAL_RANGES = [
    (0x00, 0x7F),
    (0xB7, 0xB7),
    (0xC0, 0x131),
    (0x134, 0x13E),
    (0x141, 0x148),
    (0x14A, 0x17E),
    (0x410, 0x44F),
    (0x2012, 0x2016),
    (0x2018, 0x2023),
    (0x3001, 0x3029),
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0x20000, 0x2A6DF),
]

# ---- Derived ----------------------------------------------------------------

# what Python's str.strip() removes
STRIP_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def char_class(ranges: list[tuple[int, int]]) -> str:
    """Regular-expression class body, in a form that Java and RE2 both read."""
    return "".join(
        rf"\x{{{lo:X}}}" if lo == hi else rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges
    )


HAN = char_class(HAN_RANGES)
DROPPED_RUN = f"[^{KEPT_ASCII}{HAN}]+"
ALL_NORMAL = f"^[{char_class(NORMAL_RANGES)}]*+$"
TOKEN = f"([0-9]|[a-z]+|[(),!?'\"]|[{HAN}])"

# full-width forms of ASCII: their compatibility form is one character each, whatever stands beside them
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F))) + " "

# stand-ins inside a padded text; clean text holds no control characters
EOS_MARK, PAD_MARK = "\x01", "\x02"


def normaliser():
    """The normalising function; nested, so it travels whole and executors need no copy of this package."""

    def nfkc(text: pa.Array) -> pa.Array:
        # pyarrow's own normalisation leaves marks uncomposed, hence the standard library
        if text.null_count == len(text):
            return text
        return pa.array(
            [None if s is None else unicodedata.normalize("NFKC", s) for s in text.to_pylist()],
            pa.string(),
        )

    return F.arrow_udf(nfkc, T.StringType())


nfkc = normaliser()


def strip(text: Column) -> Column:
    """Unicode-aware strip (``trim`` alone removes spaces only)."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def folded_width(text: Column) -> Column:
    """Texts that may change, full-width forms mapped; null for all others."""
    return F.when(~text.rlike(ALL_NORMAL), F.translate(text, FULL_WIDTH, HALF_WIDTH))


def unsettled(text: Column) -> Column:
    """What the normalising function must see; null for texts the JVM has settled."""
    folded = folded_width(text)
    return F.when(~folded.rlike(ALL_NORMAL), folded)


def normalise(text: Column) -> Column:
    """Compatibility normalisation; rows that cannot change, or only in width, stay in the JVM."""
    return F.coalesce(nfkc(unsettled(text)), folded_width(text), text)


def clean_text(text: Column, unicode_form: bool = True) -> Column:
    """Keep letters, digits, ``(),!?'"`` and Han; the rest becomes one space."""
    normal = normalise(text) if unicode_form else text
    return F.upper(F.trim(F.regexp_replace(normal, DROPPED_RUN, " ")))


def zh_punc_to_en_punc(text: Column) -> Column:
    """Chinese punctuation to ASCII; targets are no sources, so one pass does."""
    return F.translate(text, ZH_PUNCTUATION, EN_PUNCTUATION)


def split_num(text: Column, num_to_digits: bool = True) -> Column:
    """Runs of digits and non-digits, digits one by one if asked."""
    pattern = "([0-9]|[^0-9]+)" if num_to_digits else "([0-9]+|[^0-9]+)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def tokenize(cleaned: Column) -> Column:
    """Tokens of a cleaned text: digits, lower-case words, punctuation, ideographs.

    ``operators.segmentation`` splits by the words of a lexicon.
    """
    return F.regexp_extract_all(F.lower(cleaned), F.lit(TOKEN), F.lit(1))


def characters(cleaned: Column) -> Column:
    """The characters of a text; none for an empty one."""
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, ""))


def padded(cleaned: Column, size: int) -> Column:
    """Text, end mark and padding, cut to ``size`` characters."""
    marked = F.concat(F.coalesce(cleaned, F.lit("")), F.lit(EOS_MARK))
    return F.rpad(F.substring(marked, 1, size), size, PAD_MARK)


def id_table(ids: dict[str, int]) -> Column:
    """Array literal from code point to id, for constant-time lookups.

    The alphabet of cleaned text bounds it: ASCII and the Han ranges above.
    """
    if any(len(char) != 1 for char in ids):
        raise ValueError("the character dictionary holds longer tokens")
    points = {ord(char): i for char, i in ids.items()}
    table = [UNK_ID] * (max([*points, 2]) + 1)
    for point, i in points.items():
        table[point] = i
    table[ord(EOS_MARK)], table[ord(PAD_MARK)] = EOS_ID, PAD_ID
    # a folded split keeps the plan at one literal instead of one node per entry
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")


def ids_of(marked: Column, table: Column) -> Column:
    return F.transform(
        F.split(marked, ""), lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(UNK_ID))
    )


def text_sequence(cleaned: Column, size: int, table: Column) -> Column:
    """Ids of the characters, end id, padding; exactly ``size`` entries.

    A text of ``size`` characters or more loses its end id.
    """
    return ids_of(padded(cleaned, size), table)


def text_sequences(cleaned: dict[str, Column], table: Column) -> Column:
    """The sequences of several fields behind each other, with one lookup pass."""
    return ids_of(F.concat(*[padded(c, MAX_LEN[f]) for f, c in cleaned.items()]), table)
