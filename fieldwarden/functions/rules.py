"""Keyword and pattern hints: the baseline that the classifier replaces.

They serve as weak labels and as a model-free predictor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldwarden.functions.encoders import strings
from fieldwarden.functions.vocab import CLASSES, INSENSITIVE

# ---- Fixed values: value patterns, in order of precedence -------------------
# Plain enough for any engine: no look-around, no word boundaries.
VALUE_PATTERNS = {
    "身份证": r"(?:^|[^0-9])[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx](?:[^0-9]|\z)",
    "邮箱": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "卡号": r"(?:^|[^0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?:[0-9]{1,3})?(?:[^0-9]|\z)",
    "手机": r"(?:^|[^0-9])1[3-9][0-9]{9}(?:[^0-9]|\z)",
    "固定电话": r"(?:^|[^0-9])0[0-9]{2,3}-[0-9]{7,8}(?:[^0-9]|\z)|\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?:[^0-9]|\z)",
}
# Words in names and comments, matched in lower case
KEYWORDS = {
    "身份证": ["身份证", "证件号", "id_card", "idcard", "id_no", "cert_no"],
    "邮箱": ["邮箱", "邮件", "email", "e_mail", "mail"],
    "卡号": ["卡号", "银行卡", "card_no", "bank_card", "account_no"],
    "手机": ["手机", "移动电话", "mobile", "cell_phone"],
    "固定电话": ["固定电话", "座机", "telephone", "tel_no", "landline"],
    "地址": ["地址", "住址", "address", "addr"],
    "姓名": ["姓名", "名字", "real_name", "full_name", "user_name", "cust_name"],
}

INSENSITIVE_ID = CLASSES.index(INSENSITIVE)


def value_class(value: Column) -> Column:
    """First class whose pattern occurs in the value, else null."""
    return F.coalesce(
        *[F.when(value.rlike(pattern), F.lit(name)) for name, pattern in VALUE_PATTERNS.items()]
    )


def value_hits(value: Column) -> dict[str, Column]:
    """How often each pattern occurs in a text."""
    return {name: F.regexp_count(value, F.lit(p)) for name, p in VALUE_PATTERNS.items()}


def keyword_class(*texts: Column) -> Column:
    """First class with a keyword in any of the texts, else null."""
    text = F.lower(F.concat_ws(" ", *texts))
    found = []
    for name, words in KEYWORDS.items():
        hit = F.contains(text, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(text, F.lit(word))
        found.append(F.when(hit, F.lit(name)))
    return F.coalesce(*found)


def rule_class_id(value: Column, keyword: Column) -> Column:
    """Class id by rules alone: the value decides, then the keyword of its column."""
    name = F.coalesce(value_class(value), keyword, F.lit(INSENSITIVE))
    return (F.array_position(strings(CLASSES), name) - 1).cast("int")
