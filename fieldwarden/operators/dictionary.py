"""Character and word dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwarden.functions.text import characters, clean_text, tokenize
from fieldwarden.functions.vocab import (
    DICTIONARY_META_FIELDS,
    EOS,
    EOS_ID,
    FIRST_TOKEN_ID,
    PAD,
    PAD_ID,
    UNK,
    UNK_ID,
)
from fieldwarden.operators.selection import PREFIX

# cleaned text has 44 ASCII characters and the ideographs of Unicode
MAX_ALPHABET = 200_000


def dictionary_texts(meta: DataFrame, values: DataFrame) -> DataFrame:
    """All texts that feed a dictionary, with how often each occurs.

    Names and comments of databases and tables recur on every column, so equal
    metadata texts are counted before they are taken apart.
    """
    meta_texts = (
        meta.unpivot([], DICTIONARY_META_FIELDS, "_field", "text")
        .groupBy("text")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return meta_texts.unionByName(values.select(F.col("column_value").alias("text"), F.lit(1).cast("long").alias("n")))


def count_tokens(texts: DataFrame, tokens: Column, weight: Column) -> DataFrame:
    split = texts.select(F.explode(tokens).alias("token"), weight.alias("_w"))
    return split.groupBy("token").agg(F.sum("_w").alias("n"))


def char_counts(texts: DataFrame, text: str = "text", weight: Column | None = None) -> DataFrame:
    """Frequency of every character of the cleaned texts."""
    cleaned = clean_text(F.coalesce(F.col(text), F.lit("")))
    weight = F.lit(1).cast("long") if weight is None else weight
    return count_tokens(texts, characters(cleaned), weight)


def word_counts(texts: DataFrame, text: str = "text", weight: Column | None = None) -> DataFrame:
    """Frequency of every token of the cleaned texts."""
    cleaned = clean_text(F.coalesce(F.col(text), F.lit("")))
    weight = F.lit(1).cast("long") if weight is None else weight
    return count_tokens(texts, tokenize(cleaned), weight)


def special_tokens(counts: DataFrame) -> DataFrame:
    by_id = {PAD_ID: PAD, UNK_ID: UNK, EOS_ID: EOS}
    names = F.array(*[F.lit(by_id[i]) for i in range(FIRST_TOKEN_ID)])
    ids = counts.sparkSession.range(0, FIRST_TOKEN_ID, 1, 1)
    return ids.select(
        F.get(names, F.col("id").cast("int")).alias("token"),
        F.col("id").cast("int").alias("id"),
        F.lit(0).cast("long").alias("n"),
    )


def char_dictionary(counts: DataFrame) -> DataFrame:
    """Ids by falling frequency, ties by code point, after the special tokens.

    The alphabet bounds this relation, so one window over it is small.
    """
    order = Window.orderBy(F.col("n").desc(), "token")
    ids = counts.select(
        "token", (F.row_number().over(order) + (FIRST_TOKEN_ID - 1)).cast("int").alias("id"), "n"
    )
    return special_tokens(counts).unionByName(ids)


def word_dictionary(counts: DataFrame) -> DataFrame:
    """Ids by falling frequency for any number of words, ties by hash.

    Words are numbered within (frequency, hash prefix); the offsets come from
    the counts of these groups. Distinct frequencies grow with the square root
    of the text at most, so the one global window stays small. The counts are
    read three times: hand in a stored table.
    """
    words = counts.withColumn("_h", F.md5("token")).withColumn(
        "_bucket", F.substring("_h", 1, PREFIX)
    )
    groups = words.groupBy("n", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    per_n = groups.groupBy(F.col("n").alias("_n")).agg(F.sum("_size").alias("_words"))
    more_frequent = per_n.select(
        "_n",
        (F.sum("_words").over(Window.orderBy(F.col("_n").desc())) - F.col("_words")).alias("_more"),
    )
    before = F.sum("_size").over(Window.partitionBy("n").orderBy("_bucket")) - F.col("_size")
    offsets = (
        groups.withColumn("_before", before)
        .join(more_frequent, F.col("n") == F.col("_n"))
        .select("_n", F.col("_bucket").alias("_b"), (F.col("_more") + F.col("_before")).alias("_offset"))
    )
    rank = F.row_number().over(Window.partitionBy("n", "_bucket").orderBy("_h", "token"))
    ids = (
        words.withColumn("_rank", rank)
        .join(offsets, (F.col("n") == F.col("_n")) & (F.col("_bucket") == F.col("_b")))
        .select(
            "token",
            (F.col("_offset") + F.col("_rank") + (FIRST_TOKEN_ID - 1)).alias("id"),
            "n",
        )
    )
    return special_tokens(counts).withColumn("id", F.col("id").cast("long")).unionByName(ids)


def char_ids(dictionary: DataFrame) -> dict[str, int]:
    """The character dictionary on the driver, after a check of its size."""
    rows = (
        dictionary.filter(F.col("id") >= FIRST_TOKEN_ID)
        .select("token", "id")
        .limit(MAX_ALPHABET + 1)
        .collect()
    )
    if len(rows) > MAX_ALPHABET:
        raise ValueError("more characters than cleaned text can hold")
    return {row.token: row.id for row in rows}
