"""Texts taken apart into the words of a lexicon."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.segment import (
    MAX_WORD,
    MORE,
    edge_segmenter,
    is_wordlike,
    script_runs,
    segmenter,
)
from fieldwarden.functions.text import clean_text
from fieldwarden.session import stored

# a lexicon within these bounds is broadcast; a larger one is joined
MAX_WORDS = 500_000
MAX_BYTES = 16 << 20


class Lexicon(NamedTuple):
    """``words``: a table of ``word, cost``; ``unknown``: the cost of a word seen once."""

    words: DataFrame
    unknown: int


def lexicon(counts: DataFrame, least: int = 1) -> Lexicon:
    """A lexicon from ``token, n``: lower-case words of letters or ideographs seen often enough.

    The cost of a word is ``1000 * ln(total / n)``, rounded; an unknown word
    costs no less than a further letter of it, so that a small lexicon leaves it
    whole. Words of more than 24 characters are left out, tokens that differ in
    case are one word.
    """
    word = F.lower("token")
    kept = (
        counts.filter(is_wordlike(word) & (F.char_length("token") <= MAX_WORD))
        .groupBy(word.alias("word"))
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least)
    )
    kept = stored(kept, "lexicon-counts")
    total = kept.agg(F.sum("n").alias("total")).first().total or 1

    def cost(n) -> Column:
        return F.round(F.log(F.lit(float(total)) / n) * 1000).cast("long")

    unknown = kept.sparkSession.range(1).select(cost(F.lit(1)).alias("cost")).first().cost
    return Lexicon(kept.select("word", cost(F.col("n")).alias("cost")), max(unknown, MORE))


def fits_broadcast(given: Lexicon, max_words: int = MAX_WORDS) -> bool:
    size = given.words.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")
    ).first()
    return size.n <= max_words and size.bytes <= MAX_BYTES


def broadcast_segmenter(given: Lexicon):
    """The function from runs to words over a lexicon whose size was checked."""
    rows = given.words.collect()
    value = {"words": [r.word for r in rows], "costs": [r.cost for r in rows], "unknown": given.unknown}
    return segmenter(given.words.sparkSession.sparkContext.broadcast(value))


def joined_words(runs: DataFrame, given: Lexicon) -> DataFrame:
    """``run, words`` by a join of all parts of the distinct runs with the lexicon, whatever its size."""
    size = F.char_length("run")
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    parts = starts.select(
        "run",
        "start",
        F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), size - F.col("start") + 1))).alias("size"),
    ).withColumn("word", F.substr("run", F.col("start"), F.col("size")))
    edge = F.struct(
        (F.col("start") - 1).alias("at"), (F.col("start") - 1 + F.col("size")).alias("end"), "cost"
    )
    edges = parts.join(given.words, "word").groupBy("run").agg(F.collect_list(edge).alias("edges"))
    words = edge_segmenter()(F.col("run"), F.col("edges"), F.lit(given.unknown))
    return runs.join(edges, "run", "left").select("run", words.alias("words"))


def segmented(runs: DataFrame, given: Lexicon, max_words: int = MAX_WORDS) -> DataFrame:
    """Rows of distinct ``run`` and other columns, with ``words``."""
    if fits_broadcast(given, max_words):
        return runs.withColumn("words", broadcast_segmenter(given)(F.col("run")))
    distinct = stored(runs, "runs")
    return distinct.join(joined_words(distinct.select("run"), given), "run")


def lexicon_word_counts(
    texts: DataFrame,
    given: Lexicon,
    text: str = "text",
    num_to_digits: bool = True,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """``token, n``: frequency of every word of the cleaned texts.

    Runs of one script are counted first, so each distinct run is taken apart
    once, however often it occurs; digits and punctuation never leave the JVM.
    """
    cleaned = clean_text(F.coalesce(F.col(text), F.lit("")))
    runs = texts.select(F.explode(script_runs(cleaned, num_to_digits)).alias("run"))
    counts = stored(runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")), "run-counts")
    wordlike = is_wordlike(F.col("run"))
    apart = segmented(counts.filter(wordlike), given, max_words).select(F.explode("words").alias("token"), "n")
    plain = counts.filter(~wordlike).select(F.col("run").alias("token"), "n")
    return apart.unionByName(plain).groupBy("token").agg(F.sum("n").alias("n"))


def tokenized(
    rows: DataFrame,
    given: Lexicon,
    text: str = "text",
    output: str = "tokens",
    num_to_digits: bool = True,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """All rows with the words of a text in order; none for null and empty texts.

    The distinct runs are taken apart once and joined back to their places.
    """
    cleaned = clean_text(F.coalesce(F.col(text), F.lit("")))
    listed = stored(
        rows.withColumns(
            {"_uid": F.monotonically_increasing_id(), "_runs": script_runs(cleaned, num_to_digits)}
        ),
        "runs-of-rows",
    )
    places = listed.select("_uid", F.posexplode("_runs").alias("_at", "run"))
    words = segmented(places.filter(is_wordlike(F.col("run"))).select("run").distinct(), given, max_words)
    words = stored(words.select("run", "words"), "words-of-runs")
    own = F.coalesce("words", F.array("run"))
    in_order = F.array_sort(F.collect_list(F.struct("_at", own.alias("words"))))
    gathered = (
        places.join(words, "run", "left")
        .groupBy("_uid")
        .agg(F.flatten(F.transform(in_order, lambda x: x["words"])).alias("_words"))
    )
    nothing = F.array().cast("array<string>")
    return (
        listed.join(gathered, "_uid", "left")
        .withColumn(output, F.coalesce("_words", nothing))
        .drop("_uid", "_runs", "_words")
    )
