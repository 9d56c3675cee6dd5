"""Lines that many documents share, counted by hash and dropped in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.common import ascii_lower, prepared, stored

MIN_CHARS = 40
MIN_DOCUMENTS = 5
WHITE = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The key of a line as md5, null for a line that is too short to count."""
    key = ascii_lower(F.btrim(line, F.lit(WHITE)))
    return F.when(F.char_length(key) >= MIN_CHARS, F.md5(key))


def long_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, pos, key`` of every line that is long enough to count."""
    keys = F.transform(lines(F.col("text")), lambda line: F.unhex(line_key(line)))
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(keys).alias("pos", "key"))
    return found.filter(F.col("key").isNotNull())


def shared_lines(found: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Keys that at least ``min_documents`` documents hold: ``key, last`` (largest doc_id)."""
    holders = found.select("key", "doc_id").distinct()
    counts = holders.groupBy("key").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last"))
    return counts.filter(F.col("n") >= min_documents).select("key", "last")


def without(all_lines: Column, gone: Column) -> Column:
    """The lines but those at the given places, which ascend: the stretches between them, in one pass."""
    k = F.size(gone)

    def stretch(j: Column) -> Column:
        start = F.when(j == 0, 0).otherwise(F.get(gone, j - 1) + 1)
        end = F.when(j == k, F.size(all_lines)).otherwise(F.get(gone, j))
        return F.slice(all_lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), k), stretch))


def drop_shared_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All rows and columns of ``docs``, with ``kept_text, n_lines, n_dropped``.

    A line whose key (white space stripped at both ends, A-Z in lower case) has
    40 code points and is held by enough documents goes, except in the largest
    doc_id that holds it. Rows that share a doc_id are one document; rows without
    one are no document that counts, and lose their shared lines like others.
    Null and empty texts are one empty line; a text that loses all its lines is
    empty. No row is dropped; input columns of the added names are replaced.

    Each text is cut and hashed once for the keys, which are written with their
    places. Shared keys are written too, so that the join by key meets two plain
    tables and adaptive execution can split a line that a third of all documents
    hold. Doomed places come back to their rows by doc_id and a hash of the text,
    as rows that agree in both lose the same lines.
    """
    prepared(docs.sparkSession)
    found = stored(long_lines(docs), "long-lines")
    shared = stored(shared_lines(found, min_documents), "shared-lines")
    doomed = (
        found.join(shared, "key")
        .filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
        .agg(F.array_sort(F.collect_set("pos")).alias("_gone"))
    )
    doomed = stored(doomed, "doomed-lines")
    added = ["kept_text", "n_lines", "n_dropped"]
    rest = [c for c in docs.columns if c not in added]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.xxhash64("text").alias("_own"))
    names = {c: f"c{i}" for i, c in enumerate(rest)}
    text, own = F.col(names["text"]), F.col(names["doc_id"]).eqNullSafe(F.col("_doc"))
    joined = rows.join(doomed, own & (F.col("_own") == F.col("_hash")), "left")
    # a column of its own: a lambda would cut the text anew for each stretch
    joined = joined.withColumn("_lines", lines(text))
    untouched = F.col("_gone").isNull()
    kept = F.array_join(without(F.col("_lines"), F.col("_gone")), "\n")
    out = joined.select(
        *names.values(),
        F.when(untouched, F.coalesce(text, F.lit(""))).otherwise(kept),
        F.size("_lines").cast("long"),
        F.when(untouched, 0).otherwise(F.size("_gone")).cast("long"),
    )
    return out.toDF(*rest, *added)
