"""Logged conversations that are cumulative snapshots: keep the longest, render it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwarden.llm.common import prepared, stored

BLOCK = 512  # turn numbers that one task orders together
PART = 256  # turns in one rendered part


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    match = F.lit(True)
    for name in names:
        match = match & a[name].eqNullSafe(b[name])
    return match


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, block, rank, pos, role, text``: every turn with its place from 0.

    A conversation is ordered by turn (null first), role and text. It is cut
    into blocks of turn numbers, so that a conversation of very many turns is
    spread; the counts of its blocks give their offsets.
    """
    rows = turns.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).alias("block"), "turn", "role", "text"
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(
        "conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    place = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    ranked = rows.withColumn("rank", F.row_number().over(place) - 1)
    return (
        ranked.join(offsets, _same(ranked, offsets, "conv_id", "block"))
        .select(
            ranked["conv_id"],
            ranked["block"],
            "rank",
            (F.col("offset") + F.col("rank")).alias("pos"),
            "role",
            "text",
        )
    )


def prefix_hashes(ordered: DataFrame) -> DataFrame:
    """``conv_id, turns, n, a, b``: 128-bit hash of each prefix of ``turns`` turns, of ``n``.

    A turn is hashed with its place and the hashes are added by exclusive or, so
    prefixes roll within a block and blocks combine.
    """
    parts = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    hashed = ordered.select(
        "conv_id", "block", "pos", F.xxhash64(*parts).alias("x"), F.xxhash64(F.lit("second"), *parts).alias("y")
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hashed.groupBy("conv_id", "block").agg(
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count(F.lit(1)).alias("m")
    )
    bases = blocks.select(
        "conv_id",
        "block",
        F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("x0"),
        F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("y0"),
        F.sum("m").over(Window.partitionBy("conv_id")).alias("n"),
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumns({"x": F.bit_xor("x").over(upto), "y": F.bit_xor("y").over(upto)})
    return rolled.join(bases, _same(rolled, bases, "conv_id", "block")).select(
        rolled["conv_id"],
        (F.col("pos") + 1).alias("turns"),
        "n",
        F.col("x").bitwiseXOR(F.col("x0")).alias("a"),
        F.col("y").bitwiseXOR(F.col("y0")).alias("b"),
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_equal``: one conversation per text that no longer one begins with.

    Of equal conversations the smallest conv_id stays and ``n_equal`` counts
    them. Prefixes are made distinct before the anti-join, so a first turn that
    very many conversations share is one row there.
    """
    proper = prefixes.filter(F.col("turns") < F.col("n")).select("turns", "a", "b").distinct()
    whole = (
        prefixes.filter(F.col("turns") == F.col("n"))
        .groupBy("turns", "a", "b")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    )
    return whole.join(proper, ["turns", "a", "b"], "left_anti").select(
        "conv_id", F.col("turns").alias("n_turns"), "n_equal"
    )


def rendered_turn() -> Column:
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """Maximal conversations as chat text: ``conv_id, part, n_turns, n_equal, rendered``.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. A
    conversation goes if another one begins with all its turns and goes on.
    Turns are compared by role and text, null and empty being different; turn
    numbers only order them, so gaps do not matter, and repeated rows are turns
    of their own. Rows without conv_id are one conversation. A conversation is
    rendered in parts of 256 turns, so a single one never has to fit a task.
    Null roles and texts render as empty ones. No turns, no rows.
    """
    prepared(turns.sparkSession)
    ordered = stored(ordered_turns(turns), "turns")
    kept = stored(maximal_conversations(stored(prefix_hashes(ordered), "prefixes")), "maximal")
    parts = ordered.join(kept, _same(ordered, kept, "conv_id")).select(
        ordered["conv_id"],
        F.floor(F.col("pos") / PART).alias("part"),
        "n_turns",
        "n_equal",
        "pos",
        rendered_turn().alias("turn"),
    )
    texts = F.array_sort(F.collect_list(F.struct("pos", "turn")))
    return parts.groupBy("conv_id", "part", "n_turns", "n_equal").agg(
        F.array_join(F.transform(texts, lambda t: t["turn"]), "").alias("rendered")
    )
