"""Exact seeded selection without one hot task.

A row's place in the random order is the md5 of the seed and its key: a
function of the data, the same after a retry and in every engine. Cutting that
order at an exact row count needs no global sort: count the rows per hash
prefix, find the prefix the cut falls in, and rank only the rows that share it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 4  # hex digits: 65,536 buckets per stratum
CHUNK = 1 << 16  # most copies one generator call emits
MAX_BROADCAST_STRATA = 10_000

Cut = Callable[[Column], Column]


def seeded_hash(keys: list[str], seed: int) -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def renamed(df: DataFrame, keys: list[str], prefix: str = "_s") -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{i}" for i, k in enumerate(keys)})


def stratum_match(keys: list[str], prefix: str = "_s") -> Column:
    return reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)],
    )


def broadcast_if_few(bounds: DataFrame, rows: DataFrame, strata: list[str]) -> DataFrame:
    """Mark one-row-per-stratum bounds for broadcast after counting the strata.

    Few strata are the usual case, and the rows then need no shuffle; with many
    the join shuffles, and adaptive execution splits a hot stratum.
    """
    few = rows.select(*strata).distinct().limit(MAX_BROADCAST_STRATA + 1).count()
    return F.broadcast(bounds) if few <= MAX_BROADCAST_STRATA else bounds


def with_copies(df: DataFrame, copies: str = "_copies") -> DataFrame:
    """Distinct rows and how often each occurs; equal rows meet already map-side."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))


def cut_rows(
    df: DataFrame,
    strata: list[str],
    keys: list[str],
    cuts: list[Cut],
    seed: int,
    copies: str | None = None,
) -> DataFrame:
    """Cut every stratum's random order at exact positions.

    Each cut maps the size of a stratum to a row count; cuts must not decrease.
    Adds ``_below_0, _below_1, ...``: how many copies of the row lie before the
    cut (0 or 1 unless ``copies`` names a column of multiplicities). Without
    multiplicities the keys must be unique; with them, rows that share their
    keys are told apart by all their columns.
    The input is scanned three times, twice for the key columns alone.
    """
    weight = F.col(copies) if copies else F.lit(1)
    place = seeded_hash(keys, seed)
    others = [c for c in df.columns if c != copies and c not in keys]
    if copies and others:
        place = F.concat(place, seeded_hash(others, seed))
    rows = df.withColumn("_h", place).withColumn("_bucket", F.substring("_h", 1, PREFIX))
    narrow = rows.select(*strata, "_h", "_bucket", weight.cast("long").alias("_n"))

    # at most 65,536 rows per stratum from here on
    in_order = Window.partitionBy(*strata).orderBy("_bucket")
    histogram = (
        narrow.groupBy(*strata, "_bucket")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_before", F.sum("_n").over(in_order) - F.col("_n"))
        .withColumn("_size", F.sum("_n").over(Window.partitionBy(*strata)))
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("cut"),
                F.least(cut(F.col("_size")).cast("long"), F.col("_size")).alias("rows"),
            )
            for i, cut in enumerate(cuts)
        ]
    )
    marks = (
        histogram.select("*", F.explode(wanted).alias("_w"))
        .filter(
            (F.col("_before") < F.col("_w.rows"))
            & (F.col("_w.rows") <= F.col("_before") + F.col("_n"))
        )
        .select(
            *strata,
            F.col("_bucket").alias("_mark"),
            F.col("_w.cut").alias("_cut"),
            (F.col("_w.rows") - F.col("_before")).alias("_left"),
        )
    )

    inside = narrow.join(
        renamed(marks, strata),
        reduce(
            lambda a, b: a & b,
            [F.col("_bucket") == F.col("_mark")] + ([stratum_match(strata)] if strata else []),
        ),
    )
    ranked = Window.partitionBy(*strata, "_cut").orderBy("_h")
    last = (
        inside.withColumn("_upto", F.sum("_n").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("_upto") - F.col("_n") < F.col("_left")) & (F.col("_left") <= F.col("_upto")))
        .withColumn("_at", F.col("_left") - F.col("_upto") + F.col("_n"))
    )
    fields = {}
    for i in range(len(cuts)):
        here = F.col("_cut") == i
        fields[f"_h{i}"] = F.max(F.when(here, F.col("_h")))
        fields[f"_at{i}"] = F.max(F.when(here, F.col("_at")))
    bounds = [e.alias(name) for name, e in fields.items()]

    if strata:
        per_stratum = renamed(last.groupBy(*strata).agg(*bounds), strata)
        joined = rows.join(
            broadcast_if_few(per_stratum, df, strata), stratum_match(strata), "left"
        )
    else:
        only = last.agg(*bounds).select(F.struct(*fields).alias("_b")).scalar()
        joined = rows.withColumn("_b", only).select("*", "_b.*").drop("_b")

    below = {}
    for i in range(len(cuts)):
        at = F.col(f"_h{i}")
        below[f"_below_{i}"] = (
            F.when(F.col("_h") < at, weight).when(F.col("_h") == at, F.col(f"_at{i}")).otherwise(0)
        ).cast("long")
    return joined.withColumns(below).select(*df.columns, *below)


def take_sample(
    df: DataFrame, size: int, keys: list[str], seed: int, distinct_rows: bool = False
) -> DataFrame:
    """Exactly ``size`` random rows, or all if there are fewer.

    ``distinct_rows`` promises unique keys, which saves counting the copies.
    """
    if distinct_rows:
        cut = cut_rows(df, [], keys, [lambda n: F.lit(size)], seed)
        return cut.filter(F.col("_below_0") > 0).select(*df.columns)
    cut = cut_rows(with_copies(df), [], keys, [lambda n: F.lit(size)], seed, copies="_copies")
    return repeat_rows(cut, F.col("_below_0")).select(*df.columns)


def repeat_rows(df: DataFrame, times: Column, index: str = "_copy") -> DataFrame:
    """Emit each row ``times`` times, numbered from 0.

    Rows repeated very often are first cut into chunks that are spread over the
    cluster, so no task emits them alone.
    """
    counted = df.withColumn("_times", times.cast("long")).filter(F.col("_times") > 0)
    few = counted.filter(F.col("_times") <= CHUNK).withColumn(
        index, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1))
    )
    many = (
        counted.filter(F.col("_times") > CHUNK)
        .withColumn(
            "_chunk",
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / CHUNK))),
        )
        .repartition("_chunk")
    )
    first = F.col("_chunk") * CHUNK
    many = many.withColumn(
        index,
        F.explode(F.sequence(first, F.least(first + CHUNK, F.col("_times")) - 1)),
    ).drop("_chunk")
    return few.unionByName(many).drop("_times")


def row_positions(
    df: DataFrame, keys: list[str], seed: int, distinct_rows: bool = False
) -> DataFrame:
    """Number all rows from 0 in the seeded random order, as ``_position``.

    Offsets come from the counts per hash prefix, so each window holds one
    prefix only. Copies of a row are numbered as a block and expanded after.
    """
    rows = df if distinct_rows else with_copies(df)
    weight = F.lit(1) if distinct_rows else F.col("_copies")
    rows = rows.withColumn("_h", seeded_hash(keys, seed)).withColumn(
        "_bucket", F.substring("_h", 1, PREFIX)
    )
    counts = rows.groupBy("_bucket").agg(F.sum(weight).alias("_n"))
    offsets = counts.select(
        F.col("_bucket").alias("_b"),
        (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"),
    )
    in_bucket = (
        Window.partitionBy("_bucket")
        .orderBy("_h", *keys)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # offsets: 16^PREFIX rows at most, whatever the input
    placed = rows.join(F.broadcast(offsets), F.col("_bucket") == F.col("_b")).withColumn(
        "_position", F.col("_before") + F.sum(weight).over(in_bucket) - weight
    )
    if distinct_rows:
        return placed.select(*df.columns, "_position")
    return repeat_rows(placed, F.col("_copies")).select(
        *df.columns, (F.col("_position") + F.col("_copy")).alias("_position")
    )


def batch_ids(
    df: DataFrame,
    keys: list[str],
    batch_size: int,
    epochs: int = 1,
    seed: int = 0,
    distinct_rows: bool = False,
) -> DataFrame:
    """Mini-batches of ``batch_size`` rows, the last one short, for every epoch."""
    placed = row_positions(df, keys, seed, distinct_rows)
    return placed.select(
        F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"),
        F.floor(F.col("_position") / batch_size).alias("batch_id"),
        *df.columns,
    )
