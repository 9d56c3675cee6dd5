"""Sampling of table rows and column values for labelling and scoring."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.crypto import decrypt
from fieldwarden.functions.vocab import KEY
from fieldwarden.operators.selection import (
    cut_rows,
    repeat_rows,
    seeded_hash,
    take_sample,
    with_copies,
)

# top-k per group and top-k stay on the map side up to this many rows; beyond, the
# same order is cut by counts, so the rows are the same on both sides
SMALL_SAMPLE = 1000

TRAINING_ROW = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "stage_table_name",
            "stage_column_name",
            "column_value",
            "column_is_sensitive",
            "column_sensitive_type",
        )
    ]
)


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def on_day(df: DataFrame, day: str | None) -> DataFrame:
    """Rows of one partition date; tables without ``dt`` are taken whole."""
    if day is None or "dt" not in df.columns:
        return df
    return df.filter(F.col("dt") == day)


def on_listed_days(df: DataFrame, table: str, days: DataFrame) -> DataFrame:
    """Rows of the partition dates that ``days`` (``table_name, day``) lists for a table.

    The list is joined, so which partitions are read is known only at run time:
    where it is small enough to broadcast, Spark prunes the scan by it. Without
    an entry there are no rows; tables without ``dt`` are taken whole.
    """
    if "dt" not in df.columns:
        return df
    wanted = days.filter(F.upper("table_name") == table.upper()).select(F.col("day").alias("dt"))
    return df.join(wanted, "dt", "left_semi").select(*df.columns)


def is_present(value: Column) -> Column:
    """Neither null nor the text NULL."""
    return value.isNotNull() & (F.upper(value) != "NULL")


def decrypt_projection(
    df: DataFrame,
    insensitive: list[str],
    sensitive: list[str],
    key: str | None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Insensitive columns as they are, sensitive ones in clear; key None means clear already."""
    clear = [(decrypt(column(c), key) if key else column(c)).alias(c) for c in sensitive]
    return df.select(*[column(c) for c in (keep or [])], *[column(c) for c in insensitive], *clear)


def decryptable_rows(df: DataFrame, sensitive: list[str], key: str | None) -> DataFrame:
    """Rows whose sensitive columns are all present, before and after decryption."""
    tests = []
    for name in sensitive:
        raw = column(name).cast("string")
        tests.append(is_present(raw))
        if key:
            tests.append(is_present(decrypt(raw, key)))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def in_order(df: DataFrame, keys: list[str], seed: int) -> list[Column]:
    """The seeded order of rows; rows that share their keys are told apart by the other columns."""
    others = [c for c in df.columns if c not in keys]
    return [seeded_hash(keys, seed), *([seeded_hash(others, seed)] if others else [])]


def sample_rows(
    df: DataFrame, size: int, keys: list[str], seed: int, distinct_rows: bool = False
) -> DataFrame:
    """Exactly ``size`` random rows of a table, or all if there are fewer.

    Copies of a row count each; ``distinct_rows`` promises unique keys, which
    saves counting them in large samples. Small samples are a distributed top-k
    that never sorts the table.
    """
    if size <= SMALL_SAMPLE:
        return df.orderBy(*in_order(df, keys, seed)).limit(size)
    return take_sample(df, size, keys, seed, distinct_rows)


def long_rows(
    df: DataFrame, table: str, columns: Mapping[str, str | None], keep: list[str] | None = None
) -> DataFrame:
    """One row per cell: key columns, value, flag and type.

    ``columns`` maps a column to its sensitive type, or to None if insensitive.
    """
    keep = keep or []
    order = [c for c, t in columns.items() if t is None] + [
        c for c, t in columns.items() if t is not None
    ]
    cells = df.select(
        *[column(c).alias(f"_k{i}") for i, c in enumerate(keep)],
        *[column(c).cast("string").alias(c) for c in order],
    ).unpivot(
        [f"_k{i}" for i in range(len(keep))],
        [column(c) for c in order],
        "_column",
        "column_value",
    )
    known = [(c, t) for c, t in columns.items() if t is not None]
    kind = F.lit(None).cast("string")
    for name, sensitive_type in known:
        kind = F.when(F.col("_column") == name, F.lit(sensitive_type)).otherwise(kind)
    return cells.select(
        F.lit(table.lower()).alias("stage_table_name"),
        F.lower("_column").alias("stage_column_name"),
        "column_value",
        F.when(kind.isNull(), "0").otherwise("1").alias("column_is_sensitive"),
        F.coalesce(kind, F.lit("0")).alias("column_sensitive_type"),
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
    )


def sample_values(
    values: DataFrame,
    size: int,
    seed: int,
    row_keys: list[str] | None = None,
    distinct: bool = False,
    by: list[str] = KEY,
) -> DataFrame:
    """Up to ``size`` non-null values per column.

    With row keys every row is equally likely; ``distinct`` draws from the
    distinct values, which suits scoring. Each map task passes on ``size`` rows
    per column at most, so a huge column is no hot group; larger samples cut
    the hash order of each column instead.
    """
    present = values.filter(F.col("column_value").isNotNull())
    if distinct:
        present = present.select(*by, "column_value").distinct()
    order = ["column_value", *(row_keys or [])] if not distinct else ["column_value"]
    if size > SMALL_SAMPLE:
        rows = present if distinct else with_copies(present)
        copies = None if distinct else "_copies"
        cut = cut_rows(rows, by, order, [lambda n: F.lit(size)], seed, copies)
        return repeat_rows(cut, F.col("_below_0")).select(*present.columns)
    ranked = Window.partitionBy(*by).orderBy(*in_order(present, order, seed))
    return present.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= size).drop("_rank")
