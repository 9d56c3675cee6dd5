"""Label hygiene, splits and class balance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.vocab import UNCLEAN_TYPES
from fieldwarden.operators.selection import (
    CHUNK,
    cut_rows,
    repeat_rows,
    take_sample,
    with_copies,
)

SEED = 112358
SPLITS = ("train", "valid", "test")


def drop_unlabelled(meta: DataFrame) -> DataFrame:
    """Columns with a sensitivity flag; other gaps become empty strings."""
    return meta.na.drop(subset=["column_is_sensitive"]).na.fill("")


def clean_sensitive(meta: DataFrame) -> DataFrame:
    """Sensitive columns with a usable type; a missing type drops out too."""
    kind = F.col("column_sensitive_type")
    return meta.filter((F.col("column_is_sensitive") == "1") & ~kind.isin(UNCLEAN_TYPES))


def clean_insensitive(meta: DataFrame) -> DataFrame:
    return meta.filter(
        (F.col("column_is_sensitive") == "0") & F.col("column_sensitive_type").isNull()
    )


def clean_labels(meta: DataFrame) -> DataFrame:
    """Sensitive columns with a usable type and all insensitive columns."""
    flag, kind = F.col("column_is_sensitive"), F.col("column_sensitive_type")
    typed = (flag == "1") & ~kind.isin(UNCLEAN_TYPES)
    return meta.filter(F.coalesce(typed, F.lit(False)) | ((flag == "0") & kind.isNull()))


def undersample(
    meta: DataFrame, majority: int, keys: list[str], seed: int = SEED, distinct_rows: bool = False
) -> DataFrame:
    """Clean columns with the insensitive ones cut to ``majority`` random rows."""
    few = take_sample(clean_insensitive(meta), majority, keys, seed, distinct_rows)
    return clean_sensitive(meta).unionByName(few)


def share_of(fraction: float):
    """Row count of a fraction, halves to even."""
    return lambda size: F.bround(F.lit(float(fraction)) * size.cast("double"), 0)


def split_stratified(
    meta: DataFrame,
    keys: list[str],
    strata: list[str] | None = None,
    train: float = 0.7,
    valid: float = 0.2,
    seed: int = SEED,
    distinct_rows: bool = False,
) -> DataFrame:
    """Three-way split by sensitive type, with a ``split`` column.

    ``train`` of each type is drawn first and ``valid`` of that is set aside; a
    column is in one split only. With copies in the input the splits follow set
    difference: a row drawn once leaves the other side and stays there once,
    while ``valid`` keeps every copy drawn.
    """
    strata = ["column_sensitive_type"] if strata is None else strata

    def valid_rows(size: Column) -> Column:
        return share_of(valid)(share_of(train)(size))

    cuts = [valid_rows, share_of(train)]
    if distinct_rows:
        cut = cut_rows(meta, strata, keys, cuts, seed)
        label = F.when(F.col("_below_0") > 0, "valid").when(F.col("_below_1") > 0, "train")
        return cut.select(*meta.columns, label.otherwise("test").alias("split"))
    cut = cut_rows(with_copies(meta), strata, keys, cuts, seed, copies="_copies")
    in_valid, in_train = F.col("_below_0") > 0, F.col("_below_1") > 0
    label = F.when(in_valid, "valid").when(in_train, "train").otherwise("test")
    times = F.when(in_valid, F.col("_below_0")).otherwise(F.lit(1))
    return repeat_rows(cut.withColumn("split", label), times).select(*meta.columns, "split")


def split_random(
    df: DataFrame, test: float, keys: list[str], seed: int = SEED, distinct_rows: bool = False
) -> DataFrame:
    """Random two-way split with exactly ``ceil(test * n)`` test rows."""

    def test_rows(size: Column) -> Column:
        return F.ceil(F.lit(float(test)) * size.cast("double"))

    if distinct_rows:
        cut = cut_rows(df, [], keys, [test_rows], seed)
        label = F.when(F.col("_below_0") > 0, "test").otherwise("train")
        return cut.select(*df.columns, label.alias("split"))
    cut = cut_rows(with_copies(df), [], keys, [test_rows], seed, copies="_copies")
    parts = [("test", F.col("_below_0")), ("train", F.col("_copies") - F.col("_below_0"))]
    halves = cut.withColumn(
        "_part", F.explode(F.array(*[F.struct(F.lit(s).alias("split"), n.alias("n")) for s, n in parts]))
    )
    return repeat_rows(halves, F.col("_part.n")).select(*df.columns, "_part.split")


def split_class_counts(split: DataFrame) -> DataFrame:
    """Columns per split and type; the insensitive type is shown as such."""
    return split.groupBy("split", "column_sensitive_type").agg(F.count(F.lit(1)).alias("n"))


def is_minority() -> Column:
    return F.coalesce(F.col("column_is_sensitive") == "1", F.lit(False))


def imbalance_ratio(df: DataFrame) -> int:
    """How often sensitive rows must occur to outweigh the others, at least once."""
    few, rest = df.agg(F.count_if(is_minority()), F.count_if(~is_minority())).first()
    return max(1, math.ceil(rest / few)) if few else 1


def oversample(df: DataFrame, ratio: int | None = None) -> DataFrame:
    """Repeat sensitive rows until they match the others; one scan for any usual ratio."""
    ratio = imbalance_ratio(df) if ratio is None else ratio
    if ratio <= CHUNK:
        copies = F.when(is_minority(), F.lit(ratio)).otherwise(F.lit(1))
        return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
    rare = repeat_rows(df.filter(is_minority()), F.lit(ratio)).drop("_copy")
    return rare.unionByName(df.filter(~is_minority()))


def oversample_splits(split: DataFrame, only: tuple[str, ...] = ("train",)) -> DataFrame:
    """Balance the training split; the others keep their natural shares unless named."""
    balanced = oversample(split.filter(F.col("split").isin(*only)))
    return balanced.unionByName(split.filter(~F.col("split").isin(*only)))
