"""Joining sampled values to the metadata of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.text import strip
from fieldwarden.functions.vocab import KEY
from fieldwarden.operators.selection import renamed, stratum_match
from fieldwarden.session import estimated_size

# estimated size of metadata above which its encoded form, many times as large, is not broadcast
LARGE_META = 2 << 20

META_ALIASES = {"database_is_shard_table": "database_is_shard"}


def normalise_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({k: strip(F.upper(k)) for k in KEY})


def fill_missing(df: DataFrame) -> DataFrame:
    """Every missing string becomes an empty one."""
    return df.na.fill("")


def shuffled_if_large(encoded: DataFrame, meta: DataFrame) -> DataFrame:
    """Encoded metadata, to be joined by a shuffle where there is much of it.

    The optimizer counts a vector or an array as a few bytes and would send
    gigabytes of them through the driver.
    """
    return encoded.hint("merge") if estimated_size(meta) > LARGE_META else encoded


def attach(values: DataFrame, meta: DataFrame) -> DataFrame:
    """Inner join on the normalised keys; missing keys match each other.

    No side is forced: the optimizer broadcasts the metadata where its size is
    below the threshold, and adaptive execution splits hot columns otherwise.
    """
    right = renamed(normalise_keys(meta), KEY, "_m")
    joined = normalise_keys(values).join(right, stratum_match(KEY, "_m"), "inner")
    return joined.drop(*[f"_m{i}" for i in range(len(KEY))])


def value_with_meta(values: DataFrame, meta: DataFrame) -> DataFrame:
    """Each value with the metadata and labels of its column, no nulls left."""
    meta = meta.withColumnsRenamed(META_ALIASES)
    return fill_missing(attach(values.select(*KEY, "column_value"), meta))
