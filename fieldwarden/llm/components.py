"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.session import stored


def _least(links: DataFrame) -> DataFrame:
    """The smallest neighbour per node, written so that adaptive execution can split its join."""
    return stored(links.groupBy("u").agg(F.min("v").alias("least")), "least")


def _state(links: DataFrame) -> tuple:
    a, b = F.xxhash64("u", "v"), F.xxhash64("v", "u")
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(a), F.bit_xor(b)).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``node, component`` per linked node; the component is its smallest node.

    Each round writes the links; a node with very many links is split by the
    skew join, as sums per node are aggregated before they are shuffled. Links
    with null or equal ends say nothing and are left out; no links, no rows.
    """
    ends = links.filter(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    )
    now = stored(ends.distinct(), "links")  # u > v
    state = _state(now)
    while True:
        # large star: neighbours above a node move to its smallest neighbour
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = (
            both.join(_least(both), "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
            .distinct()
        )
        large = stored(large, "large")
        # small star: what lies below a node moves to the smallest of it
        joined = large.join(_least(large), "u")
        small = joined.select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("least").alias("v")),
                    F.struct(F.col("u"), F.col("least").alias("v")),
                )
            ).alias("_l")
        ).select("_l.u", "_l.v")
        now = stored(small.filter(F.col("u") != F.col("v")).distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
