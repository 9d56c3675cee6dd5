"""Majority vote over the predictions of a column's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.encoders import class_name
from fieldwarden.functions.vocab import CLASSES

FLAGS = ["insensitive", "sensitive"]


def vote(
    df: DataFrame,
    group: list[str],
    prediction: str = "prediction",
    position: str = "position",
    names: list[str] = CLASSES,
) -> DataFrame:
    """Most common prediction per group and its share; ties go to the first seen.

    ``names`` are those of the classes predicted; binary predictions have
    ``FLAGS``.

    Counts per (group, prediction) combine map-side, so a group of any size
    leaves the mappers as a handful of rows. No list of predictions is built.
    """
    counts = df.groupBy(*group, F.col(prediction).cast("int").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first")
    )
    best = counts.groupBy(*group).agg(
        F.min_by("_p", F.struct(-F.col("_n"), F.col("_first"))).alias("label"),
        F.max("_n").alias("_votes"),
        F.sum("_n").alias("n_values"),
    )
    return best.select(
        *group,
        "label",
        class_name(F.col("label"), names).alias("raw_label"),
        (F.col("_votes") / F.col("n_values")).alias("probability"),
        "n_values",
    )


def vote_in_row(predictions: Column) -> Column:
    """The same vote over a list inside one row: struct of label and probability."""
    ballots = F.transform(
        F.array_distinct(predictions),
        lambda p: F.struct(
            F.size(F.filter(predictions, lambda q: q == p)).alias("votes"),
            (-F.array_position(predictions, p)).alias("first"),
            p.alias("label"),
        ),
    )
    best = F.array_max(ballots)
    return F.struct(
        best["label"].alias("label"), (best["votes"] / F.size(predictions)).alias("probability")
    )


def gather_predictions(
    df: DataFrame, group: list[str], prediction: str = "prediction", position: str = "position"
) -> DataFrame:
    """Predictions of each request in the order of its values.

    The list has the length of the value list that came in the same request
    row, so a group holds no more than one input record did. Rows without a
    position add nothing.
    """
    pair = F.struct(F.col(position).alias("at"), F.col(prediction).cast("int").alias("p"))
    pairs = F.array_sort(F.collect_list(F.when(F.col(position).isNotNull(), pair)))
    return df.groupBy(*group).agg(F.transform(pairs, lambda x: x["p"]).alias("predictions"))


def flag_sensitive(votes: DataFrame, threshold: float, insensitive: int | None = None) -> DataFrame:
    """Votes sure enough to act on; a lower threshold covers more columns."""
    kept = votes.filter(F.col("probability") >= threshold)
    return kept if insensitive is None else kept.filter(F.col("label") != insensitive)
