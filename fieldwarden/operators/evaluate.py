"""Evaluation of predictions: matrix, report, accuracy, loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwarden.functions.encoders import class_name
from fieldwarden.functions.vocab import CLASSES

SUMMARY = "AVG / TOTAL"


def class_frame(df: DataFrame) -> DataFrame:
    """All classes, so that reports show those which never occur."""
    ids = df.sparkSession.range(0, len(CLASSES), 1, 1).select(F.col("id").cast("int").alias("class_id"))
    return ids.select("class_id", class_name(F.col("class_id")).alias("class"))


def pair_counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """At most one row per pair of classes: all that the reports need."""
    return df.groupBy(
        F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Counts with actual classes as rows and predicted classes as columns."""
    pairs = pair_counts(df, actual, predicted)
    ids = list(range(len(CLASSES)))
    cells = [F.coalesce(F.sum(F.when(F.col("predicted") == i, F.col("n"))), F.lit(0)) for i in ids]
    rows = class_frame(df).join(pairs, F.col("class_id") == F.col("actual"), "left")
    return rows.groupBy("class_id", "class").agg(
        *[c.alias(CLASSES[i]) for i, c in zip(ids, cells, strict=True)]
    )


def classification_report(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Precision, recall, F1 and support of every class and their plain means."""
    pairs = pair_counts(df, actual, predicted)
    hit = F.col("actual") == F.col("predicted")
    # each pair feeds the class it belongs to and the class it was given
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("actual").alias("id"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(hit, F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("id"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("hits"),
                ),
            )
        ).alias("side")
    ).select("side.*")
    per_class = (
        class_frame(df)
        .join(sides, F.col("class_id") == F.col("id"), "left")
        .groupBy("class_id", "class")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["support", "predicted", "hits"]])
    )
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    scored = per_class.withColumns({"precision": precision, "recall": recall}).select(
        "class_id",
        "class",
        "precision",
        "recall",
        F.coalesce(
            F.try_divide(
                F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")
            ),
            F.lit(0.0),
        ).alias("f1"),
        "support",
    )
    summary = scored.agg(
        F.lit(len(CLASSES)).alias("class_id"),
        F.lit(SUMMARY).alias("class"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.sum("support").alias("support"),
    )
    return scored.unionByName(summary)


def accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    hit = (F.col(actual) == F.col(predicted)).cast("int")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def batch_accuracy(
    df: DataFrame,
    position: str,
    batch_size: int,
    actual: str = "actual",
    predicted: str = "predicted",
) -> DataFrame:
    """Mean of the accuracies of consecutive batches, as training logs report it."""
    hit = (F.col(actual) == F.col(predicted)).cast("int")
    batches = df.groupBy(F.floor(F.col(position) / batch_size).alias("batch")).agg(
        F.avg(hit).alias("_a")
    )
    return batches.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("_a").alias("accuracy"))


def row_loss(probability: str, floor: float = 1e-15) -> Column:
    """Cross-entropy of a row, given the probability of its true class."""
    return -F.log(F.greatest(F.col(probability), F.lit(floor)))


def binary_row_loss(
    label: str, probability: str, positive_weight: float = 1.0, floor: float = 1e-15
) -> Column:
    """Sigmoid cross-entropy of a row; positives weigh ``positive_weight``."""
    p = F.col(probability)
    positive = -F.log(F.greatest(p, F.lit(floor))) * positive_weight
    negative = -F.log(F.greatest(1 - p, F.lit(floor)))
    return F.when(F.col(label) == 1, positive).otherwise(negative)


def mean_losses(df: DataFrame, losses: dict[str, Column]) -> DataFrame:
    """``kind, n, loss`` for each loss, all from one pass."""
    means = [F.avg(loss).alias(f"_{i}") for i, loss in enumerate(losses.values())]
    rows = [F.struct(F.lit(kind).alias("kind"), "n", F.col(f"_{i}").alias("loss")) for i, kind in enumerate(losses)]
    return df.agg(F.count(F.lit(1)).alias("n"), *means).select(F.inline(F.array(*rows)))


def log_loss(
    df: DataFrame, probability: str = "p_true", weight: Column | None = None, floor: float = 1e-15
) -> DataFrame:
    """Mean (weighted) cross-entropy, given the probability of the true class.

    Weights scale each row's loss; the mean is over rows, not over weights.
    """
    weighted = row_loss(probability, floor) * (F.lit(1.0) if weight is None else weight)
    return mean_losses(df, {"": weighted}).drop("kind")


def binary_log_loss(
    df: DataFrame,
    label: str,
    probability: str,
    positive_weight: float = 1.0,
    floor: float = 1e-15,
) -> DataFrame:
    """Mean sigmoid cross-entropy; positives weigh ``positive_weight``."""
    return mean_losses(df, {"": binary_row_loss(label, probability, positive_weight, floor)}).drop("kind")


def threshold_curve(rows: DataFrame, label: str, score: str, bins: int = 1000) -> DataFrame:
    """``threshold, n_accepted, n_right, precision, recall, coverage`` at every threshold that occurs.

    ``label`` is 0 or 1; a row is accepted from its score on, scores counted in
    ``bins`` steps. One histogram, whose size is fixed, and prefix sums over it.
    """
    step = F.least(F.floor(F.col(score) * bins), F.lit(bins)).cast("long")
    counts = rows.filter(F.col(score).isNotNull()).groupBy(step.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("hits")
    )
    above = Window.orderBy(F.col("bin").desc())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = counts.select(
        "bin",
        F.sum("n").over(above).alias("n_accepted"),
        F.sum("hits").over(above).alias("n_right"),
        F.sum("n").over(whole).alias("n_rows"),
        F.sum("hits").over(whole).alias("n_positive"),
    )
    return summed.select(
        (F.col("bin") / bins).alias("threshold"),
        "n_accepted",
        "n_right",
        (F.col("n_right") / F.col("n_accepted")).alias("precision"),
        F.coalesce(F.try_divide("n_right", "n_positive"), F.lit(0.0)).alias("recall"),
        (F.col("n_accepted") / F.col("n_rows")).alias("coverage"),
    )


def choose_threshold(curve: DataFrame, precision: float) -> float | None:
    """The threshold of the widest coverage at which enough of what is accepted is right."""
    good = curve.filter(F.col("precision") >= precision)
    return good.agg(F.max_by("threshold", "n_accepted").alias("threshold")).first().threshold
