"""A network over the wide vector and learned text representations, trained in steps.

Each text branch, metadata and value, learns what its 3-grams say of the classes;
hidden layers join both with the wide vector, which a sum of weights cannot. A
step fits one mini-batch from the weights of the step before; what it reached is
written, so a run that was stopped goes on from there.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.functions.vocab import CLASSES, KEY, WIDE_SIZE
from fieldwarden.operators.evaluate import accuracy
from fieldwarden.plans.learn import META_VECTOR, VALUE_VECTOR
from fieldwarden.session import stored
from fieldwarden.sources.store import path_exists

# the wide slots stand in front of the hashed 3-grams; the last one is the value's
WIDE_SLOTS = {META_VECTOR: WIDE_SIZE - 1, VALUE_VECTOR: 1}
LOG = "step int, batch int, accuracy double"

# ---- text branches ---------------------------------------------------------------------

Branches = dict[str, LogisticRegressionModel]


def learn_branches(rows: DataFrame, label: str = "class_id", max_iter: int = 20, reg: float = 1e-4) -> Branches:
    """For each branch weights from its 3-grams to the classes, from rows of ``learn.learning_rows``.

    All values of a column share its metadata, so that branch learns from each
    distinct row once, which weighs as many as there are of it.
    """
    known = rows.filter(F.col(label).isNotNull())
    meta = known.groupBy(label, META_VECTOR).agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    inputs = {META_VECTOR: stored(meta, "meta-rows"), VALUE_VECTOR: known.withColumn("_weight", F.lit(1.0))}
    return {
        branch: LogisticRegression(
            featuresCol=branch, labelCol=label, predictionCol=f"{branch}_class", probabilityCol=f"{branch}_says",
            rawPredictionCol=f"{branch}_raw", maxIter=max_iter, regParam=reg, standardization=False, weightCol="_weight",
        ).fit(inputs[branch])
        for branch in WIDE_SLOTS
    }


def both_branches(rows: DataFrame, branches: Branches) -> DataFrame:
    """Add ``_both``: the wide vector and what each branch says, in place of the encoded branches."""
    out, inputs = rows, []
    for branch, model in branches.items():
        slots = VectorSlicer(inputCol=branch, outputCol=f"{branch}_wide", indices=list(range(WIDE_SLOTS[branch])))
        out = slots.transform(model.transform(out))
        inputs += [f"{branch}_wide", f"{branch}_says"]
    joined = VectorAssembler(inputCols=inputs, outputCol="_both").transform(out)
    return joined.select(*[c for c in rows.columns if c not in branches], "_both")


# ---- batches and steps -------------------------------------------------------------------


def write_batches(rows: DataFrame, path: str, batches: int, seed: int = 0) -> None:
    """Training rows in one folder per mini-batch; a step reads one folder.

    The batch of a row is a hash of its content, so copies share a batch.
    """
    drawn = F.pmod(F.xxhash64(F.lit(seed), *KEY, "column_value"), F.lit(batches)).cast("int")
    rows.select("_both", "is_sensitive", "class_id", drawn.alias("batch")).write.partitionBy("batch").parquet(path)


def batch_of(step: int, batches: int, seed: int) -> int:
    """Every epoch takes each batch once, in an order of its own."""
    epoch, place = divmod(step, batches)
    order = sorted(range(batches), key=lambda b: hashlib.md5(f"{seed}|{epoch}|{b}".encode()).hexdigest())
    return order[place]


def predict(model: MultilayerPerceptronClassificationModel, rows: DataFrame) -> DataFrame:
    """Predicted class of every row, and the probability given to it."""
    return model.transform(rows).select(
        *[c for c in rows.columns if c != "_both"],
        F.col("_predicted").cast("int").alias("prediction"),
        vector_to_array("_probability").alias("probabilities"),
    )


class Settings(NamedTuple):
    """``hidden`` layers; ``steps`` at most; validation every so many steps; stop after ``patience`` without gain."""

    hidden: tuple[int, ...] = (32,)
    steps: int = 24
    batches: int = 4
    iterations: int = 12
    validate_every: int = 4
    patience: int = 3
    label: str = "class_id"
    classes: int = len(CLASSES)
    seed: int = 0


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per finished step: its batch, and the accuracy where it was validated."""
    log = f"{path}/log"
    return spark.read.schema(LOG).parquet(log) if path_exists(spark, log) else spark.createDataFrame([], LOG)


def step_model(path: str, step: int) -> MultilayerPerceptronClassificationModel:
    return MultilayerPerceptronClassificationModel.load(f"{path}/step={step}")


def best_step(scores: list[tuple[int, float]]) -> int:
    """The validated step of the highest accuracy, the latest of equal ones."""
    return max(scores, key=lambda s: (s[1], s[0]))[0]


def is_over(scores: list[tuple[int, float]], patience: int) -> bool:
    """Whether the last ``patience`` validations brought nothing."""
    if not scores:
        return False
    return sum(step > best_step(scores) for step, _ in scores) >= patience


def train_steps(
    spark: SparkSession, batches: str, valid: DataFrame, path: str, settings: Settings = Settings()
) -> MultilayerPerceptronClassificationModel:
    """Train on stored mini-batches and return the best validated state.

    After each step its weights are saved below ``path`` and then entered in the
    log. Called again with the same folders, it goes on after the last entry
    and does what one call would have done: batches, validations and the early
    stop depend on the number of the step alone. A step that was saved but not
    entered is done again.
    """
    rows = spark.read.parquet(batches)
    first = rows.select("_both").first()
    if first is None:
        raise ValueError("no training rows")
    size = first["_both"].size
    # one entry per step, and their number is set
    done = read_log(spark, path).orderBy("step").collect()
    scores = [(r.step, r.accuracy) for r in done if r.accuracy is not None]
    weights = step_model(path, done[-1].step).weights if done else None
    for step in range(len(done), settings.steps):
        if is_over(scores, settings.patience):
            break
        batch = batch_of(step, settings.batches, settings.seed)
        learner = MultilayerPerceptronClassifier(
            featuresCol="_both", labelCol=settings.label, predictionCol="_predicted", probabilityCol="_probability",
            rawPredictionCol="_raw", layers=[size, *settings.hidden, settings.classes],
            maxIter=settings.iterations, seed=settings.seed,
        )
        if weights is not None:
            learner = learner.setInitialWeights(weights)
        known = rows.filter((F.col("batch") == batch) & F.col(settings.label).isNotNull())
        model = learner.fit(known)
        weights = model.weights
        model.write().overwrite().save(f"{path}/step={step}")
        reached = None
        if (step + 1) % settings.validate_every == 0 or step + 1 == settings.steps:
            labelled = valid.filter(F.col(settings.label).isNotNull())
            reached = accuracy(predict(model, labelled), settings.label, "prediction").first().accuracy
            scores.append((step, reached))
        entry = spark.createDataFrame([(step, batch, reached)], LOG)
        entry.coalesce(1).write.mode("append").parquet(f"{path}/log")
    return step_model(path, best_step(scores))
