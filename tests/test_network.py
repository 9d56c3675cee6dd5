"""A network trained in steps: stopped and resumed, early stop, thresholds."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fieldwarden.functions.vocab import KEY
from fieldwarden.operators import evaluate
from fieldwarden.operators.balance import split_stratified
from fieldwarden.operators.features import labels
from fieldwarden.operators.voting import FLAGS
from fieldwarden.plans import learn, network
from fieldwarden.plans.score import by_network, score_columns
from workload.registry import Tables

SETTINGS = network.Settings(hidden=(6,), steps=6, batches=2, iterations=4, validate_every=2, classes=2)


@pytest.fixture(scope="module")
def ring(spark):
    """Points inside a ring against those outside: no linear model tells them apart."""
    i = F.col("id")
    x, y = F.sin(i * 12.9) * 2, F.cos(i * 7.1) * 2
    label = (x * x + y * y < 2).cast("int")
    rows = spark.range(400).select(
        *[F.concat(F.lit(k), i.cast("string")).alias(k) for k in KEY],
        i.cast("string").alias("column_value"),
        array_to_vector(F.array(x, y)).alias("_both"),
        label.alias("class_id"),
        label.alias("is_sensitive"),
    )
    return rows.coalesce(1).cache()


@pytest.fixture
def batches(ring, tmp_path):
    path = str(tmp_path / "batches")
    network.write_batches(ring, path, SETTINGS.batches)
    return path


def test_a_stopped_run_equals_one_in_one_go(spark, ring, batches, tmp_path):
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    once = network.train_steps(spark, batches, ring, whole, SETTINGS)
    for steps in (1, 3, 4):
        # a step that was saved but not entered: its folder is written again
        network.train_steps(spark, batches, ring, parts, SETTINGS._replace(steps=steps, validate_every=2))
        spark.read.parquet(f"{whole}/log").limit(1).write.parquet(f"{parts}/step={steps}")
    again = network.train_steps(spark, batches, ring, parts, SETTINGS)
    assert again.weights == once.weights

    def log(path):
        return [(r.step, r.batch) for r in network.read_log(spark, path).orderBy("step").collect()]

    assert log(whole) == log(parts)
    assert {b for _, b in log(whole)} == {0, 1}
    # finished: nothing more is done
    assert network.train_steps(spark, batches, ring, whole, SETTINGS).weights == once.weights
    assert log(whole) == log(parts)


def test_learns_what_no_linear_model_can(spark, ring, batches, tmp_path):
    settings = SETTINGS._replace(steps=16, iterations=20)
    model = network.train_steps(spark, batches, ring, str(tmp_path / "n"), settings)
    assert evaluate.accuracy(network.predict(model, ring), "class_id", "prediction").first().accuracy > 0.9


def test_early_stop(spark, ring, batches, tmp_path, monkeypatch):
    reached = iter([0.5, 0.7, 0.7, 0.6, 0.6, 0.9])
    monkeypatch.setattr(
        network, "accuracy", lambda *_: spark.createDataFrame([(next(reached),)], "accuracy double")
    )
    path = str(tmp_path / "n")
    settings = SETTINGS._replace(steps=12, validate_every=1, patience=2, iterations=1)
    model = network.train_steps(spark, batches, ring, path, settings)
    # the latest of the best counts, then two validations without gain end it
    assert [r.accuracy for r in network.read_log(spark, path).orderBy("step").collect()] == [0.5, 0.7, 0.7, 0.6, 0.6]
    assert model.weights == network.step_model(path, 2).weights
    assert network.train_steps(spark, batches, ring, path, settings).weights == model.weights


def test_no_training_rows(spark, ring, tmp_path):
    path = str(tmp_path / "none")
    ring.limit(0).withColumn("batch", F.lit(0)).write.parquet(path)
    with pytest.raises(ValueError, match="no training rows"):
        network.train_steps(spark, path, ring, str(tmp_path / "n"), SETTINGS)


def test_threshold_curve(spark):
    rows = [(1, 0.91), (0, 0.9), (1, 0.9), (1, 0.4), (0, 0.0), (0, 1.0), (0, None)]
    curve = evaluate.threshold_curve(spark.createDataFrame(rows, "y int, p double"), "y", "p", bins=10)
    got = {r.threshold: (r.n_accepted, r.n_right, r.coverage) for r in curve.collect()}
    assert got == {
        t: (sum(p >= t for _, p in rows[:-1]), sum(p >= t and y for y, p in rows[:-1]), sum(p >= t for _, p in rows[:-1]) / 6)
        for t in (1.0, 0.9, 0.4, 0.0)
    }
    assert evaluate.choose_threshold(curve, 0.5) == 0.0
    assert evaluate.choose_threshold(curve, 0.6) == 0.4
    assert evaluate.choose_threshold(curve, 0.99) is None
    assert evaluate.threshold_curve(curve.limit(0).select(F.lit(1).alias("y"), F.lit(0.5).alias("p")), "y", "p").collect() == []


def test_binary_scoring_end_to_end(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    split = split_stratified(t.f_class_meta, KEY).cache()
    parts = {n: split.filter(F.col("split") == n).drop("split") for n in ("train", "valid", "test")}
    encoded = {n: learn.learning_rows(t.f_class_values, m).cache() for n, m in parts.items()}
    branches = network.learn_branches(encoded["train"], "is_sensitive", max_iter=8)
    rows = {n: network.both_branches(encoded[n], branches) for n in ("train", "valid")}
    network.write_batches(rows["train"], str(tmp_path / "b"), 1)
    settings = network.Settings(
        hidden=(8,), steps=2, batches=1, iterations=15, validate_every=1, label="is_sensitive", classes=2
    )
    model = network.train_steps(spark, str(tmp_path / "b"), rows["valid"], str(tmp_path / "n"), settings)
    scored = network.predict(model, rows["valid"]).withColumn("p", F.col("probabilities")[1])
    curve = evaluate.threshold_curve(scored, "is_sensitive", "p")
    threshold = evaluate.choose_threshold(curve, 0.9)
    votes = score_columns(
        t.f_class_values, labels(parts["test"]), by_network(branches, model, threshold), position="row_id", carry=["is_sensitive"]
    ).collect()
    assert {r.raw_label for r in votes} <= set(FLAGS)
    assert sum(r.label == r.is_sensitive for r in votes) > 0.8 * len(votes)


def test_metadata_branch_learns_from_each_row_once(spark):
    """Values of a column share its metadata: equal rows are one that weighs more, and the model stays the same."""
    rows = spark.range(300).select(
        *[F.lit(k).alias(k) for k in KEY],
        F.when(F.col("id") != 7, F.col("id") % 3).cast("int").alias("class_id"),
        array_to_vector(F.array((F.col("id") % 5).cast("double"), (F.col("id") % 7).cast("double"))).alias(learn.META_VECTOR),
        array_to_vector(F.array(F.sin("id"), F.cos("id"))).alias(learn.VALUE_VECTOR),
    )
    branches = network.learn_branches(rows, max_iter=10)
    assert branches[learn.META_VECTOR].summary.predictions.count() == 105
    for branch, model in branches.items():
        plain = LogisticRegression(
            featuresCol=branch, labelCol="class_id", maxIter=10, regParam=1e-4, standardization=False
        ).fit(rows.filter("class_id IS NOT NULL"))
        assert abs(model.coefficientMatrix.toArray() - plain.coefficientMatrix.toArray()).max() < 1e-6
