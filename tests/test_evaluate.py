import pytest
from pyspark.sql import functions as F

from fieldwarden.functions.vocab import CLASSES
from fieldwarden.operators import evaluate, voting

# published test result: rows actual, columns predicted
MATRIX = [
    [1644, 0, 0, 0, 0, 0, 0, 365],
    [0, 174, 0, 0, 0, 0, 0, 0],
    [1, 0, 334, 0, 0, 0, 0, 198],
    [1, 0, 0, 6176, 100, 0, 1, 365],
    [0, 24, 0, 100, 6085, 3, 0, 200],
    [93, 0, 100, 0, 100, 4745, 0, 109],
    [0, 0, 6, 49, 21, 8, 246, 0],
    [854, 0, 2, 101, 0, 100, 273, 20184],
]
# F1, precision, recall, support
REPORT = {
    "卡号": (0.71447, 0.63401, 0.81832, 2009),
    "固定电话": (0.93548, 0.87879, 1, 174),
    "地址": (0.68513, 0.75566, 0.62664, 533),
    "姓名": (0.94514, 0.9611, 0.9297, 6643),
    "手机": (0.95691, 0.96495, 0.949, 6412),
    "身份证": (0.94872, 0.97714, 0.9219, 5147),
    "邮箱": (0.57882, 0.47308, 0.74545, 330),
    "非敏感": (0.94021, 0.94225, 0.93818, 21514),
}


@pytest.fixture(scope="module")
def published(spark):
    cells = [(a, p, n) for a, row in enumerate(MATRIX) for p, n in enumerate(row) if n]
    df = spark.createDataFrame(cells, "actual int, predicted int, n int")
    return df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).cache()


def test_published_report(published):
    report = {r["class"]: r for r in evaluate.classification_report(published).collect()}
    for name, (f1, precision, recall, support) in REPORT.items():
        row = report[name]
        assert (row.f1, row.precision, row.recall) == pytest.approx((f1, precision, recall), abs=1e-5)
        assert row.support == support
    total = report["AVG / TOTAL"]
    assert (total.precision, total.recall, total.f1) == pytest.approx((0.823, 0.866, 0.838), abs=5e-4)
    assert total.support == 42762


def test_published_matrix_and_accuracy(published):
    rows = {r.class_id: [r[c] for c in CLASSES] for r in evaluate.confusion_matrix(published).collect()}
    assert [rows[i] for i in range(8)] == MATRIX
    assert evaluate.accuracy(published).first().accuracy == pytest.approx(39588 / 42762)


def test_absent_classes_are_reported(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "actual int, predicted int")
    report = evaluate.classification_report(df).collect()
    assert len(report) == 9
    assert {r["class"]: r.f1 for r in report}["邮箱"] == 0.0
    assert len(evaluate.confusion_matrix(df).collect()) == 8


def test_batch_accuracy_weighs_the_short_batch(spark):
    df = spark.createDataFrame([(i, 0, 0 if i < 4 else 1) for i in range(5)], "pos int, actual int, predicted int")
    assert evaluate.batch_accuracy(df, "pos", 4).first().accuracy == 0.5
    assert evaluate.accuracy(df).first().accuracy == 0.8


def test_vote_ties_go_to_the_first(spark):
    rows = [("a", 0, 5), ("a", 1, 3), ("a", 2, 3), ("a", 3, 5), ("b", 0, 7)]
    df = spark.createDataFrame(rows, "g string, position int, prediction int")
    votes = {r.g: (r.label, r.raw_label, r.probability, r.n_values) for r in voting.vote(df, ["g"]).collect()}
    assert votes == {"a": (5, "身份证", 0.5, 4), "b": (7, "非敏感", 1.0, 1)}
    listed = voting.gather_predictions(df, ["g"])
    both = listed.select("g", "predictions", voting.vote_in_row(F.col("predictions")).alias("v"))
    got = {r.g: (r.predictions, r.v.label, r.v.probability) for r in both.collect()}
    assert got == {"a": ([5, 3, 3, 5], 5, 0.5), "b": ([7], 7, 1.0)}


def test_threshold(spark):
    votes = spark.createDataFrame([(5, 0.4), (7, 1.0), (3, 0.6)], "label int, probability double")
    assert voting.flag_sensitive(votes, 0.5, insensitive=7).collect()[0].label == 3
    assert voting.flag_sensitive(votes, 0.3).count() == 3


def test_losses(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.25)], "y int, p double")
    from math import log

    assert evaluate.log_loss(df, "p").first().loss == pytest.approx(-(log(0.5) + log(0.25)) / 2)
    weighted = evaluate.binary_log_loss(df, "y", "p", 4.0).first().loss
    assert weighted == pytest.approx(-(4 * log(0.5) + log(0.75)) / 2)


def test_binary_votes_have_their_own_names(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 0, 2)], "g string, prediction int, position int")
    got = {r.g: r.raw_label for r in voting.vote(df, ["g"], names=voting.FLAGS).collect()}
    assert got == {"a": "sensitive", "b": "insensitive"}
