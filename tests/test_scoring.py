import json

import pytest
from pyspark.sql import functions as F

from fieldwarden.functions.vocab import KEY, REQUEST_FIELDS
from fieldwarden.operators.features import labels
from fieldwarden.operators.balance import split_stratified
from fieldwarden.operators.voting import FLAGS
from fieldwarden.plans import learn
from fieldwarden.plans.score import by_model, by_rules, score_columns, score_requests, to_json
from fieldwarden.sources.requests import read_requests, validate_requests
from fieldwarden.sources.store import latest_version, load_model
from fieldwarden.streaming.score_stream import read_scores, stream_scores
from workload.registry import Tables

BODY = {f: "" for f in REQUEST_FIELDS} | {"column_name": "x", "column_value": ["13912345678", "13912345678", "y"]}


def changed(**fields):
    body = {**BODY, **fields}
    return {k: v for k, v in body.items() if v != "(absent)"}


CASES = [
    (json.dumps(BODY), 200, ""),
    (json.dumps(changed(extra={"a": 1})), 200, ""),
    (json.dumps(changed(column_value=[])), 200, ""),
    (json.dumps(changed(table_theme="(absent)", column_type="(absent)")), 301, "'table_theme' is a required property"),
    (json.dumps(changed(column_value="(absent)")), 301, "'column_value' is a required property"),
    (json.dumps(changed(database_port=3306, table_theme="(absent)")), 301, "3306 is not of type 'string'"),
    (json.dumps(changed(column_name=None)), 301, "None is not of type 'string'"),
    (json.dumps(changed(column_name=True)), 301, "True is not of type 'string'"),
    (json.dumps(changed(column_value="a")), 301, "'a' is not of type 'array'"),
    (json.dumps(changed(column_value=["a", 5])), 301, "5 is not of type 'string'"),
    (json.dumps(changed(column_value=["a", None])), 301, "None is not of type 'string'"),
    (json.dumps(changed(column_value=[None])), 301, "None is not of type 'string'"),
    ("[1,2]", 301, "[1,2] is not of type 'object'"),
    ("{", 301, "malformed JSON"),
    (None, 301, "malformed JSON"),
]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([(str(i), c[0]) for i, c in enumerate(CASES)], "request_id string, body string")


def test_validation(requests):
    got = {r.request_id: (r.status, r.error_msg) for r in validate_requests(requests).collect()}
    assert got == {str(i): (status, message) for i, (_, status, message) in enumerate(CASES)}


def test_scores(requests):
    rows = {r.request_id: r for r in score_requests(requests, by_rules(), "request_id").collect()}
    assert len(rows) == len(CASES)
    first = rows["0"]
    assert (first.label, first.raw_label, first.predictions) == (4, "手机", [4, 4, 7])
    assert first.probability == pytest.approx(2 / 3)
    # an empty list is scored as one empty value
    assert (rows["2"].predictions, rows["2"].probability) == ([7], 1.0)
    assert rows["3"].label is None and rows["3"].predictions is None
    texts = [json.loads(r.value) for r in to_json(score_requests(requests, by_rules(), "request_id")).collect()]
    assert sorted(t["status"] for t in texts) == [200] * 3 + [301] * 12
    assert all("label" not in t for t in texts if t["status"] == 301)


def test_copies_of_a_request_are_scored_apart(spark):
    copies = spark.createDataFrame([("same", json.dumps(BODY))] * 40, "request_id string, body string")
    rows = score_requests(copies, by_rules(), "request_id").collect()
    assert len(rows) == 40 and all(r.predictions == [4, 4, 7] for r in rows)


def test_request_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(BODY) + "\n{\n")
    checked = validate_requests(read_requests(spark, str(tmp_path)))
    assert sorted(r.status for r in checked.collect()) == [200, 301]


def test_stream_equals_batch_and_resumes(spark, requests, tmp_path):
    source, target, state = (str(tmp_path / d) for d in ["in", "out", "state"])
    key = ["request_id"]

    def run():
        stream_scores(spark, source, target, state, by_rules(), files_per_batch=1).awaitTermination()
        return read_scores(spark, target).drop("batch")

    requests.repartition(3).write.json(source)
    batch = score_requests(requests, by_rules(), *key)
    assert run().exceptAll(batch).count() == 0 and run().count() == len(CASES)
    requests.limit(2).withColumn("request_id", F.concat(F.lit("n"), "request_id")).write.mode("append").json(source)
    assert run().count() == len(CASES) + 2


@pytest.fixture(scope="module")
def generated(spark, sf_dir):
    t = Tables(spark, sf_dir)
    split = split_stratified(t.f_class_meta, KEY).cache()
    parts = {n: split.filter(F.col("split") == n).drop("split") for n in ["train", "valid", "test"]}
    rows = {n: learn.learning_rows(t.f_class_values, m).cache() for n, m in parts.items()}
    return t, parts, rows


def test_best_model_is_kept_and_beats_the_majority(spark, generated, tmp_path):
    t, parts, rows = generated
    path = str(tmp_path / "model")
    settings = [{"max_iter": 1}, {"max_iter": 12}]
    model, score = learn.train_best(rows["train"], rows["valid"], settings, path)
    assert score > 0.8 and latest_version(spark, path) == 2
    report = {r["class"]: r for r in learn.evaluate(load_model(spark, path), rows["test"]).collect()}
    assert report["AVG / TOTAL"].f1 > 0.8
    votes = score_columns(
        t.f_class_values, labels(parts["test"]), by_model(model), position="row_id", carry=["class_id"]
    )
    share = votes.agg(F.avg((F.col("label") == F.col("class_id")).cast("int"))).first()[0]
    assert share > 0.9
    served = score_requests(spark.createDataFrame([("a", json.dumps(BODY))], "id string, body string"), by_model(model), "id")
    assert served.first().status == 200 and len(served.first().predictions) == 3


def test_binary_and_weighted_training(generated):
    _, _, rows = generated
    binary = learn.train(rows["train"], label="is_sensitive", max_iter=5)
    predicted = learn.predict(binary, rows["test"])
    assert {r.prediction for r in predicted.select("prediction").distinct().collect()} <= {0, 1}
    balanced = learn.train(rows["train"], balanced=True, max_iter=3)
    assert learn.predict(balanced, rows["test"]).count() == rows["test"].count()


def test_votes_of_a_binary_model_have_its_names(spark, generated):
    t, parts, rows = generated
    predictor = by_model(learn.train(rows["train"], label="is_sensitive", max_iter=5), binary=True)
    votes = score_columns(t.f_class_values, labels(parts["test"]), predictor, position="row_id")
    assert {(r.label, r.raw_label) for r in votes.collect()} <= {(0, "insensitive"), (1, "sensitive")}
    served = score_requests(spark.createDataFrame([("a", json.dumps(BODY))], "id string, body string"), predictor, "id")
    assert served.first().raw_label in FLAGS


def test_long_texts_are_hashed_whole(spark):
    start = "a" * 60
    rows = spark.createDataFrame([(f"{start}{end}",) for end in ("xyz", "zyx")], "column_value string")
    first, second = (r[learn.VALUE_VECTOR] for r in learn.encode_values(rows).collect())
    assert first != second


def test_encoding_runs_no_job(spark, sf_dir):
    """The sizes of all parts are known: the join does not run once more for one row."""
    t = Tables(spark, sf_dir)
    values, meta = t.f_class_values, t.f_class_meta
    spark.sparkContext.setJobGroup("encode", "encode")
    try:
        rows = learn.learning_rows(values, meta)
        learn.classifier().getStages()[0].transform(rows)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("encode")
    assert rows.first()[learn.META_VECTOR].size == 78 + (1 << learn.META_HASH_BITS)
