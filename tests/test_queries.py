"""Every registered query against its oracle, and the shape of the plans."""

import re

import pytest

import __spark_entry__ as contract
from workload.compare import connect, difference

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    assert difference(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["row_id", "wide"]


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


# the fast ones: their plans are built without running a job that counts
PLANNED = [n for n in sorted(ORACLES) if n not in {"score_stream", "feature_store", "deep_features", "text_sequence", "char_dictionary"}]


def test_no_query_multiplies_rows_by_rows(spark, sf_dir):
    for name in PLANNED:
        text = plan(spark, sf_dir, name)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_samples_stay_on_the_map_side(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(spark, sf_dir, "sample_rows")
    assert plan(spark, sf_dir, "sample_values").count("WindowGroupLimit") == 2


def test_aggregates_are_partial_before_the_shuffle(spark, sf_dir):
    for name in ["char_counts", "column_vote", "classification_report", "length_histogram"]:
        assert "partial_" in plan(spark, sf_dir, name), name


def test_scans_read_only_what_they_need(spark, sf_dir):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, sf_dir, "column_vote"))
    assert schemas and all(set(s.split(",")) == {"o_orderkey:bigint", "o_custkey:bigint"} for s in schemas)


def test_profiles_read_their_input_once(spark, sf_dir):
    for name in ["category_share", "sensitivity_by_category"]:
        assert len(re.findall(r"FileScan parquet", plan(spark, sf_dir, name))) == 1, name


def test_metadata_is_encoded_below_the_join(spark, sf_dir):
    text = QUERIES["wide_features"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above = text[: text.index("Join ")]
    assert "database_type" not in above and "column_value" in above


def test_rules_score_requests_inside_the_row(spark, sf_dir):
    optimized = QUERIES["score_requests"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in optimized and "Generate" not in optimized
