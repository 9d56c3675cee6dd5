import pytest
from pyspark.sql import functions as F

from fieldwarden.functions.encoders import binary_weights, class_weights, percent_label
from fieldwarden import session
from fieldwarden.functions.vocab import DEEP_SIZE, KEY, META_FIELDS, WIDE_LAYOUT, WIDE_SIZE
from fieldwarden.operators import joining
from fieldwarden.operators.features import (
    add_features,
    dataset_features,
    labels,
    split_rejects,
    wide_features,
    wide_size,
)
from fieldwarden.sources.store import read_features, write_features

# ---- Fixed values: published rows and the vectors they must give ----------------

WIDE_ROW = {
    "column_value": "",
    "database_port": "3306",
    "database_name": "recpayable_",
    "database_comment": "",
    "database_type": "mysql",
    "database_is_shard": "1",
    "table_name": "acctdetail_0030_",
    "table_comment": "十二个字的表的注释文字呀",
    "table_theme": "其他",
    "column_name": "recpay_date",
    "column_comment": "应收应付时间",
    "column_type": "datetime",
    "column_is_primary_key": "0",
    "column_allow_null": "1",
}
WIDE_VECTOR = [
    0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.44, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0,
    0, 0, 0, 1, 0, 0.266666667, 0.48, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0.366666667, 0.2, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0,
]

DEEP_ROW = {
    "column_value": "2018-07-01 10:20:02",
    "database_name": "recpayable",
    "database_comment": "",
    "table_name": "btlmk_acctdetail",
    "table_comment": "白条联名卡",
    "column_name": "update_date",
    "column_comment": "更新时间",
}
# ids of the model's own dictionary, as far as the row needs them
CHARACTERS = {
    "0": 3, " ": 4, "1": 5, "2": 6, "L": 7, "E": 8, "8": 9, "7": 12, "A": 13, "T": 19, "U": 20, "D": 21, "C": 22,
    "I": 24, "R": 25, "M": 27, "B": 28, "P": 31, "Y": 32, "K": 36, "时": 81, "条": 90, "间": 92, "白": 95,
    "新": 101, "名": 104, "卡": 130, "联": 186, "更": 245,
}
DEEP_VECTOR = [
    25, 8, 22, 31, 13, 32, 13, 28, 7, 8, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0,
    0, 0, 0, 0, 0, 28, 19, 7, 27, 36, 4, 13, 22, 22, 19, 21, 8, 19, 13, 24, 7, 2, 0, 0, 0, 0, 0, 0,
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 0, 0, 0, 0, 95, 90, 186, 104, 130, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 20, 31, 21, 13, 19, 8, 4, 21, 13, 19, 8, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 0, 245, 101, 81, 92, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 0, 6, 3, 5, 9, 4, 3, 12, 4, 3, 5, 4, 5, 3, 4, 6, 3, 4, 3, 6, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
]


def one_row(spark, row):
    schema = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema)


def test_sizes():
    assert (WIDE_SIZE, DEEP_SIZE, len(META_FIELDS)) == (79, 230, 18)


def test_golden_wide_vector(spark):
    df = add_features(one_row(spark, WIDE_ROW), None)
    wide = df.first().wide
    assert wide == pytest.approx(WIDE_VECTOR, abs=1e-6)


def test_golden_deep_vector(spark):
    deep = add_features(one_row(spark, DEEP_ROW), CHARACTERS).first().deep
    assert deep == DEEP_VECTOR


def test_column_type_source(spark):
    row = {**WIDE_ROW, "column_type": "decimal(10,2)"}
    df = one_row(spark, row)
    by_default = df.select(wide_features(df.columns).alias("w")).first().w
    corrected = df.select(wide_features(df.columns, column_type_from="column_type").alias("w")).first().w
    assert by_default[61] == 1.0 and corrected[61] == 0.0
    assert sum(corrected[59:72]) == 1.0 and corrected != by_default


def test_absent_and_null_fields(spark):
    df = one_row(spark, {"column_value": None, "database_port": None})
    wide = df.select(wide_features(df.columns).alias("w")).first().w
    blocks = [(0, 17), (19, 33), (33, 36), (38, 57), (59, 72), (72, 75), (75, 78)]
    assert [sum(wide[a:b]) for a, b in blocks] == [1.0] * 7
    assert sum(wide) == 7.0 and wide[16] == 1.0


def test_length_ratio_is_capped(spark):
    df = one_row(spark, {"column_value": "　" + "x" * 80})
    assert df.select(wide_features(df.columns).alias("w")).first().w[78] == 1.0


def test_labels(spark):
    rows = [("1", "身份证"), ("0", ""), ("others", "非敏感"), ("", "balabala"), (" 1 ", " 邮箱 ")]
    df = spark.createDataFrame(rows, "column_is_sensitive string, column_sensitive_type string")
    got = [(r.is_sensitive, r.class_id) for r in labels(df).collect()]
    assert got == [(1, 5), (0, 7), (0, None), (0, None), (1, 6)]
    assert [r.class_id for r in labels(df, legacy=True).collect()] == [8, 10, 0, 0, 9]


def test_rejects(spark):
    df = spark.createDataFrame([("1", "身份证"), ("1", "京东pin")], "column_is_sensitive string, column_sensitive_type string")
    known, rejected = split_rejects(labels(df))
    assert (known.count(), rejected.first().column_sensitive_type) == (1, "京东pin")
    strict, _ = split_rejects(labels(df), on_unknown="error")
    with pytest.raises(Exception, match="unknown type"):
        strict.collect()


def test_class_weights():
    weights = class_weights(8)
    assert weights[0] == pytest.approx(40 / 281) and weights[-1] == pytest.approx(1 / 281)
    assert class_weights(2, given=[3.0, 1.0]) == [3.0, 1.0]
    assert binary_weights(3.0) == [0.25, 0.75]


def test_percent_label(spark):
    rows = [(1, 3), (2, 3), (1, 800), (1, 8), (1005, 8000), (1, 1), (1, 100), (101, 10000)]
    df = spark.createDataFrame(rows, "n long, total long")
    got = [r.p for r in df.select(percent_label(F.col("n"), F.col("total")).alias("p")).collect()]
    assert got == ["33.33%", "66.67%", "", "12.50%", "12.56%", "100.00%", "", "1.01%"]


# ---- many columns and values ------------------------------------------------------


def few_columns(spark, n=40):
    meta = spark.range(n).select(
        F.lit("T").alias("stage_table_name"),
        F.concat(F.lit("C"), F.col("id").cast("string")).alias("stage_column_name"),
        *[F.lit(v).alias(k) for k, v in WIDE_ROW.items() if k != "column_value"],
        F.lit("1").alias("column_is_sensitive"),
        F.lit("邮箱").alias("column_sensitive_type"),
    )
    return meta, meta.select(*KEY, F.lit("a@b.c").alias("column_value"))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_much_encoded_metadata_is_shuffled(spark, monkeypatch):
    meta, values = few_columns(spark)
    small = dataset_features(values, meta, CHARACTERS)
    assert "SortMergeJoin" not in executed(small)
    monkeypatch.setattr(joining, "LARGE_META", 0)
    monkeypatch.setattr(session, "BYTES_PER_TASK", 100)
    monkeypatch.setattr(session, "MOST_BYTES_PER_TASK", 1000)
    large = dataset_features(values, meta, CHARACTERS)
    assert "BroadcastHashJoin" not in executed(large) and "RoundRobin" in executed(large)
    assert sorted(large.collect()) == sorted(small.collect())


def test_number_of_heavy_tasks_grows_with_the_input(spark, monkeypatch):
    rows = spark.range(1000)
    assert session.spread_heavy(rows) is rows
    monkeypatch.setattr(session, "BYTES_PER_TASK", 100)
    monkeypatch.setattr(session, "MOST_BYTES_PER_TASK", 200)
    assert [session.spread_heavy(spark.range(n)).rdd.getNumPartitions() for n in (1000, 2000)] == [40, 80]


def test_splits_are_written_without_a_sort(spark, tmp_path):
    """A task that sorts wide rows by their folder holds all of them in memory."""
    meta, values = few_columns(spark)
    meta = meta.withColumn("split", F.when(F.col("stage_column_name") < "C2", "train").otherwise("test"))
    rows = dataset_features(values, meta, CHARACTERS, carry=["split"])
    path = str(tmp_path / "features")
    write_features(rows, path)
    assert sorted(r["count"] for r in read_features(spark, path).groupBy("split").count().collect()) == [12, 28]
    rows.createOrReplaceTempView("split_rows")
    spark.sql(f"CREATE TABLE split_features USING parquet LOCATION '{path}'")
    insert = f"INSERT INTO split_features SELECT {', '.join(spark.table('split_features').columns)} FROM split_rows"
    text = spark.sql(f"EXPLAIN {insert}").first()[0]
    spark.sql("DROP TABLE split_features")
    assert "WriteFiles" in text and "Sort " not in text
