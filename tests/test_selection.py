import hashlib

import pytest
from pyspark.sql import functions as F

from fieldwarden.functions.vocab import KEY
from fieldwarden.operators import balance, sampling, selection
from fieldwarden.operators.selection import batch_ids, cut_rows, repeat_rows, row_positions, take_sample


def order(seed, *keys):
    return hashlib.md5("|".join([str(seed), *map(str, keys)]).encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """One stratum holds most rows; a null stratum and a tiny one are there too."""
    strata = ["hot"] * 4000 + ["cold"] * 37 + [None] * 11 + ["one"]
    rows = [(s, i) for i, s in enumerate(strata)]
    return spark.createDataFrame(rows, "s string, k int").repartition(5).cache()


def brute_cut(rows, seed, share):
    out = {}
    for stratum in {s for s, _ in rows}:
        keys = sorted((k for s, k in rows if s == stratum), key=lambda k: order(seed, k))
        for place, k in enumerate(keys):
            out[k] = place < share(len(keys))
    return out


@pytest.mark.parametrize("share", [0, 1, 7, 10_000])
def test_cut_equals_sorting(spark, skewed, share):
    rows = [tuple(r) for r in skewed.collect()]
    cut = cut_rows(skewed, ["s"], ["k"], [lambda n: F.lit(share)], 3).collect()
    assert {r.k: r._below_0 > 0 for r in cut} == brute_cut(rows, 3, lambda n: share)


def test_cut_without_broadcast(spark, skewed, monkeypatch):
    monkeypatch.setattr(selection, "MAX_BROADCAST_STRATA", 1)
    rows = [tuple(r) for r in skewed.collect()]
    cut = cut_rows(skewed, ["s"], ["k"], [lambda n: F.floor(n / 2)], 3).collect()
    assert {r.k: r._below_0 > 0 for r in cut} == brute_cut(rows, 3, lambda n: n // 2)


def test_cut_splits_copies(spark):
    """A third of the rows are copies of one; the sample still has the exact size."""
    rows = [("same",)] * 500 + [(f"r{i}",) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string")
    for size in [1, 400, 750, 1499, 1500, 2000]:
        sample = take_sample(df, size, ["k"], 5)
        counts = {r.k: r["count"] for r in sample.groupBy("k").count().collect()}
        assert sum(counts.values()) == min(size, 1500)
        assert counts.get("same", 0) <= 500 and all(n == 1 for k, n in counts.items() if k != "same")


def test_hash_order_crosses_prefixes(spark, monkeypatch):
    """With one hex digit as prefix every bucket holds many rows, so the inner rank decides."""
    monkeypatch.setattr(selection, "PREFIX", 1)
    df = spark.range(2000).withColumnRenamed("id", "k")
    expected = set(sorted(range(2000), key=lambda k: order(9, k))[:777])
    for distinct in [True, False]:
        assert {r.k for r in take_sample(df, 777, ["k"], 9, distinct).collect()} == expected


def test_repeat_rows(spark, monkeypatch):
    monkeypatch.setattr(selection, "CHUNK", 8)
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 8), ("d", 9), ("e", 40)], "k string, n int")
    got = repeat_rows(df, F.col("n")).groupBy("k").agg(F.sort_array(F.collect_list("_copy")).alias("c"))
    assert {r.k: r.c for r in got.collect()} == {k: list(range(n)) for k, n in [("b", 1), ("c", 8), ("d", 9), ("e", 40)]}


def test_positions_are_a_permutation(spark):
    df = spark.range(1234).withColumnRenamed("id", "k")
    got = {r.k: r._position for r in row_positions(df, ["k"], 1, distinct_rows=True).collect()}
    assert got == {k: i for i, k in enumerate(sorted(range(1234), key=lambda k: order(1, k)))}
    copies = spark.createDataFrame([("x",)] * 300 + [("y",)] * 5, "k string")
    places = sorted(r._position for r in row_positions(copies, ["k"], 1).collect())
    assert places == list(range(305))


def test_batches(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    batches = batch_ids(df, ["k"], 10, epochs=2).groupBy("epoch", "batch_id").count().collect()
    assert len(batches) == 20 and all(r["count"] == 10 for r in batches)
    short = batch_ids(df, ["k"], 30).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in short) == [10, 30, 30, 30]


def test_small_and_large_samples_agree(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("k"), F.lit("2018-07-01").alias("dt"))
    small = {r.k for r in sampling.sample_rows(df, 200, ["k"], 4).collect()}
    monkeypatch.setattr(sampling, "SMALL_SAMPLE", 10)
    assert {r.k for r in sampling.sample_rows(df, 200, ["k"], 4).collect()} == small


def test_day_filter_needs_a_dt_column(spark):
    df = spark.createDataFrame([(1, "2018-07-01"), (2, "2018-07-02")], "k int, dt string")
    assert sampling.on_day(df, "2018-07-01").count() == 1
    assert sampling.on_day(df.drop("dt"), "2018-07-01").count() == 2


def test_sample_values_of_a_hot_column(spark):
    rows = [("T", "HOT", f"v{i % 50}", i) for i in range(3000)] + [("T", "C", None, 1), ("T", "C", "x", 2)]
    df = spark.createDataFrame(rows, "stage_table_name string, stage_column_name string, column_value string, id int")
    got = sampling.sample_values(df, 100, 1, ["id"]).groupBy(*KEY).count().collect()
    assert {r.stage_column_name: r["count"] for r in got} == {"HOT": 100, "C": 1}
    distinct = sampling.sample_values(df, 100, 1, distinct=True)
    assert distinct.filter("stage_column_name = 'HOT'").count() == 50


def test_large_value_samples(spark, monkeypatch):
    rows = [("T", "HOT", f"v{i % 50}", i) for i in range(900)] + [("T", "C", f"x{i}", i) for i in range(30)]
    df = spark.createDataFrame(rows, "stage_table_name string, stage_column_name string, column_value string, id int")
    options = [{"row_keys": ["id"]}, {"distinct": True}, {}]
    small = [sampling.sample_values(df, 40, 1, **o).select(*KEY, "column_value") for o in options]
    small = [s.collect() for s in small]
    monkeypatch.setattr(sampling, "SMALL_SAMPLE", 5)
    for rows, o in zip(small, options, strict=True):
        large = sampling.sample_values(df, 40, 1, **o).select(*KEY, "column_value").collect()
        assert sorted(map(tuple, large)) == sorted(map(tuple, rows))


@pytest.mark.parametrize("size", [1000, 1001, 1500])
def test_samples_with_copies_are_exact(spark, size):
    rows = spark.range(5000).select((F.col("id") % 40).alias("k"), F.lit("T").alias("stage_table_name"))
    assert sampling.sample_rows(rows, size, ["k"], 3).count() == size
    values = rows.select("stage_table_name", F.lit("C").alias("stage_column_name"), F.col("k").cast("string").alias("column_value"), (F.col("k") % 7).alias("id"))
    assert sampling.sample_values(values, size, 3, ["id"]).count() == size
    assert sampling.sample_values(values, size, 3).count() == size


def test_both_sides_of_the_limit_draw_the_same_rows(spark, monkeypatch):
    rows = spark.range(600).select((F.col("id") % 50).alias("k"), (F.col("id") % 3).alias("x"))
    small = sorted(map(tuple, sampling.sample_rows(rows, 77, ["k"], 3).collect()))
    monkeypatch.setattr(sampling, "SMALL_SAMPLE", 10)
    assert sorted(map(tuple, sampling.sample_rows(rows, 77, ["k"], 3).collect())) == small


def test_odd_column_names(spark):
    df = spark.createDataFrame([("1", "2", "3")], ["_id", "d:cust", "a`b.c"])
    rows = sampling.long_rows(df, "T", {"_id": None, "d:cust": "姓名", "a`b.c": None}).collect()
    assert {(r.stage_column_name, r.column_value, r.column_sensitive_type) for r in rows} == {
        ("_id", "1", "0"),
        ("d:cust", "2", "姓名"),
        ("a`b.c", "3", "0"),
    }


def meta(spark, counts):
    rows = [
        ("T", f"{kind}{i}", "0" if kind == "none" else "1", None if kind == "none" else kind)
        for kind, n in counts.items()
        for i in range(n)
    ]
    schema = "stage_table_name string, stage_column_name string, column_is_sensitive string, column_sensitive_type string"
    return spark.createDataFrame(rows, schema)


def test_splits_are_disjoint_and_complete(spark):
    columns = meta(spark, {"none": 1000, "姓名": 45, "邮箱": 5, "地址": 1})
    split = balance.split_stratified(columns, KEY)
    assert split.count() == columns.count() == split.select(*KEY).distinct().count()
    counts = {(r.split, r.column_sensitive_type): r.n for r in balance.split_class_counts(split).collect()}
    assert counts[("train", None)] == 560 and counts[("valid", None)] == 140 and counts[("test", None)] == 300
    # 0.7 * 45 is just below 31.5 in binary; 0.7 * 5 = 3.5 goes to the even neighbour
    assert counts[("test", "姓名")] == 14 and counts[("test", "邮箱")] == 1
    again = balance.split_stratified(columns.repartition(7), KEY)
    assert split.exceptAll(again).count() == 0


def test_random_split_size(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    split = balance.split_random(df, 0.3, ["k"])
    assert split.filter("split = 'test'").count() == 31 and split.count() == 101
    copies = spark.createDataFrame([("x",)] * 101, "k string")
    split = balance.split_random(copies, 0.3, ["k"])
    assert split.filter("split = 'test'").count() == 31 and split.count() == 101


def test_clean_labels(spark):
    rows = [("1", "姓名"), ("1", None), ("1", "京东pin"), ("1", "0"), ("0", None), ("0", "姓名"), (None, None)]
    df = spark.createDataFrame(rows, "column_is_sensitive string, column_sensitive_type string")
    assert {tuple(r) for r in balance.clean_labels(df).collect()} == {("1", "姓名"), ("0", None)}


def test_oversampling(spark, monkeypatch):
    columns = meta(spark, {"none": 100, "姓名": 30})
    ratio = balance.imbalance_ratio(columns)
    assert ratio == 4
    rows = balance.oversample(columns)
    assert rows.filter("column_is_sensitive = '1'").count() == 120 and rows.count() == 220
    monkeypatch.setattr(balance, "CHUNK", 2)
    assert balance.oversample(columns).exceptAll(rows).count() == 0
    assert balance.imbalance_ratio(meta(spark, {"none": 3})) == 1


def test_oversampling_spares_the_other_splits(spark):
    split = balance.split_stratified(meta(spark, {"none": 100, "姓名": 20}), KEY)
    out = balance.oversample_splits(split)
    assert out.filter("split <> 'train'").count() == split.filter("split <> 'train'").count()
    assert out.filter("split = 'train'").count() > split.filter("split = 'train'").count()
