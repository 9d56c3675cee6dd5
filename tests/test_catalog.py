import hmac

import pytest
from pyspark.sql import functions as F

from fieldwarden.functions.crypto import KEY_SETTING, decrypt, encrypt, protect
from fieldwarden.functions.vocab import KEY
from fieldwarden.operators import catalog
from fieldwarden.operators.dictionary import char_dictionary, char_ids, count_tokens, word_dictionary
from fieldwarden.operators.joining import value_with_meta
from fieldwarden.operators.sampling import decryptable_rows
from fieldwarden.plans.training_data import iter_registry, training_rows, write_all


def test_excluded_tables(spark):
    kept = ["orders", "bakery", "a_bak", "orders_2018070", "test_x", "mytemp_", "_bk"]
    dropped = ["a_bak_x", "a_BAK7", "x_bak", "a_bk", "a_bk2", "a_20180701_x", "temp_a", "TMP_a", "s__a", "a_test"]
    kept.remove("a_bak")
    rows = [(n, "stage", "1") for n in [*kept, *dropped, None]] + [("other", "ods", "1"), ("off", "stage", "0")]
    df = spark.createDataFrame(rows, "table_name string, database_name string, table_status string")
    assert [r.table_name for r in catalog.stage_tables(df).collect()] == sorted(kept)


def test_registry(spark):
    tables = spark.createDataFrame([("a",), ("A",), ("b",)], "table_name string")
    dated = spark.createDataFrame([("a",), ("zzz",)], "table_name string")
    registry = catalog.table_registry(tables, dated)
    assert {tuple(r) for r in registry.collect()} == {("A", True), ("B", False)}
    columns = spark.createDataFrame(
        [("a", "x", "1", "姓名"), ("a", "y", "0", "z"), ("a", "w", "2", ""), ("c", "x", "1", "姓名")],
        "table_name string, column_name string, column_is_sensitive string, column_sensitive_type string",
    )
    known = catalog.column_registry(registry, columns)
    assert {tuple(r) for r in known.collect()} == {("A", "X", "1", "姓名"), ("A", "Y", "0", None)}
    totals = {r.table_name: (r.n_insensitive, r.n_sensitive) for r in catalog.registry_totals(registry, known).collect()}
    assert totals == {"A": (1, 1), "B": (0, 0)}


def test_join_normalises_keys_and_matches_nulls(spark):
    values = spark.createDataFrame([(" t ", "c　", "v"), (None, "c", "w"), ("t", "none", "x")], [*KEY, "column_value"])
    meta = spark.createDataFrame([("T", "C", "a"), ("T", "C", "b"), (None, "c", None)], [*KEY, "column_comment"])
    got = {tuple(r) for r in value_with_meta(values, meta).collect()}
    assert got == {("T", "C", "v", "a"), ("T", "C", "v", "b"), ("", "C", "w", "")}


def test_shard_alias(spark):
    values = spark.createDataFrame([("T", "C", "v")], [*KEY, "column_value"])
    meta = spark.createDataFrame([("T", "C", "1")], [*KEY, "database_is_shard_table"])
    assert value_with_meta(values, meta).first().database_is_shard == "1"


def test_hot_join_key_keeps_all_rows(spark):
    values = spark.range(5000).select(
        F.lit("T").alias(KEY[0]),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), "id")).alias(KEY[1]),
        F.col("id").cast("string").alias("column_value"),
    )
    meta = values.select(*KEY).distinct().withColumn("column_comment", F.lit("x"))
    assert value_with_meta(values, meta).count() == 5000


def test_hot_join_key_is_split_at_run_time(spark):
    """Beyond the broadcast size a hot column is spread over several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.shuffle.partitions": "40",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    values = spark.range(0, 60000, 1, 6).select(
        F.lit("T").alias(KEY[0]),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), "id")).alias(KEY[1]),
        F.md5(F.col("id").cast("string")).alias("column_value"),
    )
    meta = values.select(*KEY).distinct().withColumn("column_comment", F.lit("x"))
    joined = value_with_meta(values, meta)
    try:
        assert joined.agg(F.count("column_value")).first()[0] == 60000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_dictionaries(spark):
    texts = spark.createDataFrame([("B A", 2), ("A", 1), ("C", 2)], "t string, n long")
    counts = count_tokens(texts, F.split("t", ""), F.col("n"))
    ids = {r.token: r.id for r in char_dictionary(counts).collect()}
    assert ids == {"<PAD>": 0, "<UNK>": 1, "<EOS>": 2, "A": 3, " ": 4, "B": 5, "C": 6}
    assert char_ids(char_dictionary(counts)) == {"A": 3, " ": 4, "B": 5, "C": 6}
    words = {r.token: r.id for r in word_dictionary(counts).collect()}
    assert words["A"] == 3 and sorted(words.values()) == list(range(7))


KEY_TEXT = "0123456789abcdef"


def test_training_rows_from_encrypted_tables(spark, tmp_path):
    people = spark.createDataFrame(
        [(1, "王伟", "x", "2018-07-01"), (2, "NULL", "y", "2018-07-01"), (3, None, "z", "2018-07-01"), (4, "李娜", "w", "2018-07-02")],
        "id int, name string, note string, dt string",
    ).withColumn("name", encrypt(F.col("name"), KEY_TEXT))
    broken = people.withColumn("name", F.lit("not encrypted"))
    spark.createDataFrame([(7, "n")], "id int, note string").createOrReplaceTempView("plain")
    people.createOrReplaceTempView("people")
    broken.createOrReplaceTempView("broken")
    registry = {
        "people": {"note": None, "name": "姓名"},
        "broken": {"note": None, "name": "姓名"},
        "plain": {"note": None},
        "gone": {"x": None},
        "empty": {},
    }
    keys = dict.fromkeys(registry, ["id"])
    options = {"size": 100, "day": "2018-07-01", "cipher_key": KEY_TEXT}
    rows = training_rows(spark.table, registry, keys, **options)
    expected = {("people", "note", "x", "0", "0"), ("people", "name", "王伟", "1", "姓名"), ("plain", "note", "n", "0", "0")}
    assert {tuple(r) for r in rows.collect()} == expected
    path = str(tmp_path / "rows")
    for _ in range(2):
        assert write_all(spark.table, registry, keys, path, tables_per_job=2, **options) == ["gone"]
    assert spark.read.parquet(path).count() == len(expected)


def test_registry_drives_the_tables(spark):
    long = spark.createDataFrame(
        [("PLAIN2", "NOTE", "0", None), ("PLAIN2", "ID", "1", "卡号"), ("GONE", "X", "0", None)],
        "table_name string, column_name string, column_is_sensitive string, column_sensitive_type string",
    )
    spark.createDataFrame([(7, "n"), (8, "m")], "id int, note string").createOrReplaceTempView("plain2")
    pairs = dict(iter_registry(long))
    assert pairs == {"GONE": {"X": None}, "PLAIN2": {"ID": "卡号", "NOTE": None}}
    rows = training_rows(spark.table, iter_registry(long), {}, size=100)
    assert {tuple(r) for r in rows.collect()} == {
        ("plain2", "id", "7", "1", "卡号"),
        ("plain2", "id", "8", "1", "卡号"),
        ("plain2", "note", "n", "0", "0"),
        ("plain2", "note", "m", "0", "0"),
    }


def test_decryption_needs_the_right_key(spark):
    df = spark.createDataFrame([("secret",)], "v string").withColumn("v", encrypt(F.col("v"), KEY_TEXT))
    assert decryptable_rows(df, ["v"], KEY_TEXT).count() == 1
    assert decryptable_rows(df, ["v"], KEY_TEXT[::-1]).count() == 0
    assert decryptable_rows(df, ["v"], None).count() == 1


def test_protection(spark):
    df = spark.createDataFrame([("Ab1中",), ("",), (None,)], "v string")
    for key in (KEY_TEXT, "k" * 64, "k" * 65):
        got = df.select(
            protect(F.col("v"), "mask").alias("m"),
            protect(F.col("v"), "hmac", key).alias("h"),
            decrypt(protect(F.col("v"), "aes", KEY_TEXT), KEY_TEXT).alias("a"),
        ).collect()
        assert [r.m for r in got] == ["Xxn中", "", None]
        assert [r.h for r in got] == [hmac.new(key.encode(), t.encode(), "sha256").hexdigest() for t in ("Ab1中", "")] + [None]
        assert [r.a for r in got] == ["Ab1中", "", None]
    with pytest.raises(ValueError):
        protect(F.col("v"), "rot13")
    for method in ("aes", "hmac"):
        with pytest.raises(ValueError):
            protect(F.col("v"), method)


def test_no_plan_shows_a_key(spark, capsys):
    key = "s3cr3tk3ys3cr3tk"
    df = spark.range(50).select(F.col("id").cast("string").alias("v"))
    safe = df.select(protect(F.col("v"), "aes", key).alias("a"), protect(F.col("v"), "hmac", key).alias("h"))
    safe = safe.filter(decrypt(F.col("a"), key) != "7")
    before = safe._jdf.queryExecution()
    texts = [before.toString(), before.executedPlan().toString(), before.optimizedPlan().toString()]
    assert safe.count() == 49
    safe.explain("extended")
    safe.explain("formatted")
    texts += [capsys.readouterr().out, safe._jdf.queryExecution().executedPlan().toString()]
    texts.append(before.optimizedPlan().toJSON())
    shown = "".join(texts)
    block = key.encode().ljust(64, b"\0")
    forms = [key, key.encode().hex(), *(bytes(b ^ p for b in block[:8]).hex() for p in (0x36, 0x5C))]
    assert "hidden" in shown and not any(f.lower() in shown.lower() for f in forms)
    assert spark._jvm.org.apache.spark.sql.internal.SQLConf.get().redactOptions(
        spark._jvm.scala.jdk.javaapi.CollectionConverters.asScala({KEY_SETTING: key}).toMap(
            getattr(getattr(spark._jvm, "scala.$less$colon$less$"), "MODULE$").refl()
        )
    ).apply(KEY_SETTING) != key


def test_listed_days_prune_the_scan_at_run_time(spark, sf_dir):
    from workload.catalog_queries import partition_sample, partitioned
    from workload.registry import Tables

    orders, days = partitioned(Tables(spark, sf_dir))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan that runs is the plan we hold
    try:
        df = partition_sample(orders, days)
        plan = df._jdf.queryExecution().executedPlan()
        df.collect()
        scans = plan.collectLeaves()
        read = [scans.apply(i) for i in range(scans.size())]
        filters = [s.toString() for s in read if "dynamicpruning" in s.toString()]
        assert len(filters) == 1 and "PartitionFilters" in filters[0]
        read_files = df.select("dt").distinct().count()
        files = {s.metrics().apply("numFiles").value() for s in read if "dynamicpruning" in s.toString()}
        assert files == {2} and read_files <= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert partition_sample(orders, days.filter("table_name = 'none'")).count() == 0
    assert partition_sample(orders.withColumnRenamed("dt", "x"), days).count() == 100
