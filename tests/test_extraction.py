"""Extraction that survives broken tables and restarts; extracts read in one plan."""

import re

import pytest
from pyspark.sql import functions as F

from fieldwarden.plans import training_data
from fieldwarden.plans.training_data import training_rows, write_all
from fieldwarden.sources.extracts import extract_long
from fieldwarden.sources.ledger import ledger_summary, read_ledger


def damage(folder):
    """Overwrite the data pages of the Parquet files, but not their footers."""
    for file in folder.glob("*.parquet"):
        data = bytearray(file.read_bytes())
        data[4:-400] = bytes(len(data) - 404)
        file.write_bytes(bytes(data))


@pytest.fixture
def tables(spark, tmp_path):
    opened = []
    rows = spark.range(2000).select("id", F.md5(F.col("id").cast("string")).alias("note"))
    for name in ("a", "b", "c", "d"):
        rows.write.parquet(str(tmp_path / name))
    damage(tmp_path / "b")

    def open_table(name):
        opened.append(name)
        return spark.read.parquet(str(tmp_path / name))

    return open_table, opened, tmp_path


REGISTRY = {name: {"note": None} for name in "abcd"} | {"gone": {"x": None}, "empty": {}}


def test_a_damaged_table_is_left_out_and_tried_again(spark, tables):
    open_table, opened, tmp_path = tables
    path = str(tmp_path / "rows")
    keys = dict.fromkeys(REGISTRY, ["id"])
    assert write_all(open_table, REGISTRY, keys, path, tables_per_job=3, size=10) == ["b", "gone"]
    ledger = {r.table_name: r for r in read_ledger(spark, f"{path}_ledger").collect()}
    assert {t: (r.state, r.n_rows) for t, r in ledger.items()} == {
        "a": ("done", 10), "c": ("done", 10), "d": ("done", 10), "b": ("failed", None), "gone": ("failed", None),
    }
    assert ledger["b"].error and ledger["gone"].error
    # the table is mended; what is done is not read again
    spark.range(5).select("id", F.lit("n").alias("note")).write.mode("overwrite").parquet(str(tmp_path / "b"))
    opened.clear()
    assert write_all(open_table, REGISTRY, keys, path, size=10) == ["gone"]
    assert opened == ["b", "gone"]
    states = {r.state: (r.n_tables, r.n_rows) for r in ledger_summary(read_ledger(spark, f"{path}_ledger")).collect()}
    assert states == {"done": (4, 35), "failed": (1, 0)}
    assert spark.read.parquet(path).count() == 35


def test_a_stopped_run_goes_on(spark, tables, monkeypatch):
    open_table, opened, tmp_path = tables
    path, written = str(tmp_path / "rows"), []

    def stop(rows, target):
        if len(written) == 1:
            raise KeyboardInterrupt
        written.append(target)
        original(rows, target)

    original = training_data.write_training_rows
    monkeypatch.setattr(training_data, "write_training_rows", stop)
    registry = spark.createDataFrame(
        [(t, "note", "0", None) for t in "acd"],
        "table_name string, column_name string, column_is_sensitive string, column_sensitive_type string",
    )
    with pytest.raises(KeyboardInterrupt):
        write_all(open_table, registry, {}, path, tables_per_job=1, size=10)
    monkeypatch.undo()
    opened.clear()
    assert write_all(open_table, registry, {}, path, tables_per_job=1, size=10) == []
    assert opened == ["c", "d"] and spark.read.parquet(path).count() == 30


def test_no_tables(spark, tmp_path):
    assert training_rows(spark.table, {}, {}, size=3).collect() == []
    assert write_all(spark.table, {}, {}, str(tmp_path / "rows"), size=3) == []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.tsv").write_text("a\n1\n")
    assert extract_long(spark, str(tmp_path / "in"), {}).collect() == []


def test_many_extracts_are_one_scan(spark, tmp_path):
    for i in range(300):
        names = ["id", "name", f"c{i}"][:: 1 if i % 2 else -1]
        rows = [[f"{n}{i}" for n in names], ["", '"q""t"', "x\r"]]
        (tmp_path / f"t{i}.tsv").write_text("\n".join("\t".join(r) for r in [names, *rows]) + "\n")
    registry = {f"T{i}": {"ID": None, f"C{i}": "手机"} for i in range(300)}
    df = extract_long(spark, str(tmp_path), registry)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan text", plan)) == 1
    got = {}
    for r in df.collect():
        got.setdefault(r.stage_table_name, set()).add(tuple(r)[1:])
    assert len(got) == 300
    assert got["t3"] == {("id", "id3", "0", "0"), ("c3", "c33", "1", "手机"), ("id", None, "0", "0"), ("c3", "x", "1", "手机")}
    assert got["t4"] == {("id", "id4", "0", "0"), ("c4", "c44", "1", "手机"), ("id", "x", "0", "0"), ("c4", None, "1", "手机")}


def test_quoted_newlines_need_whole_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('id\tnote\n1\t"two\nlines ""x"""\n\n2\ta"b\n3\t""')
    registry = {"T": {"id": None, "note": None}}
    with pytest.raises(Exception, match="quoted_newlines"):
        extract_long(spark, str(tmp_path), registry).collect()
    rows = extract_long(spark, str(tmp_path), registry, quoted_newlines=True).collect()
    notes = sorted((r.column_value for r in rows if r.stage_column_name == "note"), key=repr)
    assert notes == ["", 'a"b', 'two\nlines "x"']


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    lines = "".join(f"{i}\t{'n' * 90}\n" for i in range(30_000))
    (tmp_path / "big.tsv").write_text("id\tnote\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256 << 10)
    try:
        df = extract_long(spark, str(tmp_path), {"BIG": {"id": None}})
        assert df.rdd.getNumPartitions() > 5
        assert sorted(int(r.column_value) for r in df.collect()) == list(range(30_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
