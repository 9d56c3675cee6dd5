from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldwarden import session
from fieldwarden.functions import crypto
from fieldwarden.functions.vocab import META_FIELDS
from fieldwarden.session import shared_dir, spread_small
from fieldwarden.sources import delimited, logs
from fieldwarden.sources.extracts import extract_long
from fieldwarden.sources.store import (
    build_or_reuse_dictionary,
    export_dictionary,
    read_features,
    write_features,
    write_training_rows,
)

EDGES = (
    "a\tb\tc\n"
    "1\t2\t3\n"
    "too\tlong\trow\tx\n"
    "short\trow\n"
    "long\twith\tempty\t\n"
    "NULL\tN/A\tkept\n"
    '"tab\tin"\t"dou""ble"\t"new\nline"\n'
    "back\\slash\t padded \t\"\\\"\n"
    "1\t2\t3\t4\t5\n"
    "\n"
    '"q\tq"\t"x"\t"y"\t\n'
)


@pytest.mark.parametrize("quoted_newlines", [True, False])
def test_tsv_edges_equal_pandas(spark, tmp_path, quoted_newlines):
    path, options = str(tmp_path / "edges.tsv"), {"quoted_newlines": quoted_newlines}
    with open(path, "w") as f:
        f.write(EDGES if quoted_newlines else EDGES.replace("new\nline", "one\x01line"))
    ours = delimited.read_tsv(spark, path, ["a", "b", "c"], **options).collect()
    frame = pd.read_csv(path, sep="\t", quotechar='"', dtype=str, on_bad_lines="skip")
    theirs = [tuple(None if pd.isna(x) else x for x in row) for row in frame.itertuples(index=False)]
    assert [tuple(r) for r in ours] == theirs
    # counting alone prunes all fields and must not change which rows are dropped
    assert delimited.read_tsv(spark, path, ["a", "b", "c"], **options).count() == len(theirs)


def test_a_cell_with_a_newline_needs_its_option(spark, tmp_path):
    (tmp_path / "e.tsv").write_text(EDGES)
    with pytest.raises(Exception, match="quoted_newlines=True"):
        delimited.read_tsv(spark, str(tmp_path / "e.tsv"), ["a", "b", "c"]).collect()


def test_a_large_file_is_many_tasks(spark, tmp_path):
    lines = "".join(f'{i}\t"{"n" * 90}"\n' for i in range(30_000))
    (tmp_path / "big.tsv").write_text("id\tnote\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256 << 10)
    try:
        df = delimited.read_tsv(spark, str(tmp_path / "big.tsv"), ["id", "note"])
        assert df.rdd.getNumPartitions() > 5
        assert sorted(int(r.id) for r in df.select("id").collect()) == list(range(30_000))
        assert df.filter(F.col("note") != "n" * 90).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_literal_reading_keeps_na_tokens(spark, tmp_path):
    path = str(tmp_path / "edges.tsv")
    with open(path, "w") as f:
        f.write("a\tb\nNULL\tN/A\n")
    assert tuple(delimited.read_dictionary_text(spark, path, ["a", "b"]).first()) == ("NULL", "N/A")


def test_write_and_read_back(spark, tmp_path):
    rows = [(" a ", "t\tb", 'q"u', "n\nl", "back\\")]
    fields = ["p", "q", "r", "s", "t"]
    path = str(tmp_path / "out")
    delimited.write_tsv(spark.createDataFrame(rows, fields), path)
    assert [tuple(r) for r in delimited.read_tsv(spark, path, fields, quoted_newlines=True).collect()] == rows


def test_typed_meta(spark, tmp_path):
    row = {f: "x" for f in META_FIELDS} | {"database_port": "3306", "column_allow_null": "1", "column_is_sensitive": "NA"}
    delimited.write_tsv(spark.createDataFrame([tuple(row.values())], list(row)), str(tmp_path / "m"))
    got = delimited.read_typed_meta(spark, str(tmp_path / "m")).first()
    assert (got.database_port, got.column_allow_null, got.column_is_primary_key) == (3306, 1, None)


def test_table_list(spark, tmp_path):
    (tmp_path / "t.csv").write_text("table_name\nabc\ndef\n")
    assert [r.table_name for r in delimited.read_table_list(spark, str(tmp_path / "t.csv")).collect()] == ["abc", "def"]


def test_log_audit(spark, tmp_path):
    (tmp_path / "a.log").write_text("ok\nFAILED: x\n" + "FAILED: y\n" * 9)
    (tmp_path / "b.log").write_text("ok\n")
    (tmp_path / "c.tsv").write_text("FAILED\n")
    lines = logs.read_log_lines(spark, str(tmp_path))
    # ten failures: a count that ends in 0 is a failure too
    assert [tuple(r) for r in logs.failed_runs(lines).collect()] == [("a.log", 10)]
    assert tuple(logs.run_summary(lines).first()) == (2, 1)
    assert logs.count_results(spark, str(tmp_path)).first().n_results == 1


def test_extracts(spark, tmp_path):
    (tmp_path / "Good.tsv").write_text('id\tname\textra\n1\t"a ""b"""\tz\n2\t\ty\n')
    (tmp_path / "lacking.tsv").write_text("id\n1\n")
    (tmp_path / "unknown.tsv").write_text("id\n1\n")
    (tmp_path / "notes.txt").write_text("id\n1\n")
    registry = {"GOOD": {"ID": None, "NAME": "姓名"}, "LACKING": {"ID": None, "NAME": "姓名"}}
    rows = {tuple(r) for r in extract_long(spark, str(tmp_path), registry).collect()}
    assert rows == {
        ("good", "id", "1", "0", "0"),
        ("good", "id", "2", "0", "0"),
        ("good", "name", 'a "b"', "1", "姓名"),
        ("good", "name", None, "1", "姓名"),
    }


def test_feature_store(spark, tmp_path):
    df = spark.createDataFrame([("train", [1.0]), ("test", [2.0])], "split string, wide array<double>")
    path = str(tmp_path / "features")
    write_features(df, path)
    assert read_features(spark, path, "test").first().wide == [2.0]
    with pytest.raises(Exception, match="already exists"):
        write_features(df, path)


def test_dictionary_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("A", 3, 5)], "token string, id int, n long")

    path = str(tmp_path / "dictionary")
    for _ in range(2):
        assert build_or_reuse_dictionary(spark, path, build).first().token == "A"
    assert built == [1]
    export_dictionary(spark.read.parquet(path), str(tmp_path / "listing"))
    listing = spark.read.csv(str(tmp_path / "listing"), sep="\t", header=True)
    assert listing.columns == ["char", "id"]


def test_training_rows_replace_those_of_their_table(spark, tmp_path):
    df = spark.createDataFrame([("t", "c", "v")], "stage_table_name string, stage_column_name string, column_value string")
    other = df.withColumn("stage_table_name", F.lit("u"))
    for rows in (df, df.unionByName(other), df):
        write_training_rows(rows, str(tmp_path / "rows"))
    assert sorted(r.stage_table_name for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == ["t", "u"]


def test_cipher_key_comes_from_the_session(spark):
    with pytest.raises(ValueError):
        crypto.cipher_key(spark)
    spark.conf.set(crypto.KEY_SETTING, "0" * 16)
    assert crypto.cipher_key(spark) == "0" * 16
    spark.conf.unset(crypto.KEY_SETTING)


def fake_session(master, folder):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(
            master=master,
            getConf=lambda: SimpleNamespace(get=lambda key: folder),
        ),
    )


def test_shared_dir_follows_the_session(spark):
    given = shared_dir(fake_session("yarn", "/shared"), "x")
    assert given.startswith("/shared/fieldwarden/x-")
    with pytest.raises(RuntimeError):
        shared_dir(fake_session("yarn", None), "x")
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


def test_only_small_inputs_are_spread(spark, sf_dir, monkeypatch):
    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "RoundRobin" in spread_small(small)._jdf.queryExecution().toString()
    monkeypatch.setattr(session, "SMALL_INPUT", 1000)
    assert spread_small(small) is small
