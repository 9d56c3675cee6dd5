"""Sampled table extracts: one tab-separated file (or folder) per table, all read in one plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.operators.sampling import TRAINING_ROW
from fieldwarden.session import stored
from fieldwarden.sources.delimited import QUOTED, cells_of

RECORD = rf"(?:{QUOTED}(?=[\t\n]|$)|[^\t\n]*+)(?:\t(?:{QUOTED}(?=[\t\n]|$)|[^\t\n]*+))*+"

REGISTRY = "table_name string, column_name string, column_is_sensitive string, column_sensitive_type string"


def read_records(spark: SparkSession, directory: str, quoted_newlines: bool = False) -> DataFrame:
    """``file, table, start, id, cells``: every record of every ``*.tsv`` below a directory.

    Lines are read in ranges, so that a large file is many tasks; a cell with a
    quoted newline is an error then. With ``quoted_newlines`` a file is taken
    whole and cut into records.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    meta = ["_metadata.file_path", "_metadata.file_block_start"]
    if quoted_newlines:
        texts = reader.text(directory, wholetext=True)
        # a record may be empty, so its line feed is part of the pattern; the last one may lack it
        whole = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\n$", "")
        records = F.regexp_extract_all(F.concat(F.lit("\n"), whole), F.lit(f"\n({RECORD})"), F.lit(1))
        lines = texts.select(*meta, F.explode(records).alias("record"))
    else:
        texts = reader.text(directory, lineSep="\n")
        lines = texts.select(*meta, F.regexp_replace("value", "\r$", "").alias("record"))
    table = F.upper(F.regexp_extract("file_path", r"/([^/]+)\.tsv(?:/[^/]+)?$", 1))
    return lines.select(
        F.col("file_path").alias("file"),
        table.alias("table"),
        F.col("file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        "record",
    ).filter(F.col("table") != "")


def registry_rows(spark: SparkSession, registry: DataFrame | Mapping[str, Mapping[str, str | None]]) -> DataFrame:
    """The long registry; a mapping of tables to columns and sensitive types becomes one."""
    if isinstance(registry, DataFrame):
        return registry
    rows = [
        (table, column, "0" if kind is None else "1", kind)
        for table, columns in registry.items()
        for column, kind in columns.items()
    ]
    return spark.createDataFrame(rows, REGISTRY)


def wanted_cells(records: DataFrame, registry: DataFrame) -> DataFrame:
    """``file, header, wanted``: per file of a registered table its header line and the cells to take.

    The header is the first record of a file. A file that lacks a registered
    column is left out, columns are matched without case.
    """
    headers = (
        records.filter("start = 0")
        .groupBy("file", "table")
        .agg(F.min("id").alias("header"), F.min_by("record", "id").alias("names"))
    )
    names = headers.select("file", "table", "header", F.posexplode(cells_of(F.col("names"))).alias("at", "name"))
    known = registry.filter(F.col("column_is_sensitive").isin("0", "1")).select(
        F.upper("table_name").alias("table"),
        F.lower("column_name").alias("column"),
        "column_is_sensitive",
        F.when(F.col("column_is_sensitive") == "1", F.coalesce("column_sensitive_type", F.lit(""))).alias("kind"),
    )
    needed = known.groupBy("table").agg(F.count_distinct("column").alias("needed"))
    found = names.withColumn("column", F.lower("name")).join(known, ["table", "column"])
    cell = F.struct("at", "column", "column_is_sensitive", F.coalesce("kind", F.lit("0")).alias("kind"))
    files = found.groupBy("file", "table", "header").agg(
        F.collect_set(cell).alias("wanted"), F.count_distinct("column").alias("n")
    )
    complete = files.join(needed, "table").filter(F.col("n") == F.col("needed"))
    return stored(complete.select("file", "header", "wanted"), "wanted-cells")


def extract_long(
    spark: SparkSession,
    directory: str,
    registry: DataFrame | Mapping[str, Mapping[str, str | None]],
    quoted_newlines: bool = False,
) -> DataFrame:
    """Training rows of all extracts whose table is registered, from one scan of the directory.

    ``registry`` is the long table of ``table_name, column_name,
    column_is_sensitive, column_sensitive_type`` or a mapping of tables to
    columns and types. Headers are data: they are joined with the registry and
    say which cell of a record is which column, however many tables there are.
    An extract that lacks a registered column is left out as a whole; without
    any extract of a registered table there are no rows.
    """
    records = read_records(spark, directory, quoted_newlines)
    wanted = wanted_cells(records, registry_rows(spark, registry))
    rows = records.join(wanted, "file").filter(F.col("id") != F.col("header"))
    # an empty line is no record, unless the table has a single column
    rows = rows.filter((F.col("record") != "") | (F.size("wanted") == 1))
    cells = rows.select("table", cells_of(F.col("record")).alias("cells"), F.explode("wanted").alias("w"))
    return cells.select(
        F.lower("table").alias("stage_table_name"),
        F.col("w.column").alias("stage_column_name"),
        F.get("cells", F.col("w.at")).alias("column_value"),
        F.col("w.column_is_sensitive").alias("column_is_sensitive"),
        F.col("w.kind").alias("column_sensitive_type"),
    ).to(TRAINING_ROW)
