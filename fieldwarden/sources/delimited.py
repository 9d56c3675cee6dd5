"""Delimited text files with the reading rules the detector's data relies on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.vocab import META_FIELDS, VALUE_FIELDS

# ---- Fixed values: cells that stand for a missing value ---------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]

# quoted text, doubled quotes inside; possessive, so that a long cell needs no stack
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
CELL = rf"(?:{QUOTED}(?=\t|$)|[^\t]*+)"
BROKEN = "_broken_row"
NO_CELL = "\x01"  # stands for a separator where lines are read whole


def string_schema(fields: list[str], *extra: str) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in [*fields, *extra]])


def null_if_missing(cell: Column, tokens: list[str] = NA_TOKENS) -> Column:
    return F.when(cell.isin(tokens), None).otherwise(cell)


def cells_of(record: Column) -> Column:
    """The cells of a record; a bare empty cell is null, a quoted one an empty text."""
    raw = F.regexp_extract_all(F.concat(F.lit("\t"), record), F.lit(rf"\t({CELL})"), F.lit(1))

    def plain(cell: Column) -> Column:
        inner = F.replace(F.substr(cell, F.lit(2), F.char_length(cell) - 2), F.lit('""'), F.lit('"'))
        open_quote = F.raise_error(F.lit("a quoted cell holds a newline: read with quoted_newlines=True"))
        return (
            F.when(cell == "", F.lit(None).cast("string"))
            .when(cell.rlike(f"^{QUOTED}$"), inner)
            .when(cell.startswith('"'), open_quote.cast("string"))
            .otherwise(cell)
        )

    return F.transform(raw, plain)


def read_lines(spark: SparkSession, path: str | list[str], fields: list[str]) -> DataFrame:
    """Rows of files whose cells hold no newline: every line is a row, so files are read in ranges."""
    lines = spark.read.schema(string_schema(["_line"], BROKEN)).csv(
        path,
        sep=NO_CELL,
        header=True,
        quote="",
        escape="",
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=BROKEN,
        enforceSchema=True,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    # a line that holds the stand-in is read as two cells; its raw text is whole
    whole = lines.select(F.coalesce(BROKEN, "_line").alias("_line"))
    rows = whole.select(cells_of(F.col("_line")).alias("_cells")).filter(F.size("_cells") <= len(fields))
    return rows.select(*[F.get("_cells", F.lit(i)).alias(f) for i, f in enumerate(fields)])


def read_whole_files(spark: SparkSession, path: str | list[str], fields: list[str]) -> DataFrame:
    """Rows of files whose quoted cells may hold newlines; a file is one task."""
    rows = spark.read.schema(string_schema(fields, BROKEN)).csv(
        path,
        sep="\t",
        header=True,
        quote='"',
        escape='"',
        mode="PERMISSIVE",
        multiLine=True,
        columnNameOfCorruptRecord=BROKEN,
        enforceSchema=True,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    # only rows whose field count is off carry their raw text
    tabs = F.char_length(F.regexp_replace(F.regexp_replace(BROKEN, QUOTED, ""), "[^\t]", ""))
    # Spark refuses to read the raw text alone, so the filter looks at a field too
    some_field = F.coalesce(F.char_length(fields[0]), F.lit(0)) >= 0
    return rows.filter((F.col(BROKEN).isNull() | (tabs < len(fields))) & some_field)


def read_tsv(
    spark: SparkSession,
    path: str | list[str],
    fields: list[str],
    na_tokens: list[str] | None = NA_TOKENS,
    quoted_newlines: bool = False,
) -> DataFrame:
    """All-string rows of headed, tab-separated files.

    Rows with too many fields are dropped, short rows are padded with nulls and
    missing-value cells become null. A large file is read by many tasks; a cell
    that holds a newline is an error then. ``quoted_newlines=True`` reads such
    files, each by one task.
    """
    read = read_whole_files if quoted_newlines else read_lines
    kept = read(spark, path, fields)
    tokens = na_tokens if na_tokens is not None else []
    return kept.select(
        *[(null_if_missing(F.col(f), tokens) if tokens else F.col(f)).alias(f) for f in fields]
    )


def read_meta(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """``column_meta`` files; every field is a string."""
    return read_tsv(spark, path, META_FIELDS, **options)


def read_typed_meta(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """``column_meta`` with the port and the three flags as integers."""
    integers = {"database_port", "column_is_primary_key", "column_allow_null", "column_is_sensitive"}
    meta = read_meta(spark, path, **options)
    return meta.select(
        *[F.col(f).try_cast("int").alias(f) if f in integers else F.col(f) for f in meta.columns]
    )


def read_values(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Keys and values of ``column_value`` files; labels there are not used."""
    return read_tsv(spark, path, VALUE_FIELDS, **options).select(VALUE_FIELDS[:3])


def read_dictionary_text(spark: SparkSession, path: str | list[str], fields: list[str]) -> DataFrame:
    """The same files with their literal text, as dictionaries count it."""
    return read_tsv(spark, path, fields, na_tokens=None)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(
        path,
        sep="\t",
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def read_table_list(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV with a ``table_name`` column."""
    return spark.read.csv(path, header=True, escape='"').select("table_name")


def read_labelled_columns(spark: SparkSession, path: str) -> DataFrame:
    fields = ["table_name", "column_name", "column_is_sensitive", "column_sensitive_type"]
    return read_tsv(spark, path, fields, na_tokens=None)
