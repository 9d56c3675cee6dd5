"""Warehouse catalogue: which tables and columns the detector looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: table names left out (backups, dated copies, scratch) -----
EXCLUDED_TABLES = [
    ".+_bak_.*",
    ".+_bak[0-9]+",
    ".+_bak$",
    ".+_bk$",
    ".+_bk[0-9]+",
    ".+[0-9]{8}.*",
    "^temp_",
    "^tmp_",
    "^s__",
    "_test$",
]
WELL_FORMED = "^[0-9a-zA-Z_]+$"


def stage_tables(tables: DataFrame) -> DataFrame:
    """Names of active stage tables that are no backups or scratch tables."""
    kept = (F.col("database_name") == "stage") & (F.col("table_status") == "1")
    kept = kept & ~F.lower("table_name").rlike("|".join(EXCLUDED_TABLES))
    return tables.filter(kept).select("table_name").orderBy("table_name")


def tables_with_dt(columns: DataFrame) -> DataFrame:
    """Stage tables with an active ``dt`` column."""
    return (
        columns.filter(
            (F.col("column_name") == "dt")
            & (F.col("database_name") == "stage")
            & (F.col("column_status") == "1")
        )
        .select("table_name")
        .distinct()
        .orderBy("table_name")
    )


def labelled_columns(columns: DataFrame) -> DataFrame:
    """Labelled columns of tables with a well-formed name."""
    return (
        columns.filter(F.col("stage_table_name").rlike(WELL_FORMED))
        .select(
            F.col("stage_table_name").alias("table_name"),
            F.col("stage_column_name").alias("column_name"),
            "column_is_sensitive",
        )
        .orderBy("table_name", "column_name")
    )


def table_registry(tables: DataFrame, with_dt: DataFrame) -> DataFrame:
    """One row per upper-cased table name and whether it is partitioned by ``dt``."""
    names = tables.select(F.upper("table_name").alias("table_name")).distinct()
    dated = with_dt.select(F.upper("table_name").alias("table_name"), F.lit(True).alias("dt"))
    return names.join(dated.distinct(), "table_name", "left").select(
        "table_name", F.coalesce("dt", F.lit(False)).alias("dt")
    )


def column_registry(registry: DataFrame, columns: DataFrame) -> DataFrame:
    """Labelled columns of registered tables, one row each.

    The long form has no per-table lists, so a table with very many columns is
    no hot group. Flags other than ``1`` and ``0`` drop out; an insensitive
    column has no type.
    """
    upper = columns.select(
        *[
            F.upper(c).alias(c)
            for c in ["table_name", "column_name", "column_is_sensitive", "column_sensitive_type"]
        ]
    )
    routed = upper.filter(F.col("column_is_sensitive").isin("1", "0"))
    return routed.join(registry.select("table_name"), "table_name", "left_semi").select(
        "table_name",
        "column_name",
        "column_is_sensitive",
        F.when(F.col("column_is_sensitive") == "1", F.col("column_sensitive_type")).alias(
            "column_sensitive_type"
        ),
    )


def registry_totals(registry: DataFrame, columns: DataFrame) -> DataFrame:
    """Registered tables with the number of their columns on either side."""
    counts = columns.groupBy("table_name").agg(
        F.count_if(F.col("column_is_sensitive") == "0").alias("n_insensitive"),
        F.count_if(F.col("column_is_sensitive") == "1").alias("n_sensitive"),
    )
    return registry.join(counts, "table_name", "left").select(
        "table_name",
        "dt",
        F.coalesce("n_insensitive", F.lit(0)).alias("n_insensitive"),
        F.coalesce("n_sensitive", F.lit(0)).alias("n_sensitive"),
    )
