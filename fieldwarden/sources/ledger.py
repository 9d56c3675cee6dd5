"""The ledger of an extraction: what became of each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.sources.store import path_exists

ENTRY = "table_name string, state string, n_rows long, error string, attempt int"
DONE, FAILED = "done", "failed"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries; none before the first."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each table."""
    entry = F.struct("state", "n_rows", "error", "attempt")
    last = read_entries(spark, path).groupBy("table_name").agg(F.max_by(entry, "attempt").alias("e"))
    return last.select("table_name", "e.*")


def next_attempt(spark: SparkSession, path: str) -> int:
    return (read_entries(spark, path).agg(F.max("attempt").alias("last")).first().last or 0) + 1


def enter(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Append the entries of one job as one file, so that they appear together."""
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(path)


def count_rows(spark: SparkSession, path: str, tables: list[str]) -> dict[str, int]:
    """Stored training rows of some tables; only their folders are looked at."""
    stored = spark.read.parquet(path).filter(F.col("stage_table_name").isin([t.lower() for t in tables]))
    counts = stored.groupBy("stage_table_name").agg(F.count(F.lit(1)).alias("n"))
    return {str(r.stage_table_name): r.n for r in counts.collect()}


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """``state, n_tables, n_rows`` of a ledger."""
    return ledger.groupBy("state").agg(
        F.count(F.lit(1)).alias("n_tables"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")
    )
