"""Audit of extraction runs from their log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log_lines(spark: SparkSession, directory: str) -> DataFrame:
    """One row per line, with the name of the file it stands in."""
    lines = spark.read.option("pathGlobFilter", "*.log").text(directory)
    return lines.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def failed_runs(lines: DataFrame, marker: str = "FAILED") -> DataFrame:
    """Files with a failed line and how many such lines they hold."""
    return (
        lines.filter(F.contains("line", F.lit(marker)))
        .groupBy("file")
        .agg(F.count(F.lit(1)).alias("n_failed"))
    )


def run_summary(lines: DataFrame, marker: str = "FAILED") -> DataFrame:
    """How many runs there were and how many of them failed, in one row."""
    by_file = lines.groupBy("file").agg(
        F.max(F.contains("line", F.lit(marker)).cast("int")).alias("failed")
    )
    return by_file.agg(
        F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.sum("failed"), F.lit(0)).alias("n_failed_runs")
    )


def count_results(spark: SparkSession, directory: str, pattern: str = "*.tsv") -> DataFrame:
    """Number of result files; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return files.select("path").agg(F.count(F.lit(1)).alias("n_results"))
