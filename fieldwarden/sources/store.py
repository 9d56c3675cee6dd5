"""Stored intermediate results: features, dictionaries, training rows, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def write_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Features of all splits, one folder per split."""
    features.write.mode(mode).partitionBy("split").parquet(path)


def read_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored if split is None else stored.filter(F.col("split") == split)


def write_splits(split: DataFrame, path: str, mode: str = "errorifexists") -> None:
    split.write.mode(mode).partitionBy("split").parquet(path)


def build_or_reuse_dictionary(spark: SparkSession, path: str, build) -> DataFrame:
    """The stored dictionary; built and stored first if there is none."""
    if not path_exists(spark, path):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def export_dictionary(dictionary: DataFrame, path: str, token_name: str = "char") -> None:
    """Tab-separated ``token, id`` listing in id order."""
    listing = dictionary.select(F.col("token").alias(token_name), "id").orderBy("id")
    listing.write.csv(path, sep="\t", header=True, quote='"', escape='"')


def write_training_rows(rows: DataFrame, path: str) -> None:
    """One folder per table; a table that is written again replaces its rows, others stay."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("stage_table_name").parquet(path)


def save_model(model: PipelineModel, path: str, version: int) -> str:
    target = f"{path}/version={version}"
    model.write().overwrite().save(target)
    return target


def latest_version(spark: SparkSession, path: str) -> int:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    names = [entry.getPath().getName() for entry in entries]
    return max(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def load_model(spark: SparkSession, path: str, version: int | None = None) -> PipelineModel:
    """A stored model, the newest unless a version is named."""
    version = latest_version(spark, path) if version is None else version
    return PipelineModel.load(f"{path}/version={version}")
