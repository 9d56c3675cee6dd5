"""Scoring of request files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldwarden.plans.score import Predictor, score_requests


def stream_scores(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    predictor: Predictor,
    key: str = "request_id",
    files_per_batch: int = 1000,
    available_now: bool = True,
) -> StreamingQuery:
    """Score request files from ``source`` into Parquet below ``target``.

    Lines are JSON objects ``{"<key>": ..., "body": "<request JSON>"}``. A
    request carries all its values, so no state crosses batches. Each batch
    overwrites the folder of its own id, so a batch that runs again after a
    failure replaces its output instead of adding to it.
    """
    lines = (
        spark.readStream.schema(f"{key} string, body string")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(source)
    )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = score_requests(batch, predictor, key)
        scored.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_scores(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).withColumn("batch", F.col("batch").cast("long"))
