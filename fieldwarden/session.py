"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the work per row is heavy, so small shuffles should still use all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32KB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows are small on disk and grow when they are encoded, so a task reads less of them
    "spark.sql.files.maxPartitionBytes": "32m",
    # a few folders are written side by side; without this, each task sorts its whole rows by folder first
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    # texts can be long; smaller batches bound the memory of the Python workers
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def local_session(cores: str | int = "*", app: str = "fieldwarden", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8" if cores == "*" else str(cores),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the defaults to a session wherever it has no setting of its own."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


@cache
def own_dir() -> str:
    """A folder of this process, removed when it ends."""
    path = tempfile.mkdtemp(prefix="fieldwarden-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared checkpoint folder of the session.

    Every executor must see what lands here, so on a cluster the folder comes
    from ``spark.checkpoint.dir``. Only a local session without that setting gets
    a folder of its own, which goes with the process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = own_dir()
    return os.path.join(root, "fieldwarden", f"{purpose}-{uuid.uuid4().hex}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several steps read, and read it back.

    Cuts the lineage too: a lost executor costs a read, not the whole job again.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# inputs below this size may be spread before heavy work per row
SMALL_INPUT = 256 << 20
BYTES_PER_TASK = 64 << 10
MOST_BYTES_PER_TASK = 2 << 20


def estimated_size(df: DataFrame) -> int:
    """Bytes of a result as the optimizer estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a small input over the cores; leave a large one where it is.

    A small file is often a single row group, so one task would do all the work
    of a costly expression. Large inputs have enough row groups, and their
    shuffle would cost more than it gains, so the size estimate decides.
    """
    size = estimated_size(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = min(cores, size // BYTES_PER_TASK)
    return df.repartition(tasks) if size < SMALL_INPUT and tasks > 1 else df


def spread_heavy(df: DataFrame) -> DataFrame:
    """Spread an input of any size ahead of work that makes its rows many times as large.

    All cores take part where the input allows it, and beyond that the number of
    tasks grows with the input, so that one task's share stays bounded. Estimates
    behind a join can be far too large, hence a most of tasks for each core.
    """
    size = estimated_size(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = min(size // BYTES_PER_TASK, max(cores, size // MOST_BYTES_PER_TASK), 32 * cores)
    return df.repartition(tasks) if tasks > 1 else df
