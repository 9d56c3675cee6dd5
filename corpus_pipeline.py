"""A training corpus in five stages: filter, deduplicate, decontaminate, pack."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.llm import fm_index, hyperminhash, line_dedup, packing, toxicity
from fieldwarden.llm.common import prepared, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def keeps_columns(stage: Stage) -> Stage:
    """The stage with further columns of the documents under names that it cannot take for its own."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in DOCUMENT]
        apart = {c: f"carried{i}" for i, c in enumerate(others)}
        names = [apart.get(c, c) for c in docs.columns]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run_stage


@keeps_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold."""
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity(docs, toxicity.train(docs, labels))
    return scored.filter(F.col("predicted") == 0).select(*docs.columns)


@keeps_columns
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them share."""
    kept = line_dedup.drop_shared_lines(docs)
    changed = F.col("n_dropped") > 0
    size = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    return kept.withColumns({"n_chars": size, "text": text}).select(*docs.columns)


@keeps_columns
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; equal rows of it once."""
    kept = hyperminhash.near_duplicates(docs).filter("kept").select("doc_id")
    counts = stored(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept")
    own = counts.select(F.col("doc_id").alias("_doc"))
    rows = docs.join(own, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    # rows without an id are no copies of each other by it, so only repeated ids cost this shuffle
    if counts.filter("n > 1 AND doc_id IS NOT NULL").isEmpty():
        return rows
    named, unnamed = rows.filter("doc_id IS NOT NULL"), rows.filter("doc_id IS NULL")
    return named.dropDuplicates(["doc_id", "text"]).unionByName(unnamed)


@keeps_columns
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return fm_index.remove_passages(docs, prepared(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the packing; both are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
