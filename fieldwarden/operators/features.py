"""Wide (79 numbers) and deep (230 ids) features of (column, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.encoders import (
    category_index,
    column_type_base,
    is_sensitive_label,
    len_ratio,
    one_hot,
    sensitive_type_class,
)
from fieldwarden.functions.text import clean_text, id_table, text_sequences
from fieldwarden.functions.vocab import CATEGORIES, DEEP_LAYOUT, KEY, MAX_LEN, WIDE_LAYOUT
from fieldwarden.operators.joining import META_ALIASES, attach, shuffled_if_large
from fieldwarden.session import spread_heavy

COLUMN_TYPE_FROM = "database_type"


def wide_block(field: str, source: Column) -> Column:
    """The slots of one field: its one-hot code, or its length ratio."""
    if field not in CATEGORIES:
        return F.array(len_ratio(source, MAX_LEN[field]))
    values, default = CATEGORIES[field]
    return one_hot(category_index(source, values, default), len(values))


def wide_size(fields: list[str] = WIDE_LAYOUT) -> int:
    """Number of slots of the fields."""
    return sum(len(CATEGORIES[f][0]) if f in CATEGORIES else 1 for f in fields)


def wide_features(
    available: list[str],
    column_type_from: str = COLUMN_TYPE_FROM,
    fields: list[str] = WIDE_LAYOUT,
) -> Column:
    """Concatenated slots of the fields; an absent field takes its default.

    The published model reads the column type from ``database_type``;
    ``column_type_from="column_type"`` reads the field of that name.
    """
    blocks = []
    for field in fields:
        source = F.col(field) if field in available else F.lit(None).cast("string")
        if field == "column_type" and field in available:
            source = column_type_base(F.col(column_type_from))
        blocks.append(wide_block(field, source))
    return F.concat(*blocks)


def deep_features(
    available: list[str], ids: dict[str, int], fields: list[str] = DEEP_LAYOUT
) -> Column:
    """Concatenated id sequences of the text fields; an absent field is empty."""
    cleaned = {
        f: clean_text(F.col(f)) if f in available else F.lit("") for f in fields
    }
    return text_sequences(cleaned, id_table(ids))


def add_features(
    df: DataFrame, ids: dict[str, int] | None, column_type_from: str = COLUMN_TYPE_FROM
) -> DataFrame:
    """Feature columns ``wide`` and, given a dictionary, ``deep``."""
    out = df.withColumn("wide", wide_features(df.columns, column_type_from))
    return out.withColumn("deep", deep_features(df.columns, ids)) if ids is not None else out


def labels(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Binary label and class id; the class of an unknown type is null."""
    return df.withColumns(
        {
            "is_sensitive": is_sensitive_label(F.coalesce("column_is_sensitive", F.lit(""))),
            "class_id": sensitive_type_class(F.col("column_sensitive_type"), legacy),
        }
    )


def split_rejects(
    labelled: DataFrame, on_unknown: str = "reject"
) -> tuple[DataFrame, DataFrame]:
    """Rows with a class and the rows to reject; ``error`` fails on the first of those."""
    known = F.col("class_id").isNotNull()
    if on_unknown == "error":
        checked = F.when(known, F.col("class_id")).otherwise(
            F.raise_error(F.concat(F.lit("unknown type: "), F.col("column_sensitive_type"))).cast("int")
        )
        return labelled.withColumn("class_id", checked), labelled.limit(0)
    return labelled.filter(known), labelled.filter(~known)


def dataset_features(
    values: DataFrame,
    meta: DataFrame,
    ids: dict[str, int] | None,
    column_type_from: str = COLUMN_TYPE_FROM,
    carry: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Features and labels of every value; without a dictionary only the wide ones.

    Metadata is encoded once per column, before the join, not once per value;
    only the value's own slots are made after it. ``carry`` names metadata
    fields to keep, such as the split; ``keep`` names those of the values.
    """
    meta = spread_heavy(meta.withColumnsRenamed(META_ALIASES))
    own, deep_of_meta, deep = ["column_value"], [], []
    if ids is not None:
        deep_of_meta = [deep_features(meta.columns, ids, DEEP_LAYOUT[:-1]).alias("_deep")]
        deep = [F.concat("_deep", deep_features(own, ids, own)).alias("deep")]
    encoded = labels(meta).select(
        *KEY,
        *(carry or []),
        "is_sensitive",
        "class_id",
        wide_features(meta.columns, column_type_from, WIDE_LAYOUT[:-1]).alias("_wide"),
        *deep_of_meta,
    )
    joined = attach(values.select(*KEY, *own, *(keep or [])), shuffled_if_large(encoded, meta))
    value = F.coalesce("column_value", F.lit(""))
    filled = joined.withColumn("column_value", value)
    return filled.select(
        *[F.coalesce(k, F.lit("")).alias(k) for k in KEY],
        "column_value",
        *(keep or []),
        *(carry or []),
        "is_sensitive",
        "class_id",
        F.concat("_wide", wide_features(own, fields=own)).alias("wide"),
        *deep,
    )
