"""Scoring of columns: requests in, one vote per column out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.encoders import class_name
from fieldwarden.functions.rules import keyword_class, rule_class_id
from fieldwarden.functions.vocab import CLASSES, KEY, STATUS_OK
from fieldwarden.operators.joining import META_ALIASES, attach, shuffled_if_large
from fieldwarden.operators.voting import FLAGS, gather_predictions, vote, vote_in_row
from fieldwarden.plans import learn, network
from fieldwarden.sources.requests import explode_request_values, listed_values, request_fields, validate_requests

RESULT = ["status", "error_msg", "label", "raw_label", "probability", "predictions"]


@dataclass(frozen=True)
class Predictor:
    """Two steps: ``prepare`` once per column, ``predict`` once per value.

    ``prepare`` sees metadata fields and adds the column ``carried``; ``predict``
    sees that column and a value and adds ``prediction``.
    Where an expression over ``carried`` and a value does it, ``of_value`` is
    that expression, and a request's list is scored without leaving its row.
    ``names`` are those of the predicted classes.
    """

    prepare: Callable[[DataFrame], DataFrame]
    predict: Callable[[DataFrame], DataFrame]
    carried: str
    of_value: Callable[[Column], Column] | None = None
    names: tuple[str, ...] = tuple(CLASSES)


def by_model(model: PipelineModel, binary: bool = False) -> Predictor:
    """A linear model of the classes, or of the binary flag."""
    return Predictor(
        learn.encode_meta,
        lambda rows: learn.predict(model, learn.encode_values(rows)),
        learn.META_VECTOR,
        names=tuple(FLAGS if binary else CLASSES),
    )


def by_network(
    branches: network.Branches, model: MultilayerPerceptronClassificationModel, threshold: float | None = None
) -> Predictor:
    """A network; with a ``threshold`` a binary one, sensitive from that probability on."""

    def predict(rows: DataFrame) -> DataFrame:
        out = network.predict(model, network.both_branches(learn.encode_values(rows), branches))
        if threshold is None:
            return out.drop("probabilities")
        flag = (F.col("probabilities")[1] >= threshold).cast("int")
        return out.withColumn("prediction", flag).drop("probabilities")

    names = tuple(CLASSES if threshold is None else FLAGS)
    return Predictor(learn.encode_meta, predict, learn.META_VECTOR, names=names)


def by_rules() -> Predictor:
    """Patterns in the values, then keywords in the name and comment of the column."""
    hint = keyword_class(F.col("column_name"), F.col("column_comment"))

    def of_value(value: Column) -> Column:
        return rule_class_id(value, F.col("_keyword"))

    return Predictor(
        lambda meta: meta.withColumn("_keyword", hint),
        lambda rows: rows.withColumn("prediction", of_value(F.col("column_value"))),
        "_keyword",
        of_value,
    )


def score_requests(
    requests: DataFrame, predictor: Predictor, key: str, body: str = "body"
) -> DataFrame:
    """One result per request; invalid requests carry their status and message only.

    Both kinds go through one pass over the input, and the vote runs over the
    list of predictions, inside the row. Only a model needs one row per value
    and a shuffle to gather them again.
    """
    checked = validate_requests(requests, body)
    if predictor.of_value is not None:
        prepared = predictor.prepare(request_fields(checked, [key, "status", "error_msg"]))
        lists = prepared.withColumn("predictions", F.transform(listed_values(), predictor.of_value))
    else:
        # copies of a request are requests of their own: groups never span input rows
        checked = checked.withColumn("_row", F.monotonically_increasing_id())
        carried = [key, "_row", "status", "error_msg"]
        prepared = predictor.prepare(request_fields(checked, carried))
        values = explode_request_values(prepared, [*carried, predictor.carried], outer=True)
        predicted = predictor.predict(values.na.fill("", ["column_value"]))
        lists = gather_predictions(predicted, carried)
    valid = F.col("status") == STATUS_OK
    best = F.when(valid, vote_in_row(F.col("predictions")))
    return lists.withColumn("_best", best).select(
        key,
        "status",
        "error_msg",
        F.col("_best.label").alias("label"),
        class_name(F.col("_best.label"), predictor.names).alias("raw_label"),
        F.col("_best.probability").alias("probability"),
        F.when(valid, F.col("predictions")).alias("predictions"),
    )


def score_columns(
    values: DataFrame,
    meta: DataFrame,
    predictor: Predictor,
    position: str = "position",
    carry: list[str] | None = None,
) -> DataFrame:
    """One vote per column over a whole catalogue of values.

    Columns may hold any number of values: only counts are shuffled after the
    join. Ties go to the prediction met first in the order of ``position``, a
    number (text would turn the hash aggregation into a sort).
    """
    carry = carry or []
    meta = meta.withColumnsRenamed(META_ALIASES)
    prepared = predictor.prepare(meta).select(*KEY, *carry, predictor.carried)
    joined = attach(values, prepared if predictor.of_value is not None else shuffled_if_large(prepared, meta))
    predicted = predictor.predict(joined.na.fill("", ["column_value"]))
    return vote(predicted, [*KEY, *carry], position=position, names=predictor.names)


def to_json(results: DataFrame) -> DataFrame:
    """Results as JSON text, one object per request."""
    return results.select(
        F.to_json(F.struct(*RESULT), {"ignoreNullFields": "true"}).alias("value")
    )
