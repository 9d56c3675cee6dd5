"""Scoring requests: JSON objects with column metadata and sample values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.vocab import REQUEST_FIELDS, STATUS_BAD_REQUEST, STATUS_OK

REQUIRED = [*REQUEST_FIELDS, "column_value"]

BODY = T.StructType(
    [T.StructField(f, T.StringType()) for f in REQUEST_FIELDS]
    + [T.StructField("column_value", T.ArrayType(T.StringType()))]
)


def shown(value: Column) -> Column:
    """A JSON value as the error message quotes it."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(F.to_json(value)))
        .when(kind == "STRING", F.concat(F.lit("'"), value.cast("string"), F.lit("'")))
        .otherwise(F.to_json(value))
    )


def not_of_type(value: Column, name: str) -> Column:
    return F.concat(shown(value), F.lit(f" is not of type '{name}'"))


def validate_requests(raw: DataFrame, body: str = "body") -> DataFrame:
    """Status and message per request, and the parsed body of the valid ones.

    Types are strict: a number or null in place of a string is an error, while
    further keys are allowed. The first wrong type is reported, else the first
    missing key. Types are looked up once per field; a message is only built
    for the one field at fault.
    """
    field = {f: F.variant_get(F.col("_v"), f"$.{f}", "variant") for f in REQUIRED}
    listed = F.try_variant_get(F.col("_v"), "$.column_value", "array<variant>")
    wrong_items = F.filter(listed, lambda item: F.schema_of_variant(item) != "STRING")
    kinds = [F.schema_of_variant(field[f]) for f in REQUEST_FIELDS]
    kinds.append(F.when(field["column_value"].isNotNull(), F.when(listed.isNull(), "OTHER").otherwise("STRING")))

    parsed = raw.withColumn("_v", F.try_parse_json(F.col(body))).withColumns(
        {"_kinds": F.array(*kinds), "_item": F.get(wrong_items, F.lit(0))}
    )
    names = F.array(*[F.lit(f) for f in REQUIRED])
    wrong = F.array_position(F.transform("_kinds", lambda k: k != "STRING"), True)
    missing = F.array_position(F.transform("_kinds", lambda k: k.isNull()), True)
    located = parsed.withColumns({"_wrong": wrong, "_missing": missing})

    def at_fault(place: str) -> Column:
        return F.element_at(names, F.col(place).cast("int"))

    culprit = F.variant_get(F.col("_v"), F.concat(F.lit("$."), at_fault("_wrong")), "variant")
    problem = (
        F.when(F.col("_v").isNull(), F.lit("malformed JSON"))
        .when(
            ~F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT<")),
            not_of_type(F.col("_v"), "object"),
        )
        .when(F.col("_wrong") == len(REQUIRED), not_of_type(culprit, "array"))
        .when(F.col("_wrong") > 0, not_of_type(culprit, "string"))
        .when(F.col("_item").isNotNull(), not_of_type(F.col("_item"), "string"))
        .when(F.col("_missing") > 0, F.concat(F.lit("'"), at_fault("_missing"), F.lit("' is a required property")))
        .otherwise("")
    )
    request = F.try_variant_get(F.col("_v"), "$", BODY.simpleString())
    checked = located.withColumns({"error_msg": problem, "_request": request})
    valid = F.col("error_msg") == ""
    return checked.select(
        *raw.columns,
        F.when(valid, STATUS_OK).otherwise(STATUS_BAD_REQUEST).alias("status"),
        "error_msg",
        F.when(valid, F.col("_request")).alias("request"),
    )


def request_fields(checked: DataFrame, keep: list[str]) -> DataFrame:
    """Metadata fields and value list of the requests; all null for invalid ones."""
    return checked.select(*keep, "request.*")


def listed_values() -> Column:
    """The values of a request; an empty list holds one empty value, an invalid request none."""
    values = F.col("column_value")
    return F.when(F.size(values) == 0, F.array(F.lit(""))).otherwise(values)


def explode_request_values(requests: DataFrame, keep: list[str], outer: bool = False) -> DataFrame:
    """One row per value of each request; an empty list gives one empty value.

    Invalid requests have no list and drop out, or leave one row without a
    position if ``outer`` is set.
    """
    split = F.posexplode_outer(listed_values()) if outer else F.posexplode(listed_values())
    return requests.select(*keep, split.alias("position", "column_value"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request files with one JSON object per line."""
    return spark.read.text(path).select(F.col("value").alias("body"))
