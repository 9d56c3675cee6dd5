"""Numeric encodings of metadata fields and labels."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldwarden.functions.text import strip
from fieldwarden.functions.vocab import (
    CLASS_WEIGHT_RATIO,
    CLASSES,
    INSENSITIVE,
    LEGACY_CLASSES,
    LEGACY_SENSITIVE_TYPES,
    LEGACY_UNKNOWN,
    SENSITIVE_TYPES,
)


def strings(values: list[str]) -> Column:
    """Array literal of names that hold no tab; the split folds away."""
    return F.split(F.lit("\t".join(values)), "\t")


def len_ratio(text: Column, size: int) -> Column:
    """Length of the stripped raw text over its cap, at most 1; 0 if absent."""
    length = F.coalesce(F.char_length(strip(text)), F.lit(0))
    return F.least(length / F.lit(float(size)), F.lit(1.0))


def category_index(value: Column, values: list[str], default: str) -> Column:
    """1-based place among the sorted values; anything else is the default."""
    place = F.array_position(strings(values), strip(F.upper(value)))
    return F.coalesce(
        F.nullif(place, F.lit(0)), F.lit(values.index(default) + 1).cast("long")
    ).cast("int")


def one_hot(index: Column, size: int) -> Column:
    """Row ``index`` (1-based) of the identity matrix, which folds to a literal."""
    identity = [[float(i == j) for j in range(size)] for i in range(size)]
    return F.element_at(F.from_json(F.lit(json.dumps(identity)), "array<array<double>>"), index)


def column_type_base(column_type: Column) -> Column:
    """Type name before its arguments: ``decimal(10,2)`` is ``DECIMAL``."""
    return F.element_at(F.split(column_type, r"\("), 1)


def is_sensitive_label(flag: Column) -> Column:
    return F.when(strip(flag) == "1", 1).otherwise(0)


def sensitive_type_class(label: Column, legacy: bool = False) -> Column:
    """Class id of a type label; an empty one is the insensitive class.

    Unknown labels are null, so that they can be routed to a reject table. The
    legacy table has a class for them instead.
    """
    classes = LEGACY_CLASSES if legacy else CLASSES
    known = strings(LEGACY_SENSITIVE_TYPES if legacy else SENSITIVE_TYPES)
    name = F.upper(strip(F.coalesce(label, F.lit(""))))
    unknown = F.lit(LEGACY_UNKNOWN) if legacy else F.lit(None).cast("string")
    named = (
        F.when(name == "", F.lit(INSENSITIVE))
        .when(F.array_contains(known, name), name)
        .otherwise(unknown)
    )
    return (F.array_position(strings(classes), named) - 1).cast("int")


def class_name(class_id: Column, names: list[str] = CLASSES) -> Column:
    return F.get(strings(names), class_id)


def class_weights(
    classes: int, ratio: float = CLASS_WEIGHT_RATIO, given: list[float] | None = None
) -> list[float]:
    """Loss weights that sum to 1: the last class (insensitive) counts once, each other ``ratio`` times."""
    counts = [float(ratio) if c < classes - 1 else 1.0 for c in range(classes)]
    return list(given) if given else [c / sum(counts) for c in counts]


def binary_weights(ratio: float = CLASS_WEIGHT_RATIO) -> list[float]:
    """The same for the sensitivity flag, where 1 is the rare class."""
    return class_weights(2, ratio)[::-1]


def class_weight(class_id: Column, weights: list[float]) -> Column:
    return F.get(F.array(*[F.lit(float(w)) for w in weights]), class_id)


def percent_label(part: Column, whole: Column) -> Column:
    """``12.34%`` for shares above one per cent, else an empty label.

    Integer arithmetic, exact ties to even, so every engine prints the same.
    """
    scaled = part * F.lit(10000)
    rest = scaled % whole
    floor = F.round((scaled - rest) / whole).cast("long")
    up = (rest * 2 > whole) | ((rest * 2 == whole) & (floor % 2 == 1))
    cents = F.when(up, floor + 1).otherwise(floor)
    text = F.format_string("%d.%02d%%", F.floor(cents / 100), cents % 100)
    return F.when(part * 100 > whole, text).otherwise("")
