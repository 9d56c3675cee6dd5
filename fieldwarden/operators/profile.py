"""Exploratory profile of the labelled catalogue: counts, shares, lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwarden.functions.encoders import percent_label
from fieldwarden.functions.text import strip
from fieldwarden.functions.vocab import KEY, OTHER


def catalogue_totals(meta: DataFrame, approximate: bool = False) -> DataFrame:
    """Tables, columns, sensitive columns (with a type) and their shares, in one row."""
    sensitive = F.col("column_is_sensitive") == "1"
    if approximate:
        tables = F.approx_count_distinct("stage_table_name")
        columns = F.approx_count_distinct(F.struct(*KEY))
    else:
        tables = F.count_distinct(F.struct("stage_table_name"))
        columns = F.count_distinct(F.struct(*KEY))
    counts = meta.agg(
        tables.alias("n_tables"),
        columns.alias("n_columns"),
        F.count_if(sensitive).alias("n_sensitive"),
        F.count_if(sensitive & F.col("column_sensitive_type").isNotNull()).alias("n_typed"),
    )
    return counts.select(
        "*",
        percent_label_always("n_sensitive", "n_columns").alias("sensitive_share"),
        percent_label_always("n_typed", "n_columns").alias("typed_share"),
    )


def percent_label_always(part: str, whole: str) -> Column:
    """Share in per cent with two digits."""
    return F.when(F.col(whole) == 0, 0.0).otherwise(
        F.round(F.col(part) * 100 / F.col(whole), 2)
    )


def category_share(df: DataFrame, category: str, keep_null: bool = False) -> DataFrame:
    """Rows per category, share of all, label, and its place along a stacked bar.

    Missing values form a category of their own if kept, placed last.
    """
    rows = df if keep_null else df.filter(F.col(category).isNotNull())
    counts = rows.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return with_shares(counts)


def category_shares(
    df: DataFrame, categories: dict[str, Column], keep_null: list[str] | None = None
) -> DataFrame:
    """``category_share`` of several fields from one scan and one count.

    Fields named in ``keep_null`` count their missing values as a category.
    """
    named = df.select(*[c.cast("string").alias(f) for f, c in categories.items()])
    rows = named.unpivot([], list(categories), "field", "category")
    kept = rows.filter(F.col("category").isNotNull() | F.col("field").isin(keep_null or []))
    return with_shares(kept.groupBy("field", "category").agg(F.count(F.lit(1)).alias("n")), ["field"])


def with_shares(counts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Shares of (category, n) rows within their group, of which there is one per category.

    The running total needs an order over the categories of a group; it sees
    one row for each category, whatever the number of rows behind it.
    """
    group = group or []
    within = Window.partitionBy(*group)
    total = F.sum("n").over(within)
    upto = F.sum("n").over(
        within.orderBy(F.col("category").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    )
    shared = counts.withColumns({"_total": total, "_upto": upto})
    return shared.select(
        *group,
        "category",
        "n",
        (F.col("n") * 100 / F.col("_total")).alias("percentage"),
        percent_label(F.col("n"), F.col("_total")).alias("label"),
        (F.col("_total") - F.col("_upto") + F.col("n") / 2).alias("label_pos"),
    )


def sensitivity_by(df: DataFrame, category: Column, flag: str = "column_is_sensitive") -> DataFrame:
    """Rows per category and flag, with the share inside the category."""
    counts = (
        df.select(category.alias("category"), F.col(flag).alias("is_sensitive"))
        .filter(F.col("category").isNotNull() & F.col("is_sensitive").isNotNull())
        .groupBy("category", "is_sensitive")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    within = F.sum("n").over(Window.partitionBy("category"))
    return counts.withColumn("_total", within).select(
        "category",
        "is_sensitive",
        "n",
        (F.col("n") * 100 / F.col("_total")).alias("percentage"),
        percent_label(F.col("n"), F.col("_total")).alias("label"),
    )


def sensitivities_by(
    df: DataFrame, categories: dict[str, Column], flag: str = "column_is_sensitive"
) -> DataFrame:
    """``sensitivity_by`` for several fields from one scan and one count."""
    named = df.filter(F.col(flag).isNotNull()).select(
        F.col(flag).alias("is_sensitive"), *[c.cast("string").alias(f) for f, c in categories.items()]
    )
    counts = (
        named.unpivot(["is_sensitive"], list(categories), "field", "category")
        .filter(F.col("category").isNotNull())
        .groupBy("field", "category", "is_sensitive")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    within = F.sum("n").over(Window.partitionBy("field", "category"))
    return counts.withColumn("_total", within).select(
        "field",
        "category",
        "is_sensitive",
        "n",
        (F.col("n") * 100 / F.col("_total")).alias("percentage"),
        percent_label(F.col("n"), F.col("_total")).alias("label"),
    )


def is_long(text: str, size: int) -> Column:
    return F.char_length(text) >= size


def base_type(column_type: Column) -> Column:
    """Type name without its arguments, as profiled (``strip`` comes last)."""
    return strip(F.upper(F.regexp_replace(column_type, r"\(.+\)", "")))


def lumped_types(meta: DataFrame, share: float = 0.01) -> DataFrame:
    """Every base type and the category it counts as: rare ones count as one."""
    counts = meta.groupBy(base_type(F.col("column_type")).alias("base")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("_total", total).select(
        "base",
        F.when(F.col("n") / F.col("_total") <= share, F.lit(OTHER))
        .otherwise(F.col("base"))
        .alias("category"),
        "n",
    )


def rare_type_share(meta: DataFrame, share: float = 0.01) -> DataFrame:
    """Shares of the column types, rare ones lumped."""
    lumped = lumped_types(meta, share)
    return with_shares(lumped.groupBy("category").agg(F.sum("n").alias("n")))


def rare_type_sensitivity(meta: DataFrame, share: float = 0.01) -> DataFrame:
    """Sensitivity per column type, rare ones lumped."""
    mapping = lumped_types(meta, share).select("base", "category")
    # counts first, so that the lookup joins one row per type and flag
    counts = (
        meta.filter(F.col("column_is_sensitive").isNotNull())
        .groupBy(base_type(F.col("column_type")).alias("_type"), F.col("column_is_sensitive").alias("is_sensitive"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    mapped = (
        counts.join(mapping, F.col("_type") == F.col("base"))
        .groupBy("category", "is_sensitive")
        .agg(F.sum("_n").alias("n"))
    )
    within = F.sum("n").over(Window.partitionBy("category"))
    return mapped.withColumn("_total", within).select(
        "category",
        "is_sensitive",
        "n",
        (F.col("n") * 100 / F.col("_total")).alias("percentage"),
        percent_label(F.col("n"), F.col("_total")).alias("label"),
    )


def length_histogram(
    df: DataFrame,
    fields: dict[str, int | None],
    flag: str = "column_is_sensitive",
) -> DataFrame:
    """Rows per field, flag and text length; a cap keeps lengths below it only."""
    caps = {f: c for f, c in fields.items() if c is not None}
    lengths = (
        df.filter(F.col(flag).isNotNull())
        .select(F.col(flag).alias("is_sensitive"), *[F.char_length(f).alias(f) for f in fields])
        .unpivot(["is_sensitive"], list(fields), "field", "length")
        .filter(F.col("length").isNotNull())
    )
    for field, cap in caps.items():
        lengths = lengths.filter((F.col("field") != field) | (F.col("length") < cap))
    return lengths.groupBy("field", "is_sensitive", "length").agg(F.count(F.lit(1)).alias("n"))


def length_density(histogram: DataFrame, points: int = 64) -> DataFrame:
    """Gaussian density of the lengths per field and flag on an even grid.

    Bandwidth after Silverman: 0.9 * min(sd, IQR / 1.34) * n^(-1/5); the grid
    reaches three bandwidths beyond the data. It reads the histogram, whose
    size is the number of distinct lengths, not the number of rows.
    """
    group = ["field", "is_sensitive"]
    stats = histogram.groupBy(*group).agg(
        F.sum("n").alias("_total"),
        F.sum(F.col("n") * F.col("length")).alias("_sum"),
        F.sum(F.col("n") * F.col("length") * F.col("length")).alias("_squares"),
        F.min("length").alias("_min"),
        F.max("length").alias("_max"),
        (
            F.percentile("length", 0.75, F.col("n")) - F.percentile("length", 0.25, F.col("n"))
        ).alias("_iqr"),
    )
    total = F.col("_total")
    variance = (F.col("_squares") - F.col("_sum") * F.col("_sum") / total) / (total - 1)
    spread = F.when(F.col("_iqr") > 0, F.least(F.sqrt(variance), F.col("_iqr") / 1.34)).otherwise(
        F.sqrt(variance)
    )
    stats = (
        stats.filter((total > 1) & (F.col("_max") > F.col("_min")))
        .withColumn("_bw", spread * 0.9 * F.pow(total.cast("double"), F.lit(-0.2)))
        .withColumn("_from", F.col("_min") - F.col("_bw") * 3)
        .withColumn("_step", (F.col("_max") - F.col("_min") + F.col("_bw") * 6) / (points - 1))
    )
    grid = histogram.join(stats, group).withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    at = F.col("_from") + F.col("_step") * F.col("point")
    z = (at - F.col("length")) / F.col("_bw")
    kernel = F.exp(z * z * -0.5) / (F.col("_bw") * (2 * 3.141592653589793) ** 0.5)
    return grid.groupBy(*group, "point", at.alias("length")).agg(
        (F.sum(F.col("n") * kernel / total)).alias("density")
    )
