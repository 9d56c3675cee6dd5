"""Exploratory profile of the labelled catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.vocab import OTHER
from fieldwarden.operators import profile
from workload import sql
from workload.registry import Tables, query


@query(
    "catalogue_totals",
    """SELECT *, round(n_sensitive * 100 / n_columns, 2) AS sensitive_share, round(n_typed * 100 / n_columns, 2) AS typed_share
    FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT stage_table_name FROM @f_meta@)) AS n_tables,
      (SELECT count(*) FROM (SELECT DISTINCT stage_table_name, stage_column_name FROM @f_meta@)) AS n_columns,
      (SELECT count(*) FROM @f_meta@ WHERE column_is_sensitive = '1') AS n_sensitive,
      (SELECT count(*) FROM @f_meta@ WHERE column_is_sensitive = '1' AND column_sensitive_type IS NOT NULL) AS n_typed)""",
)
def catalogue_totals(t: Tables):
    return profile.catalogue_totals(t.f_meta)


def shares(counts: str) -> str:
    return f"""SELECT category, n, round(n * 100 / total, 6) AS percentage, {sql.percent_label('n', 'total')} AS label,
      round(total - upto + n / 2, 6) AS label_pos
    FROM (SELECT category, n, CAST(sum(n) OVER () AS BIGINT) AS total,
        CAST(sum(n) OVER (ORDER BY category NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM ({counts}))"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


TYPED = "column_is_sensitive = '1' AND column_sensitive_type IS NOT NULL"
SHARED = {
    "column_sensitive_type": TYPED,
    "database_port": "database_port IS NOT NULL",
    "database_name": "true",
    "database_type": "true",
    "table_theme": "true",
}


@query(
    "category_share",
    " UNION ALL ".join(
        "SELECT *, '{0}' AS field FROM ({1})".format(
            f, shares(f"SELECT {f} AS category, count(*) AS n FROM @f_meta@ WHERE {test} GROUP BY {f}")
        )
        for f, test in SHARED.items()
    ),
)
def category_share(t: Tables):
    categories = {f: F.col(f) for f in SHARED}
    categories["column_sensitive_type"] = F.when(F.col("column_is_sensitive") == "1", F.col("column_sensitive_type"))
    kept = [f for f, test in SHARED.items() if test == "true"]
    return rounded(profile.category_shares(t.f_meta, categories, kept), "percentage", "label_pos")


BY = {
    "database_port": "database_port",
    "database_type": "database_type",
    "database_is_shard": "database_is_shard",
    "table_theme": "table_theme",
    "column_comment_long": "CASE WHEN length(column_comment) >= 30 THEN 'true' WHEN length(column_comment) < 30 THEN 'false' END",
    "column_is_primary_key": "column_is_primary_key",
    "column_allow_null": "column_allow_null",
}


def within(counts: str) -> str:
    return f"""SELECT category, is_sensitive, n, round(n * 100 / total, 6) AS percentage, {sql.percent_label('n', 'total')} AS label
    FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY category) AS BIGINT) AS total FROM ({counts}))"""


@query(
    "sensitivity_by_category",
    " UNION ALL ".join(
        "SELECT *, '{0}' AS field FROM ({1})".format(
            name,
            within(
                f"""SELECT {e} AS category, column_is_sensitive AS is_sensitive, count(*) AS n FROM @f_meta@
                WHERE ({e}) IS NOT NULL AND column_is_sensitive IS NOT NULL GROUP BY ALL"""
            ),
        )
        for name, e in BY.items()
    ),
)
def sensitivity_by_category(t: Tables):
    def category(name: str) -> Column:
        if name == "column_comment_long":
            return profile.is_long("column_comment", 30).cast("string")
        return F.col(name)

    return rounded(profile.sensitivities_by(t.f_meta, {name: category(name) for name in BY}), "percentage")


BASE = "trim(upper(regexp_replace(column_type, '\\(.+\\)', '')))"
LUMPED = f"""SELECT base, n, CASE WHEN n / sum(n) OVER () <= 0.01e0 THEN '{OTHER}' ELSE base END AS category
  FROM (SELECT {BASE} AS base, count(*) AS n FROM @f_meta@ GROUP BY 1)"""


@query(
    "rare_type_share",
    shares(f"SELECT category, CAST(sum(n) AS BIGINT) AS n FROM ({LUMPED}) GROUP BY category"),
)
def rare_type_share(t: Tables):
    return rounded(profile.rare_type_share(t.f_meta), "percentage", "label_pos")


@query(
    "rare_type_sensitivity",
    within(
        f"""SELECT category, column_is_sensitive AS is_sensitive, count(*) AS n
        FROM @f_meta@ m JOIN ({LUMPED}) l ON {BASE} = l.base WHERE column_is_sensitive IS NOT NULL GROUP BY ALL"""
    ),
)
def rare_type_sensitivity(t: Tables):
    return rounded(profile.rare_type_sensitivity(t.f_meta), "percentage")


LENGTHS = {
    "database_name": None,
    "database_comment": None,
    "table_name": None,
    "table_comment": None,
    "column_name": 31,
    "column_comment": 30,
}


def histogram_sql(source: str, fields: dict[str, int | None]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{f}' AS field, column_is_sensitive AS is_sensitive, CAST(length({f}) AS INT) AS length, count(*) AS n
        FROM {source} WHERE column_is_sensitive IS NOT NULL AND {f} IS NOT NULL
        {'' if cap is None else f'AND length({f}) < {cap}'} GROUP BY ALL"""
        for f, cap in fields.items()
    )


HISTOGRAM = histogram_sql("@f_meta@", LENGTHS) + " UNION ALL " + histogram_sql("@f_values@", {"column_value": 50})


def histogram(t: Tables) -> DataFrame:
    of_meta = profile.length_histogram(t.f_meta, LENGTHS)
    return of_meta.unionByName(profile.length_histogram(t.f_values, {"column_value": 50}))


@query("length_histogram", HISTOGRAM)
def length_histogram(t: Tables):
    return histogram(t)


@query(
    "length_density",
    f"""WITH h AS ({HISTOGRAM}),
    q AS (SELECT field, is_sensitive, quantile_cont(length, 0.75) - quantile_cont(length, 0.25) AS iqr,
        stddev_samp(length) AS sd, count(*) AS total, min(length) AS lo, max(length) AS hi
      FROM (SELECT field, is_sensitive, length, unnest(range(n)) FROM h) GROUP BY field, is_sensitive),
    b AS (SELECT *, 0.9e0 * CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34e0) ELSE sd END * pow(total, -0.2e0) AS bw
      FROM q WHERE total > 1 AND hi > lo),
    g AS (SELECT *, lo - 3 * bw AS first, (hi - lo + 6 * bw) / 63 AS step FROM b)
    SELECT field, is_sensitive, CAST(p.point AS INT) AS point, round(first + step * p.point, 4) AS length,
      round(sum(n * exp(-0.5e0 * pow((first + step * p.point - h.length) / bw, 2)) / total) / (max(bw) * sqrt(2 * pi())), 6) AS density
    FROM g JOIN h USING (field, is_sensitive), (SELECT unnest(range(64)) AS point) p
    GROUP BY field, is_sensitive, p.point, first, step""",
)
def length_density(t: Tables):
    return profile.length_density(histogram(t)).select(
        "field",
        "is_sensitive",
        "point",
        F.round("length", 4).alias("length"),
        F.round("density", 6).alias("density"),
    )
