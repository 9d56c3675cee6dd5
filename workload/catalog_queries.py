"""Catalogue, sources, sampling and joins."""

from __future__ import annotations

import secrets
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.crypto import decrypt, encrypt, protect_by_class
from fieldwarden.functions.vocab import KEY, META_FIELDS, VALUE_FIELDS
from fieldwarden.operators import catalog, sampling
from fieldwarden.operators.joining import value_with_meta
from fieldwarden.plans.training_data import training_rows, write_all
from fieldwarden.session import shared_dir
from fieldwarden.sources import delimited, logs
from fieldwarden.sources.extracts import extract_long
from fieldwarden.sources.ledger import read_ledger
from workload import sql
from workload.registry import Tables, query

EXCLUDED = r"._bak_|._bak[0-9]|._bak$|._bk$|._bk[0-9]|.[0-9]{8}|^temp_|^tmp_|^s__|_test$"
STAGE_TABLES = f"""
  SELECT table_name FROM @f_tables@
  WHERE database_name = 'stage' AND table_status = '1' AND table_name IS NOT NULL
    AND NOT regexp_matches(lower(table_name), '{EXCLUDED}')
"""
DT_TABLES = """
  SELECT DISTINCT table_name FROM @f_columns@
  WHERE column_name = 'dt' AND database_name = 'stage' AND column_status = '1'
"""


@query("stage_table_filter", STAGE_TABLES + " ORDER BY table_name")
def stage_table_filter(t: Tables):
    return catalog.stage_tables(t.f_tables)


@query("tables_with_dt", DT_TABLES + " ORDER BY table_name")
def tables_with_dt(t: Tables):
    return catalog.tables_with_dt(t.f_columns)


@query(
    "labelled_columns",
    """SELECT stage_table_name AS table_name, stage_column_name AS column_name, column_is_sensitive
    FROM @f_labelled@ WHERE regexp_full_match(stage_table_name, '[0-9a-zA-Z_]+')
    ORDER BY table_name, column_name""",
)
def labelled_columns(t: Tables):
    return catalog.labelled_columns(t.f_labelled)


REGISTRY = f"""
  SELECT DISTINCT upper(s.table_name) AS table_name, d.table_name IS NOT NULL AS dt
  FROM ({STAGE_TABLES}) s LEFT JOIN ({DT_TABLES}) d ON upper(s.table_name) = upper(d.table_name)
"""


def registry(t: Tables):
    return catalog.table_registry(catalog.stage_tables(t.f_tables), catalog.tables_with_dt(t.f_columns))


@query("stage_table_registry", REGISTRY)
def stage_table_registry(t: Tables):
    return registry(t)


REGISTERED_COLUMNS = f"""
  SELECT upper(c.stage_table_name) AS table_name, upper(c.stage_column_name) AS column_name,
    c.column_is_sensitive,
    CASE WHEN c.column_is_sensitive = '1' THEN upper(c.column_sensitive_type) END AS column_sensitive_type
  FROM @f_labelled@ c
  WHERE c.column_is_sensitive IN ('0', '1')
    AND upper(c.stage_table_name) IN (SELECT table_name FROM ({REGISTRY}))
"""


def registered_columns(t: Tables):
    columns = t.f_labelled.withColumnsRenamed(
        {"stage_table_name": "table_name", "stage_column_name": "column_name"}
    )
    return catalog.column_registry(registry(t), columns)


@query("table_column_registry", REGISTERED_COLUMNS)
def table_column_registry(t: Tables):
    return registered_columns(t)


@query(
    "table_column_totals",
    f"""SELECT r.table_name, r.dt,
      count(*) FILTER (WHERE c.column_is_sensitive = '0') AS n_insensitive,
      count(*) FILTER (WHERE c.column_is_sensitive = '1') AS n_sensitive
    FROM ({REGISTRY}) r LEFT JOIN ({REGISTERED_COLUMNS}) c ON r.table_name = c.table_name
    GROUP BY r.table_name, r.dt""",
)
def table_column_totals(t: Tables):
    return catalog.registry_totals(registry(t), registered_columns(t))


def nulled(fields: list[str]) -> str:
    tokens = sql.in_list(delimited.NA_TOKENS)
    return ", ".join(f"CASE WHEN {f} IN {tokens} THEN NULL ELSE {f} END AS {f}" for f in fields)


def written(t: Tables, rows, fields: list[str], purpose: str) -> str:
    path = shared_dir(t.spark, purpose)
    delimited.write_tsv(rows.select(*fields), path)
    return path


@query("read_meta_tsv", f"SELECT {nulled(META_FIELDS)} FROM @f_meta@")
def read_meta_tsv(t: Tables):
    return delimited.read_meta(t.spark, written(t, t.f_meta, META_FIELDS, "meta-tsv"))


@query(
    "read_typed_meta_tsv",
    f"""SELECT stage_table_name, stage_column_name,
      coalesce(TRY_CAST(database_port AS INT), -1) AS database_port,
      coalesce(TRY_CAST(column_is_primary_key AS INT), -1) AS column_is_primary_key,
      coalesce(TRY_CAST(column_allow_null AS INT), -1) AS column_allow_null,
      coalesce(TRY_CAST(column_is_sensitive AS INT), -1) AS column_is_sensitive
    FROM (SELECT {nulled(META_FIELDS)} FROM @f_meta@)""",
)
def read_typed_meta_tsv(t: Tables):
    meta = delimited.read_typed_meta(t.spark, written(t, t.f_meta, META_FIELDS, "typed-tsv"))
    return meta.select(
        *KEY,
        *[
            F.coalesce(c, F.lit(-1)).alias(c)
            for c in ["database_port", "column_is_primary_key", "column_allow_null", "column_is_sensitive"]
        ],
    )


@query("read_value_tsv", f"SELECT {nulled(VALUE_FIELDS[:3])} FROM @f_values@")
def read_value_tsv(t: Tables):
    return delimited.read_values(t.spark, written(t, t.f_values, VALUE_FIELDS, "value-tsv"))


@query(
    "extract_audit",
    "SELECT file, count(*) AS n_failed FROM @f_runlog@ WHERE line LIKE '%FAILED%' GROUP BY file",
)
def extract_audit(t: Tables):
    return logs.failed_runs(t.f_runlog)


@query(
    "extract_summary",
    """SELECT count(*) AS n_runs, CAST(sum(failed) AS BIGINT) AS n_failed_runs FROM
    (SELECT file, max(CASE WHEN line LIKE '%FAILED%' THEN 1 ELSE 0 END) AS failed
     FROM @f_runlog@ GROUP BY file)""",
)
def extract_summary(t: Tables):
    return logs.run_summary(t.f_runlog)


# labels of the wide tables: wiring only, not a claim about these columns
WIDE = {
    "customer": {"c_custkey": None, "c_name": "姓名", "c_nationkey": None, "c_acctbal": "卡号", "c_mktsegment": None},
    "supplier": {"s_suppkey": None, "s_name": "姓名", "s_nationkey": None, "s_acctbal": None},
    "part": {"p_partkey": None, "p_name": None, "p_brand": None, "p_retailprice": None},
    "nation": {"n_name": "地址", "n_regionkey": None},
}
WIDE_KEYS = {"customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "nation": ["n_nationkey"]}


def cells(source: str, table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS stage_table_name, '{c}' AS stage_column_name, CAST({c} AS VARCHAR) AS column_value, "
        f"'{0 if kind is None else 1}' AS column_is_sensitive, '{kind or 0}' AS column_sensitive_type FROM {source}"
        for c, kind in WIDE[table].items()
    )


@query("unpivot_training_rows", " UNION ALL ".join(cells(t, t) for t in WIDE))
def unpivot_training_rows(t: Tables):
    frames = [sampling.long_rows(getattr(t, name), name, columns) for name, columns in WIDE.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def sampled(table: str, size: int, seed: int) -> str:
    key = WIDE_KEYS[table][0]
    return f"(SELECT * FROM {table} ORDER BY {sql.hashed(seed, key)}, {key} LIMIT {size})"


@query("training_rows", " UNION ALL ".join(cells(sampled(t, 100, 7), t) for t in WIDE))
def sampled_training_rows(t: Tables):
    return training_rows(lambda name: getattr(t, name), WIDE, WIDE_KEYS, size=100, day="2018-07-01", seed=7)


def written_rows(t: Tables) -> str:
    """The rows of all tables, written by two runs; a table that breaks while it is read is left out."""
    path, broken = shared_dir(t.spark, "training-rows"), shared_dir(t.spark, "broken")
    t.region.write.parquet(broken)

    def open_table(name: str) -> DataFrame:
        if name == "region":
            rows = t.spark.read.parquet(broken)
            return rows.withColumn("r_name", F.raise_error(F.concat(F.lit("broken: "), "r_name")).cast("string"))
        return getattr(t, name)

    registry = {"region": {"r_name": None}, **WIDE}
    for _ in range(2):
        write_all(open_table, registry, WIDE_KEYS, path, size=100, seed=7)
    return path


SAMPLED = " UNION ALL ".join(cells(sampled(t, 100, 7), t) for t in WIDE)


@query("write_training_rows", SAMPLED)
def write_training_rows(t: Tables):
    return t.spark.read.parquet(written_rows(t)).select(
        "stage_table_name", "stage_column_name", "column_value", "column_is_sensitive", "column_sensitive_type"
    )


@query(
    "extraction_ledger",
    f"""SELECT stage_table_name AS table_name, 'done' AS state, count(*) AS n_rows, CAST(1 AS INT) AS attempt
      FROM ({SAMPLED}) GROUP BY 1 UNION ALL SELECT 'region', 'failed', NULL, 2""",
)
def extraction_ledger(t: Tables):
    ledger = read_ledger(t.spark, f"{written_rows(t)}_ledger")
    return ledger.select("table_name", "state", "n_rows", "attempt")


@query("extract_long", cells("customer", "customer") + " UNION ALL " + cells("supplier", "supplier"))
def extract_files_long(t: Tables):
    directory = shared_dir(t.spark, "extracts")
    for name in ["customer", "supplier", "part"]:
        delimited.write_tsv(getattr(t, name), f"{directory}/{name}.tsv")
    known = {name.upper(): WIDE[name] for name in ["customer", "supplier", "nation"]}
    return extract_long(t.spark, directory, known)


DATED = "SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y') AS dt FROM orders"


def dated(t: Tables):
    year = F.date_format("o_orderdate", "yyyy").alias("dt")
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", year)


def partitioned(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders in one folder per year, and the days that are to be read per table."""
    path, listed = shared_dir(t.spark, "partitioned"), shared_dir(t.spark, "days")
    by_year = dated(t).withColumn("dt", F.concat(F.lit("y"), "dt"))
    by_year.repartition("dt").write.partitionBy("dt").parquet(path)
    days = by_year.select(F.lit("ORDERS").alias("table_name"), F.col("dt").alias("day")).distinct()
    others = days.withColumn("table_name", F.lit("other"))
    days.filter("day IN ('y1995', 'y1998')").unionByName(others).write.parquet(listed)
    return t.spark.read.parquet(path), t.spark.read.parquet(listed)


def partition_sample(orders: DataFrame, days: DataFrame) -> DataFrame:
    return sampling.sample_rows(sampling.on_listed_days(orders, "orders", days), 100, ["o_orderkey"], 11)


@query(
    "sample_partition",
    f"""SELECT o_orderkey, o_custkey, o_totalprice, 'y' || dt AS dt FROM ({DATED}) WHERE dt IN ('1995', '1998')
    ORDER BY {sql.hashed(11, 'o_orderkey')}, o_orderkey LIMIT 100""",
)
def sample_partition(t: Tables):
    return partition_sample(*partitioned(t))


@query(
    "sample_rows",
    f"""SELECT * FROM ({DATED}) WHERE dt = '1998'
    ORDER BY {sql.hashed(11, 'o_orderkey')}, o_orderkey LIMIT 100""",
)
def sample_rows(t: Tables):
    return sampling.sample_rows(sampling.on_day(dated(t), "1998"), 100, ["o_orderkey"], 11)


@query(
    "sample_many_rows",
    f"SELECT * FROM ({DATED}) ORDER BY {sql.hashed(11, 'o_orderkey')}, o_orderkey LIMIT 5000",
)
def sample_many_rows(t: Tables):
    return sampling.sample_rows(dated(t), 5000, ["o_orderkey"], 11)


@lru_cache
def run_key() -> str:
    return secrets.token_hex(8)


# two sensitive columns: absent, the text NULL, or a value; every fifth cipher is broken
SECRETS = """
  SELECT c_custkey, c_mktsegment,
    CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'null' ELSE c_name END AS holder,
    CASE c_custkey % 6 WHEN 0 THEN 'NULL' ELSE '62' || CAST(c_custkey AS STRING) END AS card,
    c_custkey % 5 = 0 AS broken
  FROM {customer}
"""


def encrypted(t: Tables):
    plain = t.spark.sql(SECRETS, customer=t.customer)
    key = run_key()
    return plain.select(
        "c_custkey",
        "c_mktsegment",
        *[
            F.when(F.col("broken"), F.lit("no cipher text")).otherwise(encrypt(F.col(c), key)).alias(c)
            for c in ["holder", "card"]
        ],
    )


CLEAR = SECRETS.replace("{customer}", "customer")


@query(
    "decrypt_projection",
    f"""SELECT c_custkey, c_mktsegment, CASE WHEN NOT broken THEN holder END AS holder,
    CASE WHEN NOT broken THEN card END AS card FROM ({CLEAR})""",
)
def decrypt_projection(t: Tables):
    return sampling.decrypt_projection(
        encrypted(t), ["c_custkey", "c_mktsegment"], ["holder", "card"], run_key()
    )


@query(
    "decryptable_rows",
    f"""SELECT c_custkey, holder, card FROM ({CLEAR}) WHERE NOT broken AND holder IS NOT NULL
    AND upper(holder) <> 'NULL' AND upper(card) <> 'NULL'""",
)
def decryptable_rows(t: Tables):
    kept = sampling.decryptable_rows(encrypted(t), ["holder", "card"], run_key())
    return kept.select("c_custkey", *[decrypt(F.col(c), run_key()).alias(c) for c in ["holder", "card"]])


MASKED = "regexp_replace(regexp_replace(regexp_replace(column_value, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')"


# a key of the workload, so that the oracle can know it
SHARED_KEY = "the key of this workload only"


def hmac_sql(value: str) -> str:
    block = SHARED_KEY.encode().ljust(64, b"\0")
    inner, outer = ("".join(f"\\x{b ^ pad:02X}" for b in block) for pad in (0x36, 0x5C))
    return f"sha256(CAST('{outer}' AS BLOB) || unhex(sha256(CAST('{inner}' AS BLOB) || encode({value}))))"


@query(
    "protect_columns",
    f"""SELECT v.row_id, CASE m.column_sensitive_type WHEN '手机' THEN {MASKED} WHEN '邮箱' THEN {MASKED}
      WHEN '身份证' THEN {hmac_sql('column_value')} WHEN '卡号' THEN {hmac_sql('column_value')} ELSE column_value END AS column_value
    FROM @f_class_values@ v JOIN @f_class_meta@ m USING (stage_table_name, stage_column_name)""",
)
def protect_columns(t: Tables):
    methods = {"手机": "mask", "邮箱": "mask", "身份证": "hmac", "卡号": "hmac"}
    labelled = t.f_class_values.join(t.f_class_meta.select(*KEY, "column_sensitive_type"), KEY)
    value = protect_by_class(F.col("column_value"), F.col("column_sensitive_type"), methods, SHARED_KEY)
    return labelled.select("row_id", value.alias("column_value"))


def key_of(side: str, key: str) -> str:
    return sql.strip(f"upper({side}.{key})")


JOINED = f"""
  (SELECT {key_of('v', 'stage_table_name')} AS stage_table_name,
     {key_of('v', 'stage_column_name')} AS stage_column_name, v.column_value, v.row_id, m.*
     EXCLUDE (stage_table_name, stage_column_name)
   FROM @f_values@ v JOIN @f_meta@ m
     ON {key_of('v', 'stage_table_name')} IS NOT DISTINCT FROM {key_of('m', 'stage_table_name')}
     AND {key_of('v', 'stage_column_name')} IS NOT DISTINCT FROM {key_of('m', 'stage_column_name')})
"""


@query(
    "value_with_meta",
    "SELECT "
    + ", ".join(f"coalesce({f}, '') AS {f}" for f in [*META_FIELDS, "column_value"])
    + f" FROM {JOINED}",
)
def joined_values(t: Tables):
    return value_with_meta(t.f_values, t.f_meta)


@query(
    "sample_values",
    f"""SELECT stage_table_name, stage_column_name, column_value, row_id FROM
    (SELECT *, row_number() OVER (PARTITION BY stage_table_name, stage_column_name
       ORDER BY {sql.hashed(3, 'column_value', 'row_id')}, column_value, row_id) AS r
     FROM @f_values@ WHERE column_value IS NOT NULL) WHERE r <= 5""",
)
def sample_values(t: Tables):
    rows = t.f_values.select(*KEY, "column_value", "row_id")
    return sampling.sample_values(rows, 5, 3, ["row_id"])


@query(
    "sample_distinct_values",
    f"""SELECT stage_table_name, stage_column_name, column_value FROM
    (SELECT *, row_number() OVER (PARTITION BY stage_table_name, stage_column_name
       ORDER BY {sql.hashed(3, 'column_value')}, column_value) AS r
     FROM (SELECT DISTINCT stage_table_name, stage_column_name, column_value FROM @f_values@
           WHERE column_value IS NOT NULL)) WHERE r <= 3""",
)
def sample_distinct_values(t: Tables):
    return sampling.sample_values(t.f_values, 3, 3, distinct=True)
