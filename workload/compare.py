"""Side-by-side check of a Spark result and its DuckDB oracle."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame

from workload.relations import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def duckdb_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    return sorted(names), sorted(rows, key=repr)


TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both sides hold the same rows, else what differs first."""
    names, ours = spark_rows(df)
    oracle_names, theirs = duckdb_rows(con, sql)
    if names != oracle_names:
        return f"columns {names} != {oracle_names}"
    kinds = con.execute(f"DESCRIBE {sql}").fetchall()
    expected = {k[0]: TYPES.get(k[1], k[1]) for k in kinds}
    if expected != dict(df.dtypes):
        return f"types {dict(df.dtypes)} != {expected}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a!r} != {b!r}"
    return None
