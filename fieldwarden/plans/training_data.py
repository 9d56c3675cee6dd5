"""From warehouse tables to labelled sample values."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce
from itertools import groupby

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.operators.sampling import (
    TRAINING_ROW,
    decrypt_projection,
    decryptable_rows,
    long_rows,
    on_day,
    sample_rows,
)
from fieldwarden.sources.ledger import DONE, FAILED, count_rows, enter, next_attempt, read_ledger
from fieldwarden.sources.store import write_training_rows

# a broken file surfaces as a Java error while the job runs
FAILURES = (PySparkException, Py4JJavaError)

Columns = Mapping[str, str | None]
Registry = Mapping[str, Columns] | Iterable[tuple[str, Columns]]
Keys = Mapping[str, list[str]]


def iter_registry(columns: DataFrame) -> Iterator[tuple[str, dict[str, str | None]]]:
    """Tables and their columns from the long registry, one table at a time.

    Plans are made per table, so the driver sees the registry once, but never
    holds more of it than a partition.
    """
    rows = columns.orderBy("table_name", "column_name").toLocalIterator()
    for table, group in groupby(rows, key=lambda row: row.table_name):
        yield table, {
            row.column_name: (row.column_sensitive_type or "") if row.column_is_sensitive == "1" else None
            for row in group
        }


def sampled_table(
    df: DataFrame,
    table: str,
    columns: Columns,
    keys: list[str],
    size: int,
    day: str | None = None,
    cipher_key: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """Training rows of one table.

    The day filter comes first, then rows whose sensitive columns are all
    present, then the sample; only the sampled rows are decrypted into the
    output and taken apart into cells.
    """
    sensitive = [c for c, t in columns.items() if t is not None]
    insensitive = [c for c, t in columns.items() if t is None]
    eligible = decryptable_rows(on_day(df, day), sensitive, cipher_key)
    sample = sample_rows(eligible, size, keys, seed)
    clear = decrypt_projection(sample, insensitive, sensitive, cipher_key)
    return long_rows(clear, table, columns)


def table_plans(
    open_table: Callable[[str], DataFrame], registry: Registry, keys: Keys, **options
) -> Iterator[tuple[str, DataFrame | None]]:
    """A plan per registered table with columns, or None where it cannot be read.

    Tables without known keys are sampled by the hash of their whole rows.
    """
    pairs = registry.items() if isinstance(registry, Mapping) else registry
    for table, columns in pairs:
        if not columns:
            continue
        try:
            df = open_table(table)
            yield table, sampled_table(df, table, columns, keys.get(table, df.columns), **options)
        except AnalysisException:
            yield table, None


def training_rows(
    open_table: Callable[[str], DataFrame], registry: Registry, keys: Keys, **options
) -> DataFrame:
    """Training rows of all readable tables in one plan; an empty table if there is none."""
    frames = [df for _, df in table_plans(open_table, registry, keys, **options) if df is not None]
    if not frames:
        return SparkSession.active().createDataFrame([], TRAINING_ROW)
    return reduce(DataFrame.unionByName, frames)


def first_line(error: Exception) -> str:
    """What a failure says: the message of its innermost Java cause, or its own, in one line."""
    text = str(error.java_exception) if isinstance(error, Py4JJavaError) else str(error)
    causes = re.findall(r"^Caused by: (.*)$", str(error), re.MULTILINE)
    return (causes[-1] if causes else text).strip().split("\n")[0][:500]


def pending_tables(spark: SparkSession, registry: Registry | DataFrame, ledger: str) -> Registry:
    """The registry without the tables that the ledger calls done."""
    done = read_ledger(spark, ledger).filter(F.col("state") == DONE).select("table_name")
    if isinstance(registry, DataFrame):
        return iter_registry(registry.join(done, "table_name", "left_anti"))
    pairs = registry.items() if isinstance(registry, Mapping) else registry
    names = {r.table_name for r in done.collect()}  # no more than the mapping holds, which is here already
    return ((table, columns) for table, columns in pairs if table not in names)


def write_all(
    open_table: Callable[[str], DataFrame],
    registry: Registry | DataFrame,
    keys: Keys,
    path: str,
    tables_per_job: int = 50,
    ledger: str | None = None,
    **options,
) -> list[str]:
    """Write the training rows of a whole catalogue; returns the tables left out.

    Tables are written some dozens at a time, so plans stay small however many
    tables there are. After each job the ledger (``<path>_ledger`` unless named)
    gets one row per table: its state, its number of rows or its error. A run
    that was stopped goes on where it was: tables that are done are not read
    again, failed ones are, and a job that was written but not entered is
    written anew in the same place.

    A table that cannot be read, also one that breaks only while it is read, is
    left out as a whole: if a job fails, its tables are written one by one.
    """
    spark = SparkSession.active()
    ledger = ledger or f"{path.rstrip('/')}_ledger"
    attempt = next_attempt(spark, ledger)
    skipped: list[str] = []
    pending: list[tuple[str, DataFrame]] = []

    def write(tables: list[tuple[str, DataFrame]]) -> None:
        write_training_rows(reduce(DataFrame.unionByName, [df for _, df in tables]), path)
        counts = count_rows(spark, path, [table for table, _ in tables])
        rows = [(table, DONE, counts.get(table.lower(), 0), None, attempt) for table, _ in tables]
        enter(spark, ledger, rows)

    def leave_out(table: str, error: Exception) -> None:
        skipped.append(table)
        enter(spark, ledger, [(table, FAILED, None, first_line(error), attempt)])

    def flush() -> None:
        try:
            if pending:
                write(pending)
        except FAILURES:
            for table, df in pending:
                try:
                    write([(table, df)])
                except FAILURES as error:
                    leave_out(table, error)
        pending.clear()

    for table, columns in pending_tables(spark, registry, ledger):
        if not columns:
            continue
        try:
            df = open_table(table)
            plan = sampled_table(df, table, columns, keys.get(table, df.columns), **options)
        except FAILURES as error:
            leave_out(table, error)
            continue
        pending.append((table, plan))
        if len(pending) == tables_per_job:
            flush()
    flush()
    return skipped
