"""Exact near-duplicate vectors: a metric range join over pivot cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.common import each_batch, prepared, stored
from fieldwarden.llm.components import components

COSINE = 0.93
CELL = 4000  # vectors per cell aimed at
MAX_PIVOTS = 512  # over all labels; beyond, cells grow and are compared in more blocks
BLOCK = 2048  # vectors of one cell that a task compares with as many others
MARGIN = 1e-6  # by which distances may be off


def is_usable() -> Column:
    """An id, a label and a vector that has a direction."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    filled = F.exists(v, lambda x: x != 0)
    named = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    return named & F.coalesce(finite & filled, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow of squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def choose_pivots(distinct: DataFrame, cell: int, most: int) -> dict:
    """Per label and length the vectors with the least hashes; at most ``most`` in all.

    Any choice gives the same result; only the load of the cells depends on it.
    """
    sizes = distinct.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = max(cell, math.ceil(total / most)) if total else cell
    # as many in expectation as cells are wanted, found without sorting by label
    space = 1 << 40
    wanted = distinct.filter(F.pmod(F.xxhash64("rep"), F.lit(space)) < space // share)
    rows = wanted.orderBy(F.xxhash64("rep")).limit(2 * most).select("label", "dim", "embedding").collect()
    pivots: dict = {}
    for r in rows:
        pivots.setdefault((r.label, r.dim), []).append(r.embedding)
    return {k: matrix(pa.array(v)) for k, v in pivots.items()}


def assigned(distinct: DataFrame, pivots: dict, radius: float) -> DataFrame:
    """``label, dim, cell, home, rep, n, embedding``: each vector in its cell and in all it may reach.

    A vector lies at home with its nearest pivot p. If some u at home with q is
    within the radius r of v, then d(v, q) <= d(v, p) + 2 r by the triangle
    inequality; as the space is Euclidean, v is also within r of the plane
    between p and q, and both must hold. A label without pivot is one cell.
    """
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)
    groups = distinct.select("label", "dim", "rep", "n", "embedding")

    def run(batch):
        label = batch.column("label").to_numpy(zero_copy_only=False)
        dim = batch.column("dim").to_numpy(zero_copy_only=False)
        rows, cells, homes = [], [], []
        for key in sorted(set(zip(label.tolist(), dim.tolist(), strict=True))):
            own = np.flatnonzero((label == key[0]) & (dim == key[1]))
            p = shared.value.get(key)
            if p is None:
                rows.append(own)
                cells.append(np.zeros(len(own), np.int64))
                homes.append(np.ones(len(own), bool))
                continue
            v = matrix(batch.column("embedding").take(pa.array(own)))
            square = np.maximum(2 - 2 * v @ p.T, 0)
            d = np.sqrt(square)
            nearest = d.argmin(axis=1)
            at = np.arange(len(own))
            gap = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[nearest]
            plane = (square - square[at, nearest][:, None]) <= 2 * (radius + MARGIN) * gap + MARGIN
            reach = (d <= d[at, nearest][:, None] + 2 * radius + MARGIN) & plane
            reach[at, nearest] = True
            i, j = np.nonzero(reach)
            rows.append(own[i])
            cells.append(j)
            homes.append(j == nearest[i])
        taken = batch.take(pa.array(np.concatenate(rows)))
        columns = [*taken.columns, pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes))]
        return pa.RecordBatch.from_arrays(columns, [*taken.schema.names, "cell", "home"])

    kinds = dict(groups.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in groups.columns) + ", cell long, home boolean"
    return each_batch(groups, run, schema)


def compare(group: pa.Table, cosine: float) -> pa.Table:
    """Links of the vectors at home in a block (side 0) to those of the other side.

    ``partial`` counts the linked vectors with their copies. ``tie`` joins two
    local components, at most one less than there are vectors. No other pair is
    passed on.
    """
    side = group.column("side").to_numpy()
    home, other = (group.filter(pa.array(side == k)) for k in (0, 1))
    ids, far = home.column("rep").to_numpy(), other.column("rep").to_numpy()
    rep, partial, tie = [], [], []
    if len(ids) and len(far):
        a, b = matrix(home.column("embedding")), matrix(other.column("embedding"))
        linked = (a @ b.T >= cosine) & (ids[:, None] != far[None, :])
        rep, partial, tie = ids.tolist(), (linked @ other.column("n").to_numpy()).tolist(), ids.tolist()
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in np.flatnonzero(linked.any(axis=1)).tolist():
            for x in far[linked[i]].tolist():
                p, q = root(int(ids[i])), root(x)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    rep.append(int(ids[i]))
                    partial.append(0)
                    tie.append(x)
    names = ["rep", "partial", "tie"]
    return pa.table([pa.array(x, pa.int64()) for x in (rep, partial, tie)], names)


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, most: int = MAX_PIVOTS, block: int = BLOCK
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    Vectors with equal labels and lengths are linked if their cosine, in double
    precision, is at least ``cosine``. Vectors that are null, zero or hold null
    or non-finite numbers, and those without id or label, have no links and are
    their own components. Equal vectors of a label are linked to each other and
    are compared as one, with their number. Rows of equal vec_id count as
    several vectors; should they differ, the id has the links of all. A null
    vec_id has a null component and stays. No rows, no rows.

    Exact at any choice of pivots. These are bounded in number and broadcast;
    cells beyond ``block`` vectors are compared block by block. What leaves a
    cell is a count and ties per vector, never all pairs.
    """
    prepared(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), "label", "embedding")
    good = rows.filter(is_usable()).withColumn("dim", F.size("embedding"))
    same = ["label", "dim", "embedding"]
    distinct = good.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    distinct = stored(distinct, "vectors")
    pivots = choose_pivots(distinct, cell, most)
    placed = stored(assigned(distinct, pivots, math.sqrt(2 - 2 * cosine)), "cells")

    # blocks of the vectors at home against blocks of all vectors of the cell
    at = ["label", "dim", "cell"]
    sizes = placed.groupBy(*at).agg(
        F.ceil(F.count_if("home") / block).alias("homes"), F.ceil(F.count(F.lit(1)) / block).alias("alls")
    )
    dealt = placed.join(stored(sizes.filter("homes > 0"), "sizes"), at)
    i, j = F.pmod(F.xxhash64("rep"), F.col("homes")), F.pmod(F.xxhash64(F.lit("all"), "rep"), F.col("alls"))

    def up_to(n):
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    as_home = F.transform(up_to("alls"), lambda k: F.struct(F.lit(0).alias("side"), i.alias("i"), k.alias("j")))
    as_other = F.transform(up_to("homes"), lambda k: F.struct(F.lit(1).alias("side"), k.alias("i"), j.alias("j")))
    sides = F.when(F.col("home"), F.concat(as_other, as_home)).otherwise(as_other)
    spread = dealt.select(*at, "rep", "n", "embedding", F.explode(sides).alias("_b"))
    spread = spread.select(*at, "rep", "n", "embedding", "_b.*")
    compared = spread.groupBy(*at, "i", "j").applyInArrow(
        lambda table: compare(table, cosine), "rep long, partial long, tie long"
    )
    found = stored(compared, "compared")

    near = found.groupBy("rep").agg(F.sum("partial").alias("near"))
    parts = components(found, "rep", "tie").withColumnRenamed("node", "rep")
    named = distinct.join(near, "rep", "left").join(parts, "rep", "left").select(
        *same,
        (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    # both sides are plain shuffles, so a vector with very many copies is split
    linked = good.join(stored(named, "named").hint("shuffle_merge"), same)
    lone = rows.filter(~is_usable())
    names = ["vec_id", "n_links", "component_id"]
    result = linked.select(*names).unionByName(
        lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    )
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
