"""Documents to shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwarden.llm.common import prepared

CELLS = 1 << 14  # places on the ring
NODES = 64  # virtual nodes per shard


def ring_owners(shards: int, nodes: int = NODES, cells: int = CELLS) -> list[list[int]]:
    """For each cell the shards in the order of their first virtual node clockwise."""
    at = defaultdict(list)
    for shard in range(shards):
        for node in range(nodes):
            at[zlib.crc32(f"shard {shard} node {node}".encode()) % cells].append(shard)
    order, owners = list(range(shards)), [[]] * cells
    # two rounds backwards: the second begins with what lies beyond the end
    for place in list(range(cells - 1, -1, -1)) * 2:
        for shard in at.get(place, []):
            order.remove(shard)
            order.insert(0, shard)
        owners[place] = tuple(order)
    return owners


def flow(counts: dict[int, int], shards: int, owners: list) -> list[dict]:
    """Which ranks of a cell go to which shard, and the slots they get there.

    Every shard takes ``total / shards`` rows, the first few one more. A shard
    fills from its own cells first; what finds it full continues clockwise to
    the next shard with room.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot, pieces, left = [0] * shards, [], {}

    def place(cell: int, rank: int, n: int, shard: int) -> int:
        taken = min(n, room[shard])
        if taken:
            pieces.append({"cell": cell, "low": rank, "high": rank + taken, "shard": shard, "slot": slot[shard]})
            room[shard] -= taken
            slot[shard] += taken
        return taken

    for cell in sorted(counts):
        taken = place(cell, 0, counts[cell], owners[cell][0])
        if taken < counts[cell]:
            left[cell] = taken
    for cell, rank in left.items():
        for shard in owners[cell][1:]:
            rank += place(cell, rank, counts[cell] - rank, shard)
            if rank == counts[cell]:
                break
    return pieces


def ring_shards(docs: DataFrame, keys: list[str], carry: dict[str, Column], shards: int, nodes: int = NODES) -> DataFrame:
    """``carry`` columns with ``shard`` and ``slot``, row counts of shards at most one apart.

    The key columns say where a row enters the ring. Counts per cell (16,384 at
    most, whatever the input) come to the driver, which lets full shards
    overflow; rows find their shard by their rank within the cell. Rows with
    equal keys (null is a value like any other) share a cell and are told apart
    by all carried columns; equal rows take any order, which no result shows.
    The key should include an id, as one cell is ranked by one task.
    An empty table has no rows.
    """
    spark = prepared(docs.sparkSession)
    names = {f"c{i}": name for i, name in enumerate(carry)}
    placed = docs.select(
        F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]), F.lit(CELLS))
        .cast("int")
        .alias("cell"),
        F.xxhash64(F.lit("order"), *keys).alias("h"),
        *[c.alias(f"c{i}") for i, c in enumerate(carry.values())],
    )
    counts = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = flow(counts, shards, ring_owners(shards, nodes))
    kind = "array<struct<cell:int,low:bigint,high:bigint,shard:int,slot:bigint>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(pieces)), kind)))
    in_cell = Window.partitionBy("cell").orderBy("h", *names)
    ranked = placed.withColumn("rank", F.row_number().over(in_cell) - 1)
    here = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    # at most one piece per cell and one more for each shard that a cell flows over to
    joined = ranked.join(F.broadcast(table.withColumnRenamed("cell", "at")), (F.col("cell") == F.col("at")) & here)
    return joined.select(
        *[F.col(c).alias(name) for c, name in names.items()],
        "shard",
        (F.col("slot") + F.col("rank") - F.col("low")).alias("slot"),
    )
