"""Near-duplicate documents: HyperMinHash registers, banding, estimation, exact confirmation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.common import each_batch, list_array, mixed, prepared, shingle_sets, stored, text_bytes
from fieldwarden.llm.components import components

SHINGLE = 5
REGISTERS = 160
ROWS = 4  # registers per band: 40 bands miss a pair at 0.75 with probability 3e-7
MANTISSA = 10  # bits kept below the leading one
EMPTY = 0xFFFF  # more leading zeros than any hash has
SIMILAR = 75  # percent
SLACK = 5.0  # standard errors by which an estimate may fall short before the sets are compared
BLOCK = 1024  # documents of one bucket that a task compares with as many others
BLOCK_SHINGLES = 2_000_000

SALT = np.uint64(0x2545F4914F6CDD1D)


# ---- registers ---------------------------------------------------------------


def registers(shingles: np.ndarray, bounds: np.ndarray, n: int = REGISTERS) -> np.ndarray:
    """One row of ``n`` registers per set: leading zeros and mantissa of the least hash per bucket."""
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h = mixed(shingles ^ SALT)
    bucket = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    value = mixed(h) >> np.uint64(11)  # 53 bits, exact as a float
    least = np.full((len(bounds) - 1) * n, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, docs * n + bucket, value)
    part, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(53 - exponent, 0, 62).astype(np.uint16)
    mantissa = ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    packed = zeros << np.uint16(MANTISSA) | np.minimum(mantissa, (1 << MANTISSA) - 1).astype(np.uint16)
    packed[least == np.iinfo(np.uint64).max] = EMPTY
    return packed.reshape(-1, n)


#: Where an empty register looks for a value, try by try; the same for all sets.
TRIES = 4 * REGISTERS
BORROW = (mixed(np.arange(1, TRIES * REGISTERS + 1, dtype=np.uint64)) % np.uint64(REGISTERS)).astype(np.int64)
BORROW = BORROW.reshape(TRIES, REGISTERS)


def filled_up(regs: np.ndarray) -> np.ndarray:
    """Registers whose empty ones have borrowed from others of the set, the same way in every set.

    Small sets leave most registers empty; a band of one value and three gaps
    would match all sets that share a single shingle.
    """
    full = regs.copy()
    rows = np.flatnonzero((full == EMPTY).any(axis=1) & (full != EMPTY).any(axis=1))
    for source in BORROW:
        if not len(rows):
            break
        part = full[rows]
        full[rows] = np.where(part == EMPTY, regs[rows][:, source], part)
        rows = rows[(full[rows] == EMPTY).any(axis=1)]
    for row in rows.tolist():
        full[row][full[row] == EMPTY] = regs[row].min()
    return full


def band_keys(regs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The registers of each band as one number, mixed with the number of the band."""
    parts = filled_up(regs).reshape(len(regs), -1, rows).astype(np.uint64)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for k in range(rows):
        keys = keys << np.uint64(16) | parts[:, :, k]
    number = np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * SALT
    return mixed(keys ^ mixed(number)[None, :])


def expected_collisions(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Registers that agree by chance, given the sizes of two sets; the published approximation."""
    large, small = np.maximum(a, b) / n, np.minimum(a, b) / n
    ratio = np.where(large > 0, small / np.maximum(large, 1e-9), 0)
    return 0.169919487159739 * n / 2.0**MANTISSA * 4 * ratio / (1 + ratio) ** 2


def estimate(regs_a, regs_b, size_a, size_b) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity estimated from registers less expected collisions, and its standard error at 0.75."""
    filled = ((regs_a != EMPTY) | (regs_b != EMPTY)).sum(axis=-1)
    equal = ((regs_a == regs_b) & (regs_a != EMPTY)).sum(axis=-1)
    union = np.maximum(filled, 1)
    chance = expected_collisions(size_a, size_b, REGISTERS) * filled / REGISTERS
    return np.maximum(equal - chance, 0) / union, np.sqrt(0.1875 / union)


def promising(regs_a, regs_b, size_a, size_b) -> np.ndarray:
    value, error = estimate(regs_a, regs_b, size_a, size_b)
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return (value >= SIMILAR / 100 - SLACK * error) & (100 * small >= SIMILAR * large)


def as_registers(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<u2").reshape(-1, REGISTERS)


# ---- documents ---------------------------------------------------------------


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, s1, s2, registers``: s1 and s2 are a 128-bit hash of the whole set."""

    def run(batch):
        sets, bounds = shingle_sets(*text_bytes(batch.column("text")), SHINGLE)
        regs = registers(sets, bounds)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (mixed(sets), mixed(sets ^ SALT))]
        s1, s2 = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
        data = [row.tobytes() for row in regs.astype("<u2")]
        columns = [
            batch.column("doc_id"),
            pa.array(np.diff(bounds)),
            pa.array(s1.view(np.int64)),
            pa.array(s2.view(np.int64)),
            pa.array(data, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "s1", "s2", "registers"])

    schema = "doc_id long, n_shingles long, s1 long, s2 long, registers binary"
    return each_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def bands(sets: DataFrame) -> DataFrame:
    """``key, doc`` for each band of a document with shingles."""

    def run(batch):
        keys = band_keys(as_registers(batch.column("registers")))
        rows = np.repeat(np.arange(len(keys)), keys.shape[1])
        columns = [pa.array(keys.reshape(-1).view(np.int64)), batch.column("doc").take(pa.array(rows))]
        return pa.RecordBatch.from_arrays(columns, ["key", "doc"])

    return each_batch(sets.select("doc", "registers"), run, "key long, doc long")


def estimated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose registers leave them a chance."""
    side = sets.select("doc", "registers", "n_shingles")
    both = pairs.join(side.toDF("a", "ra", "na"), "a").join(side.toDF("b", "rb", "nb"), "b")

    def run(batch):
        size = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")]
        good = promising(as_registers(batch.column("ra")), as_registers(batch.column("rb")), *size)
        return batch.select(["a", "b"]).filter(pa.array(good))

    return each_batch(both, run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, shingles`` of the wanted documents; the set of an id with several rows is one of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    rows = rows.join(wanted.select("doc", "s1", "s2"), "doc")

    def run(batch):
        sets, bounds = shingle_sets(*text_bytes(batch.column("text")), SHINGLE)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (mixed(sets), mixed(sets ^ SALT))]
        own = np.ones(batch.num_rows, bool)
        for name, s in zip(("s1", "s2"), sums, strict=True):
            own &= (s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) == batch.column(name).to_numpy(zero_copy_only=False)
        columns = [batch.column("doc"), list_array(sets.view(np.int64), bounds)]
        return pa.RecordBatch.from_arrays(columns, ["doc", "shingles"]).filter(pa.array(own))

    return each_batch(rows, run, "doc long, shingles array<long>")


def similar(common: Column, a: Column, b: Column) -> Column:
    return 100 * common >= SIMILAR * (a + b - common)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose full sets are similar enough."""
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return both.filter(similar(common, F.size("xa"), F.size("xb"))).select("a", "b")


def links_in_block(rows: pa.Table) -> pa.Table:
    """Confirmed links that join different components, among the documents of one block."""
    rows = rows.combine_chunks()
    regs = as_registers(rows.column("registers"))
    size, part, docs = (rows.column(c).to_numpy() for c in ("n_shingles", "component", "doc"))
    shingles = rows.column("shingles").chunk(0)
    values, cuts = shingles.values.to_numpy(), shingles.offsets.to_numpy()
    part, found = part.copy(), []
    strip = max(1, 4_000_000 // (REGISTERS * len(docs)))  # rows compared with all others at a time
    for low in range(0, len(docs), strip):
        here = np.arange(low, min(low + strip, len(docs)))
        good = promising(regs[here][:, None, :], regs[None, :, :], size[here][:, None], size[None, :])
        good &= (part[here][:, None] != part[None, :]) & (here[:, None] < np.arange(len(docs))[None, :])
        for i, j in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
            i += low
            if part[i] == part[j]:
                continue
            a, b = (values[cuts[k] : cuts[k + 1]] for k in (i, j))
            common = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * common >= SIMILAR * (len(a) + len(b) - common):
                found.append((docs[i], docs[j]))
                part[part == part[j]] = part[i]
    columns = [pa.array([int(f[k]) for f in found], pa.int64()) for k in (0, 1)]
    return pa.table(columns, ["a", "b"])


def links_across(members: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links inside buckets between components that the first round left apart.

    ``members`` has ``key, doc, component`` of such buckets. Buckets of the same
    documents are compared once. A large bucket is cut into blocks and each pair
    of blocks is a task; a block passes on links between components only.
    """
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("doc")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit("second"), "doc")).alias("y"),
    )
    once = stored(buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "buckets")
    rows = stored(members.join(once, "key"), "members")
    wanted = sets.join(rows.select("doc").distinct(), "doc")
    whole = stored(
        wanted.join(full_sets(docs, wanted).groupBy("doc").agg(F.first("shingles").alias("shingles")), "doc")
        .select("doc", "n_shingles", "registers", "shingles"),
        "sets",
    )
    rows = rows.join(whole.select("doc", "n_shingles"), "doc")
    loads = rows.groupBy("key").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
        ).alias("blocks")
    )
    dealt = rows.drop("n_shingles").join(stored(loads, "loads"), "key")
    own = F.pmod(F.xxhash64("doc"), F.col("blocks"))
    others = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j"))
    )
    spread = dealt.select("key", "doc", "component", F.explode(others).alias("_p")).select(
        "key", "doc", "component", "_p.i", "_p.j"
    )

    spread = spread.join(whole, "doc").select(*spread.columns, "n_shingles", "registers", "shingles")
    return spread.groupBy("key", "i", "j").applyInArrow(links_in_block, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Two documents are linked if their sets of 5-word shingles have a Jaccard
    similarity of 0.75; components are closed over links, named by their
    smallest doc_id, and that document is kept. Shorter documents have their
    whole word sequence as one shingle. A document without words has no
    shingle and is its own component. Rows of equal doc_id are one document;
    should their texts differ, the one of fewest shingles (then of the smallest
    set hash) is compared. Null doc_ids are never linked; they are kept, with a
    null component. No rows, no rows.

    Equal sets meet first, by a hash of the whole set, aggregated map-side; all
    further steps have one row per set. In a bucket each document is compared
    with the smallest one, which settles large groups of copies with a row per
    document. Only documents that this leaves in different components are
    compared with each other, in blocks.
    """
    prepared(docs.sparkSession)
    all_sets = stored(sketches(docs), "sketches")
    filled = all_sets.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    by_set = ["n_shingles", "s1", "s2"]
    classes = stored(
        filled.groupBy(*by_set).agg(F.min("doc_id").alias("doc"), F.min("registers").alias("registers")), "classes"
    )
    sets = classes
    twice = classes.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    if not twice.isEmpty():
        whole = F.min(F.struct(*by_set, "registers")).alias("s")
        sets = stored(classes.groupBy("doc").agg(whole).select("doc", "s.*"), "sets-of-documents")

    buckets = stored(bands(sets), "bands")
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least")).filter("n > 1")
    members = stored(buckets.join(stored(shared, "shared-bands"), "key"), "bucket-members")
    stars = members.filter(F.col("doc") > F.col("least")).select(F.col("least").alias("a"), F.col("doc").alias("b"))
    pairs = stored(estimated(stars.distinct(), sets), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    wanted = sets.join(ends, "doc")
    whole = stored(full_sets(docs, wanted).groupBy("doc").agg(F.first("shingles").alias("shingles")), "full-sets")
    links = stored(confirmed(pairs, whole), "links")

    first = stored(components(links, "a", "b"), "components")
    named = members.join(first, F.col("doc") == F.col("node"), "left").select(
        "key", "doc", F.coalesce("component", "doc").alias("component"), "least"
    )
    rest = named.filter(F.col("doc") > F.col("least"))
    apart = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    more = links_across(rest.join(stored(apart, "apart").select("key"), "key").drop("least"), sets, docs)
    more = stored(more, "more-links")
    if more.isEmpty():
        merged = first
    else:
        lines = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
        merged = stored(components(lines.unionByName(more), "a", "b"), "components")

    # every row by its set, then by the component of the set's document
    named = classes.join(merged, F.col("doc") == F.col("node"), "left").select(
        *by_set, F.coalesce("component", "doc").alias("component_id")
    )
    named = stored(named, "named")
    rows = all_sets.select("doc_id", *by_set).join(named.hint("shuffle_merge"), by_set, "left")
    own = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(own, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
