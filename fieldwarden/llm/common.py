"""What the operators share: batch bounds, words of whole batches as arrays, hashes."""

from __future__ import annotations

import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwarden.session import stored, tune

BATCH_BYTES = 4 << 20  # of texts that a Python worker holds as one Arrow batch

__all__ = ["each_batch", "placed", "prepared", "same", "stored"]


def prepared(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by bytes and let the workers import this package."""
    tune(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])
    return spark


def each_batch(df: DataFrame, function, schema) -> DataFrame:
    """Apply a function of one record batch to all; empty batches are passed over."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    prepared(df.sparkSession)
    return df.mapInArrow(run, schema)


_HELD: dict = {}


def unpacked(shared, build):
    """What ``build`` makes of a broadcast value, made once per worker process."""
    value = shared.value
    held = _HELD.get(build)
    if held is None or held[0] is not value:
        held = _HELD[build] = (value, build(value))
    return held[1]


class WordTable:
    """Numbers of words by their 64-bit hash, at most ``limit`` words at a time."""

    def __init__(self, limit: int):
        self.limit = limit
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def look_up(self, raw: np.ndarray, first: np.ndarray, end: np.ndarray, count) -> np.ndarray:
        """The number of each byte range; ``count`` gives it for a list of new words."""
        hashes, sample, place = np.unique(span_hashes(raw, first, end), return_index=True, return_inverse=True)
        if not len(hashes):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, hashes)
        known = np.append(self.hashes, np.uint64(0))[at] == hashes
        known &= at < len(self.hashes)
        if len(self.hashes) + (~known).sum() > self.limit:
            self.hashes, self.values = self.hashes[:0], self.values[:0]
            known[:] = False
        fresh = np.flatnonzero(~known)
        if len(fresh):
            data = raw.tobytes()
            spans = zip(first[sample[fresh]].tolist(), end[sample[fresh]].tolist(), strict=True)
            numbers = np.array(count([data[a:b].decode() for a, b in spans]), np.int64)
            at = np.searchsorted(self.hashes, hashes[fresh])
            self.hashes = np.insert(self.hashes, at, hashes[fresh])
            self.values = np.insert(self.values, at, numbers)
        return self.values[np.searchsorted(self.hashes, hashes)][place]


def ascii_lower(text):
    """A-Z in lower case and nothing else; plain ASCII takes the fast path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower))


# ---- texts of a batch as one byte array --------------------------------------


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts end to end, and where each begins and the last ends; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    _, bounds, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(bounds, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes for words between ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Word bytes for words of lower-cased ASCII letters, digits and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


class Words(NamedTuple):
    """Words of a batch: byte ranges, the text each stands in, and where a text's words begin."""

    first: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray


def find_words(raw: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> Words:
    inside = is_word[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = bounds[:-1] < bounds[1:]
    before[bounds[:-1][filled]] = False
    after[bounds[1:][filled] - 1] = False
    first, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(bounds, first, side="right") - 1
    return Words(first, end, doc, np.searchsorted(doc, np.arange(len(bounds))))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = np.uint64(0xD6E8FEB86659FD93)
SHORT = 64  # powers for spans up to this length are at hand
POWERS = np.full(SHORT, STEP).cumprod()


def span_hashes(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges are in order and do not overlap."""
    if not len(first):
        return np.zeros(0, np.uint64)
    lengths = end - first
    longest = int(lengths.max())
    powers = POWERS if longest <= SHORT else np.full(longest, STEP).cumprod()
    starts = np.zeros(len(first) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    within = np.arange(starts[-1]) - np.repeat(starts[:-1], lengths)
    values = BYTE_HASH[raw[within + np.repeat(first, lengths)]] * powers[within]
    return mixed(np.add.reduceat(values, starts[:-1]) + lengths.astype(np.uint64))


def shingle_sets(raw, bounds, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of all texts, sorted within a text, and where each text begins.

    Words stand between ASCII white space, A-Z in lower case. A text of fewer
    words is one shingle; a text without words has none.
    """
    raw = LOWER[raw]
    words = find_words(raw, bounds, NOT_SPACE)
    hashes = span_hashes(raw, words.first, words.end)
    counts = np.diff(words.bounds)
    factor = np.full(size, np.uint64(0x9FB21C651E98DF25)).cumprod()
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        rolled[: n - k] += hashes[k:] * factor[k]
    place = np.arange(n) - words.bounds[words.doc]
    whole = place <= counts[words.doc] - size
    rolled, docs = rolled[whole], words.doc[whole]
    for doc in np.flatnonzero((counts > 0) & (counts < size)):
        own = hashes[words.bounds[doc] : words.bounds[doc + 1]]
        value = (own * factor[: len(own)]).sum() ^ BYTE_HASH[len(own)]
        rolled, docs = np.append(rolled, value), np.append(docs, doc)
    rolled = mixed(rolled)
    order = np.lexsort((rolled, docs))
    rolled, docs = rolled[order], docs[order]
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = (rolled[1:] != rolled[:-1]) | (docs[1:] != docs[:-1])
    rolled, docs = rolled[fresh], docs[fresh]
    return rolled, np.searchsorted(docs, np.arange(len(bounds)))


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


# ---- places of rows within a group ---------------------------------------------


def same(a: DataFrame, b: DataFrame, *names: str):
    """Equal names in both, null being a value like any other."""
    match = F.lit(True)
    for name in names:
        match = match & a[name].eqNullSafe(b[name])
    return match


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place of a row in its group from 0, and ``n``, the group's size.

    Rows are ordered by the given columns (null first), equal ones by where they
    stand in the input. No group has to fit a task: all rows are cut into ranges
    of (group, order), a hot group into many, and the counts of these ranges,
    one row per range and group, give the offsets. ``rows`` is evaluated twice,
    so it should be a stored table or a plain projection of one; the order
    should be short, as the bounds of the ranges are drawn from it.
    """
    keys = [group, *order, "_uid"]
    given = rows.withColumn("_uid", F.monotonically_increasing_id())
    ranged = given.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("_place", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("_range", F.shiftright("_place", 33)), "ranges")
    spans = ranged.groupBy("_range", group).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        spans.select(
            "_range",
            group,
            (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"),
            F.sum("_rows").over(whole).alias("n"),
        ),
        "offsets",
    )
    joined = ranged.join(offsets, same(ranged, offsets, "_range", group))
    return joined.select(
        *[ranged[c] for c in rows.columns], (F.col("_place") + F.col("_offset")).alias("pos"), "n"
    )
