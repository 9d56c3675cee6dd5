"""Documents into training sequences by best-two-fit, decided on counts of lengths."""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldwarden.llm.common import each_batch, prepared, span_hashes, stored, text_bytes

SEQUENCE = 2048
SALT = 64  # groups in which the pieces of one length are numbered, at least
GROUP = 1 << 20  # pieces in such a group, about, where there are more
WORDS_KEPT = 2_000_000  # encoded words that a worker remembers
END = 0

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the same vocabulary

# ---- words as the tokenizer splits them --------------------------------------

LETTER, DIGIT, SPACE, OTHER, ODD = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[28:32] = ODD
# two-byte letters U+00C0 to U+024F; the rest of UTF-8 is left to the tokenizer
KIND[128:192] = LETTER
KIND[192:256] = ODD
KIND[0xC3:0xCA] = LETTER


def plain_texts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts whose split follows from byte classes alone."""
    odd = KIND[raw] == ODD
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    odd |= after & ((raw == 0x97) | (raw == 0xB7))  # the signs for times and division
    special = np.zeros(len(raw), bool)
    special[1:] = (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))  # may begin a special token
    odd = np.concatenate([[0], np.cumsum(odd | special)])
    return odd[bounds[1:]] == odd[bounds[:-1]]


def split_words(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where a word begins, as the byte-level pattern splits plain texts.

    A word is a run of letters, of digits or of other signs with one space
    before it, a contraction, or white space that precedes no word.
    """
    n = len(raw)
    kind = KIND[raw]
    begins = np.zeros(n + 1, bool)
    begins[bounds] = True  # also marks n
    first = begins[:n].copy()
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    blank = raw == 32
    white = kind == SPACE
    # the last blank of a run of white space belongs to the word behind it
    leads = np.zeros(n, bool)
    leads[:-1] = blank[:-1] & ~white[1:] & ~begins[1:n]
    behind = np.zeros(n, bool)
    behind[1:] = leads[:-1]
    # other white space right before a word stands alone
    alone = np.zeros(n, bool)
    alone[:-1] = white[:-1] & ~blank[:-1] & ~white[1:] & ~begins[1:n]
    start = (start & ~behind) | leads | alone
    # contractions, where the sign begins a word of its own
    sign = np.flatnonzero((raw == ord("'")) & start)
    if len(sign):
        padded = np.concatenate([raw, np.zeros(3, np.uint8)])
        inside = np.concatenate([~begins[:n], np.zeros(4, bool)])
        one, two = padded[sign + 1], padded[sign + 2]
        short = inside[sign + 1] & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pairs = (one.astype(np.int32) << 8) | two
        known = np.array([(a << 8) | b for a, b in (b"re", b"ve", b"ll")])
        long = inside[sign + 1] & inside[sign + 2] & np.isin(pairs, known)
        for hit, size in ((short, 2), (long, 3)):
            at = sign[hit]
            start[at + 1] = False
            if size == 3:
                start[at + 2] = False
            at = at[at + size < n] + size
            # what follows is a word of its own unless a blank leads into the next
            start[at] = start[at] | (kind[at] == LETTER)
    return np.flatnonzero(start)


class Encoder:
    """Token ids of texts; words met before are looked up by their 64-bit hash.

    New words are encoded by the ranks of the same vocabulary, many at a time
    with line feeds between them, which is several times as fast and gives the
    same ids. White space and texts beyond plain ones go to the tokenizer.
    """

    def __init__(self, path: str, ranks: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.by_rank = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.feed = table[b"\n"]
        self.clear()

    def clear(self):
        self.hashes = np.zeros(0, np.uint64)
        self.bounds = np.zeros((0, 2), np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]):
        blank = np.fromiter(map(str.isspace, words), bool, len(words))
        order = np.concatenate([np.flatnonzero(~blank), np.flatnonzero(blank)])
        filled = [w for w, b in zip(words, blank.tolist(), strict=True) if not b]
        ids = np.array(self.by_rank.encode_ordinary("\n".join([*filled, ""])), np.uint32)
        ends = np.flatnonzero(ids == self.feed)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        for word in (w for w, b in zip(words, blank.tolist(), strict=True) if b):
            own = self.whole(word)
            starts, ends = np.append(starts, len(ids)), np.append(ends, len(ids) + len(own))
            ids = np.concatenate([ids, own])
        bounds = np.stack([starts, ends], 1) + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        rising = np.argsort(hashes[order])
        hashes, bounds = hashes[order][rising], bounds[rising]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.bounds = np.insert(self.hashes, at, hashes), np.insert(self.bounds, at, bounds, axis=0)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        inside = np.minimum(at, max(len(self.hashes) - 1, 0))
        return (self.hashes[inside] == hashes) if len(self.hashes) else np.zeros(len(hashes), bool)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin."""
        raw, bounds = text_bytes(texts)
        plain = plain_texts(raw, bounds)
        keep = np.repeat(plain, np.diff(bounds))
        own = np.concatenate([[0], np.cumsum(np.where(plain, np.diff(bounds), 0))])
        kept = raw[keep]
        first = split_words(kept, own) if len(kept) else np.zeros(0, np.int64)
        end = np.append(first[1:], len(kept))
        hashes = span_hashes(kept, first, end)
        distinct, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
        fresh = np.flatnonzero(~self.known(distinct))
        if len(fresh) and len(self.hashes) + len(fresh) > WORDS_KEPT:
            self.clear()
            fresh = np.arange(len(distinct))
        if len(fresh):
            data = kept.tobytes()
            spans = zip(first[sample[fresh]].tolist(), end[sample[fresh]].tolist(), strict=True)
            self.learn(distinct[fresh], [data[a:b].decode() for a, b in spans])
        entry = self.bounds[np.searchsorted(self.hashes, distinct)][place] if len(distinct) else self.bounds[:0]
        sizes = entry[:, 1] - entry[:, 0]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        within = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)
        ids = self.ids[within + np.repeat(entry[:, 0], sizes)]
        cuts = starts[np.searchsorted(first, own)]
        if plain.all():
            return ids, cuts
        odd = {k: self.whole(texts[k].as_py()) for k in np.flatnonzero(~plain).tolist()}
        parts = [odd[k] if k in odd else ids[cuts[k] : cuts[k + 1]] for k in range(len(plain))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@cache
def encoder(path: str, ranks: str) -> Encoder:
    """One per worker process and vocabulary, kept from task to task."""
    return Encoder(path, ranks)


# ---- pieces ------------------------------------------------------------------

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str = TOKENIZER, ranks: str = RANKS, size: int = SEQUENCE) -> DataFrame:
    """Token ids of every document and a final id 0, cut into pieces of ``size`` at most.

    Only longer documents are cut, and of theirs only the first piece is
    shorter. A null text is empty. One row per piece: its place, length and the
    crc32 of its ids as little-endian 32-bit numbers.
    """

    def run(batch):
        ids, bounds = encoder(path, ranks)(batch.column("text"))
        rows: list[list] = [[], [], [], [], []]
        for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            data = ids[a:b].astype("<u4").tobytes() + END.to_bytes(4, "little")
            total = len(data) // 4
            cuts = [0, *range(total % size or size, total, size), total] if total > size else [0, total]
            for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                for column, value in zip(rows, (doc, k, x, y - x, zlib.crc32(data[4 * x : 4 * y])), strict=True):
                    column.append(value)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types, strict=True)], names)

    return each_batch(docs.select("doc_id", "text"), run, PIECE)


# ---- bins --------------------------------------------------------------------


def best_two_fit(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Bins as ``(lengths, times)``: how often a bin of these lengths is filled.

    A bin takes the longest piece left and then, greedily, the longest that
    fits. If a gap is left, its smallest piece is replaced by the two unpacked
    pieces that fill the widened gap best, if they fill it better. The same bin
    is repeated while the counts allow, so the work follows the number of
    different lengths and not the number of pieces.
    """
    left = Counter({k: n for k, n in counts.items() if n})
    lengths = sorted(left)
    bins = []

    def longest(limit: int, used: Counter) -> int:
        k = bisect_right(lengths, limit) - 1
        while k >= 0 and left[lengths[k]] <= used[lengths[k]]:
            k -= 1
        return lengths[k] if k >= 0 else 0

    def best_pair(gap: int, used: Counter) -> tuple[int, int]:
        """Two unpacked pieces with the largest sum up to the gap."""
        free = [x for x in lengths[: bisect_right(lengths, gap)] if left[x] > used[x]]
        low, high, best = 0, len(free) - 1, (0, 0)
        while low <= high:
            a, b = free[low], free[high]
            if a + b > gap or (low == high and left[a] - used[a] < 2):
                high -= 1
                continue
            if a + b > sum(best):
                best = (a, b)
                if a + b == gap:
                    break
            low += 1
        return best

    while lengths:
        used: Counter = Counter()
        gap = size
        while gap and (x := longest(gap, used)):
            used[x] += 1
            gap -= x
        if gap and used.total() > 1:
            smallest = min(used)
            used[smallest] -= 1
            pair = best_pair(gap + smallest, used)
            if sum(pair) > smallest:
                used.update(pair)
            else:
                used[smallest] += 1
        used = +used
        times = min(left[x] // n for x, n in used.items())
        left.subtract({x: n * times for x, n in used.items()})
        bins.append((sorted(used.elements(), reverse=True), times))
        lengths = [x for x in lengths if left[x]]
    return bins


def salts_of(counts: dict[int, int], size: int) -> list[int]:
    """In how many groups the pieces of each length from 0 on are numbered: more where there are very many."""
    return [max(SALT, counts.get(length, 0) // GROUP + 1) for length in range(size + 1)]


def slots(bins: list[tuple[list[int], int]]) -> list[dict]:
    """For each bin and length: which of the pieces of that length it takes, and where."""
    rank: Counter = Counter()
    table, sequence = [], 0
    for lengths, times in bins:
        offset = 0
        for length, n in Counter(lengths).items():
            low = rank[length]
            rank[length] += n * times
            table.append({"len": length, "low": low, "high": rank[length], "n": n, "seq": sequence, "at": offset})
            offset += length * n
        sequence += times
    return table


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """The pieces with ``sequence_id, offset``; every sequence is gapless from 0.

    Only the counts per length, ``size`` at most, come to the driver. Pieces of
    a length are numbered in groups by a hash of what they are, so a length that
    a third of all pieces share is spread; equal pieces may take each other's
    place. No pieces, no rows.
    """
    spark = prepared(pieces.sparkSession)
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a folded split keeps the plan at one literal
    salts = ",".join(str(n) for n in salts_of(counts, size))
    groups_of = F.get(F.split(F.lit(salts), ",").cast("array<int>"), F.col("length").cast("int"))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), groups_of).cast("int")
    salted = pieces.withColumn("_salt", salt)
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    # size * SALT rows and one more per GROUP pieces, at most
    offsets = groups.select(
        F.col("length").alias("_len"),
        F.col("_salt").alias("_s"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
    )
    kind = "array<struct<len:bigint,low:bigint,high:bigint,n:bigint,seq:bigint,at:bigint>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(slots(best_two_fit(counts, size)))), kind)))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        salted.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), (F.col("length") == F.col("_len")) & (F.col("_salt") == F.col("_s")))
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    here = (F.col("length") == F.col("len")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high"))
    nth = F.col("_rank") - F.col("low")
    placed = numbered.join(F.broadcast(table), here)
    return placed.select(
        *pieces.columns,
        (F.col("seq") + F.floor(nth / F.col("n"))).alias("sequence_id"),
        (F.col("at") + nth % F.col("n") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str = TOKENIZER, ranks: str = RANKS, size: int = SEQUENCE) -> DataFrame:
    """All documents in as few sequences of ``size`` tokens as best-two-fit finds.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. Rows of equal or null ids are documents of their own.
    """
    return pack(stored(token_pieces(docs, path, ranks, size), "pieces"), size)
