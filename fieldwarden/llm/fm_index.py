"""Benchmark passages in documents, found with an FM-index over each shard of words."""

from __future__ import annotations

import pickle
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.common import (
    LOWER,
    WORD,
    each_batch,
    find_words,
    prepared,
    span_hashes,
    stored,
    text_bytes,
    unpacked,
)

WINDOW = 10
SAMPLE = 16  # of this many suffixes of a run one position is kept
BLOCK_BYTES = 16 << 20  # of benchmark texts searched for in one pass


class Phrases:
    """Windows of benchmark items as rows of word numbers, and the items of each."""

    def __init__(self, texts: list[str], items: list[str], window: int = WINDOW):
        raw, bounds = text_bytes(pa.array(texts, pa.string()))
        raw = LOWER[raw]
        words = find_words(raw, bounds, WORD)
        self.vocabulary, number = np.unique(span_hashes(raw, words.first, words.end), return_inverse=True)
        holders = defaultdict(set)
        for k, item in enumerate(items):
            own = tuple((number[words.bounds[k] : words.bounds[k + 1]] + 1).tolist())
            for i in range(max(len(own) - window + 1, min(len(own), 1))):
                holders[own[i : i + window]].add(item)
        phrases = sorted(holders)
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.words = np.zeros((len(phrases), window), np.int64)
        for k, phrase in enumerate(phrases):
            self.words[k, : len(phrase)] = phrase
        names = sorted({x for h in holders.values() for x in h})
        place = {x: i for i, x in enumerate(names)}
        self.names = np.array(names, object)
        self.items = [np.array(sorted(place[x] for x in holders[p]), np.int64) for p in phrases]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for words of no item."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[at] == hashes, at + 1, 0) if len(self.vocabulary) else np.zeros(len(hashes), int)


class WaveletMatrix:
    """Rank of any symbol before any row, over bit levels."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels, self.zeros = [], []
        self.bits = max(1, int(largest).bit_length())
        for level in reversed(range(self.bits)):
            ones = ((symbols >> level) & 1).astype(bool)
            count = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            self.levels.append(count)
            self.zeros.append(len(symbols) - int(count[-1]))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.starts = self._down(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64))

    def _down(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        for depth, (count, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbols >> (self.bits - 1 - depth)) & 1
            ones = count[rows]
            rows = np.where(one, zeros + ones, rows - ones)
        return rows

    def rank(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self._down(symbols, rows) - self.starts[symbols]


class FmIndex:
    """Backward search over runs of word numbers; 0 separates the runs and is never crossed."""

    def __init__(self, text: np.ndarray, largest: int):
        n = len(text)
        breaks = np.flatnonzero(text == 0)
        # every separator is a symbol of its own, so suffixes differ within their run
        order = text + len(breaks)
        order[breaks] = np.arange(len(breaks))
        run = np.diff(np.append(breaks, n)).max() if len(breaks) else n
        rank, width = np.unique(order, return_inverse=True)[1], 1
        suffixes = np.argsort(rank, kind="stable")
        while width <= run:
            follow = np.zeros(n, np.int64)
            follow[: n - width] = rank[width:] + 1
            key = rank * (n + 1) + follow
            suffixes = np.argsort(key, kind="stable")
            ranked = key[suffixes]
            rank = np.empty(n, np.int64)
            rank[suffixes] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            if rank.max() == n - 1:
                break
            width *= 2
        self.last = text[suffixes - 1]  # the symbol before each suffix
        self.tree = WaveletMatrix(self.last, largest)
        counts = np.bincount(text, minlength=largest + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])  # suffixes of smaller symbols
        opening = self.last == 0
        kept = opening | (suffixes % SAMPLE == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.positions = suffixes[kept]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``low`` to ``high`` of the suffixes that begin with each phrase."""
        at = np.arange(len(phrases.lengths))
        last = phrases.words[at, phrases.lengths - 1]
        low, high = self.before[last].copy(), self.before[last + 1].copy()
        alive = at
        for step in range(2, phrases.words.shape[1] + 1):
            alive = alive[(phrases.lengths[alive] >= step) & (high[alive] > low[alive])]
            if not len(alive):
                break
            word = phrases.words[alive, phrases.lengths[alive] - step]
            low[alive] = self.before[word] + self.tree.rank(word, low[alive])
            high[alive] = self.before[word] + self.tree.rank(word, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to the next one whose position is kept."""
        steps = np.zeros(len(rows), np.int64)
        found = np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            here = rows[open_]
            hit = self.kept[here + 1] > self.kept[here]
            done = open_[hit]
            found[done] = self.positions[self.kept[rows[done]]] + steps[done]
            open_ = open_[~hit]
            here = rows[open_]
            symbol = self.last[here]
            rows[open_] = self.before[symbol] + self.tree.rank(symbol, here)
            steps[open_] += 1
        return found


def occurrences(numbers: np.ndarray, doc: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases begin among the words of a shard, and which."""
    nothing = np.zeros(0, np.int64)
    if not len(phrases.lengths):
        return nothing, nothing
    # runs of benchmark words; shorter ones than any phrase hold none
    known = np.flatnonzero(numbers)
    if not len(known):
        return nothing, nothing
    opens = np.ones(len(known), bool)
    opens[1:] = (np.diff(known) != 1) | (doc[known[1:]] != doc[known[:-1]])
    runs = np.cumsum(opens) - 1
    sizes = np.bincount(runs)
    long = sizes[runs] >= phrases.lengths.min()
    known, opens = known[long], opens[long]
    if not len(known):
        return nothing, nothing
    at = np.arange(len(known)) + np.cumsum(opens)  # with a separator before each run
    text = np.zeros(at[-1] + 2, np.int64)
    origin = np.zeros(at[-1] + 2, np.int64)
    text[at], origin[at] = numbers[known], known
    index = FmIndex(text, len(phrases.vocabulary))
    low, high = index.search(phrases)
    times = high - low
    which = np.repeat(np.arange(len(times)), times)
    first = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
    return origin[index.locate(first + np.arange(times.sum()))], which


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def spans_of(hit: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 hit word of each span; spans end with their document."""
    before, after = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
    if len(hit):
        same = words.doc[1:] == words.doc[:-1]
        before[1:], after[:-1] = hit[:-1] & same, hit[1:] & same
    return np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1


def search_batch(texts: pa.Array, phrases: Phrases):
    """Words, which of them are hit, and pairs of text and item name (distinct, in order)."""
    raw, bounds = text_bytes(texts)
    raw = LOWER[raw]
    words = find_words(raw, bounds, WORD)
    numbers = phrases.numbers(span_hashes(raw, words.first, words.end))
    starts, which = occurrences(numbers, words.doc, phrases)
    hit = covered(len(numbers), starts, phrases.lengths[which] if len(which) else starts)
    pairs = np.zeros((0, 2), np.int64)
    if len(which):
        found = np.unique(np.stack([words.doc[starts], which], 1), axis=0)
        sizes = np.array([len(phrases.items[k]) for k in found[:, 1]])
        pairs = np.stack(
            [np.repeat(found[:, 0], sizes), np.concatenate([phrases.items[k] for k in found[:, 1]])], 1
        )
        pairs = np.unique(pairs, axis=0)
    return words, hit, pairs


def benchmark_blocks(bench: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> list:
    """The benchmark as broadcast phrase tables of bounded size, one per pass over the documents.

    Texts are grouped by size only to bound a pass; every item is searched for.
    """
    spark = bench.sparkSession
    filled = bench.filter(F.length("text") > 0).select(F.col("item_id").cast("string").alias("item"), "text")
    total = filled.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    blocks = []
    for k in range(n):
        here = F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k
        rows = sorted((r.item or "", r.text) for r in filled.filter(here).collect())
        table = Phrases([t for _, t in rows], [i for i, _ in rows], window)
        blocks.append(spark.sparkContext.broadcast(pickle.dumps(table)))
    return blocks


def find_passages(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every document row.

    ``spans`` are the merged ranges of hit words (first, end), ``items`` the
    item_ids, as sorted distinct strings, of which a window occurs. A window is
    ``window`` consecutive words of an item, or all words of a shorter one.
    Null and empty texts have no words; items without words are never found, an
    item without id counts as the empty string. Equal or null doc_ids are rows
    of their own. Other columns are left out.
    """
    prepared(docs.sparkSession)
    span = "array<struct<first:long,end:long>>"
    blocks = benchmark_blocks(bench, block_bytes, window)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1

        def run(batch, block=block, first_pass=k == 0, last=last):
            words, hit, pairs = search_batch(batch.column("text"), unpacked(block, pickle.loads))
            names = unpacked(block, pickle.loads).names
            items = [[] for _ in range(batch.num_rows)]
            if not first_pass:
                for doc, (old, spans) in enumerate(zip(batch.column("items").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                    items[doc] = old
                    for s in spans:
                        hit[words.bounds[doc] + s["first"] : words.bounds[doc] + s["end"]] = True
            for doc, name in pairs.tolist():
                items[doc].append(names[name])
            first, end = spans_of(hit, words)
            doc = words.doc[first]
            base = words.bounds[doc]
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            values = pa.StructArray.from_arrays([pa.array(first - base), pa.array(end - base)], ["first", "end"])
            spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(words.bounds)),
                spans,
                pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
            ]
            names = ["doc_id", "n_words", "spans", "items"]
            if not last:
                columns.append(batch.column("text"))
                names.append("text")
            return pa.RecordBatch.from_arrays(columns, names)

        kind = dict(docs.dtypes)["doc_id"]
        schema = f"doc_id {kind}, n_words long, spans {span}, items array<string>" + ("" if last else ", text string")
        rows = each_batch(rows, run, schema)
    return rows


SPANS = "array<struct<first:long,end:long>>"


def without_spans(texts: pa.Array, words, hit: np.ndarray) -> dict[int, str]:
    """The texts that hold hit words, without their spans."""
    first, end = spans_of(hit, words)
    cuts = defaultdict(list)
    for a, b in zip(first.tolist(), end.tolist(), strict=True):
        cuts[int(words.doc[a])].append((int(words.first[a]), int(words.end[b - 1])))
    begin = text_bytes(texts)[1]
    out = {}
    for doc, ranges in cuts.items():
        data, keep, at = texts[doc].as_py().encode(), [], 0
        for a, b in ranges:
            keep.append(data[at : a - begin[doc]])
            at = b - begin[doc]
        out[doc] = b"".join([*keep, data[at:]]).decode()
    return out


def with_texts(batch: pa.RecordBatch, changed: dict[int, str], **flags) -> pa.RecordBatch:
    """A batch with other texts, marked as cut, and the given columns."""
    texts, cut = batch.column("text").to_pylist(), batch.column("_cut").to_pylist()
    for i, text in changed.items():
        texts[i], cut[i] = text, True
    for name, values in {"text": texts, "_cut": cut, **flags}.items():
        at = batch.schema.get_field_index(name)
        field = batch.schema.field(at)
        batch = batch.set_column(at, field, pa.array(values, field.type))
    return batch


def cut_in_rounds(rows: DataFrame, blocks: list) -> DataFrame:
    """Rows without the passages of several blocks.

    A round finds the spans of all blocks on the same texts and cuts them
    merged; the next one searches the texts that were cut.
    """
    finished = []
    while True:
        rows = rows.withColumns({"_spans": F.lit(None).cast(SPANS), "_open": F.lit(False)})
        for k, block in enumerate(blocks):

            def run(batch, block=block, last=k == len(blocks) - 1):
                texts = batch.column("text")
                words, hit, _ = search_batch(texts, unpacked(block, pickle.loads))
                for doc, spans in enumerate(batch.column("_spans").to_pylist()):
                    for s in spans or []:
                        hit[words.bounds[doc] + s["first"] : words.bounds[doc] + s["end"]] = True
                if last:
                    changed = without_spans(texts, words, hit)
                    empty = [None] * batch.num_rows
                    return with_texts(batch, changed, _spans=empty, _open=[i in changed for i in range(batch.num_rows)])
                spans = [[] for _ in range(batch.num_rows)]
                for a, b in zip(*(x.tolist() for x in spans_of(hit, words)), strict=True):
                    doc = int(words.doc[a])
                    spans[doc].append({"first": a - int(words.bounds[doc]), "end": b - int(words.bounds[doc])})
                return with_texts(batch, {}, _spans=spans)

            rows = each_batch(rows, run, rows.schema)
        rows = stored(rows, "passages")
        finished.append(rows.filter(~F.col("_open")).drop("_spans", "_open"))
        rows = rows.filter("_open").drop("_spans", "_open")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, finished)


def cut_in_place(rows: DataFrame, block) -> DataFrame:
    """Rows without the passages of the only block, searched until nothing is found."""

    def run(batch):
        texts, changed, open_ = batch.column("text"), {}, np.arange(batch.num_rows)
        while len(open_):
            words, hit, _ = search_batch(texts, unpacked(block, pickle.loads))
            now = without_spans(texts, words, hit)
            changed.update({int(open_[i]): text for i, text in now.items()})
            open_ = open_[sorted(now)]
            texts = pa.array([now[i] for i in sorted(now)], texts.type)
        return with_texts(batch, changed)

    return each_batch(rows, run, rows.schema)


def remove_passages(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the passages, and without documents that have no word left.

    A span is cut from its first to its last hit word, merged over all blocks of
    the benchmark; the text is searched again for all of it until nothing is
    found, as words that become neighbours may form another window. Documents that hold no passage stay as they are, also empty
    and null ones. ``n_chars``, if there, is set anew for texts that were cut.
    """
    prepared(docs.sparkSession)
    blocks = benchmark_blocks(bench, block_bytes, window)
    rows = docs.withColumn("_cut", F.lit(False))
    rows = cut_in_place(rows, blocks[0]) if len(blocks) == 1 else cut_in_rounds(rows, blocks)
    # what is left of a document that was cut must hold a word
    rows = rows.filter(~F.col("_cut") | F.col("text").rlike(r"[0-9A-Za-z[^\x00-\x7F]]"))
    if "n_chars" in docs.columns:
        size = F.when(F.col("_cut"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", size)
    return rows.select(*docs.columns)


def passage_digest(found: DataFrame) -> DataFrame:
    """Counts and a digest per row of ``find_passages``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
