"""Toxicity by compression distance between two Zstandard dictionaries."""

from __future__ import annotations

import math
import pickle
import random
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldwarden.llm.common import each_batch, prepared, stored, unpacked

THRESHOLD = 0.3
TOXIC_SAMPLE = 2000  # labelled documents the model is fitted on, of each label at most
ORDINARY_SAMPLE = 4000
SCOPES = (0, 1, 2)  # dictionaries of either half of the sample, and of all of it
WORDS = 12  # words of a window
PHRASE = 3  # words of a mark at most
WINDOW_BYTES = 256  # of a window at most; longer ones are cut
ORDINARY_BYTES = 100_000
PIECE_BYTES = 256  # of ordinary text in one sample for its dictionary
PIECES = 20_000  # samples that a dictionary is trained on at most
STEP_WORDS = 20_000  # of a text whose phrases are held at a time
ROOM = 4  # bytes of the toxic part for each byte of a mark
GAINS = (1, 2, 3, 4, 6)  # bytes that a window may gain at least

FLAT = [0.0] * (3 + 2 * len(GAINS))

# ---- Fixed value: how a trained dictionary begins ----------------------------
TRAINED = b"\x37\xa4\x30\xec"

PARAMETERS = {
    "window_log": 18,
    "chain_log": 16,
    "hash_log": 18,
    "search_log": 5,
    "min_match": 6,
    "target_length": 16,
    "strategy": zstandard.STRATEGY_GREEDY,
    "write_checksum": False,
    "write_content_size": False,
    "write_dict_id": False,
}


class Model(NamedTuple):
    """Both dictionaries, and the weights that turn window gains into a probability."""

    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def windows(text: str) -> list[bytes]:
    """A text in lower case as windows of a few words; an empty text is one empty window."""
    words = text.lower().encode().split()
    parts = [b" ".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)] or [b""]
    return [p[i : i + WINDOW_BYTES] for p in parts for i in range(0, max(len(p), 1), WINDOW_BYTES)]


class Scorer:
    """Compares window lengths under both dictionaries."""

    def __init__(self, model: Model):
        self.model = model
        parameters = zstandard.ZstdCompressionParameters(**PARAMETERS)
        self.by = []
        for content in (model.ordinary, model.toxic):
            shared = zstandard.ZstdCompressionDict(content)
            shared.precompute_compress(compression_params=parameters)
            self.by.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=parameters))

    def features(self, text: str) -> list[float]:
        parts = windows(text)
        ordinary, toxic = (c.compress for c in self.by)
        gain = np.array([len(ordinary(p)) - len(toxic(p)) for p in parts])
        out = [float(gain.max()), float(gain.mean()), float(np.log1p(len(parts)))]
        for least in GAINS:
            n = int((gain >= least).sum())
            out += [float(np.log1p(n)), n / (len(parts) + 2)]
        return out

    def __call__(self, text: str) -> float:
        x = (np.array(self.features(text)) - self.model.center) / self.model.scale
        z = float(self.model.weights[0] + x @ self.model.weights[1:])
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def dictionary(samples: list[bytes], size: int, **options) -> bytes:
    """A trained dictionary, or the samples themselves if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(samples)[:size]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, the constant first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


def family(words: list[str]) -> int:
    """The least hash of five words in a row, which near copies mostly share."""
    runs = range(max(len(words) - 4, 1))
    return min(zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in runs)


def grams(words: list[str]) -> set[str]:
    """The words, and the phrases of a few words, of a text."""
    return {" ".join(words[i : i + n]) for n in range(1, PHRASE + 1) for i in range(len(words) - n + 1)}


def chance(n: int, usual: int, share: float) -> float:
    """How probably ``n`` or more of ``n + usual`` texts are toxic if this share of all is.

    For marks every term is at most a fifth of the one before.
    """
    m = n + usual
    if share >= 1:
        return 1.0
    total = 0.0
    for k in range(n, min(m, n + 40) + 1):
        ways = math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
        total += math.exp(ways + k * math.log(share) + (m - k) * math.log1p(-share))
    return total


def chosen(used: dict[str, tuple[int, int]], tested: int, n_toxic: int, n_ordinary: int) -> set[str]:
    """Words and phrases that toxic families hold clearly more often than ordinary ones.

    ``used`` has the toxic and ordinary families of each. Among all ``tested``
    one may be marked by chance; there is no least share of the families.
    """
    share = n_toxic / (n_toxic + n_ordinary)
    return {
        g
        for g, (n, usual) in used.items()
        if n / n_toxic >= 5 * usual / max(n_ordinary, 1) and chance(n, usual, share) * tested < 1
    }


def marked(words: list[str], known: set[str]) -> list[bytes]:
    """The marked words and phrases of a text, as windows."""
    held = np.zeros(len(words), bool)
    for n in range(1, PHRASE + 1):
        for i in range(len(words) - n + 1):
            if " ".join(words[i : i + n]) in known:
                held[i : i + n] = True
    return [p for p in windows(" ".join(w for w, h in zip(words, held, strict=True) if h)) if len(p) >= 8]


def joined(plain: list[bytes], toxic: list[bytes], known: set[str]) -> Model:
    """The ordinary dictionary, trained on pieces of ordinary text, and the toxic one.

    The latter has the same base and a part trained on the marks in toxic
    texts, so windows differ in length by what is toxic in them. Marks that
    training left out are put before that part.
    """
    base = dictionary(plain, ORDINARY_BYTES) or b"        "
    room = 256 + max(256, ROOM * sum(len(w.encode()) + 1 for w in known))
    extra = dictionary(toxic, room, k=32, d=6)
    if extra[:4] == TRAINED:
        extra = extra[256:]  # tables stand in front of the text
    missing = sorted(w for w in known if w.encode() not in extra)
    extra = " ".join(["", *missing, ""]).encode() + extra
    return Model(base, base + extra, np.zeros(0), np.ones(0), np.zeros(1))


def text_rows(rows: DataFrame, function, schema: str) -> DataFrame:
    """What ``function`` of a row yields as lists of columns; one text is held at a time."""

    def run(batches):
        names, kinds = out.names, out.types
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                for columns in function(row):
                    arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    prepared(rows.sparkSession)
    out = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return rows.mapInArrow(run, schema)


def used_grams(rows: DataFrame) -> DataFrame:
    """``gram``, and the families of each label and half that hold it; two toxic ones at least."""

    def run(row):
        words = row["text"].lower().split()
        for i in range(0, len(words), STEP_WORDS):
            held = list(grams(words[i : i + STEP_WORDS + PHRASE - 1]))
            yield held, [row["toxic"]] * len(held), [row["family"]] * len(held)

    held = text_rows(rows, run, "gram string, toxic int, family long")
    counts = [
        F.count_if((F.col("toxic") == y) & (F.col("family") % 2 == half)).alias(f"n{y}{half}")
        for y in (0, 1)
        for half in (0, 1)
    ]
    held = held.repartition("gram").distinct().groupBy("gram").agg(*counts)
    return stored(held.filter(F.col("n10") + F.col("n11") > 1), "training-grams")


def all_marks(rows: DataFrame) -> list[set[str]]:
    """The words and phrases that mark toxic texts of each scope; near copies count once."""
    used = used_grams(rows)
    families = {tuple(r[:2]): r[2] for r in rows.groupBy("toxic", F.col("family") % 2).agg(F.countDistinct("family")).collect()}
    out = []
    for scope in SCOPES:
        halves = (0, 1) if scope == 2 else (scope,)
        n_ordinary, n_toxic = (sum(families.get((y, half), 0) for half in halves) for y in (0, 1))
        n, usual = (sum((F.col(f"n{y}{half}") for half in halves), F.lit(0)) for y in (1, 0))
        here = used.select("gram", n.alias("n"), usual.alias("usual")).filter("n > 1")
        tested = here.count()
        if not tested:
            out.append(set())
            continue
        # no mark is less likely by chance than one that ordinary texts never hold
        share = n_toxic / (n_toxic + n_ordinary)
        rare = F.col("n") * F.lit(math.log(share)) + F.lit(math.log(tested)) < 1e-6
        often = F.col("n") * F.lit(n_ordinary) >= F.lit(5 * n_toxic) * F.col("usual")
        found = {r.gram: (r.n, r.usual) for r in here.filter(rare & often).collect()}
        out.append(chosen(found, tested, n_toxic, n_ordinary))
    return out


def plain_pieces(rows: DataFrame) -> list[list[bytes]]:
    """Pieces of the ordinary texts of each half, drawn evenly over all pieces by hash."""
    rows = rows.filter("toxic = 0")
    total = dict(rows.groupBy(F.col("family") % 2).agg(F.sum(F.octet_length("text"))).collect())

    def run(row):
        data, half = row["text"].lower().encode(), row["family"] % 2
        # somewhat more than are used, as the draw varies
        limit = 1.1 * PIECES * PIECE_BYTES / max(total[half], 1) * 2**32
        at = range(0, len(data), PIECE_BYTES)
        own = [data[i : i + PIECE_BYTES] for i in at if zlib.crc32(f"{row['key']} {i}".encode()) < limit]
        yield [half] * len(own), own

    out: list[list[bytes]] = [[], []]
    for r in text_rows(rows, run, "half int, piece binary").collect():
        out[r.half].append(bytes(r.piece))
    return out


def marked_pieces(rows: DataFrame, known: list[set[str]]) -> list[list[bytes]]:
    """Windows of marks for each scope, in one text of each family of near copies."""
    toxic = rows.filter("toxic = 1")
    first = toxic.groupBy("family").agg(F.min("key").alias("key")).select("key")
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(known))

    def run(row):
        words = row["text"].lower().split()
        for scope in (row["family"] % 2, 2):
            own = marked(words, unpacked(shared, pickle.loads)[scope])
            yield [scope] * len(own), own

    found = stored(text_rows(toxic.join(F.broadcast(first), "key", "left_semi"), run, "scope int, piece binary"), "marked")
    total = dict(found.groupBy("scope").count().collect())
    limit = F.lit(0)
    for scope, n in total.items():
        limit = F.when(F.col("scope") == scope, int(1.1 * PIECES / n * 2**32)).otherwise(limit)
    out: list[list[bytes]] = [[], [], []]
    # equal pieces stay or go together
    for r in found.filter(F.crc32("piece") < limit).collect():
        out[r.scope].append(bytes(r.piece))
    return out


def drawn(pieces: list[bytes]) -> list[bytes]:
    """At most so many pieces as a dictionary is trained on, in an order that the pieces decide."""
    pieces = sorted(pieces)
    random.Random(0).shuffle(pieces)
    return pieces[:PIECES]


def fit(rows: DataFrame, offset: float = 0.0) -> Model:
    """A model of labelled texts ``key, toxic, family, text``.

    The weights are calibrated on texts that the dictionaries in use have not
    seen: each half, by family of near copies, is scored with dictionaries of
    the other. The final ones are trained on all. Words, windows and features
    are made of whole texts in tasks; counts, drawn pieces and features reach
    the driver. ``offset`` is what the log odds of the labels lack by the draw
    of the rows. With one label alone the score is its smoothed share.
    """
    known = all_marks(rows)
    plain, toxic = plain_pieces(rows), marked_pieces(rows, known)
    models = [
        joined(drawn(plain[k] if k < 2 else plain[0] + plain[1]), drawn(toxic[k]), known[k]) for k in SCOPES
    ]
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(models[:2]))

    def run(row):
        scorer = unpacked(shared, load_all)[1 - row["family"] % 2]
        yield [row["toxic"]], [row["key"]], [scorer.features(row["text"])]

    found = text_rows(rows, run, "toxic int, key string, features array<double>").collect()
    found.sort(key=lambda r: r.key)
    x = np.array([r.features for r in found] or [FLAT])
    y = np.array([r.toxic for r in found] or [0], float)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = logistic((x - center) / scale, y)
    if not 0 < y.sum() < len(y):
        weights[:] = 0
        weights[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    weights[0] += offset
    return models[2]._replace(center=center, scale=scale, weights=weights)


def is_held_out(doc_id: Column) -> Column:
    """The fold that no model learns from; a null doc_id is in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, doc_id, toxic`` of every distinct labelled text outside the held-out fold.

    ``key`` is the md5 of the text. Copies are one row, that of the least hash of the id.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id"))).select("doc_id", "toxic")
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("key"))
    least = F.min(F.struct(F.xxhash64("doc_id"), "doc_id", "toxic")).alias("least")
    return texts.join(known.distinct(), "doc_id").groupBy("key").agg(least).select("key", "least.doc_id", "least.toxic")


def training_sample(
    docs: DataFrame, labels: DataFrame, quotas: tuple[int, int] = (ORDINARY_SAMPLE, TOXIC_SAMPLE)
) -> tuple[DataFrame, float]:
    """At most so many texts of each label, by least key, and the offset of their log odds.

    A quota that binds changes the rate of its label; the offset is the log odds
    over all training texts less those of the sample.
    """
    known = stored(training_texts(docs, labels), "training-texts")
    counted = dict(known.groupBy("toxic").count().collect())

    def first(toxic: int) -> DataFrame:
        return known.filter(F.col("toxic") == toxic).orderBy("key").limit(quotas[toxic])

    # share of a label that is not drawn; without one label there are no odds
    left_out = [np.log(max(counted.get(k, 0), 1) / max(min(counted.get(k, 0), quotas[k]), 1)) for k in (0, 1)]
    offset = float(left_out[1] - left_out[0]) if len(counted) == 2 else 0.0
    return first(1).unionByName(first(0)), offset


def training_rows(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``key, toxic, family, text`` of a sample; texts are whole."""
    texts = docs.select("doc_id", F.md5("text").alias("key"), "text")
    rows = texts.join(F.broadcast(sample), ["doc_id", "key"]).dropDuplicates(["key"])
    rows = rows.select("key", F.col("toxic").cast("int").alias("toxic"), "text")

    def run(row):
        yield [row["key"]], [row["toxic"]], [family(row["text"].lower().split())], [row["text"]]

    return stored(text_rows(rows, run, "key string, toxic int, family long, text string"), "training-rows")


def train(docs: DataFrame, labels: DataFrame, quotas: tuple[int, int] = (ORDINARY_SAMPLE, TOXIC_SAMPLE)) -> Model:
    """A model fitted on at most ``quotas`` ordinary and toxic texts, calibrated to the rate of all."""
    prepared(docs.sparkSession)
    sample, offset = training_sample(docs, labels, quotas)
    return fit(training_rows(docs, sample), offset)


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1) and ``predicted``.

    Whole texts are scored, window by window; null and empty texts score like an
    empty window. Equal texts have equal scores. Input columns of the added
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = docs.drop("score", "predicted")

    def run(batch):
        scorer = unpacked(shared, load)
        texts = batch.column("text")
        scores = [scorer(texts[k].as_py() or "") for k in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    scored = each_batch(rows, run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def load(data: bytes) -> Scorer:
    return Scorer(pickle.loads(data))


def load_all(data: bytes) -> list[Scorer]:
    return [Scorer(model) for model in pickle.loads(data)]
