"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldwarden.llm import (
    components,
    fm_index,
    hyperminhash,
    line_dedup,
    packing,
    range_join,
    ring,
    snapshots,
    token_counts,
    toxicity,
    warc,
)
from fieldwarden.llm.queries import ORACLES
from workload.compare import duckdb_rows, spark_rows

LONG = " ".join(f"w{k}" for k in range(30_000))
LINE = "This line is long enough to be counted as shared."
MIXED = [(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (2, None), (3, ""), (4, LONG), (5, " \n\t "), (6, "日本語 é")]
CLASH = "key"


@pytest.fixture(scope="module")
def mixed(documents):
    return documents(MIXED, CLASH)


@pytest.fixture(scope="module")
def empty(documents):
    return documents([], CLASH)


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, LONG[:60]), (2, None), (None, "a b"), (3, ""), (4, "..")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_lines(documents, empty, rows):
    six = [(i, f"own {i}\n  {LINE.upper()} \n{LINE}") for i in (1, 2, 3, 3, None, 9, 4)]
    clashing = {c: F.lit(1) for c in ("key", "_doc", "_gone", "_lines", "c0")}
    docs = documents([*six, (10, None), (11, ""), (12, "x\n")], "kept_text").withColumns(clashing)
    got = line_dedup.drop_shared_lines(docs)
    out = {(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()}
    assert got.count() == 10 and set(clashing) <= set(got.columns)
    assert (9, six[5][1], 3, 0) in out and (1, "own 1", 3, 2) in out and (None, "own None", 3, 2) in out
    assert {(10, "", 1, 0), (11, "", 1, 0), (12, "x\n", 2, 0)} <= out
    assert line_dedup.drop_shared_lines(empty).count() == 0
    alone = documents([(None, LINE)] * 6)
    assert {r.n_dropped for r in line_dedup.drop_shared_lines(alone).collect()} == {0}


def test_repeated_rows_are_one_document(documents):
    # four rows of one document and three others: four documents hold the line, not seven
    few = documents([(i, LINE) for i in (1, 1, 1, 1, 2, 3, 4)])
    assert {r.n_dropped for r in line_dedup.drop_shared_lines(few).collect()} == {0}
    # a doc_id with unlike texts loses the line where it stands
    rows = [(1, LINE), (1, f"a\n{LINE}"), (1, f"a\n{LINE}"), *((i, LINE) for i in (2, 3, 4, 5))]
    got = sorted((r.doc_id, r.kept_text) for r in line_dedup.drop_shared_lines(documents(rows)).collect())
    assert got == [(1, ""), (1, "a"), (1, "a"), (2, ""), (3, ""), (4, ""), (5, LINE)]


def test_many_shared_lines_in_a_document(documents):
    many = [f"{LINE} {k}" for k in range(20_000)]
    mixed = [line for k, line in enumerate(many) for line in ([f"own {k}", line] if k % 2 else [line])]
    rows = [*((i, "\n".join(many)) for i in range(5)), (-1, "\n".join(mixed))]
    got = {r.doc_id: r for r in line_dedup.drop_shared_lines(documents(rows)).collect()}
    assert got[4].n_dropped == 0 and got[0].kept_text == "" and got[0].n_dropped == 20_000
    assert got[-1].kept_text == "\n".join(f"own {k}" for k in range(1, 20_000, 2))


def test_sql_agrees_on_repeated_rows_and_nulls(spark, documents):
    con = duckdb.connect()
    rows = [(1, LINE), (1, LINE), (2, f"x\n{LINE}"), (3, LINE), (4, LINE), (None, LINE), (None, None), (9, LINE), (9, "")]
    docs = documents(rows)
    con.register("documents", docs.toPandas())
    own = line_dedup.drop_shared_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )
    names, ours = spark_rows(own)
    assert (names, ours) == tuple(duckdb_rows(con, ORACLES["op6_line_dedup"]))
    turns = [(1, 0, "u", None), (2, 0, "u", ""), (3, 0, None, "a"), (3, 1, "u", "b"), (4, 0, None, "a")]
    talks = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    con.register("conversations", talks.toPandas())
    names, ours = spark_rows(snapshots.collapse_snapshots(talks))
    assert (names, ours) == tuple(duckdb_rows(con, ORACLES["op3_snapshots"]))


def test_shards(mixed, empty):
    carry = {"doc_id": F.col("doc_id"), "cell": F.col("key")}
    got = ring.ring_shards(mixed, ["doc_id"], carry, 4).collect()
    assert len(got) == len(MIXED) and {r.shard for r in got} == {0, 1, 2, 3}
    assert ring.ring_shards(empty, ["doc_id"], carry, 4).count() == 0


def test_full_shards_flow_clockwise_and_moves_are_few():
    owners = ring.ring_owners(5)
    counts = {c: random.Random(c).randint(0, 9) for c in range(ring.CELLS)}
    pieces = ring.flow(counts, 5, owners)
    load = [sum(p["high"] - p["low"] for p in pieces if p["shard"] == s) for s in range(5)]
    assert sum(load) == sum(counts.values()) and max(load) - min(load) <= 1
    at_home = sum(p["high"] - p["low"] for p in pieces if owners[p["cell"]][0] == p["shard"])
    assert at_home > 0.75 * sum(load)


def test_snapshots(spark, rows):
    def turns(conv, *texts, start=0):
        return [(conv, start + 2 * i, "user", t) for i, t in enumerate(texts)]

    given = [
        *turns(1, "a", "b"),
        *turns(2, "a", "b", "c", start=7),
        *turns(3, "a", "b", "c"),
        *turns(4, "a", None),
        *turns(5, "a", ""),
        *turns(None, "z"),
        *turns(6, *[str(k) for k in range(1200)]),
        *turns(7, *[str(k) for k in range(1100)]),
        (8, None, None, "x"),
        (8, None, None, "x"),
    ]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    df = df.withColumn("block", F.lit("clash"))
    got = snapshots.collapse_snapshots(df)
    kept = {(r.conv_id, r.n_turns, r.n_equal) for r in got.collect()}
    assert kept == {(2, 3, 2), (4, 2, 1), (5, 2, 1), (None, 1, 1), (6, 1200, 1), (8, 2, 1)}
    parts = {r.part: r.rendered for r in got.filter("conv_id = 6").collect()}
    assert sorted(parts) == [0, 1, 2, 3, 4]
    text = "".join(parts[k] for k in sorted(parts))
    assert text == "".join(f"<|user|>\n{k}\n<|end|>\n" for k in range(1200))
    assert snapshots.collapse_snapshots(df.limit(0)).count() == 0


def test_passages(mixed, empty, bench, documents):
    got = fm_index.passage_digest(fm_index.find_passages(mixed, bench))
    hits = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in got.collect())
    assert ("1", 2, 2, 1) in hits and hits.count(("None", 2, 2, 1)) == 1 and len(hits) == len(MIXED)
    long = next(r for r in got.collect() if r.doc_id == 4)
    assert long.n_hit > 10 and long.n_words == 30_000
    assert fm_index.find_passages(empty, bench).count() == 0
    assert fm_index.find_passages(mixed, bench.limit(0)).filter(F.size("items") > 0).count() == 0
    # in blocks the result is the same
    blocks = fm_index.passage_digest(fm_index.find_passages(mixed, bench, block_bytes=30))
    assert sorted(map(str, blocks.collect())) == sorted(map(str, got.collect()))


def test_passages_are_cut_out(documents, spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    words = item.split()
    nested = " ".join([*words[:5], item, *words[5:]])
    docs = documents([(1, f"Before. {item.upper()}, after"), (2, item), (3, "clean text"), (4, None), (5, nested)], "doc")
    got = {r.doc_id: (r.text, r.n_chars, r.doc) for r in fm_index.remove_passages(docs, bench).collect()}
    assert got == {1: ("Before. , after", 15, "x"), 3: ("clean text", 10, "x"), 4: (None, 0, "x")}


def test_cut_passages_do_not_depend_on_blocks(documents, spark):
    rng = random.Random(8)
    items = [" ".join(rng.choice("abcdef") for _ in range(5)) for _ in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    given = [(k, " ".join(rng.choice("abcdefg") for _ in range(150))) for k in range(60)]
    given += [(100, None), (101, ""), (102, items[0])]
    docs = documents(given, "doc")

    def cut(block_bytes):
        return sorted(map(str, fm_index.remove_passages(docs, bench, 3, block_bytes).collect()))

    whole = cut(1 << 20)
    assert sum("g" in r for r in whole) >= 60 and cut(30) == whole and cut(60) == whole


def test_passages_like_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 80))]
        items = [" ".join(rng.choice("abce") for _ in range(rng.randint(0, 7))) for _ in range(6)]
        phrases = fm_index.Phrases(items, [str(k) for k in range(6)], window=4)
        joined = pa.array([" ".join(text[:30]), "", " ".join(text[30:])])
        words, hit, pairs = fm_index.search_batch(joined, phrases)
        expected, found = set(), set()
        for doc, (base, part) in enumerate([(0, text[:30]), (30, []), (min(30, len(text)), text[30:])]):
            for k, item in enumerate(items):
                own = item.split()
                for i in range(max(len(own) - 3, min(len(own), 1))):
                    window = own[i : i + 4]
                    for at in range(len(part) - len(window) + 1):
                        if part[at : at + len(window)] == window:
                            expected.update(range(base + at, base + at + len(window)))
                            found.add((doc, str(k)))
        assert set(np.flatnonzero(hit).tolist()) == expected
        assert {(d, phrases.names[n]) for d, n in pairs.tolist()} == found


def test_packing(mixed, empty):
    got = packing.pack_documents(mixed).collect()
    assert {r.doc_id for r in got} == {1, None, 2, 3, 4, 5, 6}
    assert sum(r.length for r in got if r.doc_id == 3) == 1
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 4)
    assert all(n == 2048 for _, _, n in long[1:]) and long[0][2] <= 2048
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(places) == len(got)
    assert packing.pack_documents(empty).count() == 0


def test_encoder_like_the_tokenizer():
    rng = random.Random(2)
    signs = ["a", "é", "Z", "1", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", ".", "×", "中", "\xa0", "\x1c", "<|", "<|endoftext|>", "_", "ɏ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + [None, LONG]
    ids, cuts = packing.encoder(packing.TOKENIZER, packing.RANKS)(pa.array(texts))
    plain = Tokenizer.from_file(packing.TOKENIZER)
    for k, text in enumerate(texts):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_bins_hold_every_piece_once():
    rng = random.Random(1)
    counts = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(30)}
    bins = packing.best_two_fit(counts, 50)
    held = {}
    for lengths, times in bins:
        assert sum(lengths) <= 50
        for n in lengths:
            held[n] = held.get(n, 0) + times
    assert held == counts
    assert packing.best_two_fit({}, 50) == []


def test_token_counts(mixed, empty):
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(mixed).collect())
    assert len(got) == len(MIXED) and ("2", 0) in got and ("3", 0) in got
    assert token_counts.token_counts(empty).count() == 0


def test_near_documents(documents, empty, rows):
    base = " ".join(f"t{k}" for k in range(60))
    near = base.replace("t59", "other")
    given = [(5, base), (3, base.upper()), (9, near), (7, None), (8, ""), (2, "a b"), (4, "A  b"), (4, "A  b"), (None, base), (1, LONG)]
    got = hyperminhash.near_duplicates(documents(given, "doc")).collect()
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got)
    assert out == sorted(
        [
            ("5", 56, "3", False),
            ("3", 56, "3", True),
            ("9", 56, "3", False),
            ("7", 0, "7", True),
            ("8", 0, "8", True),
            ("2", 1, "2", True),
            ("4", 1, "2", False),
            ("4", 1, "2", False),
            ("None", 56, "None", True),
            ("1", 29_996, "1", True),
        ]
    )
    assert hyperminhash.near_duplicates(empty).count() == 0


def test_links_that_the_first_round_leaves(documents):
    """A chain of near copies: the ends are not similar to each other."""
    words = [f"c{k}" for k in range(200)]
    texts = []
    for k in range(12):
        words[k * 4 : k * 4 + 4] = [f"n{k}{j}" for j in range(4)]
        texts.append((100 - k, " ".join(words)))
    got = hyperminhash.near_duplicates(documents(texts)).collect()
    assert {r.component_id for r in got} == {89}


def test_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.75, 0.95):
        values = []
        for _ in range(40):
            pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
            n = int(1000 * (1 + share) / 2 / share * share * 2 / (1 + share))
            a, b = np.unique(pool[:1000]), np.unique(np.concatenate([pool[: int(2000 * share / (1 + share))], pool[1000 : 1000 + 1000 - int(2000 * share / (1 + share))]]))
            regs = hyperminhash.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            values.append(hyperminhash.estimate(regs[0], regs[1], len(a), len(b))[0])
            assert n > 0
        assert abs(np.mean(values) - share) < 0.03


def test_vectors(spark):
    one = [1.0, 0.0]
    given = [(1, one, 0), (2, [2.0, 0.0], 0), (2, one, 0), (3, one, None), (4, None, 0), (5, [0.0, 0.0], 0)]
    given += [(6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (8, [1.0, 0.0, 0.0], 0), (None, one, 0), (9, [float("inf"), 1.0], 0), (10, [-1.0, 0.0], 0)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit(1))
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in range_join.near_vectors(df).collect())
    alone = [(str(k), 0, str(k), True) for k in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert [x for x in got if x[0] not in {"1", "2"}] == sorted([*alone, ("None", 0, "None", True)])
    assert [(x[0], x[2], x[3]) for x in got if x[0] in {"1", "2"}] == [("1", "1", True), ("2", "1", False), ("2", "1", False)]
    assert range_join.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 100), (7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components.components(df, "a", "b").collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 200: 100}
    assert components.components(df.limit(0), "a", "b").count() == 0


def test_archives(spark, tmp_path):
    big, small = "<p>é</p>" * 400, "tiny"
    given = [(1, "http://x", big), (2, None, big), (2, "http://y\r\nEvil: 1", big), (3, "u", small), (4, "u", small)]
    given += [(5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "x" * 3_000_000)]
    df = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("_sha", F.lit("clash"))
    got = warc.archived_pages(df).collect()
    out = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got}
    size = len(big.encode())
    assert len(got) == len(given)
    assert {(1, size, "revisit", 2), (2, size, "response", None), (None, size, "revisit", 2)} <= out
    assert {(3, 4, "response", None), (4, 4, "response", None), (5, 0, "response", None), (7, 3_000_000, "response", None)} <= out
    assert {r.payload_digest for r in got if r.page_id == 1} == {hashlib.sha1(big.encode()).hexdigest()}
    assert warc.archived_pages(df.limit(0)).count() == 0
    path = str(tmp_path / "w")
    warc.write_archives(df, path)
    texts = {bytes(r.payload).decode() for r in warc.read_archives(spark, path).filter("payload is not null").collect()}
    assert texts == {big, small, "", "x" * 3_000_000}


def test_broken_archives():
    record = warc.header("resource", [("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "1970-01-01T00:00:00Z")], b"block")
    samples = [f"sample {k} of some words".encode() * 9 for k in range(200)]
    content = zstandard.train_dictionary(2048, samples)
    pack = zstandard.ZstdCompressor(dict_data=content)
    for stored in (content.as_bytes(), zstandard.ZstdCompressor().compress(content.as_bytes())):
        front = struct.pack("<II", warc.DICTIONARY_FRAME, len(stored)) + stored
        good = front + pack.compress(record) + pack.compress(record)
        assert [r["type"] for r in warc.read_archive(good)] == ["resource"] * 2
        for bad in (good[:-3], front[:-5], good + b"noise!!!!", front + front, b"\x00" * 20):
            with pytest.raises(warc.WarcError):
                list(warc.read_archive(bad))
    plain = zstandard.ZstdCompressor()
    for bad in (record[:-4], record.replace(b"Length: 5", b"Length: 6"), record.replace(b"WARC/1.1", b"HTTP/1.1"), record.replace(b"WARC-Date", b"X")):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(plain.compress(bad)))


def test_toxicity(documents, spark, mixed, empty):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    given, labelled = [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = [word() for _ in range(60)]
        if toxic:
            words[10:50:8] = ["horrible"] * 5
        given.append((k, " ".join(words)))
        labelled.append((k, int(toxic)))
    labels = spark.createDataFrame([*labelled, (None, 1), (5000, None)], "doc_id long, toxic int")
    docs = documents(given, "score")
    model = toxicity.train(docs, labels)
    got = toxicity.toxicity(docs, model).filter(toxicity.is_held_out(F.col("doc_id"))).collect()
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in got)
    assert right >= 0.95 * len(got)
    scores = toxicity.toxicity(mixed, model).collect()
    assert len(scores) == len(MIXED) and all(0 <= r.score <= 1 and r.key == "x" for r in scores)
    assert toxicity.toxicity(empty, model).count() == 0
    for few in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        scores = toxicity.toxicity(mixed, toxicity.train(docs, few)).collect()
        assert len({r.score for r in scores}) == 1


def test_toxicity_keeps_the_label_rate(documents, spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    # the mark is no proof: of the marked texts one in four is toxic
    given, labelled = [], []
    for k in range(1200):
        words = [word() for _ in range(40)]
        if k % 5 == 0:
            words[10:30:8] = ["horrible"] * 3
        given.append((k, " ".join(words)))
        labelled.append((k, int(k % 20 == 0)))
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    docs = documents(given)
    mean = lambda model: toxicity.toxicity(docs, model).agg(F.avg("score")).first()[0]
    free, bound = toxicity.train(docs, labels), toxicity.train(docs, labels, quotas=(40, 40))
    assert toxicity.training_sample(docs, labels)[1] == 0
    assert abs(mean(free) - 0.05) < 0.02
    assert mean(bound) < 0.15


def test_toxicity_learns_rare_words_and_phrases(documents, spark):
    rng = random.Random(6)
    usual = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    phrase = " ".join(usual[:3])
    one = [rng.choice(usual) for _ in range(60)]
    given, labelled = [], []
    for k in range(2400):
        words = [rng.choice(usual) for _ in range(60)]
        if k % 2:  # near copies of one toxic text
            words = [*one, f"copy{k}"]
        elif k < 400:  # words in a few texts each, and a phrase of ordinary words
            words[20] = f"vile{k % 20 // 2}x"
        elif k < 500:
            words[20:50:10] = [phrase] * 3
        given.append((k, " ".join(words)))
        labelled.append((k, int(k % 2 or k < 500)))
    docs = documents(given)
    model = toxicity.train(docs, spark.createDataFrame(labelled, "doc_id long, toxic int"))
    assert all(f"vile{k}x".encode() in model.toxic for k in range(10))
    assert phrase.encode() in model.toxic


def test_toxicity_learns_from_whole_texts(documents, spark):
    rng = random.Random(7)
    usual = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    given, labelled = [], []
    for k in range(160):
        words = [rng.choice(usual) for _ in range(2000)]
        if k % 4 == 0:  # behind 10,000 characters
            words[1900:1990:20] = ["horrible"] * 5
        given.append((k, " ".join(words)))
        labelled.append((k, int(k % 4 == 0)))
    docs = documents(given)
    model = toxicity.train(docs, spark.createDataFrame(labelled, "doc_id long, toxic int"))
    assert b"horrible" in model.toxic
    got = toxicity.toxicity(docs, model).filter(toxicity.is_held_out(F.col("doc_id"))).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got)


def test_pipeline(spark, tmp_path, mixed, empty):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for case in (docs, docs.unionByName(docs.limit(20)), mixed, empty):
        now = case
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, sf)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == case.columns
            path = str(tmp_path / f"{id(case)}-{k}")
            out.write.parquet(path)
            now = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, sf).count() > 100


OWN_NAMES = ["_doc", "_gone", "_cut", "_spans", "_open", "_lines", "kept", "score", "predicted", "kept_text", "n_dropped", "key"]


def test_lengths_of_very_many_pieces_are_cut_into_more_groups():
    salts = packing.salts_of({3: 10, 2048: 10**10}, 2048)
    assert len(salts) == 2049 and salts[3] == salts[0] == packing.SALT
    assert 10**10 / salts[2048] <= packing.GROUP


def test_stages_keep_columns_of_any_name(spark, mixed):
    sf = "/root/testdata/sf0.001"
    clashing = mixed.drop("key").withColumns({c: F.lit(f"own {c}") for c in OWN_NAMES})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, sf)
        assert out.columns == clashing.columns
        for r in out.collect():
            assert [r[c] for c in OWN_NAMES] == [f"own {c}" for c in OWN_NAMES]


def test_near_dedup_stage_leaves_one_row_of_a_group(spark, documents):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(7, text), (7, text), (8, text), (9, f"{text} more"), (10, "other"), (None, text), (None, "b"), (11, None)]
    out = corpus_pipeline.drop_near_copies(spark, documents(rows), "")
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(7, text), (10, "other"), (11, None), (None, text), (None, "b")], key=repr)


def test_pipeline_against_plain_stages(spark):
    """Each stage on its own input: what must go is gone, what is clean stays as it is."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def rows(df):
        return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    given = rows(docs)
    keys = {i: [k.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER) for k in (t or "").split("\n")] for i, t in given.items()}
    holders = {}
    for i, ks in keys.items():
        for k in ks:
            if len(k) >= 40:
                holders.setdefault(k, set()).add(i)
    doomed = {k: max(h) for k, h in holders.items() if len(h) >= 5}
    expected = {
        i: t if t is None else "\n".join(x for x, k in zip(t.split("\n"), keys[i], strict=True) if doomed.get(k, i) == i)
        for i, t in given.items()
    }
    assert rows(stages["line dedup"](spark, docs, sf)) == expected

    kept = rows(stages["near dedup"](spark, docs, sf))
    assert kept == {i: t for i, t in given.items() if i in kept}
    component = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(docs).collect()}
    assert set(kept) == {i for i, c in component.items() if i == c}

    cut = rows(stages["decontamination"](spark, docs, sf))
    hit = {r.doc_id: r.contaminated for r in fm_index.passage_digest(fm_index.find_passages(docs, bench)).collect()}
    assert all(cut[i] == t for i, t in given.items() if not hit[i])
    again = docs.select("doc_id").join(stages["decontamination"](spark, docs, sf).select("doc_id", "text"), "doc_id")
    assert not any(r.contaminated for r in fm_index.passage_digest(fm_index.find_passages(again, bench)).collect())

    pieces = stages["packing"](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == set(given)


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
