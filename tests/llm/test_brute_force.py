"""Every query that SQL cannot express, against a plain version over a whole table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from fieldwarden.llm import packing, token_counts, toxicity
from fieldwarden.llm.queries import QUERIES
from fieldwarden.llm.range_join import near_vectors

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def closed(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_passages(spark, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(lowered(r.text))
        for i in range(max(len(w) - 9, min(len(w), 1))):
            windows[tuple(w[i : i + 10])].add(str(r.item_id))
    sizes = {len(w) for w in windows}
    got = {r["doc_id"]: r for r in result(spark, "op4_decontaminate")}
    assert set(got) == set(texts)
    some = 0
    for i, text in texts.items():
        w = word.findall(lowered(text))
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit.update(range(k, k + n))
                    items |= found
        some += bool(hit)
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert got[i] == {
            "doc_id": i,
            "n_words": len(w),
            "n_hit": len(hit),
            "n_items": len(items),
            "items_sha256": digest,
            "contaminated": bool(hit),
        }
    assert some > 3


def test_packing(spark, texts):
    tok = Tokenizer.from_file(packing.TOKENIZER)
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in result(spark, "op5_pack"):
        got[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(got[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            data = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(data)
            at += r["length"]
        assert at == len(ids)
        if len(ids) > 2048:
            assert all(r["length"] == 2048 for r in got[i] if r["piece"])
        else:
            assert len(got[i]) == 1
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(n for p in bins.values() for _, n in p)
    assert len(bins) <= -(-total // 2048) * 1.01 + 2


def test_token_counts(spark, texts):
    pieces = token_counts.vocabulary()
    unigram = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    for r in result(spark, "op7_token_counts"):
        text = texts[r["doc_id"]] or ""
        expected = len(unigram.encode("▁" + text.replace(" ", "▁")).ids) if text else 0
        assert r["n_tokens"] == expected, text[:100]


def test_shards(spark, texts):
    got = result(spark, "op8_ring")
    assert Counter(r["doc_id"] for r in got) == Counter(list(texts))
    slots = defaultdict(list)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "rows")
        assert r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(40))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_vectors(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    noise = np.random.default_rng(5)
    rows = [(r.vec_id, list(r.embedding), r.label % 2) for r in given]
    for k in range(400):
        near = np.array(given[k % 60].embedding) + noise.normal(0, 0.03 * (1 + k % 3), 64)
        rows.append((10_000 + k, [float(x) for x in near], given[k % 60].label % 2))
    rows += [(20_000 + k, list(given[k % 3].embedding), given[k % 3].label % 2) for k in range(40)]
    unit = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    label = {i: y for i, _, y in rows}
    ids = sorted(unit)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    degree, parts = Counter(x for pair in links for x in pair), closed(ids, links)
    assert len(links) > 500
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for cell, block in ((4000, 2048), (50, 2048), (100, 30)):
        got = near_vectors(df, cell=cell, block=block).collect()
        assert len(got) == len(ids)
        for r in got:
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], parts[i], parts[i] == i)


def test_near_documents(spark, texts):
    space = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, text in texts.items():
        w = space.findall(lowered(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for h in holders.values() if len(h) < 300 for n, a in enumerate(h) for b in h[n + 1 :])
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    parts = closed(texts, links)
    assert len(links) > 10
    got = result(spark, "op10_hyperminhash")
    assert len(got) == len(texts)
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), parts[i], parts[i] == i)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op2_toxicity"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.THRESHOLD)
    held = [(r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    toxic, plain = ([s for s, y in held if y == k] for k in (1, 0))
    better = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in plain])
    assert better > 0.9
    assert np.mean([s < 0.3 for s in plain]) > 0.95
