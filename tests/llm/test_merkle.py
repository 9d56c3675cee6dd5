"""The manifest against a plain tree in memory."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldwarden.llm.merkle import manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    fields = (row[0], row[3], row[2], row[4], row[1])
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_tree(nodes):
    """All levels, and the proof of each node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])

    def proof(k):
        return [(level[(k >> i) ^ 1 : ((k >> i) ^ 1) + 1], (k >> i) & 1) for i, level in enumerate(levels[:-1])]

    return levels[-1][0], [proof(k) for k in range(len(nodes))]


def plain_manifest(rows, changed):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: sorted(trees[t], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for t in order}
    roots = {t: plain_tree([plain_leaf(r) for r in built[t]]) for t in order}
    root, above = plain_tree([roots[t][0] for t in order])
    out = []
    for t, upper in zip(order, above, strict=True):
        for r, lower in zip(built[t], roots[t][1], strict=True):
            seen = plain_leaf(changed(r))
            for sibling, side in lower + upper:
                other = sibling[0] if sibling else ""
                seen = digest(other + seen if side else seen + other)
            proof = "".join(s[0] for s, _ in lower + upper if s)
            out.append((r[0], plain_leaf(r), roots[t][0], root, proof, seen, seen == root))
    return sorted(out, key=repr)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
RESULT = ["key", "leaf", "subroot", "root", "proof", "folded_root", "verified"]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 1}, {"de": 1, "en": 1, "": 1}, {"de": 37, "en": 200, None: 9, "é": 64, "z": 65}])
def test_against_a_plain_tree(spark, sizes):
    pick = random.Random(7)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = pick.choice([None, "", "é\n" * pick.randrange(9), "x" * 5000])
            rows.append((len(rows) * 3 % 1009, text, lang, pick.choice([None, "s", "1:"]), pick.choice([None, 0, 12])))
    pick.shuffle(rows)

    def changed(r):
        return (*r[:4], None if r[4] is None else r[4] + (r[0] % 5 == 0))

    observed = {"n_chars": F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({"pos": F.lit("x"), "digest": F.lit(1), "name": F.lit(2)})
    for levels in (2, 12):
        got = manifest(docs, observed=observed, levels=levels).select(*RESULT).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows, changed)


def test_null_and_repeated_keys(spark):
    rows = [(None, "a", "en", "s", 1), (None, "a", "en", "s", 1), (4, "b", "en", "s", 1), (4, "c", "en", "s", 1), (4, "b", "en", "s", 1)]
    got = manifest(spark.createDataFrame(rows, COLUMNS), levels=1).select(*RESULT).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows, lambda r: r)


def test_no_rows(spark):
    assert manifest(spark.createDataFrame([], COLUMNS)).collect() == []
