"""Base spans against plain regular expressions; added spans by what was planted."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldwarden.llm import pii
from fieldwarden.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def plain_base(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if passes(kind, m.group())
    ]


def as_list(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(text, row):
    base = plain_base(text)
    counts = tuple(sum(k == kind for k, *_ in base) for kind in PATTERNS)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == counts, text
    assert row.base_sha256 == hashlib.sha256(as_list(base).encode()).hexdigest(), text
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(",") if s)]
    assert set(base) <= set(spans)
    assert spans == sorted(spans, key=lambda s: (list(PATTERNS).index(s[0]), *s[1:]))
    return [s for s in spans if s not in base]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_pii"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    added = [(r.doc_id, s) for r in got for s in check(texts[r.doc_id], r)]
    # two cards, or a phone and an address, that the base reads as one run
    shapes = {re.sub("[0-9]", "9", texts[i][a:b]) for i, (_, a, b) in added}
    assert shapes <= {"9999999999999999", "+9 (999) 999-9999"}, shapes


STRANGE = [
    None, "", "a@b", "a@b.c@d.e", "a@b.c_d@e.f..x@y.z", "x" * 50_000, "x" * 20_000 + "@" + "y" * 20_000, "1" * 50_000,
    "1." * 30_000, "1 " * 30_000, "a." * 20_000 + "@b" + ".c" * 20_000, "+1" + " (" * 20_000, "+1-" * 9_000, "256.1.1.1.1.1.1.1",
    "1.2.3.4.5.6.7.8", "001.0002.3.0255", "0000.1.2.3", "9" * 40 + ".1.1.1", "4111 1111-1111 1111", "4111111111111111 5500005555555559",
    "4111  1111 1111 1111", "+1 (017) 555-7713 161.17.88.162", "+49 30 1234567", "+1 234", "+12345678901234567", "é🙂a@b.co🙂 1.2.3.4",
    "\x01a@b.c\x02\n$1 a@b.c", "-1-2-3-4111111111111111-", "call +1+1 555 555 5555", "0" * 16, "4111-1111-1111-1111- 4111111111111111",
]


def test_strange_texts(spark, documents):
    pick = random.Random(5)
    texts = [*STRANGE, *("".join(pick.choices("01+ -.()@aé_%\n5", k=60)) for _ in range(3000))]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = documents(rows).withColumns({c: F.lit("x") for c in ("uid", "hits", "kind", "base", "spans", "found")})
    for r in pii.pii_digest(docs.repartition(4)).collect():
        check(texts[r.doc_id], r)


def test_repeated_rows_null_ids_and_no_rows(spark, documents):
    rows = [(None, "a@b.c"), (None, "a@b.c"), (3, None), (3, "1.2.3.4")]
    got = sorted((str(r.doc_id), r.spans) for r in pii.pii_digest(documents(rows)).collect())
    assert got == [("3", ""), ("3", "ip:0:7"), ("None", "email:0:5"), ("None", "email:0:5")]
    assert pii.pii_digest(documents([])).collect() == []


def card(pick):
    body = "4" + "".join(pick.choices("0123456789", k=14))
    return next(body + d for d in "0123456789" if luhn(body + d))


@pytest.fixture(scope="module")
def planted(documents):
    """Half the texts hold plain forms; some hold forms that only the trees can see."""
    pick, rows, wanted = random.Random(9), [], {}
    words = ["the", "of", "river", "stone", "when", "order", "page"]
    for i in range(2400):
        text = " ".join(pick.choices(words, k=12))
        good = card(pick)
        kind = i % 8
        if kind == 0:
            text += f" my card {good} is new"
        elif kind == 1:
            wrong = good[:-1] + str((int(good[-1]) + 3) % 10)
            text += f" order {wrong} came"
        elif kind == 2:
            text += f" call +1 (555) {pick.randrange(200, 999)}-{pick.randrange(1000, 9999)} now"
        elif kind == 3:
            text += f" version 300.{pick.randrange(900)}.{pick.randrange(900)}.400 of it"
        elif kind == 4:
            text += f" from 10.{pick.randrange(255)}.0.{pick.randrange(255)} again"
        elif kind == 5 and i % 40 == 5:
            wanted[i] = ("card", len(text) + 6, len(text) + 6 + 16)
            text += f" card {good} {'9' * 16} both"
        elif kind == 6:
            text += f" serial {pick.randrange(10**15, 10**16)}000 of it"
        rows.append((i, text))
    return documents(rows), rows, wanted


def test_trees_add_what_the_base_gives_up(planted):
    docs, rows, wanted = planted
    text = dict(rows)
    added = {r.doc_id: check(text[r.doc_id], r) for r in pii.pii_digest(docs).collect()}
    assert sum(wanted[i] in added[i] for i in wanted) >= 0.9 * len(wanted)
    assert sum(bool(a) for i, a in added.items() if i not in wanted) <= 0.002 * len(rows)


def test_redacted_texts(documents):
    rows = [(1, "é a@b.c, 1.2.3.4!"), (2, None), (3, "none")]
    got = {r.doc_id: (r.text, r.n_redacted) for r in pii.redact(documents(rows)).collect()}
    assert got == {1: ("é [email], [ip]!", 2), 2: (None, 0), 3: ("none", 0)}
