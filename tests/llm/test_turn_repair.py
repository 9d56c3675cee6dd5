"""Repaired conversations against a plain search over the states of the grammar."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldwarden.llm.turn_repair import aligned, repair, repair_digest

STEPS = [("", "s", "s"), ("", "u", "u"), ("s", "u", "u"), ("u", "a", "a"), ("a", "u", "u")]
NAMES = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id long, turn long, role string, text string"


def closed(states):
    """With insertions added wherever they lead to a state at less cost."""
    while True:
        more = dict(states)
        for state, (cost, audit, said) in states.items():
            for p, c, q in STEPS:
                if p == state and c in NAMES:
                    option = (cost + 5, audit + "I", [*said, NAMES[c] + ":"])
                    more[q] = min(more.get(q, option), option)
        if more == states:
            return states
        states = more


def plain_repair(turns):
    """Cost, audit and lines of (role, text, blank or duplicate, truncated)."""
    states = {"": (0, "", [])}
    for role, text, doomed, truncated in turns:
        after = {}
        for state, (cost, audit, said) in closed(states).items():
            options = [(state, (cost + 2, audit + "D", said))]
            for p, c, q in [] if doomed else STEPS:
                if p == state:
                    stay = cost + 5 * truncated
                    if role[:1] == c:
                        options.append((q, (stay, audit + "K", [*said, f"{role}:{text}"])))
                    elif c in NAMES:
                        options.append((q, (stay + 1, audit + "R", [*said, f"{NAMES[c]}:{text}"])))
            for q, option in options:
                after[q] = min(after.get(q, option), option)
        states = after
    states = closed(states)
    return min(states[s] for s in ("", "a") if s in states)


def plain_digest(rows):
    """Expected row per conversation, null as empty text."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, role or "", text or "") for c, t, role, text in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            duplicate = not blank and (role, text) in seen
            truncated = not blank and not duplicate and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
            seen.add((role, text))
            counts = [n + f for n, f in zip(counts, (blank, duplicate, truncated), strict=True)]
            turns.append((role, text, blank or duplicate, truncated))
        initials = [r[:1] for r, *_ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        numbers = [t for t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, said = plain_repair(turns)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def got(spark, rows, **options):
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit("x"), "pos": F.lit(1), "n": F.lit(2)})
    return {r[0]: tuple(r)[1:] for r in repair_digest(turns, turns, **options).collect()}


@pytest.fixture(scope="module")
def rows():
    pick, out = random.Random(11), []
    for conv in [None, *range(150)]:
        for turn in range(pick.choice([1, 2, 3, 5, 8, 13, 40])):
            role = pick.choice(["user", "assistant"][turn % 2 :] + ["user", "assistant", "system", "tool", None])
            text = pick.choice([f"t{turn}.", f"t{turn}!  ", f"t{turn}", "same?", "", None, " \t\n", "é" * 3000 + "."])
            out.append((conv, pick.choice([turn, turn, turn * 2, None]), role, text))
    return out + pick.sample(out, 40)


def test_against_a_plain_search(spark, rows):
    assert got(spark, rows) == plain_digest(rows)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_blocks_change_nothing(spark, rows, bits):
    assert got(spark, rows, block_bits=bits) == plain_digest(rows)


def test_a_block_of_many_turns():
    pick = random.Random(3)
    letters = "".join(pick.choice("DDGGEHFIACJ") for _ in range(400))
    turns = [(("s", "u", "a", "-")[k // 3], "", k % 3 == 2, k % 3 == 1) for k in (ord(c) - 65 for c in letters)]
    found = aligned(letters)
    endings = {0: "", 1: "II", 2: "I", 3: ""}
    best = min((found[0, q][0] + 5 * len(e), found[0, q][1] + e) for q, e in endings.items() if (0, q) in found)
    assert best == plain_repair(turns)[:2]


def test_edits_show_what_went(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", " "), (1, 2, "user", "So."), (1, 3, "user", "Hi.")]
    turns = repair(spark.createDataFrame(rows, SCHEMA)).turns.orderBy("ord").collect()
    assert [(r.edit, r.role, r.text) for r in turns] == [
        ("K", "user", "Hi."), ("D", "user", " "), ("R", "assistant", "So."), ("D", "user", "Hi."),
    ]


def test_nothing_left_and_no_rows(spark):
    given = spark.createDataFrame([(1, 0, "user", "Hi."), (None, None, None, None)], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    out = repair_digest(given, given.filter("conv_id = 2")).collect()
    assert {tuple(r) for r in out} == {(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (1, None)}
    assert repair_digest(given.limit(0), given.limit(0)).collect() == []
