"""The cheapest split of a run of letters or ideographs into words of a lexicon.

A word costs the negative logarithm of its share, in thousandths, so that costs
add exactly. The functions handed to Spark are nested: they travel whole, and
executors need no copy of this package.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.text import HAN

MAX_WORD = 24  # letters of the longest word of a lexicon
MORE = 2303  # what each further letter of an unknown word costs: a factor of ten
LETTERS = f"^([a-z]|[{HAN}])"


def script_runs(cleaned: Column, num_to_digits: bool = True) -> Column:
    """Runs of one script in a cleaned text: digits, lower-case words, punctuation, ideographs."""
    digits = "[0-9]" if num_to_digits else "[0-9]+"
    pattern = f"({digits}|[a-z]+|[(),!?'\"]|[{HAN}]+)"
    return F.regexp_extract_all(F.lower(cleaned), F.lit(pattern), F.lit(1))


def is_wordlike(run: Column) -> Column:
    """Whether a run may hold words; digits and punctuation are tokens as they are."""
    return run.rlike(LETTERS)


def path_finder():
    """The best split of a run, given the words that begin at each place.

    Least cost, then fewest words, then the longest last word, and so on back.
    An unknown word of letters may have any length; an unknown ideograph is a
    word of its own.
    """

    def best_split(run: str, words_at, unknown: int) -> list[str]:
        size = len(run)
        never = (1 << 60, 0, 0)
        best = [(0, 0, 0)] + [never] * size
        latin = run[0].isascii()
        growing = never  # the best unknown word that ends at the current place
        for at in range(size):
            cost, words, _ = best[at]
            for end, price in words_at(run, at):
                best[end] = min(best[end], (cost + price, words + 1, at))
            fresh = (cost + unknown, words + 1, at)
            growing = min((growing[0] + MORE, *growing[1:]), fresh) if latin else fresh
            best[at + 1] = min(best[at + 1], growing)
        cuts, at = [], size
        while at:
            cuts.append(run[best[at][2] : at])
            at = best[at][2]
        return cuts[::-1]

    return best_split


def segmenter(lexicon) -> object:
    """An Arrow function from runs to their words, over a broadcast ``{words, costs, unknown}``.

    A worker turns the lexicon into a tree of prefixes once. A walk along a run
    stops where no word goes on, so its cost does not depend on the lexicon.
    """
    best_split = path_finder()
    remembered = 1 << 18

    def tree(value: dict) -> dict:
        if "tree" not in value:
            root: dict = {}
            for word, cost in zip(value["words"], value["costs"], strict=True):
                node = root
                for letter in word:
                    node = node.setdefault(letter, {})
                node[""] = cost
            value["tree"], value["seen"] = root, {}
        return value["tree"]

    def words(runs: pa.Array) -> pa.Array:
        value = lexicon.value
        root = tree(value)

        def words_at(run: str, at: int):
            node = root
            for end in range(at, len(run)):
                node = node.get(run[end])
                if node is None:
                    return
                if "" in node:
                    yield end + 1, node[""]

        seen, out = value["seen"], []
        for run in runs.to_pylist():
            if not run:
                out.append(None if run is None else [])
                continue
            found = seen.get(run)
            if found is None:
                if len(seen) >= remembered:
                    seen.clear()
                found = seen[run] = best_split(run, words_at, value["unknown"])
            out.append(found)
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(words, T.ArrayType(T.StringType()))


def edge_segmenter() -> object:
    """An Arrow function from runs, the words found in them and the unknown cost to their words."""
    best_split = path_finder()

    def words(runs: pa.Array, edges: pa.Array, unknown: pa.Array) -> pa.Array:
        out = []
        for run, found, price in zip(runs.to_pylist(), edges.to_pylist(), unknown.to_pylist(), strict=True):
            ways: dict = {}
            for edge in found or []:
                ways.setdefault(edge["at"], []).append((edge["end"], edge["cost"]))
            out.append(best_split(run, lambda _, at, ways=ways: ways.get(at, []), price) if run else [])
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(words, T.ArrayType(T.StringType()))
