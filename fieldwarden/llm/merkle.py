"""A Merkle manifest of a dataset: subtrees, proofs, and what verification finds.

Leaves are cut into superblocks of 4,096 in their order. Going up, a superblock
leaves one node to the next level, whose nodes are cut the same way. Going down,
the nodes of a superblock meet the outer nodes of its path to the root.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.common import placed, prepared, stored

LEVELS = 12  # of the tree that one superblock reduces

NODE = "name string, pos long, n long, digest string"
OUTER = "name string, block long, path string, subroot string, root string"
WHOLE = ""  # the name of the tree over all subtrees


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int, levels: int) -> int:
    """Levels above the nodes of one superblock of a level with ``n`` nodes."""
    return min((n - 1).bit_length(), levels)


def reduced(digests: list[str]) -> list[str]:
    """The next level: every two consecutive nodes, or a last lone one, become their hash."""
    return [hashed("".join(digests[k : k + 2])) for k in range(0, len(digests), 2)]


def subtree(nodes: pd.DataFrame, levels: int) -> pd.DataFrame:
    """The one node that a superblock leaves to the next level."""
    digests = nodes.sort_values("pos")["digest"].tolist()
    name, pos, n = nodes["name"].iloc[0], int(nodes["pos"].iloc[0]), int(nodes["n"].iloc[0])
    for _ in range(height(n, levels)):
        digests = reduced(digests)
    row = (name, pos >> levels, ((n - 1) >> levels) + 1, digests[0])
    return pd.DataFrame([row], columns=["name", "pos", "n", "digest"])


def local_paths(digests: list[str], levels: int) -> list[list[str]]:
    """Per node its sibling on each level, marked by side, ``-`` where it has none."""
    paths: list[list[str]] = [[] for _ in digests]
    for level in range(levels):
        for k, path in enumerate(paths):
            at = (k >> level) ^ 1
            path.append(("><"[at < k >> level] + digests[at]) if at < len(digests) else "-")
        digests = reduced(digests)
    return paths


def fold(digest: str, path: list[str]) -> str:
    """The root that a node and its siblings give."""
    for step in path:
        if step == "-":
            digest = hashed(digest)
        else:
            digest = hashed(step[1:] + digest if step[0] == "<" else digest + step[1:])
    return digest


def joined_paths(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[str]]]:
    """The nodes of a superblock in order, and their paths to the root."""
    nodes = nodes.sort_values("pos")
    beyond = outer["path"].iloc[0].split()
    local = local_paths(nodes["digest"].tolist(), height(int(nodes["n"].iloc[0]), levels))
    return nodes, [path + beyond for path in local]


def outer_nodes(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """What the superblocks below need: the path of each node."""
    nodes, paths = joined_paths(nodes, outer, levels)
    return pd.DataFrame(
        {
            "name": nodes["name"],
            "block": nodes["pos"],
            "path": [" ".join(p) for p in paths],
            "subroot": outer["subroot"].iloc[0],
            "root": outer["root"].iloc[0],
        }
    )


def verified_leaves(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Proof of each leaf, and the root that its observed form folds to."""
    nodes, paths = joined_paths(nodes, outer, levels)
    root = outer["root"].iloc[0]
    folded = [fold(d, p) for d, p in zip(nodes["observed"], paths, strict=True)]
    return pd.DataFrame(
        {
            "key": nodes["key"],
            "leaf": nodes["digest"],
            "subroot": outer["subroot"].iloc[0],
            "root": root,
            "proof": ["".join(s[1:] for s in p) for p in paths],
            "folded_root": folded,
            "verified": [f == root for f in folded],
        }
    )


def rise(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes and what their superblocks leave, level by level; the last has one node per tree."""
    risen = [nodes]
    while (risen[-1].agg(F.max("n").alias("n")).first().n or 0) > 1:
        blocks = risen[-1].withColumn("block", F.shiftright("pos", levels)).groupBy("name", "block")
        risen.append(stored(blocks.applyInPandas(lambda nodes: subtree(nodes, levels), NODE), "subtrees"))
    return risen


def exchanged(nodes: DataFrame, outer: DataFrame, function, schema: str, levels: int) -> DataFrame:
    """Cogroup the nodes of each superblock with the outer nodes it requires."""
    blocks = nodes.withColumn("block", F.shiftright("pos", levels)).groupBy("name", "block")
    return blocks.cogroup(outer.groupBy("name", "block")).applyInPandas(lambda a, b: function(a, b, levels), schema)


def descend(risen: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """Outer nodes for the superblocks of the lowest level, from those that end at the tops."""
    for nodes in risen[-2:0:-1]:
        outer = stored(exchanged(nodes, outer, outer_nodes, OUTER, levels), "outer")
    return outer


def manifest(
    docs: DataFrame,
    tree: str = "lang",
    key: str = "doc_id",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    observed: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """``key, leaf, subroot, root, proof, folded_root, verified``: one row per row of ``docs``.

    A leaf is the hash of the given columns. Per value of ``tree`` the leaves
    ascend by key; every two consecutive nodes become their hash until one is
    left, the subroot; subroots, ordered by ``tree``, give the root likewise.
    ``proof`` holds the digests of all siblings from the leaf to the root.
    ``observed`` replaces columns by what a copy of the dataset holds: its leaf
    is folded with the original siblings, and ``verified`` says whether that
    gives the root.

    Null is a value of its own: null trees come first, null keys first in their
    tree, and a null field is hashed as ``-``. Rows of one key are ordered by
    leaf; equal rows have places of their own next to each other, in any order,
    as no one can tell them apart. Texts of any length are hashed in the JVM and
    never leave it. Other columns are ignored. An empty table has no rows.

    Only digests move: a superblock holds ``2 ** levels`` of them, a path some 64
    bytes per level. A tree that holds most rows is many superblocks.
    """
    prepared(docs.sparkSession)
    seen = {**{c: F.col(c) for c in columns}, **(observed or {})}
    unchanged = F.lit(True)
    for c in observed or {}:
        unchanged = unchanged & F.col(c).eqNullSafe(seen[c])
    kind = dict(docs.dtypes)[key]
    rows = docs.select(
        F.col(tree).alias("tree"),
        F.col(key).alias("key"),
        leaf(*map(F.col, columns)).alias("digest"),
        F.when(~unchanged, leaf(*[seen[c] for c in columns])).alias("changed"),
    )
    leaves = stored(placed(stored(rows, "digests"), "tree", ["key", "digest"]).withColumn("name", field(F.col("tree"))), "leaves")
    risen = rise(leaves.select("name", "pos", "n", "digest"), levels)

    # the tops in the order of their trees are the leaves of the tree over all
    names = leaves.filter("pos = 0").select("name", "tree")
    tops = risen[-1].select("name", F.col("digest").alias("subroot")).join(names, "name")
    over = placed(stored(tops.withColumn("all", F.lit(WHOLE)), "tops"), "all", ["tree"])
    over = stored(over.withColumnsRenamed({"name": "of", "subroot": "digest", "all": "name"}), "subroots")
    above = rise(over.select("name", "pos", "n", "digest"), levels)
    first, nothing = F.lit(0).cast("long").alias("block"), F.lit("")
    start = above[-1].select(
        "name", first, nothing.alias("path"), nothing.alias("subroot"), F.col("digest").alias("root")
    )
    to_root = exchanged(above[0], descend(above, start, levels), outer_nodes, OUTER, levels)
    to_root = to_root.select("path", "root", F.col("block").alias("at"))
    tree_tops = over.join(to_root, F.col("pos") == F.col("at")).select(
        F.col("of").alias("name"), first, "path", F.col("digest").alias("subroot"), "root"
    )
    outer = descend(risen, stored(tree_tops, "outer"), levels)
    nodes = leaves.select(
        "name", "pos", "n", "digest", F.coalesce("changed", "digest").alias("observed"),
        F.col("key").cast("string").alias("key"),
    )
    schema = "key string, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
    result = exchanged(nodes, outer, verified_leaves, schema, levels)
    return result.withColumn("key", F.col("key").cast(kind))
