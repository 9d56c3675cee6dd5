"""The registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.llm import (
    fm_index,
    hyperminhash,
    line_dedup,
    merkle,
    packing,
    pii,
    range_join,
    ring,
    snapshots,
    token_counts,
    toxicity,
    turn_repair,
    warc,
)
from fieldwarden.llm.common import prepared

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages archived and read back, equal payloads as revisits."""
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.toxicity(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.collapse_snapshots(table(spark, sf_dir, "conversations"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return fm_index.passage_digest(fm_index.find_passages(docs, bench))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    carry = {
        "doc_id": F.col("doc_id"),
        "size": (F.octet_length(text) + 16).cast("long"),
        "text_crc32": F.crc32(F.encode(text, "UTF-8")),
    }
    placed = ring.ring_shards(table(spark, sf_dir, "documents"), ["doc_id"], carry, SHARDS)
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op9_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", "n_shingles", "component_id", "kept")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and a copy whose n_chars was changed in places."""
    changed = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    observed = {"n_chars": F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle.manifest(table(spark, sf_dir, "documents"), observed=observed)
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified",
    )


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return turn_repair.repair_digest(given, turn_repair.damaged(given))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_toxicity,
        op3_snapshots,
        op4_decontaminate,
        op5_pack,
        op6_line_dedup,
        op7_token_counts,
        op8_ring,
        op9_range_join,
        op10_hyperminhash,
        op11_merkle,
        op12_pii,
        op13_turn_repair,
    )
}



def crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII text in DuckDB, which has none: two steps of four bits a character."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    halves = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c) & 15, ascii(c) >> 4]))"
    step = f"xor(CAST({table} AS BIGINT[])[(xor(c, v) & 15) + 1], c >> 4)"
    chain = f"list_prepend(4294967295, CAST({halves} AS BIGINT[]))"
    return f"xor(list_reduce({chain}, lambda c, v: {step}), 4294967295)"


def field_sql(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(field_sql, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


#: A tree of nodes (name, lvl, pos, h, n) over leaves of the same columns.
RISE = """SELECT * FROM {leaves}
  UNION ALL SELECT name, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2
    FROM {nodes} WHERE n > 1 GROUP BY name, lvl, pos // 2"""

#: Steps between the states of the grammar: what is inserted or taken, and the state after it.
GRAMMAR = """(VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) g(p, c, q)"""

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = f"regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: From links (a, b), given both ways: the smallest node that each one reaches.
REACH_SQL = """reach AS (SELECT a, a AS b FROM ({ids}) UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
parts AS (SELECT a, min(b) AS component FROM reach GROUP BY a)"""

ORACLES: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
last AS (SELECT html, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN p.n >= 1000 AND p.page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.n >= 1000 AND p.page_id <> top THEN top END AS refers_to, url AS uri
FROM p LEFT JOIN last ON p.html = last.html AND p.n >= 1000""",
    "op3_snapshots": """
WITH t AS (SELECT conv_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS turn,
  coalesce('+' || role, '-') || chr(0) || coalesce('+' || text, '-') || chr(0) AS seen
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
p AS (SELECT *, string_agg(seen, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
longer AS (SELECT DISTINCT pos + 1 AS n_turns, prefix FROM p WHERE pos + 1 < n_turns),
kept AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_equal FROM p
  WHERE pos + 1 = n_turns AND (n_turns, prefix) NOT IN (SELECT n_turns, prefix FROM longer) GROUP BY n_turns, prefix)
SELECT k.conv_id, pos // 256 AS part, k.n_turns, n_equal, string_agg(turn, '' ORDER BY pos) AS rendered
FROM kept k JOIN t ON t.conv_id = k.conv_id GROUP BY ALL""",
    "op6_line_dedup": """
WITH s AS (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT id, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, shared.key IS NOT NULL AND k.doc_id IS DISTINCT FROM last AS dropped FROM k LEFT JOIN shared ON k.key = shared.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY id""",
    "op4_decontaminate": f"""
WITH item AS (SELECT item_id, {WORDS_SQL} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, len(x) AS n, x FROM (SELECT item_id,
  unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: ws[i:i + 9])) AS x FROM item WHERE len(ws) > 0)),
doc AS (SELECT row_number() OVER () AS id, doc_id, {WORDS_SQL} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT id, n, i, ws[i:i + n - 1] AS x FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, sizes)),
found AS (SELECT id, i, spots.n, item_id FROM spots JOIN windows ON spots.x = windows.x),
hits AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT id, i, n FROM found)) GROUP BY id),
items AS (SELECT id, count(DISTINCT item_id) AS n_items, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM found GROUP BY id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (id) LEFT JOIN items USING (id)""",
    "op9_range_join": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND x IS NOT NULL
  AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
{REACH_SQL.format(ids="SELECT vec_id AS a FROM v")}
SELECT v.vec_id, coalesce(n, 0) AS n_links, component AS component_id, v.vec_id = component AS kept
FROM v JOIN parts ON parts.a = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) d ON d.a = v.vec_id""",
    "op10_hyperminhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE
  list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS xs FROM w),
e AS (SELECT doc_id, len(xs) AS n, unnest(xs) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
{REACH_SQL.format(ids="SELECT doc_id AS a FROM s")}
SELECT doc_id, CAST(len(xs) AS BIGINT) AS n_shingles, component AS component_id, doc_id = component AS kept FROM s JOIN parts ON parts.a = s.doc_id""",
    "op11_merkle": f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS seen FROM documents),
leaf AS (SELECT doc_id, {field_sql("lang")} AS name, lang, {leaf_sql("n_chars")} AS leaf, {leaf_sql("seen")} AS changed FROM d),
spot AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY name) AS n FROM leaf
  WINDOW w AS (PARTITION BY name ORDER BY doc_id NULLS FIRST, leaf)),
bottom AS (SELECT name, 0 AS lvl, pos, leaf AS h, n FROM spot),
low AS ({RISE.format(leaves="bottom", nodes="low")}),
subroots AS (SELECT '' AS name, 0 AS lvl, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n, low.name AS tree
  FROM low JOIN (SELECT DISTINCT name, lang FROM leaf) USING (name) WHERE n = 1),
tops AS (SELECT * EXCLUDE (tree) FROM subroots),
high AS ({RISE.format(leaves="tops", nodes="high")}),
place AS (SELECT doc_id, leaf, changed, spot.name, spot.pos, s.pos AS outer_pos, s.h AS subroot,
  row_number() OVER () AS id FROM spot JOIN subroots s ON s.tree = spot.name),
heights AS (SELECT name, max(lvl) AS top FROM low GROUP BY name),
steps AS (SELECT id, r.lvl AS step, (place.pos >> r.lvl) & 1 AS side, low.h FROM place JOIN heights USING (name)
    CROSS JOIN range(64) r(lvl) LEFT JOIN low ON low.name = place.name AND low.lvl = r.lvl AND low.pos = xor(place.pos >> r.lvl, 1)
    WHERE r.lvl < top
  UNION ALL SELECT id, 64 + r.lvl, (place.outer_pos >> r.lvl) & 1, high.h FROM place CROSS JOIN range(64) r(lvl)
    LEFT JOIN high ON high.lvl = r.lvl AND high.pos = xor(place.outer_pos >> r.lvl, 1) WHERE r.lvl < (SELECT max(lvl) FROM high)),
ordered AS (SELECT id, side, h, row_number() OVER (PARTITION BY id ORDER BY step) AS step FROM steps),
folded AS (SELECT id, 0 AS step, changed AS f FROM place
  UNION ALL SELECT id, folded.step + 1, sha256(CASE WHEN side = 1 THEN coalesce(h, '') || f ELSE f || coalesce(h, '') END)
    FROM folded JOIN ordered USING (id) WHERE ordered.step = folded.step + 1),
result AS (SELECT id, arg_max(f, step) AS folded_root FROM folded GROUP BY id),
proofs AS (SELECT id, string_agg(h, '' ORDER BY step) AS proof FROM ordered GROUP BY id),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM place JOIN result USING (id) LEFT JOIN proofs USING (id) CROSS JOIN root""",
    "op13_turn_repair": f"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations),
rows AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM given CROSS JOIN range(2) c(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text)) AS pos,
  trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM rows),
first AS (SELECT *, bare = '' AS blank,
  bare <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS duplicate, left(role, 1) AS c,
  coalesce(lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed),
t AS (SELECT *, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
  count(*) OVER (PARTITION BY conv) AS n FROM first),
g AS (SELECT * FROM {GRAMMAR}),
name AS (SELECT unnest(['u', 'a']) AS c, unnest(['user', 'assistant']) AS role),
inserts AS (SELECT p, p AS q, 0 AS cost, '' AS audit, '' AS said FROM (SELECT unnest(range(4)) AS p)
  UNION ALL SELECT i.p, g.q, i.cost + 5, i.audit || 'I', i.said || name.role || ':' || chr(10)
    FROM inserts i JOIN g ON g.p = i.q JOIN name USING (c) WHERE i.cost < 10),
way AS (SELECT conv, 0 AS pos, 0 AS state, struct_pack(cost := 0, audit := '', said := '') AS best FROM t WHERE pos = 1
  UNION ALL SELECT conv, pos, state, min(option) FROM (
    SELECT t.conv, t.pos, coalesce(g.q, i.q) AS state, struct_pack(
      cost := w.best.cost + i.cost + CASE WHEN g.q IS NULL THEN 2 ELSE CASE WHEN g.c = t.c THEN 0 ELSE 1 END + CASE WHEN truncated THEN 5 ELSE 0 END END,
      audit := w.best.audit || i.audit || CASE WHEN g.q IS NULL THEN 'D' WHEN g.c = t.c THEN 'K' ELSE 'R' END,
      said := w.best.said || i.said || CASE WHEN g.q IS NULL THEN '' ELSE CASE WHEN g.c = t.c THEN t.role ELSE name.role END || ':' || t.text || chr(10) END) AS option
    FROM way w JOIN t ON t.conv = w.conv AND t.pos = w.pos + 1 JOIN inserts i ON i.p = w.state
    JOIN (SELECT p, c, q FROM g UNION ALL SELECT unnest(range(4)), NULL, NULL) g ON g.p = i.q AND (g.q IS NULL OR NOT (blank OR duplicate))
    LEFT JOIN name ON name.c = g.c
    WHERE g.q IS NULL OR g.c = t.c OR g.c <> 's') GROUP BY conv, pos, state),
done AS (SELECT w.conv, min(struct_pack(cost := w.best.cost + i.cost, audit := w.best.audit || i.audit, said := w.best.said || i.said)) AS best
  FROM way w JOIN (SELECT conv, max(pos) AS last FROM t GROUP BY conv) l ON l.conv = w.conv AND l.last = w.pos
  JOIN inserts i ON i.p = w.state WHERE i.q IN (0, 3) GROUP BY w.conv),
counts AS (SELECT conv_id, conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM t GROUP BY conv_id, conv),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(left(best.said, -1), '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv = counts.conv""",
}
