"""Text functions, dictionaries and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions import text as tx
from fieldwarden.functions.rules import VALUE_PATTERNS, value_hits
from fieldwarden.functions.vocab import (
    CATEGORIES,
    CLASSES,
    DEEP_LAYOUT,
    DICTIONARY_META_FIELDS,
    KEY,
    MAX_LEN,
    WIDE_LAYOUT,
)
from fieldwarden.operators import dictionary as dic
from fieldwarden.operators.balance import clean_labels, split_stratified
from fieldwarden.operators.features import dataset_features
from fieldwarden.operators.segmentation import lexicon, lexicon_word_counts
from fieldwarden.session import shared_dir, spread_small, stored
from fieldwarden.sources.store import build_or_reuse_dictionary, read_features, write_features, write_splits
from workload import sql
from workload.catalog_queries import JOINED
from workload.data_queries import SPLIT
from workload.registry import Tables, query

SEPARATOR = "¦"


@query("clean_text", f"SELECT id, {sql.clean('text')} AS text FROM @f_text@")
def clean_text(t: Tables):
    return spread_small(t.f_text).select("id", tx.clean_text(F.col("text")).alias("text"))


@query(
    "zh_punc",
    "SELECT id, translate(text, '{}', '{}') AS text FROM @f_marks@".format(
        tx.ZH_PUNCTUATION, tx.EN_PUNCTUATION.replace("'", "''")
    ),
)
def zh_punc(t: Tables):
    return t.f_marks.select("id", tx.zh_punc_to_en_punc(F.col("text")).alias("text"))


@query(
    "split_num",
    f"""SELECT id, array_to_string(regexp_extract_all(text, '[0-9]|[^0-9]+'), '{SEPARATOR}') AS digits,
      array_to_string(regexp_extract_all(text, '[0-9]+|[^0-9]+'), '{SEPARATOR}') AS runs FROM @f_marks@""",
)
def split_num(t: Tables):
    text = F.col("text")
    return t.f_marks.select(
        "id",
        F.array_join(tx.split_num(text), SEPARATOR).alias("digits"),
        F.array_join(tx.split_num(text, num_to_digits=False), SEPARATOR).alias("runs"),
    )


def counted(tokens: str, source: str) -> str:
    return f"""SELECT token, count(*) AS n FROM (SELECT unnest({tokens}) AS token FROM {source})
      WHERE token <> '' GROUP BY token"""


CHARS = counted(f"string_split({sql.clean('text')}, '')", "@f_text@")
WORDS = counted(
    f"""regexp_extract_all(lower({sql.clean('text')}), '[0-9]|[a-z]+|[(),!?''"]|[{sql.HAN}]')""", "@f_text@"
)


@query("char_counts", CHARS)
def char_counts(t: Tables):
    return dic.char_counts(spread_small(t.f_text))


@query("word_counts", WORDS)
def word_counts(t: Tables):
    return dic.word_counts(spread_small(t.f_text))


# the words of conversations and questions are the lexicon, documents are taken apart by it
LEXICON_TEXTS = "(SELECT text FROM @conversations@ UNION ALL SELECT text FROM @benchmark@)"
SPLIT_COUNTS = f"""WITH RECURSIVE seen AS (
    SELECT token AS word, n FROM ({counted(f"regexp_extract_all(lower({sql.clean('text')}), '[a-z]+|[{sql.HAN}]')", LEXICON_TEXTS)})
    WHERE length(token) <= 24 AND n >= 3),
  total AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM seen),
  words AS (SELECT word, CAST(round(ln(total / n) * 1000) AS BIGINT) AS cost FROM seen, total),
  unknown AS (SELECT greatest(CAST(round(ln(total) * 1000) AS BIGINT), 2303) AS once FROM total),
  runs AS (SELECT token AS run, n FROM ({counted(f"regexp_extract_all(lower({sql.clean('text')}), '[0-9]|[a-z]+|[(),!?''\"]')", "@documents@")})),
  letters AS (SELECT run FROM runs WHERE run[1] BETWEEN 'a' AND 'z'),
  parts AS (SELECT run, start, start + size AS stop, run[start + 1:start + size] AS word, size
    FROM (SELECT run, start, unnest(range(1, length(run) - start + 1)) AS size
      FROM (SELECT run, unnest(range(length(run))) AS start FROM letters))),
  edges AS (SELECT run, stop, list(struct_pack(start := start, word := word, cost := cost)) AS ways FROM (
    SELECT run, start, stop, word, cost FROM parts JOIN words USING (word)
    UNION ALL SELECT run, start, stop, word, once + 2303 * (size - 1) FROM parts, unknown) GROUP BY run, stop),
  best AS (SELECT run, 0 AS stop, [struct_pack(cost := CAST(0 AS BIGINT), n := 0, start := CAST(0 AS BIGINT), path := CAST([] AS VARCHAR[]))] AS states FROM letters
    UNION ALL SELECT b.run, b.stop + 1, list_append(states, list_min(list_transform(ways, lambda w: struct_pack(
      cost := states[w.start + 1].cost + w.cost, n := states[w.start + 1].n + 1, start := w.start,
      path := list_append(states[w.start + 1].path, w.word)))))
    FROM best b JOIN edges e ON e.run = b.run AND e.stop = b.stop + 1),
  apart AS (SELECT run, states[length(run) + 1].path AS path FROM best WHERE stop = length(run))
  SELECT token, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT unnest(path) AS token, n FROM apart JOIN runs USING (run)
    UNION ALL SELECT run, n FROM runs WHERE run NOT IN (SELECT run FROM letters)) GROUP BY token"""


def text_lexicon(t: Tables):
    texts = t.conversations.select("text").unionByName(t.benchmark.select("text"))
    return lexicon(dic.word_counts(texts), least=3)


@query("word_counts_lexicon", SPLIT_COUNTS)
def word_counts_lexicon(t: Tables):
    return lexicon_word_counts(t.documents, text_lexicon(t))


def ranked(counts: str, order: str, kind: str) -> str:
    return f"""SELECT token, CAST(row_number() OVER (ORDER BY n DESC, {order}) + 2 AS {kind}) AS id, n FROM ({counts})
      UNION ALL SELECT '<PAD>', 0, 0 UNION ALL SELECT '<UNK>', 1, 0 UNION ALL SELECT '<EOS>', 2, 0"""


FIELD_TEXTS = (
    "(" + " UNION ALL ".join(f"SELECT {f} AS text FROM @f_meta@" for f in DICTIONARY_META_FIELDS)
    + " UNION ALL SELECT column_value FROM @f_values@)"
)
DICTIONARY = ranked(counted(f"string_split({sql.clean('text')}, '')", FIELD_TEXTS), "token", "INT")


def field_dictionary(t: Tables) -> DataFrame:
    texts = dic.dictionary_texts(t.f_meta, spread_small(t.f_values))
    return dic.char_dictionary(dic.char_counts(texts, weight=F.col("n")))


@query("char_dictionary", DICTIONARY)
def char_dictionary(t: Tables):
    path = shared_dir(t.spark, "char-dictionary")
    return build_or_reuse_dictionary(t.spark, path, lambda: field_dictionary(t))


@query("word_dictionary", ranked(WORDS, "md5(token), token", "BIGINT"))
def word_dictionary(t: Tables):
    return dic.word_dictionary(stored(dic.word_counts(spread_small(t.f_text)), "word-counts"))


LOOKUP = f"(SELECT map(list(token), list(id)) AS m FROM ({DICTIONARY}) WHERE id > 2)"


def joined_text(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")


def millionths(numbers: Column) -> Column:
    """Whole numbers print alike in every engine."""
    return F.array_join(
        F.transform(numbers, lambda x: (x * 1000000 + 0.5).cast("long").cast("string")), ","
    )


@query(
    "text_sequence",
    f"""SELECT row_id, array_to_string({sql.sequence('c', 50)}, ',') AS ids FROM
    (SELECT row_id, {sql.clean('column_value')} AS c FROM @f_values@), {LOOKUP}""",
)
def text_sequence(t: Tables):
    table = tx.id_table(dic.char_ids(field_dictionary(t)))
    cleaned = tx.clean_text(F.coalesce("column_value", F.lit("")))
    return spread_small(t.f_values).select(
        "row_id", joined_text(tx.text_sequence(cleaned, MAX_LEN["column_value"], table)).alias("ids")
    )


def wide_vector(column_type: str) -> str:
    blocks = []
    for field in WIDE_LAYOUT:
        if field in MAX_LEN:
            blocks.append(sql.ratio(field, MAX_LEN[field]))
            continue
        values, default = CATEGORIES[field]
        source = f"split_part({column_type}, '(', 1)" if field == "column_type" else field
        value = sql.strip(f"upper(coalesce({source}, ''))")
        blocks.append(sql.one_hot(value, values, default))
    return f"array_to_string({' || '.join(blocks)}, ',')"


def wide_sql(column_type: str) -> str:
    return f"SELECT row_id, {wide_vector(column_type)} AS wide FROM {JOINED}"


def wide_rows(t: Tables, column_type_from: str) -> DataFrame:
    rows = dataset_features(spread_small(t.f_values), t.f_meta, None, column_type_from, keep=["row_id"])
    return rows.select("row_id", millionths(F.col("wide")).alias("wide"))


@query("wide_features", wide_sql("database_type"))
def wide(t: Tables):
    return wide_rows(t, "database_type")


@query("wide_features_own_type", wide_sql("column_type"))
def wide_own_type(t: Tables):
    return wide_rows(t, "column_type")


DEEP = " || ".join(sql.sequence(f"c_{f}", MAX_LEN[f]) for f in DEEP_LAYOUT)


def dataset_sql(joined: str, *more: str) -> str:
    """Keys, value, labels and deep vector of the joined rows; ``more`` are further columns of theirs."""
    names = "".join(f", {m.split(' AS ')[-1]}" for m in more)
    return f"""SELECT stage_table_name, stage_column_name, column_value, is_sensitive, class_id,
      array_to_string({DEEP}, ',') AS deep{names} FROM
    (SELECT coalesce(stage_table_name, '') AS stage_table_name, coalesce(stage_column_name, '') AS stage_column_name,
       coalesce(column_value, '') AS column_value, CASE WHEN column_is_sensitive = '1' THEN 1 ELSE 0 END AS is_sensitive,
       CASE WHEN column_sensitive_type IS NULL THEN 7
         ELSE coalesce(CAST(list_position({sql.text_list(CLASSES[:-1])}, column_sensitive_type) AS INT), 0) - 1
       END AS class_id, {", ".join([*more, *(f"{sql.clean(f)} AS c_{f}" for f in DEEP_LAYOUT)])} FROM {joined}), {LOOKUP}"""


def dataset_columns() -> list[Column | str]:
    return [
        *KEY,
        "column_value",
        "is_sensitive",
        F.coalesce("class_id", F.lit(-1)).alias("class_id"),
        joined_text(F.col("deep")).alias("deep"),
    ]


@query("deep_features", dataset_sql(JOINED))
def deep(t: Tables):
    ids = dic.char_ids(field_dictionary(t))
    rows = dataset_features(spread_small(t.f_values), t.f_meta, ids)
    return rows.select(*dataset_columns())


@query(
    "feature_store",
    dataset_sql(JOINED.replace("@f_meta@", f"({SPLIT})"), "split", f"{wide_vector('database_type')} AS wide"),
)
def feature_store(t: Tables):
    """The dataset of all splits, written and read again."""
    splits, path = shared_dir(t.spark, "splits"), shared_dir(t.spark, "features")
    write_splits(split_stratified(clean_labels(t.f_meta), KEY, distinct_rows=True), splits)
    split = t.spark.read.parquet(splits)
    ids = dic.char_ids(field_dictionary(t))
    write_features(dataset_features(spread_small(t.f_values), split, ids, carry=["split"]), path)
    rows = read_features(t.spark, path)
    return rows.select(*dataset_columns(), "split", millionths(F.col("wide")).alias("wide"))


HITS = {
    "id_number": "身份证",
    "email": "邮箱",
    "card": "卡号",
    "mobile": "手机",
    "landline": "固定电话",
}


@query(
    "rule_hits",
    "SELECT id, "
    + ", ".join(
        f"CAST(len(regexp_extract_all(text, '{VALUE_PATTERNS[kind]}')) AS INT) AS {name}"
        for name, kind in HITS.items()
    )
    + " FROM @f_rules@",
)
def rule_hits(t: Tables):
    hits = value_hits(F.col("text"))
    return spread_small(t.f_rules).select("id", *[hits[kind].alias(name) for name, kind in HITS.items()])
