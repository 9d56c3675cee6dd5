"""Label hygiene, splits, balance, batches and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwarden.functions.encoders import binary_weights, class_weight, class_weights
from fieldwarden.functions.vocab import CLASSES, KEY, LEGACY_CLASSES, META_FIELDS, UNCLEAN_TYPES
from fieldwarden.operators import balance, evaluate, voting
from fieldwarden.operators.features import labels
from fieldwarden.operators.selection import batch_ids
from workload import sql
from workload.registry import Tables, query

SEED = balance.SEED


@query(
    "drop_unlabelled",
    "SELECT "
    + ", ".join(f"coalesce({f}, '') AS {f}" for f in META_FIELDS)
    + " FROM @f_meta@ WHERE column_is_sensitive IS NOT NULL",
)
def drop_unlabelled(t: Tables):
    return balance.drop_unlabelled(t.f_meta)


CLEAN = f"""
  SELECT * FROM @f_meta@
  WHERE (column_is_sensitive = '1' AND column_sensitive_type NOT IN {sql.in_list(UNCLEAN_TYPES)})
     OR (column_is_sensitive = '0' AND column_sensitive_type IS NULL)
"""


@query("clean_labels", CLEAN)
def clean_labels(t: Tables):
    return balance.clean_labels(t.f_meta)


@query(
    "undersample",
    f"""SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY column_is_sensitive
      ORDER BY {sql.hashed(SEED, *KEY)}) AS r FROM ({CLEAN}))
    WHERE column_is_sensitive = '1' OR r <= 300""",
)
def undersample(t: Tables):
    return balance.undersample(t.f_meta, 300, KEY, distinct_rows=True)


SPLIT = f"""
  SELECT * EXCLUDE (r, n), CASE WHEN r <= round_even(CAST(0.2 AS DOUBLE) * round_even(CAST(0.7 AS DOUBLE) * n, 0), 0) THEN 'valid'
    WHEN r <= round_even(CAST(0.7 AS DOUBLE) * n, 0) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY column_sensitive_type ORDER BY {sql.hashed(SEED, *KEY)}) AS r,
          count(*) OVER (PARTITION BY column_sensitive_type) AS n FROM ({CLEAN}))
"""


@query("split_stratified", SPLIT)
def split_stratified(t: Tables):
    return balance.split_stratified(balance.clean_labels(t.f_meta), KEY, distinct_rows=True)


@query(
    "split_class_counts",
    f"SELECT split, column_sensitive_type, count(*) AS n FROM ({SPLIT}) GROUP BY ALL",
)
def split_class_counts(t: Tables):
    return balance.split_class_counts(balance.split_stratified(balance.clean_labels(t.f_meta), KEY, distinct_rows=True))


# rows that are copies of each other by the thousand
@query(
    "split_stratified_copies",
    f"""WITH ranked AS (
      SELECT actual, predicted, row_number() OVER (PARTITION BY actual
          ORDER BY {sql.hashed(SEED, 'actual', 'predicted')}) AS r, count(*) OVER (PARTITION BY actual) AS n
      FROM @f_pred@),
    cut AS (SELECT actual, predicted, r <= round_even(CAST(0.7 AS DOUBLE) * n, 0) AS in_train,
        r <= round_even(CAST(0.2 AS DOUBLE) * round_even(CAST(0.7 AS DOUBLE) * n, 0), 0) AS in_valid FROM ranked)
    SELECT actual, predicted, 'valid' AS split FROM cut WHERE in_valid
    UNION ALL SELECT actual, predicted, 'train' FROM
      (SELECT actual, predicted FROM cut WHERE in_train EXCEPT SELECT actual, predicted FROM cut WHERE in_valid)
    UNION ALL SELECT actual, predicted, 'test' FROM
      (SELECT actual, predicted FROM cut EXCEPT SELECT actual, predicted FROM cut WHERE in_train)""",
)
def split_stratified_copies(t: Tables):
    rows = t.f_pred.select("actual", "predicted")
    return balance.split_stratified(rows, ["actual", "predicted"], ["actual"])


@query(
    "split_random",
    f"""SELECT stage_table_name, stage_column_name, CASE WHEN r <= ceil(CAST(0.3 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY {sql.hashed(SEED, *KEY)}) AS r, count(*) OVER () AS n FROM @f_meta@
          WHERE column_is_sensitive IS NOT NULL)""",
)
def split_random(t: Tables):
    meta = balance.drop_unlabelled(t.f_meta)
    return balance.split_random(meta, 0.3, KEY, distinct_rows=True).select(*KEY, "split")


@query(
    "oversample",
    """WITH labelled AS (SELECT v.row_id, v.column_is_sensitive FROM @f_values@ v),
    counts AS (SELECT count(*) FILTER (WHERE column_is_sensitive = '1') AS few,
      count(*) FILTER (WHERE column_is_sensitive <> '1') AS rest FROM labelled)
    SELECT row_id, column_is_sensitive FROM (SELECT row_id, column_is_sensitive,
      unnest(range(CASE WHEN column_is_sensitive = '1' THEN greatest((rest + few - 1) // few, 1) ELSE 1 END))
      FROM labelled, counts)""",
)
def oversample(t: Tables):
    return balance.oversample(t.f_values.select("row_id", "column_is_sensitive"))


@query(
    "batch_ids",
    f"""SELECT CAST(e.epoch AS INT) AS epoch, (r - 1) // 128 AS batch_id, actual, predicted, pos FROM
    (SELECT *, row_number() OVER (ORDER BY {sql.hashed(5, 'pos')}, pos) AS r FROM @f_pred@)
    CROSS JOIN (SELECT unnest(range(2)) AS epoch) e""",
)
def batches(t: Tables):
    return batch_ids(t.f_pred, ["pos"], 128, epochs=2, seed=5, distinct_rows=True)


@query(
    "batch_ids_copies",
    f"""SELECT 0 AS epoch, (r - 1) // 128 AS batch_id, actual, predicted FROM
    (SELECT *, row_number() OVER (ORDER BY {sql.hashed(5, 'actual', 'predicted')}) AS r FROM @f_pred@)""",
)
def batches_of_copies(t: Tables):
    rows = t.f_pred.select("actual", "predicted")
    return batch_ids(rows, ["actual", "predicted"], 128, seed=5)


def lookup(values: list[str], name: str, default: str = "-1") -> str:
    cases = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values))
    return f"CASE {name} {cases} ELSE {default} END"


KIND = f"upper({sql.strip(chr(99) + 'oalesce(column_sensitive_type, ' + chr(39) * 2 + ')')})"
LEGACY = LEGACY_CLASSES


@query(
    "label_encode",
    f"""SELECT stage_table_name, stage_column_name,
      CASE WHEN trim(coalesce(column_is_sensitive, '')) = '1' THEN 1 ELSE 0 END AS is_sensitive,
      CASE WHEN {KIND} = '' THEN 7 WHEN {KIND} = '非敏感' THEN -1 ELSE {lookup(CLASSES, KIND)} END AS class_id,
      CASE WHEN {KIND} = '' THEN 10 WHEN {KIND} = '非敏感' THEN 0 ELSE {lookup(LEGACY, KIND, "0")} END AS legacy_class_id
    FROM @f_meta@""",
)
def label_encode(t: Tables):
    both = labels(labels(t.f_meta, legacy=True).withColumnRenamed("class_id", "legacy_class_id"))
    return both.select(
        *KEY, "is_sensitive", F.coalesce("class_id", F.lit(-1)).alias("class_id"), "legacy_class_id"
    )


WEIGHT = "CASE WHEN class_id < 7 THEN 40.0e0 / 281 ELSE 1.0e0 / 281 END"


@query(
    "class_weights",
    f"""SELECT class_id, count(*) AS n, round(max({WEIGHT}), 9) AS weight FROM @f_probs@ GROUP BY class_id""",
)
def weights_by_class(t: Tables):
    weight = class_weight(F.col("class_id"), class_weights(len(CLASSES)))
    return t.f_probs.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max(weight), 9).alias("weight")
    )


# the flag: 1 is the rare class and weighs 40 times as much
@query(
    "binary_weights",
    """SELECT is_sensitive, count(*) AS n, round(max(CASE is_sensitive WHEN 1 THEN 40e0 / (40e0 + 1) ELSE 1 / (40e0 + 1) END), 9) AS weight
    FROM (SELECT CASE WHEN class_id < 7 THEN 1 ELSE 0 END AS is_sensitive FROM @f_probs@) GROUP BY is_sensitive""",
)
def weights_by_flag(t: Tables):
    flag = (F.col("class_id") < 7).cast("int").alias("is_sensitive")
    weight = class_weight(F.col("is_sensitive"), binary_weights())
    return t.f_probs.select(flag).groupBy("is_sensitive").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max(weight), 9).alias("weight")
    )


@query(
    "log_loss",
    f"""SELECT 'plain' AS kind, count(*) AS n, round(avg(-ln(p_true)), 6) AS loss FROM @f_probs@
    UNION ALL SELECT 'weighted', count(*), round(avg(-ln(p_true) * {WEIGHT}), 6) FROM @f_probs@
    UNION ALL SELECT 'binary', count(*), round(avg(CASE WHEN class_id < 7 THEN -ln(p_true) * 3 ELSE -ln(1 - p_true) END), 6) FROM @f_probs@""",
)
def log_losses(t: Tables):
    weight = class_weight(F.col("class_id"), class_weights(len(CLASSES)))
    binary = t.f_probs.withColumn("is_sensitive", (F.col("class_id") < 7).cast("int"))
    losses = {
        "plain": evaluate.row_loss("p_true"),
        "weighted": evaluate.row_loss("p_true") * weight,
        "binary": evaluate.binary_row_loss("is_sensitive", "p_true", 3.0),
    }
    return evaluate.mean_losses(binary, losses).select("kind", "n", F.round("loss", 6).alias("loss"))


CLASS_ROWS = "(SELECT unnest(range(8)) AS class_id, unnest(" + sql.text_list(CLASSES) + ") AS class)"


@query(
    "confusion_matrix",
    "SELECT CAST(c.class_id AS INT) AS class_id, c.class, "
    + ", ".join(
        f'count(*) FILTER (WHERE p.predicted = {i}) AS "{name}"' for i, name in enumerate(CLASSES)
    )
    + f" FROM {CLASS_ROWS} c LEFT JOIN @f_pred@ p ON p.actual = c.class_id GROUP BY c.class_id, c.class",
)
def confusion(t: Tables):
    return evaluate.confusion_matrix(t.f_pred)


REPORT = f"""
  WITH per_class AS (
    SELECT CAST(c.class_id AS INT) AS class_id, c.class,
      count(*) FILTER (WHERE p.actual = c.class_id AND p.predicted = c.class_id) AS hits,
      count(*) FILTER (WHERE p.predicted = c.class_id) AS given,
      count(*) FILTER (WHERE p.actual = c.class_id) AS support
    FROM {CLASS_ROWS} c, @predictions@ p GROUP BY c.class_id, c.class),
  rates AS (SELECT *, CASE WHEN given = 0 THEN 0e0 ELSE hits / given END AS precision,
    CASE WHEN support = 0 THEN 0e0 ELSE hits / support END AS recall FROM per_class),
  scored AS (SELECT class_id, class, precision, recall,
    CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM rates),
  report AS (SELECT * FROM scored UNION ALL
    SELECT 8, 'AVG / TOTAL', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM scored)
  SELECT class_id, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report
"""


def rounded_report(report):
    return report.select(
        "class_id", "class", *[F.round(c, 6).alias(c) for c in ["precision", "recall", "f1"]], "support"
    )


@query("classification_report", REPORT.replace("@predictions@", "@f_pred@"))
def report(t: Tables):
    return rounded_report(evaluate.classification_report(t.f_pred))


@query(
    "accuracy",
    """SELECT count(*) AS n, round(avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END), 9) AS accuracy FROM @f_pred@""",
)
def exact_accuracy(t: Tables):
    return evaluate.accuracy(t.f_pred).select("n", F.round("accuracy", 9).alias("accuracy"))


@query(
    "batch_accuracy",
    """SELECT count(*) AS n_batches, round(avg(a), 9) AS accuracy FROM
    (SELECT pos // 128 AS b, avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS a FROM @f_pred@ GROUP BY b)""",
)
def mean_batch_accuracy(t: Tables):
    out = evaluate.batch_accuracy(t.f_pred, "pos", 128)
    return out.select("n_batches", F.round("accuracy", 9).alias("accuracy"))


VOTES = f"""
  SELECT column_id, CAST(prediction AS INT) AS label, {sql.text_list(CLASSES)}[prediction + 1] AS raw_label,
    round(n / total, 9) AS probability, CAST(total AS BIGINT) AS n_values
  FROM (SELECT column_id, prediction, count(*) AS n, sum(count(*)) OVER (PARTITION BY column_id) AS total,
      row_number() OVER (PARTITION BY column_id ORDER BY count(*) DESC, min(position)) AS r
    FROM @f_votes@ GROUP BY column_id, prediction)
  WHERE r = 1
"""


@query("column_vote", VOTES)
def column_vote(t: Tables):
    votes = voting.vote(t.f_votes, ["column_id"])
    return votes.withColumn("probability", F.round("probability", 9))


@query(
    "binary_vote",
    """WITH v AS (SELECT column_id, position, CASE WHEN prediction < 2 THEN 1 ELSE 0 END AS p FROM @f_votes@),
    c AS (SELECT column_id, p, count(*) AS n, min(position) AS first FROM v GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY column_id) AS total,
        row_number() OVER (PARTITION BY column_id ORDER BY n DESC, first) AS r FROM c)
    SELECT column_id, CAST(p AS INT) AS label, CASE p WHEN 1 THEN 'sensitive' ELSE 'insensitive' END AS raw_label,
      round(n / total, 9) AS probability, CAST(total AS BIGINT) AS n_values FROM r WHERE r = 1""",
)
def binary_votes(t: Tables):
    flags = t.f_votes.withColumn("prediction", (F.col("prediction") < 2).cast("int"))
    votes = voting.vote(flags, ["column_id"], names=voting.FLAGS)
    return votes.withColumn("probability", F.round("probability", 9))


@query("flag_sensitive", f"SELECT * FROM ({VOTES}) WHERE probability >= 0.45 AND label <> 2")
def flagged(t: Tables):
    votes = voting.flag_sensitive(voting.vote(t.f_votes, ["column_id"]), 0.45, insensitive=2)
    return votes.withColumn("probability", F.round("probability", 9))
