"""Training and evaluation of the classifier with Spark ML.

Two branches as in the published model: the wide vector, and the text of each
field. A convolution of width three over characters sees character 3-grams, so
each text field is hashed as its 3-grams; a multinomial logistic regression
joins the branches. It is another model than a neural network and its quality
is reported as such.

Metadata is encoded once per column, ahead of the join with the values; per
value only the value's own text is hashed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.encoders import binary_weights, class_weight, class_weights
from fieldwarden.functions.text import EOS_MARK, PAD_MARK, clean_text
from fieldwarden.functions.vocab import CLASSES, KEY, MAX_LEN, WIDE_LAYOUT
from fieldwarden.operators.evaluate import accuracy, classification_report
from fieldwarden.operators.features import COLUMN_TYPE_FROM, labels, wide_features, wide_size
from fieldwarden.operators.joining import META_ALIASES, attach, shuffled_if_large
from fieldwarden.session import spread_heavy
from fieldwarden.sources.store import save_model

META_HASH_BITS, VALUE_HASH_BITS = 13, 12
META_VECTOR, VALUE_VECTOR = "_meta_vector", "_value_vector"


def grams(marked: Column) -> Column:
    """All overlapping character 3-grams, in one pass of the expression engine."""
    return F.regexp_extract_all(marked, F.lit("(?s)(?=(.{3}))"), F.lit(1))


def with_grams(df: DataFrame, fields: list[str], column_type_from: str = COLUMN_TYPE_FROM) -> DataFrame:
    """Add the wide slots (``_wide``) and the 3-grams (``_grams``) of the given fields.

    A bag of 3-grams has no fixed length, so whole texts are taken; only the
    fixed-size vectors are cut at ``MAX_LEN``.
    """
    texts = [f for f in fields if f in MAX_LEN]
    cleaned = {
        f"_c_{f}": clean_text(F.coalesce(F.col(f), F.lit(""))) if f in df.columns else F.lit("")
        for f in texts
    }
    wide = array_to_vector(wide_features(df.columns, column_type_from, fields))
    out = df.withColumns({**cleaned, "_wide": wide})

    out = out.withColumns(
        {f"_m_{f}": F.concat(F.lit(PAD_MARK), F.col(f"_c_{f}"), F.lit(EOS_MARK)) for f in texts}
    )

    def own(f: str) -> Column:
        """3-grams of a field, told apart from those of the other fields.

        Digits are also given as one symbol, so that the shapes of numbers generalise.
        """
        marked = F.col(f"_m_{f}")
        shapes = grams(F.regexp_replace(marked, "[0-9]", "9"))
        return F.concat(
            F.transform(grams(marked), lambda g: F.concat(F.lit(f"{f}:"), g)),
            F.transform(shapes, lambda g: F.concat(F.lit(f"{f}#"), g)),
            F.array(F.concat(F.lit(f"{f}="), F.char_length(marked).cast("string"))),
        )

    return out.withColumn("_grams", F.concat(*[own(f) for f in texts])).select(*df.columns, "_wide", "_grams")


def encode(
    df: DataFrame,
    fields: list[str],
    output: str,
    hash_bits: int,
    column_type_from: str = COLUMN_TYPE_FROM,
) -> DataFrame:
    """Add one vector of the wide slots and hashed 3-grams of the given fields."""
    out = with_grams(df, fields, column_type_from)
    # without a known size the assembler runs the whole join for one row, just to measure it
    sized = VectorSizeHint(inputCol="_wide", size=wide_size(fields), handleInvalid="optimistic").transform(out)
    hasher = HashingTF(inputCol="_grams", outputCol="_hashed", numFeatures=1 << hash_bits)
    joined = VectorAssembler(inputCols=["_wide", "_hashed"], outputCol=output)
    return joined.transform(hasher.transform(sized)).select(*df.columns, output)


def encode_meta(meta: DataFrame, column_type_from: str = COLUMN_TYPE_FROM) -> DataFrame:
    return encode(spread_heavy(meta), WIDE_LAYOUT[:-1], META_VECTOR, META_HASH_BITS, column_type_from)


def encode_values(rows: DataFrame) -> DataFrame:
    return encode(rows, ["column_value"], VALUE_VECTOR, VALUE_HASH_BITS)


def learning_rows(
    values: DataFrame,
    meta: DataFrame,
    carry: list[str] | None = None,
    column_type_from: str = COLUMN_TYPE_FROM,
) -> DataFrame:
    """Encoded, labelled rows of every value whose column is in ``meta``."""
    meta = labels(meta.withColumnsRenamed(META_ALIASES))
    kept = [*(carry or []), "is_sensitive", "class_id", META_VECTOR]
    encoded = encode_meta(meta, column_type_from).select(*KEY, *kept)
    joined = attach(values.select(*KEY, "column_value"), shuffled_if_large(encoded, meta))
    return encode_values(joined.na.fill("", ["column_value"]))


def classifier(
    max_iter: int = 30, reg: float = 1e-4, label: str = "class_id", weighted: bool = False
) -> Pipeline:
    """Joint linear classifier over both branches."""
    joined = VectorAssembler(inputCols=[META_VECTOR, VALUE_VECTOR], outputCol="_features")
    estimator = LogisticRegression(
        featuresCol="_features",
        labelCol=label,
        predictionCol="_predicted",
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        maxIter=max_iter,
        regParam=reg,
        # hashed counts share one scale
        standardization=False,
        **({"weightCol": "_weight"} if weighted else {}),
    )
    return Pipeline(stages=[joined, estimator])


def train(
    rows: DataFrame,
    label: str = "class_id",
    weights: list[float] | None = None,
    balanced: bool = False,
    **options,
) -> PipelineModel:
    """Fit on encoded, labelled rows.

    ``balanced`` weighs the classes of the label in use by the default ratio;
    ``label`` may also name the binary flag. Spark ML keeps the training rows in memory or on disk
    while it iterates, but plans and reads them several times before and after: hand in a stored table.
    """
    if balanced and weights is None:
        weights = class_weights(len(CLASSES)) if label == "class_id" else binary_weights()
    ready = rows.filter(F.col(label).isNotNull())
    if weights:
        ready = ready.withColumn("_weight", class_weight(F.col(label), weights))
    return classifier(label=label, weighted=bool(weights), **options).fit(ready)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Predicted class of every encoded row, and the probability given to it."""
    dropped = {META_VECTOR, VALUE_VECTOR}
    return model.transform(rows).select(
        *[c for c in rows.columns if c not in dropped],
        F.col("_predicted").cast("int").alias("prediction"),
        F.array_max(vector_to_array("_probability")).alias("confidence"),
    )


def evaluate(model: PipelineModel, rows: DataFrame, label: str = "class_id") -> DataFrame:
    """Classification report of a model on labelled rows."""
    return classification_report(predict(model, rows), label, "prediction")


def train_best(
    train_rows: DataFrame,
    valid_rows: DataFrame,
    settings: Iterable[dict],
    path: str,
    label: str = "class_id",
) -> tuple[PipelineModel, float]:
    """Fit each setting, store every model at least as accurate as the best so far."""
    best, best_score, version = None, -1.0, 0
    for options in settings:
        model = train(train_rows, label, **options)
        reached = accuracy(predict(model, valid_rows), label, "prediction").first().accuracy
        if reached >= best_score:
            best, best_score, version = model, reached, version + 1
            save_model(model, path, version)
    return best, best_score
