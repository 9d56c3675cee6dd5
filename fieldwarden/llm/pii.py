"""Personal data as spans: exact base patterns, and further candidates that boosted trees accept.

All on the JVM: patterns are regular expressions, places are sums over their
matches and the gaps between them, the trees are Spark ML's.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwarden.llm.common import prepared, stored

KINDS = ["email", "ip", "card", "phone"]
CONTEXT = 32  # code points before a match that its features see
SAMPLE = 20_000  # training candidates per kind and label, at most
LEAST = 20  # labelled candidates of each label that a fit and a threshold need
PRECISION = 0.98  # of accepted candidates among the held-out ones, per kind
HELD_OUT = 4  # one document in so many sets the thresholds


class Generator(NamedTuple):
    """A pattern, and a cheaper one that every text with a usable match holds."""

    kind: str
    pattern: str
    needs: str


LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

#: The base patterns. Runs are possessive and start where a run starts or the last
#: match ended: the matches are the same, no run is read twice, and no loop recurses.
BASE = [
    Generator("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", "@"),
    Generator("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    # runs of digits are maximal and apart, so short ones can be passed over
    Generator(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,}+",
        r"[0-9](?:[ -]?+[0-9]){12}",
    ),
    Generator("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
]

#: Generators of candidates: disguised or unusual forms, and parts of runs that the base gives up.
WIDE = [
    Generator(
        "email",
        rf"(?<!{LOCAL}){LOCAL}++ ?(?:@|\(at\)|\[at\]|\{{at\}}| at ) ?{LABEL}++"
        rf"(?: ?(?:\.|\(dot\)|\[dot\]|\{{dot\}}| dot ) ?{LABEL}++){{1,4}}",
        r"@|\(at\)|\[at\]|\{at\}| dot ",
    ),
    Generator(
        "ip",
        r"(?<![0-9])[0-9]{1,3}+(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}+){3}(?![0-9])",
        r"[0-9] ?[\[(.]",
    ),
    Generator(
        "card",
        r"(?<![0-9])[0-9]{4}(?:(?:[ ._/-]{0,2}[0-9]{4}){3}|[ ._/-]?[0-9]{6}[ ._/-]?[0-9]{5})(?![0-9])",
        r"[0-9]{4}[ ._/-]{0,2}[0-9]{4}",
    ),
    Generator("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])", r"[0-9]{13}"),
    Generator(
        "phone",
        r"\+[0-9]{1,3}+[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
        r"\+[0-9]",
    ),
    Generator(
        "phone",
        r"(?<![0-9+])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{3,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9])",
        r"[0-9]\)?[ .-][0-9]{3}",
    ),
]
GENERATORS = [*BASE, *WIDE]

#: Words before a match that speak for a kind, and words that speak for a plain number.
HINTS = {
    "email": "mail|contact|write to|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|addr|client|remote",
    "card": "card|visa|amex|karte|carte|tarjeta|credit|payment",
    "phone": r"phone|\btel|call|mobile|fax|telef|whatsapp|móvil",
}
OTHERWISE = r"token|secret|hash|version|\bid\b|order|invoice|isbn|serial"


# ---- checks -----------------------------------------------------------------------------


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    values = F.transform(
        F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
    )
    total = F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))
    return (digits != "") & (total % 10 == 0)


def is_octet(part: Column) -> Column:
    return part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$")


def is_valid(kind: Column, match: Column) -> Column:
    """Whether a base match is one, not only looks like it."""
    digits = digits_of(match)
    n = F.char_length(digits)
    return (
        F.when(kind == "ip", F.forall(F.split(match, r"\."), is_octet))
        .when(kind == "card", n.between(13, 19) & passes_luhn(digits))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


# ---- matches and their places ------------------------------------------------------------


def hits_of(text: Column) -> Column:
    """All matches of all generators in a text, each with the size and both ends of the gap before it."""

    def of(number: int, generator: Generator) -> Column:
        # the gap is lazy: it ends where the leftmost match begins; \G, so that a tail without one is read once
        pattern = F.lit(rf"(?s)\G(.*?)({generator.pattern})")
        hits = F.zip_with(
            F.regexp_extract_all(text, pattern, F.lit(1)),
            F.regexp_extract_all(text, pattern, F.lit(2)),
            lambda gap, match: F.struct(
                F.lit(number).alias("generator"),
                F.char_length(gap).cast("long").alias("gap"),
                F.left(gap, F.lit(1)).alias("head"),
                F.right(gap, F.lit(CONTEXT)).alias("before"),
                match.alias("match"),
            ),
        )
        return F.when(text.rlike(generator.needs), hits)

    return F.flatten(F.array_compact(F.array(*[of(i, g) for i, g in enumerate(GENERATORS)])))


def spans_of(hits: DataFrame) -> DataFrame:
    """Rows ``uid, kind, base, valid, start, end, match, before, after`` from rows ``uid, hits``."""
    rows = hits.select("uid", F.posexplode("hits").alias("place", "h")).select("uid", "place", "h.*")
    in_order = Window.partitionBy("uid", "generator").orderBy("place")
    size = F.char_length("match").cast("long")
    end = F.sum(F.col("gap") + size).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    kinds = F.array(*[F.lit(g.kind) for g in GENERATORS])
    placed = rows.select(
        "uid",
        F.get(kinds, F.col("generator")).alias("kind"),
        (F.col("generator") < len(BASE)).alias("base"),
        (end - size).alias("start"),
        end.alias("end"),
        "match",
        "before",
        F.coalesce(F.lead("head").over(in_order), F.lit("")).alias("after"),
    )
    return placed.withColumn("valid", is_valid(F.col("kind"), F.col("match")))


def against_base(spans: DataFrame) -> DataFrame:
    """Candidates with their relation to base spans: ``confirmed`` by one, ``overlaps`` one, ``doubtful``.

    A candidate inside a longer match that the base gave up is doubtful: no
    label can be drawn for it. Equal candidates of two generators become one.
    """
    by_start = Window.partitionBy("uid").orderBy("start")
    earlier = by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # the other way round, as a frame that shrinks is summed anew for each row
    backwards = Window.partitionBy("uid").orderBy(F.col("start").desc())
    later = backwards.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy("uid", "kind", "start", "end")
    good, bad = F.col("base") & F.col("valid"), F.col("base") & ~F.col("valid")

    def meets(which: Column) -> Column:
        before = F.max(F.when(which, F.col("end"))).over(earlier) > F.col("start")
        return F.coalesce(before | (F.min(F.when(which, F.col("start"))).over(later) < F.col("end")), F.lit(False))

    def inside(which: Column) -> Column:
        return F.coalesce(F.max(F.when(which, F.col("end"))).over(earlier) > F.col("start"), F.lit(False))

    marked = spans.select(
        "*",
        F.max(good).over(equal).alias("confirmed"),
        F.coalesce(F.max(bad).over(equal), F.lit(False)).alias("refused"),
        meets(good).alias("overlaps"),
        inside(bad).alias("given_up"),
    )
    marked = marked.withColumn("doubtful", F.col("given_up") & ~F.col("refused"))
    wide = marked.filter(~F.col("base")).drop("base", "valid", "given_up", "refused")
    return wide.dropDuplicates(["uid", "kind", "start", "end"])


# ---- boosted trees -------------------------------------------------------------------------


def char_kind(char: Column) -> Column:
    return (
        F.when(char.rlike("^[0-9]$"), 3).when(char.rlike(r"^\p{L}$"), 2).when(char.rlike(r"^\s$") | (char == ""), 0).otherwise(1)
    )


def features() -> dict[str, Column]:
    """Numbers that describe the format of a candidate and what stands around it."""
    match, kind, before = F.col("match"), F.col("kind"), F.lower("before")
    digits = digits_of(match)
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.char_length)
    separators = F.array_distinct(F.filter(F.split(F.regexp_replace(match, "[A-Za-z0-9]+", ""), ""), lambda c: c != ""))
    last_label = F.regexp_extract(match, "([A-Za-z0-9-]*)$", 1)
    local = F.regexp_extract(match, f"^({LOCAL}*)", 1)
    hint = reduce(lambda done, k: done.when(kind == k, before.rlike(HINTS[k])), KINDS, F.when(F.lit(False), False))
    return {
        **{f"is_{k}": kind == k for k in KINDS},
        "length": F.char_length(match),
        "n_digits": F.char_length(digits),
        "n_groups": F.size(groups),
        "longest_group": F.coalesce(F.array_max(sizes), F.lit(0)),
        "shortest_group": F.coalesce(F.array_min(sizes), F.lit(0)),
        "n_separators": F.size(separators),
        "luhn": F.coalesce(passes_luhn(digits), F.lit(False)),
        "octets": (F.size(groups) == 4) & F.forall(groups, is_octet),
        "plus": match.startswith("+"),
        "paired_brackets": match.rlike(r"\([0-9]+\)"),
        "last_label": F.char_length(last_label),
        "last_label_letters": last_label.rlike("^[a-z]+$"),
        "local": F.char_length(local),
        "char_before": char_kind(F.right(F.col("before"), F.lit(1))),
        "char_after": char_kind(F.col("after")),
        "hint": F.coalesce(hint, F.lit(False)),
        "other_hint": before.rlike(OTHERWISE),
    }


def with_vector(candidates: DataFrame) -> DataFrame:
    columns = {f"f_{name}": c.cast("double") for name, c in features().items()}
    vector = VectorAssembler(inputCols=list(columns), outputCol="vector")
    return vector.transform(candidates.withColumns(columns)).drop(*columns)


def held_out(uid: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("held out"), uid), F.lit(HELD_OUT)) == 0


class Detector(NamedTuple):
    """Trees and the least score per kind; kinds without a threshold accept nothing."""

    model: PipelineModel
    thresholds: dict[str, float]


def thresholds(scored: DataFrame, precision: float = PRECISION) -> dict[str, float]:
    """The least score of each kind from which on enough of the labelled candidates are confirmed.

    From counts per thousandth of the score; one more refused candidate is
    supposed at each score, so that a few confirmed ones prove nothing.
    """
    counts = scored.groupBy("kind", F.floor(F.col("score") * 1000).alias("bin")).agg(
        F.count_if("confirmed").alias("good"), F.count(F.lit(1)).alias("all")
    )
    above = Window.partitionBy("kind").orderBy(F.col("bin").desc())
    reached = counts.withColumns({"good": F.sum("good").over(above), "all": F.sum("all").over(above)})
    enough = reached.filter((F.col("good") >= precision * (F.col("all") + 1)) & (F.col("good") >= LEAST))
    # four kinds at most
    return {r.kind: r.bin / 1000 for r in enough.groupBy("kind").agg(F.min("bin").alias("bin")).collect()}


def fit(candidates: DataFrame, sample: int = SAMPLE) -> Detector | None:
    """Trees fitted on candidates that the base confirms or refuses; none without enough of both.

    At most ``sample`` candidates per kind and label are drawn, by hash, and
    weighted by what they stand for. Documents are held out as a whole for the
    thresholds, for which all their candidates count.
    """
    labelled = candidates.filter(~F.col("doubtful") & (F.col("confirmed") | ~F.col("overlaps")))
    learned = labelled.filter(~held_out(F.col("uid")))
    groups = Window.partitionBy("kind", "confirmed")
    totals = learned.groupBy("kind", "confirmed").agg(F.count(F.lit(1)).alias("total"))
    drawn = learned.withColumn(
        "rank", F.row_number().over(groups.orderBy(F.xxhash64("uid", "start"), "uid", "start", "end"))
    ).filter(F.col("rank") <= sample)
    drawn = drawn.join(F.broadcast(totals), ["kind", "confirmed"])  # eight rows at most
    weighted = drawn.withColumn("weight", F.greatest(F.col("total") / sample, F.lit(1.0)))
    rows = stored(
        with_vector(weighted).select("vector", "weight", F.col("confirmed").cast("double").alias("label")), "training"
    )
    found = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(found.get(0.0, 0), found.get(1.0, 0)) < LEAST:
        return None
    trees = GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", maxIter=15, maxDepth=4, stepSize=0.3, seed=1
    )
    model = trees.fit(rows)
    return Detector(model, thresholds(with_scores(model, labelled.filter(held_out(F.col("uid"))))))


def with_scores(model, candidates: DataFrame) -> DataFrame:
    scored = model.transform(with_vector(candidates))
    score = vector_to_array("probability")[1].alias("score")
    return scored.select(*candidates.columns, score)


def accepted(detector: Detector | None, candidates: DataFrame) -> DataFrame:
    """Spans that the trees add: over their kind's threshold, apart from base spans and from each other.

    Of candidates that overlap, the leftmost, then the longest stays; one that
    overlaps any candidate before it goes.
    """
    if detector is None or not detector.thresholds:
        return candidates.select("uid", "kind", "start", "end").filter(F.lit(False))
    scored = with_scores(detector.model, candidates.filter(~F.col("overlaps")))
    least = reduce(
        lambda done, item: done.when(F.col("kind") == item[0], F.lit(item[1])),
        detector.thresholds.items(),
        F.when(F.lit(False), F.lit(None).cast("double")),
    )
    over = scored.filter(F.floor(F.col("score") * 1000) / 1000 >= least)
    order = Window.partitionBy("uid").orderBy("start", F.col("end").desc(), "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        over.withColumn("before_end", before)
        .filter(F.coalesce(F.col("before_end") <= F.col("start"), F.lit(True)))
        .select("uid", "kind", "start", "end")
    )


# ---- the operator ----------------------------------------------------------------------------


def find_pii(docs: DataFrame, carry: list[str], detector: Detector | None = None) -> DataFrame:
    """``carry`` columns of every row, with ``base`` and ``spans``: arrays of ``kind, start, end``.

    ``docs`` has ``text``. Base spans are the matches of the four patterns that
    pass their checks: leftmost and non-overlapping within a kind, a match that
    fails is gone as a whole. ``spans`` holds them and what the trees add,
    ordered by kind, then start; places count code points, the end is exclusive.
    Without a ``detector`` one is fitted on the candidates of ``docs``; where
    base patterns confirm or refuse too few, nothing is added.

    A null text is an empty one and has no spans. Every row counts, repeated
    ones too; rows are told apart by their place in the input, not by an id.
    Other columns do not matter, whatever their names. No rows, no rows.
    """
    prepared(docs.sparkSession)
    names = {f"c{i}": c for i, c in enumerate(carry)}
    given = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        *[F.col(c).alias(n) for n, c in names.items()],
        hits_of(F.coalesce("text", F.lit(""))).alias("hits"),
    )
    rows = stored(given, "hits")
    spans = stored(spans_of(rows.filter(F.size("hits") > 0)), "spans")
    candidates = stored(against_base(spans), "candidates")
    detector = detector or fit(candidates)
    base = spans.filter(F.col("base") & F.col("valid")).select("uid", "kind", "start", "end")
    every = base.withColumn("base", F.lit(True)).unionByName(
        accepted(detector, candidates).withColumn("base", F.lit(False))
    )
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(number.alias("number"), "start", "end", "kind", "base")
    gathered = every.groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("found"))
    gathered = gathered.withColumnRenamed("uid", "_of")
    found = F.coalesce("found", F.array().cast("array<struct<number:bigint,start:bigint,end:bigint,kind:string,base:boolean>>"))

    def listed(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    joined = rows.drop("hits").join(gathered, F.col("uid") == F.col("_of"), "left").withColumn("found", found)
    return joined.select(
        *[F.col(n).alias(c) for n, c in names.items()],
        listed(F.filter("found", lambda s: s["base"])).alias("base"),
        listed(F.col("found")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """A text with its spans replaced by their kinds in brackets; of overlapping ones the first by start stays."""
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, s: Column) -> Column:
        kept = F.substr(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        out = F.concat(done["out"], kept, F.lit("["), s["kind"], F.lit("]"))
        later = s["start"] >= done["at"]
        return F.struct(
            F.when(later, out).otherwise(done["out"]).alias("out"),
            F.when(later, s["end"]).otherwise(done["at"]).alias("at"),
        )

    return F.aggregate(
        in_order, start, step, lambda done: F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int")))
    )


def redact(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the text redacted (null stays) and ``n_redacted``, its spans."""
    found = find_pii(docs, docs.columns, detector)
    changed = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    out = [changed.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("base", "spans")]
    return found.select(*out, F.size("spans").cast("long").alias("n_redacted"))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    found = find_pii(docs, ["doc_id"])

    def number_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number_of, KINDS), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans")
    )
