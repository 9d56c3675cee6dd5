"""Conversations repaired to the grammar ``(s?(ua)+)?`` by aligning their turns to it.

Target strings of the grammar alternate, so their suffixes depend on the length
and the last letter alone: one table of suffix costs per last letter aligns the
turns to every feasible length. A conversation is cut into blocks of 512 turns;
a block is aligned between all states of the grammar, and the cheapest way
through its blocks is chosen by their costs.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.common import each_batch, placed, prepared, same, stored

BLOCK_BITS = 9  # 512 turns are aligned together
REMEMBERED = 1 << 13  # alignments that a worker keeps

# costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# states of the grammar: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: What ends a conversation that has come to a state: inserted turns up to the next end.
ENDINGS = ["", "ua", "a", ""]
ROLES = {"u": "user", "a": "assistant"}
NEVER = 1 << 40

WHITE = r"[\x20\x09-\x0D]"


# ---- damage of the registered query ------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the faults that the hash of conv_id and turn sets; null is one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = (F.crc32(F.encode(key, "UTF-8")) % 20).alias("fault")
    rows = turns.select(
        "conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], fault
    ).filter("fault <> 0")
    text = (
        F.when(F.col("fault") == 1, F.lit(""))
        .when(F.col("fault") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


# ---- faults ---------------------------------------------------------------------------


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def is_truncated(text: Column) -> Column:
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return ~last.isin(".", "!", "?")


def in_order(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, role, text``: turns with their places, ties of a number by a hash of role and text."""
    tie = F.md5(F.concat("role", F.lit(":"), "text"))
    rows = placed(turns.select("conv_id", "turn", "role", "text", tie.alias("tie")), "conv_id", ["turn", "tie"])
    return rows.select("conv_id", "pos", "role", "text")


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, initial, blank, duplicate, truncated``: each turn with its first fault; no text moves."""
    firsts = rows.groupBy("conv_id", "role", F.md5("text")).agg(F.min("pos").alias("at"))
    firsts = firsts.select(F.col("conv_id").alias("of"), "at")
    text = F.col("text")
    looks = rows.select(
        "conv_id", "pos", F.substring("role", 1, 1).alias("initial"), is_blank(text).alias("blank"),
        is_truncated(text).alias("cut"),
    )
    is_first = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("at"))
    duplicate = ~F.col("blank") & F.col("at").isNull()
    return looks.join(firsts, is_first, "left").select(
        "conv_id",
        "pos",
        "initial",
        "blank",
        duplicate.alias("duplicate"),
        (~F.col("blank") & ~duplicate & F.col("cut")).alias("truncated"),
    )


def letter() -> Column:
    """Role initial and fault of a turn as one of twelve letters."""
    initial = F.col("initial")
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    state = F.when(F.col("blank") | F.col("duplicate"), 2).when(F.col("truncated"), 1).otherwise(0)
    return F.chr(F.lit(ord("A")) + 3 * kind + state)


# ---- alignment of one block -------------------------------------------------------------


class Turn(NamedTuple):
    """What the alignment knows of a turn: its initial, whether it must go, what staying costs."""

    initial: str
    doomed: bool
    penalty: int


def read_letters(letters: str) -> list[Turn]:
    codes = [ord(c) - ord("A") for c in letters]
    return [Turn("sua-"[k // 3], k % 3 == 2, TRUNCATED * (k % 3 == 1)) for k in codes]


def incumbent(turns: list[Turn]) -> int:
    """The cost of a plain repair between any two states, which bounds the band.

    Doomed and truncated turns go, the others stay or change their role; to end
    in another state takes one more deletion, or two insertions in the front and
    a deletion.
    """
    costs = []
    for expected in "ua":
        cost = 0
        for turn in turns:
            if turn.doomed or turn.penalty:
                cost += DELETE
            else:
                cost += REROLE * (turn.initial != expected)
                expected = "ua"[expected == "u"]
        costs.append(cost)
    return min(*costs, DELETE * len(turns)) + 2 * INSERT + 2 * DELETE


class Table:
    """Least costs to align the turns from ``i`` on with the last ``r`` letters of ``...uaua``.

    ``last`` is the final letter. The last edit of a block takes a turn, so that
    insertions between two blocks belong to the later one. Cells outside the
    band of the incumbent's cost hold ``NEVER``.
    """

    def __init__(self, turns: list[Turn], last: str, bound: int):
        n = len(turns)
        self.turns, self.last = turns, last
        width = n + bound // INSERT + 1
        self.cost = np.full((n + 1, width + 1), NEVER, np.int64)
        self.cost[n, 0] = 0
        lengths = np.arange(width + 1)
        odd = lengths % 2 == 1  # these suffixes begin with the last letter
        steps = INSERT * lengths
        for i in range(n - 1, -1, -1):
            low, high = max(0, n - i - bound // DELETE), min(width, n - i + bound // INSERT) + 1
            turn, after = turns[i], self.cost[i + 1]
            best = DELETE + after[low:high]
            if not turn.doomed:
                fits = odd[low:high] == (turn.initial == last) if turn.initial in "ua" else False
                taken = np.full(high - low, NEVER, np.int64)
                first = max(low, 1)
                taken[first - low :] = after[first - 1 : high - 1]
                best = np.minimum(best, taken + turn.penalty + np.where(fits, 0, REROLE))
            best = np.minimum.accumulate(best - steps[low:high]) + steps[low:high]
            self.cost[i, low:high] = np.minimum(best, NEVER)

    def expects(self, r: int) -> str:
        return self.last if r % 2 else "ua"[self.last == "u"]

    def audit(self, i: int, r: int) -> str:
        """The ASCII-least of the cheapest edits from a cell on."""
        edits = []
        while i < len(self.turns):
            turn, cost, after = self.turns[i], self.cost[i, r], self.cost[i + 1]
            if DELETE + after[r] == cost:
                edits.append("D")
                i += 1
            elif r and INSERT + self.cost[i, r - 1] == cost:
                edits.append("I")
                r -= 1
            else:
                edits.append("K" if turn.initial == self.expects(r) else "R")
                i, r = i + 1, r - 1
        return "".join(edits)

    def starts(self, i: int, expected: str, some: bool) -> list[tuple[int, int]]:
        """Cost and length of each feasible target that begins with a letter; an empty one unless ``some``."""
        row = self.cost[i]
        first = 1 if expected == self.last else 2 if some else 0
        return [(int(row[r]), r) for r in range(first, len(row), 2) if row[r] < NEVER]


@lru_cache(REMEMBERED)
def aligned(letters: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and audit of the cheapest edits of a block, by the states before and after it."""
    turns = read_letters(letters)
    n, bound = len(turns), incumbent(turns)
    found = {(p, p): (DELETE * n, "D" * n) for p in STATES}
    systems = [i for i, t in enumerate(turns) if t.initial == "s" and not t.doomed]
    only = [(DELETE * (n - 1) + turns[i].penalty, "D" * i + "K" + "D" * (n - 1 - i)) for i in systems]
    if only:
        found[START, SYSTEM] = min(only)
    for after, last in ((USER, "u"), (ASSISTANT, "a")):
        table = Table(turns, last, bound)
        for before, expected in ((SYSTEM, "u"), (USER, "a"), (ASSISTANT, "u")):
            some = (before, after) == (SYSTEM, ASSISTANT)
            lengths = table.starts(0, expected, some)
            least = min(lengths)[0]
            found[before, after] = (least, min(table.audit(0, r) for c, r in lengths if c == least))
        # from the start: any target that begins with u, or a kept system turn first
        first = [(c, 0, r) for c, r in table.starts(0, "u", True)]
        for i in systems:
            kept = DELETE * i + turns[i].penalty
            first += [(kept + c, i + 1, r) for c, r in table.starts(i + 1, "u", True)]
        least = min(c for c, _, _ in first)
        found[START, after] = (
            least,
            min(("D" * (i - 1) + "K" if i else "") + table.audit(i, r) for c, i, r in first if c == least),
        )
    return found


# ---- the way through the blocks ---------------------------------------------------------


def block_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Costs of a block by states before and after, and the order of its audits by state before."""
    costs, ranks, illegal = [], [], []
    for letters in batch.column("letters").to_pylist():
        found = aligned(letters)
        order = {
            pair: k
            for p in STATES
            for k, pair in enumerate(sorted((x for x in found if x[0] == p), key=lambda x: found[x][1]))
        }
        pairs = [(p, q) for p in STATES for q in STATES]
        costs.append([found.get(x, (NEVER,))[0] for x in pairs])
        ranks.append([order.get(x, 0) for x in pairs])
        initials = "".join(t.initial for t in read_letters(letters))
        illegal.append(sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1)))
    return pa.RecordBatch.from_arrays(
        [
            *batch.columns,
            pa.array(costs, pa.list_(pa.int64())),
            pa.array(ranks, pa.list_(pa.int32())),
            pa.array(illegal, pa.int64()),
        ],
        names=[*batch.schema.names, "costs", "ranks", "illegal"],
    )


def chosen_states(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[int]]:
    """The least cost of a conversation and the states at the borders of its blocks.

    Audits of one block from one state never begin with one another, so equal
    costs are decided block by block.
    """
    rest = [[INSERT * len(e) for e in ENDINGS]]
    for block in reversed(costs):
        rest.append([min(block[4 * p + q] + rest[-1][q] for q in STATES) for p in STATES])
    rest.reverse()
    state, states = START, [START]
    for block, rank, after in zip(costs, ranks, rest[1:], strict=True):
        options = [(block[4 * state + q] + after[q], rank[4 * state + q], q) for q in STATES]
        state = min(options)[2]
        states.append(state)
    return rest[0][START], states


COUNTS = ("blank", "duplicate", "truncated")


def path_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Cost and counts of each conversation, and the states before and after its blocks."""
    blocks = batch.column("blocks").to_pylist()
    costs, paths, illegal = [], [], []
    counts = [pa.array([sum(b[c] for b in found) for found in blocks], pa.int64()) for c in COUNTS]
    for found in blocks:
        cost, states = chosen_states([b["costs"] for b in found], [b["ranks"] for b in found])
        costs.append(cost)
        last = len(found) - 1
        paths.append([(b["block"], states[k], states[k + 1], k == last) for k, b in enumerate(found)])
        borders = [a["letters_end"] + b["letters_start"] for a, b in zip(found, found[1:], strict=False)]
        pairs = ["".join(t.initial for t in read_letters(x)) for x in borders]
        illegal.append(sum(b["illegal"] for b in found) + sum(x not in ("su", "ua", "au") for x in pairs))
    kind = pa.list_(
        pa.struct([("block", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("is_last", pa.bool_())])
    )
    paths = [[dict(zip(("block", "before", "after", "is_last"), x, strict=True)) for x in p] for p in paths]
    return pa.RecordBatch.from_arrays(
        [batch.column("conv_id"), *counts, pa.array(illegal, pa.int64()), pa.array(costs, pa.int64()), pa.array(paths, kind)],
        names=["conv_id", *COUNTS, "illegal", "cost", "path"],
    )


def edit_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The audit of each block, and its edits with the turn they take and the role they give."""
    audits, edits = [], []
    rows = zip(*[batch.column(c).to_pylist() for c in ("letters", "before", "after", "is_last")], strict=True)
    for letters, before, after, is_last in rows:
        audit = aligned(letters)[before, after][1]
        if is_last:
            audit += "I" * len(ENDINGS[after])
        audits.append(audit)
        turns, state, taken, steps = read_letters(letters), before, 0, []
        for edit in audit:
            row = None if edit == "I" else taken
            taken += edit != "I"
            role = None
            if edit != "D":
                if edit == "K" and state == START and turns[row].initial == "s":
                    state = SYSTEM
                else:
                    state = ASSISTANT if state == USER else USER
                if edit in "IR":
                    role = "assistant" if state == ASSISTANT else "user"
            steps.append({"edit": edit, "row": row, "role": role})
        edits.append(steps)
    kind = pa.list_(pa.struct([("edit", pa.string()), ("row", pa.int64()), ("role", pa.string())]))
    return pa.RecordBatch.from_arrays(
        [batch.column("conv_id"), batch.column("block"), pa.array(audits, pa.string()), pa.array(edits, kind)],
        names=["conv_id", "block", "audit", "edits"],
    )


class Repair(NamedTuple):
    """``turns``: one row per edit, ``conversations``: counts, cost and audit."""

    turns: DataFrame
    conversations: DataFrame


def repair(turns: DataFrame, block_bits: int = BLOCK_BITS) -> Repair:
    """Repair conversations of ``conv_id, turn, role, text`` at the least cost.

    Turns stand in the order of their numbers (null first), ties by a hash of
    role and text. A turn without a character but white space, and one whose
    role and text came earlier in the conversation, must go; a turn that does
    not end in ``.!?`` costs 5 unless it goes. Keeping costs 0, another role 1,
    deleting 2, inserting a turn with empty text 5. Of equal costs the audit
    that is least in ASCII wins.

    ``turns``: ``conv_id, block, ord, edit, role, text`` per edit in order; a
    deleted turn (D) shows what went. ``conversations``: ``conv_id, blank,
    duplicate, truncated, illegal, cost, audit``. Rows without conv_id are one
    conversation; null roles and texts count as empty, so such a text is blank
    and such a role fits nothing. Repeated rows are duplicates of each other.
    Other columns are ignored; no turns, no rows.

    A conversation of any length is spread: its turns are placed by ranges,
    aligned in blocks of 512, and only 16 costs a block meet in one row.
    """
    spark = prepared(turns.sparkSession)
    given = turns.select(
        "conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    rows = in_order(given)
    kind = dict(rows.dtypes)["conv_id"]
    checked = faults(rows).withColumn("block", F.shiftright("pos", block_bits))
    letters = F.array_sort(F.collect_list(F.struct("pos", letter().alias("letter"))))
    blocks = checked.groupBy("conv_id", "block").agg(
        F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("letters"),
        *[F.count_if(c).alias(c) for c in COUNTS],
    )
    counted = "blank long, duplicate long, truncated long"
    blocks = stored(
        each_batch(
            blocks,
            block_rows,
            f"conv_id {kind}, block long, letters string, {counted}, costs array<long>, ranks array<int>, illegal long",
        ),
        "blocks",
    )
    # of the letters only the two at the borders of the blocks
    summary = F.struct(
        "block", "costs", "ranks", "illegal", *COUNTS,
        F.left("letters", F.lit(1)).alias("letters_start"), F.right("letters", F.lit(1)).alias("letters_end"),
    )
    gathered = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(summary)).alias("blocks"))
    paths = stored(
        each_batch(
            gathered,
            path_rows,
            f"conv_id {kind}, {counted}, illegal long, cost long, "
            "path array<struct<block: long, before: int, after: int, is_last: boolean>>",
        ),
        "paths",
    )
    steps = paths.select("conv_id", F.inline("path"))
    edits = blocks.join(steps, same(blocks, steps, "conv_id", "block")).select(
        blocks["conv_id"], blocks["block"], "letters", "before", "after", "is_last"
    )
    edits = stored(
        each_batch(
            edits,
            edit_rows,
            f"conv_id {kind}, block long, audit string, edits array<struct<edit: string, row: long, role: string>>",
        ),
        "edits",
    )
    parts = F.array_sort(F.collect_list(F.struct("block", "audit")))
    audits = edits.groupBy(F.col("conv_id").alias("of")).agg(
        F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit")
    )
    conversations = paths.join(audits, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", *COUNTS, "illegal", "cost", "audit"
    )
    out = edits.select("conv_id", "block", F.posexplode("edits").alias("ord", "e")).select(
        "conv_id", "block", "ord", "e.edit", F.col("e.role").alias("given"),
        (F.shiftleft("block", block_bits) + F.col("e.row")).alias("at"),
    )
    taken = rows.select(F.col("conv_id").alias("of"), "pos", "role", "text")
    joined = out.join(taken, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("at") == F.col("pos")), "left")
    edited = joined.select(
        "conv_id", "block", "ord", "edit",
        F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return Repair(edited, conversations)


def text_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: hash of a conversation's ``role:text`` lines, read as a stream.

    A conversation is hashed by one task, as a hash demands, but never held:
    sorted turns pass through in batches.
    """
    prepared(turns.sparkSession)
    lines = turns.filter("edit <> 'D'").select(
        "conv_id", "block", "ord", F.concat("role", F.lit(":"), "text").alias("line")
    )
    sorted_lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "block", "ord")
    kind = dict(lines.dtypes)["conv_id"]

    def digest(batches):
        held, state, arrow_type = None, None, None
        for batch in batches:
            arrow_type = batch.schema.field("conv_id").type
            ids, digests = [], []
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or conv != held:
                    if state is not None:
                        ids.append(held)
                        digests.append(state.hexdigest())
                    held, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, arrow_type), pa.array(digests)], names=["conv_id", "repaired_sha256"]
                )
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([held], arrow_type), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"]
            )

    return sorted_lines.select("conv_id", "line").mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def turn_gaps(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps``: numbers missing between the first and the last turn."""
    return (
        turns.groupBy("conv_id")
        .agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("n"))
        .select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).alias("gaps"))
    )


def repair_digest(original: DataFrame, turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per conv_id of ``original``: counts, cost, audit and hash of the repaired ``turns``."""
    repaired = repair(turns, block_bits)
    nothing = hashlib.sha256(b"").hexdigest()
    out = original.select("conv_id").distinct()
    for more in (turn_gaps(turns), repaired.conversations, text_digests(repaired.turns)):
        names = [c for c in more.columns if c != "conv_id"]
        renamed = more.withColumnRenamed("conv_id", "_conv")
        out = out.join(renamed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(*out.columns, *names)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
