"""Conversation structure repair by depth-first branch-and-bound.

A conversation's rows are kept, given another role, deleted, or get empty turns
inserted beside them, so that their roles read as an optional system turn and
pairs of user and assistant. The cheapest edits are searched depth first with an
explicit stack: a lower bound of every suffix prunes what cannot beat the
incumbent (cost, audit), and a table per node (row, role before it) prunes
prefixes that are worse than one seen there. The search ends when the stack is
empty, which proves the incumbent optimal.

Rows are sorted by Spark and streamed; a task holds one character per row of a
conversation, not its texts. A conversation of more than ``SEGMENT`` rows is searched in segments, from every role that can
stand before a segment to every role after it; the segments' optima are chained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SEGMENT = 256

#: What stands before a row: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Initials that may follow, and what then stands before the next row.
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The user or assistant turn that may follow.
TURN = ("u", "u", "a", "u")
#: What may stand after a whole conversation.
ENDS = (START, ASSISTANT)
#: More than any cost.
NEVER = 1 << 60
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")

#: Characters that do not count in a text.
SPACES = " \t\n\x0b\x0c\r"
#: One character per row: initial (x for others) of a faultless row, in upper case if truncated; - if it must go.
MUST_GO = "-"


def _steps(row: str | None, at: int) -> Iterator[tuple[int, str, int, int]]:
    """``(cost, edit, rows passed, role after)`` of what may be done before ``row``, or with it."""
    if row is not None:
        yield DELETE, "D", 1, at
    yield INSERT, "I", 0, FOLLOWS[at][TURN[at]]
    if row is not None and row != MUST_GO:
        more = TRUNCATED if row.isupper() else 0
        after = FOLLOWS[at].get(row.lower())
        if after is not None:
            yield more + KEEP, "K", 1, after
        yield more + REROLE, "R", 1, FOLLOWS[at][TURN[at]]


def suffix_bounds(rows: str, goal: tuple[int, ...]) -> list[list[int]]:
    """Least cost of the rows from each place on, for each role before it, so that one of ``goal`` stands after them.

    The audit is left out, which makes this a bound of the pair (cost, audit).
    """
    low = [[NEVER] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        own = low[i]
        row = rows[i] if i < len(rows) else None
        for at in range(4):
            own[at] = 0 if row is None and at in goal else min(
                (cost + low[i + 1][after] for cost, _, passed, after in _steps(row, at) if passed), default=NEVER)
        for at in (USER, ASSISTANT, USER, SYSTEM, START):  # insertions go round between user and assistant once
            own[at] = min(own[at], INSERT + own[FOLLOWS[at][TURN[at]]])
    return low


def search(rows: str, before: int, goal: tuple[int, ...]) -> tuple[int, str] | None:
    """Cheapest (cost, audit) of ``rows``, ties to the least audit, with ``before`` before them and one of ``goal`` after; None if there is none."""
    low = suffix_bounds(rows, goal)
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, "", 0, before)]
    while stack:
        cost, audit, i, at = stack.pop()
        least = cost + low[i][at]
        if least >= NEVER or (best and (least, audit) > (best[0], best[1][:len(audit)])):
            continue  # bounded: no completion beats the incumbent
        if (i, at) in seen and seen[i, at] <= (cost, audit):
            continue  # dominated: an equal or better prefix was here
        seen[i, at] = (cost, audit)
        if i == len(rows) and at in goal and (best is None or (cost, audit) < best):
            best = (cost, audit)
        steps = [(cost + c + low[i + passed][after], edit, cost + c, i + passed, after)
                 for c, edit, passed, after in _steps(rows[i] if i < len(rows) else None, at)]
        # the most promising is popped first, of equal ones the least audit
        stack += [(c, audit + edit, j, after) for _, edit, c, j, after in sorted(steps, reverse=True)]
    return best


def solve(rows: str, segment: int = SEGMENT) -> tuple[int, str]:
    """Cheapest (cost, audit) of a whole conversation, ties to the least audit."""
    held = {(START,): (0, "")}
    for at in range(0, max(len(rows), 1), segment):
        new = {}
        for goal in [ENDS] if at + segment >= len(rows) else [(k,) for k in range(4)]:
            found = [(search(rows[at:at + segment], before, goal), *label) for (before,), label in held.items()]
            ways = [(cost + own[0], audit + own[1]) for own, cost, audit in found if own]
            if ways:
                new[goal] = min(ways)
        held = new
    return held[ENDS]


def _order(*more: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv_id", *more)]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage by ``crc32(conv_id:turn) % 20``, in which null ids and turns are one space.

    0 drops the row, 1 empties its text, 2 removes the ``.!?`` of its text, 3
    repeats it, 4 sets role user. Null roles and texts become one space first.
    """
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                                *(F.coalesce(F.col(c), space).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = rows.withColumn("kind", F.crc32(key.cast("binary")) % 20).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, position)``: rows of each conversation by turn, nulls first, then by role and text.

    Null roles and texts are one space. A null conv_id is a conversation like others.
    """
    own = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                      *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    w = Window.partitionBy("conv_id").orderBy(*_order("turn", "role", "text")[1:])
    return own.withColumn("position", F.row_number().over(w).cast("long"))


def faults(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, position, initial, fault, code)``: each row's first fault and its character for the search.

    Equal rows are told by a checksum of role and text, so a popular row is not one group.
    """
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    own = rows.select("conv_id", "turn", "position", F.substring("role", 1, 1).alias("initial"), last.alias("last"),
                      F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text"), 256).alias("same"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "same").orderBy("position")) > 1
    fault = F.when(F.col("last") == "", "blank").when(earlier, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    named = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(named)).otherwise(named)
    return own.withColumn("fault", fault).withColumn("code", code).select("conv_id", "turn", "position", "initial", "fault", "code")


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with each conversation's in one partition, in order."""
    return rows.repartition(F.col("conv_id")).sortWithinPartitions(*_order(*order))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def plans(marked: DataFrame) -> DataFrame:
    """``(conv_id, cost, audit)`` of every conversation of ``faults`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((conv, *solve("".join(r[1] for r in rows))) for conv, rows in groupby(_rows(batches), key=lambda r: r[0]))
        while some := list(islice(found, 1024)):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.int64(), pa.int64(), pa.string()),
                                                                   strict=True)], names=["conv_id", "cost", "audit"])

    return _sorted(marked.select("conv_id", "code", "position"), "position").select("conv_id", "code").mapInArrow(
        run, "conv_id long, cost long, audit string")


def summaries(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conv_id of ``ids``.

    ``rows`` are numbered. An id without rows has zeros and an empty audit.
    """
    marked = written(faults(rows), "conversation-faults")
    pair = F.concat(F.lag("initial").over(Window.partitionBy("conv_id").orderBy("position")), F.col("initial"))
    counted = marked.withColumn("pair", pair).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *(F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")),
        F.count_if(~F.col("pair").isin(*LEGAL_PAIRS)).alias("illegal"))
    out = _with(_with(ids.select(F.col("conv_id").cast("long")).distinct(), counted), plans(marked))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"))


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join by conv_id, in which null is an id like others."""
    names = [c for c in right.columns if c != "conv_id"]
    right = right.withColumnRenamed("conv_id", "__conv_id")
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("__conv_id")), "left").select(*left.columns, *names)


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``(conv_id, position, edit, role, text)`` of the sorted rows of conversations whose first row holds their audit."""
    for conv, own in groupby(rows, key=lambda r: r[0]):
        at, place = START, 0
        for edit, row in _paired(own):
            if edit != "D":
                role = row[3] if edit == "K" else ROLES[TURN[at]]
                at = FOLLOWS[at][role[0]]
                place += 1
                yield conv, place, edit, role, row[4] if row else ""


def _paired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edits with their rows, None for insertions; the first row holds the audit."""
    head = next(rows, None)
    for edit in head[2] if head else "":
        yield edit, None if edit == "I" else next(rows)


_REPAIRED = "conv_id long, position long, edit string, role string, text string"


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``(conv_id, position, edit, role, text)``: the rows of repaired conversations, in order within their partition.

    ``rows`` are numbered, ``plan`` holds conv_id and audit.
    """
    none = F.lit(None).cast("string")
    both = rows.select("conv_id", "position", none.alias("audit"), "role", "text").unionByName(
        plan.select("conv_id", F.lit(0).cast("long").alias("position"), "audit", none.alias("role"), none.alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _edited(_rows(batches))
        while some := list(islice(found, 256)):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (
                pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)],
                names=["conv_id", "position", "edit", "role", "text"])

    return _sorted(both, "position").mapInArrow(run, _REPAIRED)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The summary of every conversation of ``ids`` (of ``rows`` if None), and the rows of its repair.

    Of ``rows`` the columns conv_id, turn, role and text are read, others are ignored; null roles and texts are one space, null turns come
    first, a null conv_id is a conversation like others. Empty tables give no rows.
    """
    own = written(numbered(rows), "conversation-rows")
    summary = written(summaries(own, own if ids is None else ids), "conversation-summaries")
    return summary, repaired(own, summary)


def digest(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """The summary with a checksum of each conversation's repaired rows, ``role:text`` joined by newlines.

    ``rows`` come as ``repaired`` returns them; they are streamed through the checksum in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((conv, _checksum(own)) for conv, own in groupby(_rows(batches), key=lambda r: r[0]))
        while some := list(islice(found, 1024)):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.int64(), pa.string()), strict=True)],
                                  names=["conv_id", "repaired_sha256"])

    hashes = rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")
    return _with(summary, hashes).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def _checksum(rows: Iterator[tuple]) -> str:
    h = hashlib.sha256()
    for k, (_, role, text) in enumerate(rows):
        h.update(f"{chr(10) if k else ''}{role}:{text}".encode())
    return h.hexdigest()
