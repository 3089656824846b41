"""Conversation structure repair: faults, and the cheapest edits that make roles follow ``(s?(ua)+)?``.

1. Narrow rows. A message counts with its turn, role, a 128-bit digest of its text, and whether it is blank or cut off. Equal
   messages of a turn are one row with a count. The first place of every (conversation, role, text) is one aggregate, put
   beside the rows by a second one: no join, and no conversation or text that is hot goes to one task.
2. Segments. Rows are dealt by ranges of (conversation, turn, role, text), so a long conversation lies in many tasks. A
   task reads its rows in order and gives, per conversation and at most ``SEGMENT`` rows, the cheapest audit from every
   state of the automaton it may begin in to every state it may end in. Only the first conversation of a range can
   have begun earlier; all others begin with nothing.
3. Conversations. Their segments are put together in order: states, costs and audits, faults at the borders. Equal costs
   are decided by the ASCII-least audit, by a longest-common-prefix search in shared prefixes (``audits``). Two audits
   of equal cost to one place are never prefixes of each other, so the lesser one stays the lesser whatever follows.
4. Repair. Each conversation's audit meets its messages, sorted as in 2, in one stream: messages are kept, given a role,
   left out or put in, and written or hashed one after the other. SHA-256 has no parallel form, so this one step reads a long
   conversation in one task; it holds one message, and the audit, which is part of the result.

Rows stand by turn, nulls first; rows of one turn by role, then by the digest of their text. Null roles and texts are one
space. Rows without conversation form a conversation. Equal rows are duplicates of the first. A conversation without
rows (all have 0 copies) has zeros and an empty audit. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.llm.audits import FREE, FREE_ROLE, INSERT, NEXT, NOTHING, Conversation, Segment, cheapest
from plumbline.llm.texts import batch_of, slices
from plumbline.session import written

assert INSERT > 0  # inserts at no cost could be repeated for ever
SEGMENT = 1024
SPACE = " \t\n\x0b\x0c\r"
ORDER = ["_has", "_turn", "_role", "_digest"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def messages(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """Conversation, order columns, copies and text under the module's names."""
    texts = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        F.col(conv).cast("long").alias("_conv"),
        F.col(turn).isNotNull().alias("_has"),
        F.col(turn).cast("long").alias("_turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("_role"),
        F.substring(F.unhex(F.sha2(texts, 256)), 1, 16).alias("_digest"),
        (F.col(copies) if copies else F.lit(1)).cast("long").alias("_copies"),
        texts.alias("_text"),
    )


def _ends(text: str) -> Column:
    """Last character that is not space, empty if there is none."""
    return F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))


def narrow_rows(said: DataFrame) -> DataFrame:
    """Distinct messages of every conversation and turn, their number, and whether an earlier one is equal."""
    end = _ends("_text")
    rows = said.filter("_copies > 0").select(
        "_conv", *ORDER, "_copies", (end == "").alias("_blank"), (~end.isin("", ".", "!", "?")).alias("_cut"), F.lit(False).alias("_first")
    )
    place = F.min(F.struct("_has", "_turn")).alias("_place")
    first = rows.groupBy("_conv", "_role", "_digest").agg(place).select(
        "_conv", "_place._has", "_place._turn", "_role", "_digest", F.lit(0).cast("long").alias("_copies"),
        F.lit(False).alias("_blank"), F.lit(False).alias("_cut"), F.lit(True).alias("_first"),
    )
    return rows.union(first).groupBy("_conv", *ORDER).agg(
        F.sum("_copies").alias("_copies"), F.max("_blank").alias("_blank"), F.max("_cut").alias("_cut"), F.max("_first").alias("_first")
    )


_LONG, _TEXT = T.LongType(), T.StringType()
_MOVE = T.StructType(
    [T.StructField("entry", _LONG), T.StructField("exit", _LONG), T.StructField("cost", _LONG), T.StructField("audit", _TEXT)]
)
_STATS = ["blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn"]
_SEGMENTS = T.StructType(
    [T.StructField(n, _LONG) for n in ("_conv", "part", "number", *_STATS)]
    + [T.StructField("first", _TEXT), T.StructField("last", _TEXT), T.StructField("moves", T.ArrayType(_MOVE))]
)
_AUDITS = T.StructType([T.StructField(n, _LONG) for n in ("_conv", *COUNTS)] + [T.StructField("audit", _TEXT)])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    segment: Segment | None = None
    conv, number, made = None, 0, []

    def close() -> None:
        stats = [getattr(segment, name) for name in _STATS]
        made.append((conv, part, number, *stats, segment.first, segment.last, segment.moves()))

    def give() -> pa.RecordBatch:
        batch = batch_of(_SEGMENTS, [list(column) for column in zip(*made)])
        made.clear()
        return batch

    names = ["_conv", "_turn", "_role", "_copies", "_blank", "_cut", "_first"]
    for batch in slices(batches):
        for at, turn, role, copies, blank, cut, first in zip(*[batch.column(n).to_pylist() for n in names]):
            if segment is None or at != conv:
                if segment is not None:
                    close()
                begins = segment is not None
                conv, number, segment = at, 0, Segment(begins)
            for i in range(copies):
                if segment.rows >= SEGMENT:
                    close()
                    number, segment = number + 1, Segment(False)
                segment.add(role[:1], turn, blank, i > 0 or not first, cut)
                if len(made) >= 64:
                    yield give()
    if segment is not None:
        close()
    if made:
        yield give()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks (part -1) and segments, sorted by conversation and place, put together per conversation."""
    now: Conversation | None = None
    conv = None

    def close() -> tuple:
        cost, audit = cheapest(now.audits, now.best)
        return (conv, now.gaps(), now.blank, now.duplicate, now.truncated, now.illegal, cost, audit)

    for batch in slices(batches, 64):
        made = []
        for row in batch.to_pylist():
            if row["part"] < 0:
                if now is not None:
                    made.append(close())
                conv, now = row["_conv"], Conversation()
            else:
                now.add(row)
        if made:
            yield batch_of(_AUDITS, [list(column) for column in zip(*made)])
    if now is not None:
        yield batch_of(_AUDITS, [[value] for value in close()])


def audited(said: DataFrame) -> DataFrame:
    """``_conv``, the counts and ``audit`` of every conversation of ``messages``."""
    rows = written(narrow_rows(said), "conversation-rows")
    keys = ["_conv", *ORDER]
    segments = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_segments, _SEGMENTS)
    marks = said.select("_conv").distinct().withColumn("part", F.lit(-1).cast("long"))
    both = segments.unionByName(marks, allowMissingColumns=True)
    return both.repartition("_conv").sortWithinPartitions("_conv", "part", "number").mapInArrow(_conversations, _AUDITS)


class _Reader:
    """Messages of one conversation after another, edited as its audit says."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _free(self) -> str:
        role, self.state = FREE_ROLE[self.state], FREE[self.state]
        return role

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit.startswith("I", self.at):
            self.at += 1
            yield self._free(), ""

    def edit(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = NEXT[self.state, role[:1]]
            yield role, text
        elif letter == "R":
            yield self._free(), text


def _apply(said: DataFrame, audits: DataFrame, schema: T.StructType, begin: Callable, end: Callable, every: Callable) -> DataFrame:
    """Stream audits and their messages; ``begin``, ``every`` message and ``end`` return rows of ``schema`` or nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, state, names = None, None, ["_audit_row", "_role", "_text", "_copies"]

        for batch in slices(batches, 200):
            made = []
            for audit, role, text, copies in zip(*[batch.column(n).to_pylist() for n in names]):
                if audit is not None:
                    if reader is not None:
                        for pair in reader.inserts():
                            made += every(state, *pair)
                        made += end(state)
                    reader, state = _Reader(audit["audit"]), begin(audit)
                    continue
                for _ in range(copies):
                    for pair in reader.edit(role, text):
                        made += every(state, *pair)
            if made:
                yield batch_of(schema, [list(column) for column in zip(*made)])
        if reader is not None:
            made = []
            for pair in reader.inserts():
                made += every(state, *pair)
            made += end(state)
            if made:
                yield batch_of(schema, [list(column) for column in zip(*made)])

    heads = audits.select("_conv", F.struct(*_AUDITS.names).alias("_audit_row"), F.lit(0).alias("_kind"))
    rows = said.filter("_copies > 0").withColumn("_kind", F.lit(1))
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition("_conv").sortWithinPartitions("_conv", "_kind", *ORDER).mapInArrow(run, schema)


def repaired_messages(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None
) -> DataFrame:
    """``conv``, ``position``, ``role`` and ``text`` of every message of the repaired conversations."""
    said = messages(rows, conv, turn, role, text, copies)
    audits = written(audited(said), "conversation-audits")
    schema = T.StructType([T.StructField(conv, _LONG), T.StructField("position", _LONG), T.StructField("role", _TEXT), T.StructField("text", _TEXT)])

    def every(state: list, role: str, text: str) -> list[tuple]:
        state[1] += 1
        return [(state[0], state[1] - 1, role, text)]

    return _apply(said, audits, schema, lambda audit: [audit["_conv"], 0], lambda state: [], every)


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None
) -> DataFrame:
    """One row per conversation: ``conv``, faults, ``cost``, ``audit`` and the SHA-256 of the repaired ``role:text`` lines.

    ``copies`` names a column with the number of times a row stands there; rows with 0 copies only name their conversation.
    """
    said = messages(rows, conv, turn, role, text, copies)
    audits = written(audited(said), "conversation-audits")
    schema = T.StructType([T.StructField(conv, _LONG), *_AUDITS.fields[1:], T.StructField("repaired_sha256", _TEXT)])

    def begin(audit: dict) -> list:
        return [audit, hashlib.sha256(), b""]

    def every(state: list, role: str, text: str) -> list[tuple]:
        state[1].update(state[2] + f"{role}:{text}".encode())
        state[2] = b"\n"
        return []

    def end(state: list) -> list[tuple]:
        return [(*state[0].values(), state[1].hexdigest())]

    return _apply(said, audits, schema, begin, end, every)
