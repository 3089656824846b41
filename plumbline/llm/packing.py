"""Cost-balanced packing of token ids into sequences.

A sequence of ``SEQUENCE`` tokens costs, per piece of n tokens, ``linear * n + quadratic * n * n``: the second part is
attention inside the piece. A window of documents with N tokens gets N // SEQUENCE full sequences; the rest is made of sequences
whose lengths are powers of two, so nothing is padded. Documents are cut into whole sequences first; what is left of them is
placed in descending length, each into the sequence of lowest cost that still has room for all of it. Where none
has, the piece is cut: the sequence with most room takes what fits.

Documents are packed as they are read, in windows of about ``WINDOW`` tokens of a partition: no shuffle, memory of one window
and one document. Balance holds within a window, and each window adds at most log2(SEQUENCE) short sequences.

Null and empty texts are documents of the end id alone. Repeated rows and null ids are documents of their own. An empty table
gives no pieces. Sequence ids are unique, not dense.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.texts import BATCH_ROWS, batch_of, bounded_batches, slices
from plumbline.llm.tokens import encoder, end_mark

SEQUENCE, WINDOW = 2048, 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def capacities(tokens: int, sequence: int = SEQUENCE) -> np.ndarray:
    """Lengths of the sequences of a window: full ones, and powers of two for the rest."""
    rest = tokens % sequence
    powers = [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
    return np.array([sequence] * (tokens // sequence) + powers, dtype=np.int64)


def assign(lengths: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) covering every token once."""
    room = capacities(int(lengths.sum()), sequence)
    cost = np.zeros(len(room))
    size = room.copy()
    found: list[tuple[int, int, int, int, int]] = []

    def put(document: int, start: int, length: int, at: int) -> None:
        found.append((document, start, length, at, int(size[at] - room[at])))
        room[at] -= length
        cost[at] += LINEAR * length + QUADRATIC * length * length

    at = 0
    begun = np.zeros(len(lengths), dtype=np.int64)
    for document in np.flatnonzero(lengths >= sequence):
        for _ in range(int(lengths[document] // sequence)):
            put(int(document), int(begun[document]), sequence, at)
            begun[document] += sequence
            at += 1
    left = lengths - begun
    for document in np.argsort(-left, kind="stable"):
        start, length = int(begun[document]), int(left[document])
        while length:
            fits = room >= length
            if fits.any():
                target = int(np.where(fits, cost, np.inf).argmin())
                part = length
            else:
                target = int(room.argmax())
                part = int(room[target])
            put(int(document), start, part, target)
            start, length = start + part, length - part
    return found


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end: int = 1,
    sequence: int = SEQUENCE,
    window: int = WINDOW,
    leading: bool = False,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` (bytes) if wanted."""
    schema = T.StructType(
        [docs.schema[key]]
        + [
            T.StructField(n, T.LongType())
            for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        ]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )

    def packed(keys: list, ids: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(d) // 4 for d in ids], dtype=np.int64)
        rows = []
        for document, start, length, at, offset in assign(lengths, sequence):
            part = ids[document][4 * start : 4 * (start + length)]
            row = [keys[document], start, length, zlib.crc32(part), int(lengths[document]), first + at, offset]
            rows.append([*row, part] if with_ids else row)
        return batch_of(schema, list(zip(*rows))), first + len(capacities(int(lengths.sum()), sequence))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, close = encoder(tokenizer, leading).encode, end_mark(end)
        context = TaskContext.get()
        following = (context.partitionId() if context else 0) << 40
        keys: list = []
        ids: list[bytes] = []
        tokens = 0
        for batch in slices(batches, BATCH_ROWS):
            texts = [value or "" for value in batch.column("_text").to_pylist()]
            for name, found in zip(batch.column("_key").to_pylist(), encode(texts)):
                keys.append(name)
                ids.append(found + close)
                tokens += len(found) // 4 + 1
                if tokens >= window:
                    made, following = packed(keys, ids, following)
                    yield made
                    keys, ids, tokens = [], [], 0
        if ids:
            yield packed(keys, ids, following)[0]

    return bounded_batches(docs).select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)
