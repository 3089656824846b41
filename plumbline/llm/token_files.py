"""Token ids of a corpus as files of coded blocks, in document order, and their reader.

Writing: documents are dealt into ranges of ascending id (equal ids by a hash of their text, null ids first), encoded
whole, and cut into frames of about ``FRAME`` ids. A frame is a row of the table of files: its place (``part``, ``frame``), the ids
and token counts of its documents, and its coded blocks (see ``mixing_coder``). A document lies in one frame, however
long. Tasks hold the ids of one group of frames at a time; nothing is gathered elsewhere.

Reading: frames are decoded independently and may be read in any order. A document's start is the number of ids of all earlier
parts, from one row per part, plus its place in its own part.

Null and empty texts are documents of the end id alone. Repeated rows are documents of their own, in neighbouring places.
An empty table gives files without rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from plumbline.llm.mixing_coder import BLOCK, LANES, decode_blocks, encode_blocks, split_blocks
from plumbline.llm.texts import BATCH_ROWS, batch_of, bounded_batches, slices
from plumbline.llm.tokens import encoder, end_mark
from plumbline.session import scratch_dir

#: Pieces a task's encoder remembers beside the arrays of the coder.
KEEP = 300_000
#: Ids of a frame, from which on it is closed; frames coded side by side.
FRAME = 64 * BLOCK
TOGETHER = LANES * BLOCK // FRAME

SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("blocks", T.BinaryType()),
    ]
)


def write_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end: int = 2,
    leading: bool = True,
) -> None:
    """Encode every whole text, append ``end``, and write the coded ids in ascending order of the integer ``key``."""

    def frames_of(frames: list[tuple[int, int, list, list[bytes]]], part: int) -> pa.RecordBatch:
        blocks: list[np.ndarray] = []
        cuts = [0]
        for _, _, _, ids in frames:
            whole = np.frombuffer(b"".join(ids), dtype="<u4")
            blocks += [whole[at : at + BLOCK] for at in range(0, len(whole), BLOCK)]
            cuts.append(len(blocks))
        coded = encode_blocks(blocks)
        rows = [
            (part, frame, first, sum(map(len, ids)) // 4, keys, [len(d) // 4 for d in ids], b"".join(coded[a:b]))
            for (frame, first, keys, ids), a, b in zip(frames, cuts, cuts[1:])
        ]
        return batch_of(SCHEMA, list(zip(*rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, close = encoder(tokenizer, leading, KEEP).encode, end_mark(end)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        frames: list[tuple[int, int, list, list[bytes]]] = []
        keys: list = []
        ids: list[bytes] = []
        number = first = tokens = 0
        for batch in slices(batches, BATCH_ROWS):
            texts = [value or "" for value in batch.column("_text").to_pylist()]
            for name, found in zip(batch.column("_key").to_pylist(), encode(texts)):
                keys.append(name)
                ids.append(found + close)
                tokens += len(found) // 4 + 1
                if tokens >= FRAME:
                    frames.append((number, first, keys, ids))
                    number, first, tokens, keys, ids = number + 1, first + tokens, 0, [], []
                    # A document longer than many frames counts as many.
                    if sum(sum(map(len, f[3])) for f in frames) >= 4 * TOGETHER * FRAME:
                        yield frames_of(frames, part)
                        frames = []
        if ids:
            frames.append((number, first, keys, ids))
        if frames:
            yield frames_of(frames, part)

    named = bounded_batches(docs).select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    tie = F.xxhash64("_text")
    ordered = named.withColumn("_tie", tie).repartitionByRange("_key", "_tie").sortWithinPartitions("_key", "_tie")
    ordered.select("_key", "_text").mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(path)


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, and its ``ids`` (bytes) if wanted."""
    files = spark.read.schema(SCHEMA).parquet(path)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per part of the files.
    bases = files.groupBy("part").agg(F.sum("tokens").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    fields = [
        T.StructField("part", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    fields += [T.StructField("ids", T.BinaryType())] if with_ids else []
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(at, TOGETHER).to_pylist()
                split = [split_blocks(row["blocks"]) for row in rows]
                decoded = iter(decode_blocks([block for blocks in split for block in blocks]))
                for row, blocks in zip(rows, split):
                    ids = np.concatenate([next(decoded) for _ in blocks]).astype("<u4").tobytes()
                    counts = np.array(row["counts"], dtype=np.int64)
                    stops = np.cumsum(counts)
                    parts = [ids[4 * a : 4 * b] for a, b in zip(stops - counts, stops)]
                    made = [
                        [row["part"]] * len(counts),
                        row["keys"],
                        row["first"] + stops - counts,
                        counts,
                        [zlib.crc32(part) for part in parts],
                    ]
                    yield batch_of(schema, [*made, parts] if with_ids else made)

    found = files.select("part", "first", "keys", "counts", "blocks").mapInArrow(run, schema)
    start = (F.col("_base") + F.col("place")).alias("start")
    extra = ["ids"] if with_ids else []
    return found.join(bases, "part").select("doc_id", start, "n_tokens", "ids_crc32", *extra)


def new_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
