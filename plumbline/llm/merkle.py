"""Merkle manifest of documents: per-source trees of runs of 16 below one tree of the sources, with bitmap ranks.

1. Leaves. A document's leaf is the SHA-256 of its fields; only ids and digests go on. Equal rows become one with a count.
2. Bitmaps. Every batch turns its ids into one compressed bitmap per (source, id >> 12): a sorted list of 16-bit numbers
   or, where that is longer, 4,096 bits. The bitmaps of a group are merged (OR) in ranges of (source, id >> 12), and every
   merged one gets the number of ids before it: the directory.
3. Ranks. A leaf's position in its source is the directory's number plus the population count below its bit. Leaves only
   meet their bitmap (at most 4,096 ids a group, whatever the source's size) and are never sorted by id.
4. Levels. Position 16 i + s is slot s of node i: one grouping by (source, node) fills arrays of at most 16 slots, their
   hash is the node above. The number of levels is the logarithm of the largest source; every level is written.
5. Paths. From the root down every node takes its parent's path and puts its own run before it. A document's path
   (slot and run on every level up to the root) is its proof.

Ids that occur in several rows of a source stand in the order of their leaves; the bitmap keeps how many there are. A
group of such rows is one ordered stream of digests. Rows without id stand first, rows without source are a source of their own,
before all others. Null fields are written ``-``, empty texts are ``0:``. Equal rows each have their own position and proof.
An empty table gives no rows. Columns that are neither fields nor carried are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from plumbline.llm.texts import batch_of
from plumbline.session import written

RUN_BITS = 4
#: Ids of a group: about what a task handles at once, so that a source is dealt over many tasks.
CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS

#: Fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(*fields: str | Column) -> Column:
    """Digest of the fields: byte count, colon and value of each, ``-`` for null."""

    def part(field: str | Column) -> Column:
        value = (F.col(field) if isinstance(field, str) else field).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return sha256(F.concat(*[part(f) for f in fields]))


def node(run: Column) -> Column:
    """Digest of the digests of a run, as hex text one after the other."""
    return sha256(F.array_join(F.transform(run, hex_of), ""))


# Compressed bitmaps -----------------------------------------------------------------------------


def pack_ids(low: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes, int]:
    """Bitmap of sorted distinct numbers of a group, what repeated ones have beyond one, and the sum of the counts."""
    bits = low.astype("<u2").tobytes()
    if len(bits) >= CHUNK // 8:
        full = np.zeros(CHUNK, bool)
        full[low] = True
        bits = np.packbits(full).tobytes()
    again = count > 1
    extra = low[again].astype("<u2").tobytes() + (count[again] - 1).astype("<i8").tobytes()
    return bits, extra, int(count.sum())


def unpack_ids(bits: bytes, extra: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a bitmap in order, and their counts."""
    if len(bits) == CHUNK // 8:
        low = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
    else:
        low = np.frombuffer(bits, "<u2").astype(np.int64)
    count = np.ones(len(low), np.int64)
    n = len(extra) // 10
    count[np.searchsorted(low, np.frombuffer(extra, "<u2", n))] += np.frombuffer(extra, "<i8", n, 2 * n)
    return low, count


def merge_ids(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Union of bitmaps with added counts."""
    total = np.zeros(CHUNK, np.int64)
    for bits, extra in parts:
        low, count = unpack_ids(bits, extra)
        total[low] += count
    low = np.flatnonzero(total)
    return low, total[low]


class Ranks:
    """Popcount directory of one bitmap: how many rows have a smaller number, and what was already handed out."""

    def __init__(self, bits: bytes, extra: bytes, base: int) -> None:
        self.low, count = unpack_ids(bits, extra)
        self.before = base + np.concatenate([[0], np.cumsum(count)[:-1]])
        self.repeated = bool(len(extra))
        self.used = np.zeros(len(self.low), np.int64) if self.repeated else None

    def positions(self, low: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """First position of every row; rows of one number come in the order in which they stand."""
        at = np.searchsorted(self.low, low)
        first = self.before[at]
        if self.repeated and len(at):
            order = np.argsort(at, kind="stable")
            same = at[order]
            running = np.cumsum(copies[order]) - copies[order]
            starts = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
            inside = running - np.repeat(running[starts], np.diff(np.append(starts, len(same))))
            first = first.copy()
            first[order] += inside + self.used[same]
            np.add.at(self.used, at, copies)
        return first


GROUP = ["_has", "_source"]
_KEY = [T.StructField("_has", T.BooleanType()), T.StructField("_source", T.StringType()), T.StructField("_chunk", T.LongType())]
_BITS = [T.StructField("_bits", T.BinaryType()), T.StructField("_extra", T.BinaryType())]
_FRAGMENT = T.StructType(_KEY + _BITS)
_MERGED = T.StructType(_KEY + _BITS + [T.StructField(n, T.LongType()) for n in ("_n", "_before", "_part")])


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        frame = batch.to_pandas()
        made = []
        for key, rows in frame.groupby(["_has", "_source", "_chunk"], dropna=False, sort=False):
            low, inverse = np.unique(rows["_low"].to_numpy(), return_inverse=True)
            count = np.zeros(len(low), np.int64)
            np.add.at(count, inverse, rows["_copies"].to_numpy())
            chunk = None if key[2] != key[2] else int(key[2])
            made.append((bool(key[0]), key[1], chunk, *pack_ids(low, count)[:2]))
        if made:
            yield batch_of(_FRAGMENT, [list(column) for column in zip(*made)])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments sorted by (source, chunk): one bitmap per key, with the rows of the source before it in this task."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    key, waiting, before = None, [], 0

    def close() -> tuple:
        packed = pack_ids(*merge_ids(waiting))
        return (*key, *packed, before, part)

    for batch in batches:
        made = []
        for *at, bits, extra in zip(*[batch.column(n).to_pylist() for n in _FRAGMENT.names]):
            if key is not None and at != key:
                made.append(close())
                before = before + made[-1][5] if at[:2] == key[:2] else 0
                waiting = []
            key = at
            waiting.append((bits, extra))
        if made:
            yield batch_of(_MERGED, [list(column) for column in zip(*made)])
    if waiting:
        yield batch_of(_MERGED, [[value] for value in close()])


def _ranker(schema: T.StructType, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, total = None, 0
        for batch in batches:
            is_leaf = batch.column("_kind").to_numpy(zero_copy_only=False) == 1
            heads = np.flatnonzero(~is_leaf)
            cuts = [0, *heads.tolist(), batch.num_rows]
            low, copies = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_low", "_copies"))
            first, of = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b in zip(cuts, cuts[1:]):
                if a < b and not is_leaf[a]:
                    bits, extra, base, total = (batch.column(n)[a].as_py() for n in ("_bits", "_extra", "_base", "_total"))
                    ranks = Ranks(bits, extra, base)
                    a += 1
                if a < b:
                    first[a:b], of[a:b] = ranks.positions(low[a:b], copies[a:b]), total
            many = np.where(is_leaf, copies, 0)
            rows = np.repeat(np.arange(batch.num_rows), many)
            inside = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
            for at in range(0, len(rows), 10_000):  # a row with many copies becomes many rows, some at a time
                take = rows[at : at + 10_000]
                kept = [batch.column(n).take(pa.array(take)) for n in carried]
                yield batch_of(schema, [*kept, first[take] + inside[at : at + 10_000], of[take]])

    return run


def ranked(leaves: DataFrame, carried: list[str]) -> DataFrame:
    """Leaves (``_has``, ``_source``, ``_id``, ``_leaf``, ``_copies``, carried) with ``at`` in their source and its ``total``."""
    placed = leaves.select(
        "*",
        F.shiftright("_id", CHUNK_BITS).alias("_chunk"),
        F.coalesce(F.col("_id").bitwiseAND(F.lit(CHUNK - 1)), F.lit(0)).cast("int").alias("_low"),
    )
    key = [*GROUP, "_chunk"]
    fragments = written(placed.select(*key, "_low", "_copies").mapInArrow(_fragments, _FRAGMENT), "manifest-fragments")
    merged = fragments.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_merged, _MERGED)
    bitmaps = written(merged, "manifest-bitmaps")
    parts = bitmaps.groupBy(*GROUP, "_part").agg(F.sum("_n").alias("_n"))  # one row per source, and one more per range border
    earlier = W.partitionBy(*GROUP).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *GROUP,
        "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy(*GROUP)).alias("_total"),
    )
    directory = bitmaps.join(offsets, [*GROUP, "_part"]).select(
        *key, F.lit(0).alias("_kind"), F.lit(0).alias("_low"), F.lit(0).cast("long").alias("_copies"), "_bits", "_extra", (F.col("_offset") + F.col("_before")).alias("_base"), "_total"
    )
    both = placed.withColumn("_kind", F.lit(1)).unionByName(directory, allowMissingColumns=True)
    streams = both.repartition(*key).sortWithinPartitions(*key, "_kind", "_leaf", *[c for c in carried if c not in (*GROUP, "_leaf")])
    kept = T.StructType([leaves.schema[c] for c in carried] + [T.StructField(n, T.LongType()) for n in ("at", "total")])
    return streams.mapInArrow(_ranker(kept, carried), kept)


# Levels and paths -------------------------------------------------------------------------------


def levels_of(nodes: DataFrame, keys: list[str], largest: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level (``up``, ``run``, ``total``) above ``nodes`` (``at``, ``digest``, ``total``), and the top of every
    tree (``digest`` and ``depth``)."""
    levels, tops = [], nodes.filter("total = 1").select(*keys, "digest", F.lit(0).alias("depth"))
    while largest > 1:
        slots = F.array_sort(F.collect_list(F.struct("at", "digest")))
        grouped = nodes.filter("total > 1").groupBy(*keys, F.shiftright("at", RUN_BITS).alias("up"))
        runs = grouped.agg(F.transform(slots, lambda s: s["digest"]).alias("run"), F.max("total").alias("total"))
        levels.append(written(runs, "manifest-level"))
        above = F.shiftright(F.col("total") + ((1 << RUN_BITS) - 1), RUN_BITS)
        nodes = levels[-1].select(*keys, F.col("up").alias("at"), node(F.col("run")).alias("digest"), above.alias("total"))
        tops = tops.union(nodes.filter("total = 1").select(*keys, "digest", F.lit(len(levels)).alias("depth")))
        largest = (largest + (1 << RUN_BITS) - 1) >> RUN_BITS
    return levels, tops


def step(slot: Column, run: Column) -> Column:
    return F.struct(slot.cast("int").alias("slot"), run.alias("run"))


def paths_of(levels: list[DataFrame], tops: DataFrame, keys: list[str]) -> DataFrame:
    """``at``, ``subroot`` and ``path`` of every lowest node, from the ``subroot`` and ``path`` of the trees' tops."""
    found = None
    for level in range(len(levels), -1, -1):
        here = tops.filter(F.col("depth") == level).select(*keys, F.lit(0).cast("long").alias("at"), "subroot", "path")
        if found is not None:
            above = found.withColumnsRenamed({"at": "up", "path": "_above"})
            joined = levels[level].join(above, [*keys, "up"])
            spread = joined.select("*", F.explode(F.sequence(F.lit(0), F.size("run") - 1)).alias("_slot"))
            at = F.shiftleft("up", RUN_BITS) + F.col("_slot")
            path = F.concat(F.array(step(F.col("_slot"), F.col("run"))), "_above")
            here = here.union(spread.select(*keys, at.alias("at"), "subroot", path.alias("path")))
        found = here
    return found


def _sources(tops: DataFrame) -> DataFrame:
    """Position ``at`` of every source among the ``total`` ones, by ranges of their names."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = tops.repartitionByRange(*GROUP).sortWithinPartitions(*GROUP)
    placed = written(spread.select(*GROUP, "digest", "depth", F.spark_partition_id().alias("_part"), within.alias("_within")), "manifest-sources")
    parts = placed.groupBy("_part").count()  # one row per range, so these windows are small
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"), F.sum("count").over(W.partitionBy()).alias("total")
    )
    return placed.join(offsets, "_part").select(*GROUP, "digest", "depth", (F.col("_offset") + F.col("_within")).alias("at"), "total")


def manifest(docs: DataFrame, carry: list[str] = [], fields: tuple[str, ...] = FIELDS, key: str = "doc_id", source: str = "source") -> DataFrame:
    """``key``, the columns ``carry``, ``leaf``, ``subroot``, ``root`` and ``path`` of every row; digests are binary.

    ``path`` lists, from the leaf's run up to the root's, the row's ``slot`` and the whole ``run``; the proof is what ``proof``
    makes of it and ``fold`` recomputes the root. ``key`` must be an integer column.
    """
    ours = (key, "leaf", "subroot", "root", "path")
    carry = [c for c in carry if c not in ours]
    carried = [*GROUP, "_id", "_leaf", *[f"_in_{c}" for c in carry]]
    rows = docs.select(
        F.col(source).isNotNull().alias("_has"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        F.col(key).cast("long").alias("_id"),
        leaf(*fields).alias("_leaf"),
        *[F.col(c).alias(f"_in_{c}") for c in carry],
    )
    leaves = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies")), "manifest-leaves")
    placed = ranked(leaves, carried)
    slots = F.array_sort(F.collect_list(F.struct("at", *carried[2:])))
    grouped = placed.groupBy(*GROUP, F.shiftright("at", RUN_BITS).alias("up")).agg(slots.alias("rows"), F.max("total").alias("total"))
    runs = written(grouped, "manifest-leaf-runs").withColumn("run", F.transform("rows", lambda r: r["_leaf"]))
    above = F.greatest(F.lit(1), F.shiftright(F.col("total") + ((1 << RUN_BITS) - 1), RUN_BITS))
    # The only leaf of a source is its subroot and is not hashed again.
    digest = F.when(F.col("total") > 1, node(F.col("run"))).otherwise(F.col("run")[0])
    nodes = runs.select(*GROUP, F.col("up").alias("at"), digest.alias("digest"), above.alias("total"))
    levels, subroots = levels_of(nodes, GROUP, nodes.agg(F.max("total")).first()[0] or 0)
    sources = written(_sources(subroots).withColumn("_all", F.lit(0)), "manifest-subroots")
    of_sources, top = levels_of(sources, ["_all"], sources.count())
    root = top.select("digest").first()
    top = top.select("_all", "depth", F.col("digest").alias("subroot"), F.array().cast("array<struct<slot:int,run:array<binary>>>").alias("path"))
    source_paths = paths_of(of_sources, top, ["_all"]).select("at", "path")
    tops = sources.join(source_paths, "at").select(*GROUP, "depth", F.col("digest").alias("subroot"), "path")
    paths = paths_of(levels, tops, GROUP).withColumnsRenamed({"at": "up", "path": "_above"})
    each = runs.join(paths, [*GROUP, "up"]).select("*", F.posexplode("rows").alias("_slot", "_row"))
    own = F.array(step(F.col("_slot"), F.col("run")))
    return each.select(
        F.col("_row._id").alias(key),
        *[F.col(f"_row._in_{c}").alias(c) for c in carry],
        F.col("_row._leaf").alias("leaf"),
        "subroot",
        F.lit(root[0] if root else None).cast("binary").alias("root"),
        F.when(F.col("total") > 1, F.concat(own, "_above")).otherwise(F.col("_above")).alias("path"),
    )


def proof(path: str = "path") -> Column:
    """Hex digests of all siblings, level by level and left to right, as one text."""

    def siblings(s: Column) -> Column:
        others = F.filter(s["run"], lambda _, i: i != s["slot"])
        return F.array_join(F.transform(others, hex_of), "")

    return F.array_join(F.transform(path, siblings), "")


def fold(digest: Column, path: str = "path") -> Column:
    """The root recomputed from a leaf's digest and the siblings of its path."""

    def up(below: Column, s: Column) -> Column:
        return node(F.transform(s["run"], lambda x, i: F.when(i == s["slot"], below).otherwise(x)))

    return F.aggregate(path, digest, up)
