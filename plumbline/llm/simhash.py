"""SimHash near-duplicates through a Gray-order hierarchical index.

Documents are reduced to distinct 64-bit fingerprints before anything is compared, so exact copies cost one
row. Fingerprints at most ``distance`` bits apart agree on at least ``kept`` of ``blocks`` bit blocks when
``blocks - kept >= distance``: every choice of kept blocks is one table, and the leading bits of the kept blocks
are the routing key, as many as give groups of about ``GROUP`` fingerprints. Fewer key bits only make groups
larger, so no link is lost. Groups far above that (near copies agree on their keys) are cut into chunks and every
pair of chunks is one unit of work, so a hot group is spread over many tasks.

Inside a unit the fingerprints are sorted by their Gray rank, which puts similar ones side by side. Runs of the
sorted list are the leaves of a tree; every node keeps the bit positions all its members share and their values.
A pair of nodes whose shared bits already differ more often than ``distance`` is dropped as a whole; a pair
whose remaining bits cannot exceed it is accepted as a whole; only what is left is compared bit by bit.
A unit returns one link per fingerprint to the smallest member it is joined with, never pairs.

Null and empty texts have fingerprint zero and are linked like any other. Rows are never dropped: repeated ids
keep one row each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.llm.components import connected
from plumbline.llm.linking import union, units
from plumbline.llm.texts import map_texts
from plumbline.session import written

SEED = 42
#: Fingerprints in a routed group on average, and at most in a chunk.
GROUP, CHUNK = 1024, 4096
LEAF, FAN = 16, 8
#: Leaf pairs compared at once; bounds the memory of a unit.
AT_ONCE = 4096


def fingerprint(text: str, shingle: int = 4) -> int:
    """Bitwise majority of the XXH64 of all word shingles, repeats included, as a signed 64-bit number.

    A-Z are lower-cased. Fewer words than a shingle: the whole sequence is the only one. No word: zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(words) - n :] - 1).tolist()
    view = memoryview(joined)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * counts > n, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = 4) -> DataFrame:
    """``keys`` and ``fp`` of every row, from its whole text."""
    return map_texts(docs, keys, text, [T.StructField("fp", T.LongType())], lambda t: (fingerprint(t, shingle),))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray code."""
    rank = values.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


class GrayIndex:
    """Tree over fingerprints sorted by Gray rank; ``mask`` are the shared bits of a node, ``bits`` their values."""

    def __init__(self, values: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        ones, zeros, width = self.values, ~self.values, LEAF
        while True:
            at = np.arange(0, len(ones), width)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            self.levels.append((ones | zeros, ones))
            if len(at) == 1:
                break
            width = FAN

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Children of nodes, -1 where there is none: one row per node. Above its top a tree has one child, itself."""
        if level >= len(self.levels):
            return np.where(np.arange(FAN) == 0, nodes[:, None], -1)
        below = nodes[:, None] * FAN + np.arange(FAN)
        return np.where(below < len(self.levels[level - 1][0]), below, -1)


def links(a: GrayIndex, b: GrayIndex, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the given orders) to join so that all pairs within ``distance`` get connected."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    sizes = len(a.values), len(b.values)
    top = max(len(a.levels), len(b.levels)) - 1
    x = y = np.zeros(1, dtype=np.int64)
    for level in range(top, -1, -1):
        mask_a, bits_a = a.levels[min(level, len(a.levels) - 1)]
        mask_b, bits_b = b.levels[min(level, len(b.levels) - 1)]
        shared = mask_a[x] & mask_b[y]
        apart = np.bitwise_count((bits_a[x] ^ bits_b[y]) & shared)
        most = apart + np.bitwise_count(~shared)
        whole = most <= distance
        for i, j in zip(x[whole], y[whole]):
            rows = a.order[slice(*_span(a, level, i))]
            cols = b.order[slice(*_span(b, level, j))]
            left += [rows, np.full(len(cols), rows[0])]
            right += [np.full(len(rows), cols[0]), cols]
        open_ = (apart <= distance) & ~whole
        x, y = x[open_], y[open_]
        if level:
            down_a, down_b = a.children(level, x), b.children(level, y)
            grid_x, grid_y = np.repeat(down_a, FAN, axis=1).ravel(), np.tile(down_b, (1, FAN)).ravel()
            real = (grid_x >= 0) & (grid_y >= 0)
            if a is b:
                real &= grid_x <= grid_y
            x, y = grid_x[real], grid_y[real]
    for at in range(0, len(x), AT_ONCE):
        i = (x[at : at + AT_ONCE, None] * LEAF + np.arange(LEAF))[:, :, None]
        j = (y[at : at + AT_ONCE, None] * LEAF + np.arange(LEAF))[:, None, :]
        inside = (i < sizes[0]) & (j < sizes[1])
        i, j = np.minimum(i, sizes[0] - 1), np.minimum(j, sizes[1] - 1)
        near = inside & (np.bitwise_count(a.values[i] ^ b.values[j]) <= distance)
        which, row, col = np.nonzero(near)
        left.append(a.order[i[which, row, 0]])
        right.append(b.order[j[which, 0, col]])
    return np.concatenate([*left, np.zeros(0, int)]).astype(int), np.concatenate([*right, np.zeros(0, int)]).astype(int)


def _span(index: GrayIndex, level: int, node: int) -> tuple[int, int]:
    width = LEAF * FAN ** min(level, len(index.levels) - 1)
    return node * width, min((node + 1) * width, len(index.values))


def join_unit(fps: np.ndarray, side: np.ndarray, distance: int) -> pd.DataFrame:
    """Links of one unit: within the rows when there is one side, else between side 0 and side 1."""
    rank = np.argsort(fps, kind="stable")
    fps, side = fps[rank], side[rank]
    values = fps.astype(np.int64).view(np.uint64)
    if side.any() and not side.all():
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = links(GrayIndex(values[one]), GrayIndex(values[two]), distance)
        i, j = one[i], two[j]
    else:
        index = GrayIndex(values)
        i, j = links(index, index, distance)
    labels = union(np.arange(len(fps)), i, j)
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return pd.DataFrame({"src": fps[moved], "dst": fps[labels[moved]]})


def _kept_bits(chosen: tuple[int, ...], bounds: list[int], bits: int) -> Column:
    """The ``bits`` leading bits of the chosen blocks of ``fp``, taken in turns, as one number."""
    positions = [p for c in chosen for p in range(bounds[c], bounds[c + 1])][:bits]
    mask = sum(1 << p for p in positions)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def fingerprint_links(distinct: DataFrame, distance: int = 4, blocks: int = 6, kept: int = 2) -> DataFrame:
    """Links (src, dst) that connect all ``fp`` at most ``distance`` bits apart.

    ``distinct`` has one row per fingerprint. The length of the routing key follows from the number of rows.
    """
    if blocks - kept < distance:
        raise ValueError("two fingerprints could differ in every choice of kept blocks")
    bounds = [round(64 * b / blocks) for b in range(blocks + 1)]
    tables = list(combinations(range(blocks), kept))
    width = kept * (64 // blocks)
    bits = min(width, max(0, (distinct.count() // GROUP).bit_length()))
    routes = [F.struct(F.lit(t).alias("t"), _kept_bits(c, bounds, bits).alias("key")) for t, c in enumerate(tables)]
    routed = distinct.select("fp", F.inline(F.array(*routes)))
    crowded = (
        routed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK)
        .select("t", "key", F.ceil(F.col("n") / (CHUNK // 2)).cast("int").alias("chunks"))
    )
    # At most one crowded key per CHUNK rows of a table, usually few; written so that Spark knows their size.
    sized = routed.join(written(crowded, "simhash-crowded"), ["t", "key"], "left")
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    spread = sized.select("t", "key", "fp", chunks.alias("chunks"), own.alias("own")).select(
        "t",
        "key",
        "fp",
        F.col("own"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"),
    )
    placed = spread.select(
        F.col("t"),
        F.col("key"),
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "fp",
    )
    keys = ["t", "key", "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in units(batches, keys):
            if len(unit) > 1:
                yield join_unit(unit["fp"].to_numpy(), unit["side"].to_numpy(), distance)

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("src", "dst")])
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    distance: int = 4,
    others: tuple[str, ...] = (),
) -> DataFrame:
    """``key``, the columns ``others``, ``fp``, ``group`` and ``component`` of every row.

    Rows linked directly or over others have the same ``group`` (a fingerprint of theirs) and the same ``component``,
    their smallest key; null keys are ignored for it.
    """
    named = docs.select(F.col(key).alias("_key"), *others, F.col(text).alias("_text"))
    marked = written(fingerprints(named, ["_key", *others], "_text", shingle), "simhash-marked")
    distinct = written(marked.groupBy("fp").agg(F.min("_key").alias("first")), "simhash-distinct")
    roots = connected(fingerprint_links(distinct.select("fp"), distance))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = written(rooted.filter("root IS NOT NULL"), "simhash-linked")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    alone = rooted.filter("root IS NULL").select("fp", F.col("fp").alias("group"), F.col("first").alias("component"))
    of_fp = linked.join(smallest, "root").select("fp", F.col("root").alias("group"), "component").unionByName(alone)
    return marked.join(of_fp, "fp").select(F.col("_key").alias(key), *others, "fp", "group", "component")
