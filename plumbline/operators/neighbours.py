"""Exact nearest historical analogs as blocked joins over a pivot table.

Every candidate knows its distances to a few pivots, rows of a bounded sample that lie far apart. Candidates of a group are cut
into blocks of bounded size, ordered by their nearest pivot and the distance to it. By the triangle inequality the distance of a
query to a block is at least the largest gap between its own pivot distances and the ranges of the block's. Blocks in a row make
a shelf, queries with the same home shelf a chunk. A chunk first visits its home shelf, which limits the k-th distance of its
queries; then every query visits the shelves whose bound does not exceed that. Inside a task the blocks' bounds leave out what is
too far, a product of matrices tells which pairs may count, and these are measured exactly. Vectors are sent once per
shelf (or chunk) they meet, not once per block; pairs of rows never leave a task: each visit returns the k best of one shelf. Large
groups and crowded blocks are split further on both sides, so no task depends on the size of a group. The result does not
depend on the pivots. Vectors with null or non-finite components are at no distance: they find nothing and are not found.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline import contract as C
from plumbline.functions.ranks import BUCKET, bucket_count, edges_of, with_bucket
from plumbline.functions.scalars import is_finite
from plumbline.session import written

BLOCK_ROWS = 2048
#: Candidates of a shelf and queries of a chunk at most (a shelf may hold twice as many); small tables are cut into SHELVES.
SHELF_ROWS, QUERY_ROWS, SHELVES, LEAST_ROWS = 1 << 14, 1 << 14, 6, 1024
#: Queries and candidates compared by one product of matrices, and pairs of a query measured one by one.
TILE, PAIRS = 1024, 64
DISTANCE_DECIMALS = 12
#: Pivots, and the rows they are chosen from: the only rows that reach the driver.
PIVOTS, PIVOT_SAMPLE = 16, 1024
_SLACK = 1e-9


def scaler_stats(train: DataFrame, features: list[str]) -> DataFrame:
    """Population mean and scale per feature (long form); a constant feature gets scale 1."""
    wide = train.agg(
        *[F.avg(f).alias(f"{f}__mean") for f in features], *[F.stddev_pop(f).alias(f"{f}__scale") for f in features]
    )
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"{f}__mean").alias("mean"),
            F.when(F.col(f"{f}__scale") == 0, F.lit(1.0)).otherwise(F.col(f"{f}__scale")).alias("scale"),
        )
        for f in features
    ]
    return wide.select(F.inline(F.array(*rows)))


def scaled_vector(stats: DataFrame, features: list[str], out: str = "x"):
    """Column of scaled features in the given order; only the small fitted table reaches the driver."""
    fitted = {row["feature"]: row for row in stats.collect()}
    entries = [(F.col(f) - F.lit(fitted[f]["mean"])) / F.lit(fitted[f]["scale"]) for f in features]
    return F.array(*entries).alias(out)


def pivots_of(candidates: DataFrame) -> np.ndarray:
    """Rows of a bounded sample, each the farthest from those before it; none for an empty table."""
    sample = candidates.select("cid", "x").orderBy(F.xxhash64("cid"), "cid").limit(PIVOT_SAMPLE).toArrow().column("x").to_pylist()
    rows = np.array(sorted(sample), dtype=float) if sample else np.zeros((0, 0))
    chosen, nearest = [], np.full(len(rows), np.inf)
    while len(chosen) < min(PIVOTS, len(rows)):
        at = int(nearest.argmax())
        if nearest[at] == 0:
            break
        chosen.append(at)
        nearest = np.minimum(nearest, ((rows - rows[at]) ** 2).sum(axis=1))
    return rows[chosen]


def _with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``_d``, the distances to the pivots."""

    @F.pandas_udf("array<double>")
    def distances(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, pivots.shape[1]))
        return pd.Series(list(np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], axis=1))))

    return rows.withColumn("_d", distances("x") if len(pivots) else F.array().cast("array<double>"))


def _gap(directory_low: str = "lo", directory_high: str = "hi") -> Column:
    """Lower bound of the distance between a query (``_d``) and the rows of a block."""
    below = F.zip_with("_d", directory_high, lambda d, high: d - high)
    above = F.zip_with("_d", directory_low, lambda d, low: low - d)
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(below), F.lit(0.0)), F.coalesce(F.array_max(above), F.lit(0.0)))


def _placed(rows: DataFrame) -> DataFrame:
    """Add the nearest pivot (``_cell``) and the distance to it (``_r``)."""
    near = F.coalesce(F.array_min("_d"), F.lit(0.0))
    return rows.withColumn("_r", near).withColumn("_cell", F.coalesce(F.array_position("_d", F.col("_r")), F.lit(0)).cast("int"))


def _ranges(rows: DataFrame, keys: list[str], pivots: np.ndarray) -> DataFrame:
    """Least and largest distance to every pivot."""
    ends = lambda end: F.array(*[end(F.col("_d")[i]) for i in range(len(pivots))]).cast("array<double>")
    return rows.groupBy(*keys).agg(ends(F.min).alias("lo"), ends(F.max).alias("hi"))


def _blocks(placed: DataFrame, group: list[str], block_rows: int, edges: Column, buckets: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Candidates with their block, its number of parts, their shelf, its number of parts and their part of it; and where units stand."""
    # Written once: read by the uses below, and the bucket is a stored column before it is a join key.
    marked = written(with_bucket(placed, "_r", edges, buckets), "analog-buckets")
    shelf_rows = min(SHELF_ROWS, max(LEAST_ROWS, -(-rows // SHELVES)))
    sizes = marked.groupBy(*group, "_cell", BUCKET).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*group).orderBy("_cell", BUCKET)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = sizes.withColumn("_before", before).withColumn("block", F.floor(F.col("_before") / block_rows).cast("int"))
    of = lambda *keys: W.partitionBy(*group, *keys)
    cut = cut.withColumns(
        {
            "parts": F.ceil(F.sum("n").over(of("block")) / (2.0 * block_rows)).cast("int"),
            "shelf": F.floor(F.min("_before").over(of("block")) / shelf_rows).cast("int"),
        }
    )
    cut = cut.withColumn("shelf_parts", F.ceil(F.sum("n").over(of("shelf")) / (2.0 * shelf_rows)).cast("int"))
    where = written(cut.drop("n", "_before"), "analog-where")
    located = marked.join(where, [*group, "_cell", BUCKET]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("shelf_parts")).cast("int"))
    return located, where


def _with_home(queries: DataFrame, where: DataFrame, shelves: DataFrame, group: list[str]) -> DataFrame:
    """Queries with their home (shelf, part) and the chunk of it: the shelf where they would stand, else one of least bound."""
    unit = [*group, "_cell", BUCKET]
    stand = queries.join(where.select(*unit, "shelf", "shelf_parts"), unit, "left").drop("_cell", BUCKET)
    astray = stand.filter(F.col("shelf").isNull()).drop("shelf", "shelf_parts")
    if not astray.isEmpty():
        # The middle nearest to the query decides between equal bounds.
        middles = F.zip_with("lo", "hi", lambda low, high: (low + high) / 2)
        aside = F.coalesce(F.array_max(F.zip_with("_d", middles, lambda d, m: F.abs(d - m))), F.lit(0.0))
        least = F.min(F.struct(_gap().alias("gap"), aside.alias("aside"), "shelf", "shelf_parts")).alias("_h")
        nearby = astray.join(shelves, group).groupBy("qid").agg(least).select("qid", "_h.shelf", "_h.shelf_parts")
        stand = stand.filter(F.col("shelf").isNotNull()).unionByName(astray.join(nearby, "qid", "left"))
    number = F.pmod(F.xxhash64("qid"), F.col("shelf_parts")).cast("int")
    home = stand.select("*", F.coalesce("shelf", F.lit(-1)).alias("home"), F.coalesce(number, F.lit(0)).alias("home_part")).drop("shelf", "shelf_parts")
    place = [*group, "home", "home_part"]
    load = home.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / float(QUERY_ROWS)).cast("int").alias("_chunks"))
    # Another hash than that of the part, which all queries of a part share.
    chunk = F.pmod(F.xxhash64("qid", F.lit(1)), F.col("_chunks")).cast("int").alias("chunk")
    return home.join(written(load, "analog-load"), place).select("*", chunk).drop("_chunks")


def _squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all rows, summed dimension by dimension."""
    total = np.zeros((len(left), len(right)))
    for j in range(left.shape[1]):
        total += (left[:, j, None] - right[None, :, j]) ** 2
    return total


def _best_of_shelf(k: int, other_lead: bool, pivots: np.ndarray):
    """Task function: the k best candidates of one shelf for each query, ties by (init, lead)."""

    def best(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        names = ["qid", "cid", "distance", "c_init", "c_lead"]
        if queries.empty or candidates.empty:
            return pd.DataFrame({n: [] for n in names})
        # In the order of ties, and blocks as runs.
        candidates = candidates.sort_values(["c_init", "c_lead", "cid"], kind="stable").reset_index(drop=True)
        c = np.stack(candidates["x"].to_numpy()).astype(float)
        q = np.stack(queries["x"].to_numpy()).astype(float)
        c_init, c_lead = candidates["c_init"].to_numpy(), candidates["c_lead"].to_numpy()
        q_init, q_lead = queries["q_init"].to_numpy(), queries["q_lead"].to_numpy()
        reach = queries["_limit"].to_numpy(float).copy()
        qq, cc = (q * q).sum(axis=1), (c * c).sum(axis=1)
        # What the product of matrices may be wrong by, and the rounding of distances.
        margin = 1e-11 * (1 + qq + cc.max())
        block = candidates["block"].to_numpy()
        members = np.split(np.argsort(block, kind="stable"), np.flatnonzero(np.diff(np.sort(block))) + 1)
        to_pivot = lambda x: [np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots]
        ranges = [(np.array([d[m].min() for m in members]), np.array([d[m].max() for m in members])) for d in to_pivot(c)]
        sizes = np.array([len(m) for m in members])

        def barred(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
            same = q_init[rows] == c_init[columns]
            return same | (q_lead[rows] == c_lead[columns]) if other_lead else same

        def measured(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Pairs that may be among the k best: every pair within reach, or for many of them the k best."""
            with np.errstate(all="ignore"):
                near = qq[rows, None] + cc[None, columns] - 2 * (q[rows] @ c[columns].T)
            near[np.isnan(near)] = 0
            near[barred(rows[:, None], columns[None, :])] = np.inf
            bound = reach[rows] ** 2 + margin[rows]
            keep = (near <= bound[:, None]) & (near < np.inf)
            many = np.flatnonzero(keep.sum(axis=1) > PAIRS)
            if len(many) and len(columns) > k:
                bound = np.partition(near[many], k - 1, axis=1)[:, k - 1] + 2 * margin[rows[many]]
                keep[many] &= near[many] <= bound[:, None]
                many = many[keep[many].sum(axis=1) > PAIRS]
            parts = []
            if len(many):
                # Many ties: equal vectors are measured once.
                keep[many] = False
                found, which = np.unique(c[columns], axis=0, return_inverse=True)
                distance = np.round(np.sqrt(_squares(q[rows[many]], found)), DISTANCE_DECIMALS)[:, which.ravel()]
                distance[near[many] == np.inf] = np.inf
                every = np.arange(len(many))
                for _ in range(min(k, len(columns))):
                    # The first minimum wins, and columns are in tie order.
                    at = distance.argmin(axis=1)
                    parts.append((rows[many], columns[at], distance[every, at]))
                    distance[every, at] = np.inf
            i, j = np.nonzero(keep)
            i, j = rows[i], columns[j]
            total = np.zeros(len(i))
            for dimension in range(q.shape[1]):
                total += (q[i, dimension] - c[j, dimension]) ** 2
            parts.append((i, j, np.round(np.sqrt(total), DISTANCE_DECIMALS)))
            return tuple(np.concatenate(column) for column in zip(*parts))

        results = []
        for first in range(0, len(q), TILE):
            rows = np.arange(first, min(first + TILE, len(q)))
            gap = np.zeros((len(rows), len(members)))
            for d, (low, high) in zip(to_pivot(q[rows]), ranges):
                np.maximum(gap, d[:, None] - high, out=gap)
                np.maximum(gap, low - d[:, None], out=gap)
            best_of = tuple(np.zeros(0, dtype=kind) for kind in (np.int64, np.int64, float))
            order = np.argsort(gap.mean(axis=0), kind="stable")
            # Blocks from near to far, small ones together.
            for some in np.split(order, np.flatnonzero(np.diff((np.cumsum(sizes[order]) - 1) // TILE)) + 1):
                open_rows = rows[(gap[:, some] <= reach[rows, None]).any(axis=1)]
                columns = np.sort(np.concatenate([members[b] for b in some]))
                for at in range(0, len(columns) if len(open_rows) else 0, 4 * TILE):
                    i, j, distance = (np.concatenate(pair) for pair in zip(best_of, measured(open_rows, columns[at : at + 4 * TILE])))
                    fine = np.isfinite(distance)
                    i, j, distance = i[fine], j[fine], distance[fine]
                    ranked = np.lexsort((j, distance, i))
                    i, j, distance = i[ranked], j[ranked], distance[ranked]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    best_of = tuple(column[rank < k] for column in (i, j, distance))
                    last = rank == k - 1
                    reach[i[last]] = np.minimum(reach[i[last]], distance[last] * (1 + _SLACK) + _SLACK)
            results.append(best_of)
        i, j, distance = (np.concatenate(column) for column in zip(*results))
        return pd.DataFrame(
            {"qid": queries["qid"].to_numpy()[i], "cid": candidates["cid"].to_numpy()[j], "distance": distance, "c_init": c_init[j], "c_lead": c_lead[j]}
        )

    return best


def _visit(visits: DataFrame, located: DataFrame, group: list[str], k: int, other_lead: bool, pivots: np.ndarray) -> DataFrame:
    """Evaluate chunks of queries against the shelves assigned to them."""
    place = [*group, "shelf", "part"]
    keys = [*place, "home", "home_part", "chunk"]
    left = visits.select("qid", "x", "q_init", "q_lead", "_limit", *keys)
    met = written(visits.select(*keys).distinct(), "analog-met")
    right = located.select("cid", "x", "c_init", "c_lead", "block", *place).join(met, place)
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]} | {"distance": "double"}
    schema = ", ".join(f"{name} {kinds[name]}" for name in ["qid", "cid", "distance", "c_init", "c_lead"])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_best_of_shelf(k, other_lead, pivots), schema)


def _keep_best(found: DataFrame, k: int, order: list[str]) -> DataFrame:
    # At most k rows per visited shelf and query.
    rank = F.row_number().over(W.partitionBy("qid").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    group: list[str],
    k: int = C.ANALOG_COUNT,
    other_lead: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """k nearest candidates of the same group: columns qid, cid, distance, c_init, c_lead.

    Queries bring (qid, q_init, q_lead, x, group), candidates (cid, c_init, c_lead, x, group); a
    candidate of the query's own run never counts, with ``other_lead`` neither does one of its lead.
    """
    search = _search(queries, candidates, group, k, other_lead, block_rows)
    both = search.seen.unionByName(_visit(search.rest, search.located, group, k, other_lead, search.pivots))
    return _keep_best(both, k, ["distance", "c_init", "c_lead", "cid"]).drop("rank")


def visited_share(queries: DataFrame, candidates: DataFrame, group: list[str], k: int = C.ANALOG_COUNT, block_rows: int | None = None) -> DataFrame:
    """One row: blocks the queries visited, blocks there were for them, and the share."""
    search = _search(queries, candidates, group, k, False, block_rows)
    directory = written(_ranges(search.located, [*group, "block", "parts"], search.pivots), "analog-directory")
    pairs = search.limited.select("_d", "_limit", *group).join(directory, group)
    both = pairs.agg(F.sum(F.when(_gap() <= F.col("_limit"), F.col("parts"))).alias("visited"), F.sum("parts").alias("blocks"))
    return both.withColumn("share", F.col("visited") / F.col("blocks"))


class _Search(NamedTuple):
    """Finds of the first visits, the further visits, queries with their limit, candidates with their place, pivots."""

    seen: DataFrame
    rest: DataFrame
    limited: DataFrame
    located: DataFrame
    pivots: np.ndarray


def _search(queries: DataFrame, candidates: DataFrame, group: list[str], k: int, other_lead: bool, block_rows: int | None) -> _Search:
    finite = F.forall("x", is_finite)
    candidates = written(candidates.filter(finite), "analog-candidates")
    pivots = pivots_of(candidates)
    placed = written(_placed(_with_pivots(candidates, pivots)), "analog-pivots")
    rows = candidates.count()
    buckets = bucket_count(rows)
    edges = edges_of(placed, "_r", buckets)
    located, where = _blocks(placed, group, block_rows or BLOCK_ROWS, edges, buckets, rows)
    shelves = written(_ranges(located, [*group, "shelf", "shelf_parts"], pivots), "analog-shelves")
    standing = with_bucket(_placed(_with_pivots(queries.filter(finite), pivots)), "_r", edges, buckets).drop("_r")
    queries = written(_with_home(written(standing, "analog-queries"), where, shelves, group), "analog-homes")
    far = F.lit(float("inf"))
    first = queries.filter(F.col("home") >= 0).withColumns({"shelf": F.col("home"), "part": F.col("home_part"), "_limit": far})
    seen = written(_visit(first, located, group, k, other_lead, pivots), "analog-seen")
    reach = seen.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(far).alias("_reach"))
    limited = queries.join(reach, "qid", "left").withColumn("_limit", F.coalesce("_reach", far) * (1 + _SLACK) + _SLACK)
    rest = (
        limited.join(shelves, group)
        .filter(_gap() <= F.col("_limit"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shelf_parts") - 1)))
        .filter((F.col("shelf") != F.col("home")) | (F.col("part") != F.col("home_part")))
    )
    return _Search(seen, rest, limited, located, pivots)


def analogs(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = C.ANALOG_COUNT,
    region: str = "region_id",
    lead: str = "lead_day",
    block_rows: int | None = None,
) -> DataFrame:
    """k analogs per query: same region and lead by (distance, init, lead), then other leads of the region.

    Other leads are searched only for queries with too few candidates of their own lead.
    """
    same = written(nearest(queries, candidates, [region, lead], k, False, block_rows), "analog-same")
    counts = same.groupBy("qid").agg(F.count(F.lit(1)).alias("_hits"))
    short = queries.join(counts, "qid", "left").filter(F.coalesce("_hits", F.lit(0)) < k).drop("_hits")
    found = same.withColumn("other_lead", F.lit(0))
    short = written(short, "analog-short")
    if not short.isEmpty():
        pool = candidates.join(short.select(region).distinct(), region, "left_semi")
        fallback = nearest(short, pool, [region], k, True, block_rows)
        found = found.unionByName(fallback.withColumn("other_lead", F.lit(1)))
    return _keep_best(found, k, ["other_lead", "distance", "c_init", "c_lead", "cid"])

