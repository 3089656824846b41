"""Near-duplicate vectors by product quantisation: coarse inverted lists, residual codes, exact rerank.

Equal vectors become one class with a number of copies before anything is compared. A bounded sample fits coarse
centroids and, per subspace, a codebook of the residuals. Every class is put into the list of its nearest centroid
with its residual code, and probes the lists of its nearest centroids; a pair is found if either vector probes the other's
list. The number of probes is the smallest with which at least ``RECALL`` of sample vectors and random neighbours at
exactly the wanted cosine would meet, as measured when the index is fitted.

Inside a probed list, asymmetric table-lookup distances bound the true distance from below (the code's own error is
known per vector), so dropping by them loses nothing; what is left is compared by exact cosine in double precision.
Lists and their queries are cut into chunks, and each pair of chunks is a unit of work, so a hot list is spread
over many tasks. A unit returns one row per vector: how many copies it links, and the smallest member it is joined with.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; neither do vectors of
different lengths. Repeated rows are vectors of their own. Null ids take part and are ignored as component ids.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.components import connected
from plumbline.llm.linking import union, units
from plumbline.session import written

#: Vectors per list on average, most lists, sample vectors per list that the fit may use.
LIST_ROWS, MOST_LISTS, SAMPLE_PER_LIST = 256, 4096, 48
SUBSPACES, CODES = 8, 256
RECALL = 0.995
#: Rows of a list chunk and of a query chunk; queries compared at once.
LIST_CHUNK, QUERY_CHUNK, AT_ONCE = 2048, 8192, 512
#: Numbers in a table of distances, and pairs compared exactly, at once: what bounds the memory of the fit and of a task.
CELLS, PAIRS = 1 << 21, 1 << 17


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe for very large and very small components."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def row_blocks(rows: int, width: int) -> Iterator[slice]:
    """Slices of the rows whose tables of ``width`` columns stay small."""
    step = max(1, CELLS // max(1, width))
    for at in range(0, rows, step):
        yield slice(at, at + step)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row and its squared distance."""
    home, least = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for block in row_blocks(len(x), len(centres)):
        distance = squared(x[block], centres)
        home[block] = distance.argmin(axis=1)
        least[block] = distance[np.arange(len(distance)), home[block]]
    return home, least


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from distinct rows; empty clusters take the rows that are worst served."""
    random = np.random.default_rng(seed)
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home, least = nearest(x, centres)
        counts = np.bincount(home, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            worst = np.argsort(-least, kind="stable")[: (~full).sum()]
            centres[~full] = x[worst]
    return centres


@dataclass
class Index:
    """Coarse centroids, codebooks (subspace, code, component), component ranges of the subspaces, probes."""

    coarse: np.ndarray
    books: list[np.ndarray]
    parts: list[slice]
    probes: int = 1
    recall: float = 1.0

    @staticmethod
    def fit(sample: np.ndarray, lists: int, cosine: float) -> Index:
        dim = sample.shape[1]
        coarse = k_means(sample, lists, 11)
        residual = sample - coarse[nearest(sample, coarse)[0]]
        edges = np.linspace(0, dim, min(SUBSPACES, dim) + 1).round().astype(int)
        parts = [slice(a, b) for a, b in zip(edges, edges[1:])]
        index = Index(coarse, [k_means(residual[:, p], CODES, 12) for p in parts], parts)
        index.set_probes(sample, cosine)
        return index

    def set_probes(self, sample: np.ndarray, cosine: float) -> None:
        """Fewest probes with which random neighbours at the least linked cosine meet often enough."""
        random = np.random.default_rng(13)
        x = sample[random.permutation(len(sample))[:4000]]
        side = random.normal(size=x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        y = cosine * x + np.sqrt(1 - cosine**2) * side
        met = np.zeros(len(x), dtype=np.int64)
        for block in row_blocks(len(x), len(self.coarse)):
            from_x, from_y = squared(x[block], self.coarse), squared(y[block], self.coarse)
            rows = np.arange(len(from_x))
            rank_y = (from_x < from_x[rows, from_y.argmin(axis=1)][:, None]).sum(axis=1)
            rank_x = (from_y < from_y[rows, from_x.argmin(axis=1)][:, None]).sum(axis=1)
            met[block] = np.minimum(rank_x, rank_y)
        met.sort()
        self.probes = min(len(self.coarse), int(met[int(np.ceil(RECALL * len(met))) - 1]) + 1)
        self.recall = float((met < self.probes).mean())

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probed lists (nearest first), residual codes, and distance of each vector from its decoded code."""
        near = np.zeros((len(x), self.probes), dtype=np.int64)
        for block in row_blocks(len(x), len(self.coarse)):
            distance = squared(x[block], self.coarse)
            some = np.argpartition(distance, self.probes - 1, axis=1)[:, : self.probes]
            near[block] = np.take_along_axis(some, np.take_along_axis(distance, some, 1).argsort(axis=1, kind="stable"), 1)
        residual = x - self.coarse[near[:, 0]]
        codes = np.stack([nearest(residual[:, p], b)[0] for p, b in zip(self.parts, self.books)], axis=1)
        decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return near, codes.astype(np.uint8), np.linalg.norm(residual - decoded, axis=1)

    def bounds(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of the queries from the decoded members of a list, summed from one table per subspace."""
        residual = queries - self.coarse[cell]
        total = np.zeros((len(queries), len(codes)), dtype=np.float32)
        for i, (part, book) in enumerate(zip(self.parts, self.books)):
            total += squared(residual[:, part], book).astype(np.float32)[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def link_unit(index: Index, cell: int, lists: pd.DataFrame, queries: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links between the members of a list chunk and a chunk of queries, each pair in one unit of all only."""

    def stacked(rows: pd.DataFrame) -> np.ndarray:
        return unit_rows(np.stack([np.frombuffer(v) for v in rows["vector"]]))

    x, y = stacked(queries), stacked(lists)
    codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in lists["codes"]])
    member_probes = np.stack([np.frombuffer(p, dtype="<i4") for p in lists["probes"]])
    slack = np.sqrt(2 - 2 * cosine) + lists["error"].to_numpy() + 1e-4
    ids, query_ids, homes = lists["class"].to_numpy(), queries["class"].to_numpy(), queries["home"].to_numpy()
    everyone, place = np.unique(np.concatenate([ids, query_ids]), return_inverse=True)
    at_list, at_query = place[: len(ids)], place[len(ids) :]
    labels = np.arange(len(everyone))
    linked = np.zeros(len(everyone), dtype=np.int64)
    copies, query_copies = lists["copies"].to_numpy(), queries["copies"].to_numpy()
    for at in range(0, len(x), AT_ONCE):
        block = slice(at, at + AT_ONCE)
        row, col = np.nonzero(index.bounds(x[block], cell, codes) <= slack)
        if not len(row):
            continue
        # One way to sum, so that a pair at the very limit does not depend on its block.
        here = x[block]
        cuts = range(0, len(row), PAIRS)
        near = np.concatenate([np.einsum("ij,ij->i", here[row[a : a + PAIRS]], y[col[a : a + PAIRS]]) for a in cuts]) >= cosine
        row, col = row[near] + at, col[near]
        # A pair of one list is met twice, a pair of two lists twice if either probes the other's: one of both counts.
        home = homes[row]
        mutual = (member_probes[col] == home[:, None]).any(axis=1)
        counts = np.where(home == cell, query_ids[row] < ids[col], ~mutual | (home < cell))
        row, col = row[counts], col[counts]
        labels = union(labels, at_query[row], at_list[col])
        linked += np.bincount(at_query[row], copies[col], len(everyone)).astype(np.int64)
        linked += np.bincount(at_list[col], query_copies[row], len(everyone)).astype(np.int64)
    met = np.flatnonzero(linked)
    return pd.DataFrame({"class": everyone[met], "root": everyone[labels[met]], "n": linked[met]})


def prepared(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with a stable number, usable vectors as doubles (else null) and a 128-bit hash of them; written once."""
    usable = (F.size(vector) > 0) & F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    )
    usable = usable & F.exists(vector, lambda v: v != 0)
    double = F.when(usable, F.transform(vector, lambda v: v.cast("double") + 0.0))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), double.alias("vector"))
    return written(rows.withColumns({"h1": F.xxhash64(F.lit(1), "vector"), "h2": F.xxhash64(F.lit(2), "vector")}), "pq-rows")


def fit(classes: DataFrame, dim: int, cosine: float) -> Index:
    """Index fitted on a bounded sample, chosen by the hash of the vectors, so that the choice repeats."""
    n = classes.count()
    lists = int(min(MOST_LISTS, max(1, 2 ** round(np.log2(max(1, n / LIST_ROWS))))))
    rows = classes.orderBy("h1", "h2").limit(SAMPLE_PER_LIST * max(lists, CODES // 16)).select("vector").toArrow().to_pandas()
    return Index.fit(unit_rows(np.stack(rows["vector"].to_numpy()).reshape(-1, dim)), lists, cosine)


def links(classes: DataFrame, cosine: float, dim: int) -> DataFrame:
    """``class``, ``root`` and ``n``: partial numbers of linked copies and links that connect all groups."""
    index = fit(classes, dim, cosine)
    sent = classes.sparkSession.sparkContext.broadcast(index)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vector"].to_numpy())
                near, codes, error = sent.value.encode(unit_rows(x))
                yield batch[["class", "copies"]].assign(
                    vector=[v.tobytes() for v in x.astype(np.float64)],
                    home=near[:, 0],
                    probed=list(near.astype(np.int32)),
                    probes=[p.tobytes() for p in near.astype("<i4")],
                    codes=[c.tobytes() for c in codes],
                    error=error,
                )

    encoded = written(
        classes.select("class", "copies", "vector").mapInPandas(
            encode,
            "class long, copies long, vector binary, home int, probed array<int>, probes binary, codes binary, error double",
        ),
        "pq-encoded",
    )
    queries = encoded.select("class", "copies", "vector", "home", F.explode("probed").alias("cell"))
    # One row per list, at most MOST_LISTS of them.
    chunks = (
        encoded.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("n_list"))
        .join(queries.groupBy("cell").agg(F.count("*").alias("n_query")), "cell")
        .select(
            "cell",
            F.ceil(F.col("n_list") / LIST_CHUNK).cast("int").alias("list_chunks"),
            F.ceil(F.col("n_query") / QUERY_CHUNK).cast("int").alias("query_chunks"),
        )
    )
    chunks = F.broadcast(written(chunks, "pq-chunks"))

    def numbered(rows: DataFrame, side: int) -> DataFrame:
        own, other = ("query", "list") if side else ("list", "query")
        spread = rows.join(chunks, "cell").withColumn(
            f"{own}_chunk", F.pmod(F.xxhash64("class"), F.col(f"{own}_chunks")).cast("int")
        )
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_chunks") - 1)).alias(f"{other}_chunk")
        return spread.select("*", every).withColumn("side", F.lit(side))

    keys = ["cell", "list_chunk", "query_chunk"]
    none = F.lit(None)
    columns = [*keys, "side", "class", "copies", "vector", "home", "probes", "codes", "error"]
    members = numbered(encoded.withColumn("cell", F.col("home")), 0).select(columns)
    askers = numbered(queries, 1).withColumns(
        {"probes": none.cast("binary"), "codes": none.cast("binary"), "error": none.cast("double")}
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in units(batches, keys):
            side = unit["side"].to_numpy()
            if side.any() and not side.all():
                yield link_unit(sent.value, int(unit["cell"].iloc[0]), unit[side == 0], unit[side == 1], cosine)

    placed = members.unionByName(askers.select(columns)).repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInPandas(run, "class long, root long, n long")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """``key``, ``n_links`` (other vectors linked directly) and ``component`` (smallest key reachable) of every row."""
    rows = prepared(vectors, key, vector)
    classes = written(
        rows.filter("vector IS NOT NULL").groupBy("h1", "h2").agg(
            F.min("row").alias("class"),
            F.count("*").alias("copies"),
            F.min("key").alias("first"),
            F.min_by("vector", "row").alias("vector"),
        ),
        "pq-classes",
    )
    found = rows.sparkSession.createDataFrame([], "class long, root long, n long")
    for (dim,) in sorted(classes.select(F.size("vector")).distinct().collect()):
        found = found.unionByName(links(classes.filter(F.size("vector") == dim), cosine, dim))
    found = written(found, "pq-links")
    roots = connected(found.select(F.col("class").alias("src"), F.col("root").alias("dst")))
    totals = found.groupBy("class").agg(F.sum("n").alias("n"))
    joined = classes.drop("vector").join(totals, "class", "left").join(
        roots.withColumnRenamed("node", "class"), "class", "left"
    )
    marked = written(joined.withColumn("root", F.coalesce("root", "class")), "pq-marked")
    smallest = marked.groupBy("root").agg(F.min("first").alias("component"))
    of_class = marked.join(smallest, "root").select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"
    )
    usable = rows.filter("vector IS NOT NULL").join(of_class, ["h1", "h2"]).select("key", "n_links", "component")
    alone = rows.filter("vector IS NULL").select(
        "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component")
    )
    return usable.unionByName(alone).withColumnRenamed("key", key)
