"""Analogs against brute force, with ties, fallback and hot groups."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from plumbline.operators import neighbours


def brute_force(queries, candidates, k=3):
    for q in queries.itertuples():
        pool = candidates[(candidates.region_id == q.region_id) & (candidates.c_init != q.q_init)].copy()
        pool["distance"] = [round(float(np.sqrt(((np.array(x) - np.array(q.x)) ** 2).sum())), 12) for x in pool.x]
        pool["other_lead"] = (pool.lead_day != q.lead_day).astype(int)
        best = pool.sort_values(["other_lead", "distance", "c_init", "c_lead", "cid"]).head(k)
        for rank, row in enumerate(best.itertuples(), start=1):
            yield q.qid, rank, row.cid, row.distance


def _tables(spark, queries, candidates):
    left = spark.createDataFrame(queries, "qid long, region_id string, lead_day int, q_init long, q_lead int, x array<double>")
    right = spark.createDataFrame(candidates, "cid long, region_id string, lead_day int, c_init long, c_lead int, x array<double>")
    return left, right


def _query(i, region, lead, init, *x):
    return {"qid": i, "region_id": region, "lead_day": lead, "q_init": init, "q_lead": lead, "x": list(x)}


def _candidate(i, region, lead, init, *x):
    return {"cid": i, "region_id": region, "lead_day": lead, "c_init": init, "c_lead": lead, "x": list(x)}


def _found(found):
    return sorted((r.qid, r["rank"], r.cid, round(r.distance, 9)) for r in found.collect())


@pytest.mark.parametrize("block_rows", [1, 100])
def test_same_lead_first_then_earlier_start_on_ties(spark, block_rows):
    queries = pd.DataFrame([_query(1, "a", 5, 30, 0.0)])
    candidates = pd.DataFrame(
        [
            _candidate(1, "a", 5, 20, 1.0),
            _candidate(2, "a", 5, 10, -1.0),
            _candidate(3, "a", 5, 30, 0.0),
            _candidate(4, "a", 4, 5, 0.01),
            _candidate(5, "b", 5, 6, 0.0),
        ]
    )
    found = neighbours.analogs(*_tables(spark, queries, candidates), block_rows=block_rows)
    assert _found(found) == [(1, 1, 2, 1.0), (1, 2, 1, 1.0), (1, 3, 4, 0.01)]


@pytest.mark.parametrize("block_rows", [7, 5000])
def test_equals_brute_force_with_a_hot_group_and_copies(spark, block_rows, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 40)
    generator = np.random.default_rng(11)
    n = 300
    region = np.where(generator.random(n) < 0.6, "hot", generator.choice(["b", "c", "d"], n))
    lead = np.where(generator.random(n) < 0.7, 1, generator.integers(1, 6, n))
    x = np.round(generator.normal(size=(n, 4)), 1)
    # A third of all candidates are copies of one vector.
    x[::3] = [0.5, -0.5, 0.5, -0.5]
    candidates = pd.DataFrame([_candidate(i, region[i], int(lead[i]), int(i // 2), *x[i]) for i in range(n)])
    queries = pd.DataFrame([_query(i, region[-i - 1], int(lead[-i - 1]), int(i), *np.round(generator.normal(size=4), 1)) for i in range(120)])
    found = neighbours.analogs(*_tables(spark, queries, candidates), block_rows=block_rows)
    expected = sorted((q, r, c, round(d, 9)) for q, r, c, d in brute_force(queries, candidates))
    assert _found(found) == expected


def test_scaler_uses_population_statistics(spark):
    table = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    stats = {r.feature: r for r in neighbours.scaler_stats(table, ["a", "b"]).collect()}
    assert stats["a"].mean == 3.0 and stats["a"].scale == pytest.approx(np.std([1, 2, 6]))
    assert stats["b"].scale == 1.0


def _vectors(spark, rows):
    return spark.createDataFrame([(i, 0, i, 0, [float(v) for v in x]) for i, x in enumerate(rows)], "cid long, all int, c_init long, c_lead int, x array<double>")


def test_pivots_prune_clusters_in_64_dimensions(spark):
    """Clusters in 64 dimensions have like norms; the pivots tell them apart, and the result is that of all pairs."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 64)) * 3
    rows = np.concatenate([c + rng.normal(size=(60, 64)) * 0.3 for c in centres])
    pool = _vectors(spark, rows)
    queries = pool.select("all", F.col("cid").alias("qid"), F.col("c_init").alias("q_init"), F.col("c_lead").alias("q_lead"), "x")
    share = neighbours.visited_share(queries, pool, ["all"], 3, block_rows=30).first()
    assert share.blocks >= 20 * len(rows) and 0 < share.share < 0.3
    found = neighbours.nearest(queries, pool, ["all"], 3, block_rows=30).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.distance, r.cid)):
        got.setdefault(r.qid, []).append(r.cid)
    for i in range(0, len(rows), 7):
        distance = np.round(np.sqrt(((rows - rows[i]) ** 2).sum(axis=1)), 12)
        order = [j for j in np.lexsort((np.arange(len(rows)), distance)) if j != i][:3]
        assert got[i] == order


def test_equal_vectors_and_few_rows(spark):
    pool = _vectors(spark, [[1.0, 2.0]] * 5)
    queries = pool.select("all", F.col("cid").alias("qid"), F.col("c_init").alias("q_init"), F.col("c_lead").alias("q_lead"), "x")
    assert neighbours.nearest(queries, pool, ["all"], 2, block_rows=2).count() == 10
    assert neighbours.nearest(queries, pool.limit(0), ["all"], 2).count() == 0
    assert neighbours.nearest(queries.limit(0), pool, ["all"], 2).count() == 0


def test_vectors_are_not_stored_once_per_block(spark):
    """Vectors that no pivot tells apart visit every block; what is written still grows with the vectors alone."""
    rows = np.random.default_rng(8).normal(size=(600, 64))
    pool = _vectors(spark, [*rows, [float("nan")] * 64])
    queries = pool.select("all", F.col("cid").alias("qid"), F.col("c_init").alias("q_init"), F.col("c_lead").alias("q_lead"), "x")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    found = {(r.qid, r.cid) for r in neighbours.nearest(queries, pool, ["all"], 1, block_rows=4).collect()}
    after = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    distance = ((rows[:, None] - rows[None]) ** 2).sum(axis=2)
    np.fill_diagonal(distance, np.inf)
    assert found == set(enumerate(distance.argmin(axis=1).tolist()))
    assert after - before < 8 * rows.nbytes
