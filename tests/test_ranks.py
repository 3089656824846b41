"""Exact quantiles and running totals over few and many value buckets."""

import numpy as np
import pandas as pd
import pytest

from plumbline.functions import ranks


@pytest.fixture(params=[1 << 16, 50], ids=["few", "many"])
def size_limit(request, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", request.param)


@pytest.fixture(scope="module")
def skewed():
    """One key holds most rows; values repeat, one value holds a third of all rows."""
    generator = np.random.default_rng(7)
    value = np.concatenate([np.full(2000, 0.5), generator.normal(size=3000), generator.integers(0, 5, 1000).astype(float)])
    key = np.where(generator.random(6000) < 0.8, "hot", generator.choice(["a", "b", "c"], 6000))
    return pd.DataFrame({"key": key, "value": value})


@pytest.mark.parametrize("share", [0.0, 0.5, 0.85, 1.0])
def test_quantile_equals_numpy(spark, skewed, size_limit, share):
    counts = ranks.count_table(spark.createDataFrame(skewed), ["key"], "value")
    found = {r.key: r for r in ranks.grouped_quantile(counts, ["key"], "value", share, "q").collect()}
    assert set(found) == set(skewed.key)
    for key, group in skewed.groupby("key"):
        assert found[key].q == pytest.approx(np.quantile(group.value, share), rel=1e-12)
        assert found[key].sample_count == len(group)


def test_quantile_without_keys(spark, skewed, size_limit):
    counts = ranks.count_table(spark.createDataFrame(skewed), [], "value")
    row = ranks.grouped_quantile(counts, [], "value", 0.8, "q").first()
    assert row.q == pytest.approx(np.quantile(skewed.value, 0.8), rel=1e-12)


def test_missing_values_come_first_and_nan_last(spark, size_limit):
    rows = [("a", None, 2), ("a", 1.0, 3), ("a", float("nan"), 1), ("b", None, 1), (None, 4.0, 1), (None, 8.0, 1)]
    counts = spark.createDataFrame(rows, "key string, value double, n long")
    found = {r.key: (r.q, r.sample_count) for share in [0.5] for r in ranks.grouped_quantile(counts, ["key"], "value", share, "q").collect()}
    assert found == {"a": (1.0, 6), "b": (None, 1), None: (6.0, 2)}
    ends = {share: {r.key: r.q for r in ranks.grouped_quantile(counts, ["key"], "value", share, "q").collect()} for share in (0.0, 1.0)}
    assert ends[0.0] == {"a": None, "b": None, None: 4.0} and np.isnan(ends[1.0]["a"]) and ends[1.0][None] == 8.0


def test_rows_are_left_out_before_they_are_dealt(spark, skewed, monkeypatch):
    """Where values are bounded by tables that Spark knows to be small, no row is dealt or sorted before it is known to count."""
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 50)
    counts = ranks.count_table(spark.createDataFrame(skewed), ["key"], "value")
    small = {"spark.sql.autoBroadcastJoinThreshold": "12k", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in small}
    for name, setting in small.items():
        spark.conf.set(name, setting)
    plan = ranks.grouped_quantile(counts, ["key"], "value", 0.5, "q")._jdf.queryExecution().executedPlan().toString()
    for name, setting in before.items():
        spark.conf.set(name, setting)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_pandas(spark, skewed, size_limit, descending):
    counts = ranks.count_table(spark.createDataFrame(skewed), ["key"], "value")
    found = ranks.running_totals(counts, ["key"], "value", ["n"], descending).toPandas()
    for key, group in found.groupby("key"):
        ordered = group.sort_values("value", ascending=not descending)
        assert (ordered.n_before.to_numpy() == ordered.n.cumsum().shift(fill_value=0).to_numpy()).all()
        assert ordered.n.sum() == (skewed.key == key).sum()


def test_results_do_not_depend_on_partitioning(spark, skewed, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 50)
    answers = []
    for parts in (1, 7):
        rows = spark.createDataFrame(skewed).repartition(parts)
        q = ranks.grouped_quantile(ranks.count_table(rows, ["key"], "value"), ["key"], "value", 0.85, "q")
        answers.append(sorted((r.key, r.q) for r in q.collect()))
    assert answers[0] == answers[1]


def test_two_levels_of_edges_give_the_same_quantiles(spark, skewed, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 20)
    rows = spark.createDataFrame(skewed)
    one = ranks.grouped_quantile(ranks.count_table(rows, ["key"], "value"), ["key"], "value", 0.85, "q").collect()
    monkeypatch.setattr(ranks, "MOST_EDGES", 8)
    two = ranks.grouped_quantile(ranks.count_table(rows, ["key"], "value"), ["key"], "value", 0.85, "q").collect()
    assert sorted(one) == sorted(two)


def test_positions_and_neighbours_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    values = np.random.default_rng(1).permutation(5000).astype(float)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    placed = {r.v: r.at for r in ranks.positions(rows, ["v"], "at").collect()}
    assert placed == {float(i): i for i in range(5000)}
    near = {r.v: (r.p, r.q) for r in ranks.with_neighbours(rows, "v", "v", "p", "q").collect()}
    assert near == {float(i): (i - 1.0 if i else None, i + 1.0 if i < 4999 else None) for i in range(5000)}
    parts = ranks.in_ranges(rows, ["v"]).groupBy(ranks.PART).count()
    assert parts.count() > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ranks.positions(rows.limit(0), ["v"], "at").isEmpty() and ranks.with_neighbours(rows.limit(0), "v", "v", "p", "q").isEmpty()
