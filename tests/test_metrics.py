"""Probability metrics against hand-counted and direct values."""

import numpy as np
import pandas as pd
import pytest

from plumbline.functions import ranks
from plumbline.operators import metrics


def _evaluate(spark, y, p, c=None, **options):
    frame = pd.DataFrame({"bust": y, "p": p, "c": [0.5] * len(y) if c is None else c})
    return metrics.evaluate(spark.createDataFrame(frame), **options).first()


def test_perfect_ranking(spark):
    row = _evaluate(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    assert row.pr_auc == 1.0 and row.roc_auc == 1.0
    assert row.brier_score == pytest.approx(0.025) and row.brier_skill_score == pytest.approx(0.9)
    assert row.rows == 4 and row.prevalence == 0.5


@pytest.mark.parametrize("limit", [1 << 16, 3])
def test_ties_are_grouped(spark, limit, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", limit)
    row = _evaluate(spark, [1, 0, 1, 0, 1, 0, 0], [0.9, 0.8, 0.8, 0.7, 0.6, 0.3, 0.2])
    assert row.pr_auc == pytest.approx(0.755556, abs=1e-6)
    assert row.roc_auc == pytest.approx(0.791667, abs=1e-6)


def test_bins_are_left_closed_with_exact_edges(spark):
    frame = pd.DataFrame({"bust": [0] * 6, "p": [0, 0.1, 0.3, 0.6, 0.7, 1.0], "c": 0.5})
    bins = metrics.calibration_bins(metrics.score_table(spark.createDataFrame(frame), []), []).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [1, 1, 1, 0, 0, 1, 1, 0, 0, 1]
    assert bins[3].mean_probability is None and bins[9].upper == pytest.approx(1.0)


def test_one_class_and_zero_climatology_error(spark):
    row = _evaluate(spark, [0, 0], [0.2, 0.4], [0.0, 0.0])
    assert row.pr_auc is None and row.roc_auc is None and row.brier_skill_score is None
    assert row.top_20_percent_risk_recall is None


def test_probabilities_are_clipped(spark):
    row = _evaluate(spark, [0, 1], [-3.0, 7.0])
    assert row.brier_score == 0.0


@pytest.mark.parametrize("limit", [1 << 16, 3])
def test_slices_equal_direct_computation(spark, limit, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", limit)
    generator = np.random.default_rng(3)
    n = 3000
    lead = np.where(generator.random(n) < 0.7, 1, generator.integers(2, 11, n))
    p = np.round(generator.random(n), 2)
    frame = pd.DataFrame({"lead_day": lead, "p": p, "bust": (generator.random(n) < p * 0.6).astype(int), "c": 0.3})
    found = metrics.evaluate(spark.createDataFrame(frame), ["lead_day"]).collect()
    assert [str(r.lead_day) for r in found] == sorted({str(v) for v in lead})
    for row in found:
        group = frame[frame.lead_day == row.lead_day]
        y, q = group.bust.to_numpy(), group.p.to_numpy()
        assert row.roc_auc == pytest.approx(_auc(y, q))
        assert row.pr_auc == pytest.approx(_average_precision(y, q))
        cut = np.quantile(q, 0.8)
        assert row.top_20_percent_risk_threshold == pytest.approx(cut)
        assert row.brier_score == pytest.approx(((q - y) ** 2).mean())


def _auc(y, p):
    positive, negative = p[y == 1], p[y == 0]
    wins = (positive[:, None] > negative).sum() + 0.5 * (positive[:, None] == negative).sum()
    return wins / (len(positive) * len(negative))


def _average_precision(y, p):
    total, hits = 0.0, y.sum()
    for score in sorted(set(p), reverse=True):
        at = p == score
        chosen = p >= score
        total += y[at].sum() / hits * y[chosen].mean()
    return total


def test_unseen_group_gets_the_global_rate(spark):
    train = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("b", 1, 0), ("b", 1, 0)], "region_id string, lead_day int, bust int")
    target = spark.createDataFrame([("a", 1), ("c", 9)], "region_id string, lead_day int")
    rates = {r.region_id: r.climatology_probability for r in metrics.climatology(train, target).collect()}
    assert rates == {"a": 0.5, "c": 0.25}
