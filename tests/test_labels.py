"""Robust statistics, scores and labels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.errors import ContractViolation
from plumbline.functions import ranks
from plumbline.operators import labels
from tests.fixtures import LABEL_SCHEMA, label_rows


def train():
    return F.year("forecast_initialization_time").isin(2018, 2019, 2020)



def _rows(spark, **options):
    return spark.createDataFrame(label_rows(**options), LABEL_SCHEMA)


@pytest.fixture(scope="module")
def fit(spark):
    return labels.fit_labels(_rows(spark), train())


def test_fit_equals_numpy_on_each_group(fit):
    stats = {(r.component, r.region_id, r.lead_day): r for r in fit.stats.collect()}
    assert len(stats) == 16
    frame = label_rows()
    frame = frame[frame.forecast_initialization_time.dt.year < 2021]
    for name, column in labels.C.COMPONENT_COLUMNS.items():
        for (region, lead), group in frame.groupby(["region_id", "lead_day"]):
            row, values = stats[(name, region, lead)], group[column].to_numpy()
            assert (row.sample_count, row.fallback_level) == (108, "region_lead")
            assert row.median == pytest.approx(np.median(values))
            assert row.mad == pytest.approx(np.median(np.abs(values - np.median(values))))


def test_thresholds_equal_numpy(spark, fit):
    scored = labels.standardize(_rows(spark).filter(train()), fit.stats).toPandas()
    found = {(r.region_id, r.lead_day): r.threshold for r in fit.thresholds.collect()}
    for key, group in scored.groupby(["region_id", "lead_day"]):
        assert found[key] == pytest.approx(np.quantile(group.severity, labels.C.THRESHOLD_QUANTILE))


def test_test_year_does_not_influence_the_fit(spark, fit):
    moved = labels.fit_labels(_rows(spark, shift_of_test_year=1_000_000.0), train())
    assert sorted(moved.stats.collect()) == sorted(fit.stats.collect())
    assert sorted(moved.thresholds.collect()) == sorted(fit.thresholds.collect())


def test_bucketed_fit_is_the_same(spark, fit, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 20)
    other = labels.fit_labels(_rows(spark).repartition(5), train())
    same = lambda f: sorted((r.component, r.region_id, r.lead_day, round(r.median, 9), round(r.mad, 9)) for r in f.stats.collect())
    assert same(other) == same(fit)


def test_scores_are_clipped_and_labels_strict(spark, fit):
    table = fit.apply(_rows(spark, shift_of_test_year=1_000_000.0))
    assert dict(table.dtypes)["bust"] == "tinyint"
    rows = table.toPandas()
    for name in ("precip", "mslp", "wind", "temperature"):
        assert rows[f"z_{name}"].between(-8, 8).all()
    assert (rows.bust == (rows.severity > rows.threshold)).all()
    assert rows[rows.forecast_initialization_time.dt.year == 2022].bust.all()
    expected = 0.4 * rows.z_precip + 0.2 * rows.z_mslp + 0.2 * rows.z_wind + 0.2 * rows.z_temperature
    assert np.allclose(rows.severity, expected)


def test_fallback_levels(spark):
    rows = _rows(spark)
    used = lambda n: {r.fallback_level for r in labels.fit_labels(rows, train(), min_samples=n).stats.collect()}
    assert used(108) == {"region_lead"} and used(216) == {"lead"} and used(217) == {"global"}


def test_not_finite_errors_are_left_out_and_nan_stays(spark):
    frame = label_rows()
    group = frame.index[(frame.region_id == "imd-04") & (frame.lead_day == 2)]
    frame.loc[group[0], "e_precip_mm"] = math.nan
    frame.loc[group[1], "e_precip_mm"] = math.inf
    # Pandas hands NaN over as null.
    table = spark.createDataFrame(frame, LABEL_SCHEMA).fillna(math.nan, ["e_precip_mm"])
    fit = labels.fit_labels(table, train())
    precip = fit.stats.filter("component = 'precip' AND region_id = 'imd-04' AND lead_day = 2").first()
    assert precip.sample_count == 106
    scored = labels.standardize(table, fit.stats).filter(F.isnan("e_precip_mm")).first()
    assert math.isnan(scored.z_precip) and math.isnan(scored.severity)


def test_a_group_without_training_rows_is_an_error(spark):
    frame = label_rows()
    frame.loc[frame.forecast_initialization_time.dt.year > 2020, "region_id"] = "imd-09"
    with pytest.raises(ContractViolation, match="threshold"):
        labels.fit_labels(spark.createDataFrame(frame, LABEL_SCHEMA), train())
    fit = labels.fit_labels(spark.createDataFrame(frame, LABEL_SCHEMA), train(), threshold_min_samples=30)
    assert fit.thresholds.filter("threshold IS NULL").isEmpty()


def test_no_training_rows(spark):
    with pytest.raises(ContractViolation, match="no training rows"):
        labels.fit_labels(_rows(spark), F.lit(False))


def test_prevalence(spark, fit):
    table = labels.prevalence(fit.apply(_rows(spark)), F.year("forecast_initialization_time")).collect()
    assert [r.rows for r in table] == [144, 144, 144, 72, 72]
