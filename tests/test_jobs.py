"""Derivation and corpus jobs on a small two-source grid."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline import contract as C
from plumbline.errors import ContractViolation
from plumbline.operators import quality
from plumbline.plans.derive import derive_rows
from plumbline.plans.jobs import Layout, Sources, build_corpus, check_sources
from plumbline.streaming.incremental import follow_forecasts
from tests import fixtures as X

LATS, LONS = [6.0, 7.5], [68.0, 69.5]
START = datetime(2020, 6, 1)
LEADS = list(range(24, 253, 12))
TIME = "forecast_initialization_time"


def drift(init, lead, member):
    """The run 12 h earlier is 7 Pa lower at the same valid time."""
    return 7.0 * (init - datetime(2020, 5, 1)).total_seconds() / 43200


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("landing"))
    inits = [START - timedelta(hours=12), START, START + timedelta(hours=12)]
    forecast = spark.createDataFrame(X.forecast_rows(inits, LEADS, LATS, LONS, shift=drift), C.FORECAST_GRID)
    times = X.times_every(START - timedelta(hours=12), 280, 6)
    analysis = spark.createDataFrame(X.analysis_rows(times, LATS, LONS), C.ANALYSIS_GRID)
    forecast.write.parquet(f"{folder}/forecast")
    analysis.write.parquet(f"{folder}/analysis")
    table = spark.read.schema(C.FORECAST_GRID).parquet(f"{folder}/forecast")
    weights = X.equal_weights(spark, range(1, 37), LATS, LONS)
    axes = (X.axis(spark, LATS), X.axis(spark, LONS))
    later = table.filter(F.col("init_time") >= F.lit(START).cast("timestamp_ntz"))
    made = Sources(later, table, spark.read.schema(C.ANALYSIS_GRID).parquet(f"{folder}/analysis"), weights, axes, "grid-v1")
    return made, f"{folder}/forecast"


def test_derived_rows_have_the_expected_values(spark, sources):
    made, _ = sources
    rows = derive_rows(made.forecast, made.previous, made.analysis, made.weights, made.axes, "grid-v1").cache()
    assert rows.count() == 2 * C.ROWS_PER_CYCLE
    assert set(rows.columns) == {f.name for f in C.DERIVED_ROW}
    assert quality.wrong_counts(rows, [TIME, "lead_day"], 36).isEmpty()
    row = rows.filter("region_id = 'imd-01' AND lead_day = 3").orderBy(TIME).first()
    assert row.e_precip_mm == pytest.approx(2.0)
    assert row.precip24_mean_mm == pytest.approx(10.0)
    assert row.e_wind_mps == pytest.approx(1.0)
    assert row.e_temperature_k == pytest.approx(1.0)
    assert row.e_mslp_pa == pytest.approx(100.0 + drift(START, 0, None))
    assert row.run_to_run_mslp_drift_pa == pytest.approx(7.0)
    assert row.wind10_mean_mps == pytest.approx(5.0)
    assert row.mslp_gradient_pa_per_km == pytest.approx(0.0, abs=1e-9)
    assert row.vorticity850_s1 == pytest.approx(0.0, abs=1e-15)
    assert row.thickness500_850_m == pytest.approx(0.0, abs=1e-9)
    assert row.valid_time == START + timedelta(hours=72)
    assert row.region_id_semantics == "categorical"


def test_members_give_means_and_optional_spreads(spark):
    members = X.forecast_rows([START], [24], LATS, LONS, members=range(5), shift=lambda i, lead, m: 10.0 * m)
    earlier = X.forecast_rows([START - timedelta(hours=12)], [36], LATS, LONS)
    forecast, previous = (spark.createDataFrame(r, C.FORECAST_GRID) for r in (members, earlier))
    analysis = spark.createDataFrame(X.analysis_rows(X.times_every(START, 48, 6), LATS, LONS), C.ANALYSIS_GRID)
    weights, axes = X.equal_weights(spark, [1], LATS, LONS), (X.axis(spark, LATS), X.axis(spark, LONS))
    row = derive_rows(forecast, previous, analysis, weights, axes, "v", leads=[24], spread=True).first()
    assert row.mslp_mean_pa == pytest.approx(100020.0)
    assert row.mslp_spread_pa == pytest.approx(200**0.5)
    assert row.u10_spread_mps == pytest.approx(0.0)
    assert row.temperature2m_spread_k is None
    plain = derive_rows(forecast, previous, analysis, weights, axes, "v", leads=[24])
    assert not [c for c in plain.columns if "spread" in c]


def test_corpus_is_resumable_and_repairs_invalid_cycles(spark, sources, tmp_path):
    made, _ = sources
    layout = Layout(str(tmp_path))
    first = build_corpus(spark, made, layout, [2020], max_cycles=1).first()
    assert (first.status, first.completed_count, first.missing) == ("incomplete", 1, 1)
    second = build_corpus(spark, made, layout, [2020]).first()
    assert (second.status, second.row_count, second.missing) == ("complete", 720, 0)
    stored = spark.read.parquet(layout.cycles)
    broken = stored.filter(F.col(TIME) == F.lit(START).cast("timestamp_ntz")).filter("lead_day < 10")
    broken.cache().count()
    broken.write.option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "init").mode("overwrite").parquet(layout.cycles)
    spark.catalog.refreshByPath(layout.cycles)
    repaired = build_corpus(spark, made, layout, [2020]).first()
    assert (repaired.status, repaired.row_count) == ("complete", 720)
    assert spark.read.parquet(layout.quarantine).count() == 324
    altered = spark.read.parquet(layout.cycles).filter(F.dayofmonth(TIME) == 1).withColumn("mslp_mean_pa", F.lit(1.0)).cache()
    altered.count()
    altered.write.option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "init").mode("overwrite").parquet(layout.cycles)
    spark.catalog.refreshByPath(layout.cycles)
    restored = build_corpus(spark, made, layout, [2020]).first()
    assert restored.status == "complete"
    assert spark.read.parquet(layout.cycles).filter("mslp_mean_pa = 1.0").isEmpty()


def test_corpus_needs_the_earlier_run(spark, sources, tmp_path):
    made, _ = sources
    alone = Sources(made.forecast, made.forecast, made.analysis, made.weights, made.axes, "grid-v1")
    with pytest.raises(ContractViolation, match="non-finite"):
        build_corpus(spark, alone, Layout(str(tmp_path)), [2020])
    assert spark.read.json(f"{tmp_path}/manifest").first().status == "incomplete"


def test_source_contract_report(spark, sources):
    made, _ = sources
    units = lambda c: spark.createDataFrame([(v, (u or [None])[0]) for v, u in c.items()], "variable string, units string")
    tables = {"forecast": units(C.FORECAST_UNITS).filter("variable <> 'geopotential'"), "analysis": units(C.ANALYSIS_UNITS)}
    found = {r.violation for r in check_sources(made, tables, "2020-06-01", "2020-06-30").collect()}
    assert found == {"forecast geopotential missing", "short coverage"}


def test_stream_derives_what_has_landed(spark, sources, tmp_path):
    made, landing = sources
    layout = Layout(str(tmp_path / "corpus"))
    for _ in range(2):
        query = follow_forecasts(spark, landing, made, layout, [2020], str(tmp_path / "checkpoint"))
        query.awaitTermination(240)
        assert query.exception() is None
    rows = spark.read.parquet(layout.cycles)
    assert rows.groupBy(TIME).count().filter("count = 360").count() == 2
