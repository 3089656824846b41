"""The derivation: pruned scans, another grid for the analysis, units, and whole 24 h totals."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline import contract as C
from plumbline.plans.derive import carried_weights, derive_rows, standard_units
from plumbline.plans.derive_queries import derived
from plumbline.sources.landing import needed_times, within, write_landing
from tests import fixtures as X

START = datetime(2020, 6, 1)
LATS, LONS = [6.0, 7.5, 9.0], [68.0, 69.5, 71.0]
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def grids(spark):
    """Runs of five months, an analysis of all their times; values rise with the day of the year."""
    inits = [datetime(2020, m, 1) + timedelta(hours=h) for m in range(5, 10) for h in (0, 12)]
    shift = lambda init, lead, member: float(init.timetuple().tm_yday + lead)
    runs = spark.createDataFrame(X.forecast_rows(inits, [24, 36], LATS, LONS, shift=shift), C.FORECAST_GRID)
    times = sorted({t + timedelta(hours=h) for t in inits for h in range(0, 37, 6)})
    truth = spark.createDataFrame(X.analysis_rows(times, LATS, LONS), C.ANALYSIS_GRID)
    return runs, truth


def tools(spark):
    return X.equal_weights(spark, [1, 2], LATS, LONS), (X.axis(spark, LATS), X.axis(spark, LONS))


def scans(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, [line for line in plan.splitlines() if "FileScan parquet" in line]


def test_all_three_scans_reach_only_the_months_and_times_needed(spark, grids, tmp_path):
    runs, truth = grids
    write_landing(runs, f"{tmp_path}/landing-runs", "init_time")
    write_landing(truth, f"{tmp_path}/landing-truth", "valid_time")
    forecast, analysis = (spark.read.parquet(f"{tmp_path}/landing-{n}") for n in ("runs", "truth"))
    weights, axes = tools(spark)
    inits = spark.createDataFrame([(datetime(2020, 7, 1, 12),)], "init_time timestamp_ntz")
    rows = derive_rows(forecast, forecast, analysis, weights, axes, "v", inits, [24])
    plan, lines = scans(rows)
    landing = [line for line in lines if "landing-" in line]
    assert len([x for x in landing if "landing-runs" in x]) >= 2 and any("landing-truth" in x for x in landing)
    for line in landing:
        time = "init_time" if "landing-runs" in line else "valid_time"
        assert "year" in line.split("PartitionFilters:")[1].split("PushedFilters:")[0]
        assert f"GreaterThanOrEqual({time}" in line and f"LessThanOrEqual({time}" in line
    assert rows.count() == 2 and rows.first().run_to_run_mslp_drift_pa == pytest.approx(12.0)


def test_registered_derivation_exchanges_the_grid_few_times(spark):
    plan, _ = scans(derived(spark, FOLDER))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    cells = [line for line in exchanges if re.search(r"lat_i|lon_i|latitude|longitude", line)]
    assert 0 < len(cells) <= 10
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_needed_times_cover_the_earlier_run_and_every_step(spark):
    inits = spark.createDataFrame([(START,), (START,)], "init_time timestamp_ntz")
    earlier, valid = needed_times(inits, [24, 48])
    assert [r[0] for r in earlier.collect()] == [START - timedelta(hours=12)]
    assert sorted(r[0] for r in valid.collect()) == [START + timedelta(hours=h) for h in (6, 12, 18, 24, 30, 36, 42, 48)]
    assert within(inits, "init_time", inits.limit(0)).isEmpty()


def moved(truth, offset):
    return truth.withColumns({"latitude": F.col("latitude") + offset, "longitude": F.col("longitude") + offset})


def test_analysis_of_another_grid_is_aligned(spark, grids):
    """Linear fields on a finer, shifted grid give the errors of the same fields on the run's own grid."""
    runs, _ = grids
    weights, axes = tools(spark)
    inits = spark.createDataFrame([(datetime(2020, 6, 1, 12),)], "init_time timestamp_ntz")
    times = X.times_every(datetime(2020, 6, 1, 12), 36, 6)
    plane = lambda lat, lon: 10 * lat + lon

    def analysis(latitudes, longitudes):
        rows = X.analysis_rows(times, latitudes, longitudes)
        rows = [(t, la, lo, v, x + plane(la, lo) if not v.startswith("total") else x) for t, la, lo, v, x in rows]
        return spark.createDataFrame(rows, C.ANALYSIS_GRID)

    finer = ([5.0 + 0.5 * i for i in range(12)], [67.0 + 0.5 * i for i in range(12)])
    own = derive_rows(runs, runs, analysis(LATS, LONS), weights, axes, "v", inits, [24]).orderBy("region_id").collect()
    lines = tuple(X.axis(spark, values) for values in finer)
    other = derive_rows(runs, runs, analysis(*finer), weights, axes, "v", inits, [24], analysis_axes=lines).orderBy("region_id").collect()
    assert len(own) == len(other) == 2
    for a, b in zip(own, other):
        for name in C.ERROR_COLUMNS:
            assert a[name] == pytest.approx(b[name], abs=1e-6)


def test_carried_weights_keep_their_sum_and_mark_uncovered_regions(spark):
    weights, axes = tools(spark)
    finer = (X.axis(spark, [5.0 + 0.5 * i for i in range(12)]), X.axis(spark, [67.0 + 0.5 * i for i in range(12)]))
    sums = {r.region_id: r.s for r in carried_weights(weights, finer, axes).groupBy("region_id").agg(F.sum("weight").alias("s")).collect()}
    assert sums == {1: pytest.approx(1.0), 2: pytest.approx(1.0)}
    part = (X.axis(spark, [6.5, 7.0, 7.5]), finer[1])
    assert carried_weights(weights, part, axes).filter("weight IS NOT NULL").isEmpty()


def test_a_missing_step_gives_a_null_error(spark, grids):
    runs, truth = grids
    weights, axes = tools(spark)
    inits = spark.createDataFrame([(datetime(2020, 6, 1, 12),)], "init_time timestamp_ntz")
    gap = F.lit(datetime(2020, 6, 2, 0)).cast("timestamp_ntz")
    holed = truth.filter((F.col("valid_time") != gap) | (F.col("variable") != "total_precipitation_6hr"))
    rows = derive_rows(runs, runs, holed, weights, axes, "v", inits, [24]).collect()
    assert len(rows) == 2 and all(r.e_precip_mm is None and r.e_wind_mps == pytest.approx(1.0) for r in rows)


def test_units_of_the_tables_are_used(spark):
    rows = [("total_precipitation_24hr", 0.01, None), ("total_precipitation_6hr", 0.01, "m"), ("total_precipitation_6hr", 7.0, "mm"),
            ("total_precipitation_24hr", 1.0, "inch"), ("geopotential", 5.0, None), ("geopotential", 5.0, "m**2 s**-2"),
            ("geopotential", 5.0, "m"), ("2m_temperature", 300.0, "K")]
    found = standard_units(spark.createDataFrame(rows, "variable string, value double, units string")).collect()
    assert [r.value for r in found] == [10.0, 10.0, 7.0, None, 5.0, 5.0, None, 300.0]
    plain = standard_units(spark.createDataFrame(rows[:1], "variable string, value double, units string").drop("units")).first()
    assert plain.value == 10.0
