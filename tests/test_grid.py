"""Coordinates, derivatives, drift, accumulations and regridding."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import contract as C
from plumbline.errors import ContractViolation
from plumbline.operators import coordinates, grid, regrid
from tests.fixtures import axis

LATS, LONS = [6.0, 7.5, 9.5], [68.0, 69.5, 71.0]


def _field(spark, lats, lons, **fields):
    rows = [(1, float(a), float(o), *[float(f(a, o)) for f in fields.values()]) for a in lats for o in lons]
    return spark.createDataFrame(rows, ["run", "latitude", "longitude", *fields])


def test_longitudes_are_normalized_and_the_box_is_inclusive(spark):
    rows = [(lat, lon) for lat in (9.0, 7.5, 6.0) for lon in (-292.0, -290.5, -289.0)]
    found = coordinates.normalize_coordinates(spark.createDataFrame(rows, "lat double, lon double"))
    assert coordinates.axis_table(found, "longitude").orderBy("idx").toPandas().value.tolist() == LONS
    assert found.filter(coordinates.in_domain()).count() == 9


def test_axis_checks(spark):
    bad = spark.createDataFrame([(0, 6.0), (1, 6.0), (2, float("nan"))], "idx int, value double")
    assert coordinates.bad_axis_values(bad).count() == 2
    good, near, far = axis(spark, LATS), axis(spark, [6.0, 7.5 + 1e-7, 9.5]), axis(spark, [6.0, 7.6, 9.5])
    assert coordinates.axis_mismatches(good, near).isEmpty()
    assert coordinates.axis_mismatches(good, far).count() == 1
    assert coordinates.axis_mismatches(good, axis(spark, LATS[:2])).count() == 1
    edges = coordinates.cell_edges(good).orderBy("idx").toPandas()
    assert edges.low.tolist() == [5.25, 6.75, 8.5] and edges.high.tolist() == [6.75, 8.5, 10.5]


def test_leads_and_months(spark):
    leads = spark.createDataFrame([(h,) for h in [0, *range(24, 241, 24), 246]], "lead_hours int")
    chosen = coordinates.select_leads(leads)
    assert sorted(r.lead_hours for r in chosen.collect()) == C.LEAD_HOURS
    assert coordinates.missing_leads(leads).isEmpty()
    assert coordinates.missing_leads(leads.filter("lead_hours <> 48")).first().lead_hours == 48
    days = [datetime(2020, 5, 31), datetime(2020, 6, 1), datetime(2020, 9, 30), datetime(2020, 10, 1)]
    table = spark.createDataFrame([(d,) for d in days], "t timestamp_ntz")
    assert [r.t.month for r in table.filter(coordinates.in_months(F.col("t"))).orderBy("t").collect()] == [6, 9]
    spans = spark.createDataFrame([(timedelta(hours=36),)], "s interval day to second")
    assert spans.select(coordinates.lead_hours_from_interval(F.col("s")).alias("h")).first().h == 36


@pytest.mark.parametrize("lats", [[6.0, 7.5, 9.0], [6.0, 7.5, 9.5, 13.0]])
def test_derivatives_equal_numpy(spark, lats):
    f = lambda a, o: 100000 + 100 * o + 10 * a + 3 * a * o
    u, v = (lambda a, o: a * a + o), (lambda a, o: o * o - a)
    table = _field(spark, lats, LONS, f=f, u=u, v=v)
    found = grid.gradient_and_vorticity(table, "f", "u", "v", ["run"]).orderBy("latitude", "longitude").toPandas()
    y, x = np.radians(lats), np.radians(LONS)
    of = lambda g: np.array([[g(a, o) for o in LONS] for a in lats])
    north = lambda g: np.gradient(of(g), y, axis=0) / C.EARTH_RADIUS_M
    east = lambda g: np.gradient(of(g), x, axis=1) / (C.EARTH_RADIUS_M * np.cos(y)[:, None])
    assert np.allclose(found.gradient, (np.hypot(north(f), east(f)) * 1000).ravel(), rtol=1e-10)
    assert np.allclose(found.vorticity, (east(v) - north(u)).ravel(), rtol=1e-10)
    alone = grid.gradient_magnitude(table, "f", ["run"], "g").orderBy("latitude", "longitude").toPandas()
    assert np.allclose(alone.g, found.gradient)
    spin = grid.relative_vorticity(table, "u", "v", ["run"], "w").orderBy("latitude", "longitude").toPandas()
    assert np.allclose(spin.w, found.vorticity)


def test_single_point_lines_are_reported(spark):
    assert grid.short_lines(_field(spark, LATS, LONS, f=lambda a, o: 0), ["run"]).isEmpty()
    assert grid.short_lines(_field(spark, LATS, [68.0], f=lambda a, o: 0), ["run"]).count() == 3


def test_units(spark):
    rows = spark.createDataFrame([(0.001, "m"), (2.0, "mm"), (1.0, "K"), (0.002, None)], "v double, u string")
    found = rows.select(grid.precipitation_mm(F.col("v"), F.col("u"), "m").alias("mm")).toPandas().mm.tolist()
    assert found[:2] == [1.0, 2.0] and np.isnan(found[2]) and found[3] == 2.0
    height = spark.range(1).select(grid.geopotential_height(F.lit(100 * C.GRAVITY)).alias("h")).first().h
    assert height == pytest.approx(100.0)


def test_totals_need_all_steps(spark):
    start = datetime(2020, 6, 1, 6)
    steps = [(1, start + timedelta(hours=6 * i), 2.0) for i in range(6) if i != 4]
    table = spark.createDataFrame(steps, "cell int, valid_time timestamp_ntz, mm double")
    found = grid.trailing_totals(table, ["cell"], "mm", "total").collect()
    assert [(r.valid_time, r.total) for r in found] == [(start + timedelta(hours=18), 8.0)]


def test_drift_takes_only_the_run_twelve_hours_earlier(spark):
    at = lambda h: datetime(2020, 6, 1) + timedelta(hours=h)
    runs = spark.createDataFrame([(1, at(12), 24, 5.0), (1, at(24), 24, 9.0)], "cell int, init_time timestamp_ntz, lead_hours int, v double")
    earlier = spark.createDataFrame([(1, at(0), 36, 2.0), (1, at(6), 42, 8.0)], runs.schema)
    found = grid.run_to_run_drift(runs, earlier, ["cell"], "v", "drift").orderBy("init_time").collect()
    assert [r.drift for r in found] == [3.0, None]
    assert grid.missing_partners(grid.run_to_run_drift(runs, earlier, ["cell"], "v", "drift"), "drift").count() == 1


def test_overlapping_slices_keep_the_first(spark):
    a = spark.createDataFrame([(1, 0, "a"), (2, 0, "a")], "k int, o int, v string")
    b = spark.createDataFrame([(2, 1, "b"), (3, 1, "b")], a.schema)
    found = coordinates.merge_slices([b, a], ["k"], ["o"]).orderBy("k").collect()
    assert [(r.k, r.v) for r in found] == [(1, "a"), (2, "a"), (3, "b")]


def _indexed(spark, lats, lons, f):
    rows = [(1, i, j, float(f(a, o))) for i, a in enumerate(lats) for j, o in enumerate(lons)]
    return spark.createDataFrame(rows, "run int, lat_i int, lon_i int, f double")


def test_matching_grids_are_left_alone(spark):
    table = _indexed(spark, LATS, LONS, lambda a, o: a + o)
    axes = (axis(spark, LATS), axis(spark, LONS))
    same, how = regrid.align(table, axes, axes, ["run"], ["f"], "bilinear")
    assert how == "identity" and same is table
    with pytest.raises(ContractViolation, match="unsupported"):
        regrid.align(table, axes, (axis(spark, [6.5, 7.0]), axis(spark, LONS)), ["run"], ["f"], "nearest")


def test_bilinear_is_exact_for_planes_and_null_outside(spark):
    table = _indexed(spark, LATS, LONS, lambda a, o: 2 * a - 3 * o + 1)
    target = [6.3, 7.5, 9.4, 12.0]
    found, how = regrid.align(table, (axis(spark, LATS), axis(spark, LONS)), (axis(spark, target), axis(spark, [68.2, 70.9])), ["run"], ["f"], "bilinear")
    values = {(r.lat_i, r.lon_i): r.f for r in found.collect()}
    assert how == "bilinear" and set(values) == {(i, j) for i in range(4) for j in range(2)}
    assert {cell for cell, value in values.items() if value is None} == {(3, 0), (3, 1)}
    assert regrid.incomplete_cells(found, ["f"]).count() == 2
    for (i, j), value in values.items():
        if i < 3:
            assert value == pytest.approx(2 * target[i] - 3 * [68.2, 70.9][j] + 1)


@pytest.mark.parametrize("gap", ["null", "nan", "missing"])
def test_cells_next_to_a_gap_have_no_value(spark, gap):
    lines = [6.0, 7.5, 9.0]
    ones = _indexed(spark, lines, lines, lambda a, o: 1)
    hole = (F.col("lat_i") == 1) & (F.col("lon_i") == 1)
    if gap == "missing":
        ones = ones.filter(~hole)
    else:
        ones = ones.withColumn("f", F.when(hole, F.lit(None if gap == "null" else float("nan"))).otherwise(F.col("f")))
    axes = (axis(spark, lines), axis(spark, lines))
    found, _ = regrid.align(ones, axes, (axis(spark, [6.5, 9.0]), axis(spark, [6.0, 8.0])), ["run"], ["f"], "bilinear")
    assert {(r.lat_i, r.lon_i): r.f for r in found.collect()} == {(0, 0): 1.0, (0, 1): None, (1, 0): 1.0, (1, 1): 1.0}


def test_points_within_the_tolerance_get_their_cell(spark):
    lines = axis(spark, [6.0, 7.5, 9.0])
    points = spark.createDataFrame([(6.0 + 5e-7, 9.0), (7.5 - 5e-7, 7.5), (7.51, 6.0), (5.0, 6.0), (20.0, 6.0)], "latitude double, longitude double")
    placed = coordinates.with_cell_index(points, lines, lines)
    assert [(r.lat_i, r.lon_i) for r in placed.collect()] == [(0, 2), (1, 1), (None, 0), (None, 0), (None, 0)]
    assert coordinates.off_axis(placed).count() == 3


def test_conservative_keeps_the_integral(spark):
    fine, coarse = [0.5 + i for i in range(6)], [1.0, 3.0, 5.0]
    table = _indexed(spark, fine, fine, lambda a, o: a * o + 1)
    found, _ = regrid.align(table, (axis(spark, fine), axis(spark, fine)), (axis(spark, coarse), axis(spark, coarse)), ["run"], ["f"], "conservative")
    area = lambda c, h: np.sin(np.radians(c + h)) - np.sin(np.radians(c - h))
    before = sum((a * o + 1) * area(a, 0.5) for a in fine for o in fine)
    after = sum(r.f * area(coarse[r.lat_i], 1.0) * 2 for r in found.collect())
    assert found.count() == 9 and after == pytest.approx(before)


def test_cycles_and_requests(spark):
    times = [datetime(2020, 6, 1), datetime(2020, 6, 1, 6), datetime(2020, 10, 1), datetime(2015, 6, 1)]
    table = spark.createDataFrame([(t, 24) for t in times], "init_time timestamp_ntz, lead_hours int")
    cycles = coordinates.expected_cycles(table, [2020])
    assert cycles.count() == 2 and coordinates.bad_cycle_hours(cycles).count() == 1
    assert coordinates.bad_requests(table, [2020]).count() == 2


def test_split(spark):
    frame = pd.DataFrame({"forecast_initialization_time": pd.to_datetime([f"{y}-06-0{d}" for y in range(2018, 2023) for d in (1, 2)])})
    rows = spark.createDataFrame(frame, "forecast_initialization_time timestamp_ntz")
    split = coordinates.with_split(rows, F.year("forecast_initialization_time"), [2018, 2019, 2020], 2021, 2022)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 6, "validation": 2, "test": 2}
    assert coordinates.split_violations(split).isEmpty()
    assert coordinates.split_violations(split.filter("split <> 'test'")).first().violation == "empty split test"
