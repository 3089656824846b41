"""Selections and checks on coordinates, leads and cycles of long-form grid tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import contract as C
from plumbline.functions.ranks import positions, with_neighbours
from plumbline.functions.scalars import add_hours, close_to, is_finite


def normalize_coordinates(grid: DataFrame) -> DataFrame:
    """Rename ``lat``/``lon`` and bring longitudes into [0, 360)."""
    for short, name in (("lat", "latitude"), ("lon", "longitude")):
        if short in grid.columns and name not in grid.columns:
            grid = grid.withColumnRenamed(short, name)
    return grid.withColumn("longitude", F.pmod(F.col("longitude").cast("double"), F.lit(360.0)))


def axis_table(grid: DataFrame, column: str) -> DataFrame:
    """Sorted distinct coordinate values with a dense integer index from 0; the axis may be as long as a table."""
    values = grid.select(F.col(column).cast("double").alias("value")).distinct()
    return positions(values, ["value"], "idx").select(F.col("idx").cast("int").alias("idx"), "value")


def bad_axis_values(axis: DataFrame) -> DataFrame:
    """Violations: coordinate values that are missing, not finite or duplicated."""
    counted = axis.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(~is_finite(F.col("value")) | (F.col("n") > 1))


def cell_edges(axis: DataFrame) -> DataFrame:
    """Cell bounds of an axis: midpoints inside, mirrored at both ends; null on a one-point axis."""
    half_down, half_up = (F.col("value") - F.col("_before")) / 2, (F.col("_after") - F.col("value")) / 2
    return with_neighbours(axis, "idx", "value", "_before", "_after").select(
        "idx",
        "value",
        (F.col("value") - F.coalesce(half_down, half_up)).alias("low"),
        (F.col("value") + F.coalesce(half_up, half_down)).alias("high"),
    )


def with_nearest_line(
    grid: DataFrame, axis: DataFrame, column: str, name: str, tolerance: float = C.GRID_TOLERANCE_DEG
) -> DataFrame:
    """Add the index of the grid line within ``tolerance`` of ``column``, null where there is none.

    The axis travels as one sorted array and is searched by halving, so rows need no join on doubles.
    """
    lines, value = F.col("_lines"), F.col(column)

    def descend(at: Column, step: Column) -> Column:
        further = (at + step <= F.size(lines)) & (F.try_element_at(lines, at + step)["value"] <= value + tolerance)
        return F.when(further, at + step).otherwise(at)

    halves = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    found = F.get(lines, F.aggregate(halves, F.lit(0), descend) - 1)
    sorted_lines = axis.agg(F.array_sort(F.collect_list(F.struct("value", "idx")))).scalar()
    index = F.when(F.abs(found["value"] - value) <= tolerance, found["idx"])
    return grid.withColumn("_lines", sorted_lines).withColumn(name, index).drop("_lines")


def with_cell_index(grid: DataFrame, latitudes: DataFrame, longitudes: DataFrame) -> DataFrame:
    """Add integer cell indices, null off the axes (see ``off_axis``); later joins use them instead of doubles."""
    return with_nearest_line(with_nearest_line(grid, latitudes, "latitude", "lat_i"), longitudes, "longitude", "lon_i")


def off_axis(placed: DataFrame) -> DataFrame:
    """Violations: points that lie on no grid line within the tolerance."""
    return placed.filter(F.col("lat_i").isNull() | F.col("lon_i").isNull())


def axis_mismatches(source: DataFrame, target: DataFrame, tolerance: float = C.GRID_TOLERANCE_DEG) -> DataFrame:
    """Violations of grid equality: indices present on one side only or values further apart than allowed."""
    pairs = source.select("idx", F.col("value").alias("source_value")).join(
        target.select("idx", F.col("value").alias("target_value")), "idx", "full"
    )
    equal = close_to(F.col("source_value"), F.col("target_value"), tolerance)
    return pairs.filter(~F.coalesce(equal, F.lit(False)))


def axis_signature(axis: DataFrame) -> DataFrame:
    """SHA-256 of the sorted coordinate list, rounded to ten decimals: one row per axis name."""
    values = F.transform(F.array_sort(F.collect_list(F.round("value", 10))), lambda v: F.format_string("%.10f", v))
    return axis.groupBy("axis").agg(F.count(F.lit(1)).alias("size"), F.sha2(F.array_join(values, ","), 256).alias("sha256"))


def in_domain(latitude: tuple = C.LATITUDE_RANGE, longitude: tuple = C.LONGITUDE_RANGE) -> Column:
    """Bounding-box predicate, both ends included; plain comparisons reach the Parquet scan."""
    return F.col("latitude").between(*latitude) & F.col("longitude").between(*longitude)


def in_months(time: Column, months: list[int] | None = None) -> Column:
    return F.month(time).isin(months or C.SEASON_MONTHS)


def lead_hours(value: Column, units: Column) -> Column:
    """Lead in hours from an integer with units ``hours``; null for other units (reported as a violation)."""
    return F.when(units == "hours", value.cast("int"))


def lead_hours_from_interval(value: Column) -> Column:
    """Lead in hours from a day-time interval column."""
    return F.extract(F.lit("DAY"), value).cast("int") * 24 + F.extract(F.lit("HOUR"), value).cast("int")


def select_leads(grid: DataFrame, leads: list[int] | None = None) -> DataFrame:
    return grid.filter(F.col("lead_hours").isin(leads or C.LEAD_HOURS))


def missing_leads(grid: DataFrame, leads: list[int] | None = None) -> DataFrame:
    """Violations: required leads that no row carries."""
    wanted = grid.sparkSession.createDataFrame([(v,) for v in leads or C.LEAD_HOURS], "lead_hours int")
    return wanted.join(grid.select("lead_hours").distinct(), "lead_hours", "left_anti")


def with_valid_time(grid: DataFrame) -> DataFrame:
    return grid.withColumns(
        {
            "valid_time": add_hours(F.col("init_time"), F.col("lead_hours")),
            "lead_day": F.expr("CAST(lead_hours DIV 24 AS INT)"),
        }
    )


def expected_cycles(inits: DataFrame, years: list[int], months: list[int] | None = None) -> DataFrame:
    """Distinct initialization times of the given years and months."""
    time = F.col("init_time")
    return inits.filter(F.year(time).isin(years) & in_months(time, months)).select("init_time").distinct()


def bad_cycle_hours(cycles: DataFrame, hours: list[int] | None = None) -> DataFrame:
    """Violations: cycles not starting at one of the allowed hours."""
    return cycles.filter(~F.hour("init_time").isin(hours or C.CYCLE_HOURS))


def bad_requests(requests: DataFrame, years: list[int], months: list[int] | None = None) -> DataFrame:
    """Violations: requests with a lead outside the list or a start outside the covered years and months."""
    time = F.col("init_time")
    fine = [F.col("lead_hours").isin(C.LEAD_HOURS), F.year(time).isin(years), in_months(time, months)]
    return requests.filter(~reduce(lambda a, b: a & b, fine))


def with_split(rows: DataFrame, year: Column, train: list[int], validation: int, test: int | list[int]) -> DataFrame:
    """Add ``split`` by start year; rows of other years are dropped."""
    split = F.when(year.isin(train), "train").when(year == validation, "validation").when(year.isin(test), "test")
    return rows.withColumn("split", split).filter(F.col("split").isNotNull())


def split_violations(rows: DataFrame, cycle: str = "forecast_initialization_time") -> DataFrame:
    """Violations of an honest split: cycles in several splits, and splits without rows."""
    per_cycle = rows.groupBy(cycle, "split").count().groupBy(cycle).agg(F.count(F.lit(1)).alias("n"))
    shared = per_cycle.filter(F.col("n") > 1).select(F.concat(F.lit("shared cycle "), F.col(cycle).cast("string")).alias("violation"))
    present = rows.select("split").distinct()
    wanted = rows.sparkSession.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    empty = wanted.join(present, "split", "left_anti").select(F.concat(F.lit("empty split "), F.col("split")).alias("violation"))
    return shared.unionByName(empty)


def merge_slices(slices: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union of overlapping slices with the first row per coordinate key.

    ``order`` must make the choice unique; the minimum combines map-side, so repeated copies of one
    coordinate never meet in one task.
    """
    every = reduce(lambda a, b: a.unionByName(b), slices)
    rest = [c for c in every.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return every.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
