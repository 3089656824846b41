"""Grid derivatives, ensemble statistics, run-to-run drift and accumulation totals on long-form grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline import contract as C
from plumbline.functions.scalars import add_hours, season_angle

CELL = ["lat_i", "lon_i"]


def geopotential_height(value: Column) -> Column:
    return value / F.lit(C.GRAVITY)


def precipitation_mm(value: Column, units: Column, inherited: str | None = None) -> Column:
    """Metres to millimetres; null for units other than m or mm (see ``quality.unit_violations``)."""
    actual = F.coalesce(units, F.lit(inherited))
    return F.when(actual == "m", value * 1000.0).when(actual == "mm", value)


def _derivative(value: str, coordinate: Column, line: list[str], along: str) -> Column:
    """First derivative along sorted, possibly uneven coordinates: second order inside, one-sided at the ends."""
    order = W.partitionBy(*line).orderBy(along)
    f = F.col(value)
    before, after = F.lag(f).over(order), F.lead(f).over(order)
    down = coordinate - F.lag(coordinate).over(order)
    up = F.lead(coordinate).over(order) - coordinate
    centred = (down * down * after + (up * up - down * down) * f - up * up * before) / (down * up * (down + up))
    return F.when(down.isNull(), (after - f) / up).when(up.isNull(), (f - before) / down).otherwise(centred)


def _slopes(grid: DataFrame, keys: list[str], north: list[str], east: list[str]) -> DataFrame:
    """Add ``<field>_north`` and ``<field>_east``: derivatives per metre on the sphere."""
    lat, lon = F.radians("latitude"), F.radians("longitude")
    radius = F.lit(C.EARTH_RADIUS_M)
    northward = {f"{v}_north": _derivative(v, lat, [*keys, "longitude"], "latitude") / radius for v in north}
    eastward = {f"{v}_east": _derivative(v, lon, [*keys, "latitude"], "longitude") / (radius * F.cos(lat)) for v in east}
    return grid.withColumns(northward).withColumns(eastward)


def gradient_magnitude(grid: DataFrame, field: str, keys: list[str], out: str) -> DataFrame:
    """Horizontal gradient magnitude per kilometre."""
    sloped = _slopes(grid, keys, [field], [field])
    north, east = F.col(f"{field}_north"), F.col(f"{field}_east")
    return sloped.withColumn(out, F.sqrt(north * north + east * east) * 1000.0).drop(f"{field}_north", f"{field}_east")


def relative_vorticity(grid: DataFrame, u: str, v: str, keys: list[str], out: str) -> DataFrame:
    """dv/dx - du/dy on the sphere."""
    sloped = _slopes(grid, keys, [u], [v])
    return sloped.withColumn(out, F.col(f"{v}_east") - F.col(f"{u}_north")).drop(f"{u}_north", f"{v}_east")


def gradient_and_vorticity(grid: DataFrame, field: str, u: str, v: str, keys: list[str]) -> DataFrame:
    """Both derivatives from two shuffles: all northward windows share one, all eastward the other."""
    sloped = _slopes(grid, keys, [field, u], [field, v])
    north, east = F.col(f"{field}_north"), F.col(f"{field}_east")
    return sloped.withColumns(
        {
            "gradient": F.sqrt(north * north + east * east) * 1000.0,
            "vorticity": F.col(f"{v}_east") - F.col(f"{u}_north"),
        }
    ).drop(f"{field}_north", f"{u}_north", f"{field}_east", f"{v}_east")


def short_lines(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Violations: grid lines with a single point, where no derivative exists."""
    lines = []
    for fixed, axis in (("longitude", "latitude"), ("latitude", "longitude")):
        counted = grid.groupBy(*keys, F.col(fixed).alias("at")).agg(F.count(F.lit(1)).alias("points"))
        lines.append(counted.filter("points < 2").select(*keys, F.lit(axis).alias("axis"), "at", "points"))
    return lines[0].unionByName(lines[1])


def ensemble_statistics(members: DataFrame, keys: list[str], fields: list[str], spread: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation over members, combined map-side before the shuffle."""
    means = [F.avg(f).alias(f) for f in fields]
    spreads = [F.stddev_pop(f).alias(f"{f}_spread") for f in (fields if spread is None else spread)]
    return members.groupBy(*keys).agg(*means, *spreads)


def level_difference(levels: DataFrame, keys: list[str], value: str, upper: int, lower: int, out: str) -> DataFrame:
    """Difference of two pressure levels per cell in one aggregate (for example layer thickness)."""
    at = lambda level: F.max(F.when(F.col("level_hpa") == level, F.col(value)))
    chosen = levels.filter(F.col("level_hpa").isin(upper, lower))
    return chosen.groupBy(*keys).agg((at(upper) - at(lower)).alias(out))


def run_to_run_drift(
    runs: DataFrame, previous: DataFrame, keys: list[str], value: str, out: str, lag_hours: int = C.RUN_LAG_HOURS
) -> DataFrame:
    """|value - value of the run ``lag_hours`` earlier| at the same valid time, joined by equality.

    A run without that partner keeps a null, which ``missing_partners`` reports; no other run is taken.
    """
    shifted = previous.select(
        *keys,
        add_hours(F.col("init_time"), F.lit(lag_hours)).alias("init_time"),
        (F.col("lead_hours") - lag_hours).alias("lead_hours"),
        F.col(value).alias("_previous"),
    )
    joined = runs.join(shifted, [*keys, "init_time", "lead_hours"], "left")
    return joined.withColumn(out, F.abs(F.col(value) - F.col("_previous"))).drop("_previous")


def missing_partners(drifted: DataFrame, column: str) -> DataFrame:
    return drifted.filter(F.col(column).isNull()).select("init_time", "lead_hours").distinct()


def trailing_totals(
    steps: DataFrame, keys: list[str], value: str, out: str, offsets: list[int] | None = None
) -> DataFrame:
    """Sum of the steps ending at valid - 18, -12, -6 and 0 h, only where all of them exist.

    Each step is sent to the totals it belongs to, so the sum combines map-side and a long series is
    never ordered in one task.
    """
    offsets = offsets or C.PRECIP_STEP_OFFSETS_H
    hours = F.explode(F.array(*[F.lit(h) for h in offsets])).alias("_offset")
    sent = steps.select(*keys, "valid_time", value, hours)
    totals = sent.groupBy(*keys, add_hours(F.col("valid_time"), F.col("_offset")).alias("valid_time")).agg(
        F.sum(value).alias(out), F.count(value).alias("_steps")
    )
    return totals.filter(F.col("_steps") == len(offsets)).drop("_steps")


def season_terms(time: str) -> dict[str, Column]:
    angle = season_angle(F.col(time))
    return {"season_sin": F.sin(angle), "season_cos": F.cos(angle)}


def at_valid_time(forecast: DataFrame, analysis: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Forecast rows with the analysis of exactly their valid time and cell."""
    return forecast.join(analysis, [*(keys or CELL), "valid_time"])
