"""From forecast and analysis grids to regional rows: one plan for any number of cycles and leads.

All three scans reach only the times the chosen runs need. The run 12 h earlier joins its successor in the aggregate that makes
fields of variables, as one more variable, so that drift costs no join. Precipitation steps are reduced to regions first, by weights that
contain the regridding, and only then summed to 24 h: both are linear. State fields of another grid are interpolated, since
their errors are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import contract as C
from plumbline.errors import ContractViolation, raise_if_any
from plumbline.functions.scalars import add_hours, canonical_region
from plumbline.operators import coordinates, grid, quality, regions
from plumbline.operators.grid import CELL
from plumbline.operators.regrid import align, axis_weights
from plumbline.session import written
from plumbline.sources.landing import needed_times, within

RUN = ["init_time", "lead_hours"]
EARLIER = "earlier_mean_sea_level_pressure"


def _variable(name: str, level: int | None = None) -> Column:
    at = F.col("variable") == name
    if level is not None:
        at = at & (F.col("level_hpa") == level)
    return F.when(at, F.col("value"))


def forecast_fields(forecast: DataFrame, spread: bool = False) -> DataFrame:
    """Wide row per (init, lead, cell): means over members (if any) and optional spreads, in one aggregate."""
    means = {
        "mslp": _variable("mean_sea_level_pressure"),
        "t2m": _variable("2m_temperature"),
        "u10": _variable("10m_u_component_of_wind"),
        "v10": _variable("10m_v_component_of_wind"),
        "u850": _variable("u_component_of_wind", 850),
        "v850": _variable("v_component_of_wind", 850),
        "z500": _variable("geopotential", 500),
        "z850": _variable("geopotential", 850),
        "precip": _variable("total_precipitation_24hr"),
        "earlier": _variable(EARLIER),
    }
    place = [F.max(F.when(F.col("variable") != EARLIER, F.col(c))).alias(c) for c in ("latitude", "longitude")]
    columns = [*place, *[F.avg(expression).alias(name) for name, expression in means.items()]]
    if spread:
        explicit = lambda name: F.avg(_variable(f"{name}_spread"))
        over_members = lambda key: F.stddev_pop(means[key])
        columns += [
            F.coalesce(explicit("mean_sea_level_pressure"), over_members("mslp")).alias("mslp_spread_pa"),
            explicit("2m_temperature").alias("temperature2m_spread_k"),
            F.coalesce(explicit("10m_u_component_of_wind"), over_members("u10")).alias("u10_spread_mps"),
            F.coalesce(explicit("10m_v_component_of_wind"), over_members("v10")).alias("v10_spread_mps"),
            F.coalesce(explicit("total_precipitation_24hr"), over_members("precip")).alias("precip24_spread_mm"),
        ]
    return forecast.groupBy(*RUN, *CELL).agg(*columns).filter(F.col("latitude").isNotNull())


def standard_units(rows: DataFrame) -> DataFrame:
    """Precipitation in mm (m where the table says nothing), geopotential only in its own unit; other units give null."""
    units = F.col("units") if "units" in rows.columns else F.lit(None).cast("string")
    gravity = C.FORECAST_UNITS["geopotential"][0]
    known = (
        F.when(F.col("variable").startswith("total_precipitation"), grid.precipitation_mm(F.col("value"), units, "m"))
        .when(F.col("variable") == "geopotential", F.when(F.coalesce(units, F.lit(gravity)) == gravity, F.col("value")))
        .otherwise(F.col("value"))
    )
    return rows.withColumn("value", known)


STATE = ["a_mslp", "a_t2m", "a_u10", "a_v10"]


def analysis_state(analysis: DataFrame) -> DataFrame:
    names = {
        "a_mslp": "mean_sea_level_pressure",
        "a_t2m": "2m_temperature",
        "a_u10": "10m_u_component_of_wind",
        "a_v10": "10m_v_component_of_wind",
    }
    return analysis.groupBy("valid_time", *CELL).agg(*[F.max(_variable(v)).alias(k) for k, v in names.items()])


def carried_weights(weights: DataFrame, source_axes: tuple, target_axes: tuple) -> DataFrame:
    """Region weights on the source grid: conservative regridding to the target grid and the regional mean in one.

    A region of which the source covers only a part gets null weights, and so no value.
    """
    lat, lon = (axis_weights(s, t, "conservative", i == 0) for i, (s, t) in enumerate(zip(source_axes, target_axes, strict=True)))
    lat = lat.select(F.col("dst_i").alias("lat_i"), F.col("src_i").alias("_lat"), F.col("w").alias("_y"))
    lon = lon.select(F.col("dst_i").alias("lon_i"), F.col("src_i").alias("_lon"), F.col("w").alias("_x"))
    moved = weights.join(lat, "lat_i").join(lon, "lon_i").withColumn("_w", F.col("weight") * F.col("_y") * F.col("_x"))
    cells = moved.groupBy("region_id", "region_name", F.col("_lat").alias("lat_i"), F.col("_lon").alias("lon_i")).agg(F.sum("_w").alias("_w"))
    sums = cells.groupBy("region_id").agg(F.sum("_w").alias("_sum"))
    whole = F.abs(F.col("_sum") - 1.0) <= C.WEIGHT_SUM_TOLERANCE
    return cells.join(sums, "region_id").select("region_id", "region_name", *CELL, F.when(whole, F.col("_w")).alias("weight"))


def same_axes(source: tuple, target: tuple) -> bool:
    return all(coordinates.axis_mismatches(s, t).isEmpty() for s, t in zip(source, target, strict=True))


def derive_rows(
    forecast: DataFrame,
    previous: DataFrame,
    analysis: DataFrame,
    weights: DataFrame,
    axes: tuple[DataFrame, DataFrame],
    dataset_version: str,
    inits: DataFrame | None = None,
    leads: list[int] | None = None,
    spread: bool = False,
    analysis_axes: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Feature and error rows per (init, lead, region), all cycles in one plan.

    ``forecast`` holds the runs to derive, ``previous`` the runs they drift against (may be the same
    table). Grids are clipped to the domain first; derivatives are one-sided at its edge. The region
    weights and axes are small tables; everything of grid size is joined by equality. ``analysis_axes``
    are the grid lines of the analysis where they differ from ``axes``. A column ``units`` is used where a table has one.
    """
    leads = leads or C.LEAD_HOURS
    own_grid = analysis_axes is not None and not same_axes(analysis_axes, axes)
    starts = forecast if inits is None else inits
    starts = written(starts.select("init_time").distinct(), "derive-starts")
    earlier_runs, valid_times = (written(t, "derive-times") for t in needed_times(starts, leads))
    # Points off the grid have no cell and are left out here; ``coordinates.off_axis`` lists them.
    place = lambda g, lines: coordinates.with_cell_index(g, *lines).filter("lat_i IS NOT NULL AND lon_i IS NOT NULL")
    chosen = coordinates.select_leads(within(forecast, "init_time", starts), leads)
    pressure = within(previous, "init_time", earlier_runs).filter(F.col("variable") == "mean_sea_level_pressure")
    long = ["latitude", "longitude", "variable", "value", "level_hpa"]
    earlier = pressure.select(
        add_hours(F.col("init_time"), F.lit(C.RUN_LAG_HOURS)).alias("init_time"),
        (F.col("lead_hours") - C.RUN_LAG_HOURS).alias("lead_hours"),
        *["latitude", "longitude", F.lit(EARLIER).alias("variable"), "value", "level_hpa"],
    )
    both = standard_units(chosen).select(*RUN, *long).unionByName(coordinates.select_leads(earlier, leads))
    fields = forecast_fields(place(both.filter(coordinates.in_domain()), axes), spread)
    fields = fields.withColumn("drift", F.abs(F.col("mslp") - F.col("earlier")))
    sloped = grid.gradient_and_vorticity(fields, "mslp", "u850", "v850", RUN)
    cells = coordinates.with_valid_time(sloped)

    known = standard_units(within(analysis, "valid_time", valid_times))
    placed = place(known, analysis_axes) if own_grid else place(known.filter(coordinates.in_domain()), axes)
    state = analysis_state(placed.filter(F.col("variable") != "total_precipitation_6hr"))
    step_weights = weights
    if own_grid:
        state, _ = align(state, analysis_axes, axes, ["valid_time"], STATE, "bilinear")
        step_weights = written(carried_weights(weights, analysis_axes, axes), "derive-weights")
    steps = placed.filter(F.col("variable") == "total_precipitation_6hr")
    regional = regions.zonal_means(steps, step_weights, ["valid_time"], {"_step": F.col("value")})
    totals = grid.trailing_totals(regional, ["region_id"], "_step", "_a_precip_mm")
    return _regional(grid.at_valid_time(cells, state), totals, weights, dataset_version, spread)


def _regional(matched: DataFrame, totals: DataFrame, weights: DataFrame, dataset_version: str, spread: bool) -> DataFrame:
    """All features and errors of a region from one weighted aggregate."""
    difference = lambda a, b: F.col(a) - F.col(b)
    fields = {
        "mslp_mean_pa": F.col("mslp"),
        "mslp_gradient_pa_per_km": F.col("gradient"),
        "temperature2m_mean_k": F.col("t2m"),
        "u10_mean_mps": F.col("u10"),
        "v10_mean_mps": F.col("v10"),
        "wind10_mean_mps": F.hypot("u10", "v10"),
        "wind850_mean_mps": F.hypot("u850", "v850"),
        "vorticity850_s1": F.col("vorticity"),
        "thickness500_850_m": grid.geopotential_height(F.col("z500")) - grid.geopotential_height(F.col("z850")),
        "precip24_mean_mm": F.col("precip"),
        "run_to_run_mslp_drift_pa": F.col("drift"),
        "e_wind_mps": F.hypot(difference("u10", "a_u10"), difference("v10", "a_v10")),
        "e_temperature_k": F.abs(difference("t2m", "a_t2m")),
        "e_mslp_pa": F.abs(difference("mslp", "a_mslp")),
    }
    spreads = [c for c in C.SPREAD_COLUMNS if c in matched.columns] if spread else []
    fields.update({c: F.col(c) for c in spreads})
    keys = [*RUN, "valid_time", "lead_day"]
    # A region without a complete 24 h total keeps its row and a null, which the checks report.
    zones = regions.zonal_means(matched, weights, keys, fields).join(totals, ["valid_time", "region_id"], "left")
    rows = zones.withColumn("e_precip_mm", F.abs(F.col("precip24_mean_mm") - F.col("_a_precip_mm")))
    rows = rows.withColumns(
        {
            "region_id": canonical_region(F.col("region_id")),
            "forecast_initialization_time": F.col("init_time"),
            "feature_source_time": F.col("init_time"),
            "dataset_version": F.lit(dataset_version),
            "region_id_semantics": F.lit("categorical"),
            **grid.season_terms("init_time"),
        }
    )
    # A spread without a source stays null for the whole table and is dropped by the caller's schema.
    return rows.select(*[f.name for f in C.DERIVED_ROW], *spreads)


def checked_cycles(rows: DataFrame) -> DataFrame:
    """Derived rows after all contract checks: no leakage, finite values, full cycles."""
    problems = quality.schema_problems(rows.columns) + quality.leaked_columns(rows.columns)
    if problems:
        raise ContractViolation(f"derived rows: {problems}")
    rows = written(rows, "derived-rows")
    raise_if_any(quality.late_sources(rows), "feature source later than initialization")
    numeric = [c for c in C.FORECAST_FEATURES + C.ERROR_COLUMNS if c in rows.columns]
    raise_if_any(quality.non_finite_counts(rows, numeric), "derived rows hold non-finite values")
    return rows
