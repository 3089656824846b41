"""Grid, regridding and region queries; cells are arithmetic on order and part keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.geometry import AUTHALIC_RADIUS_M, FLATTENING
from plumbline.functions.scalars import add_hours, canonical_region
from plumbline.operators import coordinates, grid, regions
from plumbline.operators.regrid import align
from plumbline.plans import bindings as B
from plumbline.plans.registry import day, query, rounded
from plumbline.session import written

GRID = """
grid AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(l_partkey % 12 AS INTEGER) AS lat_i,
         CAST(l_orderkey % 12 AS INTEGER) AS lon_i, 6.0::DOUBLE + 1.5::DOUBLE * (l_partkey % 12) AS latitude,
         68.0::DOUBLE + 1.5::DOUBLE * (l_orderkey % 12) AS longitude,
         avg(l_extendedprice) AS f, avg(l_quantity) AS u, avg(l_discount * 100) AS v
  FROM lineitem GROUP BY ALL)
"""

AREAS = (
    GRID
    + """,
areas AS (
  SELECT DISTINCT lat_i, lon_i, latitude, longitude, (lat_i + lon_i) % 5 AS region_id,
         (sin(radians(latitude + 0.75)) - sin(radians(latitude - 0.75))) * radians(1.5) AS area
  FROM grid),
weights AS (
  SELECT areas.*, r_name AS region_name, area / sum(area) OVER (PARTITION BY region_id) AS weight
  FROM areas JOIN region ON r_regionkey = region_id)
"""
)

CYCLES = """
cycles AS (
  SELECT date_trunc('day', ts) + to_hours((hour(ts) // 12) * 12) AS init_time,
         CAST(24 * (user_id % 3 + 1) AS INTEGER) AS lead_hours, event_type AS region_id, user_id, value FROM events)
"""


@query(
    """WITH points AS (
      SELECT 3 + 1.5::DOUBLE * (l_partkey % 30) AS lat, 68 + 1.5::DOUBLE * (l_orderkey % 40) - 360 AS lon,
             12 * l_linenumber AS lead_hours, l_shipdate AS t, l_quantity FROM lineitem)
    SELECT lat AS latitude, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS longitude, lead_hours, count(*) AS rows,
           round(avg(l_quantity), 6) AS value
    FROM points WHERE lat BETWEEN 6 AND 38 AND lon + 360 BETWEEN 68 AND 98 AND month(t) BETWEEN 6 AND 9
      AND lead_hours IN (24, 48, 72, 96, 120, 144, 168, 192, 216, 240)
    GROUP BY ALL"""
)
def domain_selection(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates normalized, then box, season and lead selection (F-01, F-03, F-04, F-05)."""
    points = B.table(spark, d, "lineitem").select(
        (F.lit(3) + 1.5 * (F.col("l_partkey") % 30)).alias("lat"),
        (F.lit(68) + 1.5 * (F.col("l_orderkey") % 40) - 360).alias("lon"),
        (F.lit(12) * F.col("l_linenumber")).alias("lead_hours"),
        F.col("l_shipdate").alias("t"),
        "l_quantity",
    )
    chosen = coordinates.normalize_coordinates(points).filter(coordinates.in_domain() & coordinates.in_months(F.col("t")))
    return (
        coordinates.select_leads(chosen)
        .groupBy("latitude", "longitude", "lead_hours")
        .agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("l_quantity"), 6).alias("value"))
    )


@query(
    """WITH v AS (
      SELECT 24 * (user_id % 12) AS lead_value, CASE WHEN event_type = 'error' THEN 'days' ELSE 'hours' END AS units FROM events)
    SELECT CAST(CASE WHEN units = 'hours' THEN lead_value ELSE -1 END AS INTEGER) AS lead_hours,
           CAST(CASE WHEN units = 'hours' THEN lead_value // 24 ELSE -1 END AS INTEGER) AS lead_day, count(*) AS rows
    FROM v GROUP BY ALL"""
)
def lead_decoding(spark: SparkSession, d: str) -> DataFrame:
    """Integer leads decoded by unit; rows of other units have none, shown as -1 (F-06, F-10)."""
    units = F.when(F.col("event_type") == "error", "days").otherwise("hours")
    decoded = B.table(spark, d, "events").select(coordinates.lead_hours(24 * (F.col("user_id") % 12), units).alias("lead_hours"))
    rows = decoded.withColumn("lead_day", F.expr("CAST(lead_hours DIV 24 AS INT)"))
    return rows.fillna(-1).groupBy("lead_hours", "lead_day").agg(F.count(F.lit(1)).alias("rows"))


@query(
    """WITH a AS (SELECT DISTINCT 6.0 + 0.01 * l_suppkey + 0.001 * (l_suppkey % 7) AS value FROM lineitem),
    b AS (SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS idx, CAST(value AS DOUBLE) AS value FROM a),
    n AS (SELECT *, lag(value) OVER (ORDER BY idx) AS p, lead(value) OVER (ORDER BY idx) AS q FROM b)
    SELECT idx, round(value, 6) AS value, round(value - coalesce((value - p) / 2, (q - value) / 2), 6) AS low,
           round(value + coalesce((q - value) / 2, (value - p) / 2), 6) AS high FROM n"""
)
def axis_cell_edges(spark: SparkSession, d: str) -> DataFrame:
    """Axis from distinct coordinates with midpoint cell bounds, uneven spacing (F-02, G-11)."""
    key = F.col("l_suppkey")
    value = (F.lit(6.0) + 0.01 * key + 0.001 * (key % 7)).alias("value")
    axis = coordinates.axis_table(B.table(spark, d, "lineitem").select(value), "value")
    return coordinates.cell_edges(axis).select("idx", rounded("value"), rounded("low"), rounded("high"))


@query(
    """WITH a AS (SELECT DISTINCT l_suppkey + 1 AS idx, 6.0::DOUBLE + 0.5::DOUBLE * (l_suppkey + 1) AS source_value FROM lineitem),
    b AS (SELECT DISTINCT s_suppkey AS idx,
                 6.0::DOUBLE + 0.5::DOUBLE * s_suppkey + CASE WHEN s_suppkey % 10 = 3 THEN 0.00001 ELSE 0 END AS target_value
          FROM supplier)
    SELECT idx, round(source_value, 6) AS source_value, round(target_value, 6) AS target_value
    FROM a FULL JOIN b USING (idx) WHERE NOT coalesce(abs(source_value - target_value) <= 1e-6, false)"""
)
def axis_differences(spark: SparkSession, d: str) -> DataFrame:
    """Positions at which two axes disagree by more than the tolerance (G-12, G-13, Q-09)."""
    value = lambda key: F.lit(6.0) + 0.5 * key
    moved, key = F.col("l_suppkey") + 1, F.col("s_suppkey")
    source = B.table(spark, d, "lineitem").select(moved.alias("idx"), value(moved).alias("value")).distinct()
    shifted = value(key) + F.when(key % 10 == 3, 0.00001).otherwise(0.0)
    target = B.table(spark, d, "supplier").select(key.alias("idx"), shifted.alias("value")).distinct()
    found = coordinates.axis_mismatches(source, target)
    return found.select("idx", rounded("source_value"), rounded("target_value"))


@query(
    """WITH v AS (
      SELECT DISTINCT 'part' AS axis, round(l_partkey / 8.0::DOUBLE, 10) AS value FROM lineitem
      UNION ALL SELECT DISTINCT 'supplier', round(l_suppkey / 4.0::DOUBLE, 10) FROM lineitem)
    SELECT axis, count(*) AS size, sha256(string_agg(printf('%.10f', value), ',' ORDER BY value)) AS sha256
    FROM v GROUP BY axis"""
)
def axis_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Hash of each axis' sorted, rounded coordinates (G-14, S-12)."""
    line = B.table(spark, d, "lineitem")
    part = line.select(F.lit("part").alias("axis"), (F.col("l_partkey") / F.lit(8.0)).alias("value")).distinct()
    supplier = line.select(F.lit("supplier").alias("axis"), (F.col("l_suppkey") / F.lit(4.0)).alias("value")).distinct()
    return coordinates.axis_signature(part.unionByName(supplier))


def _slope(value: str, x: str, line: str, order: str) -> str:
    w = f"(PARTITION BY {line} ORDER BY {order})"
    before, after = f"lag({value}) OVER {w}", f"lead({value}) OVER {w}"
    hs, hd = f"({x} - lag({x}) OVER {w})", f"((lead({x}) OVER {w}) - {x})"
    return f"""CASE WHEN ({before}) IS NULL THEN (({after}) - {value}) / {hd}
        WHEN ({after}) IS NULL THEN ({value} - ({before})) / {hs}
        ELSE ({hs} * {hs} * ({after}) + ({hd} * {hd} - {hs} * {hs}) * {value} - {hd} * {hd} * ({before}))
             / ({hs} * {hd} * ({hs} + {hd})) END"""


@query(
    f"""WITH {GRID}, r AS (SELECT *, radians(latitude) AS y, radians(longitude) AS x FROM grid),
    s AS (SELECT *, {_slope("f", "y", "yr, lon_i", "lat_i")} AS fy, {_slope("u", "y", "yr, lon_i", "lat_i")} AS uy,
                 {_slope("f", "x", "yr, lat_i", "lon_i")} AS fx, {_slope("v", "x", "yr, lat_i", "lon_i")} AS vx FROM r)
    SELECT yr, lat_i, lon_i,
           round(sqrt(pow(fy / 6371008.8, 2) + pow(fx / (6371008.8 * cos(y)), 2)) * 1000, 6) AS gradient,
           round((vx / (6371008.8 * cos(y)) - uy / 6371008.8) * 1e6, 6) + 0.0 AS vorticity FROM s"""
)
def grid_derivatives(spark: SparkSession, d: str) -> DataFrame:
    """Gradient magnitude per km and relative vorticity on the sphere (G-03, G-04, W-03)."""
    found = grid.gradient_and_vorticity(B.grid(spark, d), "f", "u", "v", ["yr"])
    return found.select("yr", "lat_i", "lon_i", rounded("gradient"), rounded(F.col("vorticity") * 1e6, 6, "vorticity"))


@query(
    """WITH lines AS (
      SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, l_partkey % 1000 AS x, l_suppkey AS y FROM lineitem GROUP BY ALL)
    SELECT yr, 'latitude' AS axis, x AS at, count(*) AS points FROM lines GROUP BY yr, x HAVING count(*) < 2
    UNION ALL SELECT yr, 'longitude', y, count(*) FROM lines GROUP BY yr, y HAVING count(*) < 2"""
)
def single_point_lines(spark: SparkSession, d: str) -> DataFrame:
    """Grid lines on which no derivative exists (2.3.1)."""
    line = B.table(spark, d, "lineitem")
    cells = line.select(
        F.year("l_shipdate").alias("yr"), (F.col("l_partkey") % 1000).alias("longitude"), F.col("l_suppkey").alias("latitude")
    ).distinct()
    return grid.short_lines(cells, ["yr"]).select("yr", "axis", "at", "points")


@query(
    """SELECT CAST(l_partkey % 12 AS INTEGER) AS lat_i, CAST(l_orderkey % 12 AS INTEGER) AS lon_i,
           round(max(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / 9.80665 END)
                 - max(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice / 9.80665 END), 6) + 0.0 AS thickness,
           round(avg(sqrt(l_quantity * l_quantity + l_tax * l_tax * 10000)), 6) AS speed
    FROM lineitem GROUP BY ALL"""
)
def layer_thickness(spark: SparkSession, d: str) -> DataFrame:
    """Height difference of two levels and mean of cell speeds (G-01, G-05, G-06, F-07)."""
    line = B.table(spark, d, "lineitem").withColumns(
        {
            "lat_i": (F.col("l_partkey") % 12).cast("int"),
            "lon_i": (F.col("l_orderkey") % 12).cast("int"),
            "level_hpa": F.when(F.col("l_linenumber") % 2 == 0, 500).otherwise(850),
            "height": grid.geopotential_height(F.col("l_extendedprice")),
        }
    )
    thick = grid.level_difference(line, grid.CELL, "height", 500, 850, "thickness")
    speed = line.groupBy(*grid.CELL).agg(F.avg(F.hypot(F.col("l_quantity"), F.col("l_tax") * 100)).alias("speed"))
    return thick.join(speed, grid.CELL).select(*grid.CELL, rounded("thickness"), rounded("speed"))


@query(
    """SELECT l_returnflag, round(sum(CASE coalesce(CASE l_returnflag WHEN 'A' THEN 'm' WHEN 'N' THEN 'mm' END,
                 CASE WHEN l_linestatus = 'F' THEN 'm' END) WHEN 'm' THEN l_tax * 1000 WHEN 'mm' THEN l_tax END), 4) AS total_mm,
           count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus <> 'F') AS unknown_units
    FROM lineitem GROUP BY ALL"""
)
def precipitation_units(spark: SparkSession, d: str) -> DataFrame:
    """Accumulations converted to mm with inherited units; unknown units are counted (G-02)."""
    units = F.when(F.col("l_returnflag") == "A", "m").when(F.col("l_returnflag") == "N", "mm")
    actual = F.coalesce(units, F.when(F.col("l_linestatus") == "F", "m"))
    amount = grid.precipitation_mm(F.col("l_tax"), actual)
    rows = B.table(spark, d, "lineitem").withColumn("mm", amount)
    return rows.groupBy("l_returnflag").agg(
        F.round(F.sum("mm"), 4).alias("total_mm"), F.count_if(F.col("mm").isNull()).alias("unknown_units")
    )


@query(
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(l_partkey % 12 AS INTEGER) AS lat_i, CAST(l_orderkey % 12 AS INTEGER) AS lon_i,
           round(avg(l_quantity), 6) AS l_quantity, round(stddev_pop(l_quantity), 6) AS l_quantity_spread,
           round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY ALL"""
)
def ensemble_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population spread over members of each cell (G-07, A-12)."""
    members = B.table(spark, d, "lineitem").withColumns(
        {
            "yr": F.year("l_shipdate"),
            "lat_i": (F.col("l_partkey") % 12).cast("int"),
            "lon_i": (F.col("l_orderkey") % 12).cast("int"),
        }
    )
    keys = ["yr", *grid.CELL]
    found = grid.ensemble_statistics(members, keys, ["l_quantity", "l_tax"], ["l_quantity"])
    return found.select(*keys, rounded("l_quantity"), rounded("l_quantity_spread"), rounded("l_tax"))


@query(
    f"""WITH {CYCLES}, runs AS (SELECT init_time, lead_hours, region_id, avg(value) AS value FROM cycles GROUP BY ALL),
    previous AS (SELECT init_time, lead_hours + 12 AS lead_hours, region_id, value FROM runs)
    SELECT strftime(r.init_time, '%Y-%m-%d %H:%M:%S') AS init_time, r.lead_hours, r.region_id,
           round(abs(r.value - p.value), 6) AS drift
    FROM runs r LEFT JOIN previous p ON p.region_id = r.region_id AND p.init_time = r.init_time - INTERVAL 12 HOURS
         AND p.lead_hours = r.lead_hours + 12"""
)
def run_drift(spark: SparkSession, d: str) -> DataFrame:
    """Change against the run 12 h earlier at the same valid time, null without it (G-08, J-08)."""
    runs = B.cycles(spark, d).groupBy("init_time", "lead_hours", "region_id").agg(F.avg("value").alias("value"))
    previous = runs.withColumn("lead_hours", F.col("lead_hours") + 12)
    found = grid.run_to_run_drift(runs, previous, ["region_id"], "value", "drift")
    return found.select(day("init_time"), "lead_hours", "region_id", rounded("drift"))


@query(
    """WITH steps AS (
      SELECT event_type, date_trunc('day', ts) + to_hours((hour(ts) // 6) * 6) AS valid_time, sum(value) AS v
      FROM events GROUP BY ALL),
    sent AS (SELECT event_type, valid_time + to_hours(h) AS valid_time, v FROM steps, (VALUES (0), (6), (12), (18)) o(h))
    SELECT event_type, strftime(valid_time, '%Y-%m-%d %H:%M:%S') AS valid_time, round(sum(v), 4) AS total
    FROM sent GROUP BY event_type, sent.valid_time HAVING count(*) = 4"""
)
def trailing_totals(spark: SparkSession, d: str) -> DataFrame:
    """24 h totals of four 6 h steps, complete ones only (G-09, W-06)."""
    steps = B.table(spark, d, "events").groupBy("event_type", B.floor_time("ts", 6).alias("valid_time"))
    found = grid.trailing_totals(steps.agg(F.sum("value").alias("v")), ["event_type"], "v", "total")
    return found.select("event_type", day("valid_time"), rounded("total", 4))


@query(
    """SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS init_time,
           round(sin(2 * pi() * dayofyear(o_orderdate) / 366), 6) + 0.0 AS season_sin,
           round(cos(2 * pi() * dayofyear(o_orderdate) / 366), 6) + 0.0 AS season_cos FROM orders"""
)
def season_terms(spark: SparkSession, d: str) -> DataFrame:
    """Annual cycle of the start day with a fixed 366-day period (G-10)."""
    days = B.table(spark, d, "orders").select("o_orderdate").distinct().withColumns(grid.season_terms("o_orderdate"))
    return days.select(day("o_orderdate", "init_time"), rounded("season_sin"), rounded("season_cos"))


@query(
    f"""WITH {CYCLES}, f AS (
      SELECT region_id, init_time, lead_hours, init_time + to_hours(lead_hours) AS valid_time, avg(value) AS f FROM cycles GROUP BY ALL),
    a AS (SELECT region_id, init_time AS valid_time, avg(value) AS a FROM cycles GROUP BY ALL)
    SELECT region_id, strftime(init_time, '%Y-%m-%d %H:%M:%S') AS init_time, lead_hours, round(f - a, 6) + 0.0 AS error
    FROM f JOIN a USING (region_id, valid_time)"""
)
def verification_at_valid_time(spark: SparkSession, d: str) -> DataFrame:
    """Forecast minus analysis at exactly the valid time (G-16, J-09, F-10)."""
    rows = B.cycles(spark, d)
    forecast = rows.groupBy("region_id", "init_time", "lead_hours").agg(F.avg("value").alias("f"))
    analysis = rows.groupBy("region_id", F.col("init_time").alias("valid_time")).agg(F.avg("value").alias("a"))
    timed = forecast.withColumn("valid_time", add_hours(F.col("init_time"), F.col("lead_hours")))
    matched = grid.at_valid_time(timed, analysis, ["region_id"])
    return matched.select("region_id", day("init_time"), "lead_hours", rounded(F.col("f") - F.col("a"), 6, "error"))


def _target_axes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    line = B.table(spark, d, "lineitem")
    lat_i, lon_i = (F.col("l_partkey") % 10).cast("int"), (F.col("l_orderkey") % 10).cast("int")
    latitudes = line.select(lat_i.alias("idx"), (F.lit(7.0) + 1.4 * lat_i).alias("value")).distinct()
    longitudes = line.select(lon_i.alias("idx"), (F.lit(69.0) + 1.4 * lon_i).alias("value")).distinct()
    return written(latitudes, "target-lat"), written(longitudes, "target-lon")


def _regridded(spark: SparkSession, d: str, method: str) -> DataFrame:
    """All target cells; one source cell in 37 is nulled, so that cells next to it have no value."""
    gap = (F.col("lat_i") + F.col("lon_i") + F.col("yr")) % 37 == 0
    cells = B.grid(spark, d).select("yr", *grid.CELL, F.when(~gap, F.col("f")).alias("f"), "u")
    moved, _ = align(cells, B.grid_axes(spark, d), _target_axes(spark, d), ["yr"], ["f", "u"], method)
    return moved.select("yr", *grid.CELL, rounded("f", 4), rounded("u"))


_TARGETS = """
tlat AS (SELECT DISTINCT CAST(l_partkey % 10 AS INTEGER) AS i, 7.0::DOUBLE + 1.4::DOUBLE * (l_partkey % 10) AS y FROM lineitem),
tlon AS (SELECT DISTINCT CAST(l_orderkey % 10 AS INTEGER) AS i, 69.0::DOUBLE + 1.4::DOUBLE * (l_orderkey % 10) AS y FROM lineitem),
slat AS (SELECT DISTINCT lat_i AS i, latitude AS x FROM grid),
slon AS (SELECT DISTINCT lon_i AS i, longitude AS x FROM grid)
"""
_APPLY = """,
gapped AS (SELECT yr, lat_i, lon_i, CASE WHEN (lat_i + lon_i + yr) % 37 <> 0 THEN f END AS f, u FROM grid),
moved AS (
  SELECT yr, wlat.i AS lat_i, wlon.i AS lon_i,
         CASE WHEN abs(sum(wlat.w * wlon.w) FILTER (WHERE f IS NOT NULL) - 1) <= 1e-9 THEN round(sum(wlat.w * wlon.w * f), 4) END AS f,
         CASE WHEN abs(sum(wlat.w * wlon.w) - 1) <= 1e-9 THEN round(sum(wlat.w * wlon.w * u), 6) END AS u
  FROM gapped JOIN wlat ON wlat.s = gapped.lat_i JOIN wlon ON wlon.s = gapped.lon_i
  GROUP BY yr, wlat.i, wlon.i)
SELECT y.yr, tlat.i AS lat_i, tlon.i AS lon_i, f, u
FROM (SELECT DISTINCT yr FROM grid) y CROSS JOIN tlat CROSS JOIN tlon
LEFT JOIN moved ON moved.yr = y.yr AND moved.lat_i = tlat.i AND moved.lon_i = tlon.i
"""


@query(
    f"""WITH {GRID}, {_TARGETS},
    wlat AS (SELECT tlat.i, slat.i AS s, 1 - abs(y - x) / 1.5 AS w FROM tlat JOIN slat ON abs(y - x) < 1.5),
    wlon AS (SELECT tlon.i, slon.i AS s, 1 - abs(y - x) / 1.5 AS w FROM tlon JOIN slon ON abs(y - x) < 1.5)
    {_APPLY}"""
)
def regrid_bilinear(spark: SparkSession, d: str) -> DataFrame:
    """Bilinear interpolation to another grid by sparse weights (G-15)."""
    return _regridded(spark, d, "bilinear")


@query(
    f"""WITH {GRID}, {_TARGETS},
    wlat AS (
      SELECT tlat.i, slat.i AS s, (sin(radians(least(y + 0.7, x + 0.75))) - sin(radians(greatest(y - 0.7, x - 0.75))))
             / (sin(radians(y + 0.7)) - sin(radians(y - 0.7))) AS w
      FROM tlat JOIN slat ON x - 0.75 < y + 0.7 AND x + 0.75 > y - 0.7),
    wlon AS (
      SELECT tlon.i, slon.i AS s, (least(y + 0.7, x + 0.75) - greatest(y - 0.7, x - 0.75)) / 1.4 AS w
      FROM tlon JOIN slon ON x - 0.75 < y + 0.7 AND x + 0.75 > y - 0.7)
    {_APPLY}"""
)
def regrid_conservative(spark: SparkSession, d: str) -> DataFrame:
    """First-order conservative regridding by cell overlaps (G-15)."""
    return _regridded(spark, d, "conservative")


@query(
    f"""WITH {AREAS} SELECT CAST(region_id AS INTEGER) AS region_id, region_name, lat_i, lon_i, round(weight, 9) AS weight FROM weights"""
)
def region_weights(spark: SparkSession, d: str) -> DataFrame:
    """Cell weights as shares of each region's area (R-02, R-03, W-04)."""
    found = regions.normalized_weights(B.grid_areas(spark, d))
    return found.select("region_id", "region_name", *grid.CELL, rounded("weight", 9))


@query(
    f"""WITH {AREAS}, joined AS (SELECT yr, region_id, region_name, f * weight AS fw, sqrt(u * u + v * v) * weight AS sw
      FROM weights LEFT JOIN grid USING (lat_i, lon_i)),
    cells AS (SELECT region_id, count(*) AS cells FROM weights GROUP BY region_id)
    SELECT yr, CAST(region_id AS INTEGER) AS region_id, region_name,
           CASE WHEN count(*) = any_value(cells) THEN round(sum(fw), 4) END AS f,
           CASE WHEN count(*) = any_value(cells) THEN round(sum(sw), 6) END AS speed
    FROM joined JOIN cells USING (region_id) GROUP BY yr, region_id, region_name"""
)
def zonal_means(spark: SparkSession, d: str) -> DataFrame:
    """Area-weighted regional means of all fields in one pass, null for incomplete regions (R-04, J-02, J-03, A-01)."""
    weights = written(regions.normalized_weights(B.grid_areas(spark, d)), "grid-weights")
    fields = {"f": F.col("f"), "speed": F.hypot("u", "v")}
    zones = regions.zonal_means(B.grid(spark, d), weights, ["yr"], fields)
    return zones.select("yr", "region_id", "region_name", rounded("f", 4), rounded("speed"))


@query(
    f"""WITH {AREAS}, matched AS (
      SELECT a.yr, a.lat_i, a.lon_i, a.f AS ff, b.f AS af, a.u AS fu, b.u AS au, a.v AS fv, b.v AS av
      FROM grid a JOIN grid b ON b.yr = a.yr + 1 AND b.lat_i = a.lat_i AND b.lon_i = a.lon_i),
    cells AS (SELECT region_id, count(*) AS cells FROM weights GROUP BY region_id)
    SELECT yr, CAST(region_id AS INTEGER) AS region_id,
           round(abs(sum(ff * weight) - sum(af * weight)), 4) AS e_precip_mm,
           round(sum(sqrt((fu - au) * (fu - au) + (fv - av) * (fv - av)) * weight), 6) AS e_wind_mps,
           round(sum(abs(fu - au) * weight), 6) AS e_temperature_k, round(sum(abs(ff - af) * weight), 4) AS e_mslp_pa
    FROM matched JOIN weights USING (lat_i, lon_i) JOIN cells USING (region_id)
    GROUP BY yr, region_id HAVING count(*) = any_value(cells)"""
)
def zonal_errors(spark: SparkSession, d: str) -> DataFrame:
    """Error of means against mean of errors, vector wind error (R-05, R-06, J-01)."""
    weights = written(regions.normalized_weights(B.grid_areas(spark, d)), "grid-weights")
    cells = B.grid(spark, d)
    later = cells.select((F.col("yr") - 1).alias("yr"), *grid.CELL, *[F.col(c).alias(f"a_{c}") for c in ("f", "u", "v")])
    matched = cells.join(later, ["yr", *grid.CELL])
    pairs = {"precip": ("f", "a_f"), "u": ("u", "a_u"), "v": ("v", "a_v"), "temperature": ("u", "a_u"), "mslp": ("f", "a_f")}
    found = regions.verification_errors(matched, weights, ["yr"], pairs).filter(F.col("e_mslp_pa").isNotNull())
    return found.select(
        "yr", "region_id", rounded("e_precip_mm", 4), rounded("e_wind_mps"), rounded("e_temperature_k"), rounded("e_mslp_pa", 4)
    )


_E2 = FLATTENING * (2 - FLATTENING)
BOXES = """
boxes AS (
  SELECT p_partkey AS region_id, p_name AS region_name, 68.0::DOUBLE + (p_partkey * 53 % 2719) / 100.0::DOUBLE AS w,
         6.0::DOUBLE + (p_partkey * 37 % 2917) / 100.0::DOUBLE AS s, 0.1::DOUBLE + p_size / 40.0::DOUBLE AS size FROM part)
"""


def _box_area(w: str, s: str, e: str, n: str) -> str:
    """Area of a box with great-circle edges on the authalic sphere, as SQL."""
    q = lambda y: f"((1 - {_E2!r}) * (sin({y}) / (1 - {_E2!r} * pow(sin({y}), 2)) + atanh(sqrt({_E2!r}) * sin({y})) / sqrt({_E2!r})))"
    half = lambda y: f"tan(asin(least(1, {q(f'radians({y})')} / {q('(pi() / 2)')})) / 2)"
    edge = lambda y: f"atan2(tan(radians({e} - {w}) / 2) * 2 * {half(y)}, 1 + pow({half(y)}, 2))"
    return f"(2 * ({edge(n)} - {edge(s)}) * {float(AUTHALIC_RADIUS_M) ** 2!r})"


@query(
    f"""WITH {GRID}, {BOXES},
    slat AS (SELECT DISTINCT lat_i, latitude AS y FROM grid), slon AS (SELECT DISTINCT lon_i, longitude AS x FROM grid),
    cut AS (
      SELECT region_id, lat_i, lon_i, greatest(w, x - 0.75) AS w, least(w + size, x + 0.75) AS e,
             greatest(s, y - 0.75) AS s, least(s + size, y + 0.75) AS n
      FROM boxes JOIN slat ON y - 0.75 < s + size AND y + 0.75 > s JOIN slon ON x - 0.75 < w + size AND x + 0.75 > w),
    areas AS (SELECT region_id, lat_i, lon_i, {_box_area("w", "s", "e", "n")} AS area FROM cut)
    SELECT region_id, lat_i, lon_i, round(area / 1e6, 3) AS area_km2 FROM areas WHERE area > 1000"""
)
def region_cell_areas(spark: SparkSession, d: str) -> DataFrame:
    """Ellipsoid area shared by each region and grid cell (R-01, J-10)."""
    latitudes, longitudes = B.grid_axes(spark, d)
    areas = regions.region_cell_areas(B.part_boxes(spark, d), latitudes, longitudes).filter(F.col("area_m2") > 1000)
    return areas.select("region_id", *grid.CELL, rounded(F.col("area_m2") / 1e6, 3, "area_km2"))


@query(
    f"""WITH {BOXES}, pairs AS (
      SELECT a.region_id AS left_id, b.region_id AS right_id, greatest(a.w, b.w) AS w, least(a.w + a.size, b.w + b.size) AS e,
             greatest(a.s, b.s) AS s, least(a.s + a.size, b.s + b.size) AS n
      FROM boxes a JOIN boxes b ON a.region_id < b.region_id AND a.w < b.w + b.size AND b.w < a.w + a.size
           AND a.s < b.s + b.size AND b.s < a.s + a.size),
    areas AS (SELECT left_id, right_id, {_box_area("w", "s", "e", "n")} / 1e6 AS area FROM pairs)
    SELECT left_id, right_id, round(area, 3) AS area_km2 FROM areas WHERE area > 0.000001"""
)
def region_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of regions that share area (R-08, J-11)."""
    found = regions.overlapping_regions(B.part_boxes(spark, d))
    return found.select("left_id", "right_id", rounded("area_km2", 3))


CLUSTERED = """
boxes AS (
  SELECT p_partkey AS region_id, -175.0::DOUBLE + (p_partkey // 40) % 350 + p_partkey % 40 * 0.02::DOUBLE AS w,
         -75.0::DOUBLE + (p_partkey // 14000) % 150 + (p_partkey * 7 % 40) * 0.02::DOUBLE AS s, 0.05::DOUBLE + p_size / 200::DOUBLE AS size FROM part)
"""


@query(
    f"""WITH {CLUSTERED}, pairs AS (
      SELECT a.region_id AS left_id, b.region_id AS right_id, greatest(a.w, b.w) AS w, least(a.w + a.size, b.w + b.size) AS e,
             greatest(a.s, b.s) AS s, least(a.s + a.size, b.s + b.size) AS n
      FROM boxes a JOIN boxes b ON a.region_id < b.region_id AND a.w < b.w + b.size AND b.w < a.w + a.size
           AND a.s < b.s + b.size AND b.s < a.s + a.size),
    areas AS (SELECT left_id, right_id, {_box_area("w", "s", "e", "n")} / 1e6 AS area FROM pairs)
    SELECT left_id, right_id, round(area, 3) AS area_km2 FROM areas WHERE area > 0.0001"""
)
def clustered_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of regions that share area, of clusters spread over the globe: adaptive tiles, output linear in the regions (R-08, J-11)."""
    found = regions.overlapping_regions(B.clustered_boxes(spark, d), tolerance_km2=1e-4)
    return found.select("left_id", "right_id", rounded("area_km2", 3))


@query(
    """WITH source AS (SELECT s_nationkey * 2 AS region_id, count(*) AS copies, min(s_name) AS actual FROM supplier GROUP BY ALL),
    paired AS (SELECT coalesce(s.region_id, n_nationkey) AS region_id, copies, actual, n_name AS expected
               FROM source s FULL JOIN nation ON n_nationkey = s.region_id)
    SELECT region_id, actual, expected, CASE WHEN expected IS NULL THEN 'unexpected' WHEN actual IS NULL THEN 'missing'
           WHEN copies > 1 THEN 'duplicate' ELSE 'name' END AS problem FROM paired"""
)
def region_differences(spark: SparkSession, d: str) -> DataFrame:
    """Source regions against the manifest: missing, unexpected, duplicate, renamed (R-07)."""
    supplier, nation = B.table(spark, d, "supplier"), B.table(spark, d, "nation")
    source = supplier.select((F.col("s_nationkey") * 2).alias("region_id"), F.col("s_name").alias("source_name"))
    manifest = nation.select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("source_name"))
    return regions.region_differences(source, manifest)


@query(
    """WITH risks AS (
      SELECT printf('imd-%02d', s_nationkey + 1) AS region_id, round(avg(s_acctbal) / 10000, 6) AS p, count(*) AS n
      FROM supplier GROUP BY s_nationkey)
    SELECT printf('imd-%02d', n_nationkey + 1) AS canonical_region_id, coalesce('risk of ' || risks.region_id, n_name) AS region_name,
           p AS bust_probability, CAST(n AS DOUBLE) AS lead_day
    FROM nation LEFT JOIN risks ON risks.region_id = printf('imd-%02d', n_nationkey + 1)"""
)
def risk_on_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Every region with its risk, null where there is none (R-09, R-10, J-16)."""
    geometry = B.table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("region_id"), F.col("n_name").alias("region_name"))
    supplier = B.table(spark, d, "supplier").groupBy("s_nationkey")
    averaged = supplier.agg(F.avg("s_acctbal").alias("_a"), F.count(F.lit(1)).cast("int").alias("lead_day"))
    name = canonical_region(F.col("s_nationkey") + 1)
    risks = averaged.select(
        name.alias("region_id"), F.concat(F.lit("risk of "), name).alias("region_name"),
        F.round(F.col("_a") / 10000, 6).alias("bust_probability"), "lead_day", F.lit(None).cast("timestamp_ntz").alias("valid_time"),
    )
    joined = regions.risk_on_geometry(geometry, risks)
    return joined.select("canonical_region_id", "region_name", "bust_probability", F.col("lead_day").cast("double").alias("lead_day"))
