"""The derivation from landing tables to regional rows, over events as weather."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import contract as C
from plumbline.functions.scalars import add_hours
from plumbline.plans import bindings as B
from plumbline.plans.derive import derive_rows
from plumbline.plans.grid_queries import _slope
from plumbline.plans.registry import day, query, rounded
from plumbline.session import scratch_dir, written


def _field(n: int) -> str:
    return f"""field{n} AS (
  SELECT t, i, j, coalesce(c.v, m) AS v
  FROM (SELECT t, m, i, j FROM (SELECT t, avg(value) AS m FROM slots GROUP BY t), range({n}) a(i), range({n}) b(j)) f
  LEFT JOIN (SELECT t, user_id % {n} AS i, event_id % {n} AS j, avg(value) AS v FROM slots GROUP BY ALL) c USING (t, i, j))"""


_MEANS = ["mslp", "t2m", "u10", "v10", "wind10", "wind850", "thickness", "precip", "drift", "gradient", "vorticity", "e_wind", "e_t", "e_mslp"]

_SQL = f"""
WITH slots AS (SELECT date_trunc('day', ts) + to_hours((hour(ts) // 6) * 6) AS t, user_id, event_id, value FROM events),
{_field(5)}, {_field(6)},
bounds AS (SELECT min(t) + INTERVAL 12 HOURS AS low, max(t) - INTERVAL 72 HOURS AS high FROM slots),
runs AS (
  SELECT f.t AS init, lead, f.i, f.j, radians(6 + 1.5::DOUBLE * f.i) AS y, radians(68 + 1.5::DOUBLE * f.j) AS x, f.t + to_hours(lead) AS valid,
         1.00655355::DOUBLE * (100000 + 10 * f.v + lead) AS mslp, 1.00655355::DOUBLE * (280 + f.v / 10) AS t2m, 1.00655355::DOUBLE * (f.v / 7 - 3) AS u10,
         1.00655355::DOUBLE * (f.v / 9 + lead / 24) AS v10, 1.00655355::DOUBLE * f.v / 5 AS u850, 1.00655355::DOUBLE * (f.v / 6 - lead / 12) AS v850,
         1.00655355::DOUBLE * (40000 + 10 * f.v) / 9.80665 AS thickness, 1.00655355::DOUBLE * f.v / 10 AS precip, 1.00655355::DOUBLE * (100000 + 10 * p.v + lead + 12) AS earlier
  FROM field5 f JOIN bounds ON f.t BETWEEN low AND high JOIN (VALUES (24), (48), (72)) l(lead) ON true
  LEFT JOIN field5 p ON p.t = f.t - INTERVAL 12 HOURS AND p.i = f.i AND p.j = f.j
  WHERE hour(f.t) IN (0, 12)),
sloped AS (
  SELECT *, {_slope("mslp", "y", "init, lead, j", "i")} AS py, {_slope("u850", "y", "init, lead, j", "i")} AS uy,
         {_slope("mslp", "x", "init, lead, i", "j")} AS px, {_slope("v850", "x", "init, lead, i", "j")} AS vx
  FROM runs),
state AS (
  SELECT t AS valid, c.i, c.j, avg(100000 + 10 * v) AS a_mslp, avg(280 + v / 10) AS a_t2m, avg(v / 7 - 3) AS a_u10, avg(v / 9) AS a_v10
  FROM field6 f JOIN (SELECT i, j FROM range(5) a(i), range(5) b(j)) c ON f.i IN (c.i, c.i + 1) AND f.j IN (c.j, c.j + 1) GROUP BY ALL),
areas AS (
  SELECT i, j, (i + j) % 5 AS region_id, sin(radians(6.75 + 1.5::DOUBLE * i)) - sin(radians(5.25 + 1.5::DOUBLE * i)) AS area
  FROM range(5) a(i), range(5) b(j)),
weights AS (SELECT *, area / sum(area) OVER (PARTITION BY region_id) AS w FROM areas),
halves AS (
  SELECT i, a, (sin(radians(5.25 + 1.5::DOUBLE * i + 0.75 * (a - i) + 0.75)) - sin(radians(5.25 + 1.5::DOUBLE * i + 0.75 * (a - i))))
               / (sin(radians(6.75 + 1.5::DOUBLE * i)) - sin(radians(5.25 + 1.5::DOUBLE * i))) AS share
  FROM range(5) l(i), range(6) m(a) WHERE a IN (i, i + 1)),
steps AS (
  SELECT t, region_id, sum(w * share * 0.5 * v / 40) AS step
  FROM weights JOIN halves USING (i) JOIN field6 f ON f.i = a AND f.j IN (weights.j, weights.j + 1) GROUP BY ALL),
totals AS (
  SELECT t + to_hours(h) AS valid, region_id, sum(step) AS total FROM steps, (VALUES (0), (6), (12), (18)) o(h) GROUP BY ALL HAVING count(*) = 4),
cells AS (
  SELECT *, sqrt(u10 * u10 + v10 * v10) AS wind10, sqrt(u850 * u850 + v850 * v850) AS wind850, abs(mslp - earlier) AS drift,
         sqrt(pow(py / 6371008.8, 2) + pow(px / (6371008.8 * cos(y)), 2)) * 1000 AS gradient,
         (vx / (6371008.8 * cos(y)) - uy / 6371008.8) * 1e6 AS vorticity,
         sqrt(pow(u10 - a_u10, 2) + pow(v10 - a_v10, 2)) AS e_wind, abs(t2m - a_t2m) AS e_t, abs(mslp - a_mslp) AS e_mslp
  FROM sloped JOIN state USING (valid, i, j)),
zones AS (
  SELECT init, lead, valid, region_id, {", ".join(f"CASE WHEN count({c}) = 5 THEN sum({c} * w) END AS {c}" for c in _MEANS)}
  FROM cells JOIN weights USING (i, j) GROUP BY ALL)
SELECT 'imd-' || lpad(region_id::VARCHAR, 2, '0') AS region_id, r_name AS region_name, strftime(init, '%Y-%m-%d %H:%M:%S') AS init_time,
       strftime(valid, '%Y-%m-%d %H:%M:%S') AS valid_time, CAST(lead // 24 AS INTEGER) AS lead_day,
       round(mslp, 4) AS mslp_mean_pa, round(gradient, 6) AS mslp_gradient_pa_per_km, round(t2m, 6) AS temperature2m_mean_k,
       round(u10, 6) + 0.0 AS u10_mean_mps, round(v10, 6) + 0.0 AS v10_mean_mps, round(wind10, 6) AS wind10_mean_mps,
       round(wind850, 6) AS wind850_mean_mps, round(vorticity, 4) + 0.0 AS vorticity850_s1, round(thickness, 4) AS thickness500_850_m,
       round(precip, 6) AS precip24_mean_mm, round(drift, 4) AS run_to_run_mslp_drift_pa,
       round(sin(2 * pi() * dayofyear(init) / 366), 6) + 0.0 AS season_sin, round(cos(2 * pi() * dayofyear(init) / 366), 6) + 0.0 AS season_cos,
       round(abs(precip - total), 6) AS e_precip_mm, round(e_wind, 6) AS e_wind_mps, round(e_t, 6) AS e_temperature_k, round(e_mslp, 4) AS e_mslp_pa
FROM zones JOIN region ON r_regionkey = region_id LEFT JOIN totals USING (valid, region_id)
"""

_DIGITS = {"mslp_mean_pa": 4, "thickness500_850_m": 4, "run_to_run_mslp_drift_pa": 4, "e_mslp_pa": 4}


def derived(spark: SparkSession, d: str, root: str | None = None) -> DataFrame:
    """All runs of the binding whose earlier run and 72 h of analyses exist, from landing tables by month."""
    forecast, analysis = B.weather(spark, d, root or f"{scratch_dir(spark)}/weather-{uuid.uuid4().hex}")
    time = F.col("valid_time")
    first, last = analysis.agg(F.min(time), F.max(time)).first()
    ntz = lambda t: F.lit(t).cast("timestamp_ntz")
    inits = forecast.select("init_time").distinct()
    if first is not None:
        low, high = add_hours(ntz(first), F.lit(C.RUN_LAG_HOURS)), add_hours(ntz(last), F.lit(-max(B.RUN_LEADS)))
        inits = inits.filter(F.col("init_time").between(low, high))
    weights = written(B.weather_weights(spark, d), "weather-weights")
    return derive_rows(
        forecast, forecast, analysis, weights, B.even_axes(spark, (6.0, 68.0), 5), "events-v1", inits, B.RUN_LEADS,
        analysis_axes=B.even_axes(spark, (5.25, 67.25), 6),
    )


@query(_SQL)
def derived_rows(spark: SparkSession, d: str) -> DataFrame:
    """Features and errors per run, lead and region: pruned scans, analysis aligned from another grid, units (B-02, G-02, G-15, G-16)."""
    rows = derived(spark, d).withColumn("vorticity850_s1", F.col("vorticity850_s1") * 1e6)
    numbers = [rounded(c, _DIGITS.get(c, 4 if c == "vorticity850_s1" else 6)) for c in C.FORECAST_FEATURES + C.ERROR_COLUMNS if c != "lead_day"]
    return rows.select("region_id", "region_name", day("forecast_initialization_time", "init_time"), day("valid_time"), "lead_day", *numbers)
