"""Label queries on the order-line errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import contract as C
from plumbline.operators import labels, metrics
from plumbline.operators.coordinates import split_violations, with_split
from plumbline.plans import bindings as B
from plumbline.plans.registry import query, rounded

ERRORS = """
errors AS (
  SELECT l_orderkey, CAST(s_nationkey AS VARCHAR) AS region_id,
         CASE WHEN l_orderkey % 100 = 0 THEN 8 ELSE l_linenumber END AS lead_day,
         CAST(year(l_shipdate) AS INTEGER) AS yr, l_shipdate AS init, l_quantity, l_extendedprice,
         abs(l_extendedprice - l_quantity * p_retailprice) AS e1, abs(l_quantity - 25) AS e2,
         l_discount AS e3, l_tax AS e4
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
"""

GRAINS = (
    ERRORS
    + """,
long AS (
  SELECT 'precip' AS component, region_id, lead_day, e1 AS v FROM errors WHERE yr BETWEEN 1995 AND 1998
  UNION ALL SELECT 'mslp', region_id, lead_day, e2 FROM errors WHERE yr BETWEEN 1995 AND 1998
  UNION ALL SELECT 'wind', region_id, lead_day, e3 FROM errors WHERE yr BETWEEN 1995 AND 1998
  UNION ALL SELECT 'temperature', region_id, lead_day, e4 FROM errors WHERE yr BETWEEN 1995 AND 1998),
spread AS (
  SELECT component, 'region_lead' AS grain, region_id, lead_day, v FROM long
  UNION ALL SELECT component, 'lead', '*', lead_day, v FROM long
  UNION ALL SELECT component, 'global', '*', -1, v FROM long),
medians AS (
  SELECT component, grain, region_id, lead_day, quantile_cont(v, 0.5) AS median, count(*) AS sample_count
  FROM spread GROUP BY ALL),
grains AS (
  SELECT component, grain, region_id, lead_day, any_value(median) AS median,
         quantile_cont(abs(v - median), 0.5) AS mad, any_value(sample_count) AS sample_count
  FROM spread JOIN medians USING (component, grain, region_id, lead_day)
  GROUP BY component, grain, region_id, lead_day)
"""
)

STATS = (
    GRAINS
    + """,
wanted AS (SELECT DISTINCT region_id, lead_day, c.component
           FROM errors, (VALUES ('precip'), ('mslp'), ('wind'), ('temperature')) c(component)),
stats AS (
  SELECT w.component, w.region_id, w.lead_day,
         CASE WHEN a.sample_count >= 400 THEN a.median WHEN b.sample_count >= 400 THEN b.median ELSE g.median END AS median,
         CASE WHEN a.sample_count >= 400 THEN a.mad WHEN b.sample_count >= 400 THEN b.mad ELSE g.mad END AS mad,
         CASE WHEN a.sample_count >= 400 THEN a.sample_count WHEN b.sample_count >= 400 THEN b.sample_count
              ELSE g.sample_count END AS sample_count,
         CASE WHEN a.sample_count >= 400 THEN 'region_lead' WHEN b.sample_count >= 400 THEN 'lead'
              ELSE 'global' END AS fallback_level
  FROM wanted w
  LEFT JOIN grains a ON a.grain = 'region_lead' AND a.component = w.component
       AND a.region_id = w.region_id AND a.lead_day = w.lead_day
  LEFT JOIN grains b ON b.grain = 'lead' AND b.component = w.component AND b.lead_day = w.lead_day
  LEFT JOIN grains g ON g.grain = 'global' AND g.component = w.component)
"""
)

SCORES = (
    STATS
    + """,
wide AS (
  SELECT region_id, lead_day,
         max(CASE WHEN component = 'precip' THEN median END) AS m1, max(CASE WHEN component = 'precip' THEN mad END) AS d1,
         max(CASE WHEN component = 'mslp' THEN median END) AS m2, max(CASE WHEN component = 'mslp' THEN mad END) AS d2,
         max(CASE WHEN component = 'wind' THEN median END) AS m3, max(CASE WHEN component = 'wind' THEN mad END) AS d3,
         max(CASE WHEN component = 'temperature' THEN median END) AS m4,
         max(CASE WHEN component = 'temperature' THEN mad END) AS d4
  FROM stats GROUP BY ALL),
z AS (
  SELECT errors.*,
         greatest(least((e1 - m1) / (1.4826 * d1 + 1e-6), 8.0), -8.0) AS z_precip,
         greatest(least((e2 - m2) / (1.4826 * d2 + 1e-6), 8.0), -8.0) AS z_mslp,
         greatest(least((e3 - m3) / (1.4826 * d3 + 1e-6), 8.0), -8.0) AS z_wind,
         greatest(least((e4 - m4) / (1.4826 * d4 + 1e-6), 8.0), -8.0) AS z_temperature
  FROM errors JOIN wide USING (region_id, lead_day)),
scores AS (
  SELECT *, z_precip * 0.4::DOUBLE + z_mslp * 0.2::DOUBLE + z_wind * 0.2::DOUBLE + z_temperature * 0.2::DOUBLE AS severity
  FROM z)
"""
)

LABELLED = (
    SCORES
    + """,
thresholds AS (
  SELECT region_id, lead_day, quantile_cont(severity, 0.85) AS threshold, count(*) AS sample_count
  FROM scores WHERE yr BETWEEN 1995 AND 1998 GROUP BY ALL),
labelled AS (
  SELECT scores.*, threshold, CAST(severity > threshold AS INTEGER) AS bust
  FROM scores JOIN thresholds USING (region_id, lead_day))
"""
)


@query(
    f"WITH {GRAINS} SELECT component, grain, region_id, lead_day, sample_count, "
    "round(median, 6) AS median, round(mad, 6) AS mad FROM grains"
)
def median_and_mad(spark: SparkSession, d: str) -> DataFrame:
    """Median and MAD of each error component at three grains (A-02)."""
    found = labels.median_and_mad(B.errors(spark, d).filter(B.is_train()))
    return found.select("component", "grain", "region_id", "lead_day", "sample_count", rounded("median"), rounded("mad"))


@query(
    f"WITH {STATS} SELECT component, region_id, lead_day, sample_count, fallback_level, "
    "round(median, 6) AS median, round(mad, 6) AS mad FROM stats"
)
def robust_fit(spark: SparkSession, d: str) -> DataFrame:
    """Robust statistics with the three-level fallback (L-01, J-04)."""
    fit = B.label_fit(spark, d).stats
    return fit.select(
        "component", "region_id", "lead_day", "sample_count", "fallback_level", rounded("median"), rounded("mad")
    )


@query(
    f"WITH {SCORES} SELECT l_orderkey, region_id, lead_day, round(z_precip, 6) + 0.0 AS z_precip, "
    "round(z_mslp, 6) + 0.0 AS z_mslp, round(z_wind, 6) + 0.0 AS z_wind, "
    "round(z_temperature, 6) + 0.0 AS z_temperature, round(severity, 6) + 0.0 AS severity FROM scores"
)
def robust_scores(spark: SparkSession, d: str) -> DataFrame:
    """Clipped robust scores and severity per row (L-02, L-03)."""
    scored = labels.standardize(B.errors(spark, d), B.label_fit(spark, d).stats)
    values = [f"z_{name}" for name in C.COMPONENT_COLUMNS] + ["severity"]
    return scored.select("l_orderkey", "region_id", "lead_day", *[rounded(v) for v in values])


@query(f"WITH {LABELLED} SELECT region_id, lead_day, sample_count, round(threshold, 6) AS threshold FROM thresholds")
def severity_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Training-only 85 % quantile of severity per group (A-03, L-04)."""
    return B.label_fit(spark, d).thresholds.select("region_id", "lead_day", "sample_count", rounded("threshold"))


@query(f"WITH {LABELLED} SELECT l_orderkey, region_id, lead_day, yr, bust FROM labelled")
def bust_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label of every row: severity strictly above its group's threshold (L-05, L-07, J-05)."""
    return B.labelled(spark, d).select("l_orderkey", "region_id", "lead_day", "yr", F.col("bust").cast("int").alias("bust"))


PREVALENCE = f"WITH {LABELLED} SELECT yr AS year, count(*) AS rows, round(avg(bust), 6) AS bust_prevalence FROM labelled GROUP BY yr"


@query(PREVALENCE)
def prevalence_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Rows and label rate per year (A-06), from a fit on the training years."""
    table = labels.prevalence(B.labelled(spark, d), F.col("yr"))
    return table.select("year", "rows", rounded("bust_prevalence"))


@query(
    f"""WITH {LABELLED}, rates AS (
      SELECT region_id, lead_day, avg(bust) AS rate FROM labelled WHERE yr BETWEEN 1995 AND 1998 GROUP BY ALL)
    SELECT yr, region_id, lead_day, count(*) AS rows,
           round(coalesce(max(rate), (SELECT avg(bust) FROM labelled WHERE yr BETWEEN 1995 AND 1998)), 6) AS climatology
    FROM labelled LEFT JOIN rates USING (region_id, lead_day) WHERE yr > 1998 GROUP BY yr, region_id, lead_day"""
)
def climatology_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Training label rate per group as a probability for later years (A-05, M-06, J-06)."""
    rows = B.labelled(spark, d)
    later = metrics.climatology(rows.filter(B.is_train()), rows.filter(F.col("yr") > 1998), out="climatology")
    return later.groupBy("yr", "region_id", "lead_day").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.max("climatology"), 6).alias("climatology")
    )


@query(
    f"""WITH {ERRORS}, split AS (
      SELECT *, CASE WHEN yr BETWEEN 1995 AND 1998 THEN 'train' WHEN yr = 1999 THEN 'validation' ELSE 'test' END AS split
      FROM errors WHERE yr BETWEEN 1995 AND 2001)
    SELECT split, count(*) AS rows, count(DISTINCT init) AS cycles, strftime(min(init), '%Y-%m-%d %H:%M:%S') AS first_init
    FROM split GROUP BY split"""
)
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows and cycles of the year-based split (F-11, F-12, J-14)."""
    rows = with_split(B.errors(spark, d), F.col("yr"), B.TRAIN, B.VALIDATION, B.TEST_YEARS)
    per_cycle = rows.groupBy("split", "forecast_initialization_time").agg(F.count(F.lit(1)).alias("n"))
    return per_cycle.groupBy("split").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("cycles"),
        F.date_format(F.min("forecast_initialization_time"), "yyyy-MM-dd HH:mm:ss").alias("first_init"),
    )


@query(
    """WITH marked AS (
      SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m') AS month,
             CASE WHEN l_linenumber <= 4 THEN 'train' WHEN l_linenumber = 5 THEN 'validation' ELSE 'test' END AS split
      FROM lineitem)
    SELECT 'shared cycle ' || month AS violation FROM marked GROUP BY month HAVING count(DISTINCT split) > 1"""
)
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Cycles found in several splits when lines are split by number instead of time (F-11 check)."""
    line = B.table(spark, d, "lineitem")
    number = F.col("l_linenumber")
    split = F.when(number <= 4, "train").when(number == 5, "validation").otherwise("test")
    rows = line.select(F.date_format("l_shipdate", "yyyy-MM").alias("cycle"), split.alias("split"))
    return split_violations(rows, "cycle")


