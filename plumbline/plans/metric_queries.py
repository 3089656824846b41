"""Probability-metric queries on labelled order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.ranks import grouped_quantile
from plumbline.operators import metrics, model, views
from plumbline.operators.coordinates import with_split
from plumbline.operators.model import replay_differences
from plumbline.plans import bindings as B
from plumbline.plans.label_queries import LABELLED
from plumbline.plans.registry import query, rounded

SCORED = (
    LABELLED
    + """,
scored AS (
  SELECT *, 1 / (1 + exp(-(0.08::DOUBLE * l_quantity - 3))) AS p, lead_day / 20.0::DOUBLE AS c FROM labelled)
"""
)


def _metric_sql(slice_column: str, tables: str = SCORED) -> str:
    """All metrics per slice, from textbook definitions over the rows."""
    s = slice_column
    return f"""WITH {tables},
    steps AS (SELECT {s} AS s, p, count(*) AS n, sum(bust) AS pos FROM scored GROUP BY ALL),
    curve AS (
      SELECT *, sum(n) OVER w AS n_all, sum(pos) OVER w AS pos_all,
             coalesce(sum(pos) OVER (PARTITION BY s ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above
      FROM steps WINDOW w AS (PARTITION BY s ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    areas AS (
      SELECT s, sum(pos * (pos_all / n_all)) / sum(pos) AS pr_auc,
             sum((n - pos) * (pos_above + pos / 2.0)) / (sum(pos) * sum(n - pos)) AS roc_auc
      FROM curve GROUP BY s),
    cut AS (SELECT {s} AS s, quantile_cont(p, 0.8) AS t FROM scored GROUP BY ALL),
    top AS (
      SELECT cut.s, max(t) AS t, sum(CASE WHEN p >= t THEN bust ELSE 0 END) / sum(bust) AS recall
      FROM scored JOIN cut ON cut.s = scored.{s} GROUP BY cut.s),
    bins AS (
      SELECT {s} AS s, least(9, (p >= 0.1)::INT + (p >= 0.2)::INT + (p >= 0.1::DOUBLE * 3)::INT + (p >= 0.4)::INT + (p >= 0.5)::INT
             + (p >= 0.1::DOUBLE * 6)::INT + (p >= 0.1::DOUBLE * 7)::INT + (p >= 0.8)::INT + (p >= 0.9)::INT) AS bin,
             count(*) AS n, avg(p) AS mp, avg(bust) AS my FROM scored GROUP BY ALL),
    ece AS (SELECT s, sum(n * abs(mp - my)) / sum(n) AS ece FROM bins GROUP BY s)
    SELECT scored.{s} AS {s}, count(*) AS rows, round(avg(bust), 6) AS prevalence,
           round(avg((p - bust) * (p - bust)), 6) AS brier_score,
           round(avg((c - bust) * (c - bust)), 6) AS brier_climatology,
           round(1 - avg((p - bust) * (p - bust)) / avg((c - bust) * (c - bust)), 6) AS brier_skill_score,
           round(max(pr_auc), 6) AS pr_auc, round(max(roc_auc), 6) AS roc_auc,
           round(max(ece), 6) AS expected_calibration_error,
           round(max(t), 6) AS top_20_percent_risk_threshold, round(max(recall), 6) AS top_20_percent_risk_recall
    FROM scored JOIN areas ON areas.s = scored.{s} JOIN top ON top.s = scored.{s} JOIN ece ON ece.s = scored.{s}
    GROUP BY scored.{s}"""


_SETS = SCORED.replace("scored AS (", "plain AS (") + """,
held AS (
  SELECT *, CASE WHEN yr = 1999 THEN 'validation' ELSE 'test' END AS split, l_quantity / 60 AS q FROM plain WHERE yr IN (1999, 2000, 2001)),
scored AS (
  SELECT split || '|model|overall|all' AS k, bust, p, c FROM held
  UNION ALL SELECT split || '|model|lead_day|' || lead_day, bust, p, c FROM held
  UNION ALL SELECT split || '|model|region_id|' || region_id, bust, p, c FROM held
  UNION ALL SELECT split || '|climatology_baseline|overall|all', bust, c, c FROM held
  UNION ALL SELECT split || '|logistic_regression_baseline|overall|all', bust, q, c FROM held)"""


def _rounded(report: DataFrame, slices: list[str]) -> DataFrame:
    values = [c for c in report.columns if c not in ("rows", *slices)]
    return report.select(*slices, "rows", *[rounded(v) for v in values])


@query(_metric_sql("one").replace("lead_day / 20.0::DOUBLE AS c FROM", "lead_day / 20.0::DOUBLE AS c, 1 AS one FROM"))
def probability_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All probability metrics over all rows (M-07 to M-12)."""
    return _rounded(metrics.evaluate(B.scored(spark, d)), []).withColumn("one", F.lit(1))


def _report(spark: SparkSession, d: str) -> DataFrame:
    rows = with_split(B.scored(spark, d), F.col("yr"), B.TRAIN, B.VALIDATION, B.TEST_YEARS).filter("split <> 'train'")
    stored = rows.select(
        "split", "bust", "lead_day", "region_id", F.col("p").alias("bust_probability"), F.col("c").alias("climatology_probability"),
        (F.col("l_quantity") / 60).alias("logistic_baseline_probability"),
    )
    return model.full_report(stored).withColumn("k", F.concat_ws("|", "split", "source", "slice", "value"))


@query(_metric_sql("k", _SETS))
def full_report(spark: SparkSession, d: str) -> DataFrame:
    """Model and baselines of both held-out splits, overall, by lead and by region, in one pass (M-15, B-04, M-13)."""
    return _rounded(_report(spark, d).drop("split", "source", "slice", "value", "bins"), ["k"])


@query(
    f"""SELECT 'tree-risk-v1' AS model_version, rows, prevalence, brier_score, brier_skill_score, pr_auc, roc_auc, expected_calibration_error
    FROM ({_metric_sql("k", _SETS)}) WHERE k = 'test|model|overall|all'"""
)
def model_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Held-out metrics of the served model with its version (V-06)."""
    overall = _report(spark, d).filter(F.col("slice") == "overall")
    found = views.model_metadata(overall, "test", model_version="tree-risk-v1")
    names = ["prevalence", "brier_score", "brier_skill_score", "pr_auc", "roc_auc", "expected_calibration_error"]
    return found.select("model_version", "rows", *[rounded(n) for n in names])


@query(_metric_sql("lead_day"))
def metrics_by_lead(spark: SparkSession, d: str) -> DataFrame:
    """The same metrics per lead (M-13, W-05)."""
    return _rounded(metrics.evaluate(B.scored(spark, d), ["lead_day"]), ["lead_day"])


@query(_metric_sql("region_id"))
def metrics_by_region(spark: SparkSession, d: str) -> DataFrame:
    """The same metrics per region (M-13)."""
    return _rounded(metrics.evaluate(B.scored(spark, d), ["region_id"]), ["region_id"])


@query(
    f"""WITH {SCORED},
    filled AS (
      SELECT (p >= 0.1)::INT + (p >= 0.2)::INT + (p >= 0.1::DOUBLE * 3)::INT + (p >= 0.4)::INT + (p >= 0.5)::INT
             + (p >= 0.1::DOUBLE * 6)::INT + (p >= 0.1::DOUBLE * 7)::INT + (p >= 0.8)::INT + (p >= 0.9)::INT AS bin,
             count(*) AS n, avg(p) AS mp, avg(bust) AS my FROM scored GROUP BY ALL)
    SELECT CAST(b.bin AS INTEGER) AS bin, round(b.bin * 0.1::DOUBLE, 6) AS lower, round((b.bin + 1) * 0.1::DOUBLE, 6) AS upper,
           coalesce(n, 0) AS count, round(mp, 6) AS mean_probability, round(my, 6) AS observed_frequency
    FROM range(10) b(bin) LEFT JOIN filled ON filled.bin = b.bin"""
)
def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    """Ten calibration bins, empty ones included (M-10, X-19)."""
    bins = metrics.calibration_bins(metrics.score_table(B.scored(spark, d), []), [])
    return bins.select(
        "bin", rounded("lower"), rounded("upper"), "count", rounded("mean_probability"), rounded("observed_frequency")
    )


@query(f"WITH {SCORED} SELECT round(quantile_cont(p, 0.8), 6) AS cut, count(*) AS sample_count FROM scored")
def top_risk_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Global 80 % quantile of the score (A-04, M-11)."""
    scores = metrics.score_table(B.scored(spark, d), [])
    return grouped_quantile(scores, [], "p", 0.8, "cut").select(rounded("cut"), "sample_count")


@query(
    """WITH scores AS (
      SELECT o_orderkey, 1 / (1 + exp(-(o_totalprice / 250000.0::DOUBLE - 1))) AS p FROM orders)
    SELECT o_orderkey, round(p, 6) AS bust_probability FROM scores
    WHERE abs(CASE WHEN o_orderkey % 3 = 0 THEN round(p, 4) ELSE p END - p) > 1e-9"""
)
def replay_check(spark: SparkSession, d: str) -> DataFrame:
    """Stored probabilities that a recomputation does not reproduce within tolerance (E-08)."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("o_totalprice") / F.lit(250000.0) - 1)))
    fresh = B.table(spark, d, "orders").select("o_orderkey", p.alias("raw_probability"), p.alias("bust_probability"))
    kept = F.when(F.col("o_orderkey") % 3 == 0, F.round("bust_probability", 4)).otherwise(F.col("bust_probability"))
    stored = fresh.withColumn("bust_probability", kept)
    changed = replay_differences(stored, fresh, ["o_orderkey"])
    return changed.select("o_orderkey", F.round(F.col("_bust_probability"), 6).alias("bust_probability"))
