"""Analog, driver and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.ranks import with_neighbours
from plumbline.operators import evidence, model, neighbours
from plumbline.plans import bindings as B
from plumbline.plans.label_queries import LABELLED
from plumbline.plans.registry import day, query, rounded
from plumbline.session import written

_DIMS = range(64)
EVENTS = f"""
events_e AS (
  SELECT vec_id, label AS region_id, CAST(vec_id % 17 AS INTEGER) AS lead_day,
         {", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in _DIMS)} FROM embeddings),
fitted AS (
  SELECT {", ".join(f"avg(e{i}) AS m{i}, CASE WHEN stddev_pop(e{i}) = 0 THEN 1 ELSE stddev_pop(e{i}) END AS s{i}" for i in _DIMS)}
  FROM events_e),
scaled AS (SELECT vec_id, region_id, lead_day, e0, e1, {", ".join(f"(e{i} - m{i}) / s{i} AS x{i}" for i in _DIMS)} FROM events_e, fitted),
pairs AS (
  SELECT q.vec_id AS qid, c.vec_id AS cid, CASE WHEN q.lead_day = c.lead_day THEN 0 ELSE 1 END AS other_lead, c.lead_day AS c_lead,
         c.e0, c.e1, round(sqrt({" + ".join(f"pow(q.x{i} - c.x{i}, 2)" for i in _DIMS)}), 12) AS distance
  FROM scaled q JOIN scaled c ON q.region_id = c.region_id AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY other_lead, distance, cid, c_lead) AS rank FROM pairs)
"""

CONTRIBUTIONS = """
contributions AS (
  SELECT o_custkey, o_orderpriority AS feature_name, round(avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders), 6) AS shap_value
  FROM orders GROUP BY ALL)
"""
CATALOG = {
    "1-URGENT": ("Urgent", "order"),
    "2-HIGH": ("High", "order"),
    "3-MEDIUM": ("Medium", None),
    "4-NOT SPECIFIED": ("Unspecified", None),
    "5-LOW": ("Low", "order"),
}


def _analog_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every vector is a query and every vector is a candidate of the others."""
    rows = B.embeddings(spark, d)
    stats = written(neighbours.scaler_stats(rows, B.DIMENSIONS), "scaler")
    points = rows.select("vec_id", "region_id", "lead_day", neighbours.scaled_vector(stats, B.DIMENSIONS))
    queries = points.select("region_id", "lead_day", "x", F.col("vec_id").alias("qid"), F.col("vec_id").alias("q_init"), F.col("lead_day").alias("q_lead"))
    pool = points.select("region_id", "lead_day", "x", F.col("vec_id").alias("cid"), F.col("vec_id").alias("c_init"), F.col("lead_day").alias("c_lead"))
    return queries, pool


@query(
    f"""WITH {EVENTS}, long AS (UNPIVOT (SELECT {", ".join(f"m{i} AS e{i}" for i in _DIMS)} FROM fitted) ON COLUMNS(*) INTO NAME feature VALUE mean),
    scales AS (UNPIVOT (SELECT {", ".join(f"s{i} AS e{i}" for i in _DIMS)} FROM fitted) ON COLUMNS(*) INTO NAME feature VALUE scale)
    SELECT feature, round(mean, 9) + 0.0 AS mean, round(scale, 9) AS scale, (SELECT count(*) FROM embeddings) AS fit_rows
    FROM long JOIN scales USING (feature)"""
)
def analog_scaler(spark: SparkSession, d: str) -> DataFrame:
    """Population mean and scale of every dimension (A-11, E-06)."""
    found = evidence.analog_scaler(B.embeddings(spark, d), B.DIMENSIONS)
    return found.select("feature", rounded("mean", 9), rounded("scale", 9), "fit_rows")


@query(
    f"""WITH {EVENTS} SELECT qid, cid, CAST(rank AS INTEGER) AS rank, other_lead, round(distance, 6) AS distance
    FROM ranked WHERE rank <= 3"""
)
def nearest_analogs(spark: SparkSession, d: str) -> DataFrame:
    """Three nearest analogs of every vector, same lead first (E-04, E-05, W-02, J-13)."""
    found = neighbours.analogs(*_analog_inputs(spark, d))
    return found.select("qid", "cid", "rank", "other_lead", rounded("distance"))


@query(
    f"""WITH {EVENTS} SELECT qid, string_agg(cid || '@' || c_lead || ' ' || printf('%.5f', round(e0, 5)) || ' ' || printf('%.5f', round(e1, 5)), '; ' ORDER BY rank) AS events
    FROM ranked WHERE rank <= 3 GROUP BY qid"""
)
def analog_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Ordered analog list per query with a feature summary map (E-07, X-24)."""
    found = neighbours.analogs(*_analog_inputs(spark, d)).select("qid", "cid", "rank")
    facts = B.embeddings(spark, d).select(F.col("vec_id").alias("cid"), "lead_day", evidence.value_map(["e0", "e1"]).alias("summary"))
    listed = found.join(facts, "cid").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "cid", "lead_day", F.col("summary")["e0"].alias("e0"), F.col("summary")["e1"].alias("e1")))).alias("events"))
    number = lambda v: F.format_string("%.5f", F.round(v, 5))
    text = F.transform(
        "events", lambda e: F.concat(e["cid"].cast("string"), F.lit("@"), e["lead_day"].cast("string"), F.lit(" "), number(e["e0"]), F.lit(" "), number(e["e1"]))
    )
    return listed.select("qid", F.array_join(text, "; ").alias("events"))


def _contributions(spark: SparkSession, d: str) -> DataFrame:
    """Per customer: deviation of its mean order value by priority from the overall mean, as driver arrays."""
    orders = B.table(spark, d, "orders")
    overall = orders.agg(F.avg("o_totalprice")).scalar()
    each = orders.groupBy("o_custkey", F.col("o_orderpriority").alias("feature_name")).agg(F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n"))
    signed = each.withColumn("shap_value", F.round(F.col("m") - overall, 6))
    pair = F.struct("feature_name", "shap_value")
    # One entry per priority.
    listed = signed.groupBy("o_custkey").agg(F.array_sort(F.collect_list(pair)).alias("contributions"), F.map_from_entries(F.collect_list(F.struct("feature_name", "n"))).alias("values"))
    return listed.withColumn("drivers", evidence.describe_drivers("contributions", F.col("values"), CATALOG))


@query(
    f"""WITH {CONTRIBUTIONS}, counts AS (SELECT o_custkey, o_orderpriority AS feature_name, count(*) AS value FROM orders GROUP BY ALL)
    SELECT o_custkey, feature_name, CASE feature_name WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
             WHEN '4-NOT SPECIFIED' THEN 'Unspecified' ELSE 'Low' END AS display_name,
           CASE WHEN feature_name IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'order' END AS unit, value,
           CASE WHEN shap_value >= 0 THEN 'increased' ELSE 'decreased' END AS direction,
           'Model risk ' || CASE WHEN shap_value >= 0 THEN 'increased' ELSE 'decreased' END || ' by this feature.' AS interpretation,
           round(shap_value, 2) AS shap_value
    FROM contributions JOIN counts USING (o_custkey, feature_name)"""
)
def driver_table(spark: SparkSession, d: str) -> DataFrame:
    """Drivers in long form with name, unit, value, direction and sentence (E-02)."""
    long = _contributions(spark, d).select("o_custkey", F.inline("drivers"))
    return long.withColumn("shap_value", F.round("shap_value", 2))


@query(
    f"""WITH {CONTRIBUTIONS}, r AS (
      SELECT *, row_number() OVER (PARTITION BY o_custkey, shap_value > 0 ORDER BY abs(shap_value) DESC, feature_name) AS r FROM contributions WHERE shap_value <> 0)
    SELECT o_custkey, coalesce(string_agg(feature_name, ',' ORDER BY r) FILTER (WHERE shap_value > 0 AND r <= 5), '') AS positive,
           coalesce(string_agg(feature_name, ',' ORDER BY r) FILTER (WHERE shap_value < 0 AND r <= 5), '') AS negative
    FROM r GROUP BY o_custkey"""
)
def top_drivers(spark: SparkSession, d: str) -> DataFrame:
    """Strongest drivers of each sign, ties by name (E-03, W-01)."""
    rows = _contributions(spark, d)
    names = lambda positive: F.array_join(
        F.transform(evidence.top_drivers("drivers", positive), lambda e: e["feature_name"]), ","
    )
    return rows.select("o_custkey", names(True).alias("positive"), names(False).alias("negative"))


@query(
    """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem WHERE year(l_shipdate) <= 1998)
    SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INTEGER) AS a, CAST(l_returnflag = 'N' AS INTEGER) AS n, CAST(l_returnflag = 'R' AS INTEGER) AS r,
           round((l_quantity - mq) / sq, 6) + 0.0 AS quantity, round((l_tax - mt) / st, 6) + 0.0 AS tax FROM lineitem, s"""
)
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """One-hot category and population-scaled numerics, fitted on training rows (M-01)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = B.table(spark, d, "lineitem").withColumn("region_id", F.col("l_returnflag"))
    stages = model.feature_stages(rows.filter(F.year("l_shipdate") <= 1998), ["l_quantity", "l_tax"])
    fitted = Pipeline(stages=stages).fit(rows).transform(rows)
    x = vector_to_array("features")
    hot = lambda i: x[i].cast("int")
    return fitted.select(
        "l_orderkey", "l_linenumber", hot(0).alias("a"), hot(1).alias("n"), hot(2).alias("r"), rounded(x[3], 6, "quantity"), rounded(x[4], 6, "tax")
    )


# Small trees keep the registered query short; the full candidate list is the default of the job.
_SEARCH = [
    {"maxDepth": 3, "stepSize": 0.1, "maxIter": 5, "minInstancesPerNode": 5, "subsamplingRate": 0.8},
    {"maxDepth": 4, "stepSize": 0.1, "maxIter": 5, "minInstancesPerNode": 10, "subsamplingRate": 0.8},
]


def risk_model(spark: SparkSession, d: str) -> tuple[model.RiskModel, DataFrame]:
    """Model and its rows."""
    rows = written(B.model_rows(spark, d), "model-rows")
    part = lambda name: rows.filter(F.col("split") == name)
    return model.fit_risk_model(part("train"), part("validation"), B.MODEL_FEATURES, candidates=_SEARCH), rows


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    fitted, rows = risk_model(spark, d)
    train, held = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") != "train")
    return model.held_out_predictions(fitted, train, held, ["region_id", "lead_day", "forecast_initialization_time", "valid_time"])


@query()
def held_out_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Raw, calibrated, climatology and baseline probabilities of held-out years (M-02 to M-05, M-14)."""
    return _predictions(spark, d)


@query()
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the model and both baselines per held-out split (M-15, V-06)."""
    return model.evaluation_report(written(_predictions(spark, d), "predictions"))


@query()
def candidate_search(spark: SparkSession, d: str) -> DataFrame:
    """Validation average precision of each candidate (M-03)."""
    fitted, _ = risk_model(spark, d)
    rows = [(i, str(sorted(s["parameters"].items())), s["validation_pr_auc"]) for i, s in enumerate(fitted.search)]
    return spark.createDataFrame(rows, "candidate int, parameters string, validation_pr_auc double")


@query()
def tree_attributions(spark: SparkSession, d: str) -> DataFrame:
    """Additive attribution of every held-out prediction (E-01)."""
    fitted, rows = risk_model(spark, d)
    scored = written(fitted.score(rows.filter(F.col("split") != "train")), "scored")
    return evidence.tree_attributions(fitted, scored, ["region_id", "lead_day", "forecast_initialization_time"])


@query()
def explanations(spark: SparkSession, d: str) -> DataFrame:
    """Full evidence record of every held-out prediction (E-09, V-04)."""
    fitted, rows = risk_model(spark, d)
    train, held = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") != "train")
    catalog = {name: (name.replace("_", " ").title(), None) for name in ["region_id", *B.MODEL_FEATURES]}
    return evidence.explanations(fitted, held, train, {"feature_contract": "order-lines"}, "tree-risk-v1", B.MODEL_FEATURES, catalog, B.MODEL_FEATURES[:4])


_HELD = f"""{LABELLED},
held AS (
  SELECT DISTINCT region_id, lead_day, init, CASE WHEN yr = 1999 THEN 'validation' ELSE 'test' END AS split
  FROM labelled WHERE yr IN (1999, 2000, 2001))"""


@query(f"WITH {_HELD} SELECT split, count(*) AS rows, count(*) AS keys, 0::BIGINT AS out_of_range, 0::BIGINT AS out_of_order FROM held GROUP BY split")
def prediction_checks(spark: SparkSession, d: str) -> DataFrame:
    """Held-out predictions: one row per key, probabilities in range, calibration that keeps the order (M-02, M-04, M-05, M-14, T-01)."""
    table = written(_predictions(spark, d), "predictions")
    names = ["raw_probability", "bust_probability", "climatology_probability", "logistic_baseline_probability"]
    outside = ~F.forall(F.array(*names), lambda p: p.isNotNull() & (p >= 0) & (p <= 1))
    # One row per distinct raw probability: a calibration that rises gives the same order.
    curve = table.groupBy("split", F.round("raw_probability", 9).alias("raw")).agg(F.min("bust_probability").alias("low"), F.max("bust_probability").alias("high"))
    turns = with_neighbours(curve.withColumn("place", F.concat("split", F.format_string("%012.9f", "raw"))), "place", "high", "before", "after")
    falls = (F.col("before") > F.col("low") + 1e-6) & F.col("same")
    same = with_neighbours(turns.withColumn("of", F.col("split")), "place", "of", "split_before", "split_after").withColumn("same", F.col("split_before") == F.col("split"))
    wrong = same.groupBy("split").agg(F.count_if(F.coalesce(falls, F.lit(False))).alias("out_of_order"))
    keys = F.count_distinct("region_id", "lead_day", "forecast_initialization_time").alias("keys")
    return table.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), keys, F.count_if(outside).alias("out_of_range")).join(wrong, "split")


@query(f"WITH {_HELD} SELECT count(*) AS rows, count(*) AS additive, count(*) AS named FROM held")
def explanation_checks(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of every held-out prediction: attributions add up to the margin, ids are those of their rows (E-01, E-09)."""
    found = explanations(spark, d)
    stamp = F.date_format("source_forecast_time", "yyyyMMdd'T'HHmmss'Z'")
    name = F.concat_ws("__", F.lit("tree-risk-v1"), stamp, "region_id", F.concat(F.lit("d"), F.lpad(F.col("lead_day").cast("string"), 2, "0")))
    return found.agg(F.count(F.lit(1)).alias("rows"), F.count_if("additive").alias("additive"), F.count_if(F.col("prediction_id") == name).alias("named"))


_ALL_PAIRS = EVENTS.replace("ON q.region_id = c.region_id AND q.vec_id <> c.vec_id", "ON q.vec_id <> c.vec_id")


@query(
    f"""WITH {_ALL_PAIRS}, near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, cid, c_lead) AS place FROM pairs)
    SELECT qid, cid, round(distance, 9) AS distance FROM near WHERE place <= 3"""
)
def analogs_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Three nearest vectors of every vector among all others: one group of many blocks (E-04, E-05)."""
    queries, pool = _analog_inputs(spark, d)
    one = F.lit(0).alias("all")
    found = neighbours.nearest(queries.select("*", one), pool.select("*", one), ["all"], 3, block_rows=16)
    return found.select("qid", "cid", rounded("distance", 9))


@query(
    """SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS init_time FROM lineitem WHERE year(l_shipdate) <= 1998"""
)
def training_pool(spark: SparkSession, d: str) -> DataFrame:
    """Starts available to the analog search: training years only (F-12)."""
    rows = B.errors(spark, d).filter(B.is_train())
    return rows.select("forecast_initialization_time").distinct().select(day("forecast_initialization_time", "init_time"))
