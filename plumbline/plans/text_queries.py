"""Narrative checks and summaries over statements and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import narrative, quality
from plumbline.plans import bindings as B
from plumbline.plans.registry import query

ANSWERS = """
answers AS (
  SELECT 'o' || o_orderkey AS answer_id,
         'The bust probability is ' || (o_orderkey % 101) || '% and the reliability 0.' || lpad(CAST(o_orderkey * 3 % 1000 AS VARCHAR), 3, '0')
         || ' today.' || CASE WHEN o_orderkey % 7 = 0 THEN ' A Cyclone will form.' ELSE '' END AS answer,
         (o_orderkey % 101) / 100.0::DOUBLE AS p FROM orders
  UNION ALL SELECT 'd' || doc_id, text, (doc_id % 1000) / 1000.0::DOUBLE FROM documents)
"""


@query(
    rf"""WITH {ANSWERS}, found AS (
      SELECT answer_id, answer, p,
             regexp_extract_all(replace(answer, '%', '% '), '(?:^|[^\p{{L}}\p{{N}}_.])(\d{{1,3}}(?:\.\d+)?)\s*%', 1) AS percents,
             regexp_extract_all(answer, '(?i)(?:probability|reliability|risk)\D{{0,24}}(0(?:\.\d+)?|1(?:\.0+)?)(?:$|[^\p{{L}}\p{{N}}_])', 1) AS decimals
      FROM answers),
    bad AS (
      SELECT answer_id FROM (SELECT answer_id, p, unnest(percents)::DOUBLE AS v FROM found)
      WHERE least(abs(v - round(p * 100, 1)), abs(v - round((1 - p) * 100, 1))) > 0.05
      UNION SELECT answer_id FROM (SELECT answer_id, p, unnest(decimals)::DOUBLE AS v FROM found)
      WHERE least(abs(v - p), abs(v - (1 - p))) > 0.0005)
    SELECT answer_id, answer_id NOT IN (SELECT answer_id FROM bad) AS grounded FROM answers"""
)
def grounded_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Whether every number claimed in a text matches its probability (N-02, X-06, X-20)."""
    rows = B.answers(spark, d)
    return rows.select("answer_id", narrative.numbers_are_grounded(F.col("answer"), F.col("p")).alias("grounded"))


@query(
    rf"""WITH {ANSWERS} SELECT answer_id, regexp_matches(answer, '(?i)(^|[^\p{{L}}\p{{N}}_])(cyclone|hurricane|typhoon|flood|heatwave|tornado|landfall|storm surge|caused?|causes|will cause|will lead to|proves?)($|[^\p{{L}}\p{{N}}_])') AS unsupported
    FROM answers"""
)
def unsupported_claims(spark: SparkSession, d: str) -> DataFrame:
    """Texts making a claim that evidence can never support (N-03, X-07)."""
    return B.answers(spark, d).select("answer_id", narrative.has_unsupported_claim(F.col("answer")).alias("unsupported"))


@query(
    r"""WITH keyed AS (SELECT sha256(trim(regexp_replace(lower(replace(lower(text), 'ß', 'ss')), '[\s\p{Z}]+', ' ', 'g'))) AS question_hash, conv_id, turn
      FROM conversations)
    SELECT question_hash, count(*) AS askings, CAST(min(conv_id * 1000 + turn) AS BIGINT) AS first_asked FROM keyed GROUP BY ALL"""
)
def question_keys(spark: SparkSession, d: str) -> DataFrame:
    """Distinct normalized questions with their first occurrence (N-05, X-08, X-26)."""
    rows = B.table(spark, d, "conversations").select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("first_asked"))
    return narrative.first_per_question(rows, "text", ["first_asked", "text"]).select("question_hash", "askings", "first_asked")


@query(
    """WITH s AS (SELECT c_custkey, count(o_orderkey) AS n, count(o_orderkey) FILTER (WHERE o_totalprice > 400000) AS up,
                         count(o_orderkey) FILTER (WHERE o_totalprice < 20000) AS down FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_custkey, 'bust_probability,forecast_reliability' || CASE WHEN up > 0 THEN ',top_positive_shap_drivers' ELSE '' END
           || CASE WHEN down > 0 THEN ',top_negative_shap_drivers' ELSE '' END || CASE WHEN n > 0 THEN ',historical_analog_summaries' ELSE '' END
           || CASE WHEN n > 9 THEN ',run_to_run_drift' ELSE '' END AS sources FROM s"""
)
def grounding_sources(spark: SparkSession, d: str) -> DataFrame:
    """Evidence fields that are present, in fixed order (N-06)."""
    customer, orders = B.table(spark, d, "customer"), B.table(spark, d, "orders")
    joined = customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left").groupBy("c_custkey")
    price = F.col("o_totalprice")
    counted = joined.agg(F.count("o_orderkey").alias("n"), F.count_if(price > 400000).alias("up"), F.count_if(price < 20000).alias("down"))
    present = {
        "top_positive_shap_drivers": F.col("up") > 0,
        "top_negative_shap_drivers": F.col("down") > 0,
        "historical_analog_summaries": F.col("n") > 0,
        "run_to_run_drift": F.col("n") > 9,
    }
    return counted.select("c_custkey", F.array_join(narrative.grounding_sources(present), ",").alias("sources"))


@query(
    """WITH parts AS (
      SELECT c_custkey, (c_custkey % 1000) / 1000.0::DOUBLE AS p,
             string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority) FILTER (WHERE v > 0 AND rp <= 3) AS up,
             string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority) FILTER (WHERE v < 0 AND rn <= 3) AS down
      FROM customer LEFT JOIN (
        SELECT o_custkey, o_orderpriority, v, row_number() OVER (PARTITION BY o_custkey, v > 0 ORDER BY o_orderpriority) AS rp,
               row_number() OVER (PARTITION BY o_custkey, v < 0 ORDER BY o_orderpriority) AS rn
        FROM (SELECT o_custkey, o_orderpriority, count(*) - 2 AS v FROM orders GROUP BY ALL)) ON o_custkey = c_custkey
      GROUP BY c_custkey)
    SELECT c_custkey, 'Chance of an unusually large error: ' || printf('%.1f', round(p * 100, 1)) || '% (reliability '
           || printf('%.1f', round((1 - p) * 100, 1)) || '%).'
           || coalesce(' Raised most by: ' || up || '.', '')
           || coalesce(' Lowered most by: ' || down || '.', '')
           || ' Contributions explain the model, not the weather.' AS summary
    FROM parts"""
)
def evidence_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic summary sentences, parts without evidence left out (N-01, X-27)."""
    orders = B.table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg((F.count(F.lit(1)) - 2).alias("v"))
    entry = F.struct(F.col("o_orderpriority").alias("display_name"), "v")
    # One entry per priority.
    listed = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    signed = lambda test: F.coalesce(F.filter("all", test), F.expr("filter(all, x -> false)"))
    rows = B.table(spark, d, "customer").join(listed, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.withColumns(
        {
            "bust_probability": (F.col("c_custkey") % 1000) / F.lit(1000.0),
            "top_positive_drivers": signed(lambda e: e["v"] > 0),
            "top_negative_drivers": signed(lambda e: e["v"] < 0),
        }
    )
    return rows.select("c_custkey", narrative.evidence_summary(with_analogs=False).alias("summary"))


@query(
    """SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 'blank' ELSE 'question' END AS violation FROM conversations
    WHERE NOT (length(trim(text)) > 0 AND length(text) <= 500)"""
)
def question_checks(spark: SparkSession, d: str) -> DataFrame:
    """Questions that are blank or longer than allowed (Q-11)."""
    rows = B.table(spark, d, "conversations")
    broken = quality.range_violations(rows, {"question": quality.text_check("text", 500)})
    kind = F.when(F.length(F.trim(F.col("text"))) == 0, "blank").otherwise("question")
    return broken.select("conv_id", "turn", kind.alias("violation"))


@query(
    """SELECT o_orderkey,
      'lead_day,' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'run_to_run_mslp_drift_pa,' END || 'precip24_mean_mm' AS approved,
      CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice / 100, 4) END AS drift,
      CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate - INTERVAL 365 DAYS, '%Y-%m-%d') || ':' || (o_orderkey % 4 = 0) ELSE '' END AS analogs,
      'distance,historical_bust,initialization_time,lead_day,valid_time' AS analog_fields,
      'display_name,feature_name,shap_value' AS driver_fields, 'feature_contract,forecast_source' AS provenance,
      'bust_probability,forecast_reliability' || CASE WHEN o_orderkey % 4 <> 0 THEN ',top_positive_shap_drivers' ELSE '' END
      || CASE WHEN o_orderkey % 5 <> 0 THEN ',top_negative_shap_drivers' ELSE '' END
      || CASE WHEN o_orderkey % 2 = 0 THEN ',historical_analog_summaries' ELSE '' END
      || CASE WHEN o_orderkey % 3 <> 0 THEN ',run_to_run_drift' ELSE '' END AS sources FROM orders"""
)
def quotable_context(spark: SparkSession, d: str) -> DataFrame:
    """The whole projection a narrative may use: approved values, drift, analogs, drivers, provenance, sources (N-04, N-06)."""
    k, price, start = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate")
    value = lambda name, column: F.struct(F.lit(name).alias("feature_name"), column.cast("double").alias("value"))
    driver = F.struct(
        F.lit("u10_mean_mps").alias("feature_name"), F.lit("Wind").alias("display_name"), (price / 10).alias("shap_value"), F.lit("raises").alias("interpretation")
    )
    analog = F.struct(
        (start - F.expr("INTERVAL 365 DAYS")).alias("initialization_time"), (start - F.expr("INTERVAL 360 DAYS")).alias("valid_time"),
        F.lit(5).alias("lead_day"), (price / 7).alias("distance"), (k % 4 == 0).cast("int").alias("bust"), price.alias("severity"),
    )
    some = lambda test, item: F.filter(F.array(item), lambda _: test)
    values = F.array(
        value("lead_day", k % 10 + 1), value("season_sin", price), value("run_to_run_mslp_drift_pa", price / 100), value("precip24_mean_mm", price / 9)
    )
    rows = B.table(spark, d, "orders").select(
        "o_orderkey",
        (price / 500000).alias("bust_probability"),
        F.filter(values, lambda v: (k % 3 != 0) | (v["feature_name"] != "run_to_run_mslp_drift_pa")).alias("feature_values"),
        some(k % 4 != 0, driver).alias("top_positive_drivers"),
        some(k % 5 != 0, driver).alias("top_negative_drivers"),
        some(k % 2 == 0, analog).alias("historical_analogs"),
        F.create_map(*[F.lit(t) for t in ("feature_contract", "f", "forecast_source", "s", "internal_path", "p")]).alias("provenance"),
        *[F.lit(0.0).alias(c) for c in ("raw_model_output", "base_value", "additive")],
    )
    context = narrative.narrative_context(rows)
    fields = lambda column: F.lit(",".join(sorted(context.schema[column].dataType.elementType.names)))
    told = F.transform("historical_analogs", lambda a: F.concat(F.date_format(a["initialization_time"], "yyyy-MM-dd"), F.lit(":"), a["historical_bust"].cast("string")))
    return context.select(
        "o_orderkey",
        F.array_join(F.transform("approved_feature_values", lambda v: v["feature_name"]), ",").alias("approved"),
        F.round("run_to_run_drift.value", 4).alias("drift"),
        F.array_join(told, ",").alias("analogs"),
        fields("historical_analogs").alias("analog_fields"),
        fields("top_positive_drivers").alias("driver_fields"),
        F.array_join(F.array_sort(F.map_keys("provenance")), ",").alias("provenance"),
        F.array_join(narrative.grounding_sources(narrative.evidence_presence()), ",").alias("sources"),
    )


@query()
def narrative_context(spark: SparkSession, d: str) -> DataFrame:
    """Explanations restricted to what a narrative may use, with its sources and summary (N-04)."""
    from plumbline.plans.risk_queries import explanations

    context = narrative.narrative_context(explanations(spark, d))
    sources = narrative.grounding_sources(narrative.evidence_presence())
    return context.select(
        "prediction_id", sources.alias("grounding_sources"), narrative.evidence_summary().alias("summary"), "provenance"
    )
