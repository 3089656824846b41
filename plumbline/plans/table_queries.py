"""Queries on cycles, manifests, views, set operations and data contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import scalars
from plumbline.operators import coordinates, quality, views
from plumbline.plans import bindings as B
from plumbline.plans.registry import day, query, rounded
from plumbline.session import scratch_dir, written
from plumbline.sources import documents, manifests, tables

TIME = "forecast_initialization_time"

PREDICTIONS = """
predictions AS (
  SELECT o_orderkey, printf('imd-%02d', c_nationkey + 1) AS region_id, CAST(o_orderkey % 10 + 1 AS INTEGER) AS lead_day,
         o_orderdate AS init, o_orderdate + to_days(CAST(o_orderkey % 10 + 1 AS INTEGER)) AS valid_time,
         o_totalprice / 500000.0::DOUBLE AS p, c_mktsegment AS region_name
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""

RISKS = (
    PREDICTIONS
    + """,
risks AS (
  SELECT date_trunc('month', init) AS init, lead_day, region_id, round(avg(p), 12) AS p
  FROM predictions GROUP BY ALL)
"""
)


#: Every month, lead and nation; a pair without orders has its nation's mean. One nation misses some months.
FULL_RISKS = (
    RISKS
    + """,
full_risks AS (
  SELECT m.init, CAST(l.lead_day AS INTEGER) AS lead_day, n.region_id, coalesce(r.p, n.p) AS p
  FROM (SELECT DISTINCT init FROM risks) m CROSS JOIN (SELECT unnest(range(1, 11)) AS lead_day) l
  CROSS JOIN (SELECT printf('imd-%02d', n_nationkey + 1) AS region_id,
                     round(coalesce(avg(p), (SELECT avg(p) FROM predictions)), 12) AS p
              FROM nation LEFT JOIN predictions ON region_id = printf('imd-%02d', n_nationkey + 1) GROUP BY n_nationkey) n
  LEFT JOIN risks r ON r.init = m.init AND r.lead_day = l.lead_day AND r.region_id = n.region_id
  WHERE NOT (n.region_id = 'imd-03' AND (l.lead_day + month(m.init)) % 7 = 0))
"""
)


def _scratch(spark: SparkSession, name: str, d: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{d.rstrip('/').rsplit('/', 1)[-1]}"


@query(
    """SELECT DISTINCT strftime(date_trunc('day', ts) + to_hours((hour(ts) // 12) * 12), '%Y-%m-%d %H:%M:%S') AS init_time
    FROM events WHERE year(ts) = 2024 AND month(ts) IN (1, 2)"""
)
def expected_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cycles of the wanted years and months (F-08)."""
    found = coordinates.expected_cycles(B.cycles(spark, d), [2024], [1, 2])
    return found.select(day("init_time"))


@query(
    """SELECT event_id FROM (SELECT event_id, 12 * (user_id % 30) AS lead_hours, ts FROM events)
    WHERE NOT (lead_hours IN (24, 48, 72, 96, 120, 144, 168, 192, 216, 240) AND year(ts) = 2024 AND day(ts) <= 31 AND month(ts) = 1)"""
)
def rejected_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests outside the allowed leads, years or months (F-09)."""
    lead = (F.lit(12) * (F.col("user_id") % 30)).alias("lead_hours")
    requests = B.table(spark, d, "events").select("event_id", lead, F.col("ts").alias("init_time"))
    return coordinates.bad_requests(requests, [2024], [1]).select("event_id")


@query(
    """WITH slots AS (
      SELECT date_trunc('day', ts) + to_hours((hour(ts) // 12) * 12) AS t, event_type FROM events),
    wanted AS (SELECT DISTINCT t FROM slots),
    present AS (SELECT t FROM slots WHERE event_type = 'error' GROUP BY t
                UNION SELECT t + INTERVAL 6 HOURS FROM slots WHERE event_type = 'purchase')
    SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS init_time, 'missing' AS problem FROM wanted WHERE t NOT IN (SELECT t FROM present)
    UNION ALL SELECT strftime(t, '%Y-%m-%d %H:%M:%S'), 'unexpected' FROM present WHERE t NOT IN (SELECT t FROM wanted)"""
)
def corpus_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Expected cycles without rows and rows nobody expects (Q-07, J-12, T-02)."""
    rows = B.cycles(spark, d)
    wanted = rows.select("init_time").distinct()
    stored = rows.filter(F.col("region_id") == "error").select("init_time")
    odd = rows.filter(F.col("region_id") == "purchase")
    shifted = odd.select(scalars.add_hours(F.col("init_time"), F.lit(6)).alias("init_time"))
    gaps = manifests.manifest_gaps(wanted, stored.unionByName(shifted).distinct(), "init_time")
    return gaps.select(day("init_time"), "problem")


@query(
    """WITH slots AS (
      SELECT date_trunc('day', ts) + to_hours((hour(ts) // 12) * 12) AS t, event_type FROM events),
    present AS (SELECT t, count(*) AS n FROM slots WHERE event_type = 'click' GROUP BY t)
    SELECT (SELECT count(DISTINCT t) FROM slots) AS expected_count, (SELECT count(*) FROM present) AS completed_count,
           (SELECT CAST(sum(n) AS BIGINT) FROM present) AS row_count,
           (SELECT count(DISTINCT t) FROM slots WHERE t NOT IN (SELECT t FROM present)) AS missing,
           0::BIGINT AS unexpected, 'incomplete' AS status"""
)
def corpus_status(spark: SparkSession, d: str) -> DataFrame:
    """One-row completeness of a corpus (Q-07, Q-08)."""
    rows = B.cycles(spark, d)
    stored = rows.filter(F.col("region_id") == "click").groupBy("init_time").agg(F.count(F.lit(1)).alias("rows"))
    status = manifests.corpus_summary(rows.select("init_time").distinct(), stored, "init_time", 360)
    return status.select("expected_count", "completed_count", "row_count", "missing", "unexpected", "status")


@query(
    f"""WITH {PREDICTIONS}, judged AS (
      SELECT date_trunc('month', init) AS cycle, count(*) AS rows, count(DISTINCT lead_day) AS leads,
             count(DISTINCT region_id) AS regions, count(DISTINCT year(init)) AS versions
      FROM predictions GROUP BY ALL)
    SELECT strftime(cycle, '%Y-%m-%d %H:%M:%S') AS cycle, rows, leads, regions, versions,
           rows = 186 AND leads = 10 AND regions = 25 AND versions = 1 AND year(cycle) = 1999 AS valid FROM judged"""
)
def cycle_validity(spark: SparkSession, d: str) -> DataFrame:
    """Every stored cycle judged in one aggregate (S-13, A-08, Q-06)."""
    rows = B.orders_as_predictions(spark, d)
    month = F.expr(f"make_timestamp_ntz(year({TIME}), month({TIME}), 1, 0, 0, 0)")
    stored = rows.withColumns({"cycle": month, "dataset_version": F.year(TIME).cast("string")})
    judged = quality.cycle_validity(stored, "1999", 186, regions=25, cycle="cycle")
    return judged.select(day("cycle"), "rows", "leads", "regions", "versions", "valid")


@query(
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS rows,
           strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_time,
           CAST(sum(CAST('0x' || substr(sha256(o_orderkey || '|' || o_orderstatus), 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint
    FROM orders GROUP BY ALL"""
)
def partition_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Rows, coverage and order-free content fingerprint per month (A-07, A-10, S-12)."""
    orders = B.table(spark, d, "orders")
    content = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")
    by = [F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")]
    found = manifests.partition_manifest(orders, by, content, "o_orderdate")
    return found.select("year", "month", "rows", day("first_time"), day("last_time"), "fingerprint")


#: Columns of the table files by name; ``*`` marks money and measures, ``@`` times.
_FILE_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal* c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal*",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice*",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice* o_orderdate@ o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity* l_extendedprice* l_discount* l_tax* l_returnflag l_linestatus l_shipdate@",
    "events": "event_id ts@ user_id event_type value* props",
    "documents": "doc_id text lang source n_chars",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def _canonical(name: str, sql: bool):
    """A column's text, the same in both engines; null is ``-``."""
    column, kind = name.rstrip("*@"), name[-1]
    if sql:
        text = {"*": f"CAST(round({column} * 10000) AS BIGINT)::VARCHAR", "@": f"strftime({column}, '%Y-%m-%d %H:%M:%S')"}
        return f"coalesce({text.get(kind, f'{column}::VARCHAR')}, '-')"
    text = {"*": F.round(F.col(column) * 10000).cast("bigint").cast("string"), "@": F.date_format(column, "yyyy-MM-dd HH:mm:ss")} if kind in "*@" else {}
    return F.coalesce(text.get(kind, F.col(column).cast("string")), F.lit("-")).alias(column)


def _digest_sql(name: str, columns: str) -> str:
    text = " || '|' || ".join(_canonical(c, True) for c in columns.split())
    return f"""SELECT '{name}' AS name, count(*) AS rows,
      CAST(coalesce(sum(CAST('0x' || substr(sha256({text}), 1, 8) AS BIGINT)), 0) AS BIGINT) AS fingerprint FROM {name}"""


@query(" UNION ALL ".join(_digest_sql(*entry) for entry in _FILE_COLUMNS.items()))
def file_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Rows and content fingerprint of every table, added up from the digests of its files, however large (S-11, Q-08, A-10)."""
    found = []
    for name, columns in _FILE_COLUMNS.items():
        source = B.table(spark, d, name)
        text = F.concat_ws("|", *[_canonical(c, False) for c in columns.split()])
        rows = manifests.table_parts(source, text)
        found.append(rows.agg(F.sum("rows").alias("rows"), F.sum("fingerprint").alias("fingerprint")).select(F.lit(name).alias("name"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("fingerprint", F.lit(0)).alias("fingerprint")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query(
    f"""WITH {PREDICTIONS} SELECT CAST(year(init) AS INTEGER) AS year, CAST(month(init) AS INTEGER) AS month, count(*) AS rows,
           round(sum(p), 4) AS total FROM predictions WHERE year(init) IN (1996, 1999) GROUP BY ALL"""
)
def stored_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Rows written by (year, month) and read back with pruned partitions (S-01, S-02, S-06, O-02)."""
    path = _scratch(spark, "stored-predictions", d)
    tables.write_labelled(B.orders_as_predictions(spark, d), path)
    back = tables.read_labelled(spark, path).filter(F.col("year").isin(1996, 1999))
    return back.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("bust_probability"), 4).alias("total")
    )


@query(
    f"""WITH {PREDICTIONS} SELECT split, count(*) AS rows, round(sum(p), 4) AS total FROM (
      SELECT *, CASE WHEN year(init) = 1999 THEN 'validation' ELSE 'test' END AS split FROM predictions WHERE year(init) >= 1999)
    GROUP BY split"""
)
def stored_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Held-out splits united, written as one table and read back (S-07, T-01)."""
    rows = B.orders_as_predictions(spark, d)
    part = lambda condition, name: rows.filter(condition).withColumn("split", F.lit(name))
    both = part(F.year(TIME) == 1999, "validation").unionByName(part(F.year(TIME) > 1999, "test"))
    path = _scratch(spark, "held-out", d)
    tables.write_predictions(both, path)
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("bust_probability"), 4).alias("total"))


@query(
    f"""WITH {PREDICTIONS} SELECT region_id, lead_day, count(*) AS rows, round(avg(p), 6) AS mean_probability
    FROM predictions WHERE p >= 0.25 AND region_name = 'BUILDING' GROUP BY ALL"""
)
def view_query(spark: SparkSession, d: str) -> DataFrame:
    """Ad-hoc SQL with named parameters over a registered view (S-03, S-04)."""
    tables.register_views(predictions=B.orders_as_predictions(spark, d))
    return tables.query(
        spark,
        "SELECT region_id, lead_day, count(*) AS rows, round(avg(bust_probability), 6) AS mean_probability "
        "FROM predictions WHERE bust_probability >= :floor AND region_name = :segment GROUP BY ALL",
        floor=0.25,
        segment="BUILDING",
    )


@query(
    """WITH boxes AS (
      SELECT s_nationkey AS region_id, count(*) AS n, CAST(min(s_suppkey) AS DOUBLE) AS w, CAST(max(s_suppkey) + 1 AS DOUBLE) AS e
      FROM supplier GROUP BY ALL)
    SELECT CAST(region_id AS INTEGER) AS region_id, printf('imd-%02d', region_id) AS id, 5 AS points, round(w, 6) AS west, round(e, 6) AS east
    FROM boxes"""
)
def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    """Regions as GeoJSON feature text and back (S-09, X-25)."""
    supplier = B.table(spark, d, "supplier")
    boxes = supplier.groupBy(F.col("s_nationkey").alias("n")).agg(
        F.min("s_suppkey").cast("double").alias("w"), (F.max("s_suppkey") + 1).cast("double").alias("e")
    )
    point = lambda x, y: F.array(F.col(x), F.lit(float(y)))
    ring = F.array(point("w", 6), point("e", 6), point("e", 7), point("w", 7), point("w", 6))
    name = scalars.canonical_region(F.col("n"))
    text = documents.geojson_feature(F.col("n"), name, name, F.array(ring))
    parsed = boxes.select(text.alias("text")).select(documents.parse_feature(F.col("text")).alias("f"))
    ring = F.get("f.geometry.coordinates", F.lit(0))
    xs = F.transform(ring, lambda p: p[0])
    return parsed.select(
        "f.properties.region_id", "f.id", F.size(ring).alias("points"),
        F.round(F.array_min(xs), 6).alias("west"), F.round(F.array_max(xs), 6).alias("east"),
    )


@query(
    f"""WITH {FULL_RISKS}, per AS (SELECT init, lead_day, count(*) AS n FROM full_risks GROUP BY ALL)
    SELECT 'run-' || strftime(init, '%Y%m%dT%H%M%SZ') AS run_id, string_agg(lead_day, ',' ORDER BY lead_day) AS lead_days,
           CAST(sum(n) AS BIGINT) AS records, CASE WHEN sum(n) = 250 THEN 'complete' ELSE 'partial' END AS data_status
    FROM per GROUP BY init"""
)
def runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs newest first with sorted distinct leads; complete are those with every lead of every nation (V-01, A-09, O-04)."""
    found = views.runs(B.full_risk_rows(spark, d), rows_per_cycle=250)
    return found.select("run_id", F.array_join("available_lead_days", ",").alias("lead_days"), "records", "data_status")


@query(
    f"""WITH {FULL_RISKS}, named AS (
      SELECT *, 'tree-risk-v1__' || strftime(init, '%Y%m%dT%H%M%SZ') || '__' || region_id || '__d' || printf('%02d', lead_day) AS prediction_id
      FROM full_risks)
    SELECT prediction_id, strftime(init, '%Y-%m-%d %H:%M:%S') AS init_time, lead_day, region_id, p AS bust_probability
    FROM named WHERE prediction_id = (SELECT max(prediction_id) FROM named)"""
)
def explanation_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The row of one prediction key, here the last one (V-04)."""
    named = views.with_identity(B.full_risk_rows(spark, d), "tree-risk-v1")
    last = named.agg(F.max("prediction_id")).first()[0]
    found = views.find_explanation(named, last or "")
    return found.select("prediction_id", day(TIME, "init_time"), "lead_day", "region_id", "bust_probability")


@query(
    f"""WITH {FULL_RISKS}, complete AS (SELECT init, lead_day FROM full_risks GROUP BY ALL HAVING count(*) = 25)
    SELECT 'run-' || strftime(init, '%Y%m%dT%H%M%SZ') AS run_id, lead_day, region_id, p AS bust_probability,
           round(1 - p, 12) AS forecast_reliability,
           'tree-risk-v1__' || strftime(init, '%Y%m%dT%H%M%SZ') || '__' || region_id || '__d' || printf('%02d', lead_day) AS prediction_id
    FROM full_risks JOIN complete USING (init, lead_day)"""
)
def risk_maps(spark: SparkSession, d: str) -> DataFrame:
    """Maps holding exactly the expected number of regions, all runs at once (V-02, J-07)."""
    complete = views.risk_maps(B.full_risk_rows(spark, d), regions=25)
    named = views.with_identity(complete, "tree-risk-v1")
    return named.select(
        "run_id", "lead_day", "region_id", "bust_probability", rounded("forecast_reliability", 12), "prediction_id"
    )


@query(
    f"""WITH {FULL_RISKS}, complete AS (SELECT init, region_id FROM full_risks GROUP BY ALL HAVING count(*) = 10)
    SELECT strftime(init, '%Y-%m-%d %H:%M:%S') AS init_time, region_id,
           string_agg(lead_day || ':' || CAST(round(p * 1e12) AS BIGINT), ' ' ORDER BY lead_day) AS points
    FROM full_risks JOIN complete USING (init, region_id) GROUP BY init, region_id"""
)
def lead_curves(spark: SparkSession, d: str) -> DataFrame:
    """Ordered points of (run, region) pairs with exactly the expected leads (V-03)."""
    curves = views.lead_curves(B.full_risk_rows(spark, d))
    text = F.transform(
        "points", lambda p: F.concat(p["lead_day"].cast("string"), F.lit(":"), F.round(p["bust_probability"] * 1e12).cast("bigint").cast("string"))
    )
    return curves.select(day(TIME, "init_time"), "region_id", F.array_join(text, " ").alias("points"))


@query(
    f"""WITH {RISKS} SELECT CASE WHEN n = 25 THEN 'complete' ELSE 'incomplete' END AS status, count(*) AS maps, CAST(sum(n) AS BIGINT) AS rows
    FROM (SELECT init, lead_day, count(*) AS n FROM risks GROUP BY ALL) GROUP BY 1"""
)
def map_status(spark: SparkSession, d: str) -> DataFrame:
    """Complete and incomplete maps (V-02 check, Q-06)."""
    status = views.group_status(B.risk_rows(spark, d), [TIME, "lead_day"], 25)
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("maps"), F.sum("rows").alias("rows"))


@query(
    f"""WITH {PREDICTIONS}, labelled AS (SELECT region_id, lead_day, init, valid_time, max(region_name) AS region_name, avg(p) AS mean_p
      FROM predictions GROUP BY ALL)
    SELECT o_orderkey, predictions.lead_day, predictions.region_id, labelled.region_name, round(mean_p, 6) AS mean_p
    FROM predictions JOIN labelled USING (region_id, lead_day, init, valid_time) WHERE predictions.lead_day = 4"""
)
def prediction_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with labelled columns on the four keys, for one lead of all runs (F-14, J-07, O-01)."""
    rows = B.orders_as_predictions(spark, d)
    keys = ["region_id", "lead_day", TIME, "valid_time"]
    facts = rows.groupBy(*keys).agg(F.max("region_name").alias("region_name"), F.avg("bust_probability").alias("mean_p"))
    found = views.prediction_rows(rows.drop("region_name"), facts, ["region_name", "mean_p"], lead_day=4)
    return found.select("o_orderkey", "lead_day", "region_id", "region_name", rounded("mean_p"))


@query(
    f"""WITH {PREDICTIONS} SELECT o_orderkey, 'run-' || strftime(init, '%Y%m%dT%H%M%SZ') AS run_id,
           strftime(init, '%Y-%m-%dT%H:%M:%S') || '.000000000' AS iso_time,
           CASE WHEN lead_day <> 10 THEN 'tree-risk-v1__' || strftime(init, '%Y%m%dT%H%M%SZ') || '__' || region_id || '__d'
                || printf('%02d', lead_day) END AS prediction_id
    FROM predictions"""
)
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Run and prediction ids; a lead outside 1..10 has none (V-07, R-09, X-02, X-09)."""
    rows = B.orders_as_predictions(spark, d)
    lead = F.when(F.col("lead_day") == 10, 11).otherwise(F.col("lead_day"))
    return rows.select(
        "o_orderkey",
        scalars.run_id(F.col(TIME)).alias("run_id"),
        scalars.iso_nanos(F.col(TIME)).alias("iso_time"),
        scalars.prediction_id(F.lit("tree-risk-v1"), F.col(TIME), F.col("region_id"), lead).alias("prediction_id"),
    )


@query(
    f"""WITH {PREDICTIONS}, ids AS (
      SELECT o_orderkey, init, region_id, lead_day, CASE o_orderkey % 4 WHEN 0 THEN 'tree_risk__' WHEN 1 THEN 'tree-risk-v1_' ELSE 'tree-risk-v1__' END AS head
      FROM predictions)
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 1 THEN 'tree-risk-v1' END AS model_version,
           CASE WHEN o_orderkey % 4 > 1 THEN strftime(init, '%Y-%m-%d %H:%M:%S') END AS source_time,
           CASE WHEN o_orderkey % 4 > 1 THEN region_id END AS region_id,
           CASE WHEN o_orderkey % 4 > 1 THEN CAST(lead_day AS VARCHAR) END AS lead_day,
           CASE WHEN o_orderkey % 3 > 0 THEN strftime(init, '%Y-%m-%d %H:%M:%S') END AS run_time
    FROM ids"""
)
def parsed_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Ids parsed strictly back to columns, malformed ones to null (V-08, X-05)."""
    rows = B.orders_as_predictions(spark, d)
    key = F.col("o_orderkey") % 4
    head = F.when(key == 0, "tree_risk__").when(key == 1, "tree-risk-v1_").otherwise("tree-risk-v1__")
    text = F.concat(
        head, F.date_format(TIME, "yyyyMMdd'T'HHmmss'Z'"), F.lit("__"), F.col("region_id"), F.format_string("__d%02d", "lead_day")
    )
    run = F.concat(scalars.run_id(F.col(TIME)), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(""))
    parsed = rows.select("o_orderkey", scalars.parse_prediction_id(text).alias("p"), scalars.parse_run_id(run).alias("run_time"))
    return parsed.select(
        "o_orderkey", "p.model_version", F.date_format("p.source_forecast_time", "yyyy-MM-dd HH:mm:ss").alias("source_time"),
        "p.region_id", F.col("p.lead_day").cast("string").alias("lead_day"), day("run_time"),
    )


@query(
    """SELECT CASE WHEN p >= 0.5 THEN 'elevated' ELSE 'lower' END AS risk_class,
           CAST((p >= 0.25)::INT + (p >= 0.5)::INT + (p >= 0.75)::INT AS INTEGER) AS band, count(*) AS rows
    FROM (SELECT o_totalprice / 500000.0::DOUBLE AS p FROM orders) GROUP BY ALL"""
)
def risk_bands(spark: SparkSession, d: str) -> DataFrame:
    """Risk class and quarter bands (V-09, X-22)."""
    p = B.table(spark, d, "orders").select((F.col("o_totalprice") / F.lit(500000.0)).alias("p"))
    classed = p.select(views.risk_class(F.col("p")).alias("risk_class"), views.risk_band(F.col("p")).alias("band"))
    return classed.groupBy("risk_class", "band").agg(F.count(F.lit(1)).alias("rows"))


@query(
    f"""WITH {RISKS} SELECT strftime(init, '%Y-%m-%d %H:%M:%S') AS init_time, lead_day, region_id, p AS bust_probability
    FROM (SELECT *, row_number() OVER (PARTITION BY init, lead_day ORDER BY p DESC, region_id) AS r FROM risks) WHERE r = 1"""
)
def highest_risk_region(spark: SparkSession, d: str) -> DataFrame:
    """Region of highest risk per run and lead (V-10)."""
    found = views.highest_risk_region(B.risk_rows(spark, d))
    return found.select(day(TIME, "init_time"), "lead_day", "region_id", "bust_probability")


@query(
    """SELECT printf('imd-%02d', n_nationkey + 1) AS region_id, n_name AS region_name, printf('imd-%02d', n_nationkey + 1) AS geometry_id,
           'geometry#' || printf('imd-%02d', n_nationkey + 1) AS geometry_reference FROM nation"""
)
def region_list(spark: SparkSession, d: str) -> DataFrame:
    """Region manifest with geometry references (V-05, S-08, J-15, O-03)."""
    nation = B.table(spark, d, "nation")
    rows = nation.select(scalars.canonical_region(F.col("n_nationkey") + 1).alias("region_id"), F.col("n_name").alias("region_name"))
    return views.region_list(rows, "geometry#")


@query(
    """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS source FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 60 DAYS"""
)
def late_sources(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose source time is after the start (Q-01)."""
    line, orders = B.table(spark, d, "lineitem"), B.table(spark, d, "orders")
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).withColumn("start", F.expr("o_orderdate + INTERVAL 60 DAYS"))
    return quality.late_sources(rows, "l_shipdate", "start").select("l_orderkey", "l_linenumber", day("l_shipdate", "source"))


@query(
    """WITH units AS (SELECT event_type AS variable, CASE WHEN sum(value) > 60000 OR event_type = 'click' THEN 'K' ELSE 'Pa' END AS units
      FROM events GROUP BY event_type),
    contract(variable, allowed) AS (VALUES ('click', 'Pa'), ('view', ''), ('wind', 'm'), ('error', 'Pa'))
    SELECT c.variable, units, CASE WHEN u.variable IS NULL THEN 'missing' ELSE 'units' END AS problem
    FROM contract c LEFT JOIN units u USING (variable) WHERE u.variable IS NULL OR (allowed <> '' AND units <> allowed)"""
)
def unit_violations(spark: SparkSession, d: str) -> DataFrame:
    """Required variables that are absent or in the wrong unit (Q-03)."""
    events = B.table(spark, d, "events").groupBy(F.col("event_type").alias("variable")).agg(F.sum("value").alias("s"))
    unit = F.when((F.col("s") > 60000) | (F.col("variable") == "click"), "K").otherwise("Pa")
    contract = {"click": ["Pa"], "view": [], "wind": ["m"], "error": ["Pa"]}
    return quality.unit_violations(events.select("variable", unit.alias("units")), contract)


@query(
    """SELECT 'ratio' AS "column", count(*) AS bad_rows FROM lineitem WHERE l_tax = 0
    UNION ALL SELECT 'gap', count(*) FROM lineitem WHERE l_discount = 0"""
)
def non_finite_counts(spark: SparkSession, d: str) -> DataFrame:
    """Null, NaN and infinite values per column in one aggregate (Q-04, X-17)."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    rows = B.table(spark, d, "lineitem").select(
        "l_quantity",
        F.when(F.col("l_tax") == 0, F.when(F.col("l_linenumber") > 3, nan).otherwise(inf)).otherwise(1.0).alias("ratio"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("gap"),
    )
    return quality.non_finite_counts(rows, ["l_quantity", "ratio", "gap"])


@query(
    """WITH slots AS (SELECT date_trunc('day', ts) + to_hours((hour(ts) // 12) * 12) AS t, user_id FROM events)
    SELECT 'short coverage' AS violation FROM slots HAVING min(t) > TIMESTAMP '2024-01-05' OR max(t) < TIMESTAMP '2024-12-31'
    UNION ALL SELECT 'empty months' FROM slots HAVING count(*) FILTER (month(t) IN (6, 7, 8, 9)) = 0
    UNION ALL SELECT 'empty domain' FROM slots HAVING count(*) FILTER (user_id % 3 + 3 BETWEEN 6 AND 38) = 0
    UNION ALL SELECT 'members in a mean source' FROM slots HAVING count(DISTINCT user_id % 7) > 0"""
)
def source_contract(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, months, domain and members of a source of means, from one aggregate (Q-05, B-07)."""
    latitude, longitude = (F.col("user_id") % 3 + 3).cast("double"), F.lit(70.0)
    rows = B.cycles(spark, d).withColumns({"level_hpa": F.lit(500), "number": (F.col("user_id") % 7).cast("int"), "latitude": latitude, "longitude": longitude})
    return quality.coverage_violations(rows, [24], [500], "2024-01-05", "2024-12-31", mean_source=True, months=[6, 7, 8, 9], domain=True)


@query(
    """SELECT 'missing lead_hours ' || w.h AS violation FROM (VALUES (24), (48), (72), (96)) w(h)
    WHERE w.h NOT IN (SELECT 24 * (user_id % 3 + 1) FROM events)
    UNION ALL SELECT 'missing level_hpa ' || v.l FROM (VALUES (500), (850), (925)) v(l)
    WHERE v.l NOT IN (SELECT CASE WHEN event_type = 'error' THEN 500 ELSE 850 END FROM events)
    UNION ALL SELECT 'members ' || count(DISTINCT user_id % 7) FROM events HAVING count(DISTINCT user_id % 7) <> 50"""
)
def coverage_violations(spark: SparkSession, d: str) -> DataFrame:
    """Missing leads and levels, short coverage, wrong member count (Q-05)."""
    level = F.when(F.col("region_id") == "error", 500).otherwise(850)
    rows = B.cycles(spark, d).withColumns({"level_hpa": level, "number": (F.col("user_id") % 7).cast("int")})
    return quality.coverage_violations(rows, [24, 48, 72, 96], [500, 850, 925], "2024-01-05", "2024-01-20", members=50)


@query(
    f"""WITH {PREDICTIONS}, v AS (
      SELECT o_orderkey, CASE WHEN NOT lead_day + 1 BETWEEN 1 AND 10 THEN 'lead,' ELSE '' END
             || CASE WHEN NOT p * 1.1 BETWEEN 0 AND 1 THEN 'probability,' ELSE '' END
             || CASE WHEN NOT (o_orderkey % 5 IN (0, 1)) THEN 'label,' ELSE '' END AS violations FROM predictions)
    SELECT o_orderkey, rtrim(violations, ',') AS violations FROM v WHERE violations <> ''"""
)
def range_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows outside the value ranges with the names of the broken rules (Q-11)."""
    rows = B.orders_as_predictions(spark, d).withColumns(
        {"lead_day": F.col("lead_day") + 1, "bust_probability": F.col("bust_probability") * 1.1, "bust": F.col("o_orderkey") % 5}
    )
    broken = quality.range_violations(rows, quality.response_checks())
    return broken.select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@query(
    """SELECT user_id, 'left' AS side, CAST(n - 1 AS BIGINT) AS copies FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) WHERE n > 1
    UNION ALL SELECT c_custkey, 'right', 1::BIGINT FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
    UNION ALL SELECT user_id, 'left', 1::BIGINT FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
    WHERE n = 1 AND user_id NOT IN (SELECT c_custkey FROM customer)"""
)
def table_differences(spark: SparkSession, d: str) -> DataFrame:
    """Rows, with multiplicity, that only one of two tables has (Q-10, T-02)."""
    left = B.table(spark, d, "events").select("user_id")
    right = B.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    both = quality.table_differences(left, right)
    return both.groupBy("user_id", "side").agg(F.count(F.lit(1)).alias("copies"))


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice,
           round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax, l_returnflag, l_linestatus FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity,
                                   l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS r
      FROM lineitem) WHERE r = 1"""
)
def merged_slices(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping slices united, first row per coordinate key (T-05, T-01, T-04)."""
    line = B.table(spark, d, "lineitem")
    slices = [line.filter(F.col("l_quantity") <= 30), line.filter(F.col("l_quantity") >= 20)]
    values = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    order = ["l_shipdate", "l_partkey", "l_suppkey", *values, "l_returnflag", "l_linestatus"]
    merged = coordinates.merge_slices(slices, ["l_orderkey", "l_linenumber"], order)
    keys = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
    return merged.select(*keys, *[rounded(v) for v in values], "l_returnflag", "l_linestatus")


@query(
    """SELECT c_mktsegment, c_custkey, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3"""
)
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    """First k rows per group under a total order (W-02)."""
    rows = views.rank_within(B.table(spark, d, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)
    return rows.select("c_mktsegment", "c_custkey", "rank")


@query(
    """SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS init_time FROM (
      SELECT DISTINCT date_trunc('day', ts) + to_hours((hour(ts) // 12) * 12) AS t FROM events WHERE event_type = 'click') c
    WHERE t IN (SELECT date_trunc('day', ts) + to_hours((hour(ts) // 12) * 12) FROM events WHERE event_type = 'error')"""
)
def common_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles present in both of two sets (T-03, J-14)."""
    rows = B.cycles(spark, d)
    of = lambda kind: rows.filter(F.col("region_id") == kind).select("init_time")
    return of("click").intersect(of("error")).select(day("init_time"))


@query(
    """SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS init_time FROM (
      SELECT DISTINCT date_trunc('day', ts) + to_hours((hour(ts) // 12) * 12) AS t FROM events
      EXCEPT SELECT date_trunc('day', ts) + to_hours((hour(ts) // 12) * 12) FROM events WHERE event_type = 'error' AND user_id < 12)
    ORDER BY t LIMIT 5"""
)
def next_pending_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The next cycles to process under a cap on new work (O-06, O-05)."""
    rows = B.cycles(spark, d)
    done = rows.filter((F.col("region_id") == "error") & (F.col("user_id") < 12)).select("init_time")
    pending = rows.select("init_time").distinct().join(done.distinct(), "init_time", "left_anti")
    return written(pending.orderBy("init_time").limit(5), "pending").select(day("init_time"))
