"""Jobs and files as queries: what they write is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import contract as C
from plumbline.operators import narrative, regions
from plumbline.plans import bindings as B, jobs
from plumbline.plans.grid_queries import AREAS
from plumbline.plans.label_queries import PREVALENCE
from plumbline.plans.registry import query, rounded
from plumbline.session import scratch_dir, written
from plumbline.sources import documents, tables


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(PREVALENCE)
def labelled_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The whole label job: gate, fit, labelled partitions, record and digests; prevalence of what it stored (L-06, L-07, B-03, O-06)."""
    rows = B.errors(spark, d)
    start = F.col("forecast_initialization_time")
    month = F.expr("make_timestamp_ntz(year(forecast_initialization_time), month(forecast_initialization_time), 1, 0, 0, 0)")
    named = {"forecast_initialization_time": month, "valid_time": start, "dataset_version": F.lit("order-lines-v1")}
    kept = rows.withColumns(named)
    filled = [F.col(f.name).cast(f.dataType) if f.name in kept.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in C.DERIVED_ROW]
    layout = jobs.Layout(_folder(spark, "label-job"))
    tables.write_cycles(kept.select(filled), layout.cycles)
    documents.write_json_report(spark.range(1).select(F.lit("complete").alias("status")), layout.manifest)
    found = jobs.label_corpus(spark, layout, B.TRAIN, min_samples=B.MIN_SAMPLES)
    return found.select("year", "rows", rounded("bust_prevalence"))


@query("SELECT n_nationkey AS region_id, 'IN-' || n_name AS source_name, n_name AS region_name FROM nation")
def region_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A region manifest written as one JSON report and read back (S-08, S-10, V-05)."""
    nation = B.table(spark, d, "nation")
    entry = F.struct(F.col("n_nationkey").alias("id"), F.concat(F.lit("IN-"), "n_name").alias("source_name"), F.col("n_name").alias("name"))
    path = _folder(spark, "region-manifest")
    documents.write_json_report(nation.agg(F.array_sort(F.collect_list(entry)).alias("regions")), path)  # one entry per region
    return documents.read_region_manifest(spark, path)


@query(
    f"""WITH {AREAS}, kept AS (SELECT region_id, CASE WHEN region_id = 2 THEN 0.9::DOUBLE * weight ELSE weight END AS weight FROM weights WHERE region_id <> 4),
    sums AS (SELECT region_id, sum(weight) AS weight_sum FROM kept GROUP BY region_id)
    SELECT r_regionkey AS region_id, round(weight_sum, 6) AS weight_sum FROM region LEFT JOIN sums ON region_id = r_regionkey
    WHERE weight_sum IS NULL OR abs(weight_sum - 1) > 1e-8"""
)
def bad_region_weights(spark: SparkSession, d: str) -> DataFrame:
    """Regions whose weights do not add up to one, or that touch no cell (R-03, W-04)."""
    weights = written(regions.normalized_weights(B.grid_areas(spark, d)), "grid-weights").filter("region_id <> 4")
    changed = weights.withColumn("weight", F.when(F.col("region_id") == 2, F.col("weight") * 0.9).otherwise(F.col("weight")))
    wanted = B.table(spark, d, "region").select(F.col("r_regionkey").alias("region_id"))
    return regions.bad_weight_sums(changed, wanted).select("region_id", rounded("weight_sum"))


@query(
    r"""SELECT conv_id, turn, sha256('{"conversation":"' || conv_id || '","model":"tree-risk-v1","question_hash":"'
      || sha256(trim(regexp_replace(lower(replace(lower(text), 'ß', 'ss')), '[\s\p{Z}]+', ' ', 'g'))) || '"}') AS cache_key FROM conversations"""
)
def answer_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Composite key of a question with what its answer depends on (N-05, X-26)."""
    parts = {"model": F.lit("tree-risk-v1"), "conversation": F.col("conv_id").cast("string")}
    return B.table(spark, d, "conversations").select("conv_id", "turn", narrative.cache_key(F.col("text"), parts).alias("cache_key"))
