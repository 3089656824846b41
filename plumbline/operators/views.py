"""Look-up queries over predictions as DataFrames, in point and batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline import contract as C
from plumbline.functions.scalars import prediction_id, run_id


def runs(predictions: DataFrame, rows_per_cycle: int = C.ROWS_PER_CYCLE, time: str = "forecast_initialization_time") -> DataFrame:
    """One row per run, newest first: sorted distinct leads and whether it is complete.

    Rows are counted per (run, lead) first, so the lead list holds one entry per lead.
    """
    per_lead = predictions.groupBy(time, "lead_day").agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_lead.groupBy(time)
        .agg(F.array_sort(F.collect_list("lead_day")).alias("available_lead_days"), F.sum("_n").alias("records"))
        .withColumn("data_status", F.when(F.col("records") == rows_per_cycle, "complete").otherwise("partial"))
        .withColumn("run_id", run_id(F.col(time)))
        .orderBy(F.col(time).desc())
    )


def prediction_rows(predictions: DataFrame, labelled: DataFrame, columns: list[str], **point) -> DataFrame:
    """Predictions with columns of the labelled rows, restricted by any of init, lead and region.

    The filters sit below the join on both sides, so they reach both scans.
    """
    for name, value in point.items():
        if value is not None:
            predictions = predictions.filter(F.col(name) == value)
            labelled = labelled.filter(F.col(name) == value)
    facts = labelled.select(*C.PREDICTION_KEYS, *columns)
    return predictions.join(facts, C.PREDICTION_KEYS).orderBy("lead_day", "region_id")


def with_identity(rows: DataFrame, model_version: str) -> DataFrame:
    """Add run id, prediction id and the two names of 1 - probability."""
    time = F.col("forecast_initialization_time")
    reliability = F.lit(1.0) - F.col("bust_probability")
    return rows.withColumns(
        {
            "run_id": run_id(time),
            "prediction_id": prediction_id(F.lit(model_version), time, F.col("region_id"), F.col("lead_day")),
            "forecast_confidence": reliability,
            "forecast_reliability": reliability,
        }
    )


def group_status(rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Rows per group against the expected number: ``complete`` or ``incomplete``; absent groups have no row."""
    status = F.when(F.col("rows") == expected, "complete").otherwise("incomplete")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumn("status", status)


def risk_maps(rows: DataFrame, regions: int = C.REGION_COUNT) -> DataFrame:
    """Rows of the (run, lead) maps that hold exactly the expected number of regions."""
    keys = ["forecast_initialization_time", "lead_day"]
    complete = group_status(rows, keys, regions).filter(F.col("status") == "complete").select(*keys)
    return rows.join(complete, keys, "left_semi")


def lead_curves(rows: DataFrame, leads: int = C.LEAD_DAYS) -> DataFrame:
    """One row per (run, region) with exactly the expected leads: points ordered by lead.

    Group sizes are checked before points are collected, so a list never exceeds ``leads``.
    """
    keys = ["forecast_initialization_time", "region_id"]
    complete = group_status(rows, keys, leads).filter(F.col("status") == "complete").select(*keys)
    point = F.struct("lead_day", "valid_time", "bust_probability", (F.lit(1.0) - F.col("bust_probability")).alias("forecast_reliability"))
    kept = rows.join(complete, keys, "left_semi")
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("points"))


def region_list(regions: DataFrame, reference: str) -> DataFrame:
    """Region manifest with ids and the place of the geometry."""
    geometry_id = F.col("region_id")
    return regions.select(
        "region_id", "region_name", geometry_id.alias("geometry_id"), F.concat(F.lit(reference), geometry_id).alias("geometry_reference")
    ).orderBy("region_id")


def risk_class(probability: Column) -> Column:
    return F.when(probability >= 0.5, "elevated").otherwise("lower")


def risk_band(probability: Column) -> Column:
    """Quarter of the scale, 0 to 3."""
    return (probability >= 0.25).cast("int") + (probability >= 0.5).cast("int") + (probability >= 0.75).cast("int")


def highest_risk_region(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Region with the highest probability per run and lead, lowest id on ties; combines map-side."""
    keys = keys or ["forecast_initialization_time", "lead_day"]
    best = F.min_by(
        F.struct("region_id", "bust_probability"), F.struct((-F.col("bust_probability")).alias("p"), F.col("region_id"))
    ).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.region_id", "_best.bust_probability")


def rank_within(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key under a total order; Spark limits each group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def find_explanation(explanations: DataFrame, prediction: str) -> DataFrame:
    return explanations.filter(F.col("prediction_id") == prediction)


def model_metadata(report: DataFrame, test_split: str, **facts: str) -> DataFrame:
    """Held-out metrics of the model with fixed facts about it."""
    chosen = report.filter((F.col("split") == test_split) & (F.col("source") == "model"))
    return chosen.withColumns({name: F.lit(value) for name, value in facts.items()})
