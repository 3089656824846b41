"""Contract checks. Each returns the violating rows; ``errors.raise_if_any`` makes them fatal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import contract as C
from plumbline.functions.scalars import is_finite
from plumbline.operators import coordinates


def late_sources(rows: DataFrame, source: str = "feature_source_time", init: str = "forecast_initialization_time") -> DataFrame:
    """Rows whose features come from after the start of the forecast."""
    return rows.filter(F.col(source) > F.col(init))


def leaked_columns(columns: list[str]) -> list[str]:
    return [name for name in columns if name.startswith(("analysis_", "verification_"))]


def schema_problems(columns: list[str]) -> list[str]:
    """Forecast features a stored cycle lacks, and spread columns it must not have."""
    missing = [f"missing {name}" for name in C.FORECAST_FEATURES if name not in columns]
    return missing + [f"unexpected {name}" for name in columns if "spread" in name]


def unit_violations(units: DataFrame, contract: dict[str, list[str]]) -> DataFrame:
    """Required variables that are absent or carry a unit outside the allowed set."""
    required = [(name, allowed) for name, allowed in contract.items()]
    wanted = units.sparkSession.createDataFrame(required, "variable string, allowed array<string>")
    joined = wanted.join(units.withColumn("_present", F.lit(True)), "variable", "left")
    wrong = (F.size("allowed") > 0) & ~F.coalesce(F.array_contains("allowed", F.col("units")), F.lit(False))
    problem = F.when(F.col("_present").isNull(), "missing").when(wrong, "units")
    return joined.select("variable", "units", problem.alias("problem")).filter(F.col("problem").isNotNull())


def non_finite_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with null, NaN or infinite values and how many, from one aggregate over the table."""
    bad = [F.count(F.when(~is_finite(F.col(c).cast("double")), 1)).alias(c) for c in columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad_rows")) for c in columns])
    return rows.agg(*bad).select(F.inline(pairs)).filter(F.col("bad_rows") > 0)


def coverage_violations(
    grid: DataFrame,
    leads: list[int],
    levels: list[int],
    first: str,
    last: str,
    members: int | None = None,
    mean_source: bool = False,
    months: list[int] | None = None,
    domain: bool = False,
) -> DataFrame:
    """Missing leads, missing levels, short time coverage and a wrong member count of a forecast table.

    With ``mean_source`` a source of ensemble means must not carry members; with ``months`` some start must lie in these months; with
    ``domain`` some point must lie in the domain. All of them come from one aggregate. A table without one of its dimensions has that violation alone.
    """
    spark = grid.sparkSession
    dimensions = ["init_time", "lead_hours", "level_hpa", *(["number"] if members is not None else []), *(["latitude", "longitude"] if domain else [])]
    missing = [(f"missing dimension {name}",) for name in dimensions if name not in grid.columns]
    if missing:
        return spark.createDataFrame(missing, "violation string")
    if "number" not in grid.columns:
        grid = grid.withColumn("number", F.lit(None).cast("int"))

    def absent(column: str, wanted: list[int]) -> DataFrame:
        required = spark.createDataFrame([(v,) for v in wanted], f"{column} int")
        gone = required.join(grid.select(column).distinct(), column, "left_anti")
        return gone.select(F.concat_ws(" ", F.lit(f"missing {column}"), F.col(column).cast("string")).alias("violation"))

    inside = coordinates.in_domain() if domain else F.lit(True)
    span = grid.agg(
        F.min("init_time").alias("a"),
        F.max("init_time").alias("b"),
        F.countDistinct("number").alias("m"),
        F.count_if(F.month("init_time").isin(months) if months else F.lit(True)).alias("in_months"),
        F.count_if(inside).alias("in_domain"),
    )
    short = (F.col("a") > F.lit(first).cast("timestamp_ntz")) | (F.col("b") < F.lit(last).cast("timestamp_ntz"))
    found = absent("lead_hours", leads).unionByName(absent("level_hpa", levels))
    found = found.unionByName(span.filter(F.coalesce(short, F.lit(True))).select(F.lit("short coverage").alias("violation")))
    tests = {
        "empty months": (F.col("in_months") == 0) if months else F.lit(False),
        "empty domain": (F.col("in_domain") == 0) if domain else F.lit(False),
        "members in a mean source": (F.col("m") > 0) if mean_source else F.lit(False),
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda v: v.isNotNull())
    found = found.unionByName(span.select(F.explode(broken).alias("violation")))
    if members is not None:
        found = found.unionByName(
            span.filter(F.col("m") != members).select(F.concat(F.lit("members "), F.col("m").cast("string")).alias("violation"))
        )
    return found


def wrong_counts(rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Groups whose row count differs from the contract."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") != expected)


def table_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that only one of two tables has."""
    columns = left.columns
    only = lambda a, b, side: a.select(columns).exceptAll(b.select(columns)).withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def range_violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows breaking named predicates, with the names in ``violations``; an unknown outcome breaks it."""
    broken = F.array(*[F.when(~F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in checks.items()])
    return rows.withColumn("violations", F.filter(broken, lambda v: v.isNotNull())).filter(F.size("violations") > 0)


def response_checks(probability: str = "bust_probability", lead: str = "lead_day", label: str = "bust", distance: str | None = None) -> dict[str, Column]:
    checks = {
        "lead": F.col(lead).between(1, C.LEAD_DAYS),
        "probability": F.col(probability).between(0, 1),
        "label": F.col(label).isin(0, 1),
    }
    if distance:
        checks["distance"] = F.col(distance) >= 0
    return checks


def text_check(column: str, limit: int) -> Column:
    """Not blank and at most ``limit`` characters."""
    return (F.length(F.trim(F.col(column))) > 0) & (F.length(F.col(column)) <= limit)


def bad_leads(rows: DataFrame, lead: str = "lead_day") -> DataFrame:
    return rows.filter(~F.coalesce(F.col(lead).between(1, C.LEAD_DAYS), F.lit(False)))


def cycle_validity(
    rows: DataFrame,
    version: str,
    rows_per_cycle: int = C.ROWS_PER_CYCLE,
    leads: list[int] | None = None,
    regions: int = C.REGION_COUNT,
    cycle: str = "forecast_initialization_time",
    finite: list[str] | None = None,
    extra: list[Column] | None = None,
) -> DataFrame:
    """Every stored cycle judged in one aggregate: rows, leads, regions, version, and ``valid``.

    The columns ``finite`` must have finite values in all rows; ``extra`` aggregates come along.

    Distinct leads, regions and versions are reduced per (cycle, value) map-side, so a cycle with too
    many rows costs no more than its distinct values.
    """
    wanted = leads or list(range(1, C.LEAD_DAYS + 1))
    outside = F.count(F.when(~F.col("lead_day").isin(wanted), 1))
    judged = rows.groupBy(cycle).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("lead_day").alias("leads"),
        outside.alias("_outside"),
        F.countDistinct("region_id").alias("regions"),
        F.count(F.when(F.col("dataset_version") != version, 1)).alias("_other_version"),
        F.countDistinct("dataset_version").alias("versions"),
        F.count(F.when(~_all_finite(finite or []), 1)).alias("_not_finite"),
        *(extra or []),
    )
    tests = [
        F.col("_not_finite") == 0,
        F.col("rows") == rows_per_cycle,
        F.col("leads") == len(wanted),
        F.col("_outside") == 0,
        F.col("regions") == regions,
        F.col("versions") == 1,
        F.col("_other_version") == 0,
    ]
    return judged.withColumn("valid", reduce(lambda a, b: a & b, tests)).drop("_outside", "_other_version", "_not_finite")


def _all_finite(columns: list[str]) -> Column:
    return reduce(lambda a, c: a & F.coalesce(is_finite(F.col(c)), F.lit(False)), columns, F.lit(True))
