"""Robust, training-only error statistics and the labels made from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import contract as C
from plumbline.errors import ContractViolation, raise_if_any
from plumbline.functions.ranks import BUCKET, bucket_totals, count_table, grouped_quantile, quantile_ranges, quantile_within
from plumbline.functions.scalars import clip, is_finite, weighted_sum
from plumbline.session import written

GRAINS = ["region_lead", "lead", "global"]
_KEYS = ["component", "grain", "region_id", "lead_day"]
# Stand-ins for "all regions" and "all leads": non-null, so that grains join by plain equality.
ALL_REGIONS = "*"
ALL_LEADS = -1


def component_rows(rows: DataFrame, components: dict[str, str]) -> DataFrame:
    """Errors in long form: (component, region_id, lead_day, value), finite values only."""
    pairs = [F.struct(F.lit(name).alias("component"), F.col(column).alias("value")) for name, column in components.items()]
    return (
        rows.select("region_id", "lead_day", F.inline(F.array(*pairs)))
        .filter(is_finite(F.col("value")))
        .select("component", F.col("region_id").cast("string").alias("region_id"), "lead_day", "value")
    )


def median_and_mad(rows: DataFrame, components: dict[str, str] = C.COMPONENT_COLUMNS) -> DataFrame:
    """Median, MAD and sample count at three grains: (region, lead), lead, global.

    Repeated values are counted once, at the finest grain, and every grain reads those counts. MAD is a
    second quantile over |value - median of its own grain|. Both are bounded by the totals of buckets of values, which are
    made once, at the finest grain, and added up for the others.
    """
    keys = ["component", "region_id", "lead_day"]
    fine = count_table(component_rows(rows, components), keys, "value")

    def grain(name: str, region: Column, lead: Column) -> Column:
        return F.struct(F.lit(name).alias("grain"), region.alias("region_id"), lead.alias("lead_day"))

    every = F.array(
        grain("region_lead", F.col("region_id"), F.col("lead_day")),
        grain("lead", F.lit(ALL_REGIONS), F.col("lead_day")),
        grain("global", F.lit(ALL_REGIONS), F.lit(ALL_LEADS)),
    )
    counts = fine.select("component", "value", "n", F.inline(every))
    totals = bucket_totals(fine, keys, "value").select("component", BUCKET, "total", "least", "most", F.inline(every))
    totals = totals.groupBy(*_KEYS, BUCKET).agg(F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    totals = written(totals, "grain-totals")
    medians = written(quantile_within(counts, quantile_ranges(totals, _KEYS, 0.5), _KEYS, "value", "median"), "medians")
    middle = medians.drop("sample_count")
    away = lambda c: F.abs(F.col(c) - F.col("median"))
    inside = F.col("median").between(F.col("least"), F.col("most"))
    nearest = F.when(inside, 0.0).otherwise(F.least(away("least"), away("most")))
    around = totals.join(middle, _KEYS).select(*_KEYS, "total", nearest.alias("least"), F.greatest(away("least"), away("most")).alias("most"))
    deviations = counts.join(middle, _KEYS).select(*_KEYS, away("value").alias("value"), "n")
    mads = quantile_within(deviations, quantile_ranges(around, _KEYS, 0.5), _KEYS, "value", "mad").drop("sample_count")
    return medians.join(mads, _KEYS)


def robust_fit(
    train: DataFrame,
    groups: DataFrame,
    components: dict[str, str] = C.COMPONENT_COLUMNS,
    min_samples: int = C.MIN_GROUP_SAMPLES,
) -> DataFrame:
    """Statistics for each (component, region, lead): own group, else its lead, else global.

    A grain is used when it has ``min_samples`` training values; ``fallback_level`` records which.
    """
    table = written(median_and_mad(train, components), "robust-statistics")
    stats = ["median", "mad", "sample_count"]

    def at(grain: str, keys: list[str]) -> DataFrame:
        chosen = table.filter(F.col("grain") == grain)
        return chosen.select("component", *keys, F.struct(*stats).alias(grain))

    wanted = groups.select(F.col("region_id").cast("string").alias("region_id"), "lead_day").distinct()
    names = F.explode(F.array(*[F.lit(name) for name in components])).alias("component")
    joined = (
        wanted.select("*", names)
        .join(at("region_lead", ["region_id", "lead_day"]), ["component", "region_id", "lead_day"], "left")
        .join(at("lead", ["lead_day"]), ["component", "lead_day"], "left")
        .join(at("global", []), ["component"], "left")
    )
    enough = lambda grain: F.col(f"{grain}.sample_count") >= min_samples
    level = F.when(enough("region_lead"), "region_lead").when(enough("lead"), "lead").otherwise("global")
    picked = F.when(level == "region_lead", F.col("region_lead")).when(level == "lead", F.col("lead")).otherwise(F.col("global"))
    return joined.select(
        "component", "region_id", "lead_day", *[picked[s].alias(s) for s in stats], level.alias("fallback_level")
    )


def standardize(
    rows: DataFrame,
    stats: DataFrame,
    components: dict[str, str] = C.COMPONENT_COLUMNS,
    weights: dict[str, float] = C.COMPONENT_WEIGHTS,
) -> DataFrame:
    """Add ``z_<component>`` (clipped robust score) and their weighted sum ``severity``.

    The statistics are pivoted to one row per (region, lead), so all components take one join.
    """
    pick = lambda name, stat: F.max(F.when(F.col("component") == name, F.col(stat)))
    wide = stats.groupBy("region_id", "lead_day").agg(
        *[pick(name, stat).alias(f"_{name}_{stat}") for name in components for stat in ("median", "mad")]
    )
    scored = rows.join(wide, ["region_id", "lead_day"], "left")
    scores = [f"z_{name}" for name in components]
    raw = {}
    for name, column in components.items():
        width = F.lit(C.MAD_SCALE) * F.col(f"_{name}_mad") + F.lit(C.Z_EPSILON)
        raw[f"z_{name}"] = (F.col(column) - F.col(f"_{name}_median")) / width
    # Three short projections: folding them into one repeats every score and outgrows the JIT limit.
    scored = scored.withColumns(raw)
    scored = scored.withColumns({z: clip(F.col(z), -C.Z_LIMIT, C.Z_LIMIT) for z in scores})
    severity = weighted_sum({f"z_{name}": weights[name] for name in components})
    return scored.select(*rows.columns, *scores, severity.alias("severity"))


def severity_thresholds(scored_train: DataFrame, share: float = C.THRESHOLD_QUANTILE) -> DataFrame:
    counts = count_table(scored_train.filter(is_finite(F.col("severity"))), ["region_id", "lead_day"], "severity")
    return grouped_quantile(counts, ["region_id", "lead_day"], "severity", share, "threshold")


@dataclass(frozen=True)
class LabelFit:
    """Fitted label transform: two small written tables."""

    stats: DataFrame
    thresholds: DataFrame

    def apply(self, rows: DataFrame, **options) -> DataFrame:
        """Rows with z-scores, severity, threshold and ``bust`` (severity strictly above threshold)."""
        scored = standardize(rows, self.stats, **options)
        joined = scored.join(self.thresholds.select("region_id", "lead_day", "threshold"), ["region_id", "lead_day"], "left")
        return joined.withColumn("bust", (F.col("severity") > F.col("threshold")).cast("byte"))


def fit_labels(
    rows: DataFrame,
    train: Column,
    components: dict[str, str] = C.COMPONENT_COLUMNS,
    weights: dict[str, float] = C.COMPONENT_WEIGHTS,
    min_samples: int = C.MIN_GROUP_SAMPLES,
    share: float = C.THRESHOLD_QUANTILE,
    threshold_min_samples: int | None = None,
) -> LabelFit:
    """Fit statistics and thresholds on the training rows only; groups come from all rows.

    With ``threshold_min_samples`` a group with fewer training rows takes its lead's threshold, then
    the global one; by default every group needs a training row of its own. ``rows`` are evaluated once: what the fit needs
    of them is written as a narrow table.
    """
    kept = ["region_id", "lead_day", *dict.fromkeys(components.values())]
    narrow = written(rows.select(*kept, F.coalesce(train, F.lit(False)).alias("_train")), "label-rows")
    training = narrow.filter("_train").drop("_train")
    groups = written(narrow.select("region_id", "lead_day").distinct(), "label-groups")
    stats = written(robust_fit(training, groups, components, min_samples), "label-stats")
    if stats.filter(F.col("median").isNotNull()).isEmpty():
        raise ContractViolation("no training rows to fit labels on")
    scored = standardize(training, stats, components, weights)
    if threshold_min_samples is None:
        thresholds = written(severity_thresholds(scored, share), "label-thresholds")
        raise_if_any(
            groups.join(thresholds, ["region_id", "lead_day"], "left_anti"), "groups without a training-only threshold"
        )
    else:
        thresholds = written(_hierarchical_thresholds(scored, groups, share, threshold_min_samples), "label-thresholds")
    return LabelFit(stats, thresholds)


def _hierarchical_thresholds(scored: DataFrame, groups: DataFrame, share: float, min_samples: int) -> DataFrame:
    own = severity_thresholds(scored, share)
    lead = grouped_quantile(count_table(scored, ["lead_day"], "severity"), ["lead_day"], "severity", share, "_lead")
    whole = grouped_quantile(count_table(scored, [], "severity"), [], "severity", share, "_whole").select("_whole")
    lead = lead.withColumnRenamed("sample_count", "_lead_n")
    joined = groups.join(own, ["region_id", "lead_day"], "left").join(lead, ["lead_day"], "left")
    chosen = (
        F.when(F.col("sample_count") >= min_samples, F.col("threshold"))
        .when(F.col("_lead_n") >= min_samples, F.col("_lead"))
        .otherwise(whole.scalar())
    )
    return joined.select("region_id", "lead_day", chosen.alias("threshold"), "sample_count")


def unlabelled(labelled: DataFrame) -> DataFrame:
    """Violations: rows whose group has no fitted statistics or threshold."""
    return labelled.filter(F.col("severity").isNull() | F.col("threshold").isNull())


def prevalence(labelled: DataFrame, period: Column, name: str = "year") -> DataFrame:
    """Rows and share of positive labels per period."""
    return (
        labelled.groupBy(period.alias(name))
        .agg(F.count(F.lit(1)).alias("rows"), F.avg("bust").alias("bust_prevalence"))
        .orderBy(name)
    )
