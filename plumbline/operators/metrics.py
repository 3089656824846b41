"""Probability metrics as grouped plans: one scan, one count table, exact ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import contract as C
from plumbline.functions.ranks import grouped_quantile, running_totals
from plumbline.functions.scalars import clip
from plumbline.session import written


def climatology(train: DataFrame, target: DataFrame, label: str = "bust", out: str = "climatology_probability") -> DataFrame:
    """Training label rate of the (region, lead) group for each target row; global rate when unseen."""
    rates = train.groupBy("region_id", "lead_day").agg(F.avg(label).alias(out))
    overall = train.agg(F.avg(label)).scalar()
    return target.join(rates, ["region_id", "lead_day"], "left").withColumn(out, F.coalesce(F.col(out), overall))


def bin_of(probability: Column, bins: int = C.CALIBRATION_BINS) -> Column:
    """Left-closed equal bins, 1.0 in the last; edges are multiples of the step, compared exactly."""
    reached = [(probability >= F.lit(i * (1.0 / bins))).cast("int") for i in range(1, bins)]
    return reduce(lambda a, b: a + b, reached)


def score_table(
    rows: DataFrame, slices: list[str], label: str = "bust", probability: str = "p", climate: str = "c"
) -> DataFrame:
    """One row per (slice, clipped probability): rows, positives and squared climatology error.

    Every metric below is computed from this table, so the predictions are read once.
    """
    p = clip(F.col(probability), 0.0, 1.0)
    c = clip(F.col(climate), 0.0, 1.0)
    y = F.col(label).cast("double")
    base = rows.select(*slices, p.alias("p"), y.alias("y"), ((c - y) * (c - y)).alias("c2"))
    table = base.groupBy(*slices, "p").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("bigint")).alias("pos"), F.sum("c2").alias("c2")
    )
    return written(table, "scores")


def calibration_bins(scores: DataFrame, slices: list[str], bins: int = C.CALIBRATION_BINS) -> DataFrame:
    """Count, mean probability and observed rate per bin, empty bins included."""
    filled = (
        scores.withColumn("bin", bin_of(F.col("p"), bins))
        .groupBy(*slices, "bin")
        .agg(F.sum("n").alias("count"), F.sum(F.col("p") * F.col("n")).alias("_p"), F.sum("pos").alias("_pos"))
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    if slices:
        frame = scores.select(*slices).distinct().select("*", every)
    else:
        frame = scores.sparkSession.range(1).select(every)
    joined = frame.join(filled, [*slices, "bin"], "left")
    return joined.select(
        *slices,
        "bin",
        (F.col("bin") * F.lit(1.0 / bins)).alias("lower"),
        ((F.col("bin") + 1) * F.lit(1.0 / bins)).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.col("_p") / F.col("count")).alias("mean_probability"),
        (F.col("_pos") / F.col("count")).alias("observed_frequency"),
    )


def _curve_areas(scores: DataFrame, slices: list[str]) -> DataFrame:
    """Average precision and ROC-AUC from running totals over descending scores, ties grouped."""
    ranked = running_totals(scores.select(*slices, "p", "n", "pos"), slices, "p", ["n", "pos"], descending=True)
    hits = F.col("pos_before") + F.col("pos")
    precision = hits / (F.col("n_before") + F.col("n"))
    misses = F.col("n") - F.col("pos")
    pairs = misses * (F.col("pos_before") + F.col("pos") / F.lit(2.0))
    sums = ranked.groupBy(*slices).agg(
        F.sum(F.col("pos") * precision).alias("_ap"),
        F.sum(pairs).alias("_pairs"),
        F.sum("pos").alias("_pos"),
        F.sum(misses).alias("_neg"),
    )
    both = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    return sums.select(
        *slices,
        F.when(both, F.col("_ap") / F.col("_pos")).alias("pr_auc"),
        F.when(both, F.col("_pairs") / (F.col("_pos") * F.col("_neg"))).alias("roc_auc"),
    )


def _top_risk(scores: DataFrame, slices: list[str], share: float) -> DataFrame:
    cut = grouped_quantile(scores, slices, "p", share, "top_20_percent_risk_threshold").drop("sample_count")
    ranked = scores.join(cut, slices) if slices else scores.withColumn("top_20_percent_risk_threshold", cut.scalar())
    high = F.col("p") >= F.col("top_20_percent_risk_threshold")
    return ranked.groupBy(*slices).agg(
        F.max("top_20_percent_risk_threshold").alias("top_20_percent_risk_threshold"),
        F.try_divide(F.sum(F.when(high, F.col("pos"))), F.sum("pos")).alias("top_20_percent_risk_recall"),
    )


def _combine(parts: list[DataFrame], slices: list[str]) -> DataFrame:
    """Join one-row-per-slice results; without slices, on a constant."""
    if slices:
        return reduce(lambda a, b: a.join(b, slices), parts)
    keyed = [part.withColumn("_one", F.lit(1)) for part in parts]
    return reduce(lambda a, b: a.join(b, ["_one"]), keyed).drop("_one")


def evaluate(
    rows: DataFrame,
    slices: list[str] | None = None,
    label: str = "bust",
    probability: str = "p",
    climate: str = "c",
    bins: int = C.CALIBRATION_BINS,
    share: float = C.TOP_RISK_QUANTILE,
) -> DataFrame:
    """All probability metrics, one row per slice (one row in all without slices).

    Slices come ordered by the text form of their key.
    """
    slices = slices or []
    result = evaluate_scores(score_table(rows, slices, label, probability, climate), slices, bins, share)
    return result.orderBy(*[F.col(s).cast("string") for s in slices]) if slices else result


def evaluate_scores(
    scores: DataFrame, slices: list[str], bins: int = C.CALIBRATION_BINS, share: float = C.TOP_RISK_QUANTILE
) -> DataFrame:
    """The metrics from a score table, in no order."""
    p = F.col("p")
    brier = F.col("pos") * (F.lit(1.0) - p) * (F.lit(1.0) - p) + (F.col("n") - F.col("pos")) * p * p
    basic = scores.groupBy(*slices).agg(
        F.sum("n").alias("rows"),
        (F.sum("pos") / F.sum("n")).alias("prevalence"),
        (F.sum(brier) / F.sum("n")).alias("brier_score"),
        # Few distinct climatologies make short decimals; the order of the sum must not decide on which side of one the mean falls.
        F.round(F.sum("c2") / F.sum("n"), 15).alias("brier_climatology"),
    )
    basic = basic.withColumn(
        "brier_skill_score",
        F.when(
            F.col("brier_climatology") > 0, F.lit(1.0) - F.try_divide(F.col("brier_score"), F.col("brier_climatology"))
        ),
    )
    gap = F.abs(F.col("mean_probability") - F.col("observed_frequency"))
    calibration = (
        calibration_bins(scores, slices, bins)
        .groupBy(*slices)
        .agg((F.sum(F.col("count") * gap) / F.sum("count")).alias("expected_calibration_error"))
    )
    return _combine([basic, _curve_areas(scores, slices), calibration, _top_risk(scores, slices, share)], slices)
