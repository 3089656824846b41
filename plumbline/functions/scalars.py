"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from plumbline import contract as C


def is_finite(value: Column) -> Column:
    """Not null, NaN or infinite. NaN sorts above infinity, so one comparison covers both.

    The value is named once: a filter pushed below a projection repeats it as often as it is named.
    """
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def clip(value: Column, low: float, high: float) -> Column:
    """Clip that keeps NaN; ``least``/``greatest`` alone would turn it into the upper limit."""
    bounded = F.greatest(F.least(value, F.lit(high)), F.lit(low))
    return F.when(F.isnan(value), F.lit(float("nan"))).otherwise(bounded)


def close_to(left: Column, right: Column, tolerance: float) -> Column:
    return F.abs(left - right) <= F.lit(tolerance)


def add_hours(time: Column, hours: Column) -> Column:
    return time + F.make_dt_interval(F.lit(0), hours)


def iso_nanos(time: Column) -> Column:
    """Nine-digit ISO text used at the edges; inside, times stay ``TIMESTAMP_NTZ``."""
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000"))


def season_angle(time: Column) -> Column:
    return F.lit(2.0) * F.pi() * F.dayofyear(time) / F.lit(float(C.SEASON_PERIOD_DAYS))


def canonical_region(number: Column, prefix: str = "imd") -> Column:
    return F.format_string(f"{prefix}-%02d", number.cast("int"))


def logit(probability: Column, floor: float = C.PROBABILITY_FLOOR) -> Column:
    bounded = F.greatest(F.least(probability, F.lit(1.0 - floor)), F.lit(floor))
    return F.ln(bounded / (F.lit(1.0) - bounded))


def weighted_sum(terms: dict[str, float]) -> Column:
    """Weighted sum added in the order given, so that results do not depend on the plan."""
    return reduce(lambda a, b: a + b, [F.col(name) * F.lit(weight) for name, weight in terms.items()])


def euclidean(left: list[Column], right: list[Column]) -> Column:
    squares = [(a - b) * (a - b) for a, b in zip(left, right, strict=True)]
    return F.sqrt(reduce(lambda a, b: a + b, squares))


def content_hash(*columns: str | Column) -> Column:
    """SHA-256 of the values as JSON with keys in sorted order."""
    named = sorted(columns, key=str)
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def hash_number(hex_digest: Column) -> Column:
    """First eight hex digits as a number: sums of it give an order-free fingerprint of a table."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("bigint")


def run_id(time: Column) -> Column:
    return F.concat(F.lit("run-"), F.date_format(time, "yyyyMMdd'T'HHmmss'Z'"))


def prediction_id(model: Column, time: Column, region: Column, lead: Column) -> Column:
    """Prediction key; null when the lead is outside 1..10 (see ``quality.bad_leads``)."""
    text = F.concat_ws(
        "__", model, F.date_format(time, "yyyyMMdd'T'HHmmss'Z'"), region, F.format_string("d%02d", lead.cast("int"))
    )
    return F.when(lead.between(1, C.LEAD_DAYS), text)


# The two identifier formats.
RUN_ID_FORMAT = r"^run-(\d{8}T\d{6}Z)$"
PREDICTION_ID_FORMAT = r"^([a-zA-Z0-9-]+)__(\d{8}T\d{6}Z)__(imd-\d{2})__d(\d{2})$"


def _stamp_time(stamp: Column) -> Column:
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'")).cast("timestamp_ntz")


def parse_run_id(text: Column) -> Column:
    """Initialization time, or null for anything that is not a run id."""
    return F.when(text.rlike(RUN_ID_FORMAT), _stamp_time(F.regexp_extract(text, RUN_ID_FORMAT, 1)))


def parse_prediction_id(text: Column) -> Column:
    """Struct of the four parts, or null for anything that is not a prediction id."""
    part = lambda group: F.regexp_extract(text, PREDICTION_ID_FORMAT, group)
    parts = F.struct(
        part(1).alias("model_version"),
        _stamp_time(part(2)).alias("source_forecast_time"),
        part(3).alias("region_id"),
        part(4).cast("int").alias("lead_day"),
    )
    return F.when(text.rlike(PREDICTION_ID_FORMAT), parts)
