"""Landing tables of gridded values, stored by month, and reads that reach only the times a run needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import contract as C
from plumbline.functions.scalars import add_hours

_MONTHS = ("year", "month")


def write_landing(rows: DataFrame, root: str, time: str) -> None:
    """Append rows below (year, month) folders, ordered by time, so that file statistics are narrow.

    Rows are dealt by ranges of time: a heavy month is written by many tasks.
    """
    stamped = rows.withColumns({"year": F.year(time), "month": F.month(time)})
    spread = stamped.repartitionByRange("year", "month", time).sortWithinPartitions("year", "month", time)
    spread.write.partitionBy(*_MONTHS).mode("append").parquet(root)


def within(table: DataFrame, time: str, wanted: DataFrame) -> DataFrame:
    """Rows at the times ``wanted`` holds (a column of that name).

    Three filters, from coarse to exact: months by literals on the partition columns, where the table has them; the first and last
    time by literals, which reach file and row-group statistics; the times themselves by a semi-join.
    """
    first, last = wanted.agg(F.min(time), F.max(time)).first()
    if first is None:
        return table.filter(F.lit(False))
    near = table
    if set(_MONTHS) <= set(table.columns):
        month = F.col("year") * 12 + F.col("month")
        near = near.filter(month.between(first.year * 12 + first.month, last.year * 12 + last.month))
    ntz = lambda t: F.lit(t).cast("timestamp_ntz")
    near = near.filter(F.col(time).between(ntz(first), ntz(last)))
    return near.join(wanted.select(time).distinct(), time, "left_semi")


def needed_times(inits: DataFrame, leads: list[int]) -> tuple[DataFrame, DataFrame]:
    """Starts of the earlier runs (``init_time``) and times of the analyses (``valid_time``) that the runs are compared with."""
    start = F.col("init_time")
    earlier = inits.select(add_hours(start, F.lit(-C.RUN_LAG_HOURS)).alias("init_time")).distinct()
    hours = sorted({lead - step for lead in leads for step in C.PRECIP_STEP_OFFSETS_H})
    offsets = F.explode(F.array(*[F.lit(h) for h in hours])).alias("_hours")
    valid = inits.select("init_time", offsets).select(add_hours(start, F.col("_hours")).alias("valid_time")).distinct()
    return earlier, valid
