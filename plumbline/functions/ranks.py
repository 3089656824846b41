"""Exact ranks, running totals and quantiles without putting a whole group into one task.

All functions work on *count tables*: one row per (keys, value) with weights, made by a plain
``groupBy`` whose map-side combine removes repeated values, and written once because they are read
several times. They are cut into global equi-depth value buckets, so that even one key holding most rows is
spread over every bucket: bucket totals give each bucket its offset, and only rows of one (keys, bucket) pair are
ordered together. The bucket edges are approximate, the results are exact. There is one path for every size; the
number of buckets follows from the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.session import written

BUCKET = "_bucket"
#: Rows of a bucket on average: what one task orders.
BUCKET_ROWS = 1 << 16


def bucket_count(rows: int) -> int:
    """Power of two with which buckets hold about ``BUCKET_ROWS`` rows."""
    return max(8, 1 << (max(1, rows // BUCKET_ROWS) - 1).bit_length())


#: Buckets told apart by one list of edges; more are told apart in two steps.
MOST_EDGES = 1 << 10


def edges_of(df: DataFrame, value: str, buckets: int) -> Column:
    """Scalar subquery: ``buckets - 1`` approximate quantiles of ``value``."""
    return df.agg(F.percentile_approx(value, _shares(buckets), 16 * buckets)).scalar()


def _shares(buckets: int) -> list[float]:
    return [i / buckets for i in range(1, buckets)]


def with_bucket(df: DataFrame, value: str, edges: Column, buckets: int, name: str = BUCKET) -> DataFrame:
    """Add the number of edges at or below ``value``, found by binary search over the edge array."""
    return df.withColumn("_edges", edges).withColumn(name, _search(value, buckets)).drop("_edges")


def _search(value: str, buckets: int) -> Column:
    steps = []
    step = buckets // 2
    while step:
        steps.append(F.lit(step))
        step //= 2

    def descend(at: Column, jump: Column) -> Column:
        return F.when(F.element_at("_edges", at + jump) <= F.col(value), at + jump).otherwise(at)

    return F.aggregate(F.array(*steps), F.lit(0), descend)


def count_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows reduced to one per (keys, value) with their number ``n``, written for repeated reading."""
    return written(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), "counts")


def bucketed(counts: DataFrame, value: str, rows: int | None = None) -> DataFrame:
    """Rows with their bucket; ``rows`` is the size of the table where it is known without counting.

    Up to ``MOST_EDGES`` buckets share one list of edges. Beyond, each of these coarse buckets has a list of its own, made in one
    aggregate by coarse bucket: no list and no aggregate buffer grows with the table.
    """
    buckets = bucket_count(counts.count() if rows is None else rows)
    coarse = min(buckets, MOST_EDGES)
    marked = with_bucket(counts, value, edges_of(counts, value, coarse), coarse)
    fine = buckets // coarse
    if fine == 1:
        return marked
    lists = marked.groupBy(BUCKET).agg(F.percentile_approx(value, _shares(fine), 16 * fine).alias("_edges"))
    found = marked.join(written(lists, "bucket-edges"), BUCKET)
    return found.withColumn(BUCKET, F.col(BUCKET) * fine + _search(value, fine)).select(*counts.columns, BUCKET)


def _with_headers(marked: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows and one header per (keys, bucket): the header sorts first and brings the bucket's offset.

    Adding the offset as a row keeps the whole step one union and one window, with no join.
    """
    return marked.withColumn("_header", F.lit(0)).unionByName(
        headers.withColumn("_header", F.lit(1)), allowMissingColumns=True
    )


def running_totals(
    counts: DataFrame, keys: list[str], value: str, sums: list[str], descending: bool = False
) -> DataFrame:
    """Add ``<sum>_before``: the total of each sum over strictly smaller (or larger) values of the key."""
    ordered = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    marked = bucketed(counts, value)
    per_bucket = marked.groupBy(*keys, BUCKET).agg(*[F.sum(s).alias(s) for s in sums])
    earlier = W.partitionBy(*_or_constant(keys)).orderBy(ordered(BUCKET)).rowsBetween(W.unboundedPreceding, -1)
    headers = per_bucket.select(*keys, BUCKET, *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(s) for s in sums])
    inside = (
        W.partitionBy(*keys, BUCKET)
        .orderBy(F.col("_header").desc(), ordered(value))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    totals = [F.sum(s).over(inside).alias(f"{s}_before") for s in sums]
    placed = _with_headers(marked, headers).select("*", *totals)
    return placed.filter(F.col("_header") == 0).select(*counts.columns, *[f"{s}_before" for s in sums])


def grouped_quantile(
    counts: DataFrame, keys: list[str], value: str, share: float, out: str, weight: str = "n", rows: int | None = None
) -> DataFrame:
    """Exact linear-interpolated quantile of a count table per key: columns keys, ``out``, ``sample_count``.

    A value may come in several rows of a key. ``rows`` is an upper bound of the table size, if known.
    """
    return quantile_within(counts, quantile_ranges(bucket_totals(counts, keys, value, weight, rows), keys, share), keys, value, out, weight)


def bucket_totals(counts: DataFrame, keys: list[str], value: str, weight: str = "n", rows: int | None = None) -> DataFrame:
    """One row per (keys, bucket): ``total`` weight, least and largest value (``least``, ``most``). Its size follows from the buckets."""
    marked = bucketed(counts.select(*keys, value, F.col(weight).alias("_w")), value, rows)
    totals = marked.groupBy(*keys, BUCKET).agg(F.sum("_w").alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return written(totals, "bucket-totals")


def quantile_ranges(totals: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Per key the wanted rank ``_at``, the weight ``_n`` and bounds of the values at that rank; written, so that Spark sees its size.

    The value at a rank is not below the one found if every bucket stood at its least value, nor above that for its largest.
    """
    whole = W.partitionBy(*_or_constant(keys))
    upto = lambda c: F.sum("total").over(whole.orderBy(c).rowsBetween(W.unboundedPreceding, 0))
    placed = totals.withColumns({"_n": F.sum("total").over(whole), "_by_least": upto("least"), "_by_most": upto("most")})
    placed = placed.withColumn("_at", F.lit(share) * (F.col("_n") - 1))
    bounds = [
        F.max("_at").alias("_at"),
        F.max("_n").alias("_n"),
        F.min(F.when(F.col("_by_least") > F.floor("_at"), F.col("least"))).alias("_least"),
        F.min(F.when(F.col("_by_most") > F.ceil("_at"), F.col("most"))).alias("_most"),
    ]
    return written(placed.groupBy(*keys).agg(*bounds).filter(F.col("_n").isNotNull()), "quantile-ranges")


def quantile_within(counts: DataFrame, ranges: DataFrame, keys: list[str], value: str, out: str, weight: str = "n") -> DataFrame:
    """Quantiles of a count table whose ``quantile_ranges`` are known: only values between the bounds are ordered.

    Values below (and missing ones, which come first) are added up in one row per key.
    """
    # The constant joins the one row of a table without keys.
    rows = counts.select(*keys, value, F.col(weight).alias("_w"), F.lit(1).alias("_one")).alias("m")
    sides = ranges.withColumn("_one", F.lit(1)).alias("h")
    joined = rows.join(sides, [F.col(f"m.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*keys, "_one"]])
    within = joined.filter(F.col(f"m.{value}").isNull() | (F.col(f"m.{value}") <= F.col("_most")))
    kept = F.when(F.col(f"m.{value}") < F.col("_least"), None).otherwise(F.col(f"m.{value}"))
    near = within.select(*[F.col(f"m.{k}").alias(k) for k in keys], kept.alias(value), "_at", "_n", "_w")
    summed = near.groupBy(*keys, value, "_at", "_n").agg(F.sum("_w").alias("_w"))
    before = W.partitionBy(*_or_constant(keys)).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = summed.withColumn("_from", F.coalesce(F.sum("_w").over(before), F.lit(0))).withColumn("_to", F.col("_from") + F.col("_w"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col(value)))

    found = ranked.groupBy(*keys).agg(
        at(F.floor("_at")).alias("_low"),
        at(F.ceil("_at")).alias("_high"),
        F.max("_at").alias("_at"),
        F.max("_n").alias("sample_count"),
    )
    interpolated = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(
        F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    )
    return found.select(*keys, interpolated.alias(out), "sample_count")


PART = "_part"


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in ranges of ``order``, one range per task, with the number of the range in ``PART``; written, so that it stays."""
    spread = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    return written(spread.withColumn(PART, F.spark_partition_id()), "ranges")


def positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the position (from 0) of every row in the order of the whole table; no task sees more than its range.

    Only one row per range is ordered in one place: its number of rows.
    """
    ranged = in_ranges(df, order)
    sizes = ranged.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(PART, before.alias("_start"))
    inside = F.row_number().over(W.partitionBy(PART).orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(starts, PART).select(*df.columns, (F.col("_start") + F.col("_inside")).alias(name))


def with_neighbours(df: DataFrame, order: str, value: str, before: str, after: str) -> DataFrame:
    """Add the value of the row before and of the row after in the order of the whole table, null at its ends.

    Inside a range by a window; over its borders by one row per range, which knows the first and last value.
    """
    ranged = in_ranges(df, [order])
    ends = ranged.groupBy(PART).agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    parts = W.orderBy(PART)
    borders = ends.select(PART, F.lag("_last").over(parts).alias("_earlier"), F.lead("_first").over(parts).alias("_later"))
    inside = W.partitionBy(PART).orderBy(order)
    joined = ranged.withColumns({"_p": F.lag(value).over(inside), "_q": F.lead(value).over(inside)}).join(borders, PART)
    return joined.select(*df.columns, F.coalesce("_p", "_earlier").alias(before), F.coalesce("_q", "_later").alias(after))


def _or_constant(keys: list[str]) -> list[Column]:
    return [F.col(key) for key in keys] or [F.lit(0)]
