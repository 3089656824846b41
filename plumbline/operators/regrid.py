"""Regridding by two one-dimensional weight tables, applied one after the other.

Each step is a join with a table of axis size and a sum that combines map-side; the product of the two tables is never
formed. Weights are summed over finite values per field, so a target cell that lacks any of its source
cells, by a null, a non-finite value, a missing row or a place outside the source, is null and can be reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.errors import ContractViolation
from plumbline.functions.scalars import is_finite
from plumbline.operators.coordinates import axis_mismatches, cell_edges


def _with_array(rows: DataFrame, axis: DataFrame, name: str) -> DataFrame:
    """Attach an axis (one entry per grid line) to every row as an array column."""
    entries = axis.agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in axis.columns if c != "idx"]))))
    return rows.withColumn(name, entries.scalar())


def _linear_axis_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """1-D interpolation weights; a target value outside the source axis gets none."""
    rows = _with_array(target.select(F.col("idx").alias("dst_i"), F.col("value").alias("y")), source, "axis")
    intervals = F.transform(
        F.sequence(F.lit(1), F.size("axis") - 1),
        lambda i: F.struct(F.element_at("axis", i).alias("a"), F.element_at("axis", i + 1).alias("b")),
    )
    holding = F.filter(intervals, lambda s: (s["a"]["value"] <= F.col("y")) & (F.col("y") <= s["b"]["value"]))
    # At a shared node both neighbours hold the value; either gives the same result, the first is used.
    found = rows.withColumn("_intervals", intervals).withColumn("s", F.get(holding, F.lit(0))).filter(F.col("s").isNotNull())
    width = F.col("s.b.value") - F.col("s.a.value")
    ends = F.array(
        F.struct(F.col("s.a.idx").alias("src_i"), ((F.col("s.b.value") - F.col("y")) / width).alias("w")),
        F.struct(F.col("s.b.idx").alias("src_i"), ((F.col("y") - F.col("s.a.value")) / width).alias("w")),
    )
    return found.select("dst_i", F.inline(ends)).filter(F.col("w") != 0)


def _overlap_axis_weights(source: DataFrame, target: DataFrame, measure) -> DataFrame:
    """1-D overlap of target cells with source cells as a share of the target cell."""
    edges = cell_edges(target).select(F.col("idx").alias("dst_i"), F.col("low").alias("y0"), F.col("high").alias("y1"))
    rows = _with_array(edges, cell_edges(source).select("idx", "low", "high"), "axis")
    touching = F.filter("axis", lambda s: (s["low"] < F.col("y1")) & (s["high"] > F.col("y0")))
    pairs = rows.withColumn("cell", F.explode(touching))
    low, high = F.greatest("y0", "cell.low"), F.least("y1", "cell.high")
    share = (measure(high) - measure(low)) / (measure(F.col("y1")) - measure(F.col("y0")))
    return pairs.select("dst_i", F.col("cell.idx").alias("src_i"), share.alias("w"))


def _sine(latitude: Column) -> Column:
    return F.sin(F.radians(latitude))


def axis_weights(source: DataFrame, target: DataFrame, method: str, latitude: bool) -> DataFrame:
    """Weights (dst_i, src_i, w) along one axis.

    ``bilinear`` for state fields, ``conservative`` (first order, spherical areas) for precipitation.
    """
    if method == "bilinear":
        return _linear_axis_weights(source, target)
    if method == "conservative":
        return _overlap_axis_weights(source, target, _sine if latitude else lambda x: x)
    raise ContractViolation(f"unsupported regridding method {method!r}")


def _along(rows: DataFrame, weights: DataFrame, axis: str, keys: list[str], fields: list[str]) -> DataFrame:
    """One step: values and their shares (``_n_<field>``) summed over the source lines of one axis."""
    joined = rows.join(weights, rows[axis] == weights["src_i"]).drop(axis, "src_i")
    sums = {f: F.sum(F.col("w") * F.col(f)) for f in fields} | {f"_n_{f}": F.sum(F.col("w") * F.col(f"_n_{f}")) for f in fields}
    grouped = joined.groupBy(*keys, F.col("dst_i").alias(axis))
    return grouped.agg(*[value.alias(name) for name, value in sums.items()])


def apply_weights(
    grid: DataFrame,
    latitude_weights: DataFrame,
    longitude_weights: DataFrame,
    target_axes: tuple[DataFrame, DataFrame],
    keys: list[str],
    fields: list[str],
) -> DataFrame:
    """Every target cell of every key; a field is null where its weights over finite source values do not reach one."""
    shares = {f"_n_{f}": F.when(is_finite(F.col(f)), 1.0).otherwise(0.0) for f in fields}
    finite = grid.select(*keys, "lat_i", "lon_i", *fields).withColumns(shares)
    finite = finite.withColumns({f: F.when(F.col(f"_n_{f}") == 1, F.col(f)).otherwise(0.0) for f in fields})
    rows = _along(finite, latitude_weights, "lat_i", [*keys, "lon_i"], fields)
    rows = _along(rows, longitude_weights, "lon_i", [*keys, "lat_i"], fields)
    frame = grid.select(*keys).distinct()
    for axis, name in zip(target_axes, ("lat_i", "lon_i"), strict=True):
        frame = _with_array(frame, axis.select("idx"), "_axis").select(*keys, *frame.columns[len(keys) :], F.explode("_axis.idx").alias(name))
    complete = [F.when(F.abs(F.col(f"_n_{f}") - 1.0) <= 1e-9, F.col(f)).alias(f) for f in fields]
    return frame.join(rows, [*keys, "lat_i", "lon_i"], "left").select(*keys, "lat_i", "lon_i", *complete)


def incomplete_cells(regridded: DataFrame, fields: list[str]) -> DataFrame:
    """Violations: target cells without a value in one of the fields."""
    missing = F.col(fields[0]).isNull()
    for field in fields[1:]:
        missing = missing | F.col(field).isNull()
    return regridded.filter(missing)


def align(
    grid: DataFrame,
    source_axes: tuple[DataFrame, DataFrame],
    target_axes: tuple[DataFrame, DataFrame],
    keys: list[str],
    fields: list[str],
    method: str,
) -> tuple[DataFrame, str]:
    """Source values on the target grid and the way taken: identity when the grids match, else weights."""
    same = all(axis_mismatches(s, t).isEmpty() for s, t in zip(source_axes, target_axes, strict=True))
    if same:
        return grid, "identity"
    weights = [axis_weights(s, t, method, i == 0) for i, (s, t) in enumerate(zip(source_axes, target_axes, strict=True))]
    return apply_weights(grid, *weights, target_axes, keys, fields), method
