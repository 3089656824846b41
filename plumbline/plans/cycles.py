"""Validity of stored cycles, kept in a log so that a run reads only what has changed.

The log has one row per cycle: how many files it has, a mark made of their paths, sizes and times, its rows, a fingerprint of its
content, and the verdict. A listing alone tells which cycles differ from the log; only their partitions are read. A cycle stays
valid if its content is complete and, where the log knows it, the same as before. Files that cannot be read, or whose
columns have other types, count as rows that are missing: their cycle is pending and the run goes on.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline import contract as C
from plumbline.functions.scalars import content_hash
from plumbline.operators import quality

TIME = "forecast_initialization_time"
STAMP = "yyyy-MM-dd'T'HH"
LOG = "init string, files long, mark decimal(38,0), rows long, fingerprint decimal(38,0), valid boolean"
LOG_COLUMNS = ["init", "files", "mark", "rows", "fingerprint", "valid"]


def long_number(hex_digest: Column) -> Column:
    """Sixty bits of a digest as a decimal, so that sums of any number of rows fit."""
    return F.conv(F.substring(hex_digest, 1, 15), 16, 10).cast("decimal(38,0)")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``init``, ``files`` and ``mark`` of every stored cycle, from the file listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(root)
    place = F.regexp_extract("path", r"/init=([^/]+)/", 1).alias("init")
    one = long_number(F.sha2(F.concat_ws("|", "path", "length", "modificationTime"), 256))
    marked = files.select(place, one.alias("_mark"))
    return marked.groupBy("init").agg(F.count(F.lit(1)).alias("files"), F.sum("_mark").cast("decimal(38,0)").alias("mark"))


def _extra_fields(spark: SparkSession, root: str, inits: list[str]) -> dict[str, T.StructField]:
    """Columns of the cycles' files beyond the contract, from their footers.

    Files that contradict each other cannot be looked at together: the list is halved until they can.
    """
    folders = [f"{root}/year={int(i[:4])}/month={int(i[5:7])}/init={i}" for i in inits]
    try:
        found = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(*folders).schema
    except (PySparkException, Py4JJavaError):
        middle = len(inits) // 2
        return {} if not middle else _extra_fields(spark, root, inits[:middle]) | _extra_fields(spark, root, inits[middle:])
    known = {f.name for f in C.DERIVED_ROW}
    return {f.name: f for f in found if f.name not in known}


def read_stored(spark: SparkSession, root: str, inits: list[str], extra: bool = False) -> DataFrame:
    """Rows of the given cycle partitions, unreadable files left out; with ``extra``, columns beyond the contract too."""
    more = list(_extra_fields(spark, root, inits).values()) if extra and inits else []
    parts = [T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()), T.StructField("init", T.StringType())]
    schema = T.StructType([*C.DERIVED_ROW.fields, *more, *parts])
    table = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("basePath", root).parquet(root)
    return table.filter(F.col("init").isin(inits))


def judged(rows: DataFrame, version: str, rows_per_cycle: int, regions: int) -> DataFrame:
    """``init``, ``rows``, ``fingerprint`` and ``valid`` of every cycle, in one aggregate."""
    spreads = [c for c in rows.columns if "spread" in c]
    names = [f.name for f in C.DERIVED_ROW]
    hashed = rows.withColumn("_row", long_number(content_hash(*names)))
    odd = [F.count(F.when(F.col(c).isNotNull(), 1)).alias(f"_odd_{c}") for c in spreads]
    extra = [F.sum("_row").cast("decimal(38,0)").alias("fingerprint"), *odd]
    one_time = F.countDistinct(TIME).alias("_times")
    stamp = F.min(F.date_format(TIME, STAMP)).alias("_stamp")
    found = quality.cycle_validity(
        hashed, version, rows_per_cycle, regions=regions, cycle="init", finite=C.FORECAST_FEATURES + C.ERROR_COLUMNS, extra=[*extra, one_time, stamp]
    )
    clean = (F.col("_times") == 1) & (F.col("_stamp") == F.col("init"))
    for column in spreads:
        clean = clean & (F.col(f"_odd_{column}") == 0)
    return found.select("init", "rows", "fingerprint", (F.col("valid") & clean).alias("valid"))


def known(spark: SparkSession, path: str | None) -> DataFrame:
    """The log of the last run, empty if there is none."""
    return spark.createDataFrame([], LOG) if path is None else spark.read.schema(LOG).parquet(path)


def changed_inits(present: DataFrame, log: DataFrame) -> list[str]:
    """Stored cycles whose files differ from the log; at most the number of cycles."""
    same = [F.col("p.init") == F.col("l.init"), F.col("p.files") == F.col("l.files"), F.col("p.mark") == F.col("l.mark")]
    return [r.init for r in present.alias("p").join(log.alias("l"), same, "left_anti").collect()]


def current(spark: SparkSession, root: str, log: DataFrame, version: str, rows_per_cycle: int, regions: int, trusted: list[str] | None = None) -> DataFrame:
    """The log brought up to date with what is stored now.

    Unchanged cycles keep their row. Changed ones are read and judged; one whose content is not what the log says is not
    valid, unless it is one of ``trusted``, the cycles that this run has written.
    """
    present = listed(spark, root)
    changed = changed_inits(present, log)
    kept = present.select("init").join(log.filter(~F.col("init").isin(changed)), "init")
    if not changed:
        return kept.select(LOG_COLUMNS)
    verdicts = judged(read_stored(spark, root, changed, extra=True), version, rows_per_cycle, regions)
    before = log.select("init", F.col("fingerprint").alias("_before"))
    own = F.col("init").isin(trusted or [])
    same = own | F.col("_before").isNull() | (F.col("_before") == F.col("fingerprint"))
    again = (
        present.filter(F.col("init").isin(changed))
        .join(verdicts, "init", "left")
        .join(before, "init", "left")
        .select(
            "init", "files", "mark", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
            F.when(same, F.col("fingerprint")).otherwise(F.col("_before")).alias("fingerprint"),
            F.coalesce(F.col("valid") & same, F.lit(False)).alias("valid"),
        )
    )
    return kept.select(LOG_COLUMNS).unionByName(again)
