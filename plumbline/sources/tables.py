"""Reading and writing the partitioned tables of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline import contract as C
from plumbline.errors import ContractViolation


def read_cycles(spark: SparkSession, root: str, schema: T.StructType = C.DERIVED_ROW) -> DataFrame:
    """All cycle partitions as one table with an explicit schema; an empty corpus is an error."""
    table = spark.read.schema(schema).option("basePath", root).parquet(root).drop("year", "month", "init")
    if table.isEmpty():
        raise ContractViolation(f"no cycle partitions under {root}")
    return table


def read_labelled(spark: SparkSession, root: str) -> DataFrame:
    """Labelled partitions united by column name; optional columns are null where a file lacks them."""
    return spark.read.option("mergeSchema", True).parquet(root)


def with_partition_columns(rows: DataFrame, time: str = "forecast_initialization_time") -> DataFrame:
    """``year`` and ``month`` as columns: filters on them prune partitions, ``year(time)`` would not."""
    return rows.withColumns({"year": F.year(time), "month": F.month(time)})


def write_cycles(rows: DataFrame, root: str, time: str = "forecast_initialization_time", file_rows: int = 1 << 20) -> None:
    """Replace exactly the cycle partitions present in ``rows``; others stay untouched.

    Rows are rebalanced by cycle: small cycles share a task, and adaptive execution splits one that is larger than
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` over many. Files hold at most ``file_rows`` rows.
    """
    stamped = with_partition_columns(rows, time).withColumn("init", F.date_format(time, "yyyy-MM-dd'T'HH"))
    (
        stamped.hint("rebalance", "init")
        .sortWithinPartitions("init", "lead_day", "region_id")
        .write.option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", file_rows)
        .partitionBy("year", "month", "init")
        .mode("overwrite")
        .parquet(root)
    )


def write_labelled(rows: DataFrame, root: str, time: str = "forecast_initialization_time") -> None:
    """Labelled rows by (year, month), ordered by (init, lead, region) inside each file.

    Rows are range-partitioned on time, so one heavy month is spread over several files.
    """
    stamped = with_partition_columns(rows, time)
    (
        stamped.repartitionByRange("year", "month", time, "lead_day", "region_id")
        .sortWithinPartitions("year", "month", time, "lead_day", "region_id")
        .write.option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month")
        .mode("overwrite")
        .parquet(root)
    )


def write_predictions(predictions: DataFrame, root: str) -> None:
    """Held-out predictions of all splits as one table, partitioned by split."""
    predictions.write.partitionBy("split").mode("overwrite").parquet(root)


def register_views(**tables: DataFrame) -> None:
    """Make tables available by name to ``query``."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """Ad-hoc SQL over the registered views with named parameters (``:name``)."""
    return spark.sql(sql, args=parameters)
