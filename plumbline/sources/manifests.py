"""Partition manifests, checksums and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.errors import ContractViolation
from plumbline.functions.scalars import content_hash, hash_number

# ``binaryFile`` holds one file in one row; data files must stay below this size.
MAX_FILE_BYTES = 2**31 - 1


def file_checksums(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """SHA-256 and size of every file below ``root``, one task per group of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    too_big = files.filter(F.col("length") > MAX_FILE_BYTES).select("path", "length").take(3)
    if too_big:
        raise ContractViolation(f"files too large for a checksum row: {too_big}")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def checksum_differences(actual: DataFrame, recorded: DataFrame) -> DataFrame:
    """Violations: files that are missing, unexpected or changed against the recorded checksums."""
    both = actual.select("path", F.col("sha256").alias("actual")).join(
        recorded.select("path", F.col("sha256").alias("recorded")), "path", "full"
    )
    problem = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("recorded").isNull(), "unexpected")
        .when(F.col("actual") != F.col("recorded"), "changed")
    )
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def table_fingerprint(table: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free fingerprint of the whole content."""
    return table.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(hash_number(content_hash(*table.columns))).alias("fingerprint")
    )


#: Rows under one leaf of a file's digest tree.
BLOCK_ROWS = 1 << 20


def content_digests(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``path``, ``rows``, ``fingerprint`` and ``sha256`` of every file of a Parquet table, whatever the files' sizes.

    Each row's hash includes its place in the file. Blocks of ``BLOCK_ROWS`` rows sum their hashes, which combines map-side in
    constant memory; a file's digest is the hash of its blocks in order. ``fingerprint`` leaves places out: two files with
    the same rows in another order share it.
    """
    return table_parts(table, content_hash(*(columns or table.columns)))


def table_parts(table: DataFrame, content: Column) -> DataFrame:
    """``content_digests`` over any text ``content`` of the rows."""
    content = F.sha2(content, 256)
    row = F.sha2(F.concat_ws("|", F.col("_metadata.row_index").cast("string"), content), 256)
    marked = table.select(
        F.col("_metadata.file_path").alias("path"),
        F.floor(F.col("_metadata.row_index") / BLOCK_ROWS).alias("_block"),
        hash_number(content).alias("_content"),
        *[F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"_h{i}") for i in (0, 1)],
    )
    blocks = marked.groupBy("path", "_block").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_content").alias("fingerprint"), F.sum("_h0").alias("_h0"), F.sum("_h1").alias("_h1")
    )
    leaves = F.array_sort(F.collect_list(F.struct("_block", "rows", "_h0", "_h1")))
    return blocks.groupBy("path").agg(
        F.sum("rows").alias("rows"), F.sum("fingerprint").alias("fingerprint"), F.sha2(F.to_json(leaves), 256).alias("sha256")
    )


def partition_manifest(rows: DataFrame, by: list[str | Column], fingerprint: Column, time: str) -> DataFrame:
    """One row per partition: rows, time coverage and an order-free content fingerprint.

    The fingerprint sums a hash number per row, so it combines map-side for partitions of any size.
    """
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.sum(hash_number(F.sha2(fingerprint, 256))).alias("fingerprint"),
    )


def manifest_gaps(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Expected keys without a partition and partitions nobody expects."""
    missing = expected.select(key).join(present.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = present.select(key).join(expected.select(key), key, "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


def corpus_summary(expected: DataFrame, partitions: DataFrame, key: str, rows_per_cycle: int) -> DataFrame:
    """One-row corpus status: counts, missing and unexpected cycles, ``complete`` only without gaps."""
    gaps = manifest_gaps(expected, partitions, key).agg(
        F.count_if(F.col("problem") == "missing").alias("missing"),
        F.count_if(F.col("problem") == "unexpected").alias("unexpected"),
    )
    wanted = expected.agg(F.count(F.lit(1)).alias("expected_count"))
    have = partitions.agg(F.count(F.lit(1)).alias("completed_count"), F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"))
    one = F.lit(1).alias("_one")
    joined = (
        wanted.select("*", one).join(have.select("*", one), "_one").join(gaps.select("*", one), "_one").drop("_one")
    )
    expected_rows = F.col("expected_count") * rows_per_cycle
    complete = (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("row_count") == expected_rows)
    return joined.withColumns(
        {"expected_row_count": expected_rows, "status": F.when(complete, "complete").otherwise("incomplete")}
    )


def manifest_total_matches(partitions: DataFrame, total: int) -> bool:
    """Whether partition rows add up to the recorded total."""
    return partitions.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] == total
