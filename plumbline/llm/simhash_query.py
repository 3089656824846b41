"""SimHash near-duplicates over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.registry import query, table
from plumbline.llm.simhash import near_duplicates


@query()
def op8_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and group of every document; the document whose id is the group's is the one to keep."""
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
        (F.col("doc_id") == F.col("component")).alias("kept"),
    )
