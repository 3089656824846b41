"""Mixing all documents to the sources' targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.mixing import mix
from plumbline.llm.registry import query, table


@query()
def op10_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words the mix takes of every document, and the shards that take them."""
    mixed = mix(table(spark, folder, "documents"), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "draws")
