"""Secret spans of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.registry import query, table
from plumbline.llm.secrets import secret_spans


@query()
def op2_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and hash, and the spans of all layers, for every document."""
    found = secret_spans(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )
