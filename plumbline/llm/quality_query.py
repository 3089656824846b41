"""Quality scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import quality_model as M
from plumbline.llm.registry import query, table
from plumbline.llm.texts import fold


@query()
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document by a model that never saw the held-out fold's labels."""
    docs = table(spark, folder, "documents")
    scored = M.score(docs, M.fit(docs, table(spark, folder, "labels")), ["doc_id"])
    predicted = (F.col("score") >= M.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", predicted)
