"""Near-duplicate vectors over all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.quantised import near_vectors
from plumbline.llm.registry import query, table

_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degrees AS (SELECT a AS vec_id, count(*) AS n FROM linked GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p USING (vec_id) LEFT JOIN degrees d USING (vec_id)
"""


@query(_SQL)
def op3_quantised_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and groups of every vector at cosine 0.9."""
    found = near_vectors(table(spark, folder, "embeddings"))
    kept = F.col("vec_id") == F.col("component")
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), kept.alias("kept"))
