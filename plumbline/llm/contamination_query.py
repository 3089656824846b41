"""Passages of the benchmark in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.contamination import contaminated
from plumbline.llm.registry import query, table

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, size, w[i:i + size - 1] AS win
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (
  SELECT r, size, i, w[i:i + size - 1] AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
met AS (SELECT r, p.size, i, item_id FROM places p JOIN wins USING (size, win)),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM met, range(10) AS s(k) WHERE k < size GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS id FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h USING (r) LEFT JOIN items m USING (r)
"""


@query(_SQL)
def op13_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in a window of the benchmark, and the items the windows come from."""
    found = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")
