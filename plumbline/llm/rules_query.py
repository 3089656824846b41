"""Quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import quality_rules as Q
from plumbline.llm.registry import query, table

_SQL = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM texts),
windows AS (SELECT r, i, w[i:i + 7] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM parts)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(8) AS s(k) GROUP BY r),
measured AS (
  SELECT doc_id, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Z].*[A-Z]', 's') AND NOT regexp_matches(x, '[a-z]'))) AS n_caps_words,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_echoes
  FROM parts LEFT JOIN covered c USING (r)),
judged AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
         + 4 * (10 * n_symbols > n_words)::BIGINT
         + 8 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT
         + 16 * (10 * n_caps_words > 5 * n_words)::BIGINT
         + 32 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT
         + 64 * (10 * n_echoes > 3 * n_words)::BIGINT AS failed_rules
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed_rules = 0 AS kept, failed_rules
FROM judged
"""


@query(_SQL)
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's measurements, failure bits and the current policy's verdict."""
    rows = Q.apply_policy(Q.ledger(table(spark, folder, "documents")))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        Q.fails("base").alias("base_failed"),
        F.col("kept"),
        "failed_rules",
    )
