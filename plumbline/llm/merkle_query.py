"""The manifest of all documents, with every proof checked against rows of which some were tampered with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import merkle as M
from plumbline.llm.registry import query, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leaf_sql(text: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""

_NEXT = "list_transform(range(0, (len(l) + 15) // 16), lambda i: sha256(array_to_string(l[i * 16 + 1:i * 16 + 16], '')))"

# Left and right siblings of element p (from 0) of a level's list l.
_SIDES = """array_to_string(l[p // 16 * 16 + 1:p], '') AS before,
         array_to_string(l[p + 2:p // 16 * 16 + 16], '') AS after"""

_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed
  FROM documents),
docs AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s
  FROM d),
levels AS (
  SELECT s, 0 AS k, list(leaf ORDER BY pos) AS l FROM docs GROUP BY s
  UNION ALL SELECT s, k + 1, {_NEXT} FROM levels WHERE len(l) > 1),
subroots AS (SELECT s, l[1] AS subroot FROM levels WHERE len(l) = 1),
tops AS (
  SELECT 0 AS k, list(subroot ORDER BY s) AS l FROM subroots
  UNION ALL SELECT k + 1, {_NEXT} FROM tops WHERE len(l) > 1),
roots AS (SELECT l[1] AS root FROM tops WHERE len(l) = 1),
steps AS (
  SELECT r, k, {_SIDES} FROM (SELECT r, k, l, (pos // (16 ** k)::BIGINT)::BIGINT AS p FROM docs JOIN levels USING (s) WHERE len(l) > 1)
  UNION ALL
  SELECT r, 1000 + k, {_SIDES} FROM (SELECT r, k, l, (s // (16 ** k)::BIGINT)::BIGINT AS p FROM docs, tops WHERE len(l) > 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS n FROM steps),
folded AS (
  SELECT r, 0::BIGINT AS n, coalesce(changed, leaf) AS digest FROM docs
  UNION ALL
  SELECT f.r, f.n + 1, sha256(before || digest || after) FROM folded f JOIN numbered m ON m.r = f.r AND m.n = f.n + 1),
ends AS (SELECT r, arg_max(digest, n) AS folded_root FROM folded GROUP BY r),
proofs AS (SELECT r, string_agg(before || after, '' ORDER BY n) AS proof FROM numbered GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM docs JOIN subroots USING (s) JOIN ends USING (r) LEFT JOIN proofs USING (r), roots
"""


@query(_SQL)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; tampered leaves do not fold to the root."""
    docs = table(spark, folder, "documents")
    lowered = M.leaf("doc_id", "source", "lang", "n_chars", F.translate("text", _UPPER, _LOWER))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered)
    rows = M.manifest(docs.withColumn("tampered", tampered), ["tampered"])
    folded = rows.withColumn("_folded", M.fold(F.coalesce("tampered", "leaf")))
    return folded.select(
        "doc_id",
        M.hex_of(F.col("leaf")).alias("leaf"),
        M.hex_of(F.col("subroot")).alias("subroot"),
        M.hex_of(F.col("root")).alias("root"),
        F.sha2(M.proof(), 256).alias("proof_sha256"),
        M.hex_of(F.col("_folded")).alias("folded_root"),
        (F.col("_folded") == F.col("root")).alias("verified"),
    )
