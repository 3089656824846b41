"""Repair of all conversations after a damage that depends on the row alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.conversations import COUNTS, repair
from plumbline.llm.registry import query, table

_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""


def _add(way: str, cost: str, letter: str, when: str = "true") -> str:
    return f"CASE WHEN {when} THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}'}} ELSE {{'c': 1000000000::BIGINT, 'a': ''}} END"


# Ways to the states nothing (n), after s, u and a: cost and audit, the lesser struct being the better one.
_SQL = f"""
WITH RECURSIVE hurt AS (SELECT *, {_CRC} % 20 AS damage FROM conversations),
once AS (
  SELECT conv_id, turn, damage, CASE WHEN damage = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN damage = 1 THEN '' WHEN damage = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM hurt WHERE damage <> 0),
said AS (SELECT conv_id, turn, role, text FROM once UNION ALL SELECT conv_id, turn, role, text FROM once WHERE damage = 3),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM said),
judged AS (
  SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         right(bare, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier
  FROM placed),
rows AS (SELECT *, NOT blank AND NOT again AS free, (cut AND NOT blank AND NOT again)::BIGINT AS t FROM judged),
convs AS (SELECT DISTINCT conv_id FROM conversations),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS n, {{'c': 1000000000::BIGINT, 'a': ''}} AS s,
         {{'c': 2::BIGINT, 'a': 'I'}} AS u, {{'c': 4::BIGINT, 'a': 'II'}} AS a
  FROM convs
  UNION ALL
  SELECT conv_id, i, n, s, list_min([u, {_add("n", "2", "I")}, {_add("s", "2", "I")}, {_add("a", "2", "I")}]) AS u,
         list_min([a, {_add("list_min([u, " + _add("n", "2", "I") + ", " + _add("s", "2", "I") + ", " + _add("a", "2", "I") + "])", "2", "I")}]) AS a
  FROM (
    SELECT w.conv_id, k.i, {_add("w.n", "3", "D")} AS n,
           list_min([{_add("w.s", "3", "D")}, {_add("w.n", "t", "K", "free AND r = 's'")}]) AS s,
           list_min([{_add("w.u", "3", "D")}, {_add("w.n", "t", "K", "free AND r = 'u'")}, {_add("w.s", "t", "K", "free AND r = 'u'")},
                     {_add("w.a", "t", "K", "free AND r = 'u'")}, {_add("w.n", "(2 + t)", "R", "free")}, {_add("w.s", "(2 + t)", "R", "free")},
                     {_add("w.a", "(2 + t)", "R", "free")}]) AS u,
           list_min([{_add("w.a", "3", "D")}, {_add("w.u", "t", "K", "free AND r = 'a'")}, {_add("w.u", "(2 + t)", "R", "free")}]) AS a
    FROM ways w JOIN rows k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.i = w.i + 1)),
best AS (
  SELECT conv_id, list_min([n, a]) AS way FROM ways
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
letters AS (
  SELECT conv_id, k, audit[k] AS e, k - len(replace(audit[1:k], 'I', '')) AS inserts, len(replace(audit[1:k - 1], 'D', '')) AS j
  FROM (SELECT conv_id, way.a AS audit, unnest(range(1, len(way.a) + 1)) AS k FROM best)),
out AS (
  SELECT l.conv_id, j, e, role, CASE WHEN e = 'I' THEN '' ELSE text END AS text,
         max(CASE WHEN j = 0 AND e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
  FROM letters l LEFT JOIN rows k ON k.conv_id IS NOT DISTINCT FROM l.conv_id AND k.i = l.k - l.inserts AND e <> 'I'
  WHERE e <> 'D'),
mended AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS text
  FROM out GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, sum(t)::BIGINT AS truncated,
         count(*) FILTER (earlier || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, way.c AS cost, way.a AS audit, sha256(coalesce(m.text, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``copies``: rows dropped (0), emptied, without marks, doubled or made user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    damage = F.crc32(name) % 20
    text = F.coalesce(F.col("text"), space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(damage == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1).alias("copies"),
    )


@query(_SQL)
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired messages of every conversation."""
    found = repair(damaged(table(spark, folder, "conversations")), copies="copies")
    return found.select("conv_id", *COUNTS, "audit", "repaired_sha256")
