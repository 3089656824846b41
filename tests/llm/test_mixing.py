import math
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing as M


def brute_targets(sizes):
    """Water filling by repeated sharing, as the contract words it."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + ([None] if None in sizes else [])
    weights = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    full = set()
    while True:
        left = total - sum(2 * sizes[n] for n in full)
        rest = sum(weights[n] for n in names if n not in full)
        over = {n for n in names if n not in full and left * weights[n] / rest > 2 * sizes[n]}
        if not over:
            return {n: 2.0 * sizes[n] if n in full else left * weights[n] / rest for n in names}
        full |= over


@pytest.fixture(scope="module")
def mixed(documents):
    rows = [(i, "w " * (i % 23), f"s{i % 5 if i % 3 else 0}") for i in range(900)] + [(i, "x y", None) for i in range(9)]
    rows += [(7, "w " * 7, "s2")] * 3 + [(1, None, "s3"), (None, "a b c", "empty"), (5, " ", "blank")]
    docs = documents(rows)
    return rows, M.mix(docs, ["doc_id", "source"], shards=8, block_words=16).collect()


def test_hypergeometric_draws_follow_their_distribution(spark):
    draws = spark.range(20_000).select(
        M.hypergeometric(*[F.lit(v).cast("long") for v in (9, 4, 3)], M.uniform(1, F.col("id"))).alias("x")
    )
    seen = {r.x: r["count"] / 20_000 for r in draws.groupBy("x").count().collect()}
    for k in range(4):
        assert abs(seen[k] - math.comb(4, k) * math.comb(5, 3 - k) / math.comb(9, 3)) < 0.015


def test_targets_equal_water_filling(mixed):
    rows, found = mixed
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    expected = brute_targets(sizes)
    for r in found:
        assert r.target == pytest.approx(expected[r.source]) and r.source_size == sizes[r.source]


def test_draws_are_disjoint_and_reach_the_targets(mixed):
    rows, found = mixed
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken == sum(d["words"] for d in r.draws) <= 2 * r["size"]
        for number in (0, 1):
            parts = sorted((d["from_word"], d["words"]) for d in r.draws if d["pass"] == number)
            assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:]))
            assert all(0 <= a and a + n <= r["size"] for a, n in parts)
    for r in found:
        assert abs(taken[r.source] - r.target) <= 0.5


def test_shards_are_even_and_reruns_agree(mixed, documents):
    rows, found = mixed
    words = [0] * 8
    for r in found:
        for d in r.draws:
            words[d["shard"]] += d["words"]
    assert max(words) - min(words) <= 16 * 12
    again = M.mix(documents(rows[::-1]), ["doc_id", "source"], shards=8, block_words=16).collect()
    order = lambda r: (str(r.doc_id), str(r.source), r["size"], str(r.draws))
    assert sorted(again, key=order) == sorted(found, key=order)


def test_odd_rows(odd_documents, no_documents, clashing):
    found = M.mix(clashing(odd_documents), ["doc_id"]).collect()
    assert len(found) == 12 and all(r.taken <= 2 * r["size"] for r in found)
    assert M.mix(no_documents, ["doc_id"]).count() == 0


def test_main_path_is_native(documents):
    plan = M.mix(documents([(1, "a b", "x")]), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shards_follow_the_words(documents, monkeypatch):
    monkeypatch.setattr(M, "SHARD_WORDS", 64)
    docs = documents([(i, "w " * 20, f"s{i % 3}") for i in range(100)])
    rows = M.mix(docs, ["doc_id"], block_words=4).collect()
    shards = {d["shard"] for r in rows for d in r.draws}
    assert len(shards) > 32 and max(shards) < 64
