import re

import numpy as np
import xxhash

from plumbline.llm import simhash as S
from plumbline.llm.components import connected


def brute_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, n):
    label = list(range(n))
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label


def near_values(seed, clusters=12, size=40):
    random = np.random.default_rng(seed)
    centres = random.integers(0, 2**63, clusters, dtype=np.uint64)
    flips = np.bitwise_xor.reduce(np.uint64(1) << random.integers(0, 64, (3, clusters * size), dtype=np.uint64), axis=0)
    return np.unique(np.concatenate([np.repeat(centres, size) ^ flips, random.integers(0, 2**63, 100, dtype=np.uint64)]))


def partition(labels):
    found = {}
    for position, label in enumerate(labels):
        found.setdefault(label, set()).add(position)
    return sorted(map(sorted, found.values()))


def test_fingerprint_equals_brute_force():
    texts = ["", " \t", "a", "A b", "a b c", "É x y z w", "a b c d e f g a b c d", "x " * 300, "漢字 é \U0001f600 b c d"]
    assert [S.fingerprint(t) % 2**64 for t in texts] == [brute_fingerprint(t) for t in texts]


def test_unit_joins_what_brute_force_joins():
    values = near_values(3)
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    expected = partition(groups(zip(i, j), len(values)))
    found = S.join_unit(values.view(np.int64), np.zeros(len(values)), 4)
    place = {v: k for k, v in enumerate(values.view(np.int64).tolist())}
    assert partition(groups([(place[a], place[b]) for a, b in zip(found.src, found.dst)], len(values))) == expected


def test_two_sides_find_links_between_them():
    values = near_values(5)
    side = np.arange(len(values)) % 2
    near = (np.bitwise_count(values[:, None] ^ values[None, :]) <= 4) & (side[:, None] != side[None, :])
    expected = partition(groups(zip(*np.nonzero(near)), len(values)))
    found = S.join_unit(values.view(np.int64), side, 4)
    place = {v: k for k, v in enumerate(values.view(np.int64).tolist())}
    assert partition(groups([(place[a], place[b]) for a, b in zip(found.src, found.dst)], len(values))) == expected


def test_routing_and_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 32)
    monkeypatch.setattr(S, "CHUNK", 64)
    values = near_values(7, clusters=6, size=150)
    ids = values.view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in ids], "fp long").repartition(4)
    root = {r.node: r.root for r in connected(S.fingerprint_links(frame)).collect()}
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    assert partition([root.get(v, v) for v in ids]) == partition(groups(zip(i, j), len(ids)))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "src long, dst long")
    found = {r.node: r.root for r in connected(links).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected(links.filter("src < 0")).count() == 0


def test_odd_rows(odd_documents, no_documents, clashing):
    rows = S.near_duplicates(clashing(odd_documents)).collect()
    assert len(rows) == 12
    zero = [r for r in rows if r.fp == 0]
    assert {r.component for r in zero} == {2} and len(zero) == 4
    assert {r.component for r in rows if r.doc_id in (1, 6)} == {1}
    assert [r.component for r in rows if r.doc_id is None and r.fp != 0] == [None]
    assert [r.component for r in rows if r.doc_id == 2**60 + 1] == [2**60 + 1]
    assert S.near_duplicates(no_documents).count() == 0
