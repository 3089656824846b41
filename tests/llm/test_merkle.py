import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle as M


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Root of a list of digests, and the path (siblings before and after) of every one."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    paths = []
    for i in range(len(leaves)):
        path, at = [], i
        for level in levels[:-1]:
            first = at // 16 * 16
            path.append(("".join(level[first:at]), "".join(level[at + 1 : first + 16])))
            at //= 16
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof, sorted."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below, subroots = {}, []
    for name in names:
        groups[name].sort()
        top, paths = tree([g[2] for g in groups[name]])
        subroots.append(top)
        below[name] = paths
    root, above = tree(subroots) if names else (None, [])
    found = []
    for name, top, higher in zip(names, subroots, above):
        for (_, _, own, key), path in zip(groups[name], below[name]):
            whole = path + higher
            digest = own
            for before, after in whole:
                digest = h(before + digest + after)
            assert digest == root
            found.append((key, own, top, root, "".join(a + b for a, b in whole)))
    return sorted(found, key=str)


def result(docs):
    rows = M.manifest(docs).select(
        "doc_id", *[M.hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], M.proof().alias("proof"), M.hex_of(M.fold(F.col("leaf"))).alias("folded")
    )
    found = rows.collect()
    assert all(r.folded == r.root for r in found)
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in found], key=str)


def as_rows(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


def test_trees_equal_brute_force(documents):
    """Sources of 1 to 700 rows, ids over many chunks, in both directions, more than 16 sources."""
    rng = random.Random(3)
    rows = []
    for s in range(21):
        n = [1, 2, 16, 17, 256, 257, 700][s % 7] if s < 14 else s
        ids = rng.sample(range(-(2**19), 2**20), n) if s % 2 else [2**62 + i for i in rng.sample(range(5000), n)]
        rows += [(i, f"text {i} {s}", f"s{s}") for i in ids]
    rows += [(i, "x", None) for i in range(40)] + [(7, "é", "\U0001f600"), (8, "a", "￿"), (9, "", "")]
    rng.shuffle(rows)
    docs = documents(rows)
    assert result(docs) == brute(as_rows(docs))


def test_repeated_ids_and_rows(documents):
    rows = [(5, "same", "a")] * 50 + [(5, f"other {i}", "a") for i in range(30)] + [(i, "x", "a") for i in range(40)]
    rows += [(None, "no id", "a")] * 3 + [(None, f"none {i}", "b") for i in range(20)] + [(1, None, "c")] * 2
    docs = documents(rows)
    assert result(docs) == brute(as_rows(docs))


def test_dense_chunks(documents):
    """A chunk with more ids than a sorted list holds becomes a bitmap."""
    docs = documents([(i, None, "a") for i in range(0, 3 * 65536, 17)] + [(i, "y", "b") for i in range(5000)])
    assert result(docs) == brute(as_rows(docs))


def test_one_row_one_source_and_none(documents, no_documents):
    single = documents([(3, "x", "a")])
    assert result(single) == brute(as_rows(single))
    one_source = documents([(i, "x", "a") for i in range(20)])
    assert result(one_source) == brute(as_rows(one_source))
    assert result(no_documents) == []


def test_odd_rows_and_clashing_columns(odd_documents, clashing):
    docs = clashing(odd_documents).withColumn("leaf", F.lit("mine")).withColumn("_id", F.lit(1)).withColumn("at", F.lit(2))
    assert result(docs) == brute(as_rows(odd_documents))
    rows = M.manifest(docs, ["lang", "leaf", "at"])
    assert rows.columns == ["doc_id", "lang", "at", "leaf", "subroot", "root", "path"]


def test_tampered_leaves_do_not_fold(documents):
    docs = documents([(i, f"Text {i}", f"s{i % 3}") for i in range(100)])
    low = M.leaf("doc_id", "source", "lang", "n_chars", F.lower("text"))
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, low)
    rows = M.manifest(docs.withColumn("changed", changed), ["changed"])
    rows = rows.withColumn("ok", M.fold(F.coalesce("changed", "leaf")) == F.col("root")).collect()
    for r in rows:
        assert r.ok == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0)


@pytest.mark.parametrize("size", [1, 100, M.CHUNK // 16, M.CHUNK // 16 + 1, M.CHUNK])
def test_bitmaps_and_ranks(size):
    rng = np.random.default_rng(size)
    low = np.sort(rng.choice(M.CHUNK, size, replace=False))
    count = rng.integers(1, 4, size)
    bits, extra, n = M.pack_ids(low, count)
    assert len(bits) <= M.CHUNK // 8 and n == count.sum()
    again = M.unpack_ids(bits, extra)
    assert (again[0] == low).all() and (again[1] == count).all()
    half = size // 2
    merged = M.merge_ids([M.pack_ids(low[:half], count[:half])[:2], (bits, extra)])
    assert (merged[0] == low).all() and merged[1].sum() == count.sum() + count[:half].sum()
    rows = rng.permutation(np.repeat(low, count))
    ranks = M.Ranks(bits, extra, 1000)
    cut = len(rows) // 3
    at = np.concatenate([ranks.positions(part, np.ones(len(part), np.int64)) for part in (rows[:cut], rows[cut:])])
    assert sorted(at) == list(range(1000, 1000 + n)) and (rows[np.argsort(at)] == np.repeat(low, count)).all()
