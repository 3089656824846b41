import numpy as np
import pytest

from plumbline.llm import quantised as Z


def exact(ids, x, cosine=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T) >= cosine
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


@pytest.fixture(scope="module")
def cloud():
    random = np.random.default_rng(4)
    centres = random.normal(size=(30, 32))
    parts = [random.normal(size=(900, 32)), centres]
    parts += [c + 0.25 * random.normal(size=(8, 32)) for c in centres]
    parts.append(centres[0] + 0.12 * random.normal(size=(400, 32)))
    parts += [np.repeat(centres[1][None], 60, axis=0), 3 * centres[2][None]]
    x = np.concatenate(parts).astype(np.float32)
    return x[random.permutation(len(x))]


@pytest.mark.parametrize("chunk", [2048, 64])
def test_links_and_components_equal_brute_force(spark, cloud, monkeypatch, chunk):
    monkeypatch.setattr(Z, "LIST_CHUNK", chunk)
    monkeypatch.setattr(Z, "QUERY_CHUNK", 2 * chunk)
    ids = list(range(100, 100 + len(cloud)))
    frame = spark.createDataFrame(list(zip(ids, cloud.tolist())), "vec_id long, embedding array<float>").repartition(5)
    links, component = exact(ids, cloud.astype(np.float64))
    rows = {r.vec_id: r for r in Z.near_vectors(frame).collect()}
    found = np.array([rows[i].n_links for i in ids])
    assert found.sum() >= 0.98 * links.sum() and (found <= links).all()
    assert np.mean([rows[i].component == c for i, c in zip(ids, component)]) > 0.99


def test_measured_recall_of_probes(cloud):
    sample = Z.unit_rows(cloud)
    index = Z.Index.fit(sample, 16, 0.9)
    assert index.recall >= Z.RECALL and 1 <= index.probes <= 16


def test_table_distances_never_exceed_their_bound(cloud):
    sample = Z.unit_rows(cloud)
    index = Z.Index.fit(sample, 8, 0.9)
    near, codes, error = index.encode(sample)
    members = np.flatnonzero(near[:, 0] == 3)
    bound = index.bounds(sample[:200], 3, codes[members])
    true = np.linalg.norm(sample[:200][:, None] - sample[members][None], axis=2)
    assert (bound <= true + error[members] + 1e-3).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, -0.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.1]), (None, None), (10, [-1.0, 0.0]),
        (11, [1e-30, 0.0]), (12, [3e38, 1e37]),
    ]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, row int, h1 string")
    found = [(r.vec_id, r.n_links, r.component) for r in Z.near_vectors(frame).collect()]
    assert len(found) == len(rows)
    alone = {i for i, n, c in found if n == 0 and c == i}
    assert alone == {3, 4, 5, 6, 7, 8, 9, 10, None}
    assert sorted((n, c) for i, n, c in found if i in (1, 2, 11, 12)) == [(5, 1)] * 5
    assert Z.near_vectors(frame.filter("vec_id < 0")).count() == 0


def test_small_tables_of_distances_change_nothing(monkeypatch):
    from plumbline.llm import quantised as Q

    rng = np.random.default_rng(4)
    x = Q.unit_rows(rng.normal(size=(700, 16)))
    whole = Q.Index.fit(x, 16, 0.9)
    monkeypatch.setattr(Q, "CELLS", 64)
    small = Q.Index.fit(x, 16, 0.9)
    assert np.allclose(whole.coarse, small.coarse) and whole.probes == small.probes
    for a, b in zip(whole.encode(x), small.encode(x)):
        assert np.allclose(a, b)
