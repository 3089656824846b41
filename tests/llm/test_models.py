import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality_model as Q, toxicity_model as X
from plumbline.llm.texts import fold
from tests.llm.conftest import LABEL_SCHEMA

SYLLABLES = ["ba", "lo", "mi", "ter", "san", "ku", "rel", "dor", "vin", "pa"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))


def corpus(n=700, seed=1):
    """Clean prose, junk with marks, and prose with insults or invented toxic stems."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [word(rng) for _ in range(rng.randrange(25, 80))]
        bad, toxic = rng.random() < 0.25, rng.random() < 0.25
        if bad:
            words = [w + rng.choice(["###", "***", "%%%"]) for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Moron", "zugrakvin", "zugrakpa", "you stupid"]))
        rows.append((i, " ".join(words) + ".", f"s{i % 3}"))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark, documents):
    rows, labels = corpus()
    docs, marks = documents(rows), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], LABEL_SCHEMA)
    return docs, labels, Q.fit(docs, marks), X.fit(docs, marks)


def accuracy(docs, labels, scored, which, folds, held):
    truth = {r[0]: r[which] for r in labels}
    rows = scored.withColumn("held", fold("doc_id", folds, held)).filter("held").collect()
    assert len(rows) > 100
    return np.mean([(r.score >= 0.7) == bool(truth[r.doc_id]) for r in rows])


def test_quality_on_the_held_out_fold(learned):
    docs, labels, quality, _ = learned
    assert accuracy(docs, labels, Q.score(docs, quality, ["doc_id"]), 1, 4, 2) > 0.95


def test_toxicity_on_the_held_out_fold(learned):
    docs, labels, _, toxicity = learned
    assert accuracy(docs, labels, X.score(docs, toxicity, ["doc_id"]), 2, 3, 1) > 0.95


def test_held_out_labels_are_never_used(spark, documents, learned):
    docs, labels, quality, toxicity = learned
    flipped = spark.createDataFrame(labels, LABEL_SCHEMA)
    q = flipped.withColumn("quality", F.when(fold("doc_id", 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    x = flipped.withColumn("toxic", F.when(fold("doc_id", 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    probe = documents([(1, "ba lo mi###", "a"), (2, "you idiot ter san", "b")])
    for model, fit, mark, first in ((Q, Q.fit, q, quality), (X, X.fit, x, toxicity)):
        again = model.score(probe, fit(docs, mark), ["doc_id"]).collect()
        before = model.score(probe, first, ["doc_id"]).collect()
        assert sorted(round(r.score, 5) for r in again) == sorted(round(r.score, 5) for r in before)


def test_odd_rows_get_scores(learned, odd_documents, no_documents, clashing):
    for module, model in ((Q, learned[2]), (X, learned[3])):
        rows = module.score(clashing(odd_documents), model, ["doc_id", "n"]).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows) and rows[0].n == "clash"
        assert {r.doc_id for r in rows} >= {None, 2**60 + 1}
        assert module.score(no_documents, model, ["doc_id"]).count() == 0


def test_without_usable_labels(spark, documents, no_documents):
    docs = documents([(i, f"some words here {i}", "a") for i in range(30)])
    none = spark.createDataFrame([], LABEL_SCHEMA)
    ones = spark.createDataFrame([(i, 1, 1) for i in range(30)], LABEL_SCHEMA)
    assert {r.score for r in Q.score(docs, Q.fit(docs, none), ["doc_id"]).collect()} == {0.5}
    assert {r.score for r in X.score(docs, X.fit(docs, none), ["doc_id"]).collect()} == {0.0}
    assert {r.score for r in Q.score(docs, Q.fit(docs, ones), ["doc_id"]).collect()} == {1.0}
    assert {r.score for r in X.score(docs, X.fit(no_documents, ones), ["doc_id"]).collect()} == {0.0}


def test_isotonic_regression_is_monotone_and_pools():
    sums, y = np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0])
    found = X.Isotonic.fit(sums, y)(np.linspace(-1, 4, 50))
    assert (np.diff(found) >= 0).all()
    assert X.Isotonic.fit(sums, y).at.tolist() == [0.0, 1.5, 3.0]


def test_trees_split_where_labels_change():
    x = np.random.default_rng(0).random((600, 3))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    assert (((X.boost(x, y).sums(x) > 0) == y).mean()) > 0.95


def test_disguises_are_seen():
    lexicon = X.Lexicon({})
    at = X.FEATURES.index
    for text in ("you 1d1ot", "st0o0opid m0ron", "what an i.d.i.o.t he is", "you are a l0ser"):
        assert X.features(text, lexicon)[at("disguised")] > 0, text
    plain = X.features("a plain sentence with 3 numbers 12 and 1st place", lexicon)
    assert plain[at("disguised")] == plain[at("insults")] == 0
    assert X.features("You utter idiot", lexicon)[at("near_person")] == 1


def test_the_sample_is_bounded_in_rows(spark, documents):
    from plumbline.llm.texts import labelled_sample

    docs = documents([(4, f"text {i % 5}", "a") for i in range(500)] + [(5, None, "a"), (6, "x", "a")])
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    found = labelled_sample(docs, labels, "quality", 1, 5, 10).collect()
    assert sorted(r.doc_id for r in found) == [4, 5, 6] and {r.text for r in found} >= {"", "x"}
