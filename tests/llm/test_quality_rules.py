import random
from collections import Counter

from plumbline.llm import quality_rules as Q


def brute_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)})


def test_repeated_words_equal_brute_force():
    random.seed(1)
    for _ in range(300):
        n, kinds = random.randrange(60), random.choice([1, 2, 3, 50])
        words = [f"w{random.randrange(kinds)}" for _ in range(n)]
        words += words[: random.randrange(20)]
        assert Q.repeated_words(words) == brute_repeats(words)


def test_measures_of_one_text():
    text = "A b#\n\nA b#\nSHOUT x|y x|y\n  \n"
    assert Q.measure(text) == (7, 17, 4, 3, 1, 0, 1, 1)
    assert Q.measure("") == (0,) * 8


def test_every_row_is_judged(odd_documents, no_documents, clashing):
    rows = Q.apply_policy(Q.ledger(clashing(odd_documents))).collect()
    assert len(rows) == 12
    assert all(not r.kept and r.failed_rules & 1 for r in rows if r.n_words < 20)
    assert {r.doc_id for r in rows} >= {None, 2**60 + 1}
    assert Q.apply_policy(Q.ledger(no_documents)).count() == 0


def test_policies_only_add_rules_and_ablations_count(documents):
    good = " ".join(f"word{i}" for i in range(40))
    docs = documents([(1, good, "a"), (2, "short", "a"), (3, good.replace(" ", "# "), "a"), (4, "x x " * 20, "a")])
    rows = Q.ledger(docs)
    kept = {r.doc_id for r in Q.apply_policy(rows).filter("kept").collect()}
    assert kept == {1}
    assert {r.doc_id for r in Q.apply_policy(rows, "base").filter("kept").collect()} == {1, 3}
    found = {r.rule: (r.n_failed, r.n_only_this, r.n_kept_without) for r in Q.ablations(rows).collect()}
    assert found["too_few_words"] == (1, 1, 2)
    assert found["symbols"] == (1, 1, 2)
    assert found["word_length"][0] == 1 and set(found) == set(Q.POLICIES["v2"])
