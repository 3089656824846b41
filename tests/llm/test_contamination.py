import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import contamination as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(texts, items):
    """Words, hits and items of every text, by looking at every place."""
    windows = {}
    for name, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if name is None else str(name))
    found = []
    for text in texts:
        w, hit, names = words(text), set(), set()
        for size in range(1, 11):
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    names |= windows[tuple(w[i : i + size])]
        found.append((len(w), len(hit), sorted(names, key=lambda s: s.encode())))
    return found


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string").repartition(2)


def result(docs, items, **more):
    rows = C.contaminated(docs, items, ["doc_id"], **more).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows)


def expected(rows, items):
    found = brute([t for _, t, _ in rows], items)
    return sorted((i if i is not None else -1, n, hit, names, hit > 0) for (i, _, _), (n, hit, names) in zip(rows, found))


def test_random_texts_equal_brute_force(documents, items, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)  # many blocks, so that windows lie across their ends
    rng = random.Random(5)
    vocabulary = ["a", "b", "The", "É", "é", "x9", "漢字", "Z"]

    def say(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", "-", ".\n", "\x00"]) for _ in range(n))

    bench = [(i, say(rng.choice([1, 2, 3, 4, 5, 7, 9, 10, 11, 14]))) for i in range(12)] + [(3, say(12)), (None, say(10))]
    bench += [(100, bench[-1][1]), (101, ""), (102, None), (103, "...")]
    rows = []
    for i in range(150):
        text = say(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            _, passage = rng.choice(bench)
            at = rng.randrange(len(text) + 1)
            text = f"{text[:at]} {(passage or '').upper() if rng.random() < 0.3 else passage or ''} {text[at:]}"
        rows.append((i % 140, text, "s"))
    rows += rows[:5] + [(None, rows[0][1], None), (500, None, "s"), (501, "", "s"), (502, " .-\x00", "s")]
    found = result(documents(rows), items(bench))
    assert found == expected(rows, bench)
    assert any(r[2] for r in found) and any(r[1] and not r[2] for r in found)


def test_windows_share_hot_shingles_and_copies(documents, items):
    """A passage in most documents, common words everywhere, many items with one window."""
    passage = "one two three four five six seven eight nine ten"
    bench = [(i, passage) for i in range(50)] + [(60, f"the the the the the {passage} the the the the the"), (61, "the " * 10)]
    rows = [(i, f"lead {i % 3} {passage} the the end", "s") for i in range(300)] + [(900, "the " * 500, "s"), (901, "the " * 9, "s")]
    assert result(documents(rows), items(bench)) == expected(rows, bench)


def test_full_filter_loses_nothing(documents, items, monkeypatch):
    """A filter far too small lets everything through; the result is the same."""
    monkeypatch.setattr(C, "MOST_BITS", 64)
    bench = [(i, " ".join(f"w{i * 7 + j}" for j in range(12))) for i in range(40)]
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 30)), "s") for i in range(0, 200, 9)]
    assert result(documents(rows), items(bench)) == expected(rows, bench)


def test_odd_rows_and_empty_tables(odd_documents, no_documents, items, clashing):
    bench = [(1, "the quick BROWN fox jumps over the lazy dog again"), (2, "word5 other5 word6 other6"), (3, "overraschung"), (4, "don t endoftext")]
    rows = [(r.doc_id, r.text, r.source) for r in odd_documents.collect()]
    clash = clashing(items(bench)).withColumn("win", F.lit(1))
    found = result(clashing(odd_documents).withColumn("key", F.lit("clash")), clash)
    assert found == expected(rows, bench)
    assert result(no_documents, items(bench)) == []
    assert result(odd_documents, items([])) == expected(rows, [])
    carried = C.contaminated(odd_documents.withColumn("n_hit", F.lit("mine")), items(bench), ["doc_id", "lang", "n_hit"])
    assert carried.columns == ["doc_id", "lang", "n_words", "n_hit", "n_items", "items", "contaminated"]


def test_plan_stays_in_spark_functions(documents, items):
    plan = C.contaminated(documents([(1, "a b c", "s")]), items([(1, "a b")]), ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search(r"ArrowEval|BatchEvalPython|MapInArrow|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin", plan)
