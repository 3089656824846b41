import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from plumbline.session import written
from tests.llm.conftest import LABEL_SCHEMA
from tests.llm.test_models import corpus
from tests.llm.test_simhash import brute_fingerprint, groups

SECRET = 'token = "586908a73d53ffc7776756ed304e7317d12d4663"'


@pytest.fixture(scope="module")
def stages(spark, documents, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = corpus(400, seed=9)
    rows += [(1000 + i, rows[0][1], "s0") for i in range(30)] + [(0, rows[0][1], "s0"), (None, rows[5][1] + " extra", None)]
    rows += [(2000, f"{rows[7][1]} {SECRET} {rows[8][1]}", "s1"), (2001, None, "s2"), (2002, "", None)]
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABEL_SCHEMA).write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {"input": docs}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, folder), f"test-{name}")
        found[name] = docs
    return folder, labels, found


def rows_of(found, name):
    return [tuple(r) for r in found[name].select(P.COLUMNS).collect()]


def test_stages_keep_the_columns(stages):
    _, _, found = stages
    for name, _ in P.STAGES[:-1]:
        assert found[name].schema.names == P.COLUMNS


def test_quality_keeps_good_documents(stages):
    _, labels, found = stages
    kept = {r[0] for r in rows_of(found, "quality")}
    truth = {i: q for i, q, _ in labels}
    assert np.mean([(i in kept) == bool(q) for i, q in truth.items()]) > 0.97
    assert set(rows_of(found, "quality")) <= set(rows_of(found, "input"))


def test_one_of_each_group_stays(stages):
    _, _, found = stages
    before, after = rows_of(found, "quality"), rows_of(found, "near_duplicates")
    fps = [brute_fingerprint(r[1] or "") for r in before]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    label = groups(pairs, len(fps))
    expected = []
    for g in set(label):
        members = [before[i] for i in range(len(fps)) if label[i] == g]
        expected.append(min(members, key=lambda r: (r[0] is None, r[0] or 0))[0])
    assert sorted(map(str, expected)) == sorted(str(r[0]) for r in after)


def test_secrets_are_hidden_and_nothing_else_changes(stages):
    _, _, found = stages
    before = {r[0]: r for r in rows_of(found, "near_duplicates")}
    after = {r[0]: r for r in rows_of(found, "secrets")}
    assert before.keys() == after.keys()
    for key, row in after.items():
        if key == 2000:
            assert SECRET not in row[1] and "[SECRET]" in row[1] and row[4] == len(row[1])
        else:
            assert row == before[key]


def test_mix_takes_words_of_its_documents_only(stages):
    _, _, found = stages
    before = {r[0]: (r[1] or "").split() for r in rows_of(found, "secrets")}
    total = sum(map(len, before.values()))
    taken = 0
    for key, text, *_, n_chars in rows_of(found, "mixing"):
        words = text.split()
        taken += len(words)
        assert n_chars == len(text)
        assert f" {' '.join(words)} " in f" {' '.join(before[key])} "
    assert abs(taken - 1.5 * total) <= 3


def test_pieces_hold_the_mix(stages):
    _, _, found = stages
    texts = [r[1] or "" for r in rows_of(found, "mixing")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [np.array([*e.ids, 1], dtype="<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    pieces = found["packing"].collect()
    assert sum(r.length for r in pieces) == sum(map(len, ids))
    whole = sorted(zlib.crc32(d.tobytes()) for d in ids)
    uncut = [r.ids_crc32 for r in pieces if r.length == r.doc_tokens]
    assert set(uncut) <= set(whole) and len(uncut) > 0.5 * len(whole)


def test_run_on_all_and_on_no_documents(spark, stages, tmp_path):
    folder, _, found = stages
    first = sorted(map(str, P.run(spark, folder).select("doc_id", "length", "ids_crc32").collect()))
    assert first == sorted(map(str, found["packing"].select("doc_id", "length", "ids_crc32").collect()))
    empty = str(tmp_path / "empty")
    spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 0").write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").filter("doc_id < 0").write.parquet(f"{empty}/labels.parquet")
    assert P.run(spark, empty).count() == 0
    assert not re.search("localCheckpoint", open(P.__file__).read())


def test_cut_texts_keep_their_white_space(spark, documents):
    rows = [(i, "\n".join(f"a{i} \t b{j}\x0b" for j in range(150 + i)), f"s{i % 4}") for i in range(60)] + [(90, "\n\n", "s1"), (91, None, "s1")]
    docs = documents(rows)
    texts = {i: t for i, t, _ in rows}
    cut = 0
    for r in P.mix_sources(spark, docs, "").collect():
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        cut += r.text != texts[r.doc_id]
    assert cut
