import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import mixing_coder as C, packing as K, token_files as F
from plumbline.llm.tokens import Encoder

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def direct(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name, leading", FILES)
def test_encoder_equals_the_tokenizer(name, leading):
    rng = random.Random(0)
    alphabet = list("ab é'’.,!?12 \n\t_-ßÉ́​ ñ漢字½²\x01\x1c\x0b s't  ") + ["'s ", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "a ", " a", "<|endoftext|> x", "word. word, (word) don't 'tis", "x" * 5000, "a\nb\n c"]
    found = Encoder(public_tokenizers.path(name), leading).encode(texts)
    assert all(np.array_equal(np.frombuffer(f, "<u4"), d) for f, d in zip(found, direct(name, texts)))


def test_coded_blocks_round_trip_and_notice_damage():
    random_ids = np.random.default_rng(1)
    blocks = [random_ids.integers(0, 50_257, n).astype("<u4") for n in (1, 2, 5, 100, 4096)]
    blocks += [np.zeros(3000, "<u4"), np.arange(4096, dtype="<u4"), np.array([2**32 - 1] * 3, "<u4")]
    blocks += [np.tile(np.arange(7, dtype="<u4"), 300), random_ids.zipf(1.3, 4000).clip(0, 60_000).astype("<u4")]
    coded = C.encode_blocks(blocks)
    joined = C.split_blocks(b"".join(coded))
    assert all(np.array_equal(a, b) for a, b in zip(blocks, C.decode_blocks(joined)))
    assert [C.decode_blocks([c])[0].tolist() for c in coded[::-1]] == [b.tolist() for b in blocks[::-1]]
    assert len(coded[5]) < 200 and len(coded[8]) < 200
    for at in (0, 30, len(coded[4]) - 1):
        damaged = bytearray(coded[4])
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            C.decode_blocks([bytes(damaged)])
    assert C.encode_blocks([]) == [] and C.split_blocks(b"") == []


def test_symbols_at_the_borders_of_strides():
    """Every symbol is found again, whichever stride it lies in; the counts searched are 32 bits wide."""
    blocks = []
    for distinct in (1, 63, 64, 65, 127, 128, 129, 4095, 4096):
        ids = np.arange(distinct, dtype="<u4") * 7
        blocks += [ids, ids[::-1].copy(), np.resize(ids[max(0, distinct - 3) :], 2000)]
    for block, found in zip(blocks, C.decode_blocks(C.encode_blocks(blocks))):
        assert np.array_equal(block, found)
    assert C.Model(np.array([5, 64])).upto.dtype == np.int32


def test_files_give_every_document_back(spark, odd_documents, no_documents, clashing, tmp_path):
    path = str(tmp_path / "files")
    F.write_files(clashing(odd_documents), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(F.read_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and len(rows) == 12
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
        at += r.n_tokens
    texts = sorted(t or "" for (t,) in odd_documents.select("text").collect())
    expected = sorted(np.append(d, 2).astype("<u4").tobytes() for d in direct("byte_bpe_50k.json", texts))
    assert sorted(bytes(r.ids) for r in rows) == expected
    empty = str(tmp_path / "empty")
    F.write_files(no_documents, empty, public_tokenizers.path("byte_bpe_50k.json"))
    assert F.read_files(spark, empty).count() == 0


def test_assignment_covers_every_token_without_padding():
    random_lengths = np.random.default_rng(2)
    for n in (1, 3, 200):
        lengths = random_lengths.zipf(1.2, n).clip(1, 9000)
        pieces = K.assign(lengths)
        fill = {}
        for document, start, length, at, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert offset == fill.get(at, 0) and length > 0
            fill[at] = offset + length
        assert all(v == 2048 or v & (v - 1) == 0 for v in fill.values())
        for document in range(n):
            own = sorted((s, k) for d, s, k, _, _ in pieces if d == document)
            assert own[0][0] == 0 and sum(k for _, k in own) == lengths[document]
            assert all(a + k == b for (a, k), (b, _) in zip(own, own[1:]))


def test_costs_are_balanced():
    lengths = np.concatenate([np.full(40, 1000), np.full(900, 50)])
    cost = {}
    for _, _, length, at, _ in K.assign(lengths):
        cost[at] = cost.get(at, 0) + K.LINEAR * length + K.QUADRATIC * length**2
    full = [c for at, c in cost.items() if at < lengths.sum() // 2048]
    assert max(full) / min(full) < 1.5


def test_packed_pieces_hold_the_documents_ids(odd_documents, no_documents, clashing):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = K.pack(clashing(odd_documents), path, with_ids=True, window=5000).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    texts = [t or "" for (t,) in odd_documents.select("text").collect()]
    assert sum(r.length for r in rows) == sum(len(d) + 1 for d in direct("word_bpe_49k.json", texts))
    long = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == 5)
    expected = direct("word_bpe_49k.json", [max(texts, key=len)])[0]
    assert b"".join(ids for _, ids in long) == np.append(expected, 1).astype("<u4").tobytes()
    assert 2**60 + 1 in {r.doc_id for r in rows} and None in {r.doc_id for r in rows}
    assert K.pack(no_documents, path).count() == 0


def test_confident_blocks_keep_an_interval_for_every_id():
    """Both guesses sure, different and wrong late in a block: order 0 is left with its smallest share."""
    rng = random.Random(2)
    blocks = []
    for loops in (1, 5, 20, 50):
        ids, fresh = [], iter(range(1000, 10_000))
        for _ in range(40):
            ids += [50, 51, 52, rng.randrange(60, 90)]
        for _ in range(700):
            ids += [next(fresh), 51, 53]
        run = [next(fresh) for _ in range(loops)]
        while len(ids) + loops < 4086:
            ids += run
        ids += [next(fresh), 50, 51, next(fresh)]
        blocks.append(np.array(ids[:4096], dtype="<u4"))
    for seed in range(30):  # two or three ids, then a long run of one context, then surprises
        rng = random.Random(seed)
        ids = [rng.choice([1, 2, 3]) for _ in range(rng.randrange(2000))] + [1, 2, 3] * 600
        ids = ids[: 4096 - 40] + [rng.choice([1, 2, 3, rng.randrange(10**6)]) for _ in range(40)]
        blocks.append(np.array(ids, dtype="<u4"))
    blocks.append(np.arange(4096, dtype="<u4"))
    for block, found in zip(blocks, C.decode_blocks(C.encode_blocks(blocks))):
        assert (block == found).all()


@pytest.mark.parametrize("name, leading", FILES)
def test_memory_of_pieces(name, leading):
    """Words are met again beside marks and line feeds, and what is forgotten changes no id."""
    path = public_tokenizers.path(name)
    encoder = Encoder(path, leading)
    list(encoder.encode(["alpha beta.\ngamma, alpha"]))
    before = len(encoder.known)
    list(encoder.encode(["gamma beta.\ngamma, beta,\ngamma beta"] * 2))
    assert len(encoder.known) == before
    rng = random.Random(3)
    small = Encoder(path, leading, keep=20)
    for _ in range(30):
        texts = [" ".join(f"{rng.choice('abcd')}{rng.choice('xyz')}é{rng.randrange(5)}" for _ in range(20)) for _ in range(4)]
        texts += ["", "\0 a", "a\0b.c", "\n", " ", "a  b", "Σας ΣΑΣ. İi", "=\u0338 a=\u0338", "x\ny", "\nx\n"]
        rng.shuffle(texts)
        found = [np.frombuffer(ids, "<u4").tolist() for ids in small.encode(texts)]
        assert found == [ids.tolist() for ids in direct(name, texts)]
    assert len(small.known) <= 10 + 100 and len(small.starts) == len(small.known) + 1


def test_tasks_of_a_process_share_their_encoder():
    from plumbline.llm.tokens import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    assert encoder(path, False) is encoder(path, False)
    assert encoder(path, False) is not encoder(path, False, 10)


def test_blocks_are_dealt_into_groups_of_like_size(monkeypatch):
    """A few blocks beyond the lanes take no steps of their own beside almost empty lanes."""
    sizes = []
    coded, decoded = C._encode, C._decode
    monkeypatch.setattr(C, "LANES", 8)
    monkeypatch.setattr(C, "_encode", lambda blocks: sizes.append(len(blocks)) or coded(blocks))
    monkeypatch.setattr(C, "_decode", lambda blocks: sizes.append(len(blocks)) or decoded(blocks))
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 90, n).astype("<u4") for n in (50, 7, 50, 33, 1, 50, 64, 65, 31)]
    for block, found in zip(blocks, C.decode_blocks(C.encode_blocks(blocks))):
        assert np.array_equal(block, found)
    assert sorted(sizes) == [4, 4, 5, 5]


def test_carries_and_guesses_of_the_least_chance():
    """Many lanes of like contents, in which order 1's guess holds again long after it failed for long."""
    blocks = []
    for seed in range(300):
        rng = np.random.default_rng(seed)
        ids = rng.zipf(1.2 + seed % 5 / 10, 400).clip(0, 2**32 - 1).astype("<u4")
        blocks.append(np.concatenate([ids, np.tile(ids[:20], 5), ids[::-1], np.repeat(ids[:50], 3)])[: 400 + seed])
    coded = C.encode_blocks(blocks)
    for block, found in zip(blocks, C.decode_blocks(coded)):
        assert np.array_equal(block, found)
    assert all(len(c) < 60 + 6 * len(b) for b, c in zip(blocks, coded))
