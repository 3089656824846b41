"""Texts that name added tokens, against the library as it is loaded from the file."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing as K, token_files as F
from plumbline.llm.tokens import Encoder

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
TEXTS = ["a <|endoftext|> b", "x<|startoftext|>", "<|endoftext|>", "<|endoftext|> <|startoftext|>  <|endoftext|>", "a <|EndOfText|> b"]


def untouched(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name, leading", FILES)
def test_encoder_equals_the_library_default(name, leading):
    rng = random.Random(1)
    parts = ["a", "Word", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", " ", " ", " ", "\n", "é", "."]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000)]
    found = [np.frombuffer(f, "<u4").tolist() for f in Encoder(public_tokenizers.path(name), leading).encode(texts)]
    assert found == [ids.tolist() for ids in untouched(name, texts)]


def test_the_reviewers_ids():
    assert untouched("byte_bpe_50k.json", TEXTS[:1])[0].tolist() == [64, 220, 50256, 275]
    assert untouched("word_bpe_49k.json", TEXTS[:1])[0].tolist() == [320, 49407, 321]


def test_files_and_sequences_hold_these_ids(spark, documents, tmp_path):
    docs = documents([(i, text, "a") for i, text in enumerate(TEXTS)])
    path = str(tmp_path / "files")
    F.write_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    expected = [np.append(ids, 2).astype("<u4") for ids in untouched("byte_bpe_50k.json", TEXTS)]
    rows = {r.doc_id: r for r in F.read_files(spark, path, with_ids=True).collect()}
    for i, ids in enumerate(expected):
        assert (rows[i].n_tokens, rows[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        assert rows[i].start == sum(map(len, expected[:i])) and bytes(rows[i].ids) == ids.tobytes()
    pieces = K.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    assert sum(r.length for r in pieces) == sum(len(ids) + 1 for ids in untouched("word_bpe_49k.json", TEXTS))
