"""Quality classifier: random-indexing word vectors pooled per document, then a small network.

Tokens are runs of letters, digits or other marks; each token also counts under its shape (lower, Capital, UPPER,
number, mark), so that words never seen before still carry something. Tokens are hashed to ``SLOTS`` slots, which
bounds the vocabulary whatever the corpus holds. Every slot has a sparse random index vector of ``DIM`` numbers, -1, 0
or 1. Random indexing gives a slot the sum of the index vectors found within ``REACH`` tokens of it; it is
accumulated by Spark over the whole texts of a bounded labelled sample (``SAMPLE_ROWS``), per slot and without a
dense matrix in any task but the last.

A document is the mean of its slots' vectors, the mean of their index vectors squared in length (how concentrated its
words are), the same for its lines and neighbouring pairs, and its log length. A network with one hidden layer, written in
numpy, is fitted on part of the sample, and its temperature on the rest, so that scores are probabilities.

Null and empty texts pool to zero and get the score of a document without words. Rows are scored one by one, so
repeated rows and null ids change nothing. Without labelled rows of both kinds the score is the share of label 1
among the rows there are, or 0.5 without any. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.texts import labelled_sample, map_columns

SLOTS, DIM, NONZERO, REACH = 1 << 15, 64, 8, 2
#: Largest number of labelled documents a model is fitted on.
SAMPLE_ROWS = 6000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
THRESHOLD = 0.7
#: Tasks that accumulate word vectors of the bounded sample.
FIT_PARTS = 8

TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def index_vectors() -> np.ndarray:
    """The sparse random index vectors, the same in every process."""
    random = np.random.default_rng(1)
    found = np.zeros((SLOTS, DIM), dtype=np.float32)
    at = np.argsort(random.random((SLOTS, DIM)), axis=1)[:, :NONZERO]
    found[np.arange(SLOTS)[:, None], at] = random.choice(np.array([-1, 1], dtype=np.float32), (SLOTS, NONZERO))
    return found / np.sqrt(NONZERO)


def shape(token: str) -> str:
    """Class of a token: it is counted like a word of its own."""
    if token.islower():
        return "\0lower"
    if token.isupper():
        return "\0UPPER" if len(token) > 1 else "\0U"
    if token.istitle():
        return "\0Title"
    return "\0number" if token[0].isdigit() else "\0mark" if not token.isalpha() else "\0mixed"


class Slots:
    """Slot and shape slot of tokens; remembers as many as ``keep`` tokens, which changes speed only."""

    def __init__(self, keep: int = 200_000) -> None:
        self.known: dict[str, tuple[int, int]] = {}
        self.keep = keep

    def of(self, token: str) -> tuple[int, int]:
        found = self.known.get(token)
        if found is None:
            found = slot(token), slot(shape(token))
            if len(self.known) < self.keep:
                self.known[token] = found
        return found


def slot(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % SLOTS


def context_sums(tokens: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and the sums of the index vectors around their occurrences."""
    around = np.zeros((len(tokens), DIM), dtype=np.float32)
    for step in range(1, REACH + 1):
        around[step:] += index[tokens[:-step]]
        around[:-step] += index[tokens[step:]]
    slots, place = np.unique(tokens, return_inverse=True)
    sums = np.zeros((len(slots), DIM), dtype=np.float32)
    np.add.at(sums, place, around)
    return slots, sums


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Unit-length context vectors per slot, summed over the sample by Spark; their size is fixed."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, slots = index_vectors(), Slots()
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for text in batch["text"]:
                tokens = np.array([slots.of(t)[0] for t in TOKENS.findall(text)], dtype=np.int64)
                if len(tokens):
                    for at, vector in zip(*context_sums(tokens, index)):
                        total[at] = total[at] + vector if at in total else vector
        keys = sorted(total)
        yield pd.DataFrame({"slot": keys, "sums": [total[k].astype("<f4").tobytes() for k in keys]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["slot", "sums"], ignore_index=True)
        parts = np.stack([np.frombuffer(s, dtype="<f4") for s in rows["sums"]]).astype(np.float64)
        first = np.flatnonzero(np.diff(rows["slot"].to_numpy(), prepend=-1))
        total = np.add.reduceat(parts, first, axis=0).astype("<f4")
        return pd.DataFrame({"slot": rows["slot"].to_numpy()[first], "sums": [v.tobytes() for v in total]})

    kind = "slot long, sums binary"
    per_part = sample.select("text").repartition(FIT_PARTS, F.xxhash64("text")).mapInPandas(sums, kind)
    merged = per_part.groupBy(F.pmod("slot", F.lit(FIT_PARTS))).applyInPandas(merge, kind).toArrow().to_pandas()
    found = np.zeros((SLOTS, DIM), dtype=np.float32)
    if len(merged):
        found[merged["slot"].to_numpy()] = np.stack([np.frombuffer(s, dtype="<f4") for s in merged["sums"]])
        common = found[merged["slot"].to_numpy()].mean(axis=0)
        found[merged["slot"].to_numpy()] -= common
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-6)


def _concentration(parts: Counter) -> float:
    counts = np.fromiter(parts.values(), dtype=np.float64)
    return float(np.square(counts / counts.sum()).sum() - 1 / counts.sum()) if len(counts) else 0.0


def pooled(text: str, vectors: np.ndarray, index: np.ndarray, slots: Slots) -> np.ndarray:
    """The features of one whole text."""
    tokens = TOKENS.findall(text)
    out = np.zeros(2 * DIM + 5, dtype=np.float32)
    if not tokens:
        return out
    counts = Counter(tokens)
    pairs = [slots.of(t) for t in counts]
    word, form = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    share = np.fromiter(counts.values(), dtype=np.float32) / len(tokens)
    out[:DIM] = share @ vectors[word]
    out[DIM : 2 * DIM] = share @ index[form]
    echoes = sum(a == b for a, b in zip(tokens, tokens[1:])) / len(tokens)
    lines = Counter(line for line in text.split("\n") if line.strip())
    marks = sum(n for t, n in counts.items() if not t[0].isalnum()) / len(tokens)
    out[2 * DIM :] = (_concentration(counts), _concentration(lines), echoes, marks, np.log1p(len(tokens)) / 10)
    return out


@dataclass
class Network:
    """Standardisation, two layers and the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0
    fixed: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss of four fifths of the rows, then the temperature with the least loss on the others."""
    if len(y) < 10 or y.min() == y.max():
        return Network(np.zeros(0), np.ones(0), [], fixed=float(y.mean()) if len(y) else 0.5)
    random = np.random.default_rng(2)
    order = random.permutation(len(y))
    held, used = order[::5], np.delete(order, slice(None, None, 5))
    net = Network(
        x[used].mean(axis=0),
        x[used].std(axis=0) + 1e-3,
        [
            random.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN),
            np.zeros(1),
        ],
    )
    z = (x - net.mean) / net.scale
    first, second = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers]
    steps = 0
    for _ in range(EPOCHS):
        shuffled = random.permutation(used)
        for at in range(0, len(shuffled), 64):
            rows = shuffled[at : at + 64]
            w1, b1, w2, b2 = net.layers
            hidden = np.maximum(z[rows] @ w1 + b1, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, w2) * (hidden > 0)
            slopes = [z[rows].T @ back + DECAY * w1, back.sum(0), hidden.T @ error + DECAY * w2, np.array([error.sum()])]
            steps += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                rate = RATE * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
                net.layers[i] = net.layers[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)
    logits, truth = net.logits(x[held]), y[held]
    grid = np.exp(np.linspace(np.log(0.3), np.log(8), 60))
    losses = [np.mean(np.logaddexp(0, np.where(truth == 1, -logits, logits) / t)) for t in grid]
    net.temperature = float(grid[int(np.argmin(losses))])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def features(self, texts: list[str], index: np.ndarray, slots: Slots) -> np.ndarray:
        return np.stack([pooled(text, self.vectors, index, slots) for text in texts])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Word vectors and network of at most ``rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", folds, held_out, rows)
    model = QualityModel(word_vectors(sample), Network(np.zeros(0), np.ones(0), [], fixed=0.5))
    sent = sample.sparkSession.sparkContext.broadcast(model.vectors.astype(np.float16))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, index, slots = sent.value.astype(np.float32), index_vectors(), Slots()
        for batch in batches:
            rows = [pooled(text, own, index, slots).astype("<f4").tobytes() for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": rows})

    found = sample.mapInPandas(featured, "doc_id long, label int, x binary").toArrow().to_pandas()
    found = found.sort_values(["doc_id", "x"], ignore_index=True)
    if len(found):
        x = np.stack([np.frombuffer(v, dtype="<f4") for v in found["x"]]).astype(np.float64)
        model.network = fit_network(x, found["label"].to_numpy(dtype=np.float64))
    else:
        model.network = fit_network(np.zeros((0, 1)), np.zeros(0))
    return model


def score(docs: DataFrame, model: QualityModel, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` and ``score``, the probability of label 1, of every row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.vectors.astype(np.float16), model.network))

    def begin() -> Callable[[list], list]:
        vectors, network = sent.value
        vectors, index, slots = vectors.astype(np.float32), index_vectors(), Slots()

        def make(texts: list) -> list:
            x = [pooled(value or "", vectors, index, slots) for value in texts]
            return [network.scores(np.stack(x).astype(np.float64)) if x else []]

        return make

    return map_columns(docs, carry, [text], [T.StructField("score", T.DoubleType())], begin)
