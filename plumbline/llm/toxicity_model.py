"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a lexicon of insults and of a lexicon learned from the labelled sample, the same for
disguised spellings (look-alike characters, letters set apart, stretched letters), insults near a second person,
shares of capitals, exclamation and question marks, other punctuation, digits and marks inside words, and length.
The learned lexicon gives a word, and a stem of 4 to 6 letters, the smoothed log ratio of the shares of toxic and
other documents holding it; Spark counts it over the whole texts of the sample. For the training rows it is fitted on
the other half of the sample, so that no row is judged by a word it taught.

The trees (logistic loss, second-order gains over 64 quantile bins) are fitted on a bounded sample
(``SAMPLE_ROWS``) in numpy; isotonic regression on a third of the sample that the trees did not see turns their sums
into probabilities.

Null and empty texts have all features zero and get the probability of such a text. Rows are scored one by one, so
repeated rows and null ids change nothing. Without labelled rows of both kinds the score is the share of label 1
among the rows there are, or 0 without any. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.texts import labelled_sample, map_columns
from plumbline.session import written

#: Largest number of labelled documents a model is fitted on, and of words its learned lexicon keeps.
SAMPLE_ROWS, LEXICON_WORDS = 12_000, 2_000
#: A learned word stands in that many documents at least; its weight is a log ratio of that at least.
LEAST_DOCS, LEAST_WEIGHT = 4, 1.5
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 80, 3, 0.15, 64, 20

#: Insults of the four languages, and second persons.
INSULTS = frozenset(
    "idiot idiots idiotic stupid moron morons moronic imbecile dumb dumbass loser losers scum trash worthless pathetic disgusting "
    "bastard bitch asshole fuck fucking shit bullshit crap retard retarded whore slut filth vermin hate "
    "dumm dummkopf arschloch scheisse scheiße wichser trottel depp abschaum wertlos "
    "idiote imbécile stupide connard salope merde putain ordure débile crétin "
    "idiota estúpido estúpida imbécil tonto mierda puta basura cabrón gilipollas asqueroso".split()
)
PERSONS = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch sie tu toi te ton ta tes vous votre vos usted tú ti tus vosotros".split()
)
LOOKALIKE = str.maketrans("01345789@$!|", "oieastbgasii")
WORD = re.compile(r"[^\W_]+(?:[@$!|*'0-9]+[^\W_]+)*")
APART = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
REACH = 6

FEATURES = (
    "insults",
    "insults_any",
    "learned",
    "learned_best",
    "learned_hits",
    "disguised",
    "near_person",
    "persons",
    "capitals",
    "upper_words",
    "exclaims",
    "questions",
    "marks",
    "digits",
    "inside_words",
    "length",
)


def plain(word: str) -> str:
    """Lower case, look-alikes replaced, stretched letters and marks removed."""
    folded = "".join(c for c in word.lower().translate(LOOKALIKE) if c.isalpha())
    return re.sub(r"(.)\1{2,}", r"\1", folded)


def stems(word: str) -> list[str]:
    """Beginnings of a lower-case word that the learned lexicon may hold, marked by a star."""
    return [word[:n] + "*" for n in (4, 5, 6) if len(word) > n]


class Lexicon:
    """What is known of a word: its weight, and flags; remembers words, which changes speed only."""

    def __init__(self, weights: dict[str, float], keep: int = 200_000) -> None:
        self.weights, self.keep = weights, keep
        self.known: dict[str, tuple[float, bool, bool, bool, bool, bool]] = {}

    def weight(self, low: str) -> float:
        return max([self.weights.get(low, 0.0), *[self.weights.get(stem, 0.0) for stem in stems(low)]])

    def of(self, word: str) -> tuple[float, bool, bool, bool, bool, bool]:
        """Weight, insult, disguised insult, second person, upper case, marks inside."""
        found = self.known.get(word)
        if found is None:
            low = word.lower()
            weight = self.weight(low)
            insult = low in INSULTS or weight >= LEAST_WEIGHT
            odd = not word.isalpha() or any(x == y == z for x, y, z in zip(low, low[1:], low[2:]))
            hidden = False
            if odd and not insult and not word.isdigit():
                form = plain(word)
                hidden = form != low and (form in INSULTS or form in self.weights)
            inside = not word.isalnum()
            found = weight, insult, hidden, low in PERSONS, len(word) > 1 and word.isupper(), inside
            if len(self.known) < self.keep:
                self.known[word] = found
        return found


def features(text: str, lexicon: Lexicon) -> np.ndarray:
    """The dense features of one whole text."""
    out = np.zeros(len(FEATURES), dtype=np.float64)
    if not text:
        return out
    words = WORD.findall(text)
    n = max(1, len(words))
    insults = disguised = persons = upper = learned_hits = inside = 0
    learned = best = 0.0
    targets: set[str] = set()
    people: set[str] = set()
    for word, times in Counter(words).items():
        weight, insult, hidden, person, big, marked = lexicon.of(word)
        if weight:
            learned += times * weight
            learned_hits += times
            best = max(best, weight)
        if insult or hidden:
            targets.add(word)
            if insult:
                insults += times
            else:
                disguised += times
        if person:
            persons += times
            people.add(word)
        upper += times * big
        inside += times * marked
    for match in APART.finditer(text):
        form = plain(match[0])
        if form in INSULTS or form in lexicon.weights:
            disguised += 1
    near = 0
    if targets and people:
        at = np.array([i for i, w in enumerate(words) if w in people])
        hits = np.array([i for i, w in enumerate(words) if w in targets])
        place = np.searchsorted(at, hits)
        left = hits - at[np.maximum(place - 1, 0)]
        right = at[np.minimum(place, len(at) - 1)] - hits
        near = int((((left >= 0) & (left <= REACH)) | ((right >= 0) & (right <= REACH))).sum())
    chars = len(text)
    letters = sum(map(str.isupper, text)) if upper or not text.islower() else 0
    out[:] = (
        insults / n,
        min(insults, 5),
        learned / n,
        best,
        min(learned_hits, 10),
        min(disguised, 5),
        min(near, 5),
        persons / n,
        letters / chars,
        upper / n,
        text.count("!") / n,
        text.count("?") / n,
        sum(map(text.count, "*#$%&@|<>~^")) / n,
        sum(map(text.count, "0123456789")) / chars,
        inside / n,
        np.log1p(n),
    )
    return out


def learned_weights(counts: pd.DataFrame, toxic: int, other: int) -> dict[str, float]:
    """Lexicon of the words and stems much more frequent in toxic documents: columns word, n_toxic, n_other."""
    often = counts[counts["n_toxic"] >= LEAST_DOCS]
    ratio = np.log((often["n_toxic"] + 0.5) / (toxic + 1)) - np.log((often["n_other"] + 0.5) / (other + 1))
    kept = often.assign(ratio=ratio.round(6))[ratio >= LEAST_WEIGHT]
    kept = kept.sort_values(["ratio", "word"], ascending=[False, True]).head(LEXICON_WORDS)
    return dict(zip(kept["word"], kept["ratio"].astype(float)))


@dataclass
class Trees:
    """Complete trees of fixed depth: ``splits`` are (feature, edge) by node, ``leaves`` the values."""

    base: float = 0.0
    splits: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def sums(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for (which, edge), leaf in zip(self.splits, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, which[node]] > edge[node])
            total += leaf[node - (2**DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order gradient boosting with quantile histograms."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(base=float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1)
    sums = np.full(len(y), model.base)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-sums))
        slope, bend = p - y, p * (1 - p)
        which, edge = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = 1e-6
            chosen = -1
            if len(rows) >= 2 * LEAST_ROWS:
                g, h = slope[rows].sum(), bend[rows].sum()
                for f, cuts in enumerate(edges):
                    bins = binned[rows, f]
                    left_g = np.cumsum(np.bincount(bins, slope[rows], len(cuts) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(bins, bend[rows], len(cuts) + 1))[:-1]
                    left_n = np.cumsum(np.bincount(bins, minlength=len(cuts) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                    gain[(left_n < LEAST_ROWS) | (len(rows) - left_n < LEAST_ROWS)] = 0
                    if len(gain) and gain.max() > best:
                        best, chosen = float(gain.max()), f
                        which[at], edge[at] = f, cuts[int(gain.argmax())]
            right = x[rows, which[at]] > edge[at] if chosen >= 0 else np.zeros(len(rows), dtype=bool)
            node[rows] = 2 * at + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, bend, inner + 1)
        values = -RATE * g / (h + 1)
        sums += values[leaf]
        model.splits.append((which, edge))
        model.leaves.append(values)
    return model


@dataclass
class Isotonic:
    """Nondecreasing steps through (sum, label) by pooling neighbours, interpolated between block means."""

    at: np.ndarray
    value: np.ndarray

    @staticmethod
    def fit(sums: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(sums, kind="stable")
        blocks: list[list[float]] = []
        for s, label in zip(sums[order], y[order]):
            blocks.append([float(label), 1.0, float(s)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        rows = np.array(blocks)
        # One pseudo row of either label keeps small blocks away from certainty.
        return Isotonic(rows[:, 2] / rows[:, 1], (rows[:, 0] + 0.2) / (rows[:, 1] + 0.4))

    def __call__(self, sums: np.ndarray) -> np.ndarray:
        return np.interp(sums, self.at, np.maximum.accumulate(self.value))


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    trees: Trees = field(default_factory=Trees)
    calibrated: Isotonic | None = None
    fixed: float = 0.0

    def scores(self, texts: list[str], lexicon: Lexicon) -> np.ndarray:
        if self.calibrated is None or not texts:
            return np.full(len(texts), self.fixed)
        return self.calibrated(self.trees.sums(np.stack([features(t, lexicon) for t in texts])))


def word_counts(sample: DataFrame) -> pd.DataFrame:
    """Per word and stem in ``LEAST_DOCS`` toxic documents or more: toxic and other documents of either half."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for text, label, half in zip(batch["text"], batch["label"], batch["half"]):
                lows = {w.lower() for w in WORD.findall(text)}
                for word in lows.union(*map(stems, lows)):
                    total[word, half, label] += 1
            keys = list(total)
            yield pd.DataFrame(
                {
                    "word": [k[0] for k in keys],
                    "half": [k[1] for k in keys],
                    "label": [k[2] for k in keys],
                    "n": [total[k] for k in keys],
                }
            )

    parts = sample.select("text", "label", "half").mapInPandas(count, "word string, half long, label int, n long")
    cells = [
        F.coalesce(F.sum(F.when((F.col("half") == h) & (F.col("label") == v), F.col("n"))), F.lit(0)).alias(f"n{v}{h}")
        for v in (0, 1)
        for h in (0, 1)
    ]
    return parts.groupBy("word").agg(*cells).filter(F.col("n10") + F.col("n11") >= LEAST_DOCS).toArrow().to_pandas()


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Model of at most ``rows`` labelled documents outside the held-out fold.

    Words are counted and features computed by the executors; the driver gets the words of the lexicon and one row
    of features per document of the bounded sample.
    """
    sample = written(
        labelled_sample(docs, labels, "toxic", folds, held_out, rows)
        .withColumn("half", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)))
        .withColumn("held", F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(3)) == 0),
        "toxicity-sample",
    )
    sizes = {(r["half"], r["label"]): r["n"] for r in sample.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    toxic = sum(n for (_, label), n in sizes.items() if label)
    total = sum(sizes.values())
    if total < 4 * LEAST_ROWS or toxic in (0, total):
        return ToxicityModel(fixed=toxic / total if total else 0.0)
    counts = word_counts(sample)
    learned = []
    for halves in ((1,), (0,), (0, 1)):
        cells = counts[["word"]].assign(
            n_toxic=sum(counts[f"n1{h}"] for h in halves), n_other=sum(counts[f"n0{h}"] for h in halves)
        )
        learned.append(learned_weights(cells, *[sum(sizes.get((h, v), 0) for h in halves) for v in (1, 0)]))
    sent = sample.sparkSession.sparkContext.broadcast(learned[:2])

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [Lexicon(w) for w in sent.value]
        for batch in batches:
            x = [features(text, own[half]).tobytes() for text, half in zip(batch["text"], batch["half"])]
            yield batch[["doc_id", "label", "held"]].assign(x=x)

    found = sample.mapInPandas(featured, "doc_id long, label int, held boolean, x binary").toArrow().to_pandas()
    found = found.sort_values(["doc_id", "x"], ignore_index=True)
    x = np.stack([np.frombuffer(v) for v in found["x"]])
    y, held = found["label"].to_numpy(dtype=np.float64), found["held"].to_numpy(dtype=bool)
    if not held.any() or held.all():
        return ToxicityModel(fixed=toxic / total)
    trees = boost(x[~held], y[~held])
    return ToxicityModel(learned[2], trees, Isotonic.fit(trees.sums(x[held]), y[held]))


def score(docs: DataFrame, model: ToxicityModel, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` and ``score``, the probability of label 1, of every row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def begin() -> Callable[[list], list]:
        lexicon = Lexicon(sent.value.weights)
        return lambda texts: [sent.value.scores([value or "" for value in texts], lexicon)]

    return map_columns(docs, carry, [text], [T.StructField("score", T.DoubleType())], begin)
