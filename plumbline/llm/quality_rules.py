"""Rule bitmask ledger: every quality rule is evaluated once per document, policies are applied to the bits.

``ledger`` stores, per document, the measurements and one failure bit per rule. A policy is a versioned set
of rules, so it is one integer; applying it is a bitwise AND, and an ablation ("how many documents would
policy P keep without rule R") needs only the number of documents per distinct bit pattern, of which there
are at most two to the number of rules, however many documents there are.

Null and empty texts have no words: all measurements are 0 and ``too_few_words`` fails. Rows are judged one
by one: repeated rows and null ids are kept as they are. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.llm.texts import WORDS, map_texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

MEASURES = [
    T.StructField(name, T.LongType())
    for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_caps_words", "n_echoes")
]


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words lying in a window of ``window`` words that is found twice or more, first occurrence included.

    Windows are compared exactly: equal pairs get equal ranks, then equal pairs of ranks, and so on, so the
    window must be a power of two. A text of n words takes n log n steps and a few arrays of n numbers.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[str, int] = {}
    ranks = np.array([seen.setdefault(word, len(seen)) for word in words], dtype=np.int64)
    if len(seen) == n:
        return 0
    width = 1
    while width < window:
        pairs = ranks[:-width] * n + ranks[width:]
        values, ranks = np.unique(pairs, return_inverse=True)
        if len(values) == len(pairs):
            return 0
        width *= 2
    starts = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edges = np.zeros(n + 1, dtype=np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int(np.count_nonzero(np.cumsum(edges)))


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    capitals = sum(
        1 for word in words if not word.islower() and len(word) > 1 and sum("A" <= c <= "Z" for c in word) > 1
        and not any("a" <= c <= "z" for c in word)
    )
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        capitals,
        sum(map(eq, words, words[1:])),
    )


@dataclass(frozen=True)
class Rule:
    """A document fails when ``condition`` (an SQL expression over the measurements) is true."""

    name: str
    condition: str


#: The order fixes the bits: append new rules, never reorder.
RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", "10 * n_caps_words > 5 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("echoes", "10 * n_echoes > 3 * n_words"),
)

#: Versioned policies: the rules that reject. "base" has the two rules every later policy contains.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(rule.name for rule in RULES),
}
CURRENT = "v2"


def policy_bits(policy: str) -> int:
    return sum(1 << at for at, rule in enumerate(RULES) if rule.name in POLICIES[policy])


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the measurements and ``failed_rules``: bit i is set when rule i of ``RULES`` fails."""
    measured = map_texts(docs, [key], text, MEASURES, measure)
    bits = [F.when(F.expr(rule.condition), F.lit(1 << at)).otherwise(F.lit(0)) for at, rule in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failed_rules", total.cast("long"))


def fails(policy: str) -> Column:
    return F.col("failed_rules").bitwiseAND(F.lit(policy_bits(policy))) != 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Add ``kept`` and the policy's version."""
    return rows.withColumn("kept", ~fails(policy)).withColumn("policy", F.lit(policy))


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents failing it, documents only it rejects, documents kept without it."""
    patterns = rows.groupBy("failed_rules").agg(F.count(F.lit(1)).alias("n"))
    whole = policy_bits(policy)
    counts = []
    for at, rule in enumerate(RULES):
        if whole >> at & 1:
            rest = F.col("failed_rules").bitwiseAND(F.lit(whole & ~(1 << at)))
            hit = F.col("failed_rules").bitwiseAND(F.lit(1 << at)) != 0
            counts.append(
                F.struct(
                    F.lit(rule.name).alias("rule"),
                    F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
                    F.coalesce(F.sum(F.when(hit & (rest == 0), F.col("n"))), F.lit(0)).alias("n_only_this"),
                    F.coalesce(F.sum(F.when(rest == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
                )
            )
    return patterns.agg(F.array(*counts).alias("rules")).select(F.inline("rules"))
