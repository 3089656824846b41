"""Small numpy helpers of the similarity joins: what a task does with the links it finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def union(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Join the groups of ``left[i]`` and ``right[i]``: every position gets the smallest position of its group."""
    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further
    return labels


def units(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys``, cut into one frame per key; only the rows of one key and one batch are held."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(batch)]
        if waiting and (waiting[-1][keys].to_numpy()[-1] != key[0]).any():
            yield pd.concat(waiting, ignore_index=True)
            waiting = []
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield pd.concat([*waiting, batch.iloc[a:b]], ignore_index=True) if waiting else batch.iloc[a:b]
            waiting = []
        waiting.append(batch.iloc[cuts[-2] :])
    if waiting:
        yield pd.concat(waiting, ignore_index=True)
