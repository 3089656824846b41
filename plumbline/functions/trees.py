"""Additive attributions of a tree ensemble: numpy helper used inside Spark tasks.

Every leaf is a product game over the distinct features on its path: a feature in the coalition
contributes whether the row follows the path (0 or 1), a feature outside it the share of training rows
that do. Shapley values of that game depend on the row only through the pattern of followed features,
so they are tabulated once per leaf and looked up per row. Their sum over leaves is path-dependent
TreeSHAP.

A leaf is a plain dict, so that tables of leaves can be broadcast.
"""

from __future__ import annotations

from math import factorial

import numpy as np


def _shapley_table(value: float, shares: list[float]) -> np.ndarray:
    """Row per pattern (bit j set: feature j followed), column per feature."""
    m = len(shares)
    patterns = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    weight = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    table = np.zeros((1 << m, m))
    for j in range(m):
        # Coefficients by coalition size of the product of (share + follows * t) over the other features.
        sizes = np.zeros((1 << m, m))
        sizes[:, 0] = 1.0
        for i in range(m):
            if i != j:
                grown = sizes * shares[i]
                grown[:, 1:] += sizes[:, :-1] * patterns[:, i, None]
                sizes = grown
        table[:, j] = value * (patterns[:, j] - shares[j]) * (sizes @ weight)
    return table


def leaves_of(nodes: dict[int, dict], weight: float) -> list[dict]:
    """Leaves of one tree; ``nodes`` maps id to split, children, cover and prediction."""
    found = []
    stack = [(0, ())]
    while stack:
        node_id, path = stack.pop()
        node = nodes[node_id]
        if node["left"] >= 0:
            for side in ("left", "right"):
                child = node[side]
                test = (node["threshold"], node["categories"], side == "left")
                stack.append((child, path + ((node["feature"], test, nodes[child]["cover"] / node["cover"]),)))
            continue
        tests: dict[int, list] = {}
        shares: dict[int, float] = {}
        for feature, test, share in path:
            tests.setdefault(feature, []).append(test)
            shares[feature] = shares.get(feature, 1.0) * share
        value = weight * node["prediction"]
        found.append(
            {
                "tests": list(tests.items()),
                "table": _shapley_table(value, list(shares.values())),
                "expected": value * float(np.prod(list(shares.values()))),
            }
        )
    return found


def base_value(leaves: list[dict]) -> float:
    return float(sum(leaf["expected"] for leaf in leaves))


def _follows(values: np.ndarray, tests: list[tuple]) -> np.ndarray:
    result = np.ones(len(values), dtype=bool)
    for threshold, categories, to_left in tests:
        left = np.isin(values, categories) if categories is not None else values <= threshold
        result &= left == to_left
    return result


def attributions(matrix: np.ndarray, leaves: list[dict]) -> np.ndarray:
    """Contribution of every feature for every row of ``matrix``."""
    result = np.zeros(matrix.shape)
    for leaf in leaves:
        pattern = np.zeros(len(matrix), dtype=np.int64)
        for bit, (feature, tests) in enumerate(leaf["tests"]):
            pattern |= _follows(matrix[:, feature], tests).astype(np.int64) << bit
        for bit, (feature, _) in enumerate(leaf["tests"]):
            result[:, feature] += leaf["table"][pattern, bit]
    return result
