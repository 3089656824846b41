"""Contract failures, raised from a distributed violations query."""

from __future__ import annotations

from pyspark.sql import DataFrame


class ContractViolation(ValueError):
    """A data contract does not hold; the message carries sample rows."""


def raise_if_any(violations: DataFrame, message: str, sample: int = 5) -> None:
    """Raise when a violations DataFrame has rows; only a few examples reach the driver."""
    examples = violations.take(sample)
    if examples:
        raise ContractViolation(f"{message}: {[row.asDict() for row in examples]}")
