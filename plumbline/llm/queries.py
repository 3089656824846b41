"""All queries of the training-data operators."""

from __future__ import annotations

from importlib import import_module

from plumbline.llm.registry import ORACLES, QUERIES

_MODULES = [
    "rules_query",
    "simhash_query",
    "mixing_query",
    "secrets_query",
    "quality_query",
    "toxicity_query",
    "quantised_query",
    "pages_query",
    "packing_query",
    "tokens_query",
    "contamination_query",
    "merkle_query",
    "conversations_query",
]

for _name in _MODULES:
    import_module(f"plumbline.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
