"""Packing of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.packing import pack
from plumbline.llm.registry import query, table


@query()
def op7_cost_balanced_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document in sequences of 2048 tokens."""
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
