"""Token files of all documents, written and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.registry import query, table
from plumbline.llm.token_files import new_path, read_files, write_files


@query()
def op4_context_mixed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Place, number and checksum of every document's ids, from the files."""
    path = new_path(spark)
    write_files(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_files(spark, path)
