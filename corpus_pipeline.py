"""The training-data pipeline: every stage reads the documents its predecessor wrote.

Stages keep the columns of ``documents`` (doc_id, text, lang, source, n_chars), the last one returns pieces of
token sequences. Null and empty texts, repeated rows and empty tables go through as the operators define.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import quality_model
from plumbline.llm.mixing import mix
from plumbline.llm.packing import pack
from plumbline.llm.secrets import redact
from plumbline.llm.simhash import near_duplicates
from plumbline.llm.texts import WORD_SQL, map_columns
from plumbline.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_model.score(docs, model, COLUMNS)
    return scored.filter(F.col("score") >= quality_model.THRESHOLD).select(COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group: the one with the smallest id, one row of it.

    Rows are told apart by a 128-bit hash of all their columns, since ids may repeat or be null.
    """
    hashes = {f"_h{i}": F.xxhash64(F.lit(i), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in COLUMNS]) for i in (1, 2)}
    marked = docs.select(*COLUMNS, *[column.alias(name) for name, column in hashes.items()])
    grouped = near_duplicates(marked, others=("_h1", "_h2"))
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_h1", "_h2")
    chosen = grouped.groupBy("group").agg(F.min(order).alias("_row")).select("_row._h1", "_row._h2")
    kept = marked.join(written(chosen, "pipeline-kept"), ["_h1", "_h2"], "left_semi")
    return kept.dropDuplicates(["_h1", "_h2"]).select(COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets of any layer replaced by a mark."""

    others = [c for c in COLUMNS if c != "text"]
    hidden = map_columns(
        docs, others, ["text"], [docs.schema["text"]], lambda: lambda texts: [[t and redact(t) for t in texts]]
    )
    return hidden.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents once, twice or not at all, cut where a source's target or a shard ends.

    A cut text is the words taken with the white space between them as it was; what stands before the first and after the last is left out.
    """
    drawn = mix(docs, COLUMNS).select(*COLUMNS, "size", F.explode("draws").alias("draw"))
    first, count = F.col("draw.from_word").cast("int") + 1, F.col("draw.words").cast("int")
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD_SQL), 0), first, count)
    spaces = F.slice(F.split("text", WORD_SQL, -1), first, count)  # the k-th stands before the k-th word
    inner = F.transform(spaces, lambda s, i: F.when(i > 0, s).otherwise(F.lit("")))
    cut = F.array_join(F.zip_with(inner, words, lambda s, w: F.concat(s, w)), "")
    text = F.when(F.col("draw.words") < F.col("size"), cut).otherwise(F.col("text"))
    pieces = drawn.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    shuffled = pieces.repartitionByRange("draw.shard", "draw.order").sortWithinPartitions("draw.shard", "draw.order")
    return shuffled.select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores and token ids cannot be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
