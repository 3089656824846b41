"""Helpers shared by the operators that read whole texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
SPACE_SQL = r"[\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words, null texts having none; stays inside generated code."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def fold(key: str, folds: int, held_out: int) -> Column:
    """True for the rows whose crc32 of the key's decimal text leaves ``held_out``; null keys are never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held_out, F.lit(False))


def batch_of(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """Arrow batch of the columns (Arrow arrays as they are, lists and numpy arrays converted)."""
    kinds = [to_arrow_type(field.dataType) for field in schema]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


#: Rows of an Arrow batch of whole texts. Spark's own bound of 10,000 rows makes batches of up to 64 MB, which exist
#: several times at once in a task and its Python worker.
BATCH_ROWS = 1000


def bounded_batches(docs: DataFrame) -> DataFrame:
    """Lowers the session's Arrow batch size to ``BATCH_ROWS`` where it is larger; the rows are unchanged."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that Python objects exist for few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_columns(
    docs: DataFrame,
    carry: list[str],
    inputs: list[str],
    fields: list[T.StructField],
    begin: Callable[[], Callable[..., list]],
) -> DataFrame:
    """The columns ``carry``, untouched, and new ones made from ``inputs``.

    ``begin`` runs once per task and gives the function that turns the lists of one batch's inputs into the lists of the new
    columns. Memory holds one Arrow batch.
    """
    carried = [f"_carry{i}" for i in range(len(carry))]
    # A column that is both carried and read travels once.
    taken = [f"_carry{carry.index(c)}" if c in carry else f"_input{i}" for i, c in enumerate(inputs)]
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(carried, carry)] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = begin()
        for batch in slices(batches):
            made = make(*[batch.column(name).to_pylist() for name in taken])
            yield batch_of(schema, [*[batch.column(name) for name in carried], *made])

    selected = bounded_batches(docs).select(
        *[F.col(c).alias(n) for n, c in zip(carried, carry)],
        *[F.col(c).alias(n) for n, c in zip(taken, inputs) if n not in carried],
    )
    found = selected.mapInArrow(run, schema)
    return found.select(*[F.col(n).alias(c) for n, c in zip(carried, carry)], *[f.name for f in fields])


def map_texts(
    docs: DataFrame, keys: list[str], text: str, fields: list[T.StructField], rows: Callable[[str], tuple]
) -> DataFrame:
    """Keys and the values that ``rows`` gives for each whole text (null counts as empty)."""
    width = len(fields)

    def begin() -> Callable[[list], list]:
        def make(texts: list) -> list:
            found = [rows(value or "") for value in texts]
            return [[row[at] for row in found] for at in range(width)]

        return make

    return map_columns(docs, keys, [text], fields, begin)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, text: str = "text"
) -> DataFrame:
    """``doc_id``, whole text and 0/1 label of at most ``rows`` labelled documents outside the held-out fold.

    The bound is the size of the sample a classifier is fitted on. Documents are taken by a hash of their
    id, so the choice repeats. Label rows without id or label are ignored; of several rows of one
    document the smallest label holds, of several rows of one id the one whose text has the smallest hash: the bound holds for rows
    too. Only ids and labels of the sample are sent to the executors.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~fold("doc_id", folds, held_out))
    one_each = usable.groupBy("doc_id").agg(F.min((F.col(label) > 0).cast("int")).alias("label"))
    chosen = one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), "text")).alias("_row")).select("doc_id", "_row.text", "_row.label")
