"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer words, but not none, is one window). A
window is treated as the set of its shingles of ``SHINGLE`` words; a document can hold it only if it holds all of them.

1. Every position of every document gives the shingle that starts there. A Bloom filter of the windows' shingles, whose
   size is bounded by ``MOST_BITS``, lets through the few that any window has; they are written with their place and the
   words around it. What it lets through wrongly costs a row, never a result.
2. Rarity. How often each shingle was met orders the shingles of a window; since all of them are necessary, the prefix
   to join is the rarest one alone. Common shingles join nothing as long as a window has a rarer one.
3. Join. Places of a document whose shingle is the prefix of a window are candidates: the prefix's offset in the window
   gives the start. A start before the document or an end beyond it has no word in the context (positional and length bounds).
4. Verification. The document's words at the candidate place are compared with the window, word by word.
5. Hits of a document are intervals; covered words are counted from the running end, so nothing is expanded.

Documents of equal text share a 128-bit key of it and are counted once; the rows get the result by a join at the end.
Documents with the same set of windows share one list of items. Texts are read in blocks of ``BLOCK`` words.

Null texts and texts without words have no words and no hits; an item without words has no window. A null ``item_id``
counts as one item with an empty id; rows of one ``item_id`` are one item. Repeated document rows each give a row. Empty
tables give no rows, an empty benchmark no hits. Columns beyond ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.llm.mixing import let
from plumbline.session import written

WINDOW = 10
SHINGLE = 5
BLOCK = 2048
#: Bits of the filter for every shingle of the benchmark, probes of it, and its largest size (16 MB).
BITS_EACH, PROBES, MOST_BITS = 32, 4, 1 << 27

#: Before lower-casing, the class of word characters also has A to Z. The ASCII characters outside it are listed one by one:
#: the regular expressions of the JVM look single characters up in a table, but try ranges one after the other.
WORD = "[^" + "".join(f"\\x{code:02X}" for code in range(128) if not chr(code).isalnum()) + "]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: str | Column) -> Column:
    """A to Z lower-cased and nothing else; texts of ASCII alone take the faster way to the same result."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: str) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), 0)


def text_key(text: str) -> Column:
    """128 bits of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16)


def benchmark_windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """``item``, ``win`` (words joined by a space, which no word holds), ``size`` (words), ``wid`` (128-bit key)."""
    length = lambda w: F.least(F.lit(WINDOW), F.size(w))
    starts = lambda w: F.sequence(F.lit(1), F.size(w) - length(w) + 1)
    texts = lambda w: F.when(
        F.size(w) > 0,
        F.transform(starts(w), lambda i: F.struct(F.array_join(F.slice(w, i, length(w)), " ").alias("win"), length(w).alias("size"))),
    )
    each = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.inline(let(words_of(text), texts)))
    return each.distinct().withColumn("wid", text_key("win"))


def window_shingles(windows: DataFrame) -> DataFrame:
    """``wid``, ``win``, ``size``, ``n`` (words of a shingle), ``offset`` of the shingle in the window, ``shingle`` (hash)."""
    split = F.split("win", " ")
    n = F.least(F.lit(SHINGLE), F.col("size"))
    offsets = F.explode(F.sequence(F.lit(0), F.col("size") - n))
    placed = windows.select("wid", "win", "size").distinct().select("*", n.alias("n"), offsets.alias("offset"), split.alias("_w"))
    words = [F.when(F.col("n") > i, F.get("_w", F.col("offset") + i)) for i in range(SHINGLE)]
    return placed.withColumn("shingle", F.xxhash64(*words)).drop("_w")  # words that are null do not change the hash


def _probes(shingle: Column, bits: int) -> list[Column]:
    """Positions of a shingle in the filter: parts of its hash, stepped by an odd second one."""
    second = F.shiftrightunsigned(shingle, 32).bitwiseOR(F.lit(1))
    return [(shingle + second * i).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]


def shingle_filter(shingles: DataFrame) -> tuple[DataFrame, int]:
    """One row with the filter as an array of 64-bit words, and its number of bits (a power of two)."""
    wanted = shingles.select("shingle").distinct()
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_EACH * wanted.count() - 1).bit_length()))
    at = wanted.select(F.explode(F.array(*_probes(F.col("shingle"), bits))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    set_bits = at.select(F.shiftright("at", 6).alias("id"), one.alias("one")).groupBy("id").agg(F.bit_or("one").alias("bits"))
    dense = shingles.sparkSession.range(bits >> 6).join(set_bits, "id", "left")
    row = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return written(dense.agg(F.transform(row, lambda s: s["bits"]).alias("bits")), "contamination-filter"), bits


def shingle_places(docs: DataFrame, text: str, shingles: DataFrame) -> DataFrame:
    """``key`` of the text, ``at`` (first word), ``shingle`` and ``near`` (the words around) where the filter lets through."""
    before, width = WINDOW - SHINGLE, 2 * WINDOW - SHINGLE
    bits_row, bits = shingle_filter(shingles)
    lengths = [r.n for r in shingles.select("n").distinct().collect()]  # at most SHINGLE numbers
    padding = F.array(*[F.lit(None).cast("string")] * before)

    def blocks(padded: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(padded) - before - 1, F.lit(BLOCK))
        cut = lambda i: F.struct(i.alias("first"), F.slice(padded, i + 1, F.lit(BLOCK + width - 1)).alias("block"))
        return F.when(F.size(padded) > before, F.transform(firsts, cut))

    cut_up = docs.select(text_key(text).alias("key"), F.inline(let(F.concat(padding, words_of(text)), blocks)))
    inside = F.least(F.lit(BLOCK), F.size("block") - before)
    places = cut_up.select("key", "first", "block", F.explode(F.sequence(F.lit(0), inside - 1)).alias("_at"))
    word = lambda i: F.get("block", F.col("_at") + (before + i))
    filled = bits_row.scalar()

    def let_through(hashed: Column) -> Column:
        found = F.lit(True)
        for at in _probes(hashed, bits):
            bit = F.bit_get(F.get(filled, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int"))
            found = found & (bit == 1)
        return found

    # Given out by a generator, the hash is computed once per place and not again in every term of the filter.
    hashes = [F.when(word(n - 1).isNotNull(), F.xxhash64(*[word(i) for i in range(n)])) for n in sorted(lengths)]
    each = F.explode(F.array(*hashes) if hashes else F.array().cast("array<long>"))
    passed = places.select("*", each.alias("shingle")).filter(F.col("shingle").isNotNull() & let_through(F.col("shingle")))
    near = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get("block", F.col("_at") + i))
    return passed.select("key", (F.col("first") + F.col("_at")).alias("at"), "shingle", near.alias("near"))


def window_hits(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every occurrence of a window in a text (``key``, ``start``, ``size``, ``wid``), and the windows of the items."""
    windows = written(benchmark_windows(items, item, item_text), "contamination-windows")
    shingles = written(window_shingles(windows), "contamination-shingles")
    places = written(shingle_places(docs, text, shingles), "contamination-places")
    met = places.groupBy("shingle").count()
    rarity = shingles.join(met, "shingle", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = F.min(F.struct("count", "shingle", "offset")).alias("_rarest")
    prefixes = rarity.groupBy("wid", "win", "size").agg(rarest).select("wid", "win", "size", "_rarest.shingle", "_rarest.offset", "_rarest.count")
    prefixes = written(prefixes.filter("count > 0").drop("count"), "contamination-prefixes")
    there = F.array_join(F.slice("near", WINDOW - SHINGLE + 1 - F.col("offset"), F.col("size")), " ")
    exact = places.join(prefixes, "shingle").filter(there == F.col("win"))
    hits = exact.select("key", (F.col("at") - F.col("offset")).alias("start"), "size", "wid").distinct()
    return written(hits, "contamination-hits"), windows


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    carry: list[str],
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The columns ``carry``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids) and ``contaminated`` of every row."""
    hits, windows = window_hits(docs, items, text, item, item_text)
    order = W.partitionBy("key").orderBy("start", "size").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    reached = F.coalesce(F.max(end).over(order), F.lit(0))
    new = hits.withColumn("_new", F.greatest(F.lit(0), end - F.greatest("start", reached)))
    per_text = new.groupBy("key").agg(F.sum("_new").cast("long").alias("n_hit"), F.sort_array(F.collect_set("wid")).alias("_wids"))
    name = F.sha2(F.array_join(F.transform("_wids", F.hex), ""), 256)
    per_text = written(per_text.withColumn("_set", name), "contamination-texts")
    sets = per_text.groupBy("_set").agg(F.first("_wids").alias("_wids")).select("_set", F.explode("_wids").alias("wid"))
    of_set = sets.join(windows.select("wid", "item"), "wid").groupBy("_set").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    found = per_text.drop("_wids").join(of_set, "_set").drop("_set")
    rows = docs.select(
        *[F.col(c).alias(f"_in_{c}") for c in carry],
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        text_key(text).alias("key"),
    )
    joined = rows.join(found, "key", "left")
    ours = ("n_words", "n_hit", "n_items", "items", "contaminated")
    none = F.array().cast("array<string>")
    return joined.select(
        *[F.col(f"_in_{c}").alias(c) for c in carry if c not in ours],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("_items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
