"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Targets. Sources in code point order (null last) weigh 5, 2, 1 and so on; together they share 150 % of all
   words. A target stops at twice its source's words and the excess goes to the others by weight (water filling).
2. Quotas. A source's target is cut into blocks of ``block_words`` words, the last one shorter: its exact quota.
3. Tree. The root holds the quotas of all sources and stands for all output shards. A node deals half of its
   blocks to its left child; how many of each source go there is one multivariate-hypergeometric draw, made
   source by source: given what is left, each is a univariate hypergeometric draw by inversion from the mode.
   At the leaves every shard knows how many blocks of each source it gets. Quotas are conserved exactly.
4. Draws. The documents of a source are put into a random order by a hash; their words form one long stream that
   may be passed twice. Shard after shard takes its next blocks of the stream, so draws never overlap and sum to
   the target to the word. A document lying across a block boundary at a shard's end is cut there.
5. Shuffle. A draw carries a hash to order it by within its shard.

The tree has one row per node with one number per source, so it grows with shards times sources and not with the
documents; the number of sources is the number of weights a user sets and is assumed to fit one row. Documents
are placed by two-level running totals: (source, hash range) totals, then a window inside each range of about
``RANGE_ROWS`` documents, so that a hot source is spread over as many ranges as it needs.

Null and empty texts have size 0 and are never drawn. Null sources form a source of their own. Equal rows are
interchangeable. An empty table, and a source without words, has target 0. All draws depend on ``seed`` and the
rows alone, so that reruns and recomputed tasks agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.llm.texts import word_count
from plumbline.session import written

WEIGHTS = (5, 2, 1)
RANGE_ROWS = 20_000
LEAST_SHARDS, SHARD_WORDS = 16, 1 << 27
#: Standard deviations around the mode that inversion walks; what lies beyond has a probability below 1e-20.
WALK = 10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series and exactly below ten."""
    x = n.cast("double")
    exact = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)]), n.cast("int") + 1)
    tail = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 10, exact).otherwise(x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + tail)


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """Marked ones among ``drawn`` of ``total`` with ``marked`` marked ones, by inversion from the mode outwards."""

    def choose(n: Column, k: Column) -> Column:
        return log_factorial(n) - log_factorial(k) - log_factorial(n - k)

    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked))
    high = F.least(drawn, marked)
    other = total - marked - drawn

    def walk(mode: Column) -> Column:
        at_mode = F.exp(choose(marked, mode) + choose(total - marked, drawn - mode) - choose(total, drawn))
        share = marked / F.greatest(total, F.lit(1))
        spread = F.sqrt(drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
        steps = F.least(high - low, F.ceil(WALK * spread) + WALK)

        def step(state: Column, i: Column) -> Column:
            up, down = mode + i, mode - i
            more = F.when(
                up <= high, state["up"] * ((marked - up + 1) * (drawn - up + 1)) / (up.cast("double") * (other + up))
            ).otherwise(0.0)
            less = F.when(
                down >= low,
                state["down"] * ((down + 1).cast("double") * (other + down + 1)) / ((marked - down) * (drawn - down)),
            ).otherwise(0.0)

            def settle(p: Column) -> Column:
                after_up = state["rest"] - p["more"]
                after = after_up - p["less"]
                found = F.when(after_up < 0, up).when(after < 0, down)
                return F.struct(
                    after.alias("rest"),
                    p["more"].alias("up"),
                    p["less"].alias("down"),
                    F.coalesce(state["found"], found).alias("found"),
                )

            return let(F.struct(more.alias("more"), less.alias("less")), settle)

        def start(p: Column) -> Column:
            return F.struct(
                (uniform - p).alias("rest"),
                p.alias("up"),
                p.alias("down"),
                F.when(uniform < p, mode).alias("found"),
            )

        walked = F.aggregate(
            F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<long>")),
            let(at_mode, start),
            step,
        )
        return F.coalesce(walked["found"], mode)

    mode = F.floor((drawn + 1).cast("double") * (marked + 1) / (total + 2))
    return let(F.least(F.greatest(mode, low), high), walk)


def uniform(*parts: Column | int) -> Column:
    """Number in [0, 1) from a hash of the parts."""
    hashed = F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])
    return F.shiftrightunsigned(hashed, 11) * F.lit(2.0**-53)


def split(quotas: Column, low: Column, width: int, seed: int) -> Column:
    """The left child's quotas: one multivariate-hypergeometric draw of half of the node's blocks."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)

    def draw(state: Column, at: Column) -> Column:
        q = F.element_at(quotas, at)
        found = hypergeometric(state["total"], q, state["left"], uniform(seed, low, width, at))
        return let(
            found,
            lambda x: F.struct(
                (state["total"] - q).alias("total"),
                (state["left"] - x).alias("left"),
                F.concat(state["out"], F.array(x)).alias("out"),
            ),
        )

    def from_total(n: Column) -> Column:
        start = F.struct(
            n.alias("total"), F.floor(n / 2).alias("left"), F.array().cast("array<long>").alias("out")
        )
        return F.aggregate(F.sequence(F.lit(1), F.size(quotas)), start, draw)["out"]

    return let(total, from_total)


def shard_quotas(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """``at`` (position of the source), ``shard`` and ``blocks`` for quotas ``blocks`` of sources ``at`` = 1, 2, ..."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "blocks"))), lambda s: s["blocks"])
    nodes = plan.agg(ordered.alias("quotas")).filter(F.size("quotas") > 0).select(F.lit(0).alias("low"), "quotas")
    width = shards
    while width > 1:
        dealt = nodes.withColumn("left", split(F.col("quotas"), F.col("low"), width, seed))
        width //= 2
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        sides = F.array(
            F.struct(F.col("low"), F.col("left").alias("quotas")),
            F.struct((F.col("low") + width).alias("low"), right.alias("quotas")),
        )
        nodes = written(dealt.select(F.inline(sides)), "mix-nodes")
    return nodes.select(F.col("low").alias("shard"), F.posexplode("quotas").alias("at", "blocks")).withColumn(
        "at", F.col("at") + 1
    )


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Add ``at`` (position in code point order, null last), ``weight`` and ``target`` to sources with ``words``."""
    order = W.orderBy(F.col("_has").desc(), "_source")
    at = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(at - 1, F.lit(len(WEIGHTS))) + 1))
    ranked = sources.withColumn("at", at).withColumn("weight", weight).withColumn("_cap", most * F.col("words"))
    filling = W.orderBy(F.col("_cap") / F.col("weight"), "at")
    before, after = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing)
    left = share * F.sum("words").over(W.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    marked = ranked.withColumn("_level", level).withColumn("_open", F.col("_cap") > F.col("_level") * F.col("weight"))
    common = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), "at", "_level"))).over(
        W.partitionBy()
    )["_level"]
    target = F.when(F.col("_open"), common * F.col("weight")).otherwise(F.col("_cap"))
    return marked.withColumn("target", target).drop("_level", "_open", "_cap")


def mix(
    docs: DataFrame,
    carry: list[str],
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    shards: int | None = None,
    block_words: int = 256,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 20,
) -> DataFrame:
    """The columns ``carry`` of every row, ``size``, ``source_size``, ``target``, ``taken`` and ``draws``.

    ``draws`` lists what shards take of the document: shard, pass (0 or 1), first word, number of words and the
    draw's place in its shard (``order``). ``taken`` sums the words. ``shards`` must be a power of two; by default there are as many
    as keep the words of a shard below ``SHARD_WORDS``, at least ``LEAST_SHARDS``.
    """
    ranges = max(1, (docs.count() // RANGE_ROWS).bit_length())
    rows = docs.select(
        *[F.col(c).alias(f"_in_{c}") for c in carry],
        F.col(source).isNotNull().alias("_has"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_key"),
        F.col(key).alias("_tie"),
    ).withColumn("_range", F.shiftrightunsigned("_key", 64 - ranges))
    group = ["_has", "_source"]
    totals = written(rows.groupBy(*group, "_range").agg(F.sum("size").alias("_words")), "mix-ranges")
    if shards is None:
        words = totals.agg(F.sum("_words")).first()[0] or 0
        shards = max(LEAST_SHARDS, 1 << (int(share * words) // SHARD_WORDS).bit_length())
    plan = targets(totals.groupBy(*group).agg(F.sum("_words").alias("words")), share, most)
    goal = F.round("target").cast("long")
    plan = written(plan.withColumn("goal", goal).withColumn("blocks", F.ceil(goal / block_words)), "mix-targets")
    taken_before = W.partitionBy("at").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    ends = shard_quotas(plan, shards, seed).withColumn("end", F.sum("blocks").over(taken_before))
    bounds = ends.groupBy("at").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda s: s["end"]).alias("ends")
    )
    in_words = F.transform("ends", lambda e: F.least(e * block_words, F.col("goal")))
    whole = plan.join(bounds, "at").select(
        *group, F.col("words").alias("source_size"), "target", F.concat(F.array(F.lit(0).cast("long")), in_words).alias("_bounds")
    )
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_words").over(earlier), F.lit(0))
    placed = written(totals.withColumn("_base", base).drop("_words").join(whole, group), "mix-places")
    inside = W.partitionBy(*group, "_range").orderBy("_key", "_tie", "size").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    found = rows.join(placed, [*group, "_range"]).withColumn("_at", at).withColumn("draws", _draws(shards, seed))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return found.select(
        *[F.col(f"_in_{c}").alias(c) for c in carry if c not in ("size", "source_size", "target", "taken", "draws")],
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        "draws",
    )


def _shard_of(position: Column, shards: int) -> Column:
    """Last shard beginning at or before a position of the stream, by binary search."""
    steps = []
    step = shards // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    if not steps:
        return F.lit(0)
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, jump: F.when(F.element_at("_bounds", at + jump + 1) <= position, at + jump).otherwise(at),
    )


def _draws(shards: int, seed: int) -> Column:
    """Overlaps of a document's two places in its source's stream with the shards' parts of it."""
    goal = F.element_at("_bounds", -1)

    def of_pass(number: int) -> Column:
        start = F.col("_at") + number * F.col("source_size")
        end = F.least(start + F.col("size"), goal)

        def piece(shard: Column) -> Column:
            first = F.greatest(F.element_at("_bounds", shard + 1), start)
            last = F.least(F.element_at("_bounds", shard + 2), end)
            return F.struct(
                shard.alias("shard"),
                F.lit(number).alias("pass"),
                (first - start).alias("from_word"),
                (last - first).alias("words"),
                F.xxhash64(F.lit(seed), F.col("_key"), shard, F.lit(number)).alias("order"),
            )

        shards_met = F.sequence(_shard_of(start, shards), _shard_of(end - 1, shards))
        pieces = F.filter(F.transform(shards_met, piece), lambda p: p["words"] > 0)
        return F.when(start < end, pieces)

    none = F.array().cast("array<struct<shard:int,pass:int,from_word:bigint,words:bigint,order:bigint>>")
    return F.concat(F.coalesce(of_pass(0), none), F.coalesce(of_pass(1), none))
