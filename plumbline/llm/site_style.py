"""Main text of HTML pages by a site style tree.

The pages of a host are merged into one tree: elements with the same path of tags, classes and ids are one
element node, which remembers how often each sequence of children (its presentation) and each text block (its
content) was seen on different pages. Following the entropy measure for style trees, a content block seen on c of the m
pages that have its node adds log c / log m of entropy, and a node's content importance is one less the mean entropy of
the blocks below it. Its presentation importance is the entropy of its child sequences to the base m. Both are
blended by the number l of kinds of children, presentation weighing 1 - DECAY ** l. The recursion over children is
flattened: blocks are summed over all ancestors at once, so the tree needs no rounds.

Elements whose name says what they are (nav, footer, ad and cookie classes, roles) are decided by it, as are the
article and its unnamed parts, since menus and adverts that differ on every page look important to entropy. Class and id
names and forms do not decide about what holds the page's main text (see ``dom``). All other
elements are removed, with everything below them, where their importance stays under ``LEAST_IMPORTANCE`` and
their host shows them on ``LEAST_PAGES`` different pages or more. Copies of a page count once.

Statistics are aggregated over (host, node, block), with map-side sums, so a host holding a third of the pages is
spread over its nodes and blocks; nothing is gathered per host. Decisions travel to pages by the page's own hash; the
HTML itself is moved only if Spark finds the decisions too large to broadcast.

Null and empty html gives an empty text. Null or odd urls share one unnamed host. Rows are independent of repeated
rows and of null ids. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.llm.dom import blocks, read
from plumbline.llm.texts import map_columns
from plumbline.session import written

DECAY = 0.9
LEAST_IMPORTANCE = 0.3
LEAST_PAGES = 4

#: Kinds of statistics rows: a page has the node; a child sequence of the node; a text block of the node.
HAS, STYLE, CONTENT = 0, 1, 2
_STATS = "site long, page long, path long, prior int, kind int, feature long, above array<long>"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hash(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 32 | zlib.adler32(data)) - (1 << 63)


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[tuple] = []
        for site, page, html in zip(batch["_site"], batch["_page"], batch["_html"]):
            read_page = read(html or "")
            priors: dict[int, int] = {}
            above: dict[int, list[int]] = {}
            for node in read_page.nodes:
                path = node.path
                if path not in priors:
                    above[path] = [*above.get(node.parent.path, []), path] if node.parent else [path]
                    priors[path] = -1 if node.dropped else node.prior
                    rows.append((site, page, path, priors[path], HAS, 0, None))
            styles = {(n.path, "/".join(dict.fromkeys(n.children))) for n in read_page.nodes if n.children}
            rows += [(site, page, path, priors[path], STYLE, _hash(s), None) for path, s in sorted(styles)]
            found: set[tuple[int, int]] = set()
            parts: list[str] = []
            owner = 0
            for item in [*read_page.texts, None]:
                if item is not None:
                    parts.append(item[1])
                    owner = item[0].path
                    continue
                text = " ".join("".join(parts).split())
                if text:
                    found.add((owner, _hash(text)))
                parts = []
            rows += [(site, page, path, priors[path], CONTENT, f, above[path]) for path, f in sorted(found)]
        yield pd.DataFrame(rows, columns=["site", "page", "path", "prior", "kind", "feature", "above"])


def importance(pages: DataFrame) -> DataFrame:
    """Importance of every node: columns site, path, prior, pages, importance. ``pages``: _site, _page, _html."""
    stats = pages.mapInPandas(_statistics, _STATS)
    keys = ["site", "path", "kind", "feature"]
    seen = stats.groupBy(*keys).agg(
        F.count_distinct("page").alias("c"), F.max("prior").alias("prior"), F.max("above").alias("above")
    )
    of_node = seen.groupBy("site", "path", "kind").agg(
        F.sum("c").alias("c"),
        F.sum(F.col("c") * F.ln("c")).alias("c_log_c"),
        F.max("prior").alias("prior"),
        F.count("*").alias("kinds"),
        F.max("above").alias("above"),
    )
    wide = written(
        of_node.groupBy("site", "path").agg(
            F.max("prior").alias("prior"),
            F.max(F.when(F.col("kind") == HAS, F.col("c"))).alias("pages"),
            F.max(F.when(F.col("kind") == STYLE, F.struct("c", "c_log_c", "kinds"))).alias("style"),
            F.max(F.when(F.col("kind") == CONTENT, F.struct("c", "c_log_c"))).alias("content"),
            F.max("above").alias("above"),
        ),
        "style-tree",
    )
    log_pages = F.ln(F.greatest("pages", F.lit(2)))
    entropy = F.when(F.col("pages") > 1, F.col("content.c_log_c") / log_pages).otherwise(0.0)
    below = (
        wide.filter("content IS NOT NULL")
        .select("site", F.explode("above").alias("path"), F.col("content.c").alias("c"), entropy.alias("e"))
        .groupBy("site", "path").agg((1 - F.sum("e") / F.sum("c")).alias("content_importance"))
    )
    style_entropy = F.ln("style.c") - F.col("style.c_log_c") / F.col("style.c")
    style = F.when(F.col("style").isNull() | (F.col("pages") < 2), 1.0).otherwise(style_entropy / log_pages)
    weight = F.pow(F.lit(DECAY), F.coalesce("style.kinds", F.lit(0)))
    blended = (1 - weight) * style + weight * F.coalesce("content_importance", F.lit(1.0))
    decided = F.when(F.col("prior") > 0, 1.0).when(F.col("prior") < 0, 0.0).otherwise(blended)
    return wide.join(below, ["site", "path"], "left").select(
        "site", "path", "prior", "pages", decided.alias("importance")
    )


def _undecided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paths per page that only the style tree can decide."""
    for batch in batches:
        rows = []
        for site, page, html in zip(batch["_site"], batch["_page"], batch["_html"]):
            paths = {n.path for n in read(html or "").nodes if n.prior == 0 and not n.dropped and n.parent}
            rows += [(site, page, path) for path in paths]
        yield pd.DataFrame(rows, columns=["site", "page", "path"])


def main_text(pages: DataFrame, carry: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """The columns ``carry`` and ``text``, ``n_chars`` (code points) of every page."""
    known = pages.select(
        *[F.col(c).alias(f"_in_{c}") for c in carry],
        F.xxhash64(host_of(F.col(url))).alias("_site"),
        F.xxhash64(F.col(html)).alias("_page"),
        F.col(html).alias("_html"),
    )
    trees = importance(known.select("_site", "_page", "_html"))
    low = trees.filter((F.col("prior") == 0) & (F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
    paths = known.select("_site", "_page", "_html").mapInPandas(_undecided, "site long, page long, path long")
    removed = (
        paths.join(written(low.select("site", "path"), "style-low"), ["site", "path"])
        .groupBy(F.col("site").alias("_site"), F.col("page").alias("_page"))
        .agg(F.collect_set("path").alias("_removed"))
    )
    marked = known.join(written(removed, "style-removed"), ["_site", "_page"], "left")
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def begin() -> Callable[[list, list], list]:
        def make(htmls: list, removed: list) -> list:
            texts = [" ".join(blocks(read(h or ""), frozenset(gone or ()))) for h, gone in zip(htmls, removed)]
            return [texts, [len(text) for text in texts]]

        return make

    named = [c for c in carry if c not in ("text", "n_chars")]
    found = map_columns(marked, [f"_in_{c}" for c in named], ["_html", "_removed"], fields, begin)
    return found.select(*[F.col(f"_in_{c}").alias(c) for c in named], "text", "n_chars")
