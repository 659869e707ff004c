"""Main text of web pages by wrapper induction (operator 1).

Every page's block tree is aligned with the tree of one seed page of its host
by simple tree matching.  A text that stands in the same seed slot on at least
half of a host's pages is template, the others vary.  The host's content root
is the seed node that holds its varying text: an article or main element with
at least half of it, else the deepest container with nearly all.  A page's text
is what aligns under that root, without boilerplate roles (menus, notices,
adverts, forms, comments ...), and outside article elements without template.
Pages the wrapper does not fit, and hosts of one page, use the page's own
article element or else all text without a boilerplate role.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import broadcast_if_small, id_back, id_out, written
from ledgerlens.llm.dom import Node, align, parse

LEAST_PAGES = 3
TEMPLATE_SHARE = 0.5
ARTICLE_SHARE = 0.5
ROOT_SHARE = 0.9
_SEEDS = 64
_TEXT_TAGS = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd pre blockquote figcaption".split())
_BLOCK = "struct<text: string, key: long, path: array<struct<node: int, kind: int>>, inner: boolean>"


def _path(node: Node, found: dict[int, int]) -> list[dict[str, int]]:
    """Seed numbers of the aligned ancestors, with 2 for an article or main
    element, 1 for another container and 0 for a text element."""
    path = []
    at: Node | None = node
    while at is not None:
        if at.number in found:
            kind = 2 if at.tag in ("article", "main") else int(at.tag not in _TEXT_TAGS)
            path.append({"node": found[at.number], "kind": kind})
        at = at.parent
    return path


def _analysed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per page: its blocks without boilerplate roles, placed in the seed's tree."""
    seeds: OrderedDict[str, Node] = OrderedDict()
    for frame in frames:
        out = []
        for page, host, seed in zip(frame["html"], frame["host"], frame["seed"], strict=True):
            root, blocks = parse(page or "")
            blocks = [b for b in blocks if not b.node.boilerplate]
            found: dict[int, int] = {}
            if seed is not None and blocks:
                if host not in seeds:
                    seeds[host] = parse(seed)[0]
                    if len(seeds) > _SEEDS:
                        seeds.popitem(last=False)
                found = align(root, seeds[host])
            rows = []
            for b in blocks:
                path = _path(b.node, found)
                placed = f"{path[0]['node'] if path else -1}:{b.node.number in found}:{b.slot}:{b.text}"
                key = xxhash.xxh64_intdigest(placed.encode("utf-8", "surrogatepass")) - (1 << 63)
                rows.append({"text": b.text, "key": key, "path": path, "inner": b.node.article})
            out.append(rows)
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "host": frame["host"], "blocks": out})


def extract_text(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) -> (page_id, url, text, n_chars), one row each.

    Character references are decoded, white space in a block is one space,
    blocks are joined by a line feed in page order.  NULL and empty pages give
    an empty text.  Pages without a host (NULL or odd urls) are read alone.
    NULL ids stay NULL, repeated rows are each extracted, extra columns are
    ignored, an empty table gives no rows.
    """
    host = F.regexp_extract(F.lower("url"), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s]+)", 1)
    pages = pages.select(
        id_out(F.col("page_id")).alias("page_id"), "url", F.nullif(host, F.lit("")).alias("host"), "html"
    )
    seeds = (
        pages.where("host is not null and length(html) > 0")
        .groupBy("host")
        .agg(F.min_by("html", "page_id").alias("seed"), F.count(F.lit(1)).alias("pages"))
        .where("pages > 1")
    )
    seeds = written(seeds, "seeds")
    fields = f"page_id long, url string, host string, blocks array<{_BLOCK}>"
    joined = pages.join(seeds.select("host", "seed"), "host", "left").select("page_id", "url", "host", "html", "seed")
    analysed = written(joined.mapInPandas(_analysed, fields), "blocks")

    placed = analysed.where("host is not null").select("host", F.explode("blocks").alias("b")).select("host", "b.*")
    counts = seeds.select("host", "pages")
    # a page counts once per key, however often it repeats the text there
    keys = F.array_distinct(F.transform(F.filter("blocks", lambda b: F.size(b["path"]) > 0), lambda b: b["key"]))
    template = (
        analysed.where("host is not null")
        .select("host", F.explode(keys).alias("key"))
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(counts, "host")
        .where((F.col("pages") >= LEAST_PAGES) & (F.col("n") >= TEMPLATE_SHARE * F.col("pages")))
    )
    template = written(template.select("host", "key"), "template")
    mass = (
        placed.join(template, ["host", "key"], "left_anti")
        .select("host", F.explode("path").alias("at"), F.length("text").cast("long").alias("chars"), F.size("path").alias("depth"))
        .groupBy("host", "at.node", "at.kind")
        .agg(F.sum("chars").alias("chars"))
    )
    total = mass.groupBy("host").agg(F.max("chars").alias("total"))
    # seed numbers grow in page order, so of nested nodes the deeper has the larger
    preference = F.when(
        (F.col("kind") == 2) & (F.col("chars") >= ARTICLE_SHARE * F.col("total")),
        F.struct(F.lit(2).alias("rank"), F.col("chars").alias("by"), (-F.col("node")).alias("then")),
    ).when(
        (F.col("kind") == 1) & (F.col("chars") >= ROOT_SHARE * F.col("total")),
        F.struct(F.lit(1).alias("rank"), F.col("node").cast("long").alias("by"), F.lit(0).alias("then")),
    )
    roots = (
        mass.join(total, "host").where(preference.isNotNull()).groupBy("host").agg(F.max_by("node", preference).alias("root"))
    )
    wrappers = counts.join(roots, "host", "left").join(
        template.groupBy("host").agg(F.collect_list("key").alias("template")), "host", "left"
    )
    # written, so that a join beyond the broadcast limit is between two exchanges and hot hosts split
    wrappers = broadcast_if_small(written(wrappers, "wrappers"), 20_000)

    def texts(blocks: object) -> object:
        return F.transform(blocks, lambda b: b["text"])

    under = F.filter("blocks", lambda b: F.exists(b["path"], lambda p: p["node"] == F.col("root")))
    varying = F.filter("fit", lambda b: b["inner"] | ~F.array_contains(F.coalesce("template", F.array().cast("array<long>")), b["key"]))
    inner = F.filter("blocks", lambda b: b["inner"])
    chosen = (
        F.when(F.size("wrapped") > 0, F.col("wrapped"))
        .when(F.size("own") > 0, F.col("own"))
        .when(F.size("fit") > 0, F.col("fit"))
        .otherwise(F.col("blocks"))
    )
    text = F.array_join(texts(chosen), "\n")
    return (
        analysed.join(wrappers, "host", "left")
        .withColumn("fit", F.when(F.col("root").isNull(), F.array().cast(f"array<{_BLOCK}>")).otherwise(under))
        .withColumn("wrapped", varying)
        .withColumn("own", inner)
        .select(id_back(F.col("page_id")).alias("page_id"), "url", text.alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
