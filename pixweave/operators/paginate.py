"""Next-page links, and walks along them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources import html
from ..sources.scratch import stored
from .extract import base_url

# Labels of links to the next page, and class names of page lists.
TEXTS = ("next", "next page", "следующая", "следующая страница", "вперёд", "вперед")
LABELS = (*TEXTS, "next-page")
TRIMMED = " \t\r\n:;>»→[]|-_~"
LISTS = re.compile(r"pagination|pager|paginate|page-nav|pagenav|page_nav|page-links|pages|paging|expp-container|navigation", re.I)
#: Tiers of links, best first.
LINK_REL, ANCHOR_REL, LABEL, TEXT = 1, 2, 3, 4


def _numbered(parent: html.Node | None) -> bool:
    def number(node: html.Node) -> bool:
        text = node.content().strip(html.WHITE)
        return bool(re.fullmatch(r"[+-]?[0-9]{1,18}", text)) and 0 < int(text) < 10000

    return parent is not None and any(number(c) for c in parent.children)


def _in_list(node: html.Node) -> bool:
    up, parent = [], node.parent
    while parent is not None and len(up) < 5:
        up.append(parent)
        parent = parent.parent
    if any(p.tag == "nav" or LISTS.search(p.attr("class")) or LISTS.search(p.attr("id")) for p in up):
        return True
    return _numbered(node.parent) or node.parent is not None and _numbered(node.parent.parent)


def links(markup: str | None, page_url: str | None) -> list[tuple[int, int, str]]:
    """(tier, place, url) of every valid link to a next page."""
    page = urls.parse(page_url) if page_url is not None else None
    if page is None or not markup:
        return []
    root = html.parse(markup)
    base, out = base_url(root, page), []
    here = str(urls.replace(page, fragment=""))
    for node, entering in root.walk():
        if not entering or node.tag not in ("a", "link"):
            continue
        named = "next" in node.attr("rel").lower().split()
        tiers = [LINK_REL] if node.tag == "link" and named else []
        if node.tag == "a":
            tiers = [ANCHOR_REL] if named else []
            if any(node.attr(a).lower() in LABELS for a in ("aria-label", "title")):
                tiers.append(LABEL)
            if node.content().strip(TRIMMED).strip(html.WHITE).lower() in TEXTS and _in_list(node):
                tiers.append(TEXT)
        href = node.attr("href")
        if not tiers or href in ("", "#") or href.startswith("javascript:"):
            continue
        url = urls.resolved(base, href)
        if url and urls.same_origin(page, url) and str(url) != here:
            out += [(t, node.enter, urls._clean(str(url))) for t in tiers]
    return out


def _column(markup: pa.Array, pages: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("tier", pa.int32()), ("place", pa.int32()), ("url", pa.string())]))
    rows = [[dict(zip(("tier", "place", "url"), r, strict=True)) for r in links(m, p)] for m, p in zip(markup.to_pylist(), pages.to_pylist(), strict=True)]
    return pa.array(rows, kind)


def next_links(markup: Column | str, page_url: Column | str) -> Column:
    return F.arrow_udf(_column, "array<struct<tier:int, place:int, url:string>>")(markup, page_url)


def next_page(markup: Column | str, page_url: Column | str) -> Column:
    """The next page's URL: of the best tier that has a valid link the first one; null without any."""
    return F.array_min(next_links(markup, page_url))["url"]


def canonical(url: Column) -> Column:
    """The key under which a page counts as visited: scheme and host in lower case, no fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    start = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    return F.concat(F.lower(start), F.substring(bare, F.length(start) + 1, F.length(bare)))


def with_next(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    return pages.withColumn("next_url", next_page(html, url))


def walk(pages: DataFrame, starts: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(run_id, page_no, url, found): every run's pages in order, from its start along next links.

    ``pages`` has url (unique under ``canonical``), next_url; ``starts`` has run_id, url. A run ends at a page without a
    next link, before a page that it has seen, at a page that isn't there (it is counted, with found = false) or after
    ``max_pages``.

    All runs go forward together, and twice as far in each round: where a page leads in 1, 2, 4, ... steps is a table
    that is joined with itself, and a run's first n pages joined with it give the next n. A run that meets a page again
    keeps each page's first place, which are the places before the first repetition. So a chain of n pages takes
    log n rounds, and as many rows as pages.
    """
    known = pages.select(canonical(F.col("url")).alias("key"), F.col("next_url"))
    jumps = stored(known.filter("next_url is not null").select("key", F.col("next_url").alias("url"), canonical(F.col("next_url")).alias("to")), "walk-jumps")
    done = stored(starts.select("run_id", F.lit(1).alias("page_no"), "url", canonical(F.col("url")).alias("key")), "walk-pages")
    open_, reach = done.select("run_id"), 1
    while max_pages is None or reach < max_pages:
        there = jumps.select("key", F.col("url").alias("_url"), F.col("to").alias("_to"))
        more = done.join(open_, "run_id", "left_semi").join(there, "key").select("run_id", (F.col("page_no") + reach).cast("int").alias("page_no"), F.col("_url").alias("url"), F.col("_to").alias("key"))
        more = stored(more if max_pages is None else more.filter(F.col("page_no") <= max_pages), "walk-more")
        if not more.counted:
            break
        first = F.min(F.struct("page_no", "url")).alias("first")
        done = stored(done.unionByName(more).groupBy("run_id", "key").agg(first).select("run_id", "first.page_no", "first.url", "key"), "walk-pages")
        reach *= 2
        open_ = stored(done.groupBy("run_id").agg(F.count("*").alias("n")).filter(F.col("n") == reach).select("run_id"), "walk-open")
        if not open_.counted:
            break
        jumps = stored(jumps.join(there.withColumnRenamed("key", "_key"), F.col("to") == F.col("_key")).select("key", F.col("_url").alias("url"), F.col("_to").alias("to")), "walk-jumps")
    return done.join(known.select("key", F.lit(True).alias("found")), "key", "left").select("run_id", "page_no", "url", F.coalesce("found", F.lit(False)).alias("found"))
