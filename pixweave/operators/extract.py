"""Image candidates of pages.

One Arrow pass per page reads the markup and reports what each part of it points to, in document order and without any
ranking. All that ranks, caps, folds and assembles candidates into slots is column code on that page's array, so
extraction is one map over pages: no shuffle, whatever their number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import srcset, urls
from ..sources import html

FOUND = "array<struct<slot:int, ord:int, source:string, priority:int, raw_url:string, resolved_url:string, descriptor:string, place:int, landing_url:string>>"

# Attributes of images, in the order in which they are tried, and meta properties.
ORIGINALS = ("data-original", "data-original-src", "data-full", "data-full-src", "data-fullsize", "data-large", "data-large-src")
LAZY = ("data-src", "data-image", "data-image-url", "data-url", "data-lazy", "data-lazy-src")
META = {"og:image": "meta-og", "og:image:url": "meta-og", "twitter:image": "meta-twitter", "twitter:image:src": "meta-twitter"}
CSS_URL = re.compile(r"""url\(\s*['"]?([^'")]+)['"]?\s*\)""", re.I)
#: Fields of JSON-LD objects that hold images, with their priorities.
JSON_FIELDS = (("image", 30), ("contentUrl", 32), ("thumbnailUrl", 28))


class _Reader:
    """Collects a page's candidates; ``slot`` numbers the groups that compete for one image."""

    def __init__(self, base: urls.Url):
        self.base, self.rows, self.slot = base, [], 0

    def add(self, source: str, priority: int, raw: str, descriptor: str = "", place: int = 0, landing: str | None = None) -> bool:
        url = urls.resolved(self.base, raw)
        if url is None:
            return False
        self.rows.append((self.slot, len(self.rows), source, priority, raw, urls._clean(str(url)), descriptor, place, landing))
        return True

    def single(self, source: str, priority: int, raw: str) -> None:
        self.add(source, priority, raw)
        self.slot += 1

    def css(self, text: str, source: str) -> None:
        for m in CSS_URL.finditer(text):
            self.single(source, 20, m[1].strip(html.WHITE).strip("\"'"))

    def image(self, node: html.Node, href: str, sources: list[str]) -> bool:
        """An image's candidates; True where the link around it leads to an image itself."""
        landing, linked = None, False
        if href and (target := urls.resolved(self.base, href)):
            if urls.is_raster(href):
                linked = True
            elif urls.same_origin(self.base, target):
                landing = urls._clean(str(target))
        put = lambda *a: self.add(*a, landing=landing)
        if linked:
            put("anchor-image", 100, href)
        next((a for a in ORIGINALS if (v := node.attr(a)) and put("data-original", 90, v)), None)
        for name, high, texts in (("picture-source", 80, sources), ("img-srcset", 70, [node.attr("srcset"), node.attr("data-srcset")])):
            for i, e in enumerate(srcset.ordered([e for t in texts for e in srcset.parse(t)])):
                if put(name, high if i == 0 else high - 2, e["url"], e["descriptor"], i) and i >= 2:
                    break  # the first two places, and the first later one that resolves
        next((a for a in LAZY if (v := node.attr(a)) and put("data-src", 60, v)), None)
        if src := node.attr("src"):
            put("img-src", 50, src)
        self.slot += 1
        return linked

    def structured(self, text: str) -> None:
        def strict(x):
            raise ValueError(x)

        try:
            data = json.loads(text, parse_constant=strict)
        except (ValueError, RecursionError):
            return
        todo: list[tuple] = [(data, 0)]  # last in, first out; a priority of 0 asks for the rules of objects
        while todo:
            value, priority = todo.pop()
            if isinstance(value, list):
                todo += [(v, priority) for v in reversed(value)]
            elif isinstance(value, str):
                if priority and value.strip(html.WHITE):
                    self.single("json-ld", priority, value.strip(html.WHITE))
            elif isinstance(value, dict):
                todo += reversed(list(self._of_object(value)))

    @staticmethod
    def _of_object(value: dict) -> Iterator[tuple]:
        if "@graph" in value:
            yield value["@graph"], 0
        for name, priority in JSON_FIELDS:
            if name in value:
                yield value[name], priority
        kinds = value.get("@type")
        if "url" in value and any(isinstance(k, str) and k.strip(html.WHITE).lower() == "imageobject" for k in (kinds if isinstance(kinds, list) else [kinds])):
            yield value["url"], 32
        for name, child in value.items():
            if name not in ("@graph", "image", "contentUrl", "thumbnailUrl") and isinstance(child, dict | list):
                yield child, 0


def base_url(root: html.Node, page: urls.Url) -> urls.Url:
    """The page's URL as all its ``<base href>`` change it, one after the other."""
    for node, entering in root.walk():
        if entering and node.tag == "base" and (ref := urls.parse(node.attr("href")) if node.attr("href") else None):
            page = urls.resolve(page, ref)
    return page


class _Link:
    def __init__(self, href: str):
        self.href, self.used = href, False


def found(markup: str | None, page_url: str | None) -> list[tuple]:
    """All candidates of a page in document order, unranked."""
    page = urls.parse(page_url) if page_url is not None else None
    if page is None or not markup:
        return []
    root = html.parse(markup)
    out = _Reader(base_url(root, page))
    links, pictures = [_Link("")], [None]  # the nearest link and picture around what is read
    for node, entering in root.walk():
        tag = node.tag
        if tag is None:
            continue
        if not entering:
            if tag == "a":
                link = links[-1]
                if link.href and not link.used and urls.is_raster(link.href):
                    out.single("standalone-anchor", 40, link.href)
                links.pop()
            elif tag == "picture":
                pictures.pop()
            continue
        if style := node.attrs.get("style"):
            out.css(style, "css-inline")
        if tag == "a":
            links.append(_Link(node.attr("href")) if node.attr("href") else links[-1])
        elif tag == "picture":
            pictures.append([])
        elif tag == "source" and pictures[-1] is not None:
            pictures[-1].extend(t for t in (node.attr("srcset"), node.attr("data-srcset")) if t)
        elif tag == "img":
            if out.image(node, links[-1].href, pictures[-1] or []):
                links[-1].used = True
        elif tag == "meta" and node.attr("content"):
            if source := META.get((node.attr("property") or node.attr("name")).lower()):
                out.single(source, 35, node.attr("content"))
        elif tag == "script" and node.attr("type").lower() == "application/ld+json":
            if node.children and (text := node.children[0].text.strip(html.WHITE)):
                out.structured(text)
        elif tag == "style" and node.children and node.children[0].tag is None:
            out.css(node.children[0].text, "css-block")
    return out.rows


def _column(markup: pa.Array, pages: pa.Array) -> pa.Array:
    i, s = pa.int32(), pa.string()
    names = [("slot", i), ("ord", i), ("source", s), ("priority", i), ("raw_url", s), ("resolved_url", s), ("descriptor", s), ("place", i), ("landing_url", s)]
    rows = [[dict(zip((n for n, _ in names), (urls._clean(v) if isinstance(v, str) else v for v in r), strict=True)) for r in found(m, p)] for m, p in zip(markup.to_pylist(), pages.to_pylist(), strict=True)]
    return pa.array(rows, pa.list_(pa.struct(names)))


def _ranked(c: Column) -> Column:
    """By slot, then priority, then order of mention; of a slot's equal URLs the first stays."""
    key = F.transform(c, lambda x: F.struct(x["slot"].alias("slot"), (-x["priority"]).alias("minus"), x["ord"].alias("ord"), x.alias("c")))
    ordered = F.transform(F.array_sort(key), lambda x: x["c"])
    first = lambda x, i, a: ~F.exists(F.slice(a, F.greatest(i - 31, F.lit(1)), F.least(i, F.lit(31))), lambda y: (y["slot"] == x["slot"]) & (y["resolved_url"] == x["resolved_url"]))
    return F.element_at(F.transform(F.array(ordered), lambda a: F.filter(a, lambda x, i: first(x, i, a))), 1)


def slots(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] | None = None) -> DataFrame:
    """A row per slot: the kept columns of ``pages``, slot_idx from 1, landing_url and its candidates in the order of their rank.

    Slots without a candidate are not numbered. ``keep`` names the columns that pass; by default all but the markup.
    """
    keep = tuple(c for c in pages.columns if c != html) if keep is None else keep
    x = pages.select(*keep, F.arrow_udf(_column, FOUND)(html, url).alias("_found")).withColumn("_found", _ranked(F.col("_found")))
    new = lambda i: (i == 0) | (F.get("_found", i)["slot"] != F.get("_found", i - 1)["slot"])
    x = x.filter(F.size("_found") > 0).withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_found") - 1), new))
    x = x.select("*", F.posexplode("_starts").alias("_i", "_a"))
    own = F.slice("_found", F.col("_a") + 1, F.coalesce(F.get("_starts", F.col("_i") + 1), F.size("_found")) - F.col("_a"))
    made = F.transform(own, lambda c: F.struct(c["source"].alias("source"), c["priority"].alias("priority"), c["raw_url"].alias("raw_url"), c["resolved_url"].alias("resolved_url"), F.nullif(c["descriptor"], F.lit("")).alias("descriptor")))
    return x.select(*keep, (F.col("_i") + 1).cast("int").alias("slot_idx"), F.get("_found", F.col("_a"))["landing_url"].alias("landing_url"), made.alias("candidates"))


def candidates(pages: DataFrame, **kw) -> DataFrame:
    """A row per candidate: as ``slots``, with cand_idx from 1, source, priority, raw_url, resolved_url and descriptor."""
    return exploded(slots(pages, **kw))


def best(pages: DataFrame, **kw) -> DataFrame:
    """The first candidate of every slot."""
    return candidates(pages, **kw).filter("cand_idx = 1").drop("cand_idx")


def exploded(slot_rows: DataFrame) -> DataFrame:
    """Slots flattened into rows of candidates."""
    others = [c for c in slot_rows.columns if c != "candidates"]
    return slot_rows.select(*others, F.posexplode("candidates").alias("_i", "c")).select(*others, (F.col("_i") + 1).alias("cand_idx"), "c.*")
