"""Registered queries over the driver's tables, with the SQL that says the same.

The pages of the test data hold no images. Queries on images put markup into them that depends on page_id alone; the
SQL works out the expected rows from page_id, without reading any markup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, names, tokens, urls
from ..functions.srcset import best_entry, parse_srcset, srcset_entries
from ..operators import download, extract, landing, paginate
from ..sources.html import dom_nodes
from . import crawl

BASE = "https://site.example/g/"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _marked(spark: SparkSession, sf_dir: str, markup: str) -> DataFrame:
    """(page_id, url, html): every page with markup in which {p} stands for its page_id."""
    return _table(spark, sf_dir, "pages").select("page_id", F.lit(BASE).alias("url"), F.replace(F.lit(markup), F.lit("{p}"), F.col("page_id").cast("string")).alias("html"))


def _rows(select: str) -> str:
    return f"WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS s, '{BASE}' AS b FROM pages) {select}"


def _candidates(spark, sf_dir, markup: str) -> DataFrame:
    return extract.candidates(_marked(spark, sf_dir, markup), keep=("page_id",)).select("page_id", "slot_idx", "cand_idx", "source", "priority", "resolved_url")


def _expected(*rows: tuple[int, int, str, int, str]) -> str:
    """SQL for (slot_idx, cand_idx, source, priority, URL below the base) of every page; {p} is its page_id."""
    parts = []
    for slot, cand, source, priority, path in rows:
        url = "'" + path.replace("{p}", "' || s || '") + "'"
        root = "'https://site.example' || " if path.startswith("/") else "b || "
        parts.append(f"SELECT page_id, {slot} AS slot_idx, {cand} AS cand_idx, '{source}' AS source, {priority} AS priority, {root}{url} AS resolved_url FROM p")
    return _rows(" UNION ALL ".join(parts))


# Links and folders of the pages as they are.


@query("""SELECT page_id,
  CASE WHEN h = '' THEN 'site' ELSE h END AS host_folder,
  CASE WHEN rtrim(left(slug, 64), '-_.') = '' THEN 'root' ELSE rtrim(left(slug, 64), '-_.') END || '-' || left(sha256(bare), 8) AS page_folder
FROM (SELECT page_id, bare, trim(regexp_replace(regexp_replace(host, '^(?i:www\\.)', ''), '[^a-zA-Z0-9.\\-_]', '_', 'g'), ' ._') AS h,
  trim(lower(regexp_replace(trim(path, '/'), '[^a-zA-Z0-9_\\-]+', '-', 'g')), '-_.') AS slug
  FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS bare, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages))""")
def page_folder(spark, sf_dir):
    return crawl.folders(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


@query("""SELECT page_id, CAST(position AS BIGINT) AS link_no, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS position FROM pages)""")
def nav_links(spark, sf_dir):
    x = dom_nodes(_table(spark, sf_dir, "pages").select("page_id", "html")).filter("tag = 'a' and attrs['href'] is not null")
    x = x.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_id", F.col("attrs")["href"].alias("href")))).alias("links"))
    return x.select("page_id", F.posexplode("links").alias("at", "l")).select("page_id", (F.col("at") + 1).cast("long").alias("link_no"), "l.href")


@query("""SELECT page_id, CAST(count(*) AS BIGINT) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) WHERE href LIKE '/%' AND href NOT LIKE '//%' GROUP BY page_id""")
def same_origin_links(spark, sf_dir):
    x = dom_nodes(_table(spark, sf_dir, "pages")).filter("tag = 'a'").select("page_id", "url", F.col("attrs")["href"].alias("href"))
    x = x.withColumns({"a": urls.url_parts("url"), "b": urls.url_parts(urls.resolve_url("url", "href"))})
    same = (F.lower("a.scheme") == F.lower("b.scheme")) & (F.lower("a.hostname") == F.lower("b.hostname"))
    return x.filter(same).groupBy("page_id").agg(F.count("*").alias("links"))


@query("""SELECT page_id, tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<(script|style|title)([^>]*)>.*?</(script|style|title)>', '<\\1\\2>', 'g'), '(?s)<!--.*?-->', '', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY page_id, tag""")
def dom_tags(spark, sf_dir):
    x = dom_nodes(_table(spark, sf_dir, "pages").select("page_id", "html")).filter("tag is not null and tag <> '#document'")
    return x.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


# Candidates of injected markup.

# Markup that differs by page: slots of one kind, of another, or of both.


@query(_rows("""SELECT page_id, 1 AS slot_idx, 1 AS cand_idx,
  CASE page_id % 4 WHEN 0 THEN 'img-src' WHEN 1 THEN 'anchor-image' WHEN 2 THEN 'meta-og' ELSE 'img-srcset' END AS source,
  CASE page_id % 4 WHEN 0 THEN 50 WHEN 1 THEN 100 WHEN 2 THEN 35 ELSE 70 END AS priority, b || ['a', 'b', 'c', 'd'][page_id % 4 + 1] || s || '.jpg' AS resolved_url
  FROM p
UNION ALL SELECT page_id, 1, 2, 'img-src', 50, b || 'x' || s || '.png'
  FROM p
  WHERE page_id % 4 IN (1, 3)
UNION ALL SELECT page_id, 2, 1, 'css-inline', 20, b || 'bg' || (page_id % 7) || '.gif'
  FROM p
  WHERE page_id % 7 < 3"""))
def mixed_pages(spark, sf_dir):
    s, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    image = F.concat(F.lit('<p>text</p><img alt="" src="a'), s, F.lit('.jpg">'))
    anchor = F.concat(F.lit('<div><a href="b'), s, F.lit('.jpg"><b><img src="x'), s, F.lit('.png"></b></a></div>'))
    meta = F.concat(F.lit('<meta property="og:image" content="c'), s, F.lit('.jpg">'))
    srcset = F.concat(F.lit('<IMG SRC=x'), s, F.lit(".png SRCSET='d"), s, F.lit(".jpg 2x'>"))
    own = F.when(k == 0, image).when(k == 1, anchor).when(k == 2, meta).otherwise(srcset)
    more = F.when(F.col("page_id") % 7 < 3, F.concat(F.lit("<div style='background:url(bg"), (F.col("page_id") % 7).cast("string"), F.lit(".gif)'></div>"))).otherwise("<!-- none -->")
    pages = _table(spark, sf_dir, "pages").select("page_id", F.lit(BASE).alias("url"), F.concat(F.lit("<html><head></head><body>"), own, more).alias("html"))
    return extract.candidates(pages, keep=("page_id",)).select("page_id", "slot_idx", "cand_idx", "source", "priority", "resolved_url")


GALLERY = '<a href="/full/{p}.jpg"><img src="thumb/{p}.jpg" data-original="o/{p}.png"></a><a href="/view/{p}"><img src="../t2/{p}.gif#x"></a>'


@query(_expected((1, 1, "anchor-image", 100, "/full/{p}.jpg"), (1, 2, "data-original", 90, "o/{p}.png"), (1, 3, "img-src", 50, "thumb/{p}.jpg"), (2, 1, "img-src", 50, "/t2/{p}.gif")))
def img_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir, GALLERY)


@query(_expected((1, 1, "anchor-image", 100, "/full/{p}.jpg"), (2, 1, "img-src", 50, "/t2/{p}.gif")).replace("1 AS cand_idx, ", ""))
def best_candidate(spark, sf_dir):
    return extract.best(_marked(spark, sf_dir, GALLERY), keep=("page_id",)).select("page_id", "slot_idx", "source", "priority", "resolved_url")


@query(_rows("SELECT page_id, 2 AS slot_idx, 'https://site.example/view/' || s AS landing_url, 1 AS n FROM p UNION ALL SELECT page_id, 1, NULL, 3 FROM p"))
def slot_landings(spark, sf_dir):
    x = extract.slots(_marked(spark, sf_dir, GALLERY), keep=("page_id",))
    return x.select("page_id", "slot_idx", "landing_url", F.size("candidates").alias("n"))


@query(_expected((1, 1, "img-srcset", 70, "c{p}.jpg"), (1, 2, "img-srcset", 68, "a{p}.jpg"), (1, 3, "img-srcset", 68, "b{p}.jpg"), (1, 4, "img-src", 50, "s.jpg")))
def srcset_ranked(spark, sf_dir):
    return _candidates(spark, sf_dir, '<img src="s.jpg" srcset="b{p}.jpg 400w, c{p}.jpg 1200w, a{p}.jpg 800w, d{p}.jpg 200w, data:x 9w">')


@query(_rows("""SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 THEN 100 + page_id ELSE 0 END AS BIGINT) AS width, CAST(CASE WHEN page_id % 2 = 0 THEN 0 ELSE 2 END AS DOUBLE) AS density, 'a' || s || '.jpg' AS url
  FROM p"""))
def srcset_best(spark, sf_dir):
    p = F.col("page_id").cast("string")
    text = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("b.jpg 50w, a"), p, F.lit(".jpg "), (F.col("page_id") + 100).cast("string"), F.lit("w"))).otherwise(F.concat(F.lit("b.jpg, a"), p, F.lit(".jpg 2x, c.jpg 1.5x")))
    x = _table(spark, sf_dir, "pages").select("page_id", parse_srcset(text)[0].alias("e"))
    return x.select("page_id", "e.width", "e.density", "e.url")


@query(_rows("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'wide' || s || '.jpg' WHEN 1 THEN 'dense' || s || '.jpg' ELSE 'last' || s || '.jpg' END AS url FROM p"))
def srcset_pick(spark, sf_dir):
    """The one entry that is taken: the widest, without widths the first of the densest, without both the last."""
    s, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    wide = F.concat(F.lit("a.jpg 9x, wide"), s, F.lit(".jpg 800w, c.jpg 800w"))
    dense = F.concat(F.lit("a.jpg 1x, dense"), s, F.lit(".jpg 2x, c.jpg 2x"))
    last = F.concat(F.lit("a.jpg, b.jpg, last"), s, F.lit(".jpg"))
    x = _table(spark, sf_dir, "pages").select("page_id", srcset_entries(F.when(k == 0, wide).when(k == 1, dense).otherwise(last)).alias("e"))
    return x.select("page_id", best_entry("e")["url"].alias("url"))


@query(_rows("SELECT page_id, CAST(i AS BIGINT) AS place, ['b' || s, 'd' || s, 'c' || s, 'a' || s][i + 1] || '.jpg' AS url FROM p, (SELECT unnest(range(4)) AS i)"))
def srcset_ties(spark, sf_dir):
    """Equal widths: the order is that of exchanges with the front place, so the first entry ends up last."""
    s = F.col("page_id").cast("string")
    text = F.concat_ws(", ", *(F.concat(F.lit(n), s, F.lit(f".jpg {w}w")) for n, w in (("a", 400), ("b", 800), ("c", 400), ("d", 800))))
    x = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(parse_srcset(text)).alias("place", "e"))
    return x.select("page_id", F.col("place").cast("long").alias("place"), "e.url")


@query(_expected((1, 1, "anchor-image", 100, "x{p}.jpg"), (1, 2, "img-srcset", 70, "y{p}.jpg")))
def slot_distinct(spark, sf_dir):
    """A URL that a slot finds several times is kept once, with its best source."""
    return _candidates(spark, sf_dir, '<a href="x{p}.jpg"><img src="x{p}.jpg" data-src="./x{p}.jpg#f" srcset="y{p}.jpg 2x, y{p}.jpg 1x"></a>')


@query(_expected((1, 1, "picture-source", 80, "big{p}.avif"), (1, 2, "picture-source", 78, "mid{p}.webp"), (1, 3, "img-src", 50, "{p}.jpg")))
def picture_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir, '<picture><source srcset="mid{p}.webp 1x"><source data-srcset="big{p}.avif 2x"><img src="{p}.jpg"><source srcset="late.webp 9x"></picture>')


@query(_expected((1, 1, "data-original", 90, "f{p}.jpg"), (1, 2, "data-src", 60, "l{p}.jpg"), (1, 3, "img-src", 50, "blank.gif")))
def lazy_attrs(spark, sf_dir):
    return _candidates(spark, sf_dir, '<img src="blank.gif" data-lazy="z.jpg" data-src="l{p}.jpg" data-full="f{p}.jpg" data-original="data:image/png;base64,x">')


@query(_expected((1, 1, "standalone-anchor", 40, "{p}.png"), (2, 1, "anchor-image", 100, "used{p}.jpg"), (2, 2, "img-src", 50, "t.jpg")))
def standalone_anchor(spark, sf_dir):
    return _candidates(spark, sf_dir, '<a href="{p}.png">one</a><a href="{p}.html">page</a><a href="used{p}.jpg"><img src="t.jpg"></a>')


@query(_expected((1, 1, "meta-og", 35, "/og{p}.jpg"), (2, 1, "meta-twitter", 35, "tw{p}.jpg")))
def meta_images(spark, sf_dir):
    return _candidates(spark, sf_dir, '<meta property="OG:Image" content="/og{p}.jpg"><meta name="twitter:image" content="tw{p}.jpg"><meta name="og:title" content="x.jpg">')


@query(_expected((1, 1, "json-ld", 30, "a{p}.jpg"), (2, 1, "json-ld", 30, "b{p}.jpg"), (3, 1, "json-ld", 32, "c{p}.jpg"), (4, 1, "json-ld", 28, "t{p}.jpg"), (5, 1, "json-ld", 32, "u{p}.jpg")))
def jsonld_images(spark, sf_dir):
    return _candidates(spark, sf_dir, '<script type="application/ld+json">{"@graph":[{"image":["a{p}.jpg","b{p}.jpg"]}],"author":{"contentUrl":"c{p}.jpg","url":"no.jpg"},"video":[{"thumbnailUrl":"t{p}.jpg"},{"@type":["ImageObject"],"url":"u{p}.jpg"}]}</script><script type="application/ld+json">{"image":NaN}</script>')


@query(_expected((1, 1, "css-inline", 20, "i{p}.png"), (2, 1, "css-block", 20, "/b{p}.png"), (3, 1, "css-block", 20, "c{p}.png")))
def css_urls(spark, sf_dir):
    return _candidates(spark, sf_dir, """<div style="background: URL('i{p}.png')"></div><style>a{background:url(/b{p}.png)} b{background:url( "c{p}.png" )}</style>""")


@query("SELECT page_id, 1 AS slot_idx, 1 AS cand_idx, 'img-src' AS source, 50 AS priority, 'https://cdn.example/x/' || page_id || '.jpg' AS resolved_url FROM pages")
def base_href(spark, sf_dir):
    return _candidates(spark, sf_dir, '<base href="https://cdn.example/"><base href="x/"><img src="{p}.jpg">')


# URLs and tokens.


@query(_rows("""SELECT page_id, kind,
  CASE kind WHEN 0 THEN b || 'a' || s || '.jpg' WHEN 1 THEN 'https://site.example/r' || s WHEN 2 THEN 'https://site.example/u' || s WHEN 3 THEN 'http://o.example/' || s WHEN 4 THEN 'https://p.example/' || s WHEN 5 THEN b || s || '?q=a%20b' WHEN 6 THEN b || '%C3%A9%20' || s WHEN 7 THEN NULL ELSE NULL END AS resolved
  FROM p, (SELECT unnest(range(9)) AS kind)"""))
def resolve_urls(spark, sf_dir):
    s = F.col("page_id").cast("string")
    raws = [F.concat(F.lit("a"), s, F.lit(".jpg#f")), F.concat(F.lit("/r"), s), F.concat(F.lit("../u"), s), F.concat(F.lit("http://o.example/"), s), F.concat(F.lit("//p.example/"), s), F.concat(s, F.lit("?q=a%20b")), F.concat(F.lit("é "), s), F.concat(F.lit("DATA:x"), s), F.concat(F.lit("mailto:a@b"), s)]
    x = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*raws)).alias("at", "raw"))
    return x.select("page_id", F.col("at").cast("long").alias("kind"), urls.resolve_url(F.lit(BASE), "raw").alias("resolved"))


@query(_rows("""SELECT page_id, 'img-' || s || '_x1' AS token
  FROM p
UNION ALL SELECT page_id, s
  FROM p
  WHERE length(s) >= 4 AND s NOT IN ('1024','1080','1200','1280','1600','1920','2048')
UNION ALL SELECT page_id, 'id-' || (page_id + 1000)
  FROM p"""))
def url_tokens(spark, sf_dir):
    s = F.col("page_id").cast("string")
    url = F.concat(F.lit("https://site.example/photos/"), s, F.lit("/IMG-"), s, F.lit("_x1.jpg?page=zz9999&ref=id-"), (F.col("page_id") + 1000).cast("string"), F.lit("&w=8888"))
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(tokens.url_tokens(url)).alias("token"))


# Next pages.


@query(_rows("""SELECT page_id,
  CASE page_id % 5 WHEN 0 THEN b || 'p' || (page_id + 1) WHEN 1 THEN b || 'rel' || s WHEN 2 THEN b || 'label' || s WHEN 3 THEN b || 'text' || s ELSE NULL END AS next_url
  FROM p"""))
def next_page(spark, sf_dir):
    s = F.col("page_id").cast("string")
    kinds = [
        F.concat(F.lit('<a rel="next" href="no">x</a><link rel="prev Next" href="p'), (F.col("page_id") + 1).cast("string"), F.lit('">')),
        F.concat(F.lit('<a title="Next" href="later">x</a><a rel="next" href="javascript:x">x</a><a rel="next" href="rel'), s, F.lit('">x</a>')),
        F.concat(F.lit('<a aria-label=" Next page " href="label'), s, F.lit('">></a>')),
        F.concat(F.lit('<div><span>1</span> <span>2</span><a href="text'), s, F.lit('#f"> Next » </a></div>')),
        F.lit('<p><a href="plain">next</a><a rel="next" href="http://other.example/">x</a><a rel="next" href="#">x</a></p>'),
    ]
    html = F.element_at(F.array(*kinds), (F.col("page_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", paginate.next_page(html, F.lit(BASE)).alias("next_url"))


# Every row of pages starts a run over the table's own pages. Page 10k+6 leads back to 10k+3, any other one to the next;
# a link beyond the table ends the walk at a page that isn't there. So a run has a page for each step before the first
# repetition: 7 less its start's last digit from 0 to 3, 4 from 4 to 6, and from 7 on those up to the next ten and 7.
_WALK = """SELECT CAST(page_id AS VARCHAR) AS run_id, CAST(k + 1 AS INTEGER) AS page_no, '{base}' || node AS url, node <= top AS found
FROM (SELECT page_id, top, k, CASE WHEN page_id % 10 IN (4, 5, 6) AND page_id % 10 + k > 6 THEN page_id + k - 4 ELSE page_id + k END AS node
  FROM (SELECT page_id, max(page_id) OVER () AS top, CASE WHEN page_id % 10 <= 3 THEN 7 - page_id % 10 WHEN page_id % 10 <= 6 THEN 4 ELSE 17 - page_id % 10 END AS n FROM pages), (SELECT unnest(range(10)) AS k) WHERE k < n)
WHERE node <= top + 1{more}"""


def _chained_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = F.col("page_id")
    table = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(BASE), n.cast("string")).alias("url"))
    to = F.when(n % 10 == 6, n - 3).otherwise(n + 1).cast("string")
    pages = table.select("url", F.concat(F.lit('<a rel="next" href="'), to, F.lit('">x</a>')).alias("html"))
    return paginate.with_next(pages), table.select(n.cast("string").alias("run_id"), "url")


@query(_WALK.format(base=BASE, more=""))
def pagination_walk(spark, sf_dir):
    return paginate.walk(*_chained_pages(spark, sf_dir))


@query(_WALK.format(base=BASE, more=" AND k < 3"))
def max_pages(spark, sf_dir):
    return paginate.walk(*_chained_pages(spark, sf_dir), max_pages=3)


# Landing pages.


def _landing_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Slots that lead to landing pages, and the answers: original, tie without a winner, failure, image itself."""
    s, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    land = F.concat(F.lit("https://site.example/view/"), s)
    html = F.concat(F.lit('<a href="/view/'), s, F.lit('"><img src="/thumbs/pic-'), s, F.lit('.jpg"></a>'))
    pages = _table(spark, sf_dir, "pages").select(F.lit("run").alias("run_id"), F.col("page_id").cast("int").alias("page_no"), F.lit(BASE).alias("page_url"), html.alias("html"))
    one = F.concat(F.lit('<img src="/big/pic-'), s, F.lit('-full9.jpg" srcset="/orig/x/pic-'), s, F.lit('.jpg 900w, /other/else1.jpg 800w">'))
    tie = F.concat(F.lit('<img src="/a1/pic-'), s, F.lit('.jpg"><img src="/b1/pic-'), s, F.lit('.jpg">'))
    ok = k != 2
    responses = _table(spark, sf_dir, "pages").select(
        land.alias("url"), F.lit(None).cast("string").alias("final_url"), F.when(ok, 200).otherwise(403).alias("status_code"), F.when(k == 3, "image/png; q=1").otherwise("text/html").alias("content_type"),
        F.lit(None).cast("string").alias("content_disposition"), F.encode(F.when(k == 0, one).when(k == 1, tie), "UTF-8").alias("body"), F.when(~ok, "HTTP 403").alias("error"), F.lit(1).alias("attempts"),
    )
    return extract.slots(pages, url="page_url"), responses


@query(_rows("""SELECT CAST(page_id AS INTEGER) AS page_no, 'https://site.example/' || CASE page_id % 4 WHEN 0 THEN 'orig/x/pic-' || s || '.jpg' WHEN 3 THEN 'view/' || s ELSE 'thumbs/pic-' || s || '.jpg' END AS resolved_url,
  CASE WHEN page_id % 4 IN (0, 3) THEN 110 ELSE 50 END AS priority,
  CASE WHEN page_id % 4 IN (0, 3) THEN 2 ELSE 1 END AS n
  FROM p"""))
def landing_match(spark, sf_dir):
    slots, responses = _landing_tables(spark, sf_dir)
    x = landing.resolve(slots, responses, use_index=False)
    return x.select("page_no", F.col("candidates")[0]["resolved_url"].alias("resolved_url"), F.col("candidates")[0]["priority"].alias("priority"), F.size("candidates").alias("n"))


def _answers(page_ids: DataFrame, land, body) -> DataFrame:
    """Landing pages that all arrive as HTML."""
    none = F.lit(None).cast("string")
    return page_ids.select(land.alias("url"), none.alias("final_url"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), none.alias("content_disposition"), F.encode(body, "UTF-8").alias("body"), none.alias("error"), F.lit(1).alias("attempts"))


@query("""SELECT CAST(page_id // 4 AS VARCHAR) AS run_id, CAST(page_id % 4 AS INTEGER) AS page_no, 'https://site.example/orig/pic-' || page_id || '.jpg?v=' || CASE page_id % 2 WHEN 0 THEN 'own' ELSE 'next' END AS resolved_url, 110 AS priority
  FROM pages""")
def landing_index(spark, sf_dir):
    """Every landing page holds its own slot's original and the next slot's. So the index answers each second slot, whose page is not read then."""
    n = F.col("page_id")
    s, next_ = n.cast("string"), (n + 1).cast("string")
    ids = _table(spark, sf_dir, "pages")
    land = F.concat(F.lit("https://site.example/view/"), s)
    html = F.concat(F.lit('<a href="/view/'), s, F.lit('"><img src="/thumbs/pic-'), s, F.lit('.jpg"></a>'))
    pages = ids.select(F.floor(n / 4).cast("string").alias("run_id"), (n % 4).cast("int").alias("page_no"), F.lit(BASE).alias("page_url"), html.alias("html"))
    body = F.concat(F.lit('<img srcset="/orig/pic-'), s, F.lit('.jpg?v=own 900w"><img srcset="/orig/pic-'), next_, F.lit('.jpg?v=next 900w">'))
    x = landing.resolve(extract.slots(pages, url="page_url"), _answers(ids, land, body))
    return x.select("run_id", "page_no", F.col("candidates")[0]["resolved_url"].alias("resolved_url"), F.col("candidates")[0]["priority"].alias("priority"))


@query("""SELECT CAST(page_id AS INTEGER) AS page_no, 'https://site.example/' || CASE WHEN page_id % 2 = 0 THEN 'b/pic-' || page_id || '.jpg' ELSE 'thumbs/pic-' || page_id || '.jpg' END AS resolved_url,
  CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS n
  FROM pages""")
def landing_own(spark, sf_dir):
    """The best match is a URL that the slot has already: it doesn't count, and another one wins (even pages) or none (odd ones)."""
    n = F.col("page_id")
    s = n.cast("string")
    ids = _table(spark, sf_dir, "pages")
    land = F.concat(F.lit("https://site.example/view/"), s)
    html = F.concat(F.lit('<a href="/view/'), s, F.lit('"><img src="/thumbs/pic-'), s, F.lit('.jpg"></a>'))
    pages = ids.select(F.lit("run").alias("run_id"), n.cast("int").alias("page_no"), F.lit(BASE).alias("page_url"), html.alias("html"))
    own = F.concat(F.lit('<img srcset="/thumbs/pic-'), s, F.lit('.jpg 2000w">'))
    other = F.when(n % 2 == 0, F.concat(F.lit('<img src="/b/pic-'), s, F.lit('.jpg">'))).otherwise("")
    x = landing.resolve(extract.slots(pages, url="page_url"), _answers(ids, land, F.concat(own, other)), use_index=False)
    return x.select("page_no", F.col("candidates")[0]["resolved_url"].alias("resolved_url"), F.size("candidates").alias("n"))


@query("SELECT CAST(page_id AS INTEGER) AS page_no, CAST(CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 2 END AS INTEGER) AS n FROM pages")
def landing_ambiguous(spark, sf_dir):
    """Two different URLs tie (no original), the same URL twice (one), or a higher priority decides (one)."""
    n = F.col("page_id")
    s = n.cast("string")
    ids = _table(spark, sf_dir, "pages")
    html = F.concat(F.lit('<a href="/view/'), s, F.lit('"><img src="/thumbs/pic-'), s, F.lit('.jpg"></a>'))
    pages = ids.select(F.lit("run").alias("run_id"), n.cast("int").alias("page_no"), F.lit(BASE).alias("page_url"), html.alias("html"))
    image = lambda folder, attr, end="": F.concat(F.lit(f'<img {attr}="/{folder}/pic-'), s, F.lit(f'.jpg{end}">'))
    body = F.when(n % 3 == 0, F.concat(image("a", "src"), image("b", "src"))).when(n % 3 == 1, F.concat(image("a", "src"), image("a", "src"))).otherwise(F.concat(image("a", "src"), image("b", "srcset", " 900w")))
    land = F.concat(F.lit("https://site.example/view/"), s)
    x = landing.resolve(extract.slots(pages, url="page_url"), _answers(ids, land, body), use_index=False)
    return x.select("page_no", F.size("candidates").alias("n"))


@query(_rows("""SELECT CAST(page_id AS INTEGER) AS page_no, 'pic-' || s AS token
  FROM p
UNION ALL SELECT CAST(page_id AS INTEGER), s
  FROM p
  WHERE length(s) >= 4 AND s NOT IN ('1024','1080','1200','1280','1600','1920','2048')"""))
def slot_tokens(spark, sf_dir):
    slots, _ = _landing_tables(spark, sf_dir)
    return landing.slot_tokens(slots).select("page_no", "token")


# Duplicates, images, names, totals.


@query("SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS is_new FROM documents")
def content_dedup(spark, sf_dir):
    x = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"), F.lit("run").alias("run_id"))
    return download.first_contents(x, ["run_id"], F.col("body"), ["doc_id"]).select("doc_id", "sha256", "is_new")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1 AS is_new FROM events")
def url_dedup(spark, sf_dir):
    return download.first_urls(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["event_type"], "user_id", ["event_id"]).select("event_id", "user_id", "is_new")


def _be(n, size: int):
    return F.unhex(F.lpad(F.hex(n), 2 * size, "0"))


def _le(n, size: int):
    return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(size)))


def _image_bodies(spark, sf_dir) -> DataFrame:
    """(page_id, body, w, h): headers of seven formats, by page_id."""
    raw = lambda h: F.unhex(F.lit(h))
    w, h = (F.col("page_id") % 3000 + 1), (F.col("page_id") % 700 + 2)
    png = F.concat(raw("89504E470D0A1A0A0000000D49484452"), _be(w, 4), _be(h, 4), raw("0802000000"))
    gif = F.concat(raw("474946383961"), _le(w, 2), _le(h, 2), raw("000000"))
    bmp = F.concat(raw("424D00000000000000003600000028000000"), _le(w, 4), _le(h, 4), raw("01001800"))
    jpeg = F.concat(raw("FFD8FFE000104A46494600010100000100010000FFC0001108"), _be(h, 2), _be(w, 2), raw("03012200"))
    webp = F.concat(raw("524946460000000057454250565038580A00000000000000"), _le(w - 1, 3), _le(h - 1, 3))
    tiff = F.concat(raw("49492A00080000000200"), raw("0001040001000000"), _le(w, 4), raw("0101040001000000"), _le(h, 4), raw("00000000"))
    ispe = F.concat(raw("0000001469737065"), raw("00000000"), _be(w, 4), _be(h, 4))
    avif = F.concat(raw("00000014667479706176696600000000"), raw("6D696631"), raw("000000306D65746100000000"), raw("0000002469707270"), raw("0000001C6970636F"), ispe)
    body = F.element_at(F.array(png, gif, bmp, jpeg, webp, tiff, avif), (F.col("page_id") % 7 + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", body.alias("body"), w.alias("w"), h.alias("h"))


_FORMATS = "['png','gif','bmp','jpeg','webp','tiff','avif'][CAST(page_id % 7 AS INTEGER) + 1]"


@query(f"""SELECT page_id, {_FORMATS} AS format, CAST(page_id % 3000 + 1 AS BIGINT) AS width, CAST(page_id % 700 + 2 AS BIGINT) AS height, '.' || CASE {_FORMATS} WHEN 'jpeg' THEN 'jpg' ELSE {_FORMATS} END AS extension
  FROM pages""")
def image_headers(spark, sf_dir):
    none = F.lit(None).cast("string")
    x = _image_bodies(spark, sf_dir).select("page_id", images.image_info(F.col("body"), none, none).alias("i"))
    return x.select("page_id", "i.format", "i.width", "i.height", "i.extension")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' ELSE NULL END AS format FROM pages")
def image_sniff(spark, sf_dir):
    k = F.col("page_id") % 4
    body = F.unhex(F.when(k == 0, F.hex(F.lit("  <HTML>x"))).when(k == 1, F.lit("89504E470D0A1A0A")).otherwise(F.lit("00112233")))
    kind, ext = F.when(k == 2, "IMAGE/JPG; q=1"), F.when(k == 3, ".ico").otherwise(".txt")
    return _table(spark, sf_dir, "pages").select("page_id", images.sniff_format(body, kind, ext).alias("format"))


@query("SELECT page_id FROM pages WHERE greatest(page_id % 3000 + 1, page_id % 700 + 2) >= 24")
def size_filter(spark, sf_dir):
    return _image_bodies(spark, sf_dir).filter(download.keeps_size(F.col("w"), F.col("h"), 24)).select("page_id")


@query("SELECT page_id, greatest(page_id % 3000 + 1, page_id % 700 + 2) AS side FROM pages WHERE page_id % 3000 + 1 >= 10")
def max_side(spark, sf_dir):
    """The longer side, of bodies whose size is read from their headers."""
    none = F.lit(None).cast("string")
    x = _image_bodies(spark, sf_dir).select("page_id", images.image_info(F.col("body"), none, none).alias("i")).filter("i.width >= 10")
    return x.select("page_id", F.greatest("i.width", "i.height").alias("side"))


def _tried(spark, sf_dir, body, content_type: str, max_bytes: int = images.SNIFFED) -> DataFrame:
    """What a try of one image per page gives."""
    s = F.col("page_id").cast("string")
    none = F.lit(None).cast("string")
    url = F.concat(F.lit(BASE + "i"), s, F.lit(".gif"))
    ids = _table(spark, sf_dir, "pages")
    responses = ids.select(url.alias("url"), F.lit(200).alias("status_code"), F.lit(content_type).alias("content_type"), none.alias("content_disposition"), body.alias("body"), none.alias("error"))
    return download.outcomes(ids.select("page_id", url.alias("resolved_url")), responses, max_bytes=max_bytes)


@query("SELECT page_id, CASE WHEN 13 + page_id % 50 > 40 THEN 'Error' ELSE 'Downloaded' END AS outcome FROM pages")
def byte_cap(spark, sf_dir):
    body = F.concat(F.unhex(F.lit("47494638396108000800000000")), F.encode(F.repeat(F.lit("x"), (F.col("page_id") % 50).cast("int")), "UTF-8"))
    return _tried(spark, sf_dir, body, "image/gif", 40).select("page_id", "outcome")


@query("SELECT page_id, 'Skipped' AS outcome, 'unsupported format or invalid image' AS reason FROM pages")
def svg_rejected(spark, sf_dir):
    """SVG by its media type, and by its markup even where the header claims a raster image."""
    body = F.encode(F.concat(F.lit('<?xml version="1.0"?> <SVG id="'), F.col("page_id").cast("string"), F.lit('">')), "UTF-8")
    return _tried(spark, sf_dir, body, "image/png").select("page_id", "outcome", "reason")


@query("SELECT page_id, ['jpeg', 'jpeg', 'png', 'gif', 'webp', 'bmp', 'tiff', 'tiff', 'avif', NULL][CAST(page_id % 10 AS INTEGER) + 1] AS format FROM pages")
def extension_formats(spark, sf_dir):
    """Bytes that say nothing and no media type: the extension decides."""
    ext = F.element_at(F.array(*map(F.lit, ".jpg .JPEG .png .gif .webp .bmp .tif .tiff .avif .xyz".split())), (F.col("page_id") % 10 + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", images.sniff_format(F.unhex(F.lit("00112233")), F.lit(None).cast("string"), ext).alias("format"))


@query("SELECT event_id, user_id, coalesce(user_id IN (SELECT s_suppkey FROM supplier), FALSE) AS seen FROM events")
def url_seen(spark, sf_dir):
    return download.url_seen(_table(spark, sf_dir, "events").select("event_id", "user_id"), _table(spark, sf_dir, "supplier"), "user_id", "s_suppkey")


@query("""SELECT p_partkey,
  CASE p_partkey % 5 WHEN 0 THEN 'a b' || p_partkey || '.jpg' WHEN 1 THEN 'x_' || p_partkey || '.png' WHEN 2 THEN 'f' || p_partkey || '.jpeg' WHEN 3 THEN 'image_' || left(sha256(CAST(p_partkey AS VARCHAR)), 8) || '.jpg' ELSE '_CON.png' END AS filename
  FROM part""")
def filename_resolve(spark, sf_dir):
    s, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    disposition = F.when(k == 1, F.concat(F.lit('attachment; filename="dir/x:'), s, F.lit('.dat"'))).when(k == 4, "inline; filename=CON.png")
    path = F.when(k == 0, F.concat(F.lit("/d/a%20b"), s, F.lit(".jpg"))).when(k == 2, F.concat(F.lit("/f"), s, F.lit(".jpeg"))).otherwise("/")
    return _table(spark, sf_dir, "part").select("p_partkey", names.resolve_filename(disposition, path, F.when(k.isin(1, 4), ".png").otherwise(".jpg"), F.sha2(s, 256)).alias("filename"))


@query("""SELECT p_partkey,
  CASE p_partkey % 4 WHEN 0 THEN p_name || '.png' WHEN 1 THEN p_name || '.jfif' WHEN 2 THEN p_name || '.JPG.png' ELSE p_name || '.tiff' END AS filename
  FROM (SELECT p_partkey, regexp_replace(p_name, '[^a-z]', '', 'g') AS p_name
  FROM part)""")
def ensure_extension(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.regexp_replace("p_name", "[^a-z]", "")
    given = F.concat(name, F.when(k == 0, "").when(k == 1, ".jfif").when(k == 2, ".JPG").otherwise(".tiff"))
    return _table(spark, sf_dir, "part").select("p_partkey", names.ensure_extension(given, F.when(k == 1, ".jpg").when(k == 3, "tif").otherwise(".png")).alias("filename"))


@query("""SELECT o_orderkey, 'img-' || (o_orderkey % 100) || CASE WHEN n = 1 THEN '' ELSE '_' || n END || '.jpg' AS filename
  FROM (SELECT o_orderkey, o_custkey,
  row_number() OVER (PARTITION BY o_custkey, o_orderkey % 100 ORDER BY o_orderkey) AS n
  FROM orders)""")
def allocate_names(spark, sf_dir):
    x = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("img-"), (F.col("o_orderkey") % 100).cast("string"), F.lit(".jpg")).alias("base"))
    return download.allocate_names(x, ["o_custkey"], "base", ["o_orderkey"]).select("o_orderkey", "filename")


_STATUS = "CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 'Downloaded' WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN 'Duplicate' WHEN l_linenumber % 2 = 0 THEN 'Skipped' ELSE 'Error' END"
_CHAIN = f"SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (WHERE st IN ('Downloaded', 'Duplicate')), max(l_linenumber)) AS chosen FROM (SELECT DISTINCT l_orderkey, l_linenumber, {_STATUS} AS st FROM lineitem) GROUP BY l_orderkey"


def _tries(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_STATUS).alias("status"))


@query(f"SELECT c.l_orderkey, c.chosen, {_STATUS.replace('l_orderkey', 'c.l_orderkey').replace('l_linenumber', 'c.chosen')} AS status FROM ({_CHAIN}) c")
def fallback_chain(spark, sf_dir):
    return download.fallback(_tries(spark, sf_dir), ["l_orderkey"], "l_linenumber")


@query(f"""SELECT l_orderkey % 10 AS run_id, count(*) FILTER (WHERE st = 'Downloaded') AS downloaded, count(*) FILTER (WHERE st = 'Skipped') AS skipped, count(*) FILTER (WHERE st = 'Duplicate') AS duplicates, count(*) FILTER (WHERE st = 'Error') AS errors, count(*) AS total_slots
  FROM (SELECT c.l_orderkey, {_STATUS.replace('l_orderkey', 'c.l_orderkey').replace('l_linenumber', 'c.chosen')} AS st
  FROM ({_CHAIN}) c)
  GROUP BY 1""")
def run_summary(spark, sf_dir):
    x = download.fallback(_tries(spark, sf_dir), ["l_orderkey"], "l_linenumber").withColumn("run_id", F.col("l_orderkey") % 10)
    return download.summary(x, ["run_id"])


@query("""WITH p AS (SELECT page_id, page_id // 10 AS run, page_id % 10 AS i FROM pages), t AS (SELECT *, page_id % 3 = 0 AS same FROM p)
SELECT CAST(run AS VARCHAR) AS run_id, CAST(i + 1 AS INTEGER) AS page_no, CASE WHEN same AND row_number() OVER (PARTITION BY run, same ORDER BY i) > 1 THEN 'Duplicate' ELSE 'Downloaded' END AS status,
CASE WHEN NOT same THEN 'i' || page_id || '.gif' WHEN row_number() OVER (PARTITION BY run, same ORDER BY i) = 1 THEN 'i' || page_id || '.gif' END AS filename FROM t""")
def run_state(spark, sf_dir):
    """Whole runs in serial order: every image of a run whose page_id is divisible by 3 has the same bytes."""
    s, same = F.col("page_id").cast("string"), F.col("page_id") % 3 == 0
    pages = _table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 10).cast("string").alias("run_id"), (F.col("page_id") % 10 + 1).cast("int").alias("page_no"), F.lit(BASE).alias("url"), F.concat(F.lit('<img src="i'), s, F.lit('.gif">')).alias("html"))
    body = F.concat(F.unhex(F.lit("47494638396108000800000000")), F.encode(F.when(same, "same").otherwise(s), "UTF-8"))
    responses = _table(spark, sf_dir, "pages").select(F.concat(F.lit(BASE + "i"), s, F.lit(".gif")).alias("url"), F.lit(200).alias("status_code"), F.lit("image/gif").alias("content_type"), F.lit(None).cast("string").alias("content_disposition"), body.alias("body"), F.lit(None).cast("string").alias("error"))
    x = extract.candidates(pages, keep=("run_id", "page_no"))
    return download.process(download.outcomes(x, responses)).select("run_id", "page_no", "status", "filename")
