import http.server
import threading

import pytest
from pyspark.sql import functions as F

from pixweave.operators import download, extract, landing, paginate
from pixweave.plans import crawl, live, options, queries
from pixweave.sources import files, html, http as web

PAGE = "https://example.com/gallery/"
GIF = b"GIF89a\x2c\x01\xc8\x00\0\0\0"


def slots_of(spark, markup, url=PAGE):
    rows = extract.candidates(spark.createDataFrame([(url, markup)], "url string, html string")).collect()
    return [(r.slot_idx, r.cand_idx, r.source, r.priority, r.resolved_url.removeprefix("https://example.com/")) for r in sorted(rows, key=lambda r: (r.slot_idx, r.cand_idx))]


def test_tree():
    root = html.parse("<ul><li>a<li>b</ul><a href=x>1<a href=y>2</a><p>q<div>r</div><noscript><img src=n></noscript><br/>")
    tags = [(n.tag, n.parent.tag) for n, e in root.walk() if e and n.tag and n.parent]
    assert tags == [("ul", "#document"), ("li", "ul"), ("li", "ul"), ("a", "#document"), ("a", "#document"), ("p", "#document"), ("div", "#document"), ("noscript", "#document"), ("br", "#document")]
    assert html.parse("<div>" * 5000).exit == 5000


def test_all_sources(spark):
    got = slots_of(spark, """<html><head><meta property="og:image" content="/og.jpg"><style>b{background:url("/css.png")}</style>
      <script type="application/ld+json">{"image":["/j1.jpg",{"url":"/no.jpg"}],"x":{"@type":"imageobject","url":"/j2.jpg"}}</script></head>
      <body style="background:url(in.png)"><a href="/full.jpg"><img src="t.jpg" data-full="f.jpg"></a><a href="/about.html">x</a><a href="alone.webp">y</a>
      <picture><source srcset="s1.jpg 1x, s2.jpg 2x"><img data-src="lazy.jpg" src="plain.jpg"></picture><img alt="none"></body></html>""")
    assert got == [
        (1, 1, "meta-og", 35, "og.jpg"), (2, 1, "css-block", 20, "css.png"), (3, 1, "json-ld", 30, "j1.jpg"), (4, 1, "json-ld", 32, "j2.jpg"), (5, 1, "css-inline", 20, "gallery/in.png"),
        (6, 1, "anchor-image", 100, "full.jpg"), (6, 2, "data-original", 90, "gallery/f.jpg"), (6, 3, "img-src", 50, "gallery/t.jpg"), (7, 1, "standalone-anchor", 40, "gallery/alone.webp"),
        (8, 1, "picture-source", 80, "gallery/s2.jpg"), (8, 2, "picture-source", 78, "gallery/s1.jpg"), (8, 3, "data-src", 60, "gallery/lazy.jpg"), (8, 4, "img-src", 50, "gallery/plain.jpg"),
    ]


def test_slot_keeps_first_of_equal_urls(spark):
    assert slots_of(spark, '<a href="a.jpg"><img src="a.jpg#x" data-src="a.jpg"></a>') == [(1, 1, "anchor-image", 100, "gallery/a.jpg")]


def test_empty_pages(spark):
    df = spark.createDataFrame([(PAGE, None), (PAGE, ""), (None, "<img src=x>"), ("::", "<img src=x>")], "url string, html string")
    assert extract.candidates(df).count() == 0 and extract.slots(df).count() == 0
    assert df.select(paginate.next_page("html", "url")).filter("`" + df.select(paginate.next_page("html", "url")).columns[0] + "` is not null").count() == 0


@pytest.mark.parametrize(("markup", "expected"), [
    ('<link rel="next" href="/p2">', "p2"), ('<a rel="nofollow NEXT" href="/p2">x</a>', "p2"), ('<a aria-label="Next" href="/p2">x</a>', "p2"), ('<a title="следующая" href="/p2">x</a>', "p2"),
    ('<nav><a href="/p2">Next »</a></nav>', "p2"), ('<div class="my-pager"><p><a href="/p2">[next]</a></p></div>', "p2"), ('<a href="/p2">next</a>', None), ('<div><b>2</b><a href="/p2">next page</a></div>', "p2"),
    ('<a rel="next" href="#">x</a>', None), ('<a rel="next" href="http://other.example/p">x</a>', None), ('<a rel="next" href="/gallery/#f">x</a>', None), ('<a rel="next" href="javascript:go()">x</a>', None),
    ('<nav><a href="/late">next</a></nav><a rel="next" href="/rel">x</a>', "rel"),
])
def test_next_page(markup, expected):
    found = paginate.links(markup, PAGE)
    assert (min(found)[2].removeprefix("https://example.com/") if found else None) == expected


def test_walk(spark):
    pages = spark.createDataFrame([("https://e.com/1", "https://E.com/2"), ("https://e.com/2", "https://e.com/3#x"), ("https://e.com/3", "https://e.com/1"), ("https://e.com/9", "https://e.com/gone")], "url string, next_url string")
    starts = spark.createDataFrame([("a", "https://e.com/1"), ("b", "https://e.com/9")], "run_id string, url string")
    got = sorted(tuple(r) for r in paginate.walk(pages, starts).collect())
    assert got == [("a", 1, "https://e.com/1", True), ("a", 2, "https://E.com/2", True), ("a", 3, "https://e.com/3#x", True), ("b", 1, "https://e.com/9", True), ("b", 2, "https://e.com/gone", False)]
    assert paginate.walk(pages, starts, 2).count() == 4


def responses(spark, rows):
    return spark.createDataFrame([(u, None, s, t, d, b, e, 1) for u, s, t, d, b, e in rows], web.RESPONSES)


def test_landing(spark):
    pages = spark.createDataFrame([("r", i, PAGE, f'<a href="/v/{i}"><img src="/t/pic-{i}00{i}.jpg"></a>') for i in range(1, 6)], "run_id string, page_no int, page_url string, html string")
    slots = extract.slots(pages, url="page_url")
    tie = b'<img src="/a/pic-2002.jpg"><img src="/b/pic-2002.jpg">'
    answers = responses(spark, [
        ("https://example.com/v/1", 200, "text/html", None, b'<img src="/o/pic-1001.jpg"><img src="/o/other-77.jpg">', None), ("https://example.com/v/2", 200, "text/html", None, tie, None),
        ("https://example.com/v/3", 200, "IMAGE/PNG; x", None, b"", None), ("https://example.com/v/4", 403, None, None, None, "HTTP 403"), ("https://example.com/v/5", 200, "text/html", None, b'<img src="/t/pic-5005.jpg">', None),
    ])
    got = {r.page_no: r.candidates[0].resolved_url for r in landing.resolve(slots, answers, use_index=False).collect()}
    at = "https://example.com/"
    assert got == {1: at + "o/pic-1001.jpg", 2: at + "t/pic-2002.jpg", 3: at + "v/3", 4: at + "t/pic-4004.jpg", 5: at + "t/pic-5005.jpg"}


def test_landing_index(spark):
    pages = spark.createDataFrame([("r", 1, PAGE, '<a href="/v/1"><img src="/t/pic-1001.jpg"></a><a href="/v/2"><img src="/t/pic-2002.jpg"></a>')], "run_id string, page_no int, page_url string, html string")
    html_ = b'<img srcset="/o/pic-1001.jpg 9w" src="/x.jpg"><img srcset="/o/pic-2002.jpg 9w">'
    got = landing.resolve(extract.slots(pages, url="page_url"), responses(spark, [("https://example.com/v/1", 200, "text/html", None, html_, None)])).collect()
    assert sorted(r.candidates[0].resolved_url for r in got) == ["https://example.com/o/pic-1001.jpg", "https://example.com/o/pic-2002.jpg"]


def test_runs(spark):
    body = lambda x: GIF + x
    pages = spark.createDataFrame([(PAGE, '<img src="/1.gif"><img src="/1.gif"><img data-src="/bad.gif" src="/2.gif"><img src="/x/2.gif"><img src="/missing.gif"><img src="/page.gif">')], "url string, html string")
    answers = responses(spark, [
        ("https://example.com/1.gif", 200, None, None, body(b"a"), None), ("https://example.com/2.gif", 200, None, 'inline; filename="1.gif"', body(b"b"), None),
        ("https://example.com/x/2.gif", 200, None, None, body(b"a"), None), ("https://example.com/page.gif", 200, "text/html", None, b"<html>", None), ("https://example.com/bad.gif", 500, None, None, None, "HTTP 500"),
    ])
    results, totals = crawl.crawl_one(options.CrawlOptions(PAGE), pages, answers)
    got = sorted((r.slot_idx, r.status, r.filename) for r in results.collect())
    assert got == [(1, "Downloaded", "1.gif"), (2, "Duplicate", None), (3, "Downloaded", "1_2.gif"), (4, "Duplicate", None), (5, "Error", None), (6, "Skipped", None)]
    assert totals.first().asDict() == {"run_id": "run", "pages": 1, "downloaded": 2, "skipped": 1, "duplicates": 2, "errors": 1, "total_slots": 6}
    small, _ = crawl.crawl_one(options.CrawlOptions(PAGE, limit_size=301), pages, answers)
    assert small.filter("status = 'Downloaded'").count() == 0


@pytest.mark.parametrize(("w", "h", "keep"), [(255, 255, False), (256, 255, True), (255, 256, True), (256, 256, True)])
def test_size(spark, w, h, keep):
    assert spark.range(1).select(download.keeps_size(F.lit(w), F.lit(h), 256)).first()[0] is keep


def test_names():
    taken = download.Names()
    assert [taken.allocate(n) for n in ("image.jpg", "image.jpg", "image_2.jpg", "image.jpg")] == ["image.jpg", "image_2.jpg", "image_2_2.jpg", "image_3.jpg"]


def test_cli():
    run = lambda args: options.main(args, run=lambda _: None)
    assert [run(a) for a in ([], ["https://a.com", "https://b.com"], ["ftp://a.com"], ["--limit-size", "-10", "https://a.com"], ["--workers", "0", "https://a.com"], ["--version"], ["--help"], ["https://a.com", "--max-pages", "2", "-v"])] == [2, 2, 2, 2, 2, 0, 0, 0]
    assert options.parse_args(["https://a.com", "--max-pages", "1"]).paginates is False


def test_retries():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            status = {"/flaky": 503 if len(seen) < 3 else 200, "/no": 404}.get(self.path, 200)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(b"x" * 100)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at, waits = f"http://127.0.0.1:{server.server_port}", []
    client = web.Client(sleep=waits.append)
    row = client.get(at + "/flaky")
    assert (row[2], row[5], row[7]) == (200, b"x" * 100, 3) and 0.2 <= waits[0] <= 0.3 and 0.4 <= waits[1] <= 0.5
    assert client.get(at + "/no")[6:] == ("HTTP 404", 1)
    assert client.get(at + "/big", limit=50)[6] == "body exceeds the size limit"
    assert client.get("ftp://x")[6] == "unsupported scheme"
    server.shutdown()
    assert web.retry_after("7") == 7 and web.retry_after("x") is None and web.pause(1, "99") == 10


def test_stream(spark, tmp_path):
    from pixweave.streaming import incremental

    spark.createDataFrame([(1, PAGE, "<img src=a.jpg>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    q = incremental.write_candidates(incremental.read_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_walk_from_every_page(spark, tmp_path):
    ids = [*range(40), 52, 53]  # the table ends in the middle of a chain, and has gaps
    spark.createDataFrame([(i, PAGE, "") for i in ids], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = set()
    for start in ids:
        n, seen = start, []
        while n not in seen:
            seen.append(n)
            want.add((str(start), len(seen), queries.BASE + str(n), n in ids))
            if n not in ids:
                break
            n = n - 3 if n % 10 == 6 else n + 1
    got = [tuple(r) for r in queries.QUERIES["pagination_walk"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.fixture
def site():
    """A small site: two gallery pages, a landing page, images, a dead link; it notes cookies and referers."""
    gif, seen = GIF, []
    files = {
        "/g/1": ("text/html", b'<img src="/i/one.gif"><img src="/i/copy.gif"><img data-src="/i/dead.gif" src="/i/two.gif"><a href="/v/9"><img src="/t/pic-9009.gif"></a><img src="/i/odd name\xc3\xa9.gif"><a rel="next" href="/g/2">x</a>'),
        "/g/2": ("text/html", b'<img src="/i/one.gif"><a rel="next" href="/g/1">x</a>'),
        "/v/9": ("text/html", b'<img srcset="/o/pic-9009.gif 900w">'),
        "/i/one.gif": ("image/gif", gif + b"1"), "/i/copy.gif": ("image/gif", gif + b"1"), "/i/two.gif": ("image/gif", gif + b"2"),
        "/t/pic-9009.gif": ("image/gif", gif + b"t"), "/o/pic-9009.gif": ("image/gif", gif + b"o"), "/i/odd%20name%C3%A9.gif": ("image/gif", gif + b"n"),
    }

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers.get("Referer"), self.headers.get("Cookie")))
            kind, body = files.get(self.path, (None, b""))
            self.send_response(200 if kind else 404)
            if kind:
                self.send_header("Content-Type", kind)
            if self.path == "/g/1":
                self.send_header("Set-Cookie", "session=s1; Path=/")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_live_run(spark, site, tmp_path):
    at, seen = site
    said = []
    totals = live.run(spark, options.CrawlOptions(at + "/g/1", output_dir=str(tmp_path), all_pages=True, resolve_landings=True), said.append)
    assert totals == {"pages": 2, "downloaded": 4, "skipped": 0, "duplicates": 2, "errors": 0, "total_slots": 6}
    held = sorted(p.name for p in tmp_path.rglob("*.gif"))
    assert len(held) == 4 and {"one.gif", "two.gif", "pic-9009.gif"} <= set(held) and not [p for p in tmp_path.rglob("*") if p.name.endswith(".tmp")]
    assert said[0] == "[1/5] one.gif" and said[-1].split() == "Done. Pages processed: 2 Images downloaded: 4 Skipped: 0 Duplicates: 2 Errors: 0".split()
    images_ = [(r, c) for p, r, c in seen if p.startswith(("/i/", "/o/"))]
    assert {r for r, _ in images_} == {at + "/g/1"} and {c for _, c in images_} == {"session=s1"}
    assert "/t/pic-9009.gif" not in [p for p, _, _ in seen]  # the original came first
    totals = live.run(spark, options.CrawlOptions(at + "/g/1", output_dir=str(tmp_path), verbose=True), said.append)
    assert totals["downloaded"] == 4 and len([*tmp_path.rglob("*.gif")]) == 8  # names on disk aren't given out again
    assert any("FALLBACK" in x and "/i/dead.gif failed (HTTP 404)" in x for x in said) and any("DUPLICATE: identical content to" in x for x in said)
    assert live.run(spark, options.CrawlOptions(at + "/none", output_dir=str(tmp_path)), said.append)["errors"] == 1


def test_odd_urls_dont_end_a_run():
    client = web.Client(sleep=lambda s: None)
    assert web.escaped("http://bücher.example/ä b?q=ü&x=%20") == "http://xn--bcher-kva.example/%C3%A4%20b?q=%C3%BC&x=%20"
    assert client.get("http://127.0.0.1:1/a b")[6] and client.get("http://[bad/")[6] and client.get("http://" + "é" * 80 + ".example/")[6].startswith("invalid URL")


def test_files(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    assert [(r.length, r.sha256) for r in files.hashed(spark, str(tmp_path / "in")).collect()] == [(3, hashlib.sha256(b"abc").hexdigest())]
    assert files.names_on_disk(spark, str(tmp_path / "none")).count() == 0 and files.names_on_disk(spark, str(tmp_path / "in")).first().filename == "a.bin"
    rows = spark.createDataFrame([("ok.gif", bytearray(b"x")), ("no/such/folder.gif", bytearray(b"y"))], "filename string, body binary")
    got = {r.filename: (r.bytes, r.error) for r in files.saved(rows, str(tmp_path / "out")).collect()}
    assert got["ok.gif"] == (1, None) and got["no/such/folder.gif"][1] and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["ok.gif"]


def test_unsaved_files_roll_back():
    """A content that couldn't be saved is new again for the next slot."""
    row = lambda slot, unsaved: {"run_id": "r", "page_no": 1, "slot_idx": slot, "cand_idx": 1, "resolved_url": f"u{slot}", "outcome": "Downloaded", "reason": None, "sha256": "s", "width": 1, "height": 1, "base_name": "a.gif", "unsaved": unsaved}
    assert [(r["status"], r["filename"]) for r in download.fold([row(1, "disk full"), row(2, None), row(3, None)])] == [("Error", None), ("Downloaded", "a_2.gif"), ("Duplicate", None)]


def test_set_based_runs_equal_the_fold(spark):
    """Slots that share nothing are settled by aggregation, others in order; together they give what one fold gives."""
    import random

    rnd = random.Random(4)
    rows = []
    for run in range(3):
        for slot in range(60):
            for cand in range(1, rnd.randint(1, 3) + 1):
                outcome = rnd.choice(["Downloaded", "Downloaded", "Error", "Skipped"])
                name = rnd.choice([f"n{slot}.gif", f"n{slot}_2.gif", "same.gif", "same_2.gif", "plain"])
                rows.append((f"r{run}", 1 + slot // 20, slot % 20, cand, f"u{rnd.randint(0, 90)}", outcome, outcome.lower(), f"s{rnd.randint(0, 60)}" if outcome != "Error" else None, 3, 4, name if outcome == "Downloaded" else None, "disk" if rnd.random() < 0.05 and outcome == "Downloaded" else None))
    schema = "run_id string, page_no int, slot_idx int, cand_idx int, resolved_url string, outcome string, reason string, sha256 string, width long, height long, base_name string, unsaved string"
    columns = [c.split()[0] for c in schema.split(", ")]
    want = [r for run in range(3) for r in download.fold([dict(zip(columns, x)) for x in rows if x[0] == f"r{run}"])]
    key = lambda r: (r["run_id"], r["page_no"], r["slot_idx"])
    got = [r.asDict() for r in download.process(spark.createDataFrame(rows, schema)).collect()]
    pick = ("status", "filename", "cand_idx", "reason")
    assert [(key(r), *(r[c] for c in pick)) for r in sorted(got, key=key)] == [(key(r), *(r[c] for c in pick)) for r in sorted(want, key=key)]
