import struct

import pytest
from pyspark.sql import functions as F

from pixweave.functions import images, names, srcset, tokens, urls

BASE = "https://example.com/gallery/page1.html"


@pytest.mark.parametrize(("raw", "expected"), [
    ("photo.jpg", "https://example.com/gallery/photo.jpg"), ("/img/a.png", "https://example.com/img/a.png"), ("../up.gif", "https://example.com/up.gif"),
    ("https://cdn.example.net/x.jpg", "https://cdn.example.net/x.jpg"), ("//cdn.example.net/y.jpg", "https://cdn.example.net/y.jpg"), ("a.jpg#top", "https://example.com/gallery/a.jpg"),
    ("a.jpg?w=1&h=2", "https://example.com/gallery/a.jpg?w=1&h=2"), ("a b.jpg", "https://example.com/gallery/a%20b.jpg"), ("Ünd%20x.jpg", "https://example.com/gallery/%C3%9Cnd%20x.jpg"),
    ("DATA:image/png;base64,xx", None), ("mailto:a@b.c", None), ("", None), ("%zz.jpg", None), ("a:b/c.jpg", None), ("HTTP://Host.Example/A", "http://Host.Example/A"), ("?q=1", "https://example.com/gallery/page1.html?q=1"),
])
def test_resolve(raw, expected):
    got = urls.resolved(urls.parse(BASE), raw)
    assert (str(got) if got else None) == expected


def test_resolve_column(spark):
    df = spark.createDataFrame([(BASE, "x.jpg"), (None, "x.jpg"), (BASE, None), ("::", "x")], "b string, r string")
    assert [r[0] for r in df.select(urls.resolve_url("b", "r")).collect()] == ["https://example.com/gallery/x.jpg", None, None, None]


def test_origin_ignores_ports():
    assert urls.same_origin(urls.parse("https://A.example:8443/x"), urls.parse("https://a.example/y"))
    assert not urls.same_origin(urls.parse("http://a.example/"), urls.parse("https://a.example/"))


def test_srcset():
    got = srcset.parse("a.jpg 100w, b.jpg 2x, data:x 3x, c.jpg, d,e.jpg 50W x, f(1,2).jpg bad")
    assert [(e["url"], e["width"], e["density"], e["descriptor"]) for e in got] == [("a.jpg", 100, 0.0, "100w"), ("b.jpg", 0, 2.0, "2x"), ("c.jpg", 0, 0.0, ""), ("d,e.jpg", 50, 0.0, "50W"), ("f(1,2).jpg", 0, 0.0, "bad")]
    assert [e["url"] for e in srcset.parse("a.jpg,b.jpg")] == ["a.jpg,b.jpg"]
    widths = [{"url": u, "width": w, "density": 0.0, "descriptor": ""} for u, w in (("A", 1), ("B", 1), ("C", 2))]
    assert [e["url"] for e in srcset.ordered(widths)] == ["C", "B", "A"]


def test_tokens(spark):
    df = spark.createDataFrame([("https://x.example/photos/IMG_1234-full/Beach%252D99.jpg?page=abc99&ref=id-7788&w=5555",), (None,), ("::",)], "u string")
    got = [sorted(r[0]) for r in df.select(tokens.url_tokens("u")).collect()]
    assert got == [["beach-99", "id-7788", "img_1234-full"], [], []]


def test_filenames(spark):
    def run(expr, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(expr(F.col("v"))).collect()]

    assert run(names.sanitize, "../../etc/passwd.jpg", 'bad:file*name?"<yes>|pipe.png', "CON.jpg", "aux.png", "nul", "trailing_dots...jpg", "trailing_spaces   .png", "", ".jpg", "  ", ".") == [
        "passwd.jpg", "bad_file_name___yes__pipe.png", "_CON.jpg", "_aux.png", "_nul", "trailing_dots.jpg", "trailing_spaces.png", "", "", "", ""]
    assert run(lambda c: names.ensure_extension(c, F.lit(".jpg")), "photo", "photo.jpg", "photo.jpeg", "a.dat", "", "x.JPG") == ["photo.jpg", "photo.jpg", "photo.jpeg", "a.jpg", "", "x.JPG"]
    assert run(lambda c: names.ensure_extension(c, F.lit(".png")), "photo.JPG") == ["photo.JPG.png"]
    assert run(names.disposition_filename, 'attachment; filename="original_artwork.png"', "inline; filename=picture.jpg", "attachment; filename*=UTF-8''my%20summer%20vacation.jpg", "", "inline", None) == ["original_artwork.png", "picture.jpg", "my summer vacation.jpg", "", "", ""]
    paths = lambda c: names.filename_from_path(urls.url_parts(c)["path"])
    assert run(paths, "https://e.com/photos/cat.jpg?w=4", "https://e.com/i/summer%20beach.png#s", "https://e.com/download/photo", "https://e.com/") == ["cat.jpg", "summer beach.png", "photo", ""]


def test_folders(spark):
    from pixweave.plans.crawl import folders

    df = spark.createDataFrame([("https://WWW.Example.com/gallery",), ("https://example.com/",), ("https://e.com/a%20b/" + "x" * 80,), ("http://h.example/p#frag",)], "url string")
    got = {r.url: (r.host_folder, r.page_folder) for r in folders(df).collect()}
    assert got["https://WWW.Example.com/gallery"][0] == "Example.com"
    assert got["https://example.com/"][1].startswith("root-")
    assert got["https://e.com/a%20b/" + "x" * 80][1].startswith("a-b-" + "x" * 60 + "-")
    assert len(got["http://h.example/p#frag"][1]) == len("p-") + 8


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 300, 200) + b"\x08\x02\0\0\0"
    gif = b"GIF89a" + struct.pack("<HH", 150, 150) + b"\0\0\0"
    bmp = b"BM" + bytes(12) + struct.pack("<Iii", 40, 120, -80)
    jpeg = b"\xff\xd8\xff\xe0\0\x04\0\0\xff\xc2\0\x11\x08" + struct.pack(">HH", 250, 400) + b"\x03"
    lossy = b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 640, 480)
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", (77 - 1) | (55 - 1) << 14)
    rows = [(png, None, None), (gif, None, None), (bmp, None, None), (jpeg, None, None), (lossy, None, None), (lossless, None, None), (png, "image/svg+xml", None), (png, None, ".ico"), (b" <!DOCTYPE html>", None, None), (png, "text/html; x", None), (b"junk", "image/png", None), (None, None, None), (b"", None, ".png"), (b"\xff\xd8\xff", None, None)]
    df = spark.createDataFrame(rows, "b binary, t string, e string").select(images.image_info(F.col("b"), F.col("t"), F.col("e")).alias("i"))
    got = [(r.i.format, r.i.width, r.i.height) if r.i else None for r in df.collect()]
    assert got == [("png", 300, 200), ("gif", 150, 150), ("bmp", 120, 80), ("jpeg", 400, 250), ("webp", 640, 480), ("webp", 77, 55), *[None] * 8]
