"""Image formats and sizes from the first bytes of a body.

The format and the sizes that lie at fixed places (PNG, GIF, BMP, WebP) are column expressions; only formats whose
header must be walked through (JPEG, TIFF, AVIF) go through Arrow.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let

# Media types and extensions of the formats.
BY_TYPE = {"image/jpeg": "jpeg", "image/jpg": "jpeg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp", "image/x-ms-bmp": "bmp", "image/tiff": "tiff", "image/avif": "avif"}
BY_EXTENSION = {".jpg": "jpeg", ".jpeg": "jpeg", ".png": "png", ".gif": "gif", ".webp": "webp", ".bmp": "bmp", ".tif": "tiff", ".tiff": "tiff", ".avif": "avif"}
EXTENSION = {"jpeg": ".jpg", "png": ".png", "gif": ".gif", "webp": ".webp", "bmp": ".bmp", "tiff": ".tiff", "avif": ".avif"}
MIME = {f: f"image/{f}" for f in EXTENSION}
SNIFFED = 512


def _picked(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value)


def media_type(content_type: Column) -> Column:
    return F.lower(F.btrim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))


def is_raster_type(content_type: Column) -> Column:
    return media_type(content_type).isin([t for t in BY_TYPE if t != "image/x-ms-bmp"])


def _hex(body: Column, start: int, size: int) -> Column:
    return F.hex(F.substring(body, start, size))


def rejected(body: Column, content_type: Column, extension: Column) -> Column:
    """Why a body isn't a raster image whatever its bytes are: SVG, ICO, HTML, or null."""
    kind, ext = media_type(content_type), F.lower(F.regexp_replace(F.coalesce(extension, F.lit("")), r"^\.", ""))
    text = F.lower(F.decode(F.substring(body, 1, SNIFFED), "ISO-8859-1"))
    head = F.regexp_replace(text, r"^[\t\n\x0b\f\r ]+", "")
    svg = (kind == "image/svg+xml") | ext.isin("svg", "svgz") | F.contains(text, F.lit("<svg"))
    ico = kind.isin("image/x-icon", "image/vnd.microsoft.icon") | (ext == "ico") | (_hex(body, 1, 4) == "00000100")
    html = kind.isin("text/html", "application/xhtml+xml") | head.startswith("<!doctype html") | head.startswith("<html")
    return F.when(svg, "SVG").when(ico, "ICO").when(html, "HTML")


def _avif(body: Column) -> Column:
    header = _hex(body, 1, SNIFFED)
    size = F.conv(F.substring(header, 1, 8), 16, 10).cast("long")
    limit = F.when((size == 0) | (size > F.length(header) / 2), F.length(header) / 2).otherwise(size).cast("int")
    brands = F.concat(F.array(F.substring(header, 17, 8)), F.transform(F.when(limit >= 20, F.sequence(F.lit(16), limit - 4, F.lit(4))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(header, 2 * i + 1, F.lit(8))))
    return (F.length(header) >= 24) & (F.substring(header, 9, 8) == "66747970") & F.arrays_overlap(brands, F.array(F.lit("61766966"), F.lit("61766973")))


def sniff_format(body: Column, content_type: Column, extension: Column) -> Column:
    """The format by signature, else by media type, else by extension; null where none is known or the body is rejected."""
    signature = (
        F.when(_hex(body, 1, 3) == "FFD8FF", "jpeg").when(_hex(body, 1, 8) == "89504E470D0A1A0A", "png").when(_hex(body, 1, 6).isin("474946383761", "474946383961"), "gif")
        .when((_hex(body, 1, 4) == "52494646") & (_hex(body, 9, 4) == "57454250"), "webp").when(_hex(body, 1, 2) == "424D", "bmp")
        .when(_hex(body, 1, 4).isin("49492A00", "4D4D002A"), "tiff").when(_avif(body), "avif")
    )
    ext = F.lower(F.regexp_extract(F.coalesce(extension, F.lit("")), r"(\.[^.]*)$", 1))
    return F.when(rejected(body, content_type, extension).isNull(), F.coalesce(signature, _picked(media_type(content_type), BY_TYPE), _picked(ext, BY_EXTENSION)))


def _number(body: Column, start: int, size: int, little: bool = False) -> Column:
    parts = [_hex(body, start + i, 1) for i in range(size)]
    return F.conv(F.concat(*(reversed(parts) if little else parts)), 16, 10).cast("long")


def _walked(b: bytes | None) -> tuple[int, int] | None:
    try:
        if b is None:
            return None
        return jpeg_size(b) if b[:2] == b"\xff\xd8" else tiff_size(b) if b[:2] in (b"II", b"MM") else avif_size(b)
    except (struct.error, IndexError, KeyError, ValueError):
        return None


def jpeg_size(b: bytes) -> tuple[int, int] | None:
    """Width and height in the first frame header."""
    if b[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
        elif marker in (0xD9, 0xDA):
            return None
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", b, at + 5)
            return width, height
        else:
            at += 2 + struct.unpack_from(">H", b, at + 2)[0]
    return None


def tiff_size(b: bytes) -> tuple[int, int] | None:
    """Tags 256 and 257 of the first directory."""
    order = {b"II*\0": "<", b"MM\0*": ">"}[bytes(b[:4])]
    first = struct.unpack_from(order + "I", b, 4)[0]
    found = {}
    for i in range(struct.unpack_from(order + "H", b, first)[0]):
        tag, kind, _ = struct.unpack_from(order + "HHI", b, first + 2 + 12 * i)
        if tag in (256, 257):
            found[tag] = struct.unpack_from(order + {1: "B", 3: "H", 4: "I"}[kind], b, first + 10 + 12 * i)[0]
    return found[256], found[257]


def _boxes(b: bytes, at: int, end: int):
    """(type, first byte of the payload, end) of the boxes that lie in a range."""
    while at + 8 <= end:
        size, kind, head = struct.unpack_from(">I", b, at)[0], bytes(b[at + 4 : at + 8]), 8
        if size == 1:
            size, head = struct.unpack_from(">Q", b, at + 8)[0], 16
        stop = end if size == 0 else at + size
        if stop < at + head:
            return
        yield kind, at + head, min(stop, end)
        at = stop


def avif_size(b: bytes) -> tuple[int, int] | None:
    """The largest spatial extent in the item properties of the first meta box."""

    def inside(name: bytes, start: int, end: int):
        return next(((a, e) for kind, a, e in _boxes(b, start, end) if kind == name), None)

    if (meta := inside(b"meta", 0, len(b))) and (props := inside(b"iprp", meta[0] + 4, meta[1])) and (box := inside(b"ipco", *props)):
        sizes = [struct.unpack_from(">II", b, a + 4) for kind, a, e in _boxes(b, *box) if kind == b"ispe" and e - a >= 12]
        return max((s for s in sizes if min(s) > 0), key=lambda s: s[0] * s[1], default=None)
    return None


def _walked_column(bodies: pa.Array) -> pa.Array:
    sizes = [_walked(b) for b in bodies.to_pylist()]
    return pa.array([None if s is None else {"width": s[0], "height": s[1]} for s in sizes], pa.struct([("width", pa.int64()), ("height", pa.int64())]))


def image_info(body: Column, content_type: Column, extension: Column) -> Column:
    """struct<format, width, height, mime, extension>; null where no size above 0 can be read."""
    needs_walk = (_hex(body, 1, 2) == "FFD8") | _hex(body, 1, 4).isin("49492A00", "4D4D002A") | (_hex(body, 5, 4) == "66747970")
    walked = F.arrow_udf(_walked_column, "width long, height long")(F.when(needs_walk, body))
    none = F.lit(None).cast("string")
    known = F.struct(F.substring(body, 1, 64).alias("b"), sniff_format(body, content_type, extension).alias("kind"), sniff_format(body, none, none).alias("shown"), walked.alias("walked"))

    def sized(v: Column) -> Column:
        kind, size = v["kind"], let(v, _fixed_size)
        info = F.struct(kind.alias("format"), size["width"].alias("width"), size["height"].alias("height"), _picked(kind, MIME).alias("mime"), _picked(kind, EXTENSION).alias("extension"))
        # A format that only the header or the name claims has to have the bytes of one.
        return F.when(v["shown"] == kind, let(info, lambda i: F.when((i["width"] > 0) & (i["height"] > 0), i)))

    return let(known, sized)


def _fixed_size(v: Column) -> Column:
    """struct<width, height> from fixed places of PNG, GIF, BMP and WebP, else what the walk found."""
    body, kind, walked = v["b"], v["kind"], v["walked"]
    chunk, signed = _hex(body, 13, 4), lambda n: F.abs(F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n))
    masked = lambda at, size, mask: _number(body, at, size, True).bitwiseAND(F.lit(mask))
    packed = _number(body, 22, 4, True)
    webp_w = F.when(chunk == "56503820", masked(27, 2, 0x3FFF)).when(chunk == "5650384C", packed.bitwiseAND(F.lit(0x3FFF)) + 1).when(chunk == "56503858", _number(body, 25, 3, True) + 1)
    webp_h = F.when(chunk == "56503820", masked(29, 2, 0x3FFF)).when(chunk == "5650384C", F.shiftright(packed, 14).bitwiseAND(F.lit(0x3FFF)) + 1).when(chunk == "56503858", _number(body, 28, 3, True) + 1)
    width = F.when(kind == "png", _number(body, 17, 4)).when(kind == "gif", _number(body, 7, 2, True)).when(kind == "bmp", _number(body, 19, 4, True)).when(kind == "webp", webp_w).otherwise(walked["width"])
    height = F.when(kind == "png", _number(body, 21, 4)).when(kind == "gif", _number(body, 9, 2, True)).when(kind == "bmp", signed(_number(body, 23, 4, True))).when(kind == "webp", webp_h).otherwise(walked["height"])
    return F.struct(width.alias("width"), height.alias("height"))
