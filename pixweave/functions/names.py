"""Names for files and folders, as column expressions."""

from __future__ import annotations

from email.message import Message

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let
from .tokens import path_unescape

# Names that Windows keeps for itself.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10))]
COMPATIBLE = {".jpg": (".jpg", ".jpeg", ".jpe", ".jfif"), ".jpeg": (".jpg", ".jpeg", ".jpe", ".jfif"), ".tif": (".tif", ".tiff"), ".tiff": (".tif", ".tiff")}
WHITE = " \t\n\u000b\f\r"


def _extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)(\.[^.]*)$", 1)


def _stem(name: Column, ext: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext))


def sanitize(name: Column) -> Column:
    """A safe file name, or the empty string where nothing is left of it."""
    base = F.regexp_extract(F.rtrim(F.btrim(name, F.lit(WHITE)), F.lit("/")), r"(?s)([^/]*)$", 1)

    def safe(clean: Column) -> Column:
        ext = _extension(clean)

        def joined(stem: Column) -> Column:
            own = F.when(F.upper(stem).isin(RESERVED), F.concat(F.lit("_"), stem)).otherwise(stem)
            return F.when(stem == "", "").otherwise(F.concat(own, F.rtrim(ext, F.lit(" ."))))

        return let(F.rtrim(_stem(clean, ext), F.lit(" .")), joined)

    return let(F.regexp_replace(F.nullif(base, F.lit(".")), r'[\\/:*?"<>|\x00-\x1f]', "_"), lambda c: F.coalesce(safe(c), F.when(name.isNotNull(), "")))


def ensure_extension(name: Column, detected: Column) -> Column:
    """The name, with the detected extension unless it has one that means the same."""

    def ensured(v: Column) -> Column:
        name, ext, low = v["name"], v["ext"], v["low"]
        want = F.when(low.startswith("."), low).otherwise(F.concat(F.lit("."), low))
        same = ext == want
        for kind, others in COMPATIBLE.items():
            same = same | (want == kind) & ext.isin(*others)
        # An extension in capitals stays in the name when another one is added.
        stem = F.when((ext != "") & name.endswith(ext), _stem(name, ext)).otherwise(name)
        return F.when(name == "", "").when((ext != "") & (ext != ".") & same, name).otherwise(F.concat(stem, want))

    return let(name, lambda n: let(F.struct(n.alias("name"), F.lower(_extension(n)).alias("ext"), F.lower(detected).alias("low")), ensured))


def filename_from_path(path: Column) -> Column:
    """A file name from a URL's decoded path; its last segment is decoded a second time."""
    base = F.regexp_extract(F.rtrim(path, F.lit("/")), r"(?s)([^/]*)$", 1)
    return let(base, lambda b: F.when(b.isin("", "."), "").otherwise(let(path_unescape(b), sanitize)))


def _disposition(headers: pa.Array) -> pa.Array:
    out = []
    for h in headers.to_pylist():
        message = Message()
        message["content-disposition"] = (h or "").replace("\r", " ").replace("\n", " ")
        balanced = (h or "").count('"') % 2 == 0
        name = message.get_filename(failobj="") if h and h.strip() and balanced else ""
        out.append(name or "")
    return pa.array(out, pa.string())


def disposition_filename(header: Column) -> Column:
    """The safe file name of a Content-Disposition header; empty where it has none or can't be read."""
    return let(F.arrow_udf(_disposition, "string")(header), sanitize)


def resolve_filename(disposition: Column, path: Column, detected: Column, sha: Column) -> Column:
    """A file name from the header, else from the URL's path, else from the content's digest."""
    digest = F.when(F.coalesce(sha, F.lit("")) == "", "asset").otherwise(F.substring(sha, 1, 8))
    given = F.struct(disposition_filename(disposition).alias("a"), filename_from_path(path).alias("b"), F.concat(F.lit("image_"), digest).alias("c"))
    named = let(given, lambda g: F.coalesce(F.nullif(g["a"], F.lit("")), F.nullif(g["b"], F.lit("")), g["c"]))
    final = let(ensure_extension(named, detected), sanitize)
    return let(final, lambda f: F.when(f == "", F.concat(F.lit("image_"), digest, detected)).otherwise(f))


def host_folder(hostname: Column) -> Column:
    host = F.regexp_replace(hostname, r"^(?i:www\.)", "")
    clean = F.btrim(F.regexp_replace(host, r"[^a-zA-Z0-9.\-_]", "_"), F.lit(" ._"))
    return F.when(clean == "", "site").otherwise(clean)


def page_folder(parts: Column) -> Column:
    """Slug of the path and 8 hex digits of the URL's SHA-256, for a URL given as ``url_parts``."""
    tail = F.substring(F.regexp_replace(parts["url"], "#.*$", ""), F.length(parts["scheme"]) + F.length(parts["host"]) + 4, F.length(parts["url"]))
    digest = F.left(F.sha2(F.concat(parts["scheme"], F.lit("://"), F.lower(parts["host"]), tail), 256), F.lit(8))
    slug = F.regexp_replace(F.regexp_replace(F.btrim(path_unescape(parts["path"]), F.lit("/")), r"[^a-zA-Z0-9_\-]+", "-"), "-+", "-")
    short = F.rtrim(F.substring(F.btrim(F.lower(slug), F.lit("-_.")), 1, 64), F.lit("-_."))
    return F.concat(F.when(short == "", "root").otherwise(short), F.lit("-"), digest)
