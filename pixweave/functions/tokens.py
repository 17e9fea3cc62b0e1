"""Identifying tokens of URLs, as column expressions over ``urls.url_parts``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import url_parts

# Words that identify nothing, frequent image sizes, and query keys that are not looked at.
STOP_WORDS = (
    "photo photos image images picture pictures gallery galleries album albums item items media asset assets detail view full large medium small "
    "thumb thumbs thumbnail thumbnails mini frame framed preview original scaled master standard secure token hash width height size index default "
    "page pages next prev previous first last show display download upload uploads content static public file files attachment pic pics html htm php asp"
).split()
DIMENSIONS = "100 150 200 250 256 300 400 500 600 800 1024 1080 1200 1280 1600 1920 2048 2560 3840 4096".split()
SKIPPED_KEYS = "page view w h width height".split()

_SPLIT = r"[^a-zA-Z0-9_\-]+"


def path_unescape(text: Column) -> Column:
    """Percent-decoded once, "+" kept; the text itself where an escape is broken."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def clean_tokens(words: Column) -> Column:
    """The words that identify something, lower-cased, each once."""

    def kept(t: Column) -> Column:
        number = t.rlike(r"^\p{Nd}+$") & ~t.isin(DIMENSIONS)
        mixed = ~t.rlike(r"^\p{Nd}+$") & t.rlike(r"[0-9_\-]")
        return (F.octet_length(t) >= 4) & ~t.isin(STOP_WORDS) & (number | mixed)

    return F.array_distinct(F.filter(F.transform(words, lambda w: F.btrim(F.lower(F.trim(w)), F.lit("-_."))), kept))


def tokens_of(parts: Column) -> Column:
    """The tokens of a URL given as ``url_parts``: file stem, words of the path, words of the query's values."""
    path = path_unescape(parts["path"])
    base = F.regexp_extract(F.rtrim(path, F.lit("/")), r"([^/]*)$", 1)
    stem = F.when(F.contains(base, F.lit(".")), F.array(F.regexp_extract(base, r"(?s)^(.*)\.[^.]*$", 1))).otherwise(F.array().cast("array<string>"))
    values = F.filter(parts["query"], lambda q: ~F.lower(q["key"]).isin(SKIPPED_KEYS))
    words = F.flatten(F.transform(values, lambda q: F.split(q["value"], _SPLIT)))
    return F.coalesce(clean_tokens(F.concat(stem, F.split(path, _SPLIT), words)), F.array().cast("array<string>"))


def url_tokens(url: Column | str) -> Column:
    return tokens_of(url_parts(url))
