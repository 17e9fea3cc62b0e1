"""The ``srcset`` attribute: entries, their descriptors, and the order in which they are tried."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<url:string, width:bigint, density:double, descriptor:string>>"
_GAP = " \t\r\n"
_INT = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"[+-]?(?:(?:[0-9][0-9_]*)?\.?[0-9]+(?:[eE][+-]?[0-9]+)?|[0-9]+\.(?:[eE][+-]?[0-9]+)?|inf(?:inity)?)", re.I)


def entries(text: str) -> list[str]:
    """The attribute cut at commas outside parentheses that end an entry: white space stands in the entry or follows."""
    out, start, depth = [], 0, 0
    for i, c in enumerate(text + ","):
        last = i == len(text)
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(depth - 1, 0)
        elif c == "," and (last or not depth):
            body = text[start:i].lstrip(_GAP + ",")
            if last or not body or any(g in body for g in _GAP) or text[i + 1 : i + 2] in tuple(_GAP):
                if body.strip(_GAP):
                    out.append(body.strip(_GAP))
                start, depth = i + 1, 0
    return out


def parse(text: str | None) -> list[dict]:
    """url, width, density and descriptor of each entry; entries with data: URIs are left out, bad numbers count as 0."""
    out = []
    for entry in entries(text or ""):
        url, *more = entry.split()
        if url.lower().startswith("data:"):
            continue
        descriptor = more[0] if more else ""
        number, unit = descriptor[:-1], descriptor[-1:].lower()
        width, density = 0, 0.0
        if unit == "w" and _INT.fullmatch(number) and 0 < int(number) < 1 << 63:
            width = int(number)
        elif unit == "x" and _FLOAT.fullmatch(number) and "_" not in number and float(number) > 0:
            density = float(number)
        out.append({"url": url, "width": width, "density": density, "descriptor": descriptor})
    return out


def ordered(found: list[dict]) -> list[dict]:
    """Widest first, then densest. Where entries tie the order is that of repeated exchanges with the front place."""
    rank = [(e["width"], e["density"]) for e in found]
    order = list(range(len(found)))
    for front in range(len(order)):
        for k in range(front + 1, len(order)):
            if rank[order[k]] > rank[order[front]]:
                order[front], order[k] = order[k], order[front]
    return [found[i] for i in order]


_KIND = pa.list_(pa.struct([("url", pa.string()), ("width", pa.int64()), ("density", pa.float64()), ("descriptor", pa.string())]))


def _column(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else ordered(parse(t)) for t in texts.to_pylist()], _KIND)


def _plain(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else parse(t) for t in texts.to_pylist()], _KIND)


def srcset_entries(text: Column | str) -> Column:
    """The entries of a srcset in document order."""
    return F.arrow_udf(_plain, TYPE)(text)


def parse_srcset(text: Column | str) -> Column:
    """The entries of a srcset, best first."""
    return F.arrow_udf(_column, TYPE)(text)


def best_entry(found: Column | str) -> Column:
    """Of entries in document order the widest; without widths the densest, the first among equals; without both the last."""
    entries_ = F.col(found) if isinstance(found, str) else found

    def most(name: str) -> Column:
        """The largest width or density, null where none is above 0."""
        top = F.array_max(F.transform(entries_, lambda e: e[name]))
        return F.when(top > 0, top)

    def first(name: str) -> Column:
        return F.get(F.filter(entries_, lambda e: e[name] == most(name)), F.lit(0))

    last = F.when(F.size(entries_) > 0, F.element_at(entries_, -1))
    return F.when(most("width").isNotNull(), first("width")).when(most("density").isNotNull(), first("density")).otherwise(last)
