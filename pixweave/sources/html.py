"""HTML pages as trees of nodes, and as tables.

No parser library is at hand, so the tree is built on the standard library's tokenizer with the common rules of HTML:
void elements, implied end tags, an open link that ends at the next link, raw text in scripts, styles and noscript.
Foster parenting and the adoption agency are not modelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe noembed noframes xmp".split())
DECODED = frozenset(("textarea", "title"))
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An opening tag ends these open elements, up to the nearest of the second set.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
WHITE = " \t\n\v\f\r\x85\xa0                　"


class Node:
    """An element, or a text if ``tag`` is None."""

    __slots__ = ("attrs", "children", "enter", "exit", "parent", "tag", "text")

    def __init__(self, tag: str | None, parent: Node | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.parent, self.attrs, self.text = tag, parent, attrs or {}, text
        self.children: list[Node] = []
        self.enter = self.exit = -1
        if parent is not None:
            parent.children.append(self)

    def attr(self, name: str) -> str:
        """The trimmed value; empty where it is missing."""
        return self.attrs.get(name, "").strip(WHITE)

    def walk(self) -> Iterator[tuple[Node, bool]]:
        """Every node on entering (True) and leaving it, without recursion: pages can be nested to any depth."""
        stack = [(self, iter(self.children))]
        yield self, True
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                yield node, False
                stack.pop()
            else:
                yield child, True
                stack.append((child, iter(child.children)))

    def content(self) -> str:
        return "".join(n.text for n, entering in self.walk() if entering and n.tag is None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("#document", None)
        self.open = 0

    def _close(self, node: Node) -> None:
        self.top = node.parent or self.root

    def _nearest(self, tags, stops=()) -> Node | None:
        node = self.top
        while node.parent is not None:
            if node.tag in tags:
                return node
            if node.tag in stops:
                return None
            node = node.parent
        return None

    def handle_starttag(self, tag, attrs):
        tag = "img" if tag == "image" else tag
        if tag == "a" and (last := self._nearest(("a",), ("table", "td", "th", "button", "object"))):
            self._close(last)
        if tag in IMPLIED:
            tags, stops = IMPLIED[tag]
            while last := self._nearest(tags, stops):
                self._close(last)
        elif tag in BLOCKS and (last := self._nearest(("p",), ("button", "td", "th", "table", "object"))):
            self._close(last)
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k.rpartition(":")[2] if k == "xlink:href" else k, v or "")
        node = Node(tag, self.top, found)
        if tag not in VOID:
            self.top = node
        if tag in RAW and tag not in ("script", "style"):
            self.set_cdata_mode(tag, escapable=True) if tag in DECODED else self.set_cdata_mode(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def set_cdata_mode(self, elem, **kw):
        try:
            super().set_cdata_mode(elem, **kw)
        except TypeError:  # older tokenizers know no text that is raw but for references
            super().set_cdata_mode(elem)

    def handle_endtag(self, tag):
        if tag == "p" and not self._nearest(("p",)):
            Node("p", self.top)
        elif (node := self._nearest((tag,))) is not None:
            self._close(node)

    def handle_data(self, data):
        if self.top.children and self.top.children[-1].tag is None:
            self.top.children[-1].text += data
        else:
            Node(None, self.top, text=data)


def parse(html: str | None) -> Node:
    """The document's root."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    count = 0
    for node, entering in builder.root.walk():
        if entering:
            node.enter, count = count, count + 1
        else:
            node.exit = count - 1
    return builder.root


NODE = "array<struct<node_id:int, exit_id:int, parent_id:int, depth:int, tag:string, attrs:map<string,string>, text:string, anchor_id:int, picture_id:int>>"


def _rows(html: str) -> list[dict]:
    out, depth = [], -1
    state: dict[int, tuple[int | None, int | None]] = {}
    for node, entering in parse(html).walk():
        depth += 1 if entering else -1
        if not entering:
            continue
        anchor, picture = state.get(node.parent.enter, (None, None)) if node.parent else (None, None)
        row = {"node_id": node.enter, "exit_id": node.exit, "parent_id": node.parent.enter if node.parent else None, "depth": depth + 1, "tag": node.tag, "attrs": list(node.attrs.items()), "text": node.text if node.tag is None else None, "anchor_id": anchor, "picture_id": picture}
        if node.tag == "a" and node.attr("href"):
            anchor = node.enter
        if node.tag == "picture":
            picture = node.enter
        state[node.enter] = (anchor, picture)
        out.append(row)
    return out


def _column(pages: pa.Array) -> pa.Array:
    i, s = pa.int32(), pa.string()
    kind = pa.list_(pa.struct([("node_id", i), ("exit_id", i), ("parent_id", i), ("depth", i), ("tag", s), ("attrs", pa.map_(s, s)), ("text", s), ("anchor_id", i), ("picture_id", i)]))
    return pa.array([None if h is None else _rows(h) for h in pages.to_pylist()], kind)


def nodes(html: Column | str) -> Column:
    """The page's nodes in document order, with their ranges, parents, and the nearest link and picture around them."""
    return F.arrow_udf(_column, NODE)(html)


def dom_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row per node; the other columns of ``pages`` pass, the markup itself doesn't."""
    others = [c for c in pages.columns if c != html]
    return pages.select(*others, F.explode(nodes(html)).alias("n")).select(*others, "n.*")
