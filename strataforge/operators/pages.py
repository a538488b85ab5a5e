"""A reader of pages: a stack of open tags, the main node, and a line for each block with all its inline text.

Tags are read leniently, as browsers do: a paragraph ends where a block starts, a list item where the next one does, an end
tag closes what is open inside it, or nothing. Nodes of :data:`DROPPED` tags and of class words in :data:`HINTS` count nowhere. The
main node is the first of :data:`MAIN`, in that order, that has LEAST_TEXT characters of text, else the whole page. A block that stands in a list item
belongs to its line, but a list inside an item has lines of its own. Null pages have no lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where content is looked for, what is never content, and the size that stands for a heading.
MAIN = ("#topic-summary", "main", "article", "#maincontent", "#main-content", ".main-content", "body")
LEAST_TEXT = 200
DROPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "button", "iframe", "head", "template"}
HINTS = ("cookie", "breadcrumb", "share", "feedback", "related", "sidebar", "social", "subscribe", "survey", "menu", "skip", "banner")
SIZES = {"h1": 20, "h2": 15, "h3": 13, "h4": 12, "p": 10, "li": 10}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SCOPES = {"ul", "ol", "table", "td", "th", "body", "html", "article", "main", "section", "div"}


@dataclass
class Node:
    tag: str
    up: Node | None
    dropped: bool
    names: set[str]  # selectors that fit it
    length: int = 0  # of its text, without white space at the ends of pieces
    lines: list[int] = field(default_factory=list)


class Reader(HTMLParser):
    """Lines (tag, text) with the nodes they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.now = self.root = Node("", None, False, set())
        self.nodes: list[Node] = []
        self.lines: list[tuple[str, list[str], Node]] = []  # tag, pieces, node
        self.blocks: list[tuple[Node, int]] = []  # open blocks and their lines

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_data(" ")
            return
        if tag in _ENDS_P:
            self._close_within("p", {"li", *_SCOPES})
        if tag == "li":
            self._close_within("li", {"ul", "ol", "body", "html"})
        given = {k: v or "" for k, v in attributes}
        classes = given.get("class", "").lower()
        dropped = self.now.dropped or tag in DROPPED or any(h in classes.replace("shared", " ") for h in HINTS)
        names = {tag, *(f".{c}" for c in classes.split())} | ({f"#{given['id']}"} if "id" in given else set())
        self.now = Node(tag, self.now, dropped, names)
        self.nodes.append(self.now)
        inside = self.blocks[-1][0] if self.blocks else None
        if tag in SIZES and not dropped and (tag == "li" or inside is None or inside.tag != "li"):
            self.lines.append((tag, [], self.now))
            self.blocks.append((self.now, len(self.lines) - 1))

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)  # a slash closes nothing

    def _close_within(self, tag: str, scope: set[str]) -> None:
        node = self.now
        while node.up is not None and node.tag != tag and node.tag not in scope:
            node = node.up
        if node.tag == tag:
            self._leave(node)

    def _leave(self, node: Node) -> None:
        while self.now is not node:
            self._pop()
        self._pop()

    def _pop(self) -> None:
        if self.blocks and self.blocks[-1][0] is self.now:
            self.blocks.pop()
        self.now = self.now.up

    def handle_endtag(self, tag: str) -> None:
        node = self.now
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self._leave(node)

    def handle_data(self, data: str) -> None:
        if self.now.dropped:
            return
        if self.blocks:
            self.lines[self.blocks[-1][1]][1].append(data)
        size, node = len(data.strip()), self.now
        while size and node is not None:
            node.length += size
            node = node.up

    def main(self) -> Node:
        for name in MAIN:
            node = next((n for n in self.nodes if name in n.names and not n.dropped), None)
            if node is not None and node.length >= LEAST_TEXT:
                return node
        return self.root


def lines_of(html: str | None) -> list[tuple[str, str]]:
    """(tag, text) of each block of the main node that has text."""
    if not html:
        return []
    reader = Reader()
    reader.feed(html)
    reader.close()
    main = reader.main()

    def within(node: Node | None) -> bool:
        while node is not None and node is not main:
            node = node.up
        return node is main

    found = ((tag, " ".join("".join(pieces).split()), node) for tag, pieces, node in reader.lines)
    return [(tag, text) for tag, text, node in found if text and within(node)]


def page_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos (from 0), tag, line, size of each block of each page's main node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("tag", pa.string()), ("line", pa.string())]))
        for batch in batches:
            found = [[{"tag": t, "line": x} for t, x in lines_of(h)] for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, kind)], ["key", "lines"])

    named = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    read = named.mapInArrow(run, f"key {named.schema['key'].dataType.simpleString()}, lines array<struct<tag: string, line: string>>")
    sizes = F.create_map(*[F.lit(x) for tag, size in SIZES.items() for x in (tag, size)])
    each = read.select(F.col("key").alias(key), F.posexplode("lines").alias("pos", "l"))
    return each.select(key, F.col("pos").cast("long").alias("pos"), "l.tag", "l.line", F.element_at(sizes, F.col("l.tag")).cast("long").alias("size"))
