"""HTML structure of a page, as one Arrow function.

Catalyst has no HTML parser, so this is the only Python on the page path. It hands back plain arrays and strings;
every rule that follows is a column expression. Each caller names the parts it needs and only those are built.
Text is NFKC-normalised here, so later steps need no second Python pass.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from arauto.functions.text import ColumnLike, _col

_LINKS = "array<struct<href:string,text:string,url:string,cls:string>>"
PARTS = {
    "title": "string",
    "h1": "string",
    "entry_title": "string",
    "main_text": "string",
    "content_text": "string",
    "content_hrefs": "array<string>",
    "articles": "array<struct<title:string,href:string,excerpt:string>>",
    "links": _LINKS,
    "alternates": "array<struct<type:string,url:string>>",
    "rows": "array<array<string>>",
}

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))
_BLOCK = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
#: Elements at whose borders texts are kept apart; other tags join the texts around them.
_BREAK = _BLOCK | frozenset("body br caption center dd details dir dt figcaption figure head html li option summary tbody td tfoot th thead title tr".split())
# an opening tag on the left closes an open element on the right, up to the fence
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}


class _Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.items = tag, attrs, []

    def walk(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(i for i in reversed(node.items) if isinstance(i, _Node))

    def all(self, tag: str = "", cls: str = "") -> Iterator[_Node]:
        for node in self.walk():
            if node is not self and (not tag or node.tag == tag) and (not cls or cls in node.attrs.get("class", "").split()):
                yield node

    def first(self, tag: str = "", cls: str = "") -> _Node | None:
        return next(self.all(tag, cls), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in _SILENT:
                if node.tag in _BREAK:
                    out.append(" ")
                    stack.append(" ")
                stack.extend(reversed(node.items))
        return unicodedata.normalize("NFKC", " ".join("".join(out).split()))


class _Tree(HTMLParser):
    """Tolerant tree builder: implied end tags, stray end tags ignored, everything open closes at the end."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self._open = [self.root]
        self._depths: dict[str, list[int]] = {}  # where each open tag stands, so that closing needs no search
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._close_to({"p"}, {"table", "td", "div", "article", "section", "main", "body"})
        if tag in _IMPLIED:
            self._close_to(*_IMPLIED[tag])
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self._open[-1].items.append(node)
        if tag not in _VOID:
            self._depths.setdefault(tag, []).append(len(self._open))
            self._open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self._open[-1].tag == tag:
            self._close_from(len(self._open) - 1)

    def handle_endtag(self, tag):
        if self._depths.get(tag):
            self._close_from(self._depths[tag][-1])

    def handle_data(self, data):
        self._open[-1].items.append(data)

    def _close_to(self, tags: set[str], fence: set[str]):
        fenced = max((at[-1] for t in fence if (at := self._depths.get(t))), default=0)
        inside = [at[i] for t in tags if (at := self._depths.get(t)) and (i := bisect_right(at, fenced)) < len(at)]
        if inside:
            self._close_from(min(inside))

    def _close_from(self, depth: int):
        while len(self._open) > depth:
            self._depths[self._open.pop().tag].pop()


def _text(node: _Node | None) -> str | None:
    return node.text() if node is not None else None


def _link_within(node: _Node, tag: str = "", cls: str = "") -> _Node | None:
    return next((a for scope in node.all(tag, cls) if (a := scope.first("a"))), None)


def _article(node: _Node) -> dict | None:
    link = _link_within(node, cls="entry-title") or _link_within(node, "h2") or _link_within(node, "h1")
    if link is None:
        return None
    excerpt = node.first(cls="entry-summary") or node.first(cls="excerpt") or node.first("p")
    return {"title": link.text(), "href": link.attrs.get("href", ""), "excerpt": _text(excerpt) or ""}


def _url(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def _part(name: str, root: _Node, base: str):
    match name:
        case "title" | "h1":
            return _text(root.first(name))
        case "entry_title":
            return _text(root.first(cls="entry-title"))
        case "main_text":
            return _text(root.first("main") or root.first("article") or root.first("body") or root)
        case "content_text" | "content_hrefs":
            node = root.first(cls="entry-content") or root.first("article") or root.first("main")
            if name == "content_text":
                return _text(node)
            return [a.attrs["href"] for a in node.all("a") if a.attrs.get("href")] if node else []
        case "articles":
            nodes = list(root.all("article")) or list(root.all(cls="post")) or list(root.all(cls="entry"))
            return [a for n in nodes if (a := _article(n))]
        case "links":
            return [
                {"href": a.attrs["href"], "text": a.text(), "url": _url(base, a.attrs["href"]), "cls": a.attrs.get("class", "")}
                for a in root.all("a") if a.attrs.get("href")
            ]
        case "alternates":
            return [
                {"type": n.attrs.get("type", "").lower(), "url": _url(base, n.attrs["href"])}
                for n in root.all("link") if n.attrs.get("rel", "").lower() == "alternate" and n.attrs.get("href")
            ]
        case "rows":
            listed = (t for t in root.all("table") if t.attrs.get("id") == "listagem")
            found = [r for t in listed for r in t.all("tr")] or [r for b in root.all("tbody") for r in b.all("tr")]
            return [[c.text() for c in r.all("td")] for r in found]


def dom_struct(html: ColumnLike, base_url: ColumnLike, *parts: str) -> Column:
    """The named ``PARTS`` of each page as one struct column; null HTML gives a null struct."""
    schema = ", ".join(f"{p} {PARTS[p]}" for p in parts)

    @F.pandas_udf(schema)
    def parse(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        rows = []
        for page, base in zip(pages, bases):
            root = _Tree(page or "").root
            rows.append([_part(p, root, base or "") for p in parts])
        return pd.DataFrame(rows, columns=list(parts), dtype=object)

    # else a filter on what follows from the parse is pushed below it, and pages are parsed twice
    return parse.asNondeterministic()(_col(html), _col(base_url))
