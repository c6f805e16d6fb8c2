"""Main text of pages by a site style tree."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arauto.llm.common import slices, staged

#: A style node below this importance is noise on its site.
THRESHOLD = 0.3
#: Weight of a node's content against its presentation.
GAMMA = 0.9

# Elements and names that are not part of an article.
DROPPED = {"script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "iframe", "object", "svg", "math", "canvas", "button", "select", "textarea", "input", "dialog", "menu", "audio", "video"}
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br", "caption", "option"}
NOISE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "menu", "nav", "navbar", "navigation", "navi", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "topbar", "toolbar",
    "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "commentlist", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "widget", "search", "searchbox",
}
#: Names of what readers add; such parts hold articles of their own.
REPLY_NAMES = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: An open element of these is closed by a start tag of those.
CLOSES = {"p": BLOCKS - {"br", "option", "body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
CUT_OFF = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MASK = (1 << 63) - 1


class Node:
    """An open or closed element: its style path, what kind of place it is, and its range of text pieces."""

    __slots__ = ("tag", "path", "never", "name", "weak", "core", "noise", "article", "main", "begin", "end", "children", "parent")

    def __init__(self, tag, path, never, name, weak, core, begin, parent):
        self.tag, self.path, self.never, self.name, self.weak, self.core, self.begin, self.end, self.children, self.parent = tag, path, never, name, weak, core, begin, begin, [], parent
        self.noise = self.article = self.main = False


def _names(attrs: dict[str, str]) -> set[str]:
    return {x for a in ("class", "id") if a in attrs for x in re.split(r"[^a-z]+", attrs[a].lower()) if x}


def _named(attrs: dict[str, str]) -> str:
    """What class and id say an element is: "reply", "noise", "header" or nothing.

    A name counts whole: every word of it has to be such a name, so ``cookie-notice`` counts and ``no-sidebar`` does not.
    """
    kinds = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words and words <= NOISE_NAMES:
            kinds.add("noise" if words.isdisjoint(REPLY_NAMES) else "reply")
        elif words == {"header"}:
            kinds.add("header")
    return next((k for k in ("reply", "noise", "header") if k in kinds), "")


def settle(nodes: list[Node], spared: frozenset[str] = frozenset()) -> None:
    """Set noise, article and main of all nodes; names of the ``spared`` kinds mark nothing that is or holds an article or main part.

    Within an article a header's name and the site's tree count for nothing.
    """
    holders = set()
    if spared:
        gone = set()
        for n in nodes:
            if n.never or id(n.parent) in gone:
                gone.add(id(n))
            elif n.core:
                while n is not None and id(n) not in holders:
                    holders.add(id(n))
                    n = n.parent
    for n in nodes:
        up = n.parent
        name = "" if n.name in spared and id(n) in holders else n.name
        n.noise = up.noise or n.never or name in ("noise", "reply") or (not up.article and n.tag != "article" and (n.weak or name == "header"))
        n.article = up.article or (n.tag == "article" and not n.noise)
        n.main = up.main or (n.core and n.tag != "article" and not n.noise)


def parse(page: str, noisy_paths: frozenset[int] | None = None) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All elements in page order, and text pieces with the element each stands in (a piece '' is a block's border).

    ``never`` marks elements by tag or role, ``name`` by class or id (never html, body or a main part), ``weak`` those whose
    style path the site's tree found unimportant; settle() makes noise of them and of everything below.
    """
    root = Node("", 1, False, "", False, False, 0, None)
    stack, nodes, pieces = [root], [], []
    open_tags: dict[str, int] = {}
    at, end = 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a:
            pieces.append((stack[-1], page[a:b]))

    def close() -> None:
        node = stack.pop()
        open_tags[node.tag] -= 1
        node.end = len(pieces)
        if node.tag in BLOCKS:
            pieces.append((node, ""))

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            cut = CUT_OFF.search(page, at)  # a tag that the page's end cuts off is no text
            text(at, cut.start() if cut else end)
            break
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags.get(tag):
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag in ("p", "br"):
                pieces.append((stack[-1], ""))
            continue
        while len(stack) > 1 and tag in CLOSES.get(stack[-1].tag, ()):
            close()
        if open_tags.get("p") and tag in CLOSES["p"]:  # a paragraph ends even under open inline elements
            depth = len(stack) - 1
            while depth and stack[depth].tag not in BLOCKS:
                depth -= 1
            if stack[depth].tag == "p":
                while len(stack) > depth:
                    close()
        attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
        names = _names(attrs)
        up = stack[-1]
        signature = f"{tag}.{'.'.join(sorted(names))}"
        path = (up.path * 1000003 + zlib.crc32(signature.encode())) & MASK
        up.children.append(zlib.crc32(signature.encode()))
        role = attrs.get("role", "").lower()
        never = tag in DROPPED or "hidden" in attrs or role in NOISE_ROLES
        main = tag == "main" or role == "main"
        name = "" if main or tag in ("html", "body") else _named(attrs)
        weak = tag == "header" or bool(noisy_paths and path in noisy_paths)
        node = Node(tag, path, never, name, weak, main or tag == "article", len(pieces), up)
        nodes.append(node)
        if tag in BLOCKS:
            pieces.append((node, ""))
        if tag in VOID or m[3].endswith("/") and tag in RAW:
            node.end = len(pieces)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            node.end = len(pieces)
            continue
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    while len(stack) > 1:
        close()
    settle(nodes)
    return nodes, pieces


def main_text(page: str | None, noisy_paths: frozenset[int] | None = None) -> str:
    """The article's text: of all articles if there are any, else of the main part, else of the body, without noise.

    Names may take some articles of a page (replies), not all: where they would leave no article or main part of those
    that are there, they don't count for what is or holds one; names of replies still do unless the page would be empty.
    """
    if not page:
        return ""
    nodes, pieces = parse(page, noisy_paths)
    text = _text(nodes, pieces)
    core = [n for n in nodes if n.core]
    if core and (not text or not any(n.article or n.main for n in core)):
        for spared in ({"noise", "header"}, {"noise", "header", "reply"}):
            settle(nodes, frozenset(spared))
            if found := _text(nodes, pieces):
                return found
    return text


def _text(nodes: list[Node], pieces: list[tuple[Node, str]]) -> str:
    where = "article" if any(n.article for n in nodes) else "main" if any(n.main for n in nodes) else None
    kept = [(html.unescape(t) if "&" in t else t) or " " for n, t in pieces if not n.noise and (where is None or getattr(n, where))]
    return " ".join("".join(kept).split())


def style_rows(page: str) -> list[tuple[int, int, int]]:
    """(style path, presentation, content) of every style node of a page: what its elements' children and texts hash to."""
    nodes, pieces = parse(page)
    prefix = [0]
    for _, t in pieces:
        prefix.append((prefix[-1] * 1000003 + zlib.crc32(" ".join(t.split()).encode())) & MASK if t.strip() else prefix[-1])
    out: dict[int, list[int]] = {}
    for n in nodes:
        seen = out.setdefault(n.path, [0, 0])
        kinds = [c for i, c in enumerate(n.children) if not i or c != n.children[i - 1]]
        own = 0
        for t in pieces[n.begin : n.end] if not n.children else ():
            own = (own * 31 + zlib.crc32(" ".join(t[1].split()).encode())) & MASK
        seen[0] = (seen[0] * 31 + zlib.crc32(repr(kinds).encode())) & MASK if kinds else seen[0]
        seen[1] = (seen[1] * 1000003 + (own or prefix[n.end] ^ prefix[n.begin])) & MASK
    return [(path, a, b) for path, (a, b) in out.items()]


def site_noise(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, paths): style paths of each host whose importance is below the threshold.

    The pages of a host are merged by style path. On a path that m different pages have, a presentation or content that
    n of them share has p = n / m. Presentation importance is its entropy to base m; content importance is one less the
    mean of ln n / ln m, which is 0 for what all pages repeat and 1 for what each has alone. Copies of a page count once.
    """
    schema = "host string, page long, path long, look long, content long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = [(host, mark, *r) for host, mark, page in zip(*(batch.column(c).to_pylist() for c in ("host", "mark", "html")), strict=True) for r in style_rows(page)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.string(), *[pa.int64()] * 4])], names=["host", "page", "path", "look", "content"])

    source = pages.select(host(), F.xxhash64("html").alias("mark"), "html").filter(F.col("host").isNotNull() & F.col("html").isNotNull())
    once = source.mapInArrow(run, schema).distinct()
    seen = once.groupBy("host", "path", "look", "content").agg(F.count(F.lit(1)).alias("n"))
    by_content = seen.groupBy("host", "path", "content").agg(F.sum("n").alias("n"))
    by_look = seen.groupBy("host", "path", "look").agg(F.sum("n").alias("n"))
    x = F.col("n") * F.log(F.col("n").cast("double"))
    content = by_content.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(x).alias("same"))
    look = by_look.groupBy("host", "path").agg(F.sum(x).alias("alike"))
    m, log_m = F.col("m"), F.log(F.col("m").cast("double"))
    importance = GAMMA * (1 - F.col("same") / (m * log_m)) + (1 - GAMMA) * (1 - F.col("alike") / (m * log_m))
    low = content.filter(F.col("m") > 1).join(look, ["host", "path"]).filter(importance < threshold)
    return low.groupBy("host").agg(F.collect_list("path").alias("paths"))


def host():
    return F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host")


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page.

    Elements that are never part of an article go by tag, whole name or role; outside articles, branches go whose style node
    is unimportant on their site. Character references are decoded, white space is squeezed, blocks are joined in page
    order by one blank; inline tags join without. Null and empty html give an empty text; a page whose url has no host
    belongs to no site and loses nothing to one. Copies of rows are extracted alike. Other columns are ignored.
    """
    noise = staged(site_noise(pages, threshold), "site-noise")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host())
    rows = rows.join(noise, "host", "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(page, frozenset(paths) if paths else None) for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
