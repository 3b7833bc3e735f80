"""Main text of HTML pages by composite text density.

A page is parsed into a tree (void elements, raw text and implied ends of paragraphs, list items,
table parts and options as in HTML). Elements that HTML itself defines as no article go first:
navigation, footers, page headers (of a header inside an article the headings stay), asides,
forms, scripts, styles, what is hidden or has such a role.

Each node then has C characters, T tags, LC link characters and LT link tags below it and the
composite density

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LCb / Cb * C + e))

with b for the body: characters per tag, adjusted for links. The node with the largest sum of its
children's densities leads to the main subtree: the deepest one below it with ``NEARLY`` that sum.
The smallest density on its path is the threshold that other subtrees must reach to count as well.
``article`` and ``main`` bound the search where a page has them: the largest sum is looked for
inside, the main subtree is the whole article around it, and what may join it are other articles,
or subtrees and headings of the same ``main``.

Class and id names only help: a subtree named as an advert, notice, sidebar and the like goes if it
holds less than half of the page's text and no article, one named as reader comments goes if any
other text is left.

Text of a block: character references decoded, white space to one space, trimmed; blocks in page
order joined by two line feeds. Inline elements don't part blocks; ``br`` is white space.

Defined cases: null or empty html gives the empty text; html is read whole, in time proportional
to its length however deep it nests; repeated rows keep their rows; broken markup never fails (an
unclosed tag is text); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
P_SCOPE = frozenset("table caption td th button object template html".split())
#: What an opening element ends: the open elements named first, as far up as the ones named second.
ENDS = {tag: (frozenset(("p",)), P_SCOPE) for tag in CLOSES_P} | {
    "li": (frozenset(("li", "p")), P_SCOPE | {"ul", "ol", "menu"}),
    "dt": (frozenset(("dt", "dd", "p")), P_SCOPE | {"dl"}),
    "dd": (frozenset(("dt", "dd", "p")), P_SCOPE | {"dl"}),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "thead": (frozenset(("tr", "td", "th", "thead", "tbody", "tfoot")), frozenset(("table",))),
    "tbody": (frozenset(("tr", "td", "th", "thead", "tbody", "tfoot")), frozenset(("table",))),
    "tfoot": (frozenset(("tr", "td", "th", "thead", "tbody", "tfoot")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
#: Elements that are never article text.
DROPPED = frozenset("script style noscript iframe textarea title head nav footer aside form button select option svg canvas object template dialog input audio video map menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names of what is no article, and words before them that say it isn't there.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup sidebar widget widgets related recommended recommendations share sharing social nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager "
    "masthead footer login search toolbar skip".split()
)
COMMENT_NAMES = frozenset("comment comments disqus respond reply replies".split())
NEGATIONS = frozenset("no not non has have with without is hide allow".split())
NEVER_NAMED = frozenset(("html", "body", "main"))
MARKS = frozenset(("article", "main"))
#: A node with this share of the largest sum is preferred to the ones above it.
NEARLY = 0.9
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))

TOKEN = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|\Z)", re.IGNORECASE)
NAME_PART = re.compile(r"[a-z0-9]+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "named", "chars", "tags", "link_chars", "link_tags", "density", "total", "marks")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, named: str | None = None):
        self.tag, self.parent, self.noise, self.named = tag, parent, noise, named
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and not c.noise]


def named_as(tag: str, value: str) -> str | None:
    """comments, other or None: what a class or id calls its element."""
    for token in value.split():
        parts = NAME_PART.findall(token)
        if tag == "article":
            if token in COMMENT_NAMES:
                return "comments"
        elif not NEGATIONS.isdisjoint(parts):
            continue
        elif not COMMENT_NAMES.isdisjoint(parts):
            return "comments"
        elif not NAMES.isdisjoint(parts):
            return "other"
    return None


def judged(tag: str, attributes: str) -> tuple[bool, str | None]:
    """(no article by HTML's own terms, what its names call it)"""
    if tag in DROPPED:
        return True, None
    named = None
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if tag not in NEVER_NAMED:
                named = named or named_as(tag, value)
        elif name == "role":
            if value in ROLES:
                return True, None
        elif name == "style":
            if INVISIBLE.search(value):
                return True, None
        elif name == "hidden" or value == "true":
            return True, None
    return False, named


class Open:
    """The open elements, and where those of each tag are among them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """This one and all inside it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def end(self, tag: str) -> None:
        if self.places.get(tag):
            self.close(self.places[tag][-1])

    def imply(self, tag: str) -> None:
        ended, scope = ENDS[tag]
        limit = max((at[-1] for t in scope if (at := self.places.get(t))), default=0)
        inside = [at[i] for t in ended if (at := self.places.get(t)) and (i := bisect_right(at, limit)) < len(at)]
        if inside:
            self.close(min(inside))


def parse(page: str) -> Node:
    root = Node("html", None)
    opened, end, search = Open(root), 0, TOKEN.search
    last = page.rfind(">") + 1  # no tag ends after it, so none is looked for
    while m := search(page, end, last):
        at = opened.nodes[-1]
        if m.start() > end:
            at.children.append(page[end : m.start()])
        end = m.end() if m[1] is None or m[0].endswith("-->") else len(page)
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "html":
            continue
        if m[2] or m[5]:  # an end tag closes the nearest open element of its name
            opened.end(tag)
            continue
        if tag in ENDS:
            opened.imply(tag)
        at = opened.nodes[-1]
        node = Node(tag, at, *judged(tag, m[4] or m[7] or ""))
        at.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}\\s*>", re.IGNORECASE).search(page, end)
            end = stop.end() if stop else len(page)
            continue
        opened.push(node)
    if end < len(page):  # an open comment goes on to the end
        opened.nodes[-1].children.append(page[end:].partition("<!--")[0])
    return root


def _mark_headers(root: Node) -> None:
    """A page header is noise; of a header inside the article the headings stay."""
    stack = [(root, False, False)]
    while stack:
        n, marked, header = stack.pop()
        if header:  # only headings, wherever they are in it
            n.children = [c for c in n.children if isinstance(c, Node)]
        for c in n.children:
            if not isinstance(c, Node) or c.noise or (header and c.tag in HEADINGS):
                continue
            if c.tag == "header" and not marked:
                c.noise = True
            else:
                stack.append((c, marked or c.tag in MARKS, header or c.tag == "header"))


def measure(root: Node) -> list[Node]:
    """Counts of every node that is no noise, parents first."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(reversed(n.elements()))
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.marks = n.tag in MARKS and n.named is None
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(" ".join(html.unescape(c).split())) if "&" in c or "  " in c or "\n" in c else len(c)
            elif not c.noise:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
                n.marks = n.marks or c.marks
        if n.tag == "a":
            n.link_chars = n.chars
    return order


def _drop_named(order: list[Node], body: Node) -> None:
    """Names decide about what is too small to be the article, and about readers' comments."""
    left = body.chars
    for n in order:
        if n.named and not (n.parent and n.parent.noise):
            if (n.named == "comments" and n.chars < left) or (n.named == "other" and not n.marks and 2 * n.chars < body.chars):
                n.noise = True
                left -= n.chars
        elif n.parent and n.parent.noise:
            n.noise = True  # inside what has gone


def composite_density(n: Node, body: Node) -> float:
    if not n.chars:
        return 0.0
    tags, links, link_tags = max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
    base = math.log(math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + body.link_chars / max(1, body.chars) * n.chars + math.e))
    x = math.log(max(1.0, n.chars / links * tags / link_tags))
    return n.chars / tags * x / max(base, 1e-3)


def weigh(order: list[Node], body: Node) -> None:
    """Density of each node, and the sum of its children's."""
    for n in order:
        n.density = composite_density(n, body)
    for n in order:
        n.total = sum(c.density for c in n.elements())


def _outermost(order: list[Node], test) -> list[Node]:
    """Nodes for which the test holds and that lie in no such node; ``order`` has parents first."""
    inside, out = set(), []
    for n in order:
        if n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
        elif test(n):
            inside.add(id(n))
            out.append(n)
    return out


def main_nodes(root: Node) -> list[Node]:
    """The roots of the main text, in page order."""
    _mark_headers(root)
    order = measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    _drop_named(order, body)
    order = measure(root)
    weigh(order, body)
    articles = _outermost(order, lambda n: n.tag == "article" and n.chars)
    bounds = _outermost(order, lambda n: n.tag in MARKS and n.chars) or [body]
    search = [n for top in bounds for n in _subtree(top)]
    best = max(search, key=lambda n: n.total)
    if best.total == 0:  # text without elements
        return bounds
    least = NEARLY * best.total
    while (below := max(best.elements(), key=lambda n: n.total, default=best)).total >= least and below is not best:
        best = below
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    own = next((n for n in reversed(path) if n.tag == "article"), None)
    base = own or best
    path = path[path.index(base) :]
    main = next((n for n in reversed(path) if n.tag == "main"), None)
    bound = main or (body if body in path else root)
    path = path[: path.index(bound) + 1]
    threshold = min(n.density for n in path)
    if own and not main:
        return [n for n in articles if n is base or n.density >= threshold]
    found, stack, on_path, before = [], [bound], {id(n) for n in path}, True
    while stack:
        n = stack.pop()
        if n is base:
            found.append(n)
            before = False
        elif id(n) in on_path:
            stack.extend(reversed(n.elements()))
        elif n.density >= threshold or (before and n.tag in HEADINGS):
            found.append(n)
    return found


def _subtree(top: Node) -> list[Node]:
    out, stack = [], [top]
    while stack:
        out.append(n := stack.pop())
        stack.extend(reversed(n.elements()))
    return out


def blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(text)
            parts.clear()

    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            n = stack.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                parts.append(n)
            elif n.noise and n is not top:
                continue
            elif n.tag == "br":
                parts.append(" ")
            elif n.tag in INLINE:
                stack.extend(reversed(n.children))
            else:
                flush()
                stack.append(None)
                stack.extend(reversed(n.children))
        flush()
    return out


def main_text(page: str | None) -> str:
    """Main text of a page; empty if there is none."""
    return "\n\n".join(blocks(main_nodes(parse(page)))) if page else ""


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with ``out_col``: the main text."""
    common.bound_batches(pages.sparkSession)
    cols = [c for c in pages.columns if c not in (out_col, html_col)]
    rows = pages.select(*cols, F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts = pa.array([main_text(p) for p in b.column(len(cols)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], texts], names=[*cols, out_col])

    return rows.mapInArrow(run, pages.select(*cols).schema.add(out_col, "string"))


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``: a row for each row of ``pages``."""
    rows = extract(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
