"""Main text of web pages by tree scoring.

A page is parsed to a tree with the end tags that HTML lets authors leave out. Scripts, styles, forms, menus,
headers, footers, asides, and elements whose role, class or id names such a part (sidebar, notice, advert, reader
comments) are taken out. Each paragraph passes points for its length and its commas to its ancestors, halved at each
step up; an element's points are discounted by its share of link text. The best container is kept, widened to an
enclosing article or main element, with those siblings that score well or hold prose. Its text is given in blocks.

White space inside a block becomes one space, blocks are trimmed, empty ones left out, and joined by two line
feeds; a line break is white space, a table row is one block. Null and empty pages, and pages of markup only, have an
empty text. Unclosed tags, comments and quotes end with the page. Repeated rows and null ids are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?", re.S)
_WORD = re.compile("[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody tfoot thead tr ul".split()
)
CELL = frozenset(("td", "th"))
#: A start tag that ends an open element of the second set, as far as the third.
_SCOPE = frozenset("html body table td th caption button object template article section div aside main header footer nav form".split())
_ENDS = {
    "li": (frozenset(("li",)), frozenset("ul ol menu".split()) | _SCOPE),
    "dd": (frozenset(("dd", "dt")), frozenset(("dl",)) | _SCOPE),
    "dt": (frozenset(("dd", "dt")), frozenset(("dl",)) | _SCOPE),
    "tr": (frozenset(("tr",)), frozenset(("table", "html"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table", "html"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table", "html"))),
    "tbody": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table", "html"))),
    "tfoot": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table", "html"))),
    "option": (frozenset(("option",)), frozenset(("select", "html"))),
}
_PARAGRAPH = (frozenset(("p",)), frozenset("html table td th caption button object template".split()))
_ENDS_PARAGRAPH = BLOCK - frozenset("body html option optgroup caption tbody tfoot thead tr".split())

DROPPED = frozenset(
    "script style noscript template textarea title iframe noembed noframes xmp nav header footer aside form fieldset button select option input label svg math canvas "
    "object embed applet audio video map menu dialog head search datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Words of a class or id that name a part beside the article.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense banner sponsor sponsored promo promos promotion cookie cookies consent gdpr "
    "notice notices alert alerts modal popup overlay newsletter subscribe subscription signup paywall menu menus nav navbar navigation breadcrumb breadcrumbs "
    "sidebar sidebars widget widgets related recommended recommendations share sharing social comment comments disqus respond reply replies "
    "footer header masthead login search toolbar pager pagination skip topbar bottombar toc tags outbrain taboola".split()
)
#: Beginnings of such words that are written together with others (commentlist, sidebarleft).
ASIDE_BEGINNINGS = tuple("comment sidebar advert newsletter breadcrumb cookie sponsor disqus subscri navbar navigation footer".split())
_NEVER = frozenset("html body article main".split())
POSITIVE = frozenset("article body content entry main page post text blog story hentry".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "score", "chars", "linked")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.score, self.chars, self.linked = 0.0, 0, 0

    def names(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attrs)} if self.attrs.strip(" /\n\t") else {}


class Open:
    """The open elements from the root down, and the depths at which each tag is open.

    A search for an open element asks for depths instead of walking up, so that a tag costs the same at any depth."""

    def __init__(self, root: Node):
        self.path, self.depths = [root], {}
        self.blocks, self.cells = [0], [0]

    def push(self, node: Node) -> None:
        depth = len(self.path)
        self.path.append(node)
        self.depths.setdefault(node.tag, []).append(depth)
        if node.tag in BLOCK:
            self.blocks.append(depth)
        elif node.tag in CELL:
            self.cells.append(depth)

    def cut(self, depth: int) -> None:
        """Close all elements from this depth on; the root stays open."""
        while len(self.path) > max(depth, 1):
            tag = self.path.pop().tag
            self.depths[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            elif tag in CELL:
                self.cells.pop()

    def deepest(self, tags: frozenset) -> int:
        return max((found[-1] for tag in tags if (found := self.depths.get(tag))), default=0)

    def end(self, tags: frozenset, scope: frozenset) -> None:
        """Close the nearest open element of `tags`, unless one of `scope` is nearer."""
        depth = self.deepest(tags)
        if depth and depth >= self.deepest(scope):
            self.cut(depth)

    def close(self, tag: str) -> None:
        """An end tag; a stray one of an inline element ends no block and no cell, one of a cell no block."""
        found = self.depths.get(tag)
        if found:
            nearest = 0 if tag in BLOCK else self.blocks[-1] if tag in CELL else max(self.blocks[-1], self.cells[-1])
            if found[-1] > nearest:
                self.cut(found[-1])


def parse(page: str) -> Node:
    root = Node("html", "", None)
    opened = Open(root)
    at, size = 0, len(page)
    while at < size:
        node = opened.path[-1]
        found = _TAG.search(page, at)
        if found is None:
            node.children.append(page[at:])
            break
        if found.start() > at:
            node.children.append(page[at : found.start()])
        at = found.end()
        if name := found[1]:
            tag = name.lower()
            if tag in ("html", "body", "head"):
                if tag == "body":
                    opened.cut(1)
                if tag != "head":
                    continue
            if tag == "body" or node.tag == "head" and tag not in RAW and tag not in VOID and tag != "template":
                opened.cut(1)
            if tag in _ENDS_PARAGRAPH:
                opened.end(*_PARAGRAPH)
            if tag in _ENDS:
                opened.end(*_ENDS[tag])
            node = opened.path[-1]
            made = Node(tag, found[2] or "", node)
            node.children.append(made)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else size
            elif tag == "plaintext":
                made.children.append(page[at:])
                at = size
            elif tag not in VOID and not (found[2] or "").rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
                opened.push(made)
        elif name := found[3]:
            tag = name.lower()
            if tag not in ("html", "body"):
                opened.close(tag)
    return root


def is_aside(node: Node) -> bool:
    """Whether the element is a part beside the article."""
    if node.tag in DROPPED:
        return True
    names = node.names()
    if not names or node.tag in ("html", "body"):
        return False
    if "hidden" in names or names.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", names.get("style", "")):
        return True
    if names.get("role", "").lower() in ROLES:
        return True
    words = set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{names.get('class', '')} {names.get('id', '')}").lower()))
    if node.tag in _NEVER:  # an article inside the article may be a comment or a teaser, a page's main part isn't
        return bool(words & {"comment", "comments", "reply", "related", "sponsored", "advert", "ad"})
    return bool(words & ASIDE) or any(word.startswith(ASIDE_BEGINNINGS) for word in words)


def prune(root: Node) -> None:
    waiting = [root]
    while waiting:
        node = waiting.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not is_aside(c)]
        waiting += [c for c in node.children if not isinstance(c, str)]


def measure(root: Node) -> list[Node]:
    """All elements, parents first, with their text and link lengths, and with the points of the paragraphs below."""
    order = [root]
    for node in order:
        order += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        own = [html.unescape(c).strip() for c in node.children if isinstance(c, str)]
        node.chars += sum(map(len, own))
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for node in order:
        prose = node.tag in ("p", "pre", "blockquote", "td", "li", "dd")
        if not prose and node.tag in BLOCK:
            prose = any(isinstance(c, str) and c.strip() for c in node.children) and not re.fullmatch("h[1-6]", node.tag)
        if prose and node.chars:
            points = 1 + _commas(node) + min(node.chars / 100, 3)
            up, part = node.parent, 1.0
            if node.tag not in ("p", "li", "td", "dd") or up is None:
                node.score += points
            while up is not None and part > 0.1:
                up.score += points * part
                up, part = up.parent, part / 2
    for node in order:
        words = set(_WORD.findall(f"{node.names().get('class', '')} {node.names().get('id', '')}".lower()))
        node.score += 25 * bool(words & POSITIVE) * (node.tag not in ("html", "body") and node.chars > 0)
        node.score *= 1 - node.linked / max(node.chars, 1)
    return order


def _commas(node: Node) -> int:
    """Commas of a block's own text, inline elements included."""
    n, waiting = 0, [node]
    while waiting:
        for child in waiting.pop().children:
            if isinstance(child, str):
                n += child.count(",")
            elif child.tag not in BLOCK:
                waiting.append(child)
    return n


def choose(root: Node) -> list[Node]:
    """The best container with the siblings worth keeping, in page order."""
    order = measure(root)
    best = max(order, key=lambda n: n.score)  # the outermost of equals
    for wanted in ("article", "main"):
        around = [n for n in _up(best) if n.tag == wanted or wanted == "main" and n.names().get("role") == "main"]
        if around:
            best = around[-1]
            break
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * best.score)
    keep = []
    for sibling in best.parent.children:
        if isinstance(sibling, str):
            continue
        density = sibling.linked / max(sibling.chars, 1)
        prose = sibling.tag == "p" and (sibling.chars > 80 and density < 0.25 or 0 < sibling.chars <= 80 and density == 0 and any("." in text for text in blocks([sibling])))
        if sibling is best or best.tag not in ("article", "main") and (sibling.score >= least or prose) or best.tag == "article" and sibling.tag == "article" and sibling.score >= least:
            keep.append(sibling)
        elif best.tag not in ("article", "main") and re.fullmatch("h[1-6]", sibling.tag) and density < 0.5:
            keep.append(sibling)
    return keep


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(piece).split()):
            out.append(text)
        piece.clear()

    for top in nodes:
        waiting: list[Node | str | None] = [top]
        while waiting:
            item = waiting.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                piece.append(html.unescape(item))
            else:
                if item.tag in BLOCK:
                    flush()
                    waiting.append(None)
                elif item.tag == "br" or item.tag in CELL:
                    piece.append(" ")
                waiting += reversed(item.children)
        flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page.replace("\0", "�"))
    prune(root)
    return "\n\n".join(blocks(choose(root)))


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; narrow."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [main_text(page) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_column, "url", "text", "n_chars"])

    return pages.select(id_column, "url", html_column).mapInArrow(run, f"`{id_column}` {kinds[id_column]}, url {kinds['url']}, text string, n_chars bigint")
