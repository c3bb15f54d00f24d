"""Main text of web pages by composite text density (operator 4).

A page is read into a tree of block elements, from which parts that name
themselves as furniture (menus, adverts, comments, forms ...) are taken.  For
every element the composite density relates its characters to its tags,
lowered by the share of both that belong to links.  The element whose children
have the largest sum of densities holds the article; the smallest density on
the path from it to the body is the threshold for what else along that path is
kept.  Where that element lies in an ``article`` or ``main`` element, the choice is
widened to the whole of the outermost one; where it does not, the densest such
element is taken, if it has at least a quarter of the page's characters.  Either
way its siblings of that kind which reach the threshold and are not mostly links
are parts of the article too.

Inline markup counts as characters and tags of the block around it; it never
is a block or a candidate itself.  Inline elements that are hidden or name
themselves as furniture go, without ending the block; so do scripts, drawings and
buttons.  Null and empty pages give an empty text;
malformed markup is read as far as it goes, unclosed elements end with their
parent.  Of equal sums the first element in page order wins.  Repeated rows give
repeated results.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlog.llm.textkit import prepare

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "html body head address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section select summary table tbody td template tfoot th "
    "thead tr ul noscript script style title svg button object canvas audio video textarea xmp iframe noembed noframes".split()
)
CLOSED_BY = {  # what ends when another of these begins inside the same parent
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPE = frozenset("html body table ul ol dl menu select article section div main aside nav header footer form td th blockquote".split())
INLINE_FURNITURE = frozenset("svg button noscript canvas object audio video".split())  # inside a paragraph they do not end it
PHRASING_END = frozenset("p h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(("article", "main"))

# Names by which pages mark what is not article text.
FURNITURE = frozenset(
    "head nav footer aside form script style noscript template iframe svg button select textarea title object canvas audio video dialog menu xmp noembed noframes".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promoted promotion banner sidebar side aside nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot comment comments commentlist disqus replies respond reply cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations pagination pager widget toolbar tags legal copyright skip search form forum outbrain taboola".split()
)
#: Names with these inside are phrases ("form-of-government"), no marks.
PHRASE_WORDS = frozenset("of the and for in to on by".split())
#: "has-sidebar" and the like mark what stands beside furniture.
NEIGHBOUR_WORDS = frozenset("has with no without".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>", re.S)
_MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "parts", "furniture", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, furniture: bool):
        self.tag, self.parent, self.furniture = tag, parent, furniture
        self.parts: list[Node | str] = []  # text and blocks in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    for name, *values in _MARKS.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if tag in ("html", "body") or tag in ARTICLE:
            continue
        if name == "role" and value.lower() in FURNITURE_ROLES:
            return True
        if name in ("class", "id"):
            for mark in value.split():
                words = [w.lower() for w in _NAMES.findall(mark)]
                if words and words[0] not in NEIGHBOUR_WORDS and PHRASE_WORDS.isdisjoint(words) and not FURNITURE_WORDS.isdisjoint(words):
                    return True
    return False


def parse(page: str) -> Node:
    """The tree of blocks of a page, with characters and tags of the text that
    is a block's own counted there."""
    root = node = Node("#root", None, False)
    links = at = end = articles = 0
    size = len(page)

    def text(raw: str) -> None:
        if raw and not node.furniture:
            raw = html.unescape(raw) if "&" in raw else raw
            node.parts.append(raw)
            n = len(raw.strip()) if raw.isspace() or raw[0].isspace() or raw[-1].isspace() else len(raw)
            node.chars += n
            if links:
                node.link_chars += n

    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        tag = found[3]
        if tag is None:
            if found[1]:
                text(html.escape(found[1]))
            continue
        tag = tag.lower()
        if found[2]:  # end tag
            if tag == "a":
                links = max(0, links - 1)
            if tag not in BLOCKS:
                if node.furniture and node.tag == tag:  # inline furniture
                    node = node.parent
                continue
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                while node is not up:
                    articles -= node.tag in ARTICLE
                    node = node.parent
                articles -= node.tag in ARTICLE
                node = up.parent
                links = 0
            continue
        if tag not in BLOCKS:
            if tag not in VOID and not found[4].endswith("/") and (node.furniture and node.tag == tag or found[4] and _is_furniture(tag, found[4], True)):
                node.parts.append(child := Node(tag, node, True))
                node = child
                continue
            node.tags += 1
            if tag == "a":
                links += not found[4].endswith("/")
                node.link_tags += 1
            elif tag == "br":
                node.parts.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in INLINE_FURNITURE:
            if not found[4].endswith("/"):
                node.parts.append(child := Node(tag, node, True))
                node = child
            continue
        if node.tag in PHRASING_END:
            node = node.parent
        elif closing := CLOSED_BY.get(tag):
            up = node
            while up is not root and up.tag not in closing and up.tag not in SCOPE:
                up = up.parent
            if up.tag in closing:
                node = up.parent
                if tag == "tr" and node.tag == "tr":
                    node = node.parent
        child = Node(tag, node, node.furniture or _is_furniture(tag, found[4], articles > 0))
        node.parts.append(child)
        if tag not in VOID:
            node = child
            articles += tag in ARTICLE
            links = 0
    return root


def measure(root: Node) -> list[Node]:
    """Sum up and return, in page order, the blocks that are no furniture."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.furniture)
    for node in reversed(order):
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    whole = root.chars or 1
    for node in reversed(order):
        if node.chars:
            chars, links = node.chars, node.link_chars
            base = math.log(chars / max(1, chars - links) * links + root.link_chars / whole * chars + math.e)
            ratio = chars / max(1, links) * max(1, node.tags) / max(1, node.link_tags)
            node.density = chars / max(1, node.tags) * max(0.0, math.log(max(ratio, 1.0)) / math.log(base) if base > 1 else 1.0)
        if node.parent is not None:
            node.parent.total += node.density
    return order


def _blocks(node: Node, skip: frozenset[int], out: list[str]) -> None:
    """Texts of the blocks of a subtree in page order."""
    stack: list[Iterator] = [iter(node.parts)]
    run: list[str] = []
    while stack:
        part = next(stack[-1], None)
        if isinstance(part, str):
            run.append(part)
            continue
        if part is not None and (part.furniture or id(part) in skip):
            continue
        if run and (text := " ".join("".join(run).split())):
            out.append(text)
        run = []
        if part is None:
            stack.pop()
        else:
            stack.append(iter(part.parts))


def _above(node: Node, tags: frozenset[str]) -> Iterator[Node]:
    while (node := node.parent) is not None:
        if node.tag in tags:
            yield node


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line ends."""
    if not page:
        return ""
    root = parse(page)
    order = measure(root)
    best = max(order, key=lambda node: node.total)  # the first of equals
    if not best.total:
        best = root
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    out: list[str] = []
    body = next((i for i, node in enumerate(path) if node.tag == "body"), len(path) - 1)
    threshold = min(node.density for node in path[: body + 1])
    whole = next((node for node in reversed(path) if node.tag in ARTICLE), None)
    if whole is None:
        # long text beside an article element outweighs it only if it is most of the page
        named = max((node for node in order if node.tag in ARTICLE), key=lambda node: node.total, default=None)
        if named is not None and 4 * named.chars >= root.chars:
            whole = named
            while (up := next(_above(whole, ARTICLE), None)) is not None:
                whole = up
    if whole is not None:
        for part in whole.parent.parts:
            if part is whole or isinstance(part, Node) and part.tag in ARTICLE and not part.furniture and part.density >= threshold and 2 * part.link_chars <= part.chars:
                _blocks(part, frozenset(), out)
        return "\n".join(out)
    inside, dropped = path[0], set()
    for up in path[1 : body + 1]:
        before = True
        for part in up.parts:
            if part is inside:
                before = False
            elif isinstance(part, Node) and not part.furniture:
                linked = 2 * part.link_chars > part.chars
                if linked or part.density < threshold and not (before and part.tag in HEADINGS):
                    dropped.add(id(part))
        inside = up
    _blocks(inside, frozenset(dropped), out)
    return "\n".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``page_id, url, html``."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
