"""Main text of web pages by composite text density.

A page is parsed into a tree of elements. What is marked as something else than the article (menus,
page headers and footers, sidebars, notices, adverts, forms, scripts, comments, hidden parts) is cut
off. Every remaining element gets a density, its characters for each tag, weighted down by its share
of link text, and a density sum over its children. The container with the largest sum is the article's
subtree, whatever its tag or name. The smallest density on its path from the body is a threshold: the
subtree grows to hold a neighbour that is as dense as that and weighs as much as a part of the article
would.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch

_ROWS = "page_id long,url string,text string,n_chars long"

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg noframes xmp".split())
BLOCKS = set(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu "
    "nav ol option p pre search section select summary table caption tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open element of the second set, up to the nearest element of the third.
_ENDS_P = BLOCKS - set("td th tr tbody thead tfoot caption li dt dd option html body legend summary".split())
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
#: Elements that are never the article, and the roles and the words in classes and ids that say so.
CUT = set("nav footer aside form menu button select input dialog canvas audio video object embed map search fieldset datalist head label".split()) | RAW
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tooltip".split())
MARKS = set(
    "ad ads advert adverts advert-box advertisement advertisements advertising adsense sponsor sponsored promo promotion banner cookie cookies cookie-banner cookie-notice cookie-bar consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu main-menu breadcrumb breadcrumbs sidebar sidebars header site-header page-header footer "
    "site-footer page-footer masthead topbar toolbar share share-buttons sharing social social-share related related-posts widget widgets pager pagination paywall".split()
)
COMMENTS = set("comment comments comment-list comments-list comments-area comment-section commentlist respond reply replies disqus disqus_thread".split())
#: Elements that only the words for reader comments cut, those that no word cuts, headings, and elements that hold a text and are no container of several.
SECTIONS, KEPT = set("section ol ul dl figure table blockquote".split()), set("html body article main p pre h1 h2 h3 h4 h5 h6 hgroup a b i em strong span code math".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXTS = HEADINGS | set("p pre li dt dd legend summary caption figcaption address option hr tr th".split())
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|!--(?:.*?--!?>|.*\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []


def parse(page: str) -> Node:
    """The element tree. Unclosed elements end with their parents, end tags without a start are skipped."""
    root = Node("html")
    at, open_node, end = 0, root, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            rest = page[at:]
            broken = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page ends in
            open_node.children.append(unescape(rest[: broken.start()] if broken else rest))
            break
        if m.start() > at:
            open_node.children.append(unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = open_node
            while node is not root and node.tag != tag and not (tag not in BLOCKS and node.tag in BLOCKS):
                node = node.parent
            if node.tag == tag and node is not root:
                open_node = node.parent
            continue
        if tag in ("html", "body") and tag != "body":
            root.attributes = root.attributes or m[3]
            continue
        if tag in _ENDS_P:
            node = open_node
            while node is not root and node.tag != "p" and (node.tag not in BLOCKS):
                node = node.parent
            if node.tag == "p":
                open_node = node.parent
        if tag in _SIBLINGS:
            ended, fence = _SIBLINGS[tag]
            node = open_node
            while node is not root and node.tag not in ended and node.tag not in fence:
                node = node.parent
            if node.tag in ended:
                open_node = node.parent
        node = Node(tag, m[3], open_node)
        open_node.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end if tag in ("script", "style") else at
        elif tag not in VOID and not m[3].endswith("/"):
            open_node = node
    return root


def is_cut(node: Node, in_article: bool) -> bool:
    """Whether an element is marked as something else than the article, by its tag, role, or a whole word of its class or id.

    An article's own header is part of it.
    """
    if node.tag in CUT or node.tag == "header" and not in_article:
        return True
    if not node.attributes or node.tag in ("html", "body"):
        return False
    for name, a, b, c, hidden in _ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), a or b or c
        if hidden or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and node.tag not in KEPT:
            found = {token.lower() for token in value.split()}
            if found & COMMENTS or node.tag not in SECTIONS and found & MARKS:
                return True
    return False


def _prune(root: Node) -> list[Node]:
    """Cuts marked elements off; the others in page order."""
    out, stack = [], [(root, False)]
    while stack:
        node, in_article = stack.pop()
        out.append(node)
        in_article |= node.tag == "article"
        node.children = [x for x in node.children if isinstance(x, str) or not is_cut(x, in_article)]
        stack += [(x, in_article) for x in reversed(node.children) if not isinstance(x, str)]
    return out


def _measure(nodes: list[Node]) -> None:
    """Characters, tags (its own too), densities and density sums of each element, from the leaves up."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.children:
            if isinstance(x, str):
                node.chars += len(_SPACE.sub(" ", x).strip())
            else:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_tags += x.link_tags + (x.tag == "a")
                node.link_chars += x.link_chars
        if node.tag == "a":
            node.link_chars = node.chars
    share = nodes[0].link_chars / max(1, nodes[0].chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, node.tags + 1, node.link_chars, max(1, node.link_tags)
        # The squared e keeps the logarithm's base over 1 on pages without links.
        base = math.log(c * lc / max(1, c - lc) + share * c + math.e**2)
        node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base) if c else 0.0
        node.total = sum(x.density for x in node.children if not isinstance(x, str))
        own = sum(len(x.strip()) for x in node.children if isinstance(x, str))
        if own:  # text that stands beside child elements counts as a child
            node.total += min(own, c) * math.log(max(2, own)) / math.log(base)


def content(root: Node) -> tuple[Node, float]:
    """The subtree with the article, and the density threshold."""
    nodes = _prune(root)
    _measure(nodes)
    containers = [x for x in nodes if x.tag in BLOCKS and x.tag not in TEXTS and x.chars]
    if not containers:
        return root, 0.0
    top = core = max(reversed(containers), key=lambda x: x.total)  # of equals the innermost
    path, node = [], core
    while node is not None and node.tag not in ("html", "body"):
        path.append(node)
        node = node.parent
    threshold = min([x.density for x in path], default=0.0)
    for node in path:
        if any(x is not node and _belongs(x, node, core, threshold) for x in node.parent.children):
            top = node.parent
    return top, threshold


def _belongs(x: Node | str, beside: Node, core: Node, threshold: float) -> bool:
    """Whether an element is a part of the article beside the core: dense, with few links, and heavy or of the same kind."""
    if isinstance(x, str) or x.tag not in BLOCKS or x.density < threshold or x.link_chars > 0.33 * x.chars:
        return False
    return x.total >= 0.25 * core.total or x.tag not in TEXTS and (x.tag, x.attributes) == (beside.tag, beside.attributes)


def _is_menu(node: Node) -> bool:
    """Whether an element is nothing but links within the site. A list of sources links to other hosts, and stays."""
    if node.tag not in BLOCKS or node.link_tags < 3 or node.link_chars < 0.9 * node.chars:
        return False
    links, stack = [], [node]
    while stack:
        x = stack.pop()
        if not isinstance(x, str):
            links += [x] if x.tag == "a" else []
            stack += x.children
    return 2 * sum("//" in x.attributes for x in links) < len(links)


def extract(page: str) -> str:
    """The article's blocks, one a line."""
    top, _ = content(parse(page))
    lines: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(current)).strip()
        current.clear()
        if text:
            lines.append(text)

    # A headline may stand before the subtree.
    beside = top.parent.children if top.parent is not None else [top]
    before = [x for x in beside[: next(k for k, x in enumerate(beside) if x is top)] if not isinstance(x, str) and x.tag in HEADINGS]
    stack: list[Node | str | None] = [top, *reversed(before)]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            current.append(x)
        elif x.tag == "br":
            current.append(" ")
        elif x is not top and _is_menu(x):
            flush()
        else:
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return "\n".join(lines)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row.

    Null and empty pages, and pages without an article, have empty text. Each page is parsed whole, however
    long, by itself, so repeated rows repeat and no page size or count changes another's result. Of containers
    with equal density sums the innermost counts. Null ids and urls stay null, an empty table gives no row,
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                some = b.slice(at, 200)
                texts = [extract(x or "") for x in some.column(2).to_pylist()]
                yield batch(_ROWS, page_id=some.column(0), url=some.column(1).to_pylist(), text=texts, n_chars=[len(t) for t in texts])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, _ROWS)
