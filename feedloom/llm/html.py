"""Main text of HTML pages by composite text density.

A page becomes a tree of its block elements.  Each node has a composite text density: characters
per tag, adjusted by how much of the text and of the tags are links.  The node whose children's
densities have the largest sum is the surest part of the article; the least density on the path from
it to the body is the threshold.  All parts of the body that reach it are the text, in page order,
and so are headings beside them; link-heavy parts below it go.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import smaller

#: Fixed values of HTML: elements without content, elements whose content is not text, elements
#: that run on within a line, and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math canvas object video audio".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table td th tr ul dt dd".split())
#: An element ends open ones of these kinds, up to the nearest of the bounds.
SELF_CLOSING = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never article text, and those, like some roles and names, that only may not be.
DROP = frozenset("nav footer aside button select input dialog menu".split())
DOUBTED = frozenset("form".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words of class and id.  A name is doubted if it holds one of ``NAMES`` and else only words of ``PLAIN``.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related respond responses search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
PLAIN = frozenset("area bar block box btn button buttons column container content form global group inner item items left link links list main outer panel post posts primary right secondary section site slot stories thread top bottom unit user wrap wrapper".split())
COMMENTS = frozenset("comment comments disqus respond responses".split())
#: Text beside a doubted block that can be the page's own, in characters.
ENOUGH = 140
LOOSE, NAMED, READERS = 1, 2, 3
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT_NAME = re.compile(r"[^a-z]+")


class Node:
    """A block element: its parts are strings and nodes; links count characters of its own text."""

    __slots__ = ("tag", "parts", "links", "dropped", "doubt", "inline", "anchors", "own", "chars", "tags", "link_chars", "link_tags", "holds", "sum", "density")

    def __init__(self, tag: str, dropped: bool, doubt: int = 0):
        self.tag, self.dropped, self.doubt = tag, dropped, doubt
        self.parts: list = []
        self.links = self.inline = self.anchors = 0

    def kids(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node) and not p.dropped and p.tag != "head"]


def _doubt(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether a block goes, and else how its names speak against it; density has the last word on those."""
    if tag in DROP or (tag == "header" and not in_article):
        return True, 0
    doubt = NAMED if tag in DOUBTED else 0
    if tag in ("body", "html", "main"):
        return False, 0
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value.strip() in ROLES:
                doubt = max(doubt, NAMED)
            continue
        for name in value.split():
            words = [w for w in SPLIT_NAME.split(name) if w]
            known = NAMES.intersection(words)
            if not known or (known == {"header"} and (in_article or len(words) > 1 and "site" not in words)):
                continue
            if known and PLAIN.union(NAMES).issuperset(words):
                doubt = max(doubt, READERS if known <= COMMENTS else NAMED)
            else:
                doubt = max(doubt, LOOSE)
    return False, doubt if tag != "article" or doubt == READERS else 0


def parse(page: str) -> Node:
    """The tree of block elements; unwanted parts are marked, raw content is left out."""
    root = Node("#root", False)
    stack: list[tuple[str, Node, bool]] = [("#root", root, False)]  # element, its block, inside a link
    at, size = 0, len(page)

    def close(k: int) -> None:
        del stack[k:]

    def text(s: str) -> None:
        if s:
            s = html.unescape(s) if "&" in s else s
            _, block, link = stack[-1]
            block.parts.append(s)
            if link:
                block.links += len("".join(s.split()))

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # a stray inline end tag ends no block
            continue
        if tag == "br":
            stack[-1][1].parts.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else (size if tag in ("script", "style", "textarea", "title", "xmp") else at)
            continue
        if tag in VOID:
            if tag == "hr":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                stack[-1][1].parts.append(Node("hr", False))
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in SELF_CLOSING:
            ends, bounds = SELF_CLOSING[tag]
            low = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in bounds:
                    break
                if stack[k][0] in ends:
                    low = k
            if low:
                close(low)
        _, block, link = stack[-1]
        if tag in INLINE:
            block.inline += 1
            block.anchors += tag == "a"
            stack.append((tag, block, link or tag == "a"))
        else:
            child = Node(tag, *_doubt(tag, m[3], any(t in ("article", "main") for t, _, _ in stack)))
            block.parts.append(child)
            stack.append((tag, child, link))
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes that stay, parents before children; deep pages need no recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.kids())
    return out


def _measured(root: Node) -> tuple[list[Node], dict[int, Node], Node]:
    """The nodes that stay with the characters and tags of their subtrees, their parents, and the body."""
    nodes, parent = _walk(root), {}
    for node in reversed(nodes):
        kids = node.kids()
        for k in kids:
            parent[id(k)] = node
        node.own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.chars = node.own + sum(k.chars for k in kids)
        node.tags = node.inline + len(kids) + sum(k.tags for k in kids)
        node.link_chars = node.links + sum(k.link_chars for k in kids)
        node.link_tags = node.anchors + sum(k.link_tags for k in kids)
        node.holds = (node.tag in ("article", "main") and node.doubt != READERS and node.chars > 0) or any(k.holds for k in kids)
    body = next((n for n in nodes if n.tag == "body"), root)
    return nodes, parent, body if body.chars else root


def _densest(nodes: list[Node], parent: dict[int, Node], body: Node) -> Node:
    """Sets each node's density, and finds the one whose children's densities have the largest sum."""
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
        node.density = c / t * max(0.0, math.log(c / lc * t / lt + 1e-9) / math.log(base + 1)) if c else 0.0
    best, most = body, -1.0
    for node in nodes:
        node.sum = sum(k.density for k in node.kids())
        if node.sum > most or (node.sum == most and parent.get(id(node)) is best):
            best, most = node, node.sum
    return best


def _settle(root: Node) -> None:
    """Drops doubted blocks where the page's text is elsewhere.

    A block that holds the article or main element stays.  Reader comments go if enough text is left beside
    them.  Other doubted blocks go unless the densest node is in them; then only if what lies beside them is
    enough and at least a quarter of theirs.  So the name of a wrapper round the whole page does nothing.
    """
    for kinds in ((READERS,), (LOOSE, NAMED)):
        nodes, parent, body = _measured(root)
        if not any(n.doubt in kinds for n in nodes):
            continue
        way, node = set(), _densest(nodes, parent, body)
        while node is not None:
            way.add(id(node))
            node = parent.get(id(node))
        left = body.chars - body.link_chars
        gone: set[int] = set()
        for n in nodes:
            if id(parent.get(id(n))) in gone:
                gone.add(id(n))
                continue
            if n.doubt not in kinds or n.holds:
                continue
            own = n.chars - n.link_chars
            beside = left - own
            if n.doubt == READERS:
                drop = beside >= min(ENOUGH, own)
            elif n.doubt == LOOSE:
                drop = 2 * n.link_chars > n.chars and id(n) not in way
            else:
                drop = id(n) not in way or (beside >= ENOUGH and 4 * beside >= own)
            if drop:
                n.dropped = True
                gone.add(id(n))
                left -= own


def main_text(page: str) -> str:
    root = parse(page)
    _settle(root)
    nodes, parent, body = _measured(root)
    best = _densest(nodes, parent, body)
    share = body.link_chars / max(1, body.chars)
    limit, node = best.density, best
    while node is not body and id(node) in parent:
        node = parent[id(node)]
        limit = min(limit, node.density)

    def reaches(c: int) -> bool:
        """Whether a run of ``c`` characters beside the blocks of its element is as dense as the threshold."""
        return c > 0 and c * math.log(c) / math.log(math.log(share * c + math.e) + 1) >= limit

    blocks: list[str] = []
    current: list[str] = []

    def flush() -> None:
        block = " ".join("".join(current).split())
        if block:
            blocks.append(block)
        current.clear()

    # each part, and whether it lies in a subtree that reaches the threshold
    todo: list = [(body, body is best)]
    while todo:
        part, inside = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            current.append(part)
        elif not part.dropped and part.tag != "head":
            linked = 2 * part.link_chars > part.chars
            if inside and part is not body and part.density < limit and linked:
                continue
            inside = inside or (part is not body and (part.density >= limit or (part.tag in HEADINGS and not linked)))
            flush()
            todo.append((None, inside))
            if inside:
                todo += [(p, True) for p in reversed(part.parts)]
                continue
            rest: list = []
            for is_text, run in groupby(part.parts, lambda p: isinstance(p, str)):
                run = list(run)
                if not is_text:
                    rest += [(p, False) for p in run]
                elif 2 * part.links <= part.own and reaches(len("".join("".join(run).split()))):
                    rest += [(p, True) for p in run]
            todo += reversed(rest)
    flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Blocks of the article are trimmed, runs of white space in them are one space, and two line feeds
    join them in page order.  Null or empty page: empty text.  Equal density sums: the inner node.
    Repeated rows and null ids or urls: each row gives its own.  Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in smaller(batches):
            texts = [main_text(h) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
