"""Main text of web pages by composite text density.

A forgiving parser makes a tree of the page; code, controls and what is not shown are no text.
Every node gets its composite density: link-adjusted characters per tag, and the sum of the
densities of its child blocks (elements within a line belong to their block).  The node of
the largest sum is the text; the least density on the path between it and the body is the
threshold by which other parts beside that path join or link lists inside are dropped.  Beside
the path a paragraph is judged by its own density, a container by the sum of its blocks'; the
body is a frame of containers even where it is the node chosen.  Bare text of the nodes on the
path joins unless half of it is links.

What says of itself, by tag or name, that it is something else (menus, page heads and feet,
side columns, notices, adverts, readers' comments) is then left out of the text so chosen.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pathval.llm.common import give_back

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.DOTALL,
)
ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Elements without an end tag, raw text elements, elements that part blocks of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: A start tag of the key ends open elements of the value, up to a container.
CLOSES = {t: frozenset({"p"}) for t in BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr", "li", "dd", "dt"}} | {
    "li": frozenset({"li", "p"}),
    "dd": frozenset({"dd", "dt", "p"}),
    "dt": frozenset({"dd", "dt", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "tr": frozenset({"td", "th", "tr", "p"}),
    "tbody": frozenset({"td", "th", "tr", "tbody", "thead", "p"}),
    "tfoot": frozenset({"td", "th", "tr", "tbody", "thead", "p"}),
    "option": frozenset({"option"}),
}
WALL = {
    "li": frozenset({"ul", "ol", "menu", "dir"}),
    "dd": frozenset({"dl"}),
    "dt": frozenset({"dl"}),
    "option": frozenset({"select", "datalist"}),
}
WALL_ELSE = frozenset("table td th div section article main aside nav header footer form blockquote body html button object ul ol dl".split())
WALL_ROWS = frozenset({"table", "body", "html"})

#: Elements that hold no text: code, media and controls.
NO_TEXT = frozenset("head script style noscript template iframe object embed svg canvas audio video map button select textarea input math noembed noframes datalist".split())
#: Containers, which hold blocks of text; other blocks are paragraphs, lists, tables.
FRAMES = frozenset("div section article main aside header footer nav form fieldset body html center dialog details dir menu hgroup address".split())
#: Elements that say of themselves that they are no article text, by tag, role, and a word of their class or id.
APART = frozenset("nav footer aside form label fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsors sponsored promo promos promotion banner banners "
    "nav navbar navigation menu menus submenu topnav subnav breadcrumb breadcrumbs crumbs pagination pager toolbar skip "
    "header masthead footer foot copyright colophon sidebar sidebars aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall subscribe subscription newsletter signup login "
    "comment comments commentlist disqus respond reply replies discussion "
    "share sharing social related recommended recommendations trending popular taboola outbrain form search".split()
)
REMARKS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Stands for a run of bare text beside blocks.
LINE = "#line"
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "chars", "tags", "link_chars", "links", "density", "total")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(self.attrs)}


class Open:
    """The elements that are open: a stack, and of each tag the places on it, so that no step walks up the tree."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags; 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first_behind(self, tags: Iterable[str], wall: int) -> int:
        """The place of the outermost element of these tags inside that at ``wall``; 0 for none."""
        found = 0
        for t in tags:
            at = self.places.get(t)
            if at and at[-1] > wall:
                place = at[bisect_right(at, wall)]
                found = min(found or place, place)
        return found

    def close(self, place: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()


def parse(page: str) -> Node:
    """The page's tree, in time linear in its length; character references are decoded, comments and declarations left out."""
    root = Node("#root", "", None)
    still = Open(root)
    at, end = 0, len(page)
    while at < end:
        here = still.stack[-1]
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            here.children.append(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if m["tag"] is None:
            if page.startswith("<![CDATA[", stop):
                here.children.append(page[stop + 9 : at].removesuffix("]]>"))
            continue
        tag = m["tag"].lower()
        if m["end"]:
            place = still.last((tag,))
            if place and (tag in BLOCK or place >= still.last(WALL_ELSE)):
                still.close(place)
            continue
        if ends := CLOSES.get(tag):
            wall = WALL.get(tag) or (WALL_ROWS if tag in ("td", "th", "tr", "tbody", "tfoot") else WALL_ELSE)
            if place := still.first_behind(ends, still.last(wall)):
                still.close(place)
                here = still.stack[-1]
        attrs = m["attrs"]
        node = Node(tag, attrs, here)
        here.children.append(node)
        if tag in RAW:
            close_at = re.compile(rf"</{re.escape(tag)}\s*(?:[/\s][^>]*)?>", re.I).search(page, at)
            node.children.append(page[at : close_at.start() if close_at else end])
            at = close_at.end() if close_at else end
        elif tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            still.push(node)
    return root


def preorder(root: Node) -> Iterator[Node]:
    left = [root]
    while left:
        node = left.pop()
        yield node
        left += [c for c in reversed(node.children) if isinstance(c, Node)]


def clean(root: Node) -> None:
    """Take out what is no text by its tag, and what is not shown."""
    left = [root]
    while left:
        node = left.pop()
        keep: list[Node | str] = []
        for c in node.children:
            if isinstance(c, Node):
                if c.tag in NO_TEXT or c.attrs and _hidden(c):
                    keep.append(" ")
                    continue
                left.append(c)
            keep.append(c)
        node.children = keep


def _hidden(node: Node) -> bool:
    if node.tag in ("html", "body"):
        return False
    a = node.attributes()
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(a.get("style", "")))


def apart(root: Node) -> set[int]:
    """What says of itself that it is something else than article text: the outermost such nodes, by identity."""
    holds = set()  # nodes with the page's title or main part inside
    for node in preorder(root):
        if node.tag in ("h1", "main"):
            up = node
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    found, left = set(), [(root, False)]
    while left:
        node, inside = left.pop()
        inside = inside or node.tag in ("article", "main")
        for c in node.children:
            if isinstance(c, Node):
                if _apart(c, id(c) in holds, inside):
                    found.add(id(c))
                else:
                    left.append((c, inside))
    return found


def _apart(node: Node, holds: bool, inside: bool) -> bool:
    """``holds``: the title or main part; ``inside``: of an article."""
    tag = node.tag
    if tag in APART:
        return not (holds and tag in ("form", "fieldset", "label"))
    if tag == "header":
        return not inside
    if tag in ("html", "body", "main", "h1") or not node.attrs or holds:
        return False
    a = node.attributes()
    if a.get("role", "").lower() in ROLES:
        return True
    words = {w.lower() for k in ("class", "id", "data-component", "aria-label") for w in PARTS.findall(a.get(k, ""))}
    if tag in ("p", "h2", "h3", "h4", "h5", "h6", "li", "span", "b", "i", "em", "strong", "a"):
        words -= {"header", "foot", "alert", "form", "search", "popular", "related", "discussion", "reply"}
    if tag == "article":
        return bool(words & REMARKS)
    return bool(words & NAMES)


def weigh(root: Node) -> None:
    """Characters, tags and composite densities of every node, from the leaves up; a count of none stands as one."""
    nodes = list(preorder(root))
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.links += c.links + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        if node.chars:
            node.density = density(node.chars, node.tags, node.link_chars, node.links, share)
    for node in reversed(nodes):  # an element within a line hands on what it holds
        if node.tag not in BLOCK:
            node.total = sum(c.density if c.tag in BLOCK else c.total for c in node.children if isinstance(c, Node))
    for node in nodes:
        if node.tag in BLOCK:
            node.total = sum(c.density if c.tag in BLOCK else c.total for c in node.children if isinstance(c, Node))


def density(chars: int, tags: int, link_chars: int, links: int, share: float) -> float:
    """Composite text density: characters per tag times how little of both is links, by a logarithm whose base
    grows with the node's link characters and with the body's ``share`` of them."""
    tags, links, linked, plain = max(1, tags), max(1, links), max(1, link_chars), max(1, chars - link_chars)
    base = math.log(chars / plain * linked + share * chars + math.e)
    return chars / tags * math.log(chars / linked * tags / links) / math.log(base)


def _units(node: Node, on: set[int]) -> list[Node]:
    """The node's child elements, each run of bare text and the elements within its line as one ``LINE``."""
    units: list[Node] = []
    run: list[Node | str] = []

    def close() -> None:
        if not any(isinstance(c, str) and c.strip() for c in run):
            units.extend(c for c in run if isinstance(c, Node))
        else:
            line = Node(LINE, "", node)
            line.children = list(run)
            line.chars = sum(len("".join(c.split())) if isinstance(c, str) else c.chars for c in run)
            line.link_chars = sum(c.link_chars for c in run if isinstance(c, Node))
            units.append(line)
        run.clear()

    for c in node.children:
        if isinstance(c, str) or id(c) not in on and all(n.tag not in BLOCK and n.tag not in ("td", "th") for n in preorder(c)):
            run.append(c)
        else:
            close()
            units.append(c)
    close()
    return units


def chosen(root: Node, out: set[int] = frozenset()) -> tuple[list[Node], float]:
    """The text's subtrees in page order, and the threshold of the path to the body; nothing of ``out`` is among them."""
    body = next((n for n in preorder(root) if n.tag == "body"), root)
    best, left = body, [body]
    while left:
        node = left.pop()
        if node.tag in BLOCK and node.total > best.total:  # the first of equal ones
            best = node
        left += [c for c in reversed(node.children) if isinstance(c, Node) and id(c) not in out]
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)

    def joins(node: Node) -> bool:
        weight = node.total if node.tag in FRAMES else node.density
        return (node.tag == LINE or weight >= threshold) and 2 * node.link_chars < node.chars

    on = {id(n) for n in path}
    if best is body and not any(isinstance(c, Node) and c.tag in FRAMES and id(c) not in out and c.total and joins(c) for c in body.children):
        return [body], threshold
    found, left = [], [body]
    while left:
        node = left.pop()
        if id(node) in out:
            continue
        if node is best is not body or node.tag == "h1" and node.chars:
            found.append(node)
        elif id(node) in on:
            left += reversed(_units(node, on))
        elif joins(node):
            found.append(node)
    return found, threshold


def blocks(nodes: list[Node], threshold: float, without: set[int] = frozenset()) -> list[str]:
    """Blocks of text in page order, white space made single; lists of links are left out."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(part).split()):
            out.append(text)
        part.clear()

    for root in nodes:
        left: list[Node | str | None] = [root]
        while left:
            node = left.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                part.append(node)
            elif id(node) in without:
                part.append(" ")
            elif node is not root and node.tag in BLOCK and node.links > 1 and node.density < threshold and 5 * node.link_chars >= 3 * node.chars:
                flush()
            else:
                if node.tag in BLOCK:
                    flush()
                    left.append(None)
                elif node.tag in ("br", "td", "th", "img"):
                    part.append(" ")
                left += reversed(node.children)
        flush()
    return out


def extract(page: str | None, named: bool = True) -> str:
    """The main text: blocks joined by line breaks; empty for null, empty or textless pages.

    Without ``named`` density alone decides, and what parts say of themselves is not asked.
    """
    if not page:
        return ""
    root = parse(page)
    clean(root)
    weigh(root)
    out = apart(root) if named else set()
    return "\n".join(blocks(*chosen(root, out), out))


def main_text(page: Column) -> Column:
    """Main text of each whole page: empty for null, empty and textless ones.

    Very long pages take time in proportion to their length.  Repeated pages give equal texts, no
    pages give none; other columns play no part.
    """

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([extract(p.as_py()) for p in pages], pa.string())
        give_back()

    return extracted(page)
