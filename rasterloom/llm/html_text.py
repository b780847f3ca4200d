"""The main text of web pages by composite text density.

A page is cut into tags and text in one linear scan and built into a tree as browsers would, as far as text is concerned. What is
named as boilerplate (by element, role or class) is set aside. Every other node has a density: its characters for each tag below
it, adjusted by how much of them is in links and by the whole body's share of links. The subtree whose children's densities sum
up to most is the main text; other subtrees belong to it if they are as dense as the least dense node on its path to the body.

A page is one row, so nothing is shuffled; each is worked on by itself in an Arrow batch.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import give_back, small_batches

#: A comment, a declaration, or a tag with its attributes. Whatever isn't closed runs to the page's end, as in browsers, so no
#: place is looked at twice.
MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-z][^\s/>]*+)([^>=]*+(?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+)[^>=]*+)*+)(?:>|\Z)|<(?:[!?]|/[^>])[^>]*+(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")

#: The elements of HTML by their part in this.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Block elements that don't end a paragraph.
INSIDE_P = frozenset("body head html legend option optgroup caption tbody td tfoot th thead tr".split())
SCOPE = frozenset("table td th caption html button object template".split())
#: Start tags that end an open element, and what holds that back.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",))}
ENDS |= {part: (("tbody", "thead", "tfoot"), ("table",)) for part in ("tbody", "thead", "tfoot")}

#: Elements, roles and names that mark what isn't main text.
ASIDE = frozenset("nav footer aside form script style noscript template iframe object svg math canvas button select textarea input dialog head title menu search audio video xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status tablist".split())
NAMES = frozenset(
    """nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar header footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adsense adbox
    banner sponsor sponsored promo promos promoted promotion popup popover modal overlay lightbox cookie cookies consent gdpr notice notices notification notifications alert disclaimer newsletter subscribe
    subscription signup signin login share sharing social related recommended recommendations recirculation pager pagination toolbar skip copyright legal outbrain taboola tags taglist byline""".split()
)
REMARKS = frozenset("comment comments commentlist disqus reply replies respond discussion remarks".split())
#: Names that describe the page or its article rather than what an element holds.
LAYOUT = frozenset("no has with without hide show open closed enabled disabled off on".split())
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: A list or box is a menu if it has so many links and such a share of its characters in them.
MENU_LINKS, MENU_SHARE = 3, 0.75


class Node:
    __slots__ = ("tag", "parent", "children", "gone", "remark", "chars", "linked", "tags", "links", "own", "density", "sum", "order")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []  # nodes and texts, in order
        self.gone = self.remark = False
        self.chars = self.linked = self.tags = self.links = self.own = 0
        self.density = self.sum = 0.0


def marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether a tag is set aside, and whether as readers' remarks."""
    if tag in ASIDE:
        return True, False
    if not attributes.strip(" /\t\n\r\f"):
        return False, False
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return tag not in ("html", "body"), False
    if tag in ("html", "body", "main"):
        return False, False
    named = []
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w.lower() for w in WORDS.findall(name)]
        if not LAYOUT.intersection(words):
            named += words
    if REMARKS.intersection(named):
        return True, True
    return bool(ROLES.intersection(found.get("role", "").lower().split())) or (tag != "article" and bool(NAMES.intersection(named))), False


class Tree:
    """The tree of a page: open elements with their places by name, so that no search goes through the depth of the tree."""

    def __init__(self, page: str):
        self.root = Node("html", None)
        self.open, self.places, self.blocks, self.scopes = [self.root], {}, [0], [0]
        self.nodes = [self.root]
        at, end = 0, len(page)
        while at < end:
            found = MARKUP.search(page, at)
            if found is None:
                break
            self.text(page[at : found.start()])
            at = found.end()
            if (name := found[2]) is None:
                continue
            name = name.lower()
            if found[1]:
                self.end(name)
            elif self.start(name, found[3]) and name in RAW:
                closing = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                stop = closing.start() if closing else end
                if name in ("textarea", "title"):
                    self.text(page[at:stop])
                at = stop
        self.text(page[at:])

    def text(self, part: str) -> None:
        if part:
            self.open[-1].children.append(html.unescape(part) if "&" in part else part)

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def cut(self, place: int) -> None:
        """Close all that is open from a place on."""
        for node in reversed(self.open[place:]):
            self.places[node.tag].pop()
        del self.open[place:]
        for kept in (self.blocks, self.scopes):
            while kept and kept[-1] >= place:
                kept.pop()

    def start(self, name: str, attributes: str) -> bool:
        if name in ("html", "body") and (name == "html" or self.places.get("body")):
            return False
        if name not in ("head", "title", "meta", "link", "style", "script", "base", "noscript", "template") and self.places.get("head"):
            self.cut(self.places["head"][-1])
        if name in BLOCK and name not in INSIDE_P and (p := self.last(("p",))) > self.scopes[-1]:
            self.cut(p)
        if name in ENDS and (place := self.last(ENDS[name][0])) > self.last(ENDS[name][1]):
            self.cut(place)
        if name == "a" and self.places.get("a") and self.places["a"][-1] > self.blocks[-1]:
            self.cut(self.places["a"][-1])
        node = Node(name, self.open[-1])
        node.gone, node.remark = marks(name, attributes)
        self.open[-1].children.append(node)
        self.nodes.append(node)
        if name in VOID or (attributes.endswith("/") and name not in BLOCK and name not in RAW):
            return False
        place = len(self.open)
        self.open.append(node)
        self.places.setdefault(name, []).append(place)
        if name in BLOCK:
            self.blocks.append(place)
        if name in SCOPE:
            self.scopes.append(place)
        return True

    def end(self, name: str) -> None:
        if name in ("html", "body") or not self.places.get(name):
            return
        place = self.places[name][-1]
        if name in BLOCK or name in SCOPE:
            if name not in SCOPE and place < self.scopes[-1]:  # a cell's content doesn't end what is around its table
                return
        elif place < self.blocks[-1]:  # an inline end tag doesn't end the blocks that were opened meanwhile
            return
        self.cut(place)


def set_aside(tree: Tree) -> None:
    """Spread what is gone to all below it; a page's header is gone, an article's stays, and a named box around the article too."""
    holds = set()
    for node in tree.nodes:
        if node.tag in ("article", "main") and not node.gone:
            up = node.parent
            while up is not None and up not in holds:
                holds.add(up)
                up = up.parent
    inside = {tree.root: False}
    for node in tree.nodes[1:]:
        within = inside[node.parent]
        if node.tag == "header" and not within:
            node.gone = True
        if node.gone and not node.remark and node in holds and node.tag not in ASIDE:
            node.gone = False
        node.gone, node.remark = node.gone or node.parent.gone, node.remark or node.parent.remark
        inside[node] = within or node.tag in ("article", "main")


def length(text: str) -> int:
    return len(" ".join(text.split()))


def measure(tree: Tree) -> None:
    """Characters, tags and what of them is in links, then densities and the sums of children's, from the leaves up."""
    nodes = [n for n in tree.nodes if not n.gone]
    for node in reversed(nodes):
        node.own = sum(length(c) for c in node.children if isinstance(c, str))
        node.chars += node.own
        if node.tag == "a":
            node.linked, node.links = node.chars, node.links + 1
        if node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.links >= MENU_LINKS and node.linked >= MENU_SHARE * node.chars:
            node.gone = True
        elif (up := node.parent) is not None:
            up.chars, up.linked = up.chars + node.chars, up.linked + node.linked
            up.tags, up.links = up.tags + node.tags + 1, up.links + node.links
    for node in tree.nodes[1:]:
        node.gone = node.gone or node.parent.gone
    share = tree.root.linked / max(tree.root.chars, 1)
    for node in reversed(nodes):
        if not node.gone:
            node.density = density(node.chars, node.tags, node.linked, node.links, share)
            node.sum += density(node.own, 0, 0, 0, share)
            if node.parent is not None:
                node.parent.sum += node.density


def density(chars: int, tags: int, linked: int, links: int, share: float) -> float:
    """The composite density; its logarithm's base, near 1 where a page has hardly a link, is taken as e at least."""
    if not chars:
        return 0.0
    tags_, linked_, links_ = max(tags, 1), max(linked, 1), max(links, 1)
    base = math.log(chars / max(chars - linked, 1) * linked + share * chars + math.e)
    return chars / tags_ * max(math.log(chars / linked_ * tags_ / links_), 0.0) / math.log(max(base, math.e))


def main_roots(tree: Tree) -> set[Node]:
    """The roots of the main text."""
    left = [n for n in tree.nodes if not n.gone]
    best = max(left, key=lambda n: n.sum)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    floor = min(n.density for n in path if n.tag != "html" or n is best)
    named = [i for i, n in enumerate(path) if n.tag in ("article", "main")]
    top = named[0] if named else 0
    while top + 1 < len(path) and path[top + 1].tag not in ("body", "html") and 2 * path[top].chars >= path[top + 1].chars:
        top += 1
    roots, above = {path[top]}, set(path[top + 1 :])
    for node in left:
        if node in above or node.parent is None:
            continue
        if (node.density >= floor > 0 and node.linked < node.chars / 2) or node.tag == "h1":
            roots.add(node)
    return roots


def joined(tree: Tree, roots: set[Node]) -> str:
    """The blocks below the roots, each with its white space turned into blanks, one a line."""
    blocks: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(pieces).split()):
            blocks.append(text)
        pieces.clear()

    stack: list[tuple[object, bool]] = [(tree.root, False)]
    while stack:
        item, within = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if within:
                pieces.append(item)
        elif not item.gone:
            within = within or item in roots
            if item.tag == "br":
                pieces.append("\n")
            if item.tag in BLOCK:
                flush()
                stack.append((None, within))
            stack.extend((c, within) for c in reversed(item.children))
    flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    """The main text of one page; of a null or empty one, or where nothing is left, an empty text."""
    if not page:
        return ""
    tree = Tree(page.replace("\x00", ""))
    set_aside(tree)
    measure(tree)
    return joined(tree, main_roots(tree))


def extract(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each in a further column; one of that name, in any case, is replaced.

    The article comes whole: no menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup or readers'
    comments. Character references are decoded once, white space within a block becomes one blank (a line break counts as
    such), and blocks follow each other in page order, one a line. A null or empty page, and one with nothing but boilerplate,
    gives an empty text; plain text without markup is one block. Very long and very deep pages are read whole, in linear time.
    Repeated rows and null keys pass through, as do other columns, whatever their names; an empty table stays empty.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf(T.StringType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for batch in batches:
                yield pd.Series([main_text(p) for p in batch], dtype="object")
        finally:
            give_back()

    return pages.withColumn(text, of(F.col(page)))
