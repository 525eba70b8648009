"""Main text of web pages by tree scoring.

A page becomes a tree (HTML's usual implied end tags are supplied). Boilerplate subtrees go first: menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments, by tag, role and whole class or id words (the words spare what
holds an article, a main element or most of the paragraph text; names such as has-sidebar or no-comments say nothing). Each
paragraph then gives points for its length and commas to its parent and, at half and a third, to the next two ancestors; a
container's points are discounted by its link density. From the best container it goes up to the outermost article or main element
around it, and all such elements with paragraphs are kept whole, with all siblings, loose text too, that are not mostly links. If
there is none, or if most paragraph text is outside them, it goes up until all paragraphs are held. All text of what is kept comes
out, block by block.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..tables import table

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<self>/?)>|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
DROP = set("nav footer aside form script style noscript template iframe head title button select textarea input option svg canvas object embed dialog menu".split())
DROP_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Whole words of class and id names that mark boilerplate; fixed.
DROP_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer masthead topbar toolbar social share sharing related recommended recommendations widget "
    "comment comments commentlist disqus respond replies reviews login search skip".split()
)
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_OUTSIDE_P, _KEEPS_P = BLOCKS - {"p"}, {"button", "td", "th", "table", "object"}
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: First parts of class names that say what an element has or has not, not what it is; fixed.
_TELLS_OF = {"has", "no", "not", "with", "without", "is", "hide", "show", "non"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "chars", "commas", "links", "points", "own")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.chars = self.commas = self.links = 0
        self.points = 0.0
        self.own = 0


class _Tree:
    """The page's tree while it is built. Where each tag is open is kept by tag, so nesting costs no walk over the ancestors."""

    def __init__(self) -> None:
        self.root = Node("#root", {}, None)
        self.open: list[Node] = [self.root]
        self.at: dict[str, list[int]] = {}

    @property
    def top(self) -> Node:
        return self.open[-1]

    def last(self, tag: str) -> int:
        """Depth of the innermost open element of the tag; 0 if there is none."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def innermost(self, tags: Iterable[str]) -> int:
        return max((self.last(t) for t in tags), default=0)

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def close(self, depth: int) -> None:
        """Closes the element at the depth and all within."""
        while len(self.open) > depth:
            self.at[self.open.pop().tag].pop()

    def outermost_within(self, tags: Iterable[str], depth: int) -> int:
        """Depth of the outermost open element of the tags that is deeper than ``depth``; 0 if there is none."""
        found = 0
        for t in tags:
            places = self.at.get(t, ())
            i = bisect_right(places, depth)
            if i < len(places):
                found = min(found or places[i], places[i])
        return found


def parse(page: str) -> Node:
    """The page's tree; children are nodes and strings, in page order."""
    tree = _Tree()
    i, n = 0, len(page)
    while i < n:
        if page[i] != "<":
            j = page.find("<", i)
            j = n if j < 0 else j
            x = page[i:j]
            tree.top.children.append(html.unescape(x) if "&" in x else x)
            i = j
            continue
        m = _TOKEN.match(page, i)
        if m["text"] == "<" and page[i + 1 : i + 2].isalpha() and page.find(">", i) < 0:  # the page ends within a tag
            break
        i = m.end()
        if m["text"] is not None:
            tree.top.children.append((html.unescape(x) if "&" in (x := m["text"]) else x))
        elif m["cdata"] is not None:
            tree.top.children.append(m["cdata"])
        elif m["tag"] is not None:
            tag = m["tag"].lower()
            if m["close"]:
                if (at := tree.last(tag)) and (tag != "p" or at > tree.innermost(_OUTSIDE_P)):
                    tree.close(at)
                continue
            if tag in CLOSES_P and (at := tree.last("p")) > tree.innermost(_KEEPS_P):
                tree.close(at)
            if tag in _IMPLIED:
                ends, within = _IMPLIED[tag]
                if at := tree.outermost_within(ends, tree.innermost(within)):
                    tree.close(at)
            attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m["attrs"] or "")}
            node = Node(tag, attrs, tree.top)
            tree.top.children.append(node)
            if tag in VOID or m["self"] and tag not in BLOCKS | RAW:
                continue
            if tag in RAW:
                end = _END[tag].search(page, i)
                node.children.append(page[i : end.start() if end else n])
                i = end.end() if end else n
                continue
            tree.push(node)
    return tree.root


def _boilerplate(node: Node, inside: bool) -> bool:
    """By tag, role or hiding. ``inside``: within an article or main element, whose header is its own."""
    if node.tag in DROP or node.tag == "header" and not inside:
        return True
    a = node.attrs
    return a.get("role", "").lower() in DROP_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", "").lower()))


def _named(node: Node, inside: bool) -> bool:
    """By class or id."""
    if node.tag in ("article", "main", "body", "html"):
        return False
    for name in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower().split():
        words = re.split(r"[^a-z0-9]+", name)
        if words[0] not in _TELLS_OF and (not DROP_WORDS.isdisjoint(words) or "header" in words and not inside):
            return True
    return False


def _walk(root: Node, drop: Callable[[Node, bool], bool]) -> list[Node]:
    """Cuts off what is to be dropped and returns what is left, parents first."""
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        order.append(node)
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not drop(c, inside)]
        todo.extend((c, inside) for c in node.children if not isinstance(c, str))
    return order


def _pruned(root: Node) -> list[Node]:
    """Cuts boilerplate off and returns what is left, parents first.

    A class or id cuts no subtree off that holds an article or main element or most of the paragraph text outside links; the
    words then hold within it.
    """
    order = _walk(root, _boilerplate)
    if not any(_named(x, False) for x in order):
        return order
    para, whole, text = set(), set(), {}
    for x in order:  # paragraph text: in paragraphs and the like, articles and main elements, or all if there is none
        if x.tag in ("p", "pre", "td", "blockquote", "li", "dd", "h1", "h2", "h3", "article", "main") or x.parent is not None and id(x.parent) in para:
            para.add(id(x))
    for some in (True, False):
        text = {id(x): sum(len(c.strip()) for c in x.children if isinstance(c, str)) if not some or id(x) in para else 0 for x in order}
        for x in reversed(order):
            if x.parent is not None and x.tag != "a":
                text[id(x.parent)] += text[id(x)]
        if text[id(root)]:
            break
    for x in reversed(order):
        if x.parent is not None and (x.tag in ("article", "main") or id(x) in whole):
            whole.add(id(x.parent))
    most = text[id(root)] / 2
    return _walk(root, lambda x, inside: _named(x, inside) and id(x) not in whole and text[id(x)] <= most)


def _score(order: list[Node]) -> None:
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip())
                node.commas += c.count(",")
            else:
                node.chars += c.chars
                node.commas += c.commas
                node.links += c.chars if c.tag == "a" else c.links
    for node in order:
        if node.tag in BLOCKS or node.parent is None:  # its text outside links and inner blocks
            node.own = sum(len(c.strip()) if isinstance(c, str) else c.chars - c.links for c in node.children if isinstance(c, str) or c.tag != "a" and c.tag not in BLOCKS)
        own = node.tag in ("p", "pre", "td", "blockquote", "li", "dd", "h1", "h2", "h3") or node.tag in BLOCKS and any(isinstance(c, str) and c.strip() for c in node.children)
        if not own or not node.chars:
            continue
        points = (1 + node.commas + min(node.chars / 100, 3)) * (1 - node.links / node.chars)
        up, share = node.parent, 1
        while up is not None and share <= 3:
            up.points += points / share
            up, share = up.parent, share + 1
    for node in order:
        node.points += {"article": 25, "main": 20, "section": 3}.get(node.tag, 0) if node.points else 0
        node.points *= 1 - node.links / node.chars if node.chars else 0


def _kept(order: list[Node], best: Node) -> list[Node | str]:
    """Subtrees that hold the main text, in page order, and loose text beside them; none lies in another."""
    held = {id(x): x.own for x in order}  # paragraph text of each subtree
    for x in reversed(order):
        if x.parent is not None:
            held[id(x.parent)] += held[id(x)]
    total = held[id(order[0])]
    tops, outer, up = [], None, best
    while up is not None:
        outer = up if up.tag in ("article", "main") else outer
        up = up.parent
    if outer is not None:
        todo = [order[0]]
        while todo:
            x = todo.pop()
            if x.tag in ("article", "main"):
                if x is outer or held[id(x)]:
                    tops.append(x)
            else:
                todo.extend(c for c in x.children if not isinstance(c, str))
    if not tops or 2 * sum(held[id(x)] for x in tops) < total:
        at = best
        while at.parent is not None and held[id(at)] < total:
            at = at.parent
        return [at]
    keep = {id(x) for x in tops} | {id(x) for x in outer.parent.children if isinstance(x, str) or x.chars and x.links <= x.chars / 2}
    out: list[Node | str] = []
    todo: list[Node | str] = [order[0]]
    while todo:
        x = todo.pop()
        if id(x) in keep:
            out.append(x)
        elif not isinstance(x, str):
            todo.extend(reversed(x.children))
    return out


def _blocks(node: Node, out: list[str]) -> None:
    """Adds the node's text to ``out``, a string a block."""
    part: list[str] = []

    def end() -> None:
        text = " ".join("".join(part).split())
        if text:
            out.append(text)
        part.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            part.append(x)
        elif x.tag in BLOCKS:
            end()
            todo.append(None)
            todo.extend(reversed(x.children))
        elif x.tag == "br":
            part.append(" ")
        else:
            todo.extend(reversed(x.children))
    end()


def extract(page: str | None) -> str:
    """Main text of a page: blocks joined by newlines; empty for null, empty or text-less pages."""
    if not page:
        return ""
    order = _pruned(parse(page))
    _score(order)
    containers = [x for x in order if x.points > 0 and x.tag not in ("#root", "html")]
    best = max(containers, key=lambda x: x.points, default=order[0])
    # under one node, so that loose text and inline elements that follow each other make one block
    main = Node("div", {}, None)
    main.children = _kept(order, best)
    out: list[str] = []
    _blocks(main, out)
    return "\n".join(out)


@F.pandas_udf(StringType())
def extract_udf(pages: pd.Series) -> pd.Series:
    return pages.map(extract, na_action=None)


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``: map-only, a page at a time, so memory follows the longest page.

    Null and empty html give an empty text; repeated rows give equal texts; a column named text is replaced.
    """
    return pages.withColumn("text", F.coalesce(extract_udf(F.col(html_col)), F.lit("")))


def op5_html(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_html": op5_html}
ORACLE_SQL: dict[str, str] = {}
