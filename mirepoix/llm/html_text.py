"""Main text of web pages by composite text density.

Every node of the page's tree has the characters of its subtree for each tag, adjusted for link text. The
node whose children's densities have the largest sum is the content's subtree; the least density on the path
from the body to it is the threshold that tells which of its parts are content. Parts that say themselves
that they are not content (navigation, forms, scripts, adverts and so on) are left out beforehand.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from mirepoix.llm.common import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr br img".split()
)
#: Elements that are never main text.
DROPPED = frozenset(
    "script style noscript template head nav footer aside form button select option textarea input iframe object"
    " embed canvas svg math audio video menu dialog title".split()
)
_WORDS = (
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay"
    r"|navigation|navbar|nav|menus?|breadcrumbs?|sidebars?|side|widgets?|related|recommend\w*|share|sharing|social"
    r"|comments?|disqus|replies|reply|respond|footer|foot|header|masthead|topbar|toolbar|newsletter|subscribe|signup|login"
    r"|search|pagination|pager|skip|contentinfo|complementary"
)
#: Names (class, id, role) of what is not main text: such a word with or without words of place and form around it. A
#: name like "has-sidebar" or "post-header" tells about something else.
MARKED = re.compile(
    rf"(?:(?:site|page|global|main|top|bottom|left|right|primary|secondary|cookie|reader|user)[_-])*(?:{_WORDS})"
    rf"(?:[_-](?:{_WORDS}|list|box|section|wrap|wrapper|container|area|bar|block|links?|inner|content|form|thread|item|unit|slot"
    r"|top|bottom|left|right|\d+))*",
    re.IGNORECASE,
)
#: Marked parts that may well be longer than the main text.
REMARKS = re.compile(r"comment|disqus|repl|respond", re.IGNORECASE)
#: Elements whose header is part of the text.
WHOLE = frozenset(("article", "main"))
#: Opening one of these ends an open paragraph.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Opening the key ends an open element of the value, looked for up to the boundary.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: No open paragraph is looked for beyond these.
SCOPE = frozenset("html body table td th caption button object template article section main div".split())


class Node:
    __slots__ = (
        "chars", "children", "density", "dropped", "inside", "link_chars", "link_tags", "marked", "parent", "sum", "tag", "tags",
    )

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        #: Within an article or the like; named as something else than main text.
        self.inside = tag in WHOLE or (parent is not None and parent.inside)
        self.marked = False
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


class Tree(HTMLParser):
    """Builds the tree; end tags that fit nothing are ignored, missing ones are supplied."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.body: Node | None = None
        #: How many elements of a tag are open.
        self.open: Counter = Counter()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            if tag == "body" and self.body is None:
                self._close_to({"head"}, set())
                self.body = self._open("body", False)
            return
        if tag in BLOCKS:
            self._close_to({"p"}, SCOPE)
        if tag in ENDS:
            self._close_to(*ENDS[tag])
        node = self._open(tag, self._dropped(tag, attrs))
        if named(tag, attrs):
            # remarks go whatever they hold, other marked parts unless they hold the text itself
            remarks = any(n in ("class", "id", "role") and v and REMARKS.search(v) for n, v in attrs)
            node.dropped, node.marked = node.dropped or remarks, not remarks
        if tag in VOID:
            self._leave(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag not in BLOCKS and tag not in INLINE:
            self._leave(self.at)

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("html", "body") and tag not in VOID:
            self._close_to({tag}, {"body"} if tag in BLOCKS else SCOPE - {tag})

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def _open(self, tag: str, dropped: bool) -> Node:
        node = Node(tag, self.at, dropped)
        self.at.children.append(node)
        self.at = node
        self.open[tag] += 1
        return node

    def _leave(self, node: Node) -> None:
        if self.at is node and node.parent is not None:
            self.at = node.parent
            self.open[node.tag] -= 1

    def _close_to(self, tags: set, bounds) -> None:
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in bounds or node.tag == "body":
                return
            node = node.parent
        if node.parent is not None:
            while self.at is not node:
                self._leave(self.at)
            self._leave(node)

    def _dropped(self, tag: str, attrs: list) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header":
            return not self.at.inside
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and value and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                return True
        return False


def named(tag: str, attrs: list) -> bool:
    """Whether an element's names say that it is not main text."""
    if tag in WHOLE or tag in ("b", "p", "br"):
        return False
    return any(
        name in ("class", "id", "role") and value and any(map(MARKED.fullmatch, value.split())) for name, value in attrs
    )


def _length(text: str) -> int:
    return len(" ".join(text.split()))


def in_order(top: Node) -> list[Node]:
    """Nodes that are not dropped, parents first."""
    found = [top]
    for node in found:
        found.extend(c for c in node.children if isinstance(c, Node) and not c.dropped)
    return found


def measure(body: Node) -> list[Node]:
    """Composite text density of every node and the sum over its children; returns the nodes, parents first."""
    nodes = in_order(body)
    for node in reversed(nodes):
        node.chars = sum(_length(c) for c in node.children if isinstance(c, str))
        for c in node.children:
            if isinstance(c, Node) and not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.tag == "a":
            node.link_chars = node.chars
            node.link_tags += 1
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        tags, links = max(1, node.tags), max(1, node.link_tags)
        plain = max(1, node.chars - node.link_chars)
        if node.chars:
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            ratio = node.chars * tags / (max(1, node.link_chars) * links)
            node.density = node.chars / tags * max(0.0, math.log(max(ratio, 1.0)) / math.log(max(base, 1.0001)))
    for node in reversed(nodes):
        node.sum = sum(c.density for c in node.children if isinstance(c, Node) and not c.dropped)
        # text of the node itself counts as a child without tags
        node.sum += sum(_length(c) for c in node.children if isinstance(c, str))
    return nodes


def content(body: Node) -> tuple[Node, float]:
    """The subtree of the largest sum and the threshold of the path to it."""
    nodes = measure(body)
    best = max(nodes, key=lambda n: n.sum)
    threshold, node = math.inf, best
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent if node is not body else None
    # an inline element or a paragraph is never the whole text
    while best is not body and (best.tag in INLINE or best.tag == "p"):
        best = best.parent
    return best, threshold


def drop_marked(body: Node) -> None:
    """Leaves out marked parts, but for one that holds a main heading or an article and at least half of the page's text
    outside links: that is a wrapper with a telling name, not a part of its own."""
    nodes = in_order(body)
    plain: dict[int, int] = {}
    headed: dict[int, bool] = {}
    for node in reversed(nodes):
        below = [id(c) for c in node.children if isinstance(c, Node) and not c.dropped]
        own = sum(_length(c) for c in node.children if isinstance(c, str)) + sum(map(plain.__getitem__, below))
        plain[id(node)] = 0 if node.tag == "a" else own
        headed[id(node)] = node.tag in WHOLE or node.tag == "h1" or any(map(headed.__getitem__, below))
    for node in nodes:
        if node.marked and not (headed[id(node)] and 2 * plain[id(node)] >= plain[id(body)]):
            node.dropped = True


def blocks(top: Node) -> Iterator[str]:
    """Text of each block in page order, white space as single spaces; what inline elements hold belongs to
    the block around them, and a line break is a space."""
    parts: list[str] = []
    stack: list[tuple[Node, int]] = [(top, 0)]

    def flush() -> str:
        text = " ".join("".join(parts).split())
        parts.clear()
        return text

    while stack:
        node, i = stack.pop()
        if i == len(node.children):
            if node.tag not in INLINE and (text := flush()):
                yield text
            continue
        stack.append((node, i + 1))
        child = node.children[i]
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append(" ")
        elif not child.dropped:
            if child.tag not in INLINE and (text := flush()):
                yield text
            stack.append((child, 0))
    if text := flush():
        yield text


def main_text(html: str | None) -> str:
    """Main text of a page, blocks joined by line feeds; empty if there is none."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    body = tree.body or tree.root
    if body is not tree.root and body.children == [] and len(tree.root.children) > 1:
        body = tree.root
    drop_marked(body)
    top, threshold = content(body)
    if threshold > 0:
        # of what lies beside the content, blocks below the threshold that are mostly links go
        for node in in_order(top)[1:]:
            if node.tag not in INLINE and node.density < threshold and 2 * node.link_chars > node.chars:
                node.dropped = True
    return "\n".join(blocks(top))


def with_main_text(pages: DataFrame, html_col: str = "html", column: str = "text") -> DataFrame:
    """``pages`` with ``column``: the main text of ``html_col``.

    Null and empty pages, and pages without text, have an empty one. Nothing is cut off; a column of that
    name is replaced, all others and repeated rows are kept.
    """

    def rows(texts: list) -> Iterator[tuple]:
        return ((main_text(t),) for t in texts)

    names = [c for c in pages.columns if c != column]
    return map_texts(pages, html_col, names, rows, f"`{column}` string")
