"""Main text of web pages by composite text density.

The page is read into a tree. For each element, ``chars`` and ``tags`` count its text
and its elements, ``link_chars`` and ``link_tags`` those inside links. The composite
density weighs characters per tag by how little of them is link text. The sum of the
children's densities picks the container with the most text; the smallest density on
its path up to the body is the threshold that a neighbour must reach to belong to the
main text as well. Elements that are never part of an article (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments) are left out first, by
their name, role, class or id.

Blocks of the chosen container come in page order; ``br`` ends a block. Nothing else is
dropped or capped. Null and empty pages give an empty text; broken markup (missing or
surplus end tags, a page that stops anywhere) is read the way browsers do, as far as
text is concerned. Repeated rows are separate rows. Ties of the density sum go to the
outer container.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.rows import texts

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe xmp noembed noframes plaintext".split())
ESCAPABLE = frozenset("textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li legend main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div body td center blockquote figure details dd li ul ol dl table tbody tr".split())
ENDS_P = BLOCK - frozenset("body html head option optgroup td th tr tbody thead tfoot legend".split())
OWN_KIND = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
NEVER = frozenset(
    "head nav header footer aside form script style noscript iframe template button select textarea input label fieldset menu dialog object "
    "embed applet canvas svg audio video map title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tablist".split())
# Words of class names and ids that mark what is not the article, whatever stands beside them ...
ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promotion sidebar sidebars comment comments "
    "disqus respond cookie cookies consent gdpr nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager popup modal newsletter "
    "subscribe subscription paywall toolbar masthead share sharing social related recommended recommendations widget widgets skip login signup".split()
)
# ... and those that do unless a word of the article's own stands beside them.
PERHAPS = frozenset("header footer notice notices alert aside rail form search tags meta byline disclaimer legal copyright replies reviews".split())
ARTICLE = frozenset("article content post entry main story body text".split())

NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""\s*/?\s*([^\s=>/"'][^\s=>/]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    __slots__ = ("name", "parent", "children", "dropped", "article", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, dropped: bool = False, article: bool = False):
        self.name, self.parent, self.children = name, parent, []
        self.dropped, self.article = dropped, article
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def unwanted(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element is never part of an article."""
    if name in NEVER:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    if name in ("html", "body"):
        return False
    pieces = {p.lower() for key in ("class", "id") for p in PIECE.findall(attributes.get(key, ""))}
    return bool(pieces & ALWAYS or (pieces & PERHAPS and not pieces & ARTICLE))


def end_of_tag(page: str, at: int) -> int:
    """The place after the > that ends a tag, quotes respected; the page's end if there is none."""
    while True:
        close = page.find(">", at)
        if close < 0:
            return len(page)
        quotes = [q for q in (page.find('="', at, close), page.find("='", at, close)) if q >= 0]
        if not quotes:
            return close + 1
        q = min(quotes)
        shut = page.find(page[q + 1], q + 2)
        if shut < 0:
            return close + 1
        at = shut + 1


def parse(page: str) -> Node:
    """The tree of a page; text is kept as str children, line ends as None."""
    root = here = Node("html", None)
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            here.children.append(html.unescape(page[at:start]))
        if start >= n:
            break
        next_char = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            shut = page.find("-->", start + 4)
            at = n if shut < 0 else shut + 3
        elif next_char in ("!", "?"):
            shut = page.find(">", start)
            at = n if shut < 0 else shut + 1
        elif next_char == "/":
            found = NAME.match(page, start + 2)
            shut = page.find(">", start)
            at = n if shut < 0 else shut + 1
            if found:
                here = closed(here, found.group().lower())
        elif found := NAME.match(page, start + 1):
            at = end_of_tag(page, found.end())
            name = found.group().lower()
            rest = page[found.end() : at].rstrip(">")
            attributes = {}
            if "=" in rest or rest.strip(" /"):
                for key, value in ATTRIBUTE.findall(rest):
                    attributes.setdefault(key.lower(), html.unescape(value.strip("\"'")))
            here = opened(here, name, attributes)
            if name in RAW or name in ESCAPABLE:
                shut = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                if name == "plaintext" or not shut:
                    at = n
                else:
                    at = page.find(">", shut.start())
                    at = n if at < 0 else at + 1
                here = here.parent
            elif name in VOID:
                here = here.parent
        else:
            here.children.append("<")
            at = start + 1
    return root


def opened(here: Node, name: str, attributes: dict[str, str]) -> Node:
    """Add an element, after closing those that it ends."""
    if name in ("html", "body", "head"):
        top, inside = here, name == "html"
        while top.parent is not None:
            inside = inside or top.name == "body"
            top = top.parent
        if inside:
            return here
        here = top
    elif name in ENDS_P:
        scan = here
        while scan is not None and (scan.name not in BLOCK or scan.name == "p"):
            if scan.name == "p":
                here = scan.parent
                break
            scan = scan.parent
    if name in OWN_KIND:
        kinds, limits = OWN_KIND[name]
        scan = here
        while scan is not None and scan.name not in limits:
            if scan.name in kinds:
                here = scan.parent
                if name not in ("tr",) or scan.name == "tr":
                    break
            scan = scan.parent
    if name == "br":
        here.children.append(None)
    node = Node(name, here, unwanted(name, attributes), name in ("article", "main") or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody")
    here.children.append(node)
    return node


def closed(here: Node, name: str) -> Node:
    """The element that is open after an end tag; an end tag of text styling never closes a block."""
    scan = here
    if name in ("body", "html"):  # what follows still belongs to the page
        return here
    while scan.parent is not None:
        if scan.name == name:
            return scan.parent
        if name not in BLOCK and scan.name in BLOCK:
            return here
        scan = scan.parent
    return here


def measure(root: Node) -> tuple[Node, list[Node]]:
    """Fill in the counts, densities and sums; returns the body and all kept elements in page order."""
    order, stack, body = [], [(root, False)], root
    while stack:
        node, linked = stack.pop()
        order.append((node, linked))
        if node.name == "body" and body is root:
            body = node
        inside = linked or node.name == "a"
        stack += [(c, inside) for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    for node, linked in reversed(order):
        inside = linked or node.name == "a"
        for child in node.children:
            if isinstance(child, str):
                size = len(" ".join(child.split()))
                node.chars += size
                node.link_chars += size * inside
            elif child is not None and not child.dropped:
                node.chars += child.chars
                node.link_chars += child.link_chars
                node.tags += child.tags + 1
                node.link_tags += child.link_tags + (child.name == "a" or inside)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node, _ in order:
        node.density = density(node, share)
    for node, _ in order:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.dropped)
        if any(isinstance(c, str) and c.strip() for c in node.children):
            node.total += own_density(node)
    return body, [n for n, _ in order]


def density(node: Node, body_share: float) -> float:
    """Characters per tag, on a logarithm whose base grows with the share of link text."""
    if not node.chars:
        return 0.0
    tags, link_tags, links = max(1, node.tags), max(1, node.link_tags), max(1, node.link_chars)
    plain = max(1, node.chars - node.link_chars)
    base = math.log(node.chars / plain * node.link_chars + body_share * node.chars + math.e)
    weight = math.log(node.chars / links * tags / link_tags) / math.log(max(base, 1.0) + 1e-9) if base > 1.0 + 1e-9 else math.log(max(math.e, node.chars / links * tags / link_tags))
    return max(0.0, node.chars / tags * weight)


def own_density(node: Node) -> float:
    """Of the text that stands in a container itself."""
    own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
    return own / max(1, node.tags)


def main_nodes(body: Node, nodes: list[Node]) -> list[Node]:
    """The containers of the main text, in page order."""
    containers = [n for n in nodes if n.name in CONTAINER and n.chars]
    if not containers:
        return [body] if body.chars else []
    best = max(containers, key=lambda n: n.total)
    path, scan = [best], best
    while scan is not body and scan.parent is not None:
        scan = scan.parent
        path.append(scan)
    marked = [n for n in path if n.article]
    if marked:
        return [marked[-1]]
    threshold = min(n.density for n in path)
    for outer in path[1:]:  # neighbours that are as dense belong to the text
        beside = [c for c in outer.children if isinstance(c, Node) and not c.dropped and c not in path and c.chars and c.link_chars * 2 < c.chars]
        if any(c.density >= threshold for c in beside):
            best = outer
    return [best]


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below an element, white space turned into single spaces."""
    found, now = [], []

    def end():
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            found.append(text)

    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            now.append(item)
        elif item.name in BLOCK:
            end()
            stack.append(None)
            stack += [c for c in reversed(item.children) if not isinstance(c, Node) or not c.dropped]
        else:
            stack += [c for c in reversed(item.children) if not isinstance(c, Node) or not c.dropped]
    end()
    return found


def main_text(page: str) -> str:
    body, nodes = measure(parse(page))
    return "\n".join(text for node in main_nodes(body, nodes) for text in blocks(node))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points of every row."""

    def run(batches):
        for batch in batches:
            found = [main_text(value.decode()) if value else "" for value in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
