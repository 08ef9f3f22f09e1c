"""Main text of HTML pages by tree scoring.

A tolerant scanner builds a tree of a page's elements.  Paragraphs pass points (one, one a comma, and up to three for length, discounted by
their own links) to all their ancestors: in full to the parent, half to the grandparent, a third of the depth beyond.  A container's points are
discounted by its link density, and the best one is kept; tags of articles give no points and only settle ties.

The kept container is widened to an ancestor where wanted parts beside it hold at least a fifth of its readable points, but not past an
``article`` or ``main`` around it.  Siblings go with it: those that score like it or read like text, headings right before it, and all wanted ones between.

Inside what is kept, navigation, page headers, footers, asides, notices, adverts, forms, scripts, styles and reader comments go; everything
else stays in page order.  Class and id names count as whole names (``ad``, ``cookie-banner``), not by their pieces
(``has-sidebar``, ``share-price``), and an element so named stays all the same where it holds most of the page's readable points.

Each page is one row; nothing is shuffled.  Memory per task: a slice of pages and the tree of one; time grows with the page's length.

Defined results: null or empty html gives empty text; a page cut off in the middle keeps what is there; a page without any
paragraph falls back to its body; a very long page is read whole, and comes alone in its slice; repeated rows come back once each; null ids and urls
pass through; ids are of any type; other columns are not read, whatever their names are.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblock import slices

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
DROPPED = frozenset("head nav footer aside script style noscript template iframe svg canvas object embed select button textarea title dialog menu input audio video xmp noembed noframes".split())
PARAGRAPH = frozenset("p pre blockquote td dd".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar note".split())
# Class and id names of what is not the article, and words that may stand beside them in one name.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies respond response responses".split())
DROPPED_NAMES = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs consent cookie cookies footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
BESIDE = frozenset("area articles bar block bottom box button buttons container content form inline inner item items left link links list main page posts reader readers right section site slot stories top unit user users wrapper".split())
# Names of what leads elsewhere, which say nothing of a heading, list or paragraph without links.
LEADING = frozenset("banner breadcrumb breadcrumbs menu nav navbar navigation pager pagination recommended related sidebar toolbar topbar".split())
STANDING = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote ul ol dl table".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|<([a-zA-Z/][^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PIECES = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A start tag ends an open element of these names first.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("html body table ul ol dl div section article td th".split())
#: Elements that hold text beside others; a run of text ends at each.
_CELLS = frozenset("br td th".split())


class Node:
    __slots__ = ("tag", "parent", "children", "unwanted", "leads", "points", "readable", "chars", "linked", "commas")

    def __init__(self, tag: str, parent: Node | None, unwanted: str):
        #: ``unwanted`` is empty, ``hard`` (by tag, role or style), ``name`` or ``comment`` (by class or id, or a form); ``leads``: by a name of ``LEADING`` alone.
        self.tag, self.parent, self.children, self.leads = tag, parent, [], unwanted == "leads"
        self.unwanted = "name" if self.leads else unwanted
        self.points = self.readable = 0.0
        self.chars = self.linked = self.commas = 0


def named(value: str) -> str:
    """``comment``, ``leads`` or ``name`` where one of the names in a class or id marks what is not the article, else empty."""
    for name in value.split():
        pieces = [x.lower() for x in _PIECES.findall(name) if not x.isdigit()]
        marks = [x for x in pieces if x in DROPPED_NAMES]
        if marks and all(x in DROPPED_NAMES or x in BESIDE for x in pieces):
            return "comment" if COMMENTS.intersection(marks) else "leads" if LEADING.issuperset(marks) else "name"
    return ""


def _unwanted(tag: str, attributes: str, inside_article: bool) -> str:
    if tag in DROPPED or tag == "header" and not inside_article:
        return "hard"
    mark = ""
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDING.search(value):
            return "hard"
        if name == "role" and value.lower() in DROPPED_ROLES:
            return "hard"
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            mark = mark or named(value)
    return mark or "name" * (tag == "form")


class _Open:
    """The open elements, with the places of each name, so that no tag walks the stack."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks, self.scopes = [root], {}, [], [0]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in BLOCK:
            self.blocks.append(at)
        if node.tag in _SCOPE:
            self.scopes.append(at)

    def last(self, tag: str) -> int:
        return places[-1] if (places := self.places.get(tag)) else 0

    def close(self, at: int) -> None:
        for node in reversed(self.stack[at:]):
            self.places[node.tag].pop()
        del self.stack[at:]
        for places in (self.blocks, self.scopes):
            while places and places[-1] >= at and places[-1] > 0:
                places.pop()


def tree(page: str) -> Node:
    """The elements of a page; text is kept as strings among the children."""
    root = Node("html", None, "")
    open_ = _Open(root)
    at = 0
    while (found := _TAG.search(page, at)) is not None:
        if found.start() > at:
            open_.stack[-1].children.append(page[at : found.start()])
        at = found.end()
        closing, tag, attributes, odd = found.groups()
        if odd is not None:  # a tag with an unmatched quote: its name still counts
            closing, tag, attributes = ("/" if odd.startswith("/") else ""), (re.match(r"/?([a-zA-Z0-9:-]*)", odd)[1]), ""
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            place = open_.last(tag)
            # A stray end tag of an inline element ends no block.
            if place and (tag in BLOCK or not open_.blocks or open_.blocks[-1] <= place):
                open_.close(place)
            continue
        if tag in ("html", "body"):
            if tag == "body" and len(open_.stack) > 1 and open_.stack[1].tag == "head":
                open_.close(1)
            continue
        if tag in BLOCK and (place := open_.last("p")) > open_.scopes[-1]:
            open_.close(place)
        if tag in _ENDS:
            # The element to end may be a scope itself (a cell): it counts as long as no other scope stands after it.
            place = max(map(open_.last, _ENDS[tag]))
            if place and place >= open_.scopes[-1]:
                open_.close(place)
                if tag == "tr" and (row := open_.last("tr")) > open_.scopes[-1]:
                    open_.close(row)
        inside = open_.last("article") or open_.last("main")
        node = Node(tag, open_.stack[-1], _unwanted(tag, attributes, bool(inside)))
        open_.stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (attributes or "").endswith("/"):
            open_.push(node)
    if at < len(page):
        open_.stack[-1].children.append(page[at:])
    return root


def _nodes(root: Node, skipped: tuple[str, ...]) -> list[Node]:
    """All elements outside those of the ``skipped`` marks, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and c.unwanted not in skipped]
    return out


def paragraph_points(chars: int, linked: int, commas: int) -> float:
    return (1 + commas + min(3, chars / 100)) * (1 - linked / chars)


def score(nodes: list[Node]) -> None:
    """``points`` that paragraphs pass to each node by depth, and ``readable``, the sum of those inside it."""
    for node in nodes:
        node.chars = node.linked = node.commas = 0
        node.points = node.readable = 0.0
    # One sum a node: at distance 1 points count in full, at 2 by half, then by a third of the distance.  ``far`` holds those sums
    # by distance, and a node of great depth passes on at most FAR of them.
    far: dict[Node, list[float]] = {}
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.commas += child.count(",")
                node.chars += 0 if child.isspace() else len(child)
        if node.tag == "a":
            node.linked = node.chars
        levels = far.pop(node, [])
        node.points = sum(x / (1, 2)[d] if d < 2 else x / (3 * d) for d, x in enumerate(levels))
        node.readable += sum(levels)
        if node.parent is None:
            continue
        own = paragraph_points(node.chars, node.linked, node.commas) if node.tag in PARAGRAPH and node.chars else 0.0
        passed = far.setdefault(node.parent, [])
        for d, x in enumerate([own, *levels]):
            d = min(d, FAR - 1)
            passed.extend([0.0] * (d + 1 - len(passed)))
            passed[d] += x
        node.parent.chars += node.chars
        node.parent.linked += node.linked
        node.parent.commas += node.commas


#: Distances told apart when points are passed up.
FAR = 12


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _settle_names(root: Node) -> None:
    """Elements that only a name marks, and forms, are wanted after all where they hold most of what can be read; comments, where nothing else can.

    A heading, list or paragraph without links is wanted although its name is one of what leads elsewhere.
    """
    marked = [n for n in _nodes(root, ("hard",)) if n.unwanted]
    if not marked:
        return
    score(_nodes(root, ("hard",)))
    whole = root.readable
    comments = 0.0
    todo = [root]
    while todo:
        node = todo.pop()
        if node.unwanted == "comment":
            comments += node.readable
        else:
            todo += [c for c in node.children if isinstance(c, Node) and c.unwanted != "hard"]
    for node in marked:
        if node.leads and node.tag in STANDING and node.chars and not node.linked:
            node.unwanted = ""
        elif node.unwanted == "name" and whole > comments and node.readable > (whole - comments) / 2 or node.unwanted == "comment" and whole > 0 and whole - comments <= 1e-9 and node.readable > whole / 2:
            node.unwanted = ""


def kept(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    _settle_names(root)
    nodes = _nodes(root, ("hard", "name", "comment"))
    score(nodes)
    worth = lambda n: n.points * (1 - _density(n))
    best = max(nodes, key=lambda n: (round(worth(n), 9), n.tag in ("article", "main")))
    if best.points <= 0:
        return [root]
    top = node = best
    while node.parent is not None and node.tag not in ("article", "main"):
        others = [c for c in node.parent.children if isinstance(c, Node) and not c.unwanted and c is not node and _density(c) < 0.5]
        if sum(c.readable for c in others) >= 0.2 * best.readable:
            top = node.parent
        node = node.parent
    best = top
    if best.parent is None or best.tag == "main":
        return [best]
    beside = [c for c in best.parent.children if isinstance(c, Node) and not c.unwanted]
    if best.tag == "article":  # the text may be in several, with nothing but their like between them
        return [c for c in beside if c is best or c.tag == "article" and worth(c) >= 0.2 * worth(best)]
    floor = max(10.0, 0.2 * worth(best))
    reads = lambda c: c.tag in PARAGRAPH and c.chars and _density(c) < 0.25 and (c.chars > 80 or c.linked == 0)
    like = lambda c: best.tag == "section" == c.tag and c.readable > 0 and not c.linked  # noqa: E731  a short section beside a long one
    chosen = [i for i, c in enumerate(beside) if c is best or worth(c) >= floor or reads(c) or like(c)]
    first, last = chosen[0], chosen[-1]
    while first and beside[first - 1].tag in HEADING:
        first -= 1
    return beside[first : last + 1]


def _link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "table", "dl") and node.chars > 0 and _density(node) > 0.8


def _blocks(chosen: list[Node]) -> Iterator[str]:
    """Texts of blocks, before white space is folded."""
    run: list[str] = []
    todo: list = list(reversed(chosen))
    # Where the whole page is the container, lists of links before its first text and after its last are menus.
    bare = len(chosen) == 1 and chosen[0].parent is None
    menus: set[Node] = set()
    if bare:
        inside = [c for c in chosen[0].children if isinstance(c, Node) and not c.unwanted]
        for side in (inside, list(reversed(inside))):
            for c in side:
                if c.readable > 0 and not _link_list(c) or c.tag in PARAGRAPH and c.chars:
                    break
                if _link_list(c):
                    menus.add(c)
    while todo:
        item = todo.pop()
        if item is None:
            yield "".join(run)
            run = []
        elif isinstance(item, str):
            run.append(entities.unescape(item))
        elif item.unwanted or item in menus:
            if item.tag in BLOCK:
                todo.append(None)
        else:
            if item.tag in _CELLS:
                run.append(" ")
            inside = item.children
            if item.tag == "header":  # an article's own header: its bare text, dates and names, is no text of the article
                inside = [c for c in inside if isinstance(c, Node) and c.tag in BLOCK]
            ends = [None] if item.tag in BLOCK else []
            todo += ends + list(reversed(inside)) + ends
    yield "".join(run)


def main_text(page: str | None) -> str:
    """The article's blocks, joined by blank lines."""
    if not page:
        return ""
    return "\n\n".join(x for x in (" ".join(b.split()) for b in _blocks(kept(tree(page)))) if x)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    columns = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return columns.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
