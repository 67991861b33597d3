"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each in a block (the innermost element that is not inline) with
its path of tags and classes from the root. Per path the length of the text outside links and its
punctuation are added up and divided by the path's blocks. Both ratios are smoothed over the paths in
page order and multiplied (fused); paths in an ``article`` or ``main`` element weigh more. This is
done on every page. A path is content where it has such text and its fused ratio reaches a share of
the page's spread. Of the other paths only what bridges content stays, and no lists of links: blocks
that are headings, items, cells or the like in the very container that content stands in, and
headings right before content.

Names of boilerplate (menus, headers, footers, adverts, forms, comments, ...) lower the fused score
of what stands in the element so named to a tenth. An element that holds most of the page's score
even so is no boilerplate, whatever its name; the others are left out before content is chosen.
Scripts, styles, controls and hidden elements never count.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revloom.llm.common import slices, text_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# No \d: digits of a class name belong to it.
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img script style noscript template".split()
)
NEVER = {"head", "button", "select", "object", "canvas"} | RAW
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
CONTENT = {"article", "main"}
# Words of classes, ids and roles that name what is not the article.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar side footer header masthead topbar cookie cookies consent gdpr notice notices "
    "alert popup modal overlay comment comments disqus reply replies respond share sharing social related recommended "
    "newsletter subscribe subscription login signup signin register search widget widgets pagination pager skip toolbar "
    "contentinfo complementary copyright legal toc tags hidden".split()
)
# Elements that end an open one of their kind, and where the search for it stops.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"div", "section", "center", "body", "html", "article", "main", ""}
KERNEL = 1  # paths to each side that a ratio is smoothed over
SHARE = 0.5  # of the standard deviation that a content path reaches
WEIGHT = 2.0  # of paths in an article or main element
LOWERED = 0.1  # weight of the score in an element that names boilerplate
LEAST_CHARS = 100  # outside links, for an element whose whole name is boilerplate to be content all the same


@dataclass(slots=True, eq=False)
class Element:
    """An element; its path is a number, one for each path of the page."""

    tag: str
    number: int
    path: int
    parent: Element | None
    dropped: bool = False
    content: bool = False
    link: bool = False
    named: int = 0  # 0, WEAK or STRONG
    suspect: Element | None = None  # the innermost named element, itself included
    block: Element = None  # the innermost element around it that is not inline
    place: Element = None  # the innermost container

    def __post_init__(self) -> None:
        up = self.parent
        if self.named:
            self.suspect = self
        elif up is not None:
            self.suspect = up.suspect
        self.block = up.block if up is not None and self.tag in INLINE else self
        self.place = self if up is None or self.tag in CONTAINERS or self.tag == "td" else up.place


@dataclass(slots=True)
class Block:
    """What stands in one element: characters outside and inside of links, and punctuation outside."""

    element: Element
    own: int = 0
    linked: int = 0
    marks: int = 0


@dataclass(slots=True)
class Page:
    """Text nodes in page order: (text, element, starts a block)."""

    nodes: list[tuple[str, Element, bool]] = field(default_factory=list)


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}


WEAK, STRONG = 1, 2


def _named(attrs: dict[str, str], names: set[str]) -> int:
    """How far classes, id and role name boilerplate: not, in part of a name, or by a whole name."""
    found = 0
    for name in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).split():
        parts = {w.lower() for w in NAME_PART.findall(name)}
        if parts & names:
            found = max(found, STRONG if parts <= names else WEAK)
    return found


def _is_dropped(tag: str, attrs: dict[str, str]) -> bool:
    if tag in CONTENT or tag in ("html", "body"):
        return False
    if tag in NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    style = attrs.get("style", "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style


def _names(tag: str, attrs: dict[str, str], parent: Element) -> int:
    if tag in CONTENT or tag in ("html", "body"):
        return 0
    if tag == "header" and parent.content:
        return _named(attrs, NAMES - {"header"})
    return STRONG if tag in BOILERPLATE else _named(attrs, NAMES) if attrs else 0


def read_page(source: str) -> Page:
    """Text nodes with their elements; open tags are closed as browsers do in the common cases."""
    page, count = Page(), 0
    top = Element("", 0, 0, None)
    paths: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    place, breaks = 0, True

    def text(piece: str) -> None:
        nonlocal breaks
        if piece:
            page.nodes.append((html.unescape(piece), top, breaks))
            breaks = False

    def leave(last: Element) -> None:
        nonlocal top
        while top is not last:
            opened[top.tag] -= 1
            top = top.parent
        opened[last.tag] -= 1
        top = last.parent

    position, size = 0, len(source)
    while position < size:
        m = TOKEN.search(source, position)
        if m is None:
            text(source[place:])
            break
        tag = m["tag"] or m["tag2"]
        text(source[place : m.start()])
        place = position = m.end()
        if tag is None:
            continue
        tag = tag.lower()
        end = bool(m["end"] or m["end2"])
        if tag not in INLINE:
            breaks = True
        if end:
            if opened[tag]:
                found = top
                while found.tag != tag:
                    found = found.parent
                leave(found)
            continue
        if tag in VOID:
            continue
        rest = m["rest"] or m["rest2"] or ""
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, position)
            if not rest.endswith("/") or tag in ("script", "style"):
                place = position = close.end() if close else size
            continue
        closing = CLOSES.get(tag, {"p"} if tag in ENDS_PARAGRAPH else set())
        if tag in ENDS_PARAGRAPH:
            closing = closing | {"p"}
        if any(opened[t] for t in closing):
            found, stops = top, STOPS.get(tag, {"body", "article", "main", "section", "div", "table", "td", "li"} - closing)
            while found.parent is not None and found.tag not in closing and found.tag not in stops:
                found = found.parent
            if found.parent is not None and found.tag in closing:
                leave(found)
        if rest.endswith("/") and tag in ("svg", "math"):
            continue
        attrs = _attributes(rest) if rest else {}
        count += 1
        kind = tag + "".join(f".{c}" for c in attrs.get("class", "").split())
        path = paths.setdefault((top.path, kind), len(paths) + 1)
        opened[tag] += 1
        top = Element(
            tag, count, path, top, top.dropped or _is_dropped(tag, attrs), top.content or tag in CONTENT,
            top.link or tag == "a", _names(tag, attrs, top),
        )
    return page


def _blocks(nodes: list[tuple[str, Element, bool]]) -> dict[int, Block]:
    """Blocks by the number of their element, in page order."""
    blocks: dict[int, Block] = {}
    for text, element, _ in nodes:
        own = element.block
        block = blocks.get(own.number) or blocks.setdefault(own.number, Block(own))
        n = len(text.strip())
        if element.link:
            block.linked += n
        else:
            block.own += n
            block.marks += len(PUNCTUATION.findall(text))
    return blocks


def _path_scores(blocks: dict[int, Block]) -> dict[int, float]:
    """Fused, smoothed and weighted ratio of every path."""
    length: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    count: dict[int, int] = defaultdict(int)
    weight: dict[int, float] = {}
    for block in blocks.values():
        path = block.element.path
        length[path] += block.own
        marks[path] += block.marks
        count[path] += 1
        weight[path] = WEIGHT if block.element.content else 1.0
    paths = list(count)  # in page order
    text_ratio = _smooth([length[p] / count[p] for p in paths])
    mark_ratio = _smooth([marks[p] / count[p] for p in paths])
    return {p: weight[p] * t * (1.0 + m) for p, t, m in zip(paths, text_ratio, mark_ratio)}


def _content_paths(blocks: dict[int, Block]) -> set[int]:
    """Paths with text outside links whose score reaches the threshold; all paths where links are all there is."""
    scores = _path_scores(blocks)
    worded = {b.element.path for b in blocks.values() if b.own}
    if not worded:
        return set(scores)
    mean = sum(scores.values()) / len(scores)
    spread = math.sqrt(sum((v - mean) ** 2 for v in scores.values()) / len(scores))
    least = min(SHARE * spread, max(scores[p] for p in worded))
    return {p for p in worded if scores[p] >= least}


def _smooth(values: list[float]) -> list[float]:
    """A Gaussian kernel over neighbours in page order."""
    weight = [math.exp(-0.5 * (k / KERNEL) ** 2 * 4) for k in range(-KERNEL, KERNEL + 1)]
    out = []
    for i in range(len(values)):
        near = [(values[i + k], weight[k + KERNEL]) for k in range(-KERNEL, KERNEL + 1) if 0 <= i + k < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def _kept(blocks: dict[int, Block]) -> set[int]:
    """Numbers of the blocks of content paths and of those that bridge them."""
    chosen = _content_paths(blocks)
    kept = {k for k, b in blocks.items() if b.element.path in chosen}
    around: set[int] = set()  # every element that holds content
    places: set[int] = set()  # the containers that content stands in
    for k in kept:
        e = blocks[k].element
        places.add(e.place.number)
        while e is not None and e.number not in around:
            around.add(e.number)
            e = e.parent
    bridges: set[int] = set()
    holder: dict[int, Element] = {}  # the container, or what holds content, around an element
    heads = False  # what follows is content
    for k in reversed(blocks):
        if k in kept:
            heads = True
            continue
        block = blocks[k]
        e = block.element
        heading = e.tag in HEADINGS
        if block.linked <= block.own:
            # Cells of a table without content of its own are part of what is around it.
            climbed = []
            while e.number not in holder and e.tag not in CONTAINERS and e.number not in around:
                climbed.append(e.number)
                e = e.parent
            e = holder.get(e.number, e)
            holder.update(dict.fromkeys(climbed, e))
            if e.number in places or (heading and heads):
                bridges.add(k)
        heads = heads and heading
    return kept | bridges


def _left_out(nodes: list[tuple[str, Element, bool]]) -> set[int]:
    """Numbers of the named elements that do not hold most of the page's lowered score, and of those inside."""
    if all(e.suspect is None for _, e, _ in nodes):
        return set()
    blocks = _blocks(nodes)
    scores = _path_scores(blocks)
    clean = 0.0  # score of what stands in no named element
    own: dict[int, float] = defaultdict(float)
    chars: dict[int, int] = defaultdict(int)
    found: dict[int, Element] = {}
    for text, element, _ in nodes:
        block, named = blocks[element.block.number], element.suspect
        n = 0 if element.link else len(text.strip())
        score = scores[block.element.path] * n / block.own if n else 0.0
        if named is None:
            clean += score
            continue
        own[named.number] += score
        chars[named.number] += n
        while named is not None and named.number not in found:
            found[named.number] = named
            named = named.parent.suspect
    total, inside = dict(own), defaultdict(list)
    for k in sorted(found, reverse=True):  # what is inside has a larger number
        around = found[k].parent.suspect
        total.setdefault(k, 0.0)
        if around is not None:
            inside[around.number].append(k)
            total[around.number] = total.get(around.number, 0.0) + total[k]
            chars[around.number] += chars[k]
    outer = [(-total[k], k) for k, e in found.items() if e.parent.suspect is None]
    heapq.heapify(outer)
    lowered, left = LOWERED * -sum(t for t, _ in outer), set()
    while outer:
        score, k = heapq.heappop(outer)
        enough = found[k].named == WEAK or chars[k] >= LEAST_CHARS
        if enough and -LOWERED * score > (clean + lowered) / 2:
            clean += own.get(k, 0.0)
            lowered += LOWERED * (sum(total[c] for c in inside[k]) + score)
            for c in inside[k]:
                heapq.heappush(outer, (-total[c], c))
        else:
            left.add(k)
    for k in sorted(found):
        around = found[k].parent.suspect
        if around is not None and around.number in left:
            left.add(k)
    return left


def main_text(source: str | None) -> str:
    """Main text of one page; empty if there is none."""
    if not source:
        return ""
    nodes = read_page(source).nodes
    usable = [x for x in nodes if not x[1].dropped and x[0].strip()]
    left = _left_out(usable)
    usable = [x for x in usable if x[1].suspect is None or x[1].suspect.number not in left]
    if not usable:
        return ""
    kept = _kept(_blocks(usable))
    out, gap = [], False
    for text, element, starts in nodes:
        gap = gap or starts
        out_of = element.dropped or (element.suspect is not None and element.suspect.number in left)
        if not out_of and element.block.number in kept:
            out.append(f"\n{text}" if gap else text)
            gap = False
    return " ".join("".join(out).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        texts = [main_text(x) for x in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page, from its whole source, without a shuffle.

    A null page or one without content gives an empty text. White space of a block is one space,
    blocks are joined by one space in page order. Rows are treated one by one: repeated rows, null
    ids and null urls stay, other columns are ignored, an empty table gives an empty one.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html")
    )
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
