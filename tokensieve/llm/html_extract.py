"""Main text of web pages, by minimum-cut labelling of their blocks.

A page becomes a row of text blocks. A hand-set linear classifier scores each
block from its elements' kinds and names, link share and words; the score gives the cost of
calling it boilerplate (capacity from the source) or content (capacity to the
sink). Edges between neighbouring blocks, weaker the further apart they stand
in the element tree, and between blocks of one parent make labels smooth. The
minimum cut is the cheapest labelling; blocks on the source's side are the text.

Tags are found in one pass forward, open elements are kept by kind, and blocks
whose label no neighbour can turn leave the graph before the flow is computed,
so that the time of a very long, deeply nested or broken page is about in
proportion to its length.

Defined results: a null or empty page has the empty text; a repeated row has a row
each; an empty table gives no rows; of several minimum cuts the one with the least
text counts. Very long pages are read whole. Only the three columns named are read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPENS = re.compile(r"<!--|<(?=/?[a-zA-Z!?])")
NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
ATTRS = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTR = re.compile(r"(?<![\w:-])([\w:-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[a-z0-9]+")
#: Character references by number: zeros in front, and numbers beyond any character.
ZEROS = re.compile(r"&#0+(?=[0-9])")
BEYOND = re.compile(r"&#[0-9]{8,};?")
#: Elements that HTML lays out as blocks, never closes, and whose content is not text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Evidence of an element by its kind, and by the words of its class, id and role.
KIND = {"article": 4.0, "main": 3.0, "nav": -9.0, "aside": -9.0, "footer": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0,
        "button": -9.0, "select": -9.0, "fieldset": -9.0, "head": -9.0, "address": -2.0}
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation "
    "menu menus breadcrumb breadcrumbs sidebar sidebars aside rail footer foot masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices alert popup modal overlay comment comments commentlist disqus respond reply replies related recommended share sharing social follow "
    "subscribe newsletter signup login form search searchbox widget widgets pager pagination tags taglist copyright legal disclaimer skip "
    "complementary contentinfo navigation dialog hidden".split())
#: Words of elements that wrap a page: they name what the page has.
WRAPPER = frozenset("has with layout site".split())
FOR = frozenset("article articlebody content post entry story maincontent main text body bodytext prose".split())


class Block:
    __slots__ = ("parts", "linked", "score", "place", "tag", "text")

    def __init__(self, score: float, place: "Place", tag: str):
        self.parts: list[str] = []
        self.linked, self.score, self.place, self.tag, self.text = 0, score, place, tag, ""


class Place:
    """A layout element of the page's tree."""
    __slots__ = ("parent", "depth")

    def __init__(self, parent: "Place | None"):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" of a closing tag, name, attributes) of each tag and
    comment, the name empty where it has none. An element whose content is not
    text ends behind its closing tag. A ``>`` in quotes does not end a tag,
    unless no other does."""
    last, at = page.rfind(">"), 0
    ends: dict[int, int] | None = None
    marks: list[int] = []
    while m := OPENS.search(page, at):
        start = m.start()
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", "", ""
            continue
        if start > last:  # nothing ends a tag any more; a comment may still come
            at = page.find("<!--", start)
            if at < 0:
                return
            continue
        name = NAME.match(page, start)
        end = -1
        if name:
            if ends is None:
                whole = ATTRS.match(page, name.end())
                end = whole.end() if whole else -1
                if not whole:  # a quote stays open: find all ends at once
                    ends, marks = _ends(page)
            else:
                k = bisect_left(marks, name.end())
                end = ends[marks[k]] if k < len(marks) else -1
        if end >= 0:
            at, closing, attrs = end, "/" if page[start + 1] == "/" else "", page[name.end():end - 1]
            if not closing and name[1].lower() in RAW and not attrs.rstrip().endswith("/"):
                m = re.compile(rf"</{re.escape(name[1])}\b", re.I).search(page, at)
                at = (m and page.find(">", m.end()) + 1) or len(page)
            yield start, at, closing, name[1], attrs
        else:
            at = page.find(">", start) + 1
            yield start, at, "", "", ""


def _ends(page: str) -> tuple[dict[int, int], list[int]]:
    """Where a tag ends, by the first quote or ``>`` after its name, or -1;
    and the places of these in order."""
    marks = [m.start() for m in re.finditer(r"[>\"']", page)]
    ends: dict[int, int] = {}
    after = {}  # the next mark of each kind, and the mark that follows that one
    following = -1
    for p in reversed(marks):
        kind = page[p]
        if kind == ">":
            ends[p] = p + 1
        else:
            closing = after.get(kind)
            ends[p] = -1 if closing is None or closing < 0 else ends[closing]
            after[kind] = following
        following = p
    return ends, marks


def _evidence(tag: str, attrs: str, good: float, bad: float) -> tuple[float, float]:
    """What an element's place says so far: best for, worst against."""
    own = KIND.get(tag, 0.0)
    if tag == "header" and good <= 0:
        own = -6.0
    if attrs:
        words = set()
        for name, *values in ATTR.findall(attrs):
            name = name.lower()
            if name in ("class", "id", "role"):
                words.update(WORD.findall("".join(values).lower()))
            elif name == "aria-hidden" and "true" in values or name == "style" and "display:none" in "".join(values).replace(" ", ""):
                own = min(own, -9.0)
        if tag not in ("html", "body") and words & AGAINST and not words & WRAPPER:
            own = min(own, -9.0)
        elif words & FOR and own >= 0:
            own = max(own, 2.5)
    return max(good, own), min(bad, own)


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    # an open element: tag, best evidence for, worst against
    stack: list[tuple[str, float, float]] = [("", 0.0, 0.0)]
    # where in the stack the open elements of a tag stand, and the layout elements with their places in the tree
    held: dict[str, list[int]] = {}
    layout: list[tuple[int, Place]] = [(0, Place(None))]
    open_block: Block | None = None
    at = 0

    def add(text: str) -> None:
        nonlocal open_block
        if open_block is None:
            if not text.strip():
                return
            _, good, bad = stack[-1]
            k, place = layout[-1]
            open_block = Block(good + bad, place, stack[k][0])
            out.append(open_block)
        open_block.parts.append(text)
        if held.get("a"):
            open_block.linked += len(text)

    def close(upto: int) -> None:
        while len(stack) > upto:
            held[stack.pop()[0]].pop()
            if layout[-1][0] == len(stack):
                layout.pop()

    for start, end, closing, name, attrs in tags(page):
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            continue
        tag = name.lower()
        if tag in BLOCK:
            open_block = None
        if closing:
            # a closing inline tag does not reach out of its block
            if held.get(tag) and (tag in BLOCK or held[tag][-1] >= layout[-1][0]):
                close(held[tag][-1])
            continue
        if tag == "br":
            if open_block:
                open_block.parts.append(" ")
            continue
        if tag in VOID or tag in RAW or attrs.endswith("/"):
            continue
        if tag in BLOCK:  # opens where a paragraph or item of its kind is left open
            implied = ("p", tag) if tag in ("li", "dt", "dd", "td", "th", "tr", "option") else ("p",)
            if layout[-1][0] and stack[layout[-1][0]][0] in implied:
                close(layout[-1][0])
            layout.append((len(stack), Place(layout[-1][1])))
        held.setdefault(tag, []).append(len(stack))
        stack.append((tag, *_evidence(tag, attrs, *stack[-1][1:])))
    if at < len(page):
        add(page[at:])
    for b in out:
        b.text = " ".join(html.unescape(BEYOND.sub("\ufffd", ZEROS.sub("&#", "".join(b.parts)))).split())
    return [b for b in out if b.text]


def scores(found: list[Block]) -> list[float]:
    """Evidence that each block is content; negative is against."""
    anchored = any(b.score >= 2 for b in found)
    out = []
    for b in found:
        words = b.text.count(" ") + 1
        share = min(1.0, b.linked / max(1, len(b.text)))
        s = b.score + 0.5 * math.log(words) - 3.5 * share + (0.5 if b.tag == "p" or b.tag in HEADING else 0.0)
        s += 0.5 if b.text[-1] in ".!?…\"”»" else 0.0
        out.append(s - (1.5 if anchored else 1.0))
    return out


def _apart(a: Place, b: Place) -> int:
    """Steps between two places of the tree."""
    steps = 0
    while a is not b:
        if a.depth < b.depth:
            a, b = b, a
        a, steps = a.parent, steps + 1
    return steps


def smooth_edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """(block, block, weight): neighbours in the page and in the tree."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, 1.0 / (1 + _apart(found[i - 1].place, b.place))))
        parent = b.place.parent or b.place
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, 0.3))
        last[parent] = i
    return out


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut (nodes that no
    residual path from the source reaches are on the other side)."""
    n = len(source)
    # what flows straight through a node is settled at once
    need = [a - b for a, b in zip(source, sink)]
    to: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        to[a][b] = to[a].get(b, 0) + w
        to[b][a] = to[b].get(a, 0) + w
    # a node that needs more than its edges hold keeps its side; its edges become needs of its neighbours
    side: list[bool | None] = [None] * n
    room = [sum(x.values()) for x in to]
    sure = [i for i in range(n) if need[i] > room[i] or need[i] <= -room[i]]
    while sure:
        i = sure.pop()
        if side[i] is not None:
            continue
        side[i] = need[i] > 0
        for j, w in to[i].items():
            if side[j] is None:
                del to[j][i]
                room[j] -= w
                need[j] += w if side[i] else -w
                if need[j] > room[j] or need[j] <= -room[j]:
                    sure.append(j)
    left = [i for i in range(n) if side[i] is None]
    while True:  # one phase: all shortest paths from needs above zero to needs below
        level = {i: 0 for i in left if need[i] > 0}
        front, ends = list(level), False
        while front and not ends:
            reached = []
            for i in front:
                for j, w in to[i].items():
                    if w > 0 and j not in level:
                        level[j] = level[i] + 1
                        ends |= need[j] < 0
                        reached.append(j)
            front = reached
        if not ends:
            for i in left:
                side[i] = i in level
            return side
        arcs = {i: list(to[i]) for i in level}
        tried = dict.fromkeys(level, 0)
        for first in [i for i in level if level[i] == 0]:
            path = [first]
            while path and need[first] > 0:
                i = path[-1]
                if need[i] < 0:
                    steps = list(zip(path, path[1:]))
                    flow = min(need[first], -need[i], *(to[a][b] for a, b in steps))
                    need[first] -= flow
                    need[i] += flow
                    for a, b in steps:
                        to[a][b] -= flow
                        to[b][a] += flow
                    # go on from the last node before an edge that is full
                    path = path[:next((k for k, (a, b) in enumerate(steps) if to[a][b] == 0), len(steps)) + 1]
                    continue
                while tried[i] < len(arcs[i]):
                    j = arcs[i][tried[i]]
                    if level.get(j) == level[i] + 1 and to[i][j] > 0:
                        path.append(j)
                        break
                    tried[i] += 1
                else:
                    path.pop()
                    if path:
                        tried[path[-1]] += 1


def main_text(page: str) -> str:
    found = blocks(page)
    if not found:
        return ""
    unit = 1000
    costs = [(math.log1p(math.exp(min(s, 30.0))), math.log1p(math.exp(min(-s, 30.0)))) for s in scores(found)]
    side = minimum_cut([round(unit * a) for a, _ in costs], [round(unit * b) for _, b in costs],
                       [(i, j, round(unit * w)) for i, j, w in smooth_edges(found)])
    return "\n".join(b.text for b, content in zip(found, side) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "") for p in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                  ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
