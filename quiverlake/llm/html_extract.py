"""Main-text extraction from HTML by minimum-cut labelling.

A page is cut into blocks of text. A fixed linear classifier gives each block a score from its own text, and each element whose name or attributes say what
it is for (an article, a menu, an advert, comments) a score of its own; the costs of calling a node content or boilerplate are the capacities of
its terminal edges. Smoothness edges tie a block to the innermost such element around it, to the block before it by how much of the DOM path
they share, and to the one before under the same parent. The minimum cut (a maximum flow) separates content from boilerplate.

No cost settles a label alone: costs of blocks lie between about -4.5 and 2, ties between 1 and 2.6. So a one-word paragraph is content in an article and a
fluent sentence is not in an advert, and a container goes the way of its blocks where these all speak against it. On a page of many nodes those whose
cost outweighs all their edges are settled first, which changes no minimum cut, and the flow runs on the rest.

Text of content blocks: character references decoded, white space turned into one space, trimmed, joined by newlines in page order.
Scripts, styles, titles, hidden parts and markup are never text. Broken markup is read as browsers do where that matters here: unclosed
elements end with their parent, a tag cut off at the end of the page is no text, comments and scripts that never end run to the end.

Defined cases: a null or empty page has the empty text; a page of text without any markup is one block; repeated rows give equal results;
null urls and ids pass through; very long pages and deep nesting are read whole, in time that grows with the page; kept columns that are named like a
result (text, n_chars) are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML's own element names, grouped by how they take part.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg math object canvas audio video select button".split())
ENDS_P = BLOCK - frozenset("body html head option optgroup".split())
#: An element that opens ends an open one of these, unless the third set comes between.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

# Words of class, id and role attributes that name parts other than the article.
OTHER_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner bottombar breadcrumb breadcrumbs byline-ads captcha comment comments commentlist consent "
    "contentinfo cookie cookies copyright disclaimer disqus complementary dialog dropdown feedback footer footnotes-ads form gdpr header login masthead menu menubar menus modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond "
    "search share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tagcloud teaser toc toolbar topbar tracking widget widgets alert".split()
)
ARTICLE_PARTS = frozenset("article articlebody body-text content entry main maintext post postbody story text".split())

OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""(?:[^>"']++|"[^"]*"|'[^']*')*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


#: How strongly an element that says what it is for holds its blocks, and how sure that is for each block it holds.
ARTICLE, CALLED_ARTICLE, OTHER, OUTSIDE = 2.6, 1.6, -2.6, -1.2
SURE = 0.8
HIDDEN = "hidden"


class Element:
    """mark: the innermost element at or above this one that says what it is for; says: what."""

    __slots__ = ("tag", "parent", "depth", "number", "says", "mark")

    def __init__(self, tag: str, parent: Element | None, says: float | str, number: int):
        self.tag, self.parent, self.number, self.says = tag, parent, number, says
        self.depth = parent.depth + 1 if parent else 0
        self.mark = self if says and not (parent and parent.mark and parent.mark.says == HIDDEN) else parent.mark if parent else None


def _says(tag: str, attributes: str, parent: Element | None) -> float | str:
    """What an element's name and attributes say about the text in it."""
    inside = parent.mark.says if parent and parent.mark else 0.0
    found = 0.0
    if tag in ("nav", "footer", "aside", "form", "menu", "dialog", "search") or tag == "header" and not (inside != HIDDEN and inside > 0):
        found = OTHER
    elif tag in ("article", "main"):
        found = ARTICLE
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role", "data-role", "aria-label"):
                words = {x.lower() for x in TOKEN.findall(value)} | {x.lower() for x in value.split()}
                if words & OTHER_PARTS and not (words & {"article", "main"} and words <= ARTICLE_PARTS | {"header"}):
                    found = OTHER
                elif words & ARTICLE_PARTS and not found:
                    found = CALLED_ARTICLE
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return HIDDEN
    return found


class Piece:
    """A block: its text, the characters inside links, the element that holds it."""

    __slots__ = ("raw", "linked", "holder")

    def __init__(self, holder: Element):
        self.raw: list[str] = []
        self.linked = 0
        self.holder = holder


def blocks_of(page: str) -> list[tuple[str, int, Element]]:
    """(text, linked characters, holder) of each block with text, in page order."""
    root = Element("#root", None, 0.0, 0)
    stack, out, piece = [root], [], Piece(root)
    at, n, number, anchors, odd_quotes = 0, len(page), 0, 0, 0
    places: dict[str, list[int]] = {}  # for each name the places in the stack where it is open

    def innermost(*names: str) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def flush() -> None:
        nonlocal piece
        if piece.raw:
            text = " ".join("".join(piece.raw).split())
            if text and not (piece.holder.mark and piece.holder.mark.says == HIDDEN):
                out.append((text, piece.linked, piece.holder))
        piece = Piece(stack[-1])

    def add(text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        piece.raw.append(text)
        if anchors:
            piece.linked += len(text.strip())

    def close(to: int) -> None:
        flush()
        while len(stack) > to:
            places[stack.pop().tag].pop()
        piece.holder = stack[-1]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        tag = OPEN.match(page, lt)
        if not tag:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                if lt + 1 < n:
                    add("<")
                at = lt + 1
            continue
        name = tag[2].lower()
        rest = REST.match(page, tag.end(), tag.end() + 65536) if odd_quotes < 100 else None
        end = rest.end() if rest else page.find(">", tag.end()) + 1
        odd_quotes += rest is None  # a page full of them is read without regard to quotes
        if not end:
            break  # a tag that never ends
        attributes, at = page[tag.end() : end - 1], end
        if tag[1]:
            if name == "a":
                anchors = max(0, anchors - 1)
            elif name in BLOCK:
                close(innermost(name)) if places.get(name) else flush()
            continue
        if name in RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(page, at)
            if stop is None:
                break
            past = page.find(">", stop.end())
            at = past + 1 if past >= 0 else n
            if name not in ("script", "style", "template", "title"):
                add(" ")
            continue
        if name == "br":
            add(" ")
        elif name == "a":
            anchors = 1
        elif name in BLOCK:
            if name in ENDS_P and innermost("p") > innermost("td", "th", "table", "button"):
                close(innermost("p"))
            if name in ENDED_BY:
                ended, between = ENDED_BY[name]
                border = innermost(*between)
                if innermost(*ended) > border:  # a row ends its open cell and the row around it
                    close(min(i for i in map(innermost, ended) if i > border))
            flush()
            if name not in VOID:
                number += 1
                parent = stack[-1]
                stack.append(Element(name, parent, _says(name, attributes, parent), number))
                places.setdefault(name, []).append(len(stack) - 1)
                piece.holder = stack[-1]
    flush()
    return out


def score_of(text: str, linked: int, holder: Element) -> float:
    """The classifier: positive for content. Its weights are fixed and its inputs are the text of this one block and its own tag."""
    n, words = len(text), text.count(" ") + 1
    score = min(1.3, 0.55 * math.log1p(words) - 1.4) - 2.0 * linked / n
    if holder.tag in ("p", "blockquote", "pre"):
        score += 0.3
    elif holder.tag in ("h1", "h2", "h3", "h4"):
        score += 0.2
    elif holder.tag == "li":
        score -= 0.3
    if words < 3 and holder.tag != "li":
        score -= 0.8  # as buttons and labels
    if text[-1] in ".!?…\"”»":
        score += 0.3
    if "©" in text or "All rights reserved" in text:
        score -= 2.0
    return score


def _shared(a: Element, b: Element) -> float:
    """Which part of the deeper of two DOM paths is shared, 0 to 1. For neighbours the walk is as long as the tags between them."""
    deep = max(a.depth, b.depth, 1)
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return (a.depth + 1) / (deep + 1)


def smoothness(holders: list[Element], weight: float = 0.8) -> dict[tuple[int, int], float]:
    """Edges of adjacent blocks, and of each block with the next under the same parent element; weak across the border of a marked element."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    alike = lambda i, j: 1.0 if holders[i].mark is holders[j].mark else 0.05
    for i, h in enumerate(holders):
        if i:
            near = _shared(holders[i - 1], h)
            edges[(i - 1, i)] = weight * near * near * alike(i - 1, i)
        parent = h.parent.number if h.parent else h.number
        j = last.get(parent)
        if j is not None:
            edges[(j, i)] = edges.get((j, i), 0.0) + weight / 2 * alike(j, i)
        last[parent] = i
    return edges


def graph_of(found: list[tuple[str, int, Element]]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Costs of all nodes, blocks first and then the elements that hold them, and the edges between them."""
    holders = [b[2] for b in found]
    scores, edges = [score_of(*b) for b in found], smoothness(holders)
    article = any(h.mark is not None and h.mark.says == ARTICLE for h in holders)
    nodes: dict[int, int] = {}
    for i, h in enumerate(holders):
        says = h.mark.says if h.mark is not None else OUTSIDE if article else 0.0
        if says:
            key = h.mark.number if h.mark is not None else -1
            if key not in nodes:
                nodes[key] = len(scores)
                scores.append(0.0)
            scores[nodes[key]] += SURE * says
            edges[(i, nodes[key])] = abs(says)
    return scores, edges


def minimum_cut(scores: list[float], edges: dict[tuple[int, int], float], settle_over: int = 256) -> list[bool]:
    """Which nodes are on the content side of a minimum cut of the terminal costs and the edges; ties go to boilerplate."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    lean, side = list(scores), [None] * n
    if n > settle_over:
        pull = [sum(x.values()) for x in near]
        todo = list(range(n))
        while todo:
            i = todo.pop()
            if side[i] is None and abs(lean[i]) > pull[i]:
                side[i] = lean[i] > 0
                for j, w in near[i].items():
                    if side[j] is None:
                        lean[j] += w if side[i] else -w
                        pull[j] -= w
                        todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        content = _content_side(rest, lean, near, side)
        for i in rest:
            side[i] = i in content
    return [bool(x) for x in side]


def _content_side(rest: list[int], lean: list[float], near: list[dict[int, float]], side: list) -> set[int]:
    """The unsettled nodes on the content side, by a maximum flow: level by level from the content terminal, blocking flows in each."""
    number = {i: x for x, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    to: list[list[int]] = [[] for _ in range(len(rest) + 2)]
    head, room = [], []

    def edge(a: int, b: int, there: float, back: float) -> None:
        to[a].append(len(head))
        head.append(b)
        room.append(there)
        to[b].append(len(head))
        head.append(a)
        room.append(back)

    for i in rest:
        x = number[i]
        if lean[i] > 0:
            edge(source, x, lean[i], 0.0)
        elif lean[i] < 0:
            edge(x, sink, -lean[i], 0.0)
        for j, w in near[i].items():
            if i < j and side[j] is None:
                edge(x, number[j], w, w)
    tiny = 1e-12
    while True:
        level = {source: 0}
        queue = [source]
        for x in queue:
            for e in to[x]:
                if room[e] > tiny and head[e] not in level:
                    level[head[e]] = level[x] + 1
                    queue.append(head[e])
        if sink not in level:
            return {rest[x] for x in level if x < source}
        tried = [0] * len(to)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                push = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                at = head[path[cut] ^ 1]
                del path[cut:]
            while tried[at] < len(to[at]):
                e = to[at][tried[at]]
                if room[e] > tiny and level.get(head[e], -1) == level[at] + 1:
                    break
                tried[at] += 1
            else:
                if at == source:
                    break
                at = head[path.pop() ^ 1]
                tried[at] += 1
                continue
            path.append(e)
            at = head[e]


def main_text(page: str | None) -> str:
    """The main text of a whole page."""
    found = blocks_of(page) if page else []
    if not found:
        return ""
    keep = minimum_cut(*graph_of(found))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=False) if k)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """keep columns, text string and n_chars long (code points), for each row of pages."""
    kept = [F.col(f"`{c}`") for c in keep if c.lower() not in ("text", "n_chars")]
    rows = pages.select(*kept, F.col(f"`{html_col}`").alias("__html"))

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*[f.name for f in batch.schema][:-1], "text", "n_chars"],
            )

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
