"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text. A linear classifier on a block's tags, names, length, links and
punctuation gives the cost of calling it content and of calling it boilerplate: the capacities to the
two terminals. Neighbouring blocks, and blocks that follow each other in one container, are tied
by smoothness edges; the closer they are in the tree, the stronger. The minimum cut, found by
maximum flow, labels all blocks of a page at once. Blocks whose own costs outweigh all their ties
are settled beforehand, which leaves the cut the same and the graph small.

Pages are independent: one pass, no shuffle, memory bounded by one page.

Defined results: null or empty html gives an empty text, as does a page without content. Broken
markup is read as far as it goes: an open script hides the rest, an open paragraph ends at the next
block, ``<`` before anything but a tag is text. Nothing is cut off, whatever the length.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_HIDDEN = {"script", "style", "noscript", "template", "title", "textarea", "select", "iframe", "svg", "math",
           "canvas", "object", "audio", "video", "button", "datalist"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div",
          "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "head", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary",
          "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An opening tag ends an open element of the same kind, up to the container named.
_IMPLIED = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
            "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_NAMED = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BAD = set("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo "
           "cookie cookies copyright disclaimer discussion disqus footer gdpr header legal login masthead menu modal nav "
           "navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted "
           "promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor "
           "sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split())
_GOOD = set("article articlebody body content entry main post story text".split())
#: Bad in front of a name as well (related-posts); the others count where they are what is named (site-footer).
_BAD_KIND = set("ad ads cookie gdpr newsletter promo promoted recommended related sponsor sponsored".split())
#: Words that say where or how something is, not what: what is named comes before them.
_PLACES = set("area bar block box bottom col column container group holder inner item items left links list outer panel "
              "region right row section slot top unit wrap wrapper".split())
#: What follows them is said of the thing, and is not the thing (has-sidebar, content-with-navigation).
_SAID = set("has have is no not show with without".split())
_CONTAINER = {"nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "dialog": -8.0, "menu": -8.0,
              "article": 3.0, "main": 3.0, "section": 0.3}
_TAG = {"p": 1.0, "h1": 1.5, "h2": 0.8, "h3": 0.6, "h4": 0.5, "h5": 0.3, "h6": 0.3, "blockquote": 1.0, "pre": 1.0,
        "figcaption": -0.3, "li": -0.3, "td": -0.3, "th": -0.3}
_BIAS, _OUTSIDE, _LINKED, _NEIGHBOUR, _SIBLING = -0.6, -2.0, -4.0, 0.3, 0.5


class _Element:
    """``best`` and ``worst`` are the highest and the lowest score on the way down to it, 0 at least and at most."""
    __slots__ = ("tag", "best", "worst", "inside", "depth", "parent")

    def __init__(self, tag: str, score: float, inside: bool, parent: "_Element | None"):
        self.tag, self.inside, self.parent = tag, inside, parent
        self.best = max(score, parent.best if parent else 0.0)
        self.worst = min(score, parent.worst if parent else 0.0)
        self.depth = parent.depth + 1 if parent else 0


class _Block:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: _Element):
        self.text, self.linked, self.element = text, linked, element


def name_score(names: str) -> float:
    """What the class names and ids of an element say: each good or bad name weighs against the others."""
    good = bad = 0
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        said = next((k for k, w in enumerate(words) if w in _SAID), len(words))
        words = words[:said]
        while len(words) > 1 and words[-1] in _PLACES:
            words.pop()
        if words and (words[-1] in _BAD or words[0] in _BAD_KIND):
            bad += 1
        elif words and words[-1] in _GOOD:
            good += 1
    return -7.0 if bad > good else 2.0 if good > bad else 0.0


def _opened(tag: str, attributes: str, parent: _Element) -> _Element:
    score, inside = _CONTAINER.get(tag, 0.0), parent.inside or tag in ("article", "main")
    if tag == "header":
        score = -1.0 if parent.inside else -8.0
    if attributes:
        if "=" in attributes:
            said = name_score(" ".join(n.strip("\"'") for n in _NAMED.findall(attributes)))
            score += max(said, 0.0) if tag in ("html", "body") else said
        if _UNSEEN.search(attributes):
            score -= 9.0
    return _Element(tag, score, inside, parent)


def blocks_of(page: str) -> list[_Block]:
    """Blocks of a page in order, with their text as shown."""
    root = _Element("", 0.0, False, None)
    stack, blocks = [root], []
    parts: list[str] = []
    links = linked = at = 0
    owner = root

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(_Block(text, min(linked, len(text)), owner))
            parts.clear()
        linked = 0

    def add(data: str) -> None:
        nonlocal owner, linked
        if data:
            if not parts:
                owner = stack[-1]
            parts.append(data)
            if links:
                linked += len(data.strip())

    while True:
        found = _TOKEN.search(page, at)
        add(page[at:found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in _BLOCK:
                close()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            continue
        if tag in _HIDDEN:
            if not found[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "br":
            add(" ")
        elif tag == "a":
            links = 1
        elif tag in _BLOCK:
            close()
            links = 0
            ends = _IMPLIED.get(tag, {"p"})
            while stack[-1].tag in ends:
                stack.pop()
            if tag not in _VOID:
                stack.append(_opened(tag, found[3], stack[-1]))
        elif found[3] and "=" in found[3] and tag not in _VOID and _UNSEEN.search(found[3]):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else at
    close()
    return blocks


def _evidence(block: _Block, framed: bool) -> float:
    """The classifier: positive for content."""
    element = block.element
    # The best and the worst of the way down count, each once.
    score = _BIAS + element.best + element.worst + _TAG.get(element.tag, 0.0)
    if framed and not element.inside:
        score += _OUTSIDE
    score += min(2.0, block.text.count(" ") / 20)
    score += 0.5 if block.text[-1] in ".!?…:;\"'”»)" else 0.0
    return score + _LINKED * block.linked / len(block.text)


def minimum_cut(costs: list[tuple[float, float]], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True for the first terminal) of least total cost.

    ``costs[v]`` is the price of the label True and of False; an edge costs its weight if its ends
    differ.
    """
    lean = [b - a for a, b in costs]  # what True saves
    near: list[dict[int, float]] = [{} for _ in costs]
    for (u, v), w in edges.items():
        near[u][v] = near[u].get(v, 0.0) + w
        near[v][u] = near[v].get(u, 0.0) + w
    label: list[bool | None] = [None] * len(costs)
    tied = [sum(n.values()) for n in near]
    ready = deque(range(len(costs)))
    while ready:  # settle what no labelling of the others can turn
        v = ready.popleft()
        if label[v] is not None or abs(lean[v]) < tied[v]:
            continue
        label[v] = lean[v] >= 0
        for u, w in near[v].items():
            if label[u] is None:
                lean[u] += w if label[v] else -w
                tied[u] -= w
                ready.append(u)
    rest = [v for v in range(len(costs)) if label[v] is None]
    if rest:
        for v, side in zip(rest, _flow_labels(rest, lean, near, label)):
            label[v] = side
    return [bool(x) for x in label]


def _flow_labels(rest: list[int], lean: list[float], near: list[dict[int, float]], label: list[bool | None]) -> list[bool]:
    """Maximum flow over shortest ways (Dinic) among the open nodes; True where the source still reaches."""
    place = {v: i for i, v in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    room: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for v in rest:
        i = place[v]
        for u, w in near[v].items():
            if label[u] is None:
                room[i][place[u]] = w
        if lean[v] > 0:
            room[source][i], room[i][source] = lean[v], 0.0
        elif lean[v] < 0:
            room[i][sink], room[sink][i] = -lean[v], 0.0
    least = 1e-9
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for u, w in room[v].items():
                if w > least and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if sink not in level:
            return [place[v] in level for v in rest]
        untried = [iter(list(r)) for r in room]
        way = [source]
        while way:
            v = way[-1]
            if v == sink:
                push = min(room[a][b] for a, b in zip(way, way[1:]))
                for a, b in zip(way, way[1:]):
                    room[a][b] -= push
                    room[b][a] = room[b].get(a, 0.0) + push
                full = next(k for k, (a, b) in enumerate(zip(way, way[1:])) if room[a][b] <= least)
                del way[full + 1:]
                continue
            for u in untried[v]:
                if room[v].get(u, 0.0) > least and level.get(u) == level[v] + 1:
                    way.append(u)
                    break
            else:
                way.pop()


def extract(page: str | None) -> str:
    """Main text of a page: its content blocks, two newlines between them."""
    blocks = blocks_of(page) if page else []
    framed = any(b.element.inside for b in blocks)
    costs = []
    for block in blocks:
        z = max(-30.0, min(30.0, _evidence(block, framed)))
        costs.append((log1p(exp(-z)), log1p(exp(z))))
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}  # the latest block in each container
    for v, block in enumerate(blocks):
        if v:
            edges[v - 1, v] = _NEIGHBOUR
        element, weight = block.element.parent, _SIBLING
        while element and weight > 0.1:  # ties halve with every step up the tree
            u = last.get(id(element))
            if u is not None:
                edges[u, v] = edges.get((u, v), 0.0) + weight
                last[id(element)] = v
                break
            last[id(element)] = v
            element, weight = element.parent, weight / 2
    return "\n\n".join(b.text for b, kept in zip(blocks, minimum_cut(costs, edges)) if kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [extract(page.as_py()) for page in batch.column("__html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__page"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["__page", "text", "n_chars"])


def extract_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """Every row without its html, with ``text`` and ``n_chars``; own columns of these names are replaced."""
    others = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    bare = pages.select(F.struct(*others).alias("__page"), F.col(page).alias("__html"))
    kind = bare.schema["__page"].dataType.simpleString()
    return bare.mapInArrow(_extracted, f"__page {kind}, text string, n_chars long").select("__page.*", "text", "n_chars")
