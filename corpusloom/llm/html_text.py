"""Main text of web pages by minimum-cut labelling.

Each text block of a page is a node. A logistic classifier looks at the block alone: its length, its links, its
element, how it ends. It is fitted on a bounded sample of the pages themselves, where the elements around a block tell
what it is: article and main elements against navigation, footers, notices and the like. Its log-odds and what the
elements around say become a pair of terminal capacities, the cost of calling the block boilerplate and the cost of
calling it content. Blocks that follow each other, and blocks that follow each other under the same element, are
joined by smoothness edges as dear as a middling opinion, the dearer the closer they are in the DOM. The minimum
cut then labels all blocks of the page at once, so that a short or linked block among content stays, and a long one among
boilerplate goes.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of the HTML standard by the part they play here.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea noscript template iframe noembed noframes xmp svg math title".split())
NEVER_TEXT = set("head nav footer aside form button select option datalist dialog menu object audio video canvas".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Words in class names, ids and roles that tell what an element is for.
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline copyright cookie cookies consent contentinfo "
    "foot footer gdpr header headerbar login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall "
    "popup popover promo promoted promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar topbar widget widgets complementary alert".split()
)
COMMENTS = set("comment comments commentlist disqus discussion replies respond reply reviews".split())
CONTENT = set("article articlebody body content entry main maintext post story text".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">]++)*+(?:["'][^>]*+)?)(?:>|\Z)|[^<]++|<""", re.S
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")
LOCKED = -9.0
ARTICLE, CONTAINER = 5.0, 3.0  # what an article element, or one with a name of CONTENT, adds to the log-odds
SMOOTH = 3.0


@dataclass
class Block:
    parent: int  # the element it lies in
    tag: str
    bias: float  # what the elements around it say
    around: int = 0  # the element that the one it lies in lies in
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _names(attributes: str) -> tuple[set[str], bool]:
    words, hidden = set(), False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("hidden", "aria-hidden"):
            hidden |= value != "false"
        else:
            words.update(NAME.findall(value))
    return words, hidden


def _bias(around: float, tag: str, attributes: str) -> float:
    """What is known of an element's text, from its surroundings and its own name; below zero: boilerplate."""
    if around == LOCKED or tag in NEVER_TEXT:
        return LOCKED
    words, hidden = _names(attributes) if attributes else (set(), False)
    if hidden:
        return LOCKED
    if tag in ("html", "body"):
        return around
    if words & COMMENTS:
        return LOCKED
    if tag in ("article", "main") or "main" in words:
        return ARTICLE
    if tag == "header" and around <= 0:
        return LOCKED
    if words & BOILERPLATE and tag not in INLINE:
        return -6.0
    if words & CONTENT and around >= 0:
        return max(around, CONTAINER)
    return around


class Open:
    """The elements that are open, with what is asked of them known without going through them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, float]] = [("", 0, 0.0)]  # name, number, bias
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]  # places of those that are not inline

    def push(self, tag: str, number: int, bias: float) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, number, bias))

    def last(self, tag: str) -> int | None:
        at = self.places.get(tag)
        return at[-1] if at else None

    def close(self, at: int) -> None:
        """Closes the element at this place and all within it."""
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()
        while self.blocks[-1] >= at:
            self.blocks.pop()

    @property
    def linked(self) -> bool:
        return bool(self.places.get("a"))


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, with the DOM position and the hints of each."""
    found: list[Block] = []
    opened = Open()
    numbers, current, raw = 0, None, None
    for m in TOKEN.finditer(page):
        tag = m[2]
        if raw is not None:  # until its end tag, all is raw text
            if tag and m[1] and tag.lower() == raw:
                raw = None
            continue
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                if current is None:
                    name, number, _ = opened.stack[opened.blocks[-1]]
                    outer = opened.stack[opened.blocks[-2]][1] if len(opened.blocks) > 1 else -1
                    current = Block(number, name, opened.stack[-1][2], outer)
                    found.append(current)
                current.parts.append(m[0])
                if opened.linked:
                    current.linked += len(m[0])
            elif m[0].startswith("<![CDATA[") and current is not None:
                current.parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if not inline:
            if tag == "br":
                if current is not None:
                    current.parts.append(" ")
                continue
            current = None
        if m[1]:
            at = opened.last(tag)
            if at is not None and (not inline or opened.blocks[-1] < at):
                opened.close(at)
            continue
        if tag in RAW:
            raw = tag if not m[3].endswith("/") else None
            continue
        if tag in CLOSES_P:
            if (at := opened.last("p")) is not None:
                opened.close(at)
        elif tag in ("li", "td", "th", "tr", "dt", "dd", "option") and opened.stack[-1][0] == tag:
            opened.close(len(opened.stack) - 1)
        if tag in VOID or m[3].endswith("/"):
            continue
        numbers += 1
        opened.push(tag, numbers, _bias(opened.stack[-1][2], tag, m[3]))
    for b in found:
        b.text = BLANK.sub(" ", html.unescape("".join(b.parts))).strip()
    return [b for b in found if b.text]


def features(b: Block) -> tuple[float, ...]:
    """What the classifier knows of a block: nothing of the elements around it."""
    size = len(b.text)
    return (
        1.0, math.log2((size + 1) / 60), min(1.0, b.linked / size), float(b.text[-1] in ".!?:;\"'”»)"), float(b.tag == "li"),
        float(b.tag in ("p", "pre", "blockquote")), float(b.tag in ("h1", "h2", "h3")),
    )


#: Weights for the features above where there is nothing to learn from.
UNTAUGHT = (-0.3, 0.8, -4.0, 1.0, -0.5, 1.0, 1.0)


def taught(examples: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> tuple[float, ...]:
    """Weights by logistic regression (Newton's method) from rows of label and features; pulled towards UNTAUGHT."""
    start = np.array(UNTAUGHT)
    if len(examples) == 0 or len(set(examples[:, 0])) < 2:
        return UNTAUGHT
    y, x = examples[:, 0], examples[:, 1:]
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both labels weigh the same
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (balance * (p - y)) + ridge * (w - start)
        curve = (x * (balance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def examples_of(page: str | None) -> list[tuple[float, ...]]:
    """Label (1: content) and features of the blocks of a page whose surroundings tell what they are."""
    return [(float(b.bias > 0), *features(b)) for b in blocks_of(page or "") if b.bias != 0]


def costs(b: Block, weights: tuple[float, ...] = UNTAUGHT, most: float = 5.0) -> tuple[float, float]:
    """The cost of calling a block boilerplate, and that of calling it content; the classifier's part is ``most`` at most."""
    if b.bias == LOCKED:
        return 0.0, 1e6
    opinion = sum(w * x for w, x in zip(weights, features(b), strict=True))
    score = b.bias + min(max(opinion, -most), most)
    return max(score, 0.0), max(-score, 0.0)


def minimum_cut(source: list[float], sink: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """For each node, whether it stays on the source's side of a minimum cut.

    Blocking flows along levels: nodes with something left push it along edges that lead one level nearer to those with
    a need, each edge being left behind once nothing goes through it.
    """
    n, tiny = len(source), 1e-9
    excess = [a - b for a, b in zip(source, sink, strict=True)]  # what goes straight through is pushed at once
    around: list[list[int]] = [[] for _ in range(n)]
    room: list[float] = []
    ends: list[int] = []
    for (i, j), w in edges.items():
        for a, b in ((i, j), (j, i)):
            around[a].append(len(ends))
            ends.append(b)
            room.append(w)
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] > tiny)
        for i in queue:
            level[i] = 0
        needed = False
        while queue:
            i = queue.popleft()
            needed |= excess[i] < -tiny
            for e in around[i]:
                if room[e] > tiny and level[ends[e]] < 0:
                    level[ends[e]] = level[i] + 1
                    queue.append(ends[e])
        if not needed:
            return [x >= 0 for x in level]
        at = [0] * n
        for start in [i for i in range(n) if level[i] == 0]:
            path: list[int] = []  # edges from start on
            i = start
            while excess[start] > tiny:
                if excess[i] < -tiny:
                    push = min(excess[start], -excess[i], *(room[e] for e in path))
                    excess[start] -= push
                    excess[i] += push
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    path, i = [], start
                    continue
                while at[i] < len(around[i]) and not (room[e := around[i][at[i]]] > tiny and level[ends[e]] == level[i] + 1):
                    at[i] += 1
                if at[i] < len(around[i]):
                    path.append(around[i][at[i]])
                    i = ends[path[-1]]
                elif path:
                    i = ends[path.pop() ^ 1]
                    at[i] += 1
                else:
                    break


def smoothness(nodes: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between blocks that follow each other, in the page or under one element."""
    edges: dict[tuple[int, int], float] = {}
    previous: dict[int, int] = {}
    for k, b in enumerate(nodes):
        if k:
            a = nodes[k - 1]
            siblings = a.parent == b.parent or a.around == b.around
            near = 1.0 if siblings else 0.6 if a.parent == b.around or a.around == b.parent else 0.3
            edges[k - 1, k] = SMOOTH * near * (0.05 if a.bias != b.bias else 1.0)
        if (j := previous.get(b.parent)) is not None and j < k - 1:
            edges[j, k] = 0.5 * SMOOTH * (0.05 if nodes[j].bias != b.bias else 1.0)
        previous[b.parent] = k
    return edges


def main_text(page: str | None, weights: tuple[float, ...] = UNTAUGHT) -> str:
    """The blocks of a page that the cut leaves with the content, joined by line ends."""
    nodes = blocks_of(page or "")
    pairs = [costs(b, weights) for b in nodes]
    kept = minimum_cut([p[0] for p in pairs], [p[1] for p in pairs], smoothness(nodes))
    return "\n".join(b.text for b, keep in zip(nodes, kept, strict=True) if keep)


def learn(pages: DataFrame, html_col: str = "html", sample_pages: int = 1000, by: tuple[str, ...] = ()) -> tuple[float, ...]:
    """The classifier's weights from ``sample_pages`` pages, those first by a hash of html and the columns ``by``; the features
    of some tens of blocks a page come to the driver. Without any page that tells what its blocks are: UNTAUGHT.

    Only pages whose hash is in the share that holds some four times as many are put in order, so that no task gets
    more than those.
    """
    hashed = pages.select(F.col(html_col).cast("string").alias("html"), F.xxhash64(F.col(html_col), *by).alias("at")).where("html IS NOT NULL")
    total = pages.count()
    if total > 4 * sample_pages:
        hashed = hashed.where(F.pmod("at", F.lit(1 << 40)) < int((1 << 40) * 4 * sample_pages / total))
    sample = hashed.orderBy("at", "html").limit(sample_pages).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column("html").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(examples_of(page)[:1000], pa.list_(pa.float64()))], names=["e"])

    found = [r["e"] for r in sample.mapInArrow(run, "e array<double>").collect()]
    return taught(np.array(sorted(found)).reshape(len(found), len(UNTAUGHT) + 1))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sample_pages: int = 1000) -> DataFrame:
    """The columns of ``keep``, text (the main text, empty if there is none) and n_chars, for each page.

    The classifier is fitted on ``sample_pages`` pages at most, then every page is read whole. Null html counts as empty;
    broken markup is read as far as it goes; repeated rows are extracted one by one; other columns are ignored.
    """
    weights = learn(pages, html_col, sample_pages, keep)
    own = "page"
    while own in keep:
        own += "_"
    narrow = pages.select(*keep, F.col(html_col).cast("string").alias(own))
    fields = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(len(keep))
            for start in range(0, len(raw), 256):
                texts = pa.array([main_text(x, weights) for x in raw.slice(start, 256).to_pylist()], pa.string())
                columns = [batch.column(k).slice(start, len(texts)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, texts], names=[*keep, "text"])

    out = narrow.mapInArrow(run, f"{fields}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
