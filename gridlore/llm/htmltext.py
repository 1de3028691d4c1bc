"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. The costs of calling a block content or boilerplate are the capacities to
the two terminals; neighbouring blocks, and neighbours under one parent in the DOM, are joined by edges whose
capacity is the price of labelling them differently. The minimum cut separates content from boilerplate and
so is the cheapest labelling of the whole page: where a block's own evidence is weak, its surroundings decide.

A block's costs are log-odds from two views. Structure: elements and roles that say what they hold. Names and
text: class and id names, length, links, punctuation, tags, weighted by a logistic regression that is trained
on the pages themselves (co-training): structure labels the blocks of a bounded sample of pages, and what it
labels teaches the second view, which then speaks where pages have no such structure. The regression starts
from stated weights and moves from them as far as the labels tell.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import carried, quoted

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements whose content is never text of the page.
RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "button"}
TEXTLIKE_RAW = {"script", "style", "title", "textarea", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"body", "html", "head", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "li", "dd", "dt", "legend", "summary"}
#: Elements and landmark roles that hold no article text.
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "note"}
#: Words of class and id names that mark boilerplate, and content.
CHROME_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "adv", "banner", "bottombar", "breadcrumb", "breadcrumbs", "byline", "comment", "comments",
    "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "meta", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notification", "outbrain", "pager", "pagination", "popup", "promo", "related", "recommended", "replies",
    "reply", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "taboola", "tags", "toolbar",
    "topbar", "widget", "alert", "toc", "respond", "discussion",
}
CONTENT_WORDS = {"article", "content", "entry", "main", "post", "story", "text", "body"}
NAME_PART = re.compile(r"[a-z]+")
#: Structure's log-odds: in an article, in boilerplate, and outside on a page whose article holds half of its text.
IN_ARTICLE, IN_CHROME, OUTSIDE = 6.0, -14.0, -6.0
#: Start of the learned weights: listed names of boilerplate and of content, then the features of the text.
LISTED_CHROME, LISTED_CONTENT = -12.0, 1.5
FEATURES = {"bias": -2.0, "log_length": 0.35, "linked": -2.0, "mostly_linked": -1.0, "sentence": 0.8, "very_short": -0.4, "paragraph": 0.8, "heading": 0.4, "cell": -0.6, "digits": -0.3}
NAMES = 256
#: Bounds of the text view, and of what names may add to or take from the listed weights.
TEXT_BOUND, NAME_BOUND = 3.0, 6.0
#: Prices of a change of label: between neighbours, and between neighbours under one parent.
NEXT, SIBLING = 0.8, 1.0
#: Bounds of the sample that the second view is trained on: pages in the mean, and blocks of a page.
SAMPLE_PAGES, SAMPLE_BLOCKS = 1000, 40
SENTENCE_END = tuple(".!?:;…。！？\"'»”)")


@dataclass
class Element:
    tag: str
    chrome: bool = False
    named: bool = False
    article: bool = False
    content: bool = False
    hidden: bool = False
    number: int = 0
    names: frozenset[int] = frozenset()


@dataclass
class Block:
    text: str
    tag: str
    parent: int
    article: bool
    chrome: bool
    named: bool
    content: bool
    linked: float
    names: frozenset[int] = field(default_factory=frozenset)


def _element(tag: str, attributes: str, parent: Element, number: int) -> Element:
    e = Element(tag, parent.chrome or tag in CHROME, parent.named, parent.article or tag in ("article", "main"), parent.content, parent.hidden, number, parent.names)
    if tag == "header" and parent.article:
        e.chrome = parent.chrome  # an article's own heading group
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                parts = set(NAME_PART.findall(value))
                if tag not in ("html", "body"):
                    e.names |= {crc32(p.encode()) % NAMES for p in parts}
                e.named |= bool(parts & CHROME_WORDS) and tag not in ("html", "body", "article", "main")
                e.content |= bool(parts & CONTENT_WORDS) and not parts & CHROME_WORDS
            elif name == "role":
                e.chrome |= value in CHROME_ROLES
                e.article |= value in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                e.hidden = True
    return e


class Tags:
    """The tags of a page in order, in time in proportion to its length."""

    def __init__(self, page: str):
        self.page, self.end = page, len(page)
        self.last = {q: page.rfind(q) for q in "\"'>"}
        self.quotes = True

    def after(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; past the page where it never does."""
        if at > self.last[">"]:
            return self.end + 1
        here = at
        while self.quotes:
            m = STOP.search(self.page, here)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            if m.start() >= self.last[m[0]]:
                self.quotes = False  # a quote that nothing closes: from here on, quotes hide no tag's end
                break
            here = self.page.index(m[0], m.end()) + 1
        return self.page.find(">", at) + 1 or self.end + 1

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """(start, end, slash, name, attributes) of the next tag or comment from ``at``; comments have no name."""
        page, here = self.page, at
        while (start := page.find("<", here)) >= 0:
            m = TAG.match(page, start)
            if m:
                end = self.after(m.end())
                return start, end, m[1], m[2].lower(), page[m.end() : end - 1]
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                return start, close + 3 if close >= 0 else self.end + 1, "", "", ""
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1 or self.end + 1, "", "", ""
            here = start + 1
        return self.end, self.end + 1, "", "", ""


class Stack:
    """Open elements, with the places of each tag's and of the blocks, so that no search walks over them."""

    def __init__(self):
        self.items = [Element("#root")]
        self.of: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, e: Element) -> None:
        self.of.setdefault(e.tag, []).append(len(self.items))
        if e.tag in BLOCK:
            self.blocks.append(len(self.items))
        self.items.append(e)

    def cut(self, k: int) -> None:
        for e in reversed(self.items[k:]):
            self.of[e.tag].pop()
            if e.tag in BLOCK:
                self.blocks.pop()
        del self.items[k:]

    def last(self, *tags: str) -> int:
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=0)

    def block(self) -> Element:
        return self.items[self.blocks[-1]] if self.blocks else self.items[0]


SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


def blocks_of(page: str) -> tuple[list[Block], dict[int, int]]:
    """Text blocks in page order, and the parent of each block element; tolerant of unclosed and stray tags.

    A tag or comment that the page's end cuts off is dropped with what follows.
    """
    tags, stack, out = Tags(page), Stack(), []
    run: list[str] = []
    parents: dict[int, int] = {}
    linked, at, number, end = 0, 0, 0, len(page)
    block_at: Element = stack.items[0]
    closes: dict[str, re.Pattern] = {}
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        run.clear()
        if text and not block_at.hidden:
            e = block_at
            out.append(Block(text, e.tag, e.number, e.article, e.chrome, e.named, e.content, min(1.0, linked / len(text)), e.names))
        linked = 0

    while at < end:
        start, after, slash, tag, attributes = tags.next(at)
        if start > at:
            text = html.unescape(page[at:start]) if page.find("&", at, start) >= 0 else page[at:start]
            run.append(text)
            if stack.last("a") >= len(stack.items) - 4 and stack.of.get("a"):
                linked += len(text.strip())
        at = after
        if not tag or after > end:
            continue
        if slash:
            if tag in VOID:
                continue
            k = stack.last(tag)
            inner = stack.blocks[-1] if stack.blocks else 0
            if k and not (tag not in BLOCK and inner > k):
                if inner >= k:
                    flush()
                stack.cut(k)
                block_at = stack.block()
            continue
        if tag in RAW and not attributes.rstrip().endswith("/"):
            close = closes.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*>", re.I)).search(page, at) if tag not in unclosed else None
            if close is not None:
                at = close.end()
            else:
                unclosed.add(tag)
                if tag in TEXTLIKE_RAW:
                    at = end
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                if stack.blocks and stack.block().tag == "p":
                    stack.cut(stack.blocks[-1])
            elif tag in SAME:
                same = SAME[tag]
                k = stack.last(*same, "ul", "ol", "dl", "table", "menu")
                while k and stack.items[k].tag in same:
                    stack.cut(k)
                    k = len(stack.items) - 1
        number += 1
        parent = stack.block().number
        stack.push(_element(tag, attributes, stack.items[-1], number))
        if tag in BLOCK:
            block_at = stack.items[-1]
            parents[number] = parent
    flush()
    return out, parents


def features(b: Block) -> list[float]:
    n = len(b.text)
    return [
        1.0, float(min(n, 400).bit_length()), b.linked, float(b.linked > 0.5), float(b.text.endswith(SENTENCE_END)), float(n < 20),
        float(b.tag in ("p", "pre", "blockquote")), float(re.fullmatch(r"h[1-6]", b.tag) is not None), float(b.tag in ("li", "td", "th", "dt", "dd")),
        sum(map(b.text[:2000].count, "0123456789")) / min(n, 2000),
    ]


def has_article(blocks: list[Block]) -> bool:
    """Whether an article holds half of the text that is not in boilerplate elements."""
    free = sum(len(b.text) for b in blocks if not b.chrome)
    return 0 < free <= 2 * sum(len(b.text) for b in blocks if b.article and not b.chrome)


def structure(b: Block, page_has_article: bool) -> float:
    return IN_CHROME * b.chrome + (IN_ARTICLE if b.article else OUTSIDE if page_has_article else 0.0)


@dataclass
class View:
    """Weights of text features and of hashed names."""

    text: np.ndarray = field(default_factory=lambda: np.array(list(FEATURES.values())))
    names: np.ndarray = field(default_factory=lambda: np.zeros(NAMES))

    def of_text(self, b: Block) -> float:
        return min(TEXT_BOUND, max(-TEXT_BOUND, float(np.dot(features(b), self.text))))

    def of_names(self, b: Block) -> float:
        learned = sum(self.names[k] for k in b.names)
        return LISTED_CHROME * b.named + LISTED_CONTENT * b.content + min(NAME_BOUND, max(-NAME_BOUND, float(learned)))


def log_odds(b: Block, view: View, page_has_article: bool) -> float:
    return structure(b, page_has_article) + view.of_text(b) + view.of_names(b)


def labelled(page: str | None) -> list[tuple[bool, list[float], list[int]]]:
    """(content, features, names) of blocks that structure is sure of, at most SAMPLE_BLOCKS, evenly over the page."""
    blocks, _ = blocks_of(page) if page else ([], {})
    if not has_article(blocks):
        return []
    sure = [b for b in blocks if not (b.article and (b.chrome or b.named))]
    some = sure if len(sure) <= SAMPLE_BLOCKS else [sure[int(i)] for i in np.linspace(0, len(sure) - 1, SAMPLE_BLOCKS)]
    return [(b.article, features(b), sorted(b.names)) for b in some]


def train(rows: list[tuple[bool, list[float], list[int]]], *, steps: int = 300, rate: float = 0.3, hold: float = 0.02) -> View:
    """Logistic regression by Adam, held to the stated weights; classes weigh alike. No label of either class: the stated weights."""
    view = View()
    y = np.array([r[0] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        return view
    used = np.array(sorted({k for _, _, names in rows for k in names}), int)
    x = np.zeros((len(rows), len(FEATURES) + len(used)), np.float32)
    x[:, : len(FEATURES)] = [r[1] for r in rows]
    for i, (_, _, names) in enumerate(rows):
        x[i, len(FEATURES) + np.searchsorted(used, np.array(names, int))] = 1
    scale = np.maximum(np.abs(x).max(axis=0), 1e-6)
    x /= scale
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    start = np.r_[view.text, view.names[used]] * scale
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for step in range(1, steps + 1):
        z = x @ w
        g = x.T @ (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)) + hold * (w - start) / scale.size
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w = w / scale
    view.text, view.names[used] = w[: len(FEATURES)], w[len(FEATURES) :]
    return view


def fit(pages: DataFrame, *, html_col: str = "html", sample: int = SAMPLE_PAGES) -> View:
    """The second view, trained on about ``sample`` pages drawn at random, and at most twice as many."""
    total = pages.count()
    if not total:
        return View()
    chosen = pages.select(pages[quoted(html_col)].alias("h"))
    if total > sample:
        chosen = chosen.where(F.rand(17) < sample / total).limit(2 * sample)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([r for h in frame["h"] for r in labelled(h)], columns=["y", "x", "names"])

    rows = chosen.mapInPandas(run, "y boolean, x array<double>, names array<int>").collect()
    return train(sorted((r["y"], list(r["x"]), list(r["names"])) for r in rows))


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut: node i pays odds[i] on the sink side if positive, -odds[i] on the
    source side if negative, and each edge (i, j, price) where its ends differ. Dinic's algorithm."""
    n = len(odds)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(forth)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, o in enumerate(odds):
        if o > 0:
            link(source, i, o, 0.0)
        elif o < 0:
            link(i, sink, -o, 0.0)
    for i, j, price in edges:
        link(i, j, price, price)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
            while nxt[a] < len(graph[a]):
                e = graph[a][nxt[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            else:
                if a == source:
                    break
                a = to[path.pop() ^ 1]
                nxt[a] += 1
                continue
            path.append(graph[a][nxt[a]])
            a = to[path[-1]]


def labels(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The minimum cut; blocks that outweigh all their edges have the label of their own odds, and are cut out first."""
    around = [0.0] * len(odds)
    for i, j, price in edges:
        around[i] += price
        around[j] += price
    keep = [o > 0 for o in odds]
    open_ = [i for i, o in enumerate(odds) if abs(o) <= around[i]]
    if not open_:
        return keep
    place = {i: k for k, i in enumerate(open_)}
    rest, inner = [odds[i] for i in open_], []
    for i, j, price in edges:
        if i in place and j in place:
            inner.append((place[i], place[j], price))
        elif i in place:
            rest[place[i]] += price if keep[j] else -price
        elif j in place:
            rest[place[j]] += price if keep[i] else -price
    for i, k in zip(open_, minimum_cut(rest, inner)):
        keep[i] = k
    return keep


def edges_of(blocks: list[Block], parents: dict[int, int]) -> list[tuple[int, int, float]]:
    edges = [(i, i + 1, NEXT) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = parents.get(b.parent, 0)
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def main_text(page: str | None, view: View | None = None) -> str:
    """The article of one page; empty for null and for pages without any."""
    if not page:
        return ""
    view = view or View()
    blocks, parents = blocks_of(page)
    sure = has_article(blocks)
    keep = labels([log_odds(b, view, sure) for b in blocks], edges_of(blocks, parents))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, *, html_col: str = "html", carry: list[str], sample: int = SAMPLE_PAGES) -> DataFrame:
    """carry columns, text and n_chars (code points) of every row of ``pages``, from the whole html.

    Null and empty pages, and pages without an article, give an empty text. Rows are independent but for the
    weights learned from a sample of them, so repeated rows give repeated results. Long pages take time in
    proportion to their length. An empty table gives an empty result. A carried column named like an added
    one gives way to it, other names do no harm.
    """
    view = fit(pages, html_col=html_col, sample=sample)
    inner, back = carried(pages, carry, ["text", "n_chars"])
    kept = pages.select(*inner, pages[quoted(html_col)].alias("h"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept.schema if f.name != "h") + "text string, n_chars long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h, view) for h in frame.pop("h")]
            yield frame.assign(text=texts, n_chars=[len(t) for t in texts])

    return kept.mapInPandas(run, schema).select(*back, "text", "n_chars")
