"""Main text of web pages by minimum cuts.

A page is read into blocks of text.  A classifier gives each block the cost of calling it content and the
cost of calling it boilerplate; these are the capacities to the two terminals.  Blocks next to each other,
and blocks of one parent in the page's tree, are joined by edges, weaker the farther apart they are in the
tree.  The minimum cut, found by maximum flow, labels all blocks of a page at once.

The classifier is a logistic regression fitted in numpy on the blocks of a bounded sample of pages
(`SAMPLE_PAGES` pages of at most `SAMPLE_BYTES` bytes).  Nobody has labelled them: blocks under elements
that name their role (article, nav, footer, ...) are the examples.  Half of them are shown without those
names, so that the text itself has a say on pages that lack them.  `PRIOR` is the centre of the weights'
prior, and what remains where a sample has no examples.

Defined cases: null and empty pages, and pages without content, give an empty text.  Unclosed elements,
comments and tags reach to the end.  White space of any kind counts as such, a line break too.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, mapped

SAMPLE_PAGES = 400
SAMPLE_BYTES = 200_000
NEAR, SIBLING = 0.6, 0.3

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int, n_content int"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.DOTALL)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
#: Their contents are not text of the page.
SILENT = frozenset("head title script style template textarea select button".split())
RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.IGNORECASE) for t in "script style textarea title".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote".split())

GOOD_TAGS, BAD_TAGS = frozenset(("article", "main")), frozenset(("nav", "aside", "footer", "header", "form", "menu", "dialog"))
BAD_NAMES = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|modal|popup|newsletter|subscribe|sidebar|widget|menu|nav\w*|breadcrumbs?|foot\w*|masthead|header|social|share|sharing|related|recommended|login|signup|search|form|copyright|pagination|toolbar)(?:$|[-_\s])", re.IGNORECASE)
COMMENT_NAMES = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|disqus\w*|replies|reply|respond|discussion|reviews?)(?:$|[-_\s])", re.IGNORECASE)
GOOD_NAMES = re.compile(r"(?:^|[-_\s])(?:articles?|post|entry|story|content|main|body|text)(?:$|[-_\s])", re.IGNORECASE)

FEATURES = ("bias", "length", "links", "sentence", "short", "signs", "heading", "item", "good tag", "bad tag", "good name", "bad name", "comment")
PRIOR = np.array([-0.5, 0.5, -3.0, 0.8, -0.5, -1.0, 0.3, -0.3, 3.0, -4.0, 2.0, -4.0, -5.0])
STRUCTURE = slice(8, 13)
#: The prior's precision: how many examples it counts for, about.
FIRM = 25.0


class Block:
    """A block: its text, how much of it is in links, how deep it lies, how deep the last element lies that it has in
    common with the block before, its element's parent, what its ancestors say, its element."""

    __slots__ = ("text", "linked", "depth", "shared", "parent", "names", "tag")

    def __init__(self, text: str, linked: int, depth: int, shared: int, parent: int, names: tuple[bool, ...], tag: str):
        self.text, self.linked, self.depth, self.shared, self.parent, self.names, self.tag = text, linked, depth, shared, parent, names, tag


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order.  Time grows with the length of the page, however deep it nests."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[bool, ...], bool]] = []  # element, what it and its ancestors say, is it silent
    outer: list[tuple[str, int, int]] = []  # those of them that aren't inline, their numbers and places in the stack
    open_: Counter[str] = Counter()
    none = (False,) * 5
    parts: list[str] = []
    linked = links = number = silent = lowest = 0

    def close_block() -> None:
        nonlocal linked, lowest
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            depth = len(outer)
            out.append(Block(text, min(linked, len(text)), depth, min(lowest, depth), outer[-2][1] if depth > 1 else 0, stack[-1][1] if stack else none, outer[-1][0] if outer else ""))
            lowest = depth
        parts.clear()
        linked = 0

    def pop(i: int) -> None:
        nonlocal links, silent, lowest
        if outer and outer[-1][2] >= i:
            close_block()
            while outer and outer[-1][2] >= i:
                outer.pop()
            lowest = min(lowest, len(outer))
        for t, _, quiet in stack[i:]:
            links -= t == "a"
            silent -= quiet
            open_[t] -= 1
        del stack[i:]

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        token, tag, at = m[0], (m[2] or "").lower(), m.end()
        if not tag:
            if (token[0] != "<" or len(token) == 1) and not silent:
                parts.append(token)
                linked += len(token.strip()) if links else 0
            continue
        if m[1]:
            if open_[tag]:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            elif tag == "p":
                close_block()
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
        else:
            closed = CLOSES.get(tag, ())
            if open_["p"] or any(open_[t] for t in closed):  # elements whose end may be left out
                for t, _, i in reversed(outer):
                    if t == "p" or t in closed:
                        pop(i)
                        break
                    if t in SCOPE or t in ("td", "th", "li") and tag not in CLOSES:
                        break
            close_block()
        if tag in VOID or m[3].endswith("/") and tag not in INLINE:
            continue
        said = " ".join(n.strip("\"'") for n in _NAME.findall(m[3])) if "=" in m[3] else ""
        above = stack[-1][1] if stack else none
        own = (tag in GOOD_TAGS, tag in BAD_TAGS and not (tag == "header" and above[0]), bool(said) and bool(GOOD_NAMES.search(said)), bool(said) and bool(BAD_NAMES.search(said)) and tag not in ("html", "body"), bool(said) and bool(COMMENT_NAMES.search(said)) and tag not in ("html", "body"))
        number += 1
        if tag not in INLINE:
            outer.append((tag, number, len(stack)))
        stack.append((tag, tuple(a or b for a, b in zip(above, own)), tag in SILENT))
        open_[tag] += 1
        links += tag == "a"
        silent += tag in SILENT
        if tag in RAW:  # its end is the next end tag of its name, whatever stands before
            end = RAW[tag].search(page, at)
            at = end.start() if end else len(page)
    close_block()
    return out


def features(found: list[Block]) -> np.ndarray:
    out = np.zeros((len(found), len(FEATURES)))
    for i, b in enumerate(found):
        n = len(b.text)
        signs = sum(b.text.count(c) for c in "|©·»›•→")
        out[i] = (1, min(n, 1000) ** 0.5 / 10, b.linked / n, b.text[-1] in ".!?…:;\"”»", n < 25, min(1.0, 10 * signs / n), b.tag in ("h1", "h2", "h3", "h4"), b.tag in ("li", "td", "dd", "dt"), *b.names)
    return out


def fit(pages: list[str], steps: int = 25, seed: int = 4) -> np.ndarray:
    """Weights of the classifier from pages whose elements name their role."""
    rows, y = [], []
    for page in pages:
        found = blocks(page)
        x = features(found)
        for b, f in zip(found, x):
            good, bad, _, names, comment = b.names
            if bad or names or comment or good:
                rows.append(f)
                y.append(0.0 if bad or names or comment else 1.0)
    w = PRIOR.copy()
    if not rows:
        return w
    x, y = np.array(rows), np.array(y)
    x[np.random.default_rng(seed).random(len(x)) < 0.5, STRUCTURE] = 0
    share = np.array([max(1, (y == k).sum()) for k in (0, 1)])
    weight = len(y) / 2 / share[y.astype(int)]
    for _ in range(steps):  # Newton's method
        p = 0.5 + 0.5 * np.tanh(0.5 * (x @ w))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + FIRM * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, x.T @ (weight * (p - y)) + FIRM * (w - PRIOR)), -2, 2)
    return w


def costs(found: list[Block], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each block: the cost of calling it boilerplate and the cost of calling it content."""
    logit = np.clip(features(found) @ weights, -12, 12)
    return np.logaddexp(0, logit), np.logaddexp(0, -logit)


def edges(found: list[Block]) -> Iterator[tuple[int, int, float]]:
    """Neighbours, and the block before of the same parent; weaker with the distance in the tree."""
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            yield i - 1, i, NEAR / max(1, found[i - 1].depth + b.depth - 2 * b.shared)
        if b.parent in last and last[b.parent] < i - 1:
            yield last[b.parent], i, SIBLING
        last[b.parent] = i


def minimum_cut(source: np.ndarray, sink: np.ndarray, joins: list[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes are on the source's side of a minimum cut: flow along shortest paths, all of one length at a time."""
    to, room, near = [], [], [[] for _ in source]
    for a, b, w in joins:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        room += [w, w]
    straight = np.minimum(source, sink)  # what flows from terminal to terminal through one node
    out, into = (source - straight).tolist(), (sink - straight).tolist()
    tiny = 1e-12
    while True:
        level, queue, met = [0 if x > tiny else -1 for x in out], deque(i for i, x in enumerate(out) if x > tiny), False
        while queue:
            a = queue.popleft()
            met = met or into[a] > tiny
            for e in near[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if not met:
            return np.array([x >= 0 for x in level], dtype=bool)
        tried = [0] * len(near)
        for start in range(len(near)):
            at, path = start, []
            while out[start] > tiny:
                if into[at] > tiny:
                    flow = min(out[start], into[at], *(room[e] for e in path))
                    out[start] -= flow
                    into[at] -= flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    at, path = start, []
                    continue
                while tried[at] < len(near[at]):
                    e = near[at][tried[at]]
                    if room[e] > tiny and level[to[e]] == level[at] + 1:
                        break
                    tried[at] += 1
                else:
                    if at == start:
                        break
                    at = to[path.pop() ^ 1]
                    tried[at] += 1
                    continue
                path.append(e)
                at = to[e]


def main_text(page: str | None, weights: np.ndarray) -> tuple[str, int, int]:
    """The main text, the number of blocks, and how many are content."""
    found = blocks(page) if page else []
    if not found:
        return "", 0, 0
    side = minimum_cut(*costs(found, weights), list(edges(found)))
    return " ".join(b.text for b, s in zip(found, side) if s), len(found), int(side.sum())


def train(pages: DataFrame, rows: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights from a sample of pages, which are drawn by a hash where they lie: the driver gets no more than `rows`."""
    some = pages.where(F.octet_length("html") <= SAMPLE_BYTES).select("page_id", "url", "html")
    return fit([r.html for r in drawn(some, F.xxhash64("page_id", "url"), rows, "html").collect()])


def extract(pages: DataFrame, rows: int = SAMPLE_PAGES) -> DataFrame:
    """One row per page: its main text, that one's length in code points, blocks and content blocks."""
    weights = train(pages, rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(p.as_py(), weights) for p in batch.column("html")]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int32()), pa.array([n for _, _, n in found], pa.int32())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])

    return mapped(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, SCHEMA)
