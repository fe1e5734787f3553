"""Main text of web pages: a minimum cut through each page's blocks parts content from boilerplate.

A page's blocks, the runs of text between block tags, are the nodes of a graph. A classifier, fitted here on blocks
whose tags alone tell their kind (in at most ``FIT_PAGES`` pages), scores each block by its text and its links; elements that name the article
or boilerplate add to the score, or take from it (``NAMED``). A score is the block's cost as the other kind: the
capacity of its edge to a terminal. Blocks that follow each other are held together by a smoothness edge, by how near they are in
the tree, and so are blocks with the same parent; these edges cross the borders of named elements too. Their capacities are fitted together with the
classifier, from how much the kind of its neighbours tells of a block's beyond its own features. The maximum flow's cut labels the blocks at the least total cost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages, by the order of a hash of page_id, that the classifier is fitted on, at most.
FIT_PAGES = 300
#: What a name adds to a block's score: an article or main around it; none there though the page has one; a nav, aside, footer or header
#: around it; and each element (form, or by class words) that may be boilerplate.
NAMED = {"article": 1.5, "elsewhere": -3.0, "apart": -5.0, "doubt": -3.0}
#: Scores count so much at most, before names.
MOST = 4.0
#: The kinds of smoothness edges: neighbours by their distance in the tree, up to the first two of these or beyond, and the last two blocks with one parent.
NEAR = (2, 4)
N_EDGES = len(NEAR) + 2
# HTML's tags by their role.
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template iframe object svg math canvas audio video select option textarea button datalist head title".split())
_TEXT = frozenset("p h1 h2 h3 h4 pre blockquote".split())
_APART = frozenset("nav footer aside menu dialog".split())
_ENDS_P = _BLOCK - {"body", "html", "head", "title"}
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
# Words of class, id and role attributes that name boilerplate or the article.
_BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|byline|comments?|comment-?list|commentlist|replies|reply|respond|disqus|contentinfo|cookies?|consent|copyright|disclaimer|dropdown|footer|foot|form|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|pager|pagination|popup|promo\w*|recommend\w*|related|search|share|sharing|sidebar|(?<!-by-)side(?!-by-)|signup|skip|social|sponsor\w*|subscribe|subscription|tags?|toolbar|topbar|widget|complementary)(?:$|[\s_-])", re.I)
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-body|content|entry|entry-content|main|main-content|post|post-body|post-content|story|body-text)(?:$|[\s_-])", re.I)
# Words of these that name what readers or other pages say, which is no article however long it is.
_THREAD = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|commentlist|replies|reply|respond|disqus|related|recommend\w*)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BLANK = re.compile(r"\s+")


@dataclass
class Block:
    """A run of text; ``parent`` numbers the element that holds it, ``kind`` is 1 in an article, -1 in boilerplate, 0 elsewhere.

    ``doubt`` numbers the innermost element around it that may be boilerplate, ``doubts`` counts those that count in the end, ``inner`` is
    the kind that it has without them; ``distance`` is the way through the tree from the block before it.
    """

    tag: str
    parent: int
    kind: int
    apart: bool
    doubt: int = 0
    distance: int = 0
    doubts: int = 0
    inner: int = 0
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class _Open:
    """An open element; ``holder`` is the place in the stack of the innermost block element, ``depth`` counts those."""

    tag: str
    number: int
    kind: int
    apart: bool
    silent: bool
    doubt: int
    holder: int
    depth: int


@dataclass
class _Doubt:
    """An element that may be boilerplate: the one around it, how many there are, how many of them name a thread, and whether it does."""

    up: int
    depth: int
    threads: int
    thread: bool
    real: bool = True


class _Blocks(HTMLParser):
    """Cuts a page into blocks. The end tags that HTML lets out are supplied; what is still open at the end ends there."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Open("", 0, 0, False, False, 0, 0, 0)]
        self.opened: Counter = Counter()
        self.doubts = [_Doubt(0, 0, 0, False, False)]
        self.count, self.links, self.now, self.blocks = 0, 0, None, []
        self.depth_before = self.low = 0

    def _pop_to(self, at: int) -> None:
        for element in self.open[at:]:
            self.links -= element.tag == "a"
            self.opened[element.tag] -= 1
            if element.tag in _BLOCK:
                self.now = None
        del self.open[at:]
        self.low = min(self.low, self.open[-1].depth)

    def _doubtful(self, inside: int, thread: bool) -> int:
        around = self.doubts[inside]
        self.doubts.append(_Doubt(inside, around.depth + 1, around.threads + thread, thread))
        return len(self.doubts) - 1

    def _without_doubts(self, inside: int) -> int:
        """The doubts of a <main>: the threads around it alone."""
        threads = self.doubts[inside].threads
        self.doubts.append(_Doubt(0, threads, threads, threads > 0, False))
        return len(self.doubts) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data(" ")
        if tag in _VOID:
            self.now = None if tag == "hr" else self.now
            return
        if tag in _BLOCK:
            self.now = None
        if tag in _ENDS_P:
            self._end_open("p", ())
        if tag in _SAME:
            for same in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                self._end_open(same, _SAME[tag])
        top = self.open[-1]
        kind, apart, silent, doubt = top.kind, top.apart, top.silent, top.doubt
        named = {k: v or "" for k, v in attrs}
        name = " ".join(named.get(k, "") for k in ("class", "id", "role"))
        silent |= tag in _SILENT or "hidden" in named or bool(_HIDDEN.search(named.get("style", ""))) or named.get("aria-hidden", "") == "true"
        self.count += 1
        if tag in _APART or tag == "header" and kind != 1:
            kind, apart = -1, True
        elif name.strip() and tag not in ("body", "html", "article", "main") and _BOILERPLATE.search(name) and not _ARTICLE.search(name) or tag == "form":
            doubt = self._doubtful(doubt, bool(_THREAD.search(name)))
        elif tag in ("article", "main") or name.strip() and _ARTICLE.search(name) and not apart:
            kind = -1 if apart else 1
            doubt = self._without_doubts(doubt) if tag == "main" else doubt
        self.links += tag == "a"
        self.opened[tag] += 1
        block = tag in _BLOCK
        self.open.append(_Open(tag, self.count, kind, apart, silent, doubt, len(self.open) if block else top.holder, top.depth + block))

    def _end_open(self, tag: str, within: tuple[str, ...]) -> None:
        """End the innermost open ``tag``, unless an element that limits its reach is inside it."""
        for at in range(len(self.open) - 1, 0, -1) if self.opened[tag] else ():
            found = self.open[at].tag
            if found == tag:
                self._pop_to(at)
                return
            if found in within or not within and found in _BLOCK:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.now = None
        for at in range(len(self.open) - 1, 0, -1) if self.opened[tag] else ():
            found = self.open[at].tag
            if found == tag:
                self._pop_to(at)
                return
            if found in ("td", "th", "table", "article", "body") and tag not in _BLOCK:
                return

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.silent:
            return
        if self.now is None:
            if not data.strip():
                return
            holder = self.open[top.holder]
            parent = self.open[self.open[top.holder - 1].holder].number if top.holder else 0
            self.now = Block(holder.tag, parent, holder.kind, holder.apart, holder.doubt, max(1, self.depth_before + holder.depth - 2 * self.low))
            self.depth_before = self.low = holder.depth
            self.blocks.append(self.now)
        if top.apart and not self.now.apart or self.doubts[top.doubt].depth > self.doubts[self.now.doubt].depth:
            return  # an inline part that is named boilerplate
        self.now.pieces.append(data)
        self.now.linked += len(data) if self.links else 0


def blocks_of(html: str) -> list[Block]:
    """The page's blocks with text, in order; character references decoded, white space single."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    out, skipped = [], 0
    for block in parser.blocks:
        block.text = _BLANK.sub(" ", "".join(block.pieces)).strip()
        skipped += block.distance
        if block.text:
            block.distance, skipped = skipped, 0
            out.append(block)
    size, held, counted, thread = sum(len(b.text) for b in out if not b.apart), [0] * len(parser.doubts), [0], [False]
    for block in out:
        held[block.doubt] += 0 if block.apart else len(block.text)
    for k in range(len(held) - 1, 0, -1):
        held[parser.doubts[k].up] += held[k]
    for k, doubt in enumerate(parser.doubts[1:], 1):
        counted.append(counted[doubt.up] + (doubt.thread or 2 * held[k] <= size) if doubt.real else doubt.threads)
        thread.append(thread[doubt.up] or doubt.thread)
    for block in out:
        block.doubts = counted[block.doubt]
        block.inner = 0 if thread[block.doubt] else block.kind
        block.kind = -1 if block.doubts else block.kind
    return out


def features(block: Block, tagged: bool = True) -> list[float]:
    """What the classifier sees of a block: its text, its links, and, where the page's tags tell paragraphs from others (``tagged``), its own tag."""
    text = block.text
    words = text.count(" ") + 1
    return [1.0, min(words, 60) / 60, min(block.linked / max(len(text), 1), 1.0), float(text[-1] in ".!?:;\"'…»”"), min(text.count(".") + text.count(","), 20) / 20, float(words <= 3), float(tagged and block.tag in _TEXT), float(tagged and block.tag in ("li", "td", "dt", "dd", "div"))]


N_FEATURES = 8
#: Where the pages have no blocks of both kinds: longer, unlinked paragraphs are content.
PLAIN = np.array([-0.5, 4.0, -4.0, 0.5, 1.0, -0.5, 1.0, -0.5, 0.5, 0.3, 0.1, 0.5])


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """The smoothness edges (block, later block, kind)."""
    edges, last = [], {}
    for k, block in enumerate(blocks):
        if k:
            edges.append((k - 1, k, sum(block.distance > most for most in NEAR)))
        if block.parent in last:
            edges.append((last[block.parent], k, N_EDGES - 1))
        last[block.parent] = k
    return edges


def _told(blocks: list[Block]) -> list[tuple[int, list[float]]]:
    """The kind of each block whose tags tell it, with its features and the sum of its neighbours' kinds for each kind of edge; once with its own tag, and once without."""
    around = np.zeros((len(blocks), N_EDGES))
    for a, b, kind in edges_of(blocks):
        around[a, kind] += blocks[b].kind
        around[b, kind] += blocks[a].kind
    return [(b.kind, features(b, tagged) + around[k].tolist()) for tagged in (True, False) for k, b in enumerate(blocks) if b.kind]


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, steps: int = 300) -> np.ndarray:
    """Weights of the blocks' features, then capacities of the kinds of edges, from the blocks of at most ``fit_pages`` pages that lie in an article or in boilerplate.

    The features' weights are a logistic model's. The capacities, zero at least, then maximise the pseudo-likelihood of the kinds, that of each block's given its
    score and its neighbours' kinds: a capacity is the weight of a neighbour's kind (1 or -1). Every block counts twice, with its own tag and without, so that the text's
    weights and the capacities are fitted for pages too whose tags tell nothing. Of rows that share a page_id, the least html counts.
    """
    ids = pages.filter("html is not null and page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(fit_pages)
    sample = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [x for html in batch.column("html") for x in _told(blocks_of(html.as_py() or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([kind for kind, _ in told], pa.int32()), pa.array([row for _, row in told], pa.list_(pa.float64()))], names=["kind", "features"])

    return _climb(sorted(map(tuple, sample.select("html").mapInArrow(measured, "kind int, features array<double>").collect())), steps)


def _climb(told: list[tuple], steps: int) -> np.ndarray:
    y = np.array([kind > 0 for kind, _ in told], float)
    if not told or y.min() == y.max():
        return PLAIN
    x = np.array([row for _, row in told])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)

    def logistic(x: np.ndarray, given: np.ndarray, least: float) -> np.ndarray:
        w, m = np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for _ in range(steps):
            slope = x.T @ (weight * (y - 1 / (1 + np.exp(-given - x @ w)))) - 1e-3 * w
            m = 0.9 * m + slope
            w = np.maximum(w + 0.5 * m, least)
        return w

    alone = logistic(x[:, :N_FEATURES], np.zeros(len(y)), -np.inf)
    score = np.clip(x[:, :N_FEATURES] @ alone, -MOST, MOST)
    return np.concatenate([alone, logistic(x[:, N_FEATURES:], score, 0.0)])


def minimum_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Of each node, whether it is on the content side. ``content``: the cost of that label, ``boilerplate``: of the other.

    A node's flow from terminal to terminal goes first; blocking flows over the shortest paths then carry what is left along the
    edges, all paths of one length at a time.
    """
    n, least = len(content), 1e-9
    supply = [max(b - c, 0.0) for c, b in zip(content, boilerplate, strict=True)]
    demand = [max(c - b, 0.0) for c, b in zip(content, boilerplate, strict=True)]
    ends, room, out = [], [], [[] for _ in range(n)]  # edge k and its reverse, k ^ 1
    for a, b, capacity in edges:
        out[a].append(len(ends))
        out[b].append(len(ends) + 1)
        ends += (b, a)
        room += (capacity, capacity)
    while True:
        level = [0 if s > least else -1 for s in supply]
        ahead, reached = [k for k in range(n) if level[k] == 0], False
        while ahead and not reached:
            following = []
            for k in ahead:
                for e in out[k]:
                    if room[e] > least and level[ends[e]] < 0:
                        level[ends[e]] = level[k] + 1
                        following.append(ends[e])
                        reached |= demand[ends[e]] > least
            ahead = following
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for source in range(n):
            path, at = [], source
            while supply[source] > least:
                if demand[at] > least:
                    flow = min([supply[source], demand[at], *(room[e] for e in path)])
                    supply[source] -= flow
                    demand[at] -= flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    full = next((k for k, e in enumerate(path) if room[e] <= least), len(path))
                    at = ends[path[full] ^ 1] if full < len(path) else at
                    del path[full:]
                    continue
                while tried[at] < len(out[at]):
                    e = out[at][tried[at]]
                    if room[e] > least and level[ends[e]] == level[at] + 1:
                        break
                    tried[at] += 1
                else:
                    if not path:
                        break
                    at = ends[path.pop() ^ 1]
                    tried[at] += 1
                    continue
                path.append(e)
                at = ends[e]


def terminals(blocks: list[Block], weights: np.ndarray) -> tuple[list[float], list[float]]:
    """Each block's cost as content, and as boilerplate."""
    tagged = any(b.tag in _TEXT for b in blocks)
    score = np.clip(np.array([features(b, tagged) for b in blocks]) @ weights[:N_FEATURES], -MOST, MOST)
    has_article = any(b.inner > 0 for b in blocks)
    content, boilerplate = [], []
    for block, s in zip(blocks, score.tolist(), strict=True):
        s += NAMED["article"] if block.inner > 0 else NAMED["elsewhere"] if has_article else 0.0
        s += NAMED["apart"] * block.apart + NAMED["doubt"] * block.doubts
        content.append(max(-s, 0.0))
        boilerplate.append(max(s, 0.0))
    return content, boilerplate


def main_text(html: str, weights: np.ndarray) -> str:
    """The content blocks of a page, one a line; ``weights`` as from ``fit``."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    content, boilerplate = terminals(blocks, weights)
    edges = [(a, b, float(weights[N_FEATURES + kind])) for a, b, kind in edges_of(blocks)]
    return "\n".join(b.text for b, inside in zip(blocks, minimum_cut(content, boilerplate, edges), strict=True) if inside)


def extract_main_text(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html, ...), from the whole html.

    Returns page_id, url, text and n_chars (its code points).

    Defined cases: a null or empty html, or one without content, gives an empty text; cut-off and wrongly nested html is read
    as far as it goes; repeated rows are read each; a null page_id or url stays null; an empty table gives no rows. Other
    columns of ``pages`` are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "", weights) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")
