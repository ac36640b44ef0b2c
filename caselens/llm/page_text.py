"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every run of text of a page is a node with a hidden state: does it hold article text or not.
A node's own potential comes from its tag, its names and the shape of its text, and a table of potentials ties
each child to its parent. Sum-product messages run upward from the leaves and downward from the root, a level of
all trees of a batch at a time, and give every node's exact marginal; runs more likely article text than not make
up the result. The potentials are trained by the same messages on labelled pages (`page_samples`), so that the
model's expected counts meet those of the labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import arrow_map, slices
from caselens.llm.page_samples import MARK, labelled_pages

PAGES = 700  # labelled pages to train on
SEED = 11
STEPS = 200
RIDGE = 0.05

# Fixed values of HTML: tags that hold no text of the page, tags that end a line of text only, tags inside a line.
SKIPPED = frozenset("script style template noscript iframe object video audio canvas svg math select textarea button datalist title noembed noframes".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split()
)
# An opening tag of the key ends an open element of the values, if nothing but text styling lies between.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "option": ("option",),
}
TAGS = (
    "#other html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th article section main nav header footer aside "
    "form fieldset label blockquote pre figure figcaption address center dialog details summary a span"
).split()
TAG_NUMBER = {t: k for k, t in enumerate(TAGS)}
# Words in class names, ids and roles, by what they say of an element.
HINTS = (
    ("nav", "nav navbar menu navigation breadcrumb breadcrumbs pagination pager tabs tablist topnav"),
    ("header", "header masthead banner topbar logo branding"),
    ("footer", "footer copyright colophon legal contentinfo"),
    ("side", "sidebar aside side widget related recommended popular trending complementary"),
    ("notice", "cookie cookies consent gdpr notice alert popup modal overlay toast announcement alertdialog dialog"),
    ("ad", "ad ads adv advert advertisement advertising adsbygoogle adbox adslot sponsor sponsored promo promotion"),
    ("form", "form search login signin signup subscribe newsletter register contact searchbox"),
    ("comments", "comment comments reply replies respond responses discussion disqus"),
    ("share", "share sharing social follow"),
    ("byline", "byline author date meta timestamp"),
    ("main", "content article post entry story main text prose body"),
)
HINT_WORDS = {w: k for k, (_, words) in enumerate(HINTS) for w in words.split()}
# Longer ones also count as a part of a word.
HINT_PARTS = [(w, k) for w, k in HINT_WORDS.items() if len(w) >= 6 and w != "contentinfo"]
MAIN = len(HINTS) - 1
# Strings in a short text that speak for a part outside the article.
CUES = (
    ("©", "copyright", "all rights reserved"),
    ("cookie", "privacy", "consent"),
    ("subscribe", "newsletter", "sign up", "log in", "search"),
    ("advertisement", "sponsored"),
    ("comment", "reply"),
)
CUE_WORDS = 60  # texts longer than this are not searched for cues
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORDS = np.array([1, 3, 6, 13, 31, 81, 200])
TAG_COUNT, HINT_COUNT, CUE_COUNT = len(TAGS), len(HINTS), len(CUES)


# Regions of a page by the nearest tag of this kind; a header of an article is one of its own.
IN_ARTICLE, IN_ARTICLE_HEADER, IN_HEADER = 1, 2, 3
REGIONS = {"article": 1, "main": 1, "nav": 4, "footer": 4, "aside": 4, "form": 4, "dialog": 4}
N_REGIONS = 5


@lru_cache(maxsize=100_000)
def hints(name: str) -> int:
    """The kinds of part that a class name or id speaks of, as bits."""
    out = 0
    for part in NAME.findall(name):
        part = part.lower()
        if part in HINT_WORDS:
            out |= 1 << HINT_WORDS[part]
        elif len(part) > 6:
            for word, k in HINT_PARTS:
                if word in part:
                    out |= 1 << k
    return out


@dataclass
class Forest:
    """Nodes of pages, parents before children. Runs of text are nodes with `block` >= 0."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    hint: list[int] = field(default_factory=list)
    region: list[int] = field(default_factory=list)  # the kind of part that the tags around a node speak of
    words: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    closed: list[int] = field(default_factory=list)  # 1 for a run that ends like a sentence
    commas: list[int] = field(default_factory=list)
    cue: list[int] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    page: list[int] = field(default_factory=list)

    def add(self, page: int, parent: int, tag: int, hint: int, region: int, depth: int, block: int = -1, text: str = "", words: int = 0, linked: int = 0) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.tag.append(tag)
        self.hint.append(hint)
        self.region.append(region)
        self.depth.append(depth)
        self.block.append(block)
        self.text.append(text)
        self.words.append(words)
        self.linked.append(linked)
        end = text.rstrip()[-1:]
        self.closed.append(int(end != "" and end in ".!?…。:;\"”»"))
        self.commas.append(min(text.count(","), 3))
        cue = 0
        if 0 < words <= CUE_WORDS:
            low = text.lower()
            cue = sum(1 << k for k, c in enumerate(CUES) if any(w in low for w in c))
        self.cue.append(cue)
        return len(self.parent) - 1


class _Reader(HTMLParser):
    """Adds the nodes of one page to a forest."""

    def __init__(self, forest: Forest, page: int):
        super().__init__(convert_charrefs=True)
        self.forest, self.number = forest, page
        root = forest.add(page, -1, TAG_NUMBER["body"], 0, 0, 0)
        # Open elements: tag, node, depth, region, makes a block.
        self.stack = [("#page", root, 0, 0, True)]
        self.open: dict[str, int] = {}
        self.skipped = self.links = 0
        self.block = 0
        self.pieces: list[str] = []
        self.words = self.linked = 0

    def _flush(self) -> None:
        if self.pieces:
            text = "".join(self.pieces)
            k = len(self.stack) - 1
            while self.stack[k][1] < 0:
                k -= 1
            _, node, depth, region, _ = self.stack[k]
            if self.words:
                self.forest.add(self.number, node, self.forest.tag[node], 0, region, depth + 1, self.block, text, self.words, self.linked)
            elif text:
                # Only blanks: they may part two runs of one block.
                self.forest.add(self.number, node, self.forest.tag[node], 0, region, depth + 1, self.block, " ")
            self.pieces, self.words, self.linked = [], 0, 0

    def _break(self) -> None:
        self._flush()
        self.block += 1

    def _pop(self) -> None:
        tag, node, _, _, makes_block = self.stack[-1]
        if makes_block:
            self._break()
        elif node >= 0:
            self._flush()
        self.stack.pop()
        self.open[tag] -= 1
        if tag in SKIPPED or tag == "head":
            self.skipped -= 1
        elif tag == "a":
            self.links -= 1

    def _close(self, tag: str) -> None:
        if self.open.get(tag, 0):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            self._close("head")
            return
        if self.open.get("head", 0) and tag not in IN_HEAD:
            self._close("head")
        if tag in VOID:
            if tag in ("br", "hr"):
                self._break()
            return
        if tag in SKIPPED or tag == "head":
            self._flush()
            self._push(tag, -1, False)
            self.skipped += 1
            return
        inline = tag in INLINE
        if not inline:
            self._close("p")
            ends = ENDS.get(tag)
            while ends and len(self.stack) > 1 and (self.stack[-1][0] in ends or self.stack[-1][0] in INLINE):
                self._pop()
        elif tag == "a":
            self._close("a")
        said = 0
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                said |= hints(value)
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and "display:none" in value.replace(" ", "")):
                said |= 1 << HINT_COUNT
        if inline:
            if said and said != 1 << MAIN:
                self._flush()
                self._push(tag, self._node(tag, said), False)
            elif tag == "a":
                self._push(tag, -1, False)
            if tag == "a":
                self.links += 1
            return
        self._break()
        self._push(tag, self._node(tag, said), True)

    def _node(self, tag: str, said: int) -> int:
        k = len(self.stack) - 1
        while self.stack[k][1] < 0:
            k -= 1
        _, node, depth, region, _ = self.stack[k]
        return self.forest.add(self.number, node, TAG_NUMBER.get(tag, 0), said, region, depth + 1)

    def _push(self, tag: str, node: int, makes_block: bool) -> None:
        _, _, depth, region, _ = self.stack[-1]
        if tag == "header":
            region = IN_ARTICLE_HEADER if region == IN_ARTICLE else IN_HEADER
        else:
            region = REGIONS.get(tag, region)
        self.stack.append((tag, node, depth + (node >= 0), region, makes_block))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # A slash does not close an HTML element.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._break()
        elif tag not in ("html", "body") and (tag not in INLINE or tag in self.open):
            self._close(tag)
            if tag not in INLINE and tag not in SKIPPED and tag != "head":
                self._break()

    def handle_data(self, data: str) -> None:
        if self.skipped:
            if not self.open.get("head", 0) or self.stack[-1][0] != "head" or not data.strip():
                return
            self._close("head")  # text ends an open head
            if self.skipped:
                return
        n = len(data.split())
        self.pieces.append(data)
        self.words += n
        if self.links:
            self.linked += n

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def finish(self) -> None:
        self._flush()


def read_page(forest: Forest, page: int, text: str) -> None:
    reader = _Reader(forest, page)
    # In HTML "<![" opens a comment that ends at the next ">", as any other "<!" does.
    reader.feed(text.replace("<![", "<! ["))
    reader.close()
    reader.finish()


# --- features ----------------------------------------------------------------------------
def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


@dataclass
class Trees:
    """What the model sees: (node, feature) pairs, kinds of edges, levels from the roots down."""

    node: np.ndarray
    feature: np.ndarray
    edge: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]


def _table(*sizes: int) -> list[int]:
    return np.cumsum([1, *sizes]).tolist()


SHARES = np.array([0.001, 0.34, 0.8])
STARTS = _table(
    2 * TAG_COUNT * N_REGIONS, 16, 2 * 4 * 4, 2 * 4 * 4, 2 * 4, HINT_COUNT + 1, CUE_COUNT, (HINT_COUNT + 1) * N_REGIONS * 4,
    2 * TAG_COUNT * 4,
)
N_FEATURES = STARTS[-1]
N_EDGES = 4 * N_REGIONS


def trees(forest: Forest) -> Trees:
    parent, depth, tag, hint, region, words, linked, closed, commas, cue, block = (
        np.array(x, dtype=np.int64)
        for x in (
            forest.parent, forest.depth, forest.tag, forest.hint, forest.region, forest.words, forest.linked, forest.closed,
            forest.commas, forest.cue, forest.block,
        )
    )
    run = block >= 0
    levels = _levels(depth)
    runs = (run & (words > 0)).astype(np.int64)
    sums = np.stack([words, linked, closed, runs], axis=1)
    for level in reversed(levels[1:]):
        np.add.at(sums, parent[level], sums[level])
    size = np.searchsorted(WORDS, sums[:, 0], side="right")
    coarse = np.searchsorted([1, 6, 31], sums[:, 0], side="right")
    link = np.searchsorted(SHARES, sums[:, 1] / np.maximum(sums[:, 0], 1), side="right")
    ends = np.where(run, closed, np.searchsorted(SHARES, sums[:, 2] / np.maximum(sums[:, 3], 1), side="right"))
    many = np.where(run, commas, np.searchsorted([2, 4, 9], sums[:, 3], side="right"))
    kind = run.astype(np.int64)
    base = STARTS
    columns = [
        base[0] + (kind * TAG_COUNT + tag) * N_REGIONS + region,
        base[1] + kind * 8 + size,
        base[2] + (kind * 4 + link) * 4 + coarse,
        base[3] + (kind * 4 + ends) * 4 + coarse,
        base[4] + kind * 4 + many,
        base[8] + (kind * TAG_COUNT + tag) * 4 + coarse,
    ]
    for k in range(HINT_COUNT + 1):
        has = (hint >> k) & 1
        columns.append(has * (base[5] + k))
        columns.append(has * (base[7] + (k * N_REGIONS + region) * 4 + coarse))
    columns += [((cue >> k) & 1) * (base[6] + k) for k in range(CUE_COUNT)]
    outside = (hint & ~((1 << MAIN))) != 0
    edge = np.where(run, 0, np.where(outside, 1, np.where((hint >> MAIN) & 1, 2, 3)))
    edge = edge + 4 * region
    table = np.stack(columns, axis=1)
    node, column = np.nonzero(table)
    return Trees(node, table[node, column], edge, parent, levels)


# --- model -------------------------------------------------------------------------------
@dataclass
class PageModel:
    """Weight of each feature for state 1, and for each kind of edge the potentials by (parent, child) state."""

    weights: np.ndarray
    edges: np.ndarray


def marginals(model: PageModel, t: Trees) -> tuple[np.ndarray, np.ndarray]:
    """Chance of state 1 for each node, and of each (parent, child) pair of states for each node but the roots."""
    n = len(t.parent)
    up = np.zeros((n, 2))
    up[:, 1] = np.bincount(t.node, weights=model.weights[t.feature], minlength=n)
    sent = np.zeros((n, 2))
    for level in reversed(t.levels[1:]):
        joint = model.edges[t.edge[level]] + up[level][:, None, :]
        sent[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        np.add.at(up, t.parent[level], sent[level])
    belief = up.copy()
    pair = np.zeros((n, 2, 2))
    for level in t.levels[1:]:
        # The parent's belief without what this child told it.
        rest = belief[t.parent[level]] - sent[level]
        joint = rest[:, :, None] + model.edges[t.edge[level]] + up[level][:, None, :]
        here = np.logaddexp(joint[:, 0, :], joint[:, 1, :])
        belief[level] = here
        pair[level] = np.exp(joint - np.logaddexp(here[:, 0], here[:, 1])[:, None, None])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


def fit(pages: Iterable[str], steps: int = STEPS, ridge: float = RIDGE) -> PageModel:
    """Trains on pages whose article text is marked: expected counts of features and edges move to those of the labels.

    An element's label is 1 if any text below it belongs to the article.
    """
    forest = Forest()
    for k, page in enumerate(pages):
        read_page(forest, k, page)
    state = np.array([MARK in x for x in forest.text], dtype=np.int64)
    # Marks are no text: they stand before a word, so counts of words are those of the plain page.
    t = trees(forest)
    for level in reversed(t.levels[1:]):
        np.maximum.at(state, t.parent[level], state[level])
    below = np.ones(len(state), dtype=bool)
    below[t.levels[0]] = False
    kind = t.edge[below]
    seen = np.zeros((N_EDGES, 2, 2))
    np.add.at(seen, (kind, state[t.parent[below]], state[below]), 1.0)
    model = PageModel(np.zeros(N_FEATURES), np.zeros((N_EDGES, 2, 2)))
    m, v = np.zeros(N_FEATURES + N_EDGES * 4), np.zeros(N_FEATURES + N_EDGES * 4)
    for step in range(1, steps + 1):
        p, pair = marginals(model, t)
        node = np.bincount(t.feature, weights=(state - p)[t.node], minlength=N_FEATURES) - ridge * model.weights
        expected = np.zeros((N_EDGES, 2, 2))
        np.add.at(expected, kind, pair[below])
        g = np.concatenate([node, (seen - expected - ridge * model.edges).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.4 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        model.weights += move[:N_FEATURES]
        model.edges += move[N_FEATURES:].reshape(N_EDGES, 2, 2)
    return model


@lru_cache(maxsize=1)
def default_model() -> PageModel:
    """Fitted on PAGES labelled pages, the same ones each time."""
    return fit(labelled_pages(PAGES, SEED))


def page_texts(model: PageModel, pages: list[str]) -> list[str]:
    """The main text of each page: runs of a block joined as they stand, blocks joined by one space."""
    forest = Forest()
    for k, page in enumerate(pages):
        read_page(forest, k, page)
    chance = marginals(model, trees(forest))[0].tolist()
    blocks: list[list[str]] = [[] for _ in pages]
    place = (-1, -1)
    for k, block in enumerate(forest.block):
        # A run of blanks follows its neighbours; alone it vanishes with the white space.
        if block < 0 or (forest.words[k] and chance[k] < 0.5):
            continue
        page = forest.page[k]
        if place != (page, block):
            blocks[page].append("")
            place = (page, block)
        blocks[page][-1] += forest.text[k]
    return [" ".join(" ".join(b).split()) for b in blocks]


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", model: PageModel | None = None) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars (code points) of every row.

    White space inside a block (Unicode's too) becomes one space. A null html is an empty page. Repeated rows and null
    ids stay as they are, pages are read whole and each by itself, unclosed and stray tags are put right as browsers
    do. An empty table gives no rows. Other columns are not read.
    """
    model = model or default_model()
    schema = T.StructType(
        [
            T.StructField(page_id, pages.schema[page_id].dataType),
            T.StructField(url, pages.schema[url].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html", 2_000_000):
                texts = page_texts(model, [x or "" for x in part.column(2).to_pylist()])
                n = pa.array([len(x) for x in texts], type=pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, type=pa.string()), n], names=schema.names)

    return arrow_map(pages.select(page_id, url, F.col(html).cast("string").alias("_html")), run, schema)
