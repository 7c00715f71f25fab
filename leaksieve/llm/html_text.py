"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with two states, content or not. Its features (kind of tag, words in its class and id, own
text, links) give it a unary potential, and each parent and child a potential that depends on the parent's kind. Sum-product
messages go from the leaves to the root and back; a block is kept if the marginal of its node says content.

The potentials are counts over labelled pages, mixed with a prior: pages that mark their article by ``article`` or ``main``
label their nodes themselves. Elements that are
boilerplate by tag, and all in them, have no content potential and send no message. Names of boilerplate and hidden
elements are features: they hold unless the messages of what lies in such an element say more. An element round the
marked articles of a page is a wrapper, whatever its name.

A null or empty page gives an empty text; unclosed and misplaced tags close as browsers close them. Repeated rows
give repeated results, null ids and urls stay null. Pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm.common import table

#: About so many labelled pages teach.
SAMPLE_PAGES = 3000
#: Weights of the prior beside the learnt shares: of features, of the kind of tag (a list need not be a menu), of edges.
PRIOR, PRIOR_KIND, PRIOR_EDGE = 0.1, 0.5, 0.01

# HTML elements by what they are.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title template noscript iframe svg math canvas object".split())
FOREIGN = {"svg", "math"}  # may close themselves and hold their like
BOILER_TAGS = set("nav header footer aside form menu dialog button select fieldset head".split())
BLOCKS = set(
    "html body head article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address details summary nav header footer aside form menu dialog "
    "button select option fieldset hr center".split()
)
BOILER_WORDS = set(
    "ad ads advert advertisement advertising adslot sponsor sponsored promo promotion banner nav navbar navigation menu header masthead "
    "footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login social share sharing comment comments disqus reply replies respond related recommended breadcrumb "
    "breadcrumbs pagination pager toolbar search form copyright legal disclaimer".split()
)
CONTENT_WORDS = set("article content post entry story main body text articlebody".split())
CLOSES = {  # an open element on the left ends when one on the right begins
    "p": BLOCKS - {"html", "body", "head", "caption", "option"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"},
    "head": {"body", "article", "main", "section", "div", "p", "nav", "header", "h1", "h2"},
}
#: An element that begins is looked for no further out than these.
BORDERS = {"article", "section", "div", "body", "td", "th", "table"}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

#: Elements that decide where an open one ends; all others are passed over when looking for it.
_DECIDING = BORDERS | CLOSES.keys() | set().union(*HOLDS.values())
_CLOSING = set().union(*CLOSES.values())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|"
    r"<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_VALUES = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")
_HIDDEN = re.compile(r"(?<![^\s\"'/])hidden(?![\w:-])", re.IGNORECASE)  # as an attribute, looked for outside of values
_UNSEEN = re.compile(r"style\s*=[^>]*display\s*:\s*none|aria-hidden\s*=\s*[\"']?true\b", re.IGNORECASE)

KINDS = ("boiler", "article", "heading", "text", "list", "table", "box", "named")
_KIND = {tag: "boiler" for tag in BOILER_TAGS} | {"article": "article", "main": "article"}
_KIND |= {f"h{n}": "heading" for n in range(1, 7)} | dict.fromkeys(("p", "blockquote", "pre", "figcaption"), "text")
_KIND |= dict.fromkeys(("ul", "ol", "li", "dl", "dt", "dd"), "list")
_KIND |= dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "table")
NAMES, SIZES, LINKS = ("none", "content", "other", "mixed", "boiler"), 5, 3
WIDTHS = (len(KINDS), len(NAMES), SIZES, LINKS)


def name_of(attributes: str) -> str:
    """One of NAMES: boiler if a whole name is of boilerplate words or the element is hidden, mixed if a part of one is."""
    names = [n for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    split = [set(_WORD.findall(name)) for name in names]
    words = set().union(*split)
    if "hidden" in names or any(name and name <= BOILER_WORDS for name in split) or _UNSEEN.search(attributes):
        return "boiler"
    if _HIDDEN.search(_VALUES.sub(" ", attributes)):
        return "boiler"
    if words & BOILER_WORDS:
        return "mixed"
    return "content" if words & CONTENT_WORDS else "other" if words else "none"


def _end_of_raw(source: str, at: int, tag: str) -> int:
    """Where an element whose contents are no text ends: at its first end tag, at that of its own level if it can be nested."""
    if tag not in FOREIGN:
        return re.compile(rf"</{tag}\b[^>]*>?|\Z", re.IGNORECASE).search(source, at).end()
    depth, edges = 1, re.compile(rf"<(/?){tag}\b[^>]*?(/?)(?:>|\Z)", re.IGNORECASE)
    while depth and (found := edges.search(source, at)):
        depth += -1 if found[1] else not found[2]
        at = found.end()
    return at if not depth else len(source)


class Page:
    """Block elements in page order, each after its parent, and the blocks of text with their nodes."""

    def __init__(self, source: str):
        self.parent, self.kind, self.name = [-1], [KINDS.index("box")], [0]
        self.marked = [False]
        self.chars, self.linked = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._pieces: list[str] = []
        self._open: list[tuple[str, int]] = [("", 0)]  # open elements with the block node they lie in
        # How many of a tag are open, and of those that are no blocks, in each open block: what is not open is not looked for.
        self._count: Counter = Counter()
        self._inline: list[Counter] = [Counter()]
        self._deciding: list[int] = []  # depths of the open elements of _DECIDING
        self._links = 0
        self._forms: set[int] = set()
        self._read(source)

    def _text(self, piece: str) -> None:
        if piece:
            self._pieces.append(piece)
            node = self._open[-1][1]
            n = len(piece) - piece.count(" ")
            self.chars[node] += n
            if self._links:
                self.linked[node] += n

    def _end_block(self) -> None:
        if self._pieces:
            text = " ".join(html.unescape("".join(self._pieces)).split())
            if text:
                self.blocks.append((self._open[-1][1], text))
            self._pieces = []

    def _close(self, depth: int) -> None:
        """Closes all elements from this depth on."""
        if any(tag in BLOCKS for tag, _ in self._open[depth:]):
            self._end_block()
        for tag, _ in reversed(self._open[depth:]):
            self._links -= tag == "a"
            self._count[tag] -= 1
            if tag in BLOCKS:
                self._inline.pop()
            else:
                self._inline[-1][tag] -= 1
        del self._open[depth:]
        while self._deciding and self._deciding[-1] >= depth:
            self._deciding.pop()

    def _begin(self, tag: str, attributes: str) -> None:
        for depth in reversed(self._deciding) if tag in _CLOSING else ():
            other = self._open[depth][0]
            if tag in CLOSES.get(other, ()):
                self._close(depth)
                break
            if other in HOLDS.get(tag, ()) or other in BORDERS:
                break
        if tag in VOID:
            if tag in BLOCKS:
                self._end_block()
            elif tag in ("br", "wbr", "img", "input"):
                self._pieces.append(" " if tag != "wbr" else "")
            return
        node = self._open[-1][1]
        if tag in BLOCKS:
            self._end_block()
            words = {w for m in _NAMES.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}
            kind = _KIND.get(tag, "box")
            name = name_of(attributes)
            if name in ("mixed", "boiler"):
                if kind == "article" or tag in ("html", "body"):
                    name = "content" if words & CONTENT_WORDS else "other"
                elif kind in ("box", "list", "table"):
                    kind = "named"
            self.parent.append(node)
            self.kind.append(KINDS.index(kind))
            self.name.append(NAMES.index(name))
            self.marked.append(kind == "article" or "articlebody" in words)
            if tag == "form":
                self._forms.add(len(self.kind) - 1)
            self.chars.append(0)
            self.linked.append(0)
            node = len(self.parent) - 1
        self._links += tag == "a"
        self._count[tag] += 1
        if tag in BLOCKS:
            self._inline.append(Counter())
        else:
            self._inline[-1][tag] += 1
        if tag in _DECIDING:
            self._deciding.append(len(self._open))
        self._open.append((tag, node))

    def _read(self, source: str) -> None:
        at = 0
        while found := _TAG.search(source, at):
            self._text(source[at : found.start()])
            at = found.end()
            if found[1]:
                tag = found[1].lower()
                # An element that is no block does not end outside of its block. All that is passed over is closed.
                if self._count[tag] if tag in BLOCKS else self._inline[-1][tag]:
                    self._close(next(d for d in range(len(self._open) - 1, 0, -1) if self._open[d][0] == tag))
            elif found[2]:
                tag = found[2].lower()
                if tag in FOREIGN and found[3].endswith("/"):
                    continue
                if tag in RAW:
                    at = _end_of_raw(source, at, tag)
                    self._pieces.append(" " if self._pieces else "")
                else:
                    self._begin(tag, found[3])
        self._text(source[at:])
        self._close(1)
        self._end_block()
        self._spare()
        # What lies in boilerplate is boilerplate; boxes in a named element carry its name's doubt on.
        boiler, named = KINDS.index("boiler"), KINDS.index("named")
        loose = {KINDS.index(kind) for kind in ("box", "list", "table")}
        for node in range(1, len(self.parent)):
            above = self.kind[self.parent[node]]
            if above == boiler or above == named and self.kind[node] in loose:
                self.kind[node] = above

    def _spare(self) -> None:
        """Elements round marked articles are wrappers. Round some of them only, and with another article that stands
        free, boilerplate holds teasers or comments: forms and names that are boilerplate in part are wrappers then."""
        boiler, named, box = (KINDS.index(kind) for kind in ("boiler", "named", "box"))
        whole, part = NAMES.index("boiler"), NAMES.index("mixed")
        shut = [False] * len(self.parent)  # inside boilerplate that is no wrapper when another article stands free
        round_ = [0] * len(self.parent)  # how many marked ones each holds
        for node in range(len(self.parent) - 1, 0, -1):
            round_[self.parent[node]] += self.marked[node] + round_[node]
        total = sum(self.marked)
        for node in range(1, len(self.parent)):
            own = self.kind[node] == boiler and not (node in self._forms and round_[node])
            own = own or self.kind[node] == named and self.name[node] == whole
            shut[node] = shut[self.parent[node]] or own and not 0 < total == round_[node]
        free = any(m and not s for m, s in zip(self.marked, shut, strict=True))
        for node in range(1, len(self.parent)):
            if free and shut[node]:
                if self.marked[node]:
                    self.marked[node], self.kind[node] = False, named
            elif round_[node] and self.kind[node] in (boiler, named):
                self.kind[node] = box
                self.name[node] = NAMES.index("other") if self.name[node] in (whole, part) else self.name[node]

    def features(self) -> np.ndarray:
        """(node, feature): kind, name, size of own text, share of links."""
        chars, linked = np.array(self.chars), np.array(self.linked)
        size = np.searchsorted([1, 20, 80, 300], chars, side="right")
        links = np.where(linked == 0, 0, np.where(linked * 2 < chars, 1, 2))
        return np.stack([np.array(self.kind), np.array(self.name), size, links], axis=1)

    def labels(self) -> np.ndarray | None:
        """1 for nodes inside the marked article and no boilerplate by tag or name; None if nothing is marked."""
        if not any(self.marked):
            return None
        out = np.zeros(len(self.parent), np.int64)
        for node, above in enumerate(self.parent):
            if KINDS[self.kind[node]] != "boiler" and NAMES[self.name[node]] not in ("mixed", "boiler"):
                out[node] = self.marked[node] or (above >= 0 and out[above])
        return out


def prior() -> tuple[list[np.ndarray], np.ndarray]:
    """Shares before any page is seen: (state, value) of each feature, and (parent's kind, state, child's state)."""
    kinds = np.array([[0.3, 1e-5, 0.1, 0.15, 0.15, 0.1, 0.15, 0.05], [0.0, 0.1, 0.15, 0.45, 0.1, 0.05, 0.1, 0.05]])
    names = np.array([[0.35, 0.1, 0.35, 0.1, 0.1], [0.5, 0.3, 0.2, 1e-3, 1e-6]])
    sizes = np.array([[0.4, 0.3, 0.15, 0.1, 0.05], [0.2, 0.1, 0.15, 0.25, 0.3]])
    links = np.array([[0.5, 0.1, 0.4], [0.8, 0.15, 0.05]])
    steps = np.tile(np.array([[0.85, 0.15], [0.02, 0.98]]), (len(KINDS), 1, 1))
    steps[KINDS.index("boiler")] = [[1.0, 0.0], [0.5, 0.5]]
    steps[KINDS.index("named")] = [[0.99, 0.01], [0.02, 0.98]]
    return [kinds, names, sizes, links], steps


class TreeModel:
    """Potentials of nodes and edges, and the marginals they give a page."""

    def __init__(self, counts: np.ndarray):
        """counts: the sums of ``page_counts``; zeros leave the prior alone."""
        unary, steps = prior()
        at, self.unary = 0, []
        for width, before in zip(WIDTHS, unary, strict=True):
            seen = counts[at : at + 2 * width].reshape(2, width)
            at += 2 * width
            self.unary.append(_mix(seen, before, PRIOR if at > 2 * WIDTHS[0] else PRIOR_KIND))
        seen = counts[at:].reshape(len(KINDS), 2, 2)
        self.steps = _mix(seen, steps, PRIOR_EDGE)
        boiler, named, hits = KINDS.index("boiler"), KINDS.index("named"), [NAMES.index("mixed"), NAMES.index("boiler")]
        self.unary[0][1, boiler] = 0.0
        self.steps[boiler] = steps[boiler]
        # Labels go by these names themselves, so they teach nothing of them.
        self.unary[0][:, named], self.unary[1][:, hits], self.steps[named] = unary[0][:, named], unary[1][:, hits], steps[named]

    def marginals(self, page: Page) -> np.ndarray:
        """The chance of content of every node."""
        features, parent, kind = page.features(), page.parent, page.kind
        own = np.ones((len(parent), 2))
        for column, shares in zip(features.T, self.unary, strict=True):
            own *= shares.T[column]
        up, steps, boiler = own.tolist(), self.steps.tolist(), KINDS.index("boiler")
        message = [None] * len(parent)
        for node in range(len(parent) - 1, 0, -1):  # children come after their parents
            if kind[node] == boiler:  # known to be no content wherever it stands, so it says nothing of its parent
                message[node] = (1.0, 1.0)
                continue
            a, b = up[node]
            s = steps[kind[parent[node]]]
            m0, m1 = s[0][0] * a + s[0][1] * b, s[1][0] * a + s[1][1] * b
            scale = m0 + m1
            message[node] = m = (m0 / scale, m1 / scale)
            above = up[parent[node]]
            x, y = above[0] * m[0], above[1] * m[1]
            above[0], above[1] = x / (x + y), y / (x + y)
        belief = [None] * len(parent)
        x, y = up[0][0] * 0.95, up[0][1] * 0.05
        belief[0] = (x / (x + y), y / (x + y))
        for node in range(1, len(parent)):
            above, m = belief[parent[node]], message[node]
            s = steps[kind[parent[node]]]
            # The parent's belief without what this child said, carried down.
            p0, p1 = (above[0] / m[0] if m[0] else 0.0), (above[1] / m[1] if m[1] else 0.0)
            a = up[node][0] * (p0 * s[0][0] + p1 * s[1][0])
            b = up[node][1] * (p0 * s[0][1] + p1 * s[1][1])
            belief[node] = (a / (a + b), b / (a + b)) if a + b > 0 else (1.0, 0.0)
        return np.array(belief)[:, 1]

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        chance = self.marginals(page)
        return "\n".join(text for node, text in page.blocks if chance[node] > 0.5)


def _mix(seen: np.ndarray, before: np.ndarray, weight: float) -> np.ndarray:
    total = seen.sum(axis=-1, keepdims=True)
    share = np.divide(seen, total, out=before.copy(), where=total > 0)
    return (1 - weight) * share + weight * before


def page_counts(page: Page) -> np.ndarray | None:
    """Feature and edge counts of a page that marks its article, as one vector."""
    labels = page.labels()
    if labels is None:
        return None
    parts = []
    for column, width in zip(page.features().T, WIDTHS, strict=True):
        parts.append(np.bincount(labels * width + column, minlength=2 * width))
    parent, kind = np.array(page.parent[1:]), np.array(page.kind)
    edges = (kind[parent] * 2 + labels[parent]) * 2 + labels[1:]
    return np.concatenate([*parts, np.bincount(edges, minlength=4 * len(KINDS))])


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source in batch.column(0).to_pylist():
            counts = page_counts(Page(source)) if source else None
            if counts is not None:
                places = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places, pa.int32()), pa.array(counts[places], pa.int64())], ["place", "n"]
                )


def learn(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Summed counts of about ``sample`` pages, chosen by hash; they fit one short vector."""
    sources = pages.select(F.col(html_col).cast("string").alias("html")).where("length(html) > 0")
    share = max(1, sources.count() // sample)
    chosen = sources.where(F.pmod(F.xxhash64("html"), F.lit(share)) == 0)
    sums = chosen.mapInArrow(_teach, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(2 * sum(WIDTHS) + 4 * len(KINDS))
    for row in sums:
        out[row.place] = row.n
    return out


def _extract(batches: Iterator[pa.RecordBatch], counts: Broadcast) -> Iterator[pa.RecordBatch]:
    model = TreeModel(counts.value)
    for batch in batches:
        texts = [model.text(source) for source in batch.column(2).to_pylist()]
        lengths = pa.array([len(text) for text in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE_PAGES
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    counts = pages.sparkSession.sparkContext.broadcast(learn(pages, html_col, sample))
    columns = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return columns.mapInArrow(
        lambda batches: _extract(batches, counts), "page_id long, url string, text string, n_chars long"
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
