"""Main-text extraction by a tree-structured graphical model over the DOM.

Every block element of a page, and loose text between such elements, is a node with a hidden label:
content, boilerplate or frame.  Edges between parent and child carry potentials, nodes carry evidence (tag, words of class, id and
role, amount of own text, share of link text).  Sum-product messages pass from the leaves to the
root and back, which gives each node its exact marginal; text blocks of nodes that are more
likely content than not make up the main text, in page order.

Potentials are trained by smoothed counts from labelled pages.  The synthetic tables hold no
labels, so :func:`labelled_pages` makes a seeded set with the usual kinds of layout; any list of
``(html, labels in document order)`` serves as well.

Text: character references are decoded, white space inside a block becomes one space, blocks
are joined by one line feed.  Scripts, styles, templates, inline frames, text areas, comments and
the head never count as text.  Inside ``svg`` and ``math`` all elements are inline up to the first
that HTML does not allow there.

Defined results: null and empty pages give an empty text; unclosed, stray and cut-off markup is
read as browsers do in the common cases; nesting may be of any depth, and time is linear in the
page; equal rows give equal texts; an empty table gives an empty result; a column named
``main_text`` is replaced.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

#: Fixed values of HTML: elements without content, inline elements, elements whose content is raw.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var br img wbr math svg object canvas".split()
)
#: Without an end tag these reach to the end of the page, in browsers too.
RAW = frozenset("script style template iframe textarea".split())
FOREIGN = frozenset(("math", "svg"))
#: Elements that end an open paragraph when they start.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements that end open ``svg`` and ``math`` when they start.
ENDS_FOREIGN = ENDS_P | frozenset("body head html dd dt li tbody td th tr thead tfoot button noscript select".split())
#: An element that starts ends an open element of these, unless one of the others lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody"}, {"table"}),
}

#: Possessive throughout, so that no page makes it look at a byte more than a few times; quotes count after ``=`` only.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Labels: what is left out, what is kept, and what only frames other elements (html, body, wrappers).
BOILERPLATE, CONTENT, FRAME = 0, 1, 2
LABELS = 3


@dataclass
class Dom:
    """Block elements in document order, node 0 being the root, then ``#text`` nodes (see :func:`parse`)."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [-1])
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    text: list[int] = field(default_factory=lambda: [0])
    link_text: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)  # node, clean text
    elements: int = 1  # how many of the nodes are elements (or the root)


class _Open:
    """The stack of open block elements, with the places of each tag, so that no search walks the stack."""

    def __init__(self, tags: list[str]):
        self.tags, self.nodes, self.at = tags, [0], defaultdict(list)

    def push(self, node: int) -> None:
        self.at[self.tags[node]].append(len(self.nodes))
        self.nodes.append(node)

    def last(self, names) -> int:
        """The place of the innermost open element of one of these tags, 0 if there is none."""
        found = 0
        for n in names:
            if (places := self.at.get(n)) and places[-1] > found:
                found = places[-1]
        return found

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.at[self.tags[self.nodes.pop()]].pop()


def parse(page: str | None) -> Dom:
    """The tree of a page.

    Text that stands directly in an element with block elements of its own, or in ``body``, ``html``
    or nothing at all, belongs to a ``#text`` node below that element, so that the label of a frame
    does not decide about it.
    """
    dom = Dom()
    if not page:
        return dom
    stack = _Open(dom.tags)
    links = 0  # open <a> elements
    foreign = 0  # open <svg> and <math> elements
    run: list[str] = []
    size_run = link_run = 0  # characters other than spaces of the run, and those in links
    runs: list[tuple[int, str, int, int]] = []  # node, clean text, characters, characters in links
    at = 0

    def close() -> None:
        nonlocal size_run, link_run
        if run:
            if clean := " ".join(_html.unescape("".join(run)).split()):
                runs.append((stack.nodes[-1], clean, size_run, link_run))
            run.clear()
            size_run = link_run = 0

    def add_text(piece: str) -> None:
        nonlocal size_run, link_run
        if piece:
            run.append(piece)
            n = len(piece) - piece.count(" ")
            size_run += n
            link_run += n if links else 0

    def pop_to(place: int) -> None:
        close()
        stack.cut(place)

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            add_text(page[at:])
            break
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name in FOREIGN:
                foreign = max(0, foreign - 1)
            elif name == "a":
                links = max(0, links - 1)
            elif name not in INLINE:
                if place := stack.last((name,)):
                    pop_to(place)
                elif name == "p":
                    close()
            continue
        if name in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in ENDS_FOREIGN:
            foreign = 0
        if name in INLINE or foreign:
            if name in FOREIGN:
                foreign += not m[0].endswith("/>")
            elif name == "a":
                links += 1
            elif name == "br":
                run.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        if name in ENDS_P and (place := stack.last(("p",))) and place > stack.last(("table", "td", "button")):
            pop_to(place)
        if name in ENDS:
            ended, walls = ENDS[name]
            wall = stack.last(walls)
            while (place := stack.last(ended)) > wall:
                last = name != "tr" or dom.tags[stack.nodes[place]] == "tr"
                pop_to(place)
                if last:
                    break
        if run:
            close()
        dom.tags.append(name)
        dom.parents.append(stack.nodes[-1])
        dom.words.append(tuple(w.lower() for _, v in _ATTR.findall(m[3]) for w in _NAME.findall(v)) if m[3] else ())
        stack.push(len(dom.tags) - 1)
        links = 0 if name not in ("li", "h1", "h2", "h3", "p") else links
    close()
    dom.elements = len(dom.tags)
    mixed = {i for i in range(dom.elements) if dom.tags[i] in ("#root", "html", "body")}.union(dom.parents[1:])
    dom.text, dom.link_text = [0] * dom.elements, [0] * dom.elements
    for node, clean, n, in_links in runs:
        if node in mixed:
            dom.tags.append("#text")
            dom.parents.append(node)
            dom.words.append(())
            dom.text.append(0)
            dom.link_text.append(0)
            node = len(dom.tags) - 1
        dom.text[node] += n
        dom.link_text[node] += in_links
        dom.blocks.append((node, clean))
    return dom


#: Edges differ by the child: loose text, an element without class, id and role, one with.
LOOSE, PLAIN, NAMED = 0, 1, 2


def kind_of(dom: Dom, i: int) -> int:
    return LOOSE if dom.tags[i] == "#text" else NAMED if dom.words[i] else PLAIN


def evidence(dom: Dom, i: int) -> list[tuple[str, str]]:
    """What is seen of a node: (kind, value) pairs, taken as independent given its label."""
    n = dom.text[i]
    out = [("tag", dom.tags[i] + "+" * (kind_of(dom, i) == NAMED)), ("length", str(0 if n == 0 else min(6, 1 + int(math.log(n, 4)))))]
    if n:
        out.append(("links", str(round(3 * dom.link_text[i] / n))))
    out += [("word", w) for w in set(dom.words[i])]
    return out


@dataclass
class Model:
    root: list[float]  # P(label of the root)
    edges: list[list[list[float]]]  # per kind of child: P(child label | parent label), parent first
    seen: dict[tuple[str, str], tuple[float, ...]]  # log P(value | label)
    cache: dict = field(default_factory=dict)

    def unary(self, dom: Dom, i: int) -> list[float]:
        """Likelihood of a node's evidence under each label, scaled to a maximum of 1."""
        key = tuple(evidence(dom, i))
        got = self.cache.get(key)
        if got is None:
            logs = [sum(x) for x in zip(*(self.seen[k] for k in key if k in self.seen), strict=True)] or [0.0] * LABELS
            got = [math.exp(x - max(logs)) for x in logs]
            if len(self.cache) > 50_000:
                self.cache.clear()
            self.cache[key] = got
        return got

    def marginals(self, dom: Dom) -> list[float]:
        """P(content) of every node, by sum-product messages up and down the tree."""
        n, every = len(dom.tags), range(LABELS)
        edges = [self.edges[kind_of(dom, i)] for i in range(n)]
        up = [list(self.unary(dom, i)) for i in range(n)]
        message: list[list[float]] = [[]] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            own, p = up[i], up[dom.parents[i]]
            m = [sum(e[y] * own[y] for y in every) for e in edges[i]]
            total = sum(m)
            message[i] = m = [x / total for x in m]
            for y in every:
                p[y] *= m[y]
            total = max(p)
            for y in every:
                p[y] /= total
        out: list[list[float]] = [[]] * n
        out[0] = _unit([r * u for r, u in zip(self.root, up[0], strict=True)])
        for i in range(1, n):
            # The parent's belief without this child's own message, passed down the edge.
            rest = [b / max(m, 1e-300) for b, m in zip(out[dom.parents[i]], message[i], strict=True)]
            out[i] = _unit([sum(rest[x] * edges[i][x][y] for x in every) * up[i][y] for y in every])
        return [o[CONTENT] for o in out]

    def extract(self, page: str | None, bar: float = 0.5) -> str:
        dom = parse(page)
        if not dom.blocks:
            return ""
        p = self.marginals(dom)
        return "\n".join(t for i, t in dom.blocks if p[i] > bar)


def _unit(xs: list[float]) -> list[float]:
    total = sum(xs)
    return [x / total for x in xs] if total > 0 else [1 / len(xs)] * len(xs)


def train(labelled: list[tuple[str, list[int]]], smooth: float = 0.3) -> Model:
    """Counts over pages with a label per block element, in document order after the root (a frame).

    ``#text`` nodes have their parent's label, and are content in a frame.
    """
    edges = np.full((3, LABELS, LABELS), smooth)
    counts: dict[str, dict[str, list[float]]] = defaultdict(lambda: defaultdict(lambda: [smooth] * LABELS))
    nodes = [0.0] * LABELS
    for page, labels in labelled:
        dom = parse(page)
        labels = [FRAME, *labels]
        if len(labels) != dom.elements:
            raise ValueError(f"{len(labels) - 1} labels for {dom.elements - 1} block elements")
        labels += [CONTENT if labels[p] == FRAME else labels[p] for p in dom.parents[dom.elements :]]
        for i in range(1, len(labels)):
            y = labels[i]
            edges[kind_of(dom, i), labels[dom.parents[i]], y] += 1
            nodes[y] += 1
            for kind, value in evidence(dom, i):
                counts[kind][value][y] += 1
    seen = {}
    for kind, values in counts.items():
        total = [nodes[y] + smooth if kind == "word" else sum(v[y] for v in values.values()) for y in range(LABELS)]
        for value, v in values.items():
            seen[kind, value] = tuple(math.log(v[y] / total[y]) for y in range(LABELS))
    return Model([0.001, 0.001, 0.998], (edges / edges.sum(axis=2, keepdims=True)).tolist(), seen)


class _Page:
    """Builds a labelled page: every opened block element brings its label."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.html, self.labels = rng, [], []

    def pick(self, *xs: str) -> str:
        return xs[int(self.rng.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, a: int, b: int) -> str:
        return " ".join("".join(self.pick("la", "en", "ti", "or", "ne", "sa") for _ in range(int(self.rng.integers(1, 5)))) for _ in range(int(self.rng.integers(a, b))))

    def el(self, tag: str, label: int, inside, attrs: str = "") -> None:
        if label == BOILERPLATE and tag in ("nav", "footer", "aside", "header", "form") and self.chance(0.4):
            attrs = ""  # the tag says it
        self.html.append(f"<{tag}{' ' + attrs if attrs else ''}>")
        self.labels.append(label)
        inside() if callable(inside) else self.html.append(inside)
        self.html.append(f"</{tag}>")

    def any_class(self) -> str:
        return f'class="{self.pick(*"qrstuvwxyz")}{self.pick(*"abcdefgh")}"'

    def menu(self, n: int) -> None:
        self.el("ul", 0, lambda: [self.el("li", 0, f'<a href="/x">{self.words(1, 3)}</a>') for _ in range(n)])

    def sentence_block(self, label: int, tag: str = "p") -> None:
        text = self.words(1, 6) if self.chance(0.15) else self.words(8, 120)
        if self.chance(0.2):
            text = f'<b>{text}</b> <a href="/y">{self.words(1, 4)}</a> {self.words(3, 30)}'
        named = label == CONTENT and self.chance(0.2)
        self.el(tag, label, text, self.pick('class="lead"', 'class="intro"', 'id="p1"', 'class="text"', 'class="body-text"', self.any_class()) if named else "")

    def loose(self) -> None:
        """Lines that stand in the element around them, without one of their own."""
        self.html.append("<br>".join(self.words(4, 60) for _ in range(int(self.rng.integers(1, 4)))))

    def small_print(self, tag: str, attrs: str) -> None:
        kind = self.rng.random()
        if kind < 0.5:
            self.el(tag, 0, self.words(3, 25), attrs)
        elif kind < 0.8:
            self.el(tag, 0, lambda: [self.loose() if self.chance(0.2) else self.sentence_block(0) for _ in range(int(self.rng.integers(1, 3)))], attrs)
        else:
            self.el(tag, 0, lambda: self.menu(int(self.rng.integers(2, 6))), attrs)

    def form(self) -> None:
        def inside() -> None:
            self.html.append(f'<label>{self.words(1, 3)}</label><input name="q">')
            if self.chance(0.5):
                self.el("p", 0, self.words(3, 15))
            self.el("button", 0, self.words(1, 3))

        self.el("form", 0, inside, self.pick("", 'class="search"', 'class="newsletter subscribe"', 'id="login"'))

    def comments(self) -> None:
        def one() -> None:
            self.el(self.pick("p", "div"), 0, self.words(4, 60))

        def inside() -> None:
            self.el(self.pick("h2", "h3"), 0, self.words(1, 3))
            for _ in range(int(self.rng.integers(1, 5))):
                self.el(self.pick("div", "article", "li"), 0, one, self.pick('class="comment"', 'class="comment-body reply"', 'class="user comment"'))

        self.el(self.pick("section", "div"), 0, inside, self.pick('id="comments"', 'class="comments"', 'class="comment-list discussion"', 'class="responses comments"'))

    def junk(self) -> None:
        kind = self.pick("ad", "ad", "notice", "form", "share", "side")
        if kind == "ad":
            self.small_print(self.pick("div", "div", "aside", "p", "section"), self.pick('class="ad"', 'class="advert"', 'class="ads banner"', 'id="ad-top"', 'class="advertisement sponsored"', 'class="promo"', 'class="sponsor"'))
        elif kind == "notice":
            self.small_print(self.pick("div", "section", "aside"), self.pick('class="cookie-notice"', 'class="cookie banner"', 'id="consent"', 'class="notice"', 'class="gdpr privacy popup"', 'class="alert modal"', 'role="alert"', 'role="dialog"', 'class="paywall notice"'))
        elif kind == "form":
            self.form()
        elif kind == "share":
            self.small_print("div", self.pick('class="share social"', 'class="related"', 'class="breadcrumb"', 'class="pagination pager"', 'class="tags meta"', 'class="recommended more"'))
        else:
            self.sidebar()

    def sidebar(self) -> None:
        self.small_print(self.pick("aside", "aside", "div"), self.pick('class="sidebar"', 'id="sidebar"', 'class="widget sidebar"', 'role="complementary" class="side"', 'class="rail aside"'))

    def article(self) -> None:
        def inside() -> None:
            if self.chance(0.8):
                self.el("h1", 1, self.words(2, 12))
            for _ in range(int(self.rng.integers(1, 14))):
                kind = self.rng.random()
                if kind < 0.05:
                    self.loose()
                elif kind < 0.72:
                    self.sentence_block(1)
                elif kind < 0.79:
                    self.el(self.pick("h2", "h3", "h4"), 1, self.words(1, 9))
                elif kind < 0.84:
                    self.el(self.pick("ul", "ol"), 1, lambda: [self.el("li", 1, self.words(2, 25)) for _ in range(int(self.rng.integers(2, 6)))])
                elif kind < 0.88:
                    self.el("blockquote", 1, lambda: self.sentence_block(1))
                elif kind < 0.90:
                    self.el("pre", 1, self.words(4, 40))
                elif kind < 0.92:
                    self.el("table", 1, lambda: [self.el("tr", 1, lambda: [self.el("td", 1, self.words(1, 6)) for _ in range(2)]) for _ in range(3)])
                elif kind < 0.94:
                    self.el("figure", 1, lambda: self.el("figcaption", 1, self.words(3, 15)))
                elif kind < 0.97:
                    self.el(self.pick("div", "section"), 1, lambda: [self.sentence_block(1) for _ in range(2)])
                else:
                    self.junk()
            if self.chance(0.1):
                self.comments()

        kind = self.rng.random()
        if kind < 0.08:  # without an element around it
            for _ in range(int(self.rng.integers(1, 7))):
                self.loose() if self.chance(0.4) else self.sentence_block(1, self.pick("p", "p", "p", "h2"))
                self.html.append(self.pick("", "<hr>"))
        elif kind < 0.13:
            self.el("div", 1, lambda: [self.loose(), self.html.append("<br><br>"), self.loose()], self.pick("", 'class="content"', 'class="text"', self.any_class()))
        elif kind < 0.55:
            self.el("article", 1, inside, self.pick("", "", 'class="post"', self.any_class()))
        elif kind < 0.75:
            self.el("main", 1, inside, self.pick("", 'id="content"', 'role="main"'))
        elif kind < 0.95:
            self.el("div", 1, inside, self.pick('class="content"', 'id="main"', 'class="article-body"', 'class="post entry"', 'class="story text"', 'id="content" class="main"'))
        else:
            self.el("div", 1, inside)

    def make(self) -> tuple[str, list[int]]:
        self.html.append("<!DOCTYPE html>")

        def head() -> None:
            self.el("title", 0, self.words(2, 9))
            self.html.append("<style>p{margin:0}</style><script>var a='</p>';</script>")

        def body() -> None:
            if self.chance(0.4):
                self.el("header", 0, lambda: (self.el(self.pick("h1", "h2", "p", "div"), 0, self.words(1, 5)), self.menu(3) if self.chance(0.5) else None))
            elif self.chance(0.3):
                self.small_print("div", self.pick('class="header"', 'id="header"', 'class="masthead top"'))
            if self.chance(0.8):
                self.el(self.pick("nav", "nav", "nav", "div"), 0, lambda: self.menu(int(self.rng.integers(3, 9))), self.pick('class="nav menu"', 'id="menu"', 'class="navigation"'))
            for _ in range(int(self.rng.integers(0, 3))):
                self.junk()
            self.article() if self.chance(0.75) else self.el("div", 2, lambda: (self.article(), self.sidebar()), self.pick('class="wrapper"', 'class="container"', 'id="page"', ""))
            for _ in range(int(self.rng.integers(0, 3))):
                self.junk()
            if self.chance(0.3):
                self.comments()
            if self.chance(0.85):
                self.small_print(self.pick("footer", "footer", "footer", "div"), self.pick('class="footer"', 'id="footer"', 'class="footer copyright"'))

        self.el("html", 2, lambda: (self.el("head", 0, head), self.el("body", 2, body)))
        return "".join(self.html), self.labels


def labelled_pages(count: int = 400, seed: int = 3) -> list[tuple[str, list[int]]]:
    """A made, seeded set of pages with a label per block element."""
    rng = np.random.default_rng(seed)
    return [_Page(rng).make() for _ in range(count)]


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """Adds ``main_text`` to every row."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in pages.columns if c != "main_text"]
    where = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [model.extract(h) for h in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string())], names=[*kept, "main_text"])

    return pages.mapInArrow(run, T.StructType([f for f in pages.schema.fields if f.name != "main_text"] + [T.StructField("main_text", T.StringType())]))
