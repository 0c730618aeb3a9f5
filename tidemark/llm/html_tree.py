"""Main-text extraction by a tree-structured graphical model over the DOM.

Each run of text is a node that is content or not, each block element one that
holds content or not.
Node potentials come from tags, class words and text shape; parent-child
potentials connect the nodes.  Sum-product messages, up the tree and down again,
give exact content marginals; runs that are more likely content than not are the
text.  Weights are trained from labelled pages by maximum likelihood.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import read_columns, reserved, table

_TOKEN = re.compile(
    r"""<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[.{0,4096}?\]\]>|<[!?/](?![a-zA-Z])[^>]*>|<![^>]*>"""
    r"""|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"""
    r"""|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]{0,4096}+"|'[^']{0,4096}+')*+|[^>]*)>""",
    re.DOTALL,
)
_UNENDED = re.compile(r"<[a-zA-Z!?/]")
_NAMED = re.compile(r"""(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: HTML's elements by how they break text up.
RAW = frozenset("script style template noscript svg math iframe textarea title object canvas audio video select datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr link meta base".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Starting one of these ends an open one of those, up to the nearest of the last.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "body": (("head",), ()),
}
TAGS = (
    "#text html head body div section article main p h1 h2 h3 h4 h5 h6 nav header footer aside form fieldset label button legend "
    "ul ol li dl dt dd table thead tbody tr td th caption blockquote pre figure figcaption details summary dialog address center menu hgroup search"
).split()
WORDS = (
    "ad ads advert advertisement sponsor sponsored promo promoted banner cookie consent gdpr notice alert popup modal overlay paywall "
    "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc header masthead top topbar logo footer foot bottom copyright legal "
    "sidebar side aside widget rail related recommended more popular trending comment comments reply replies discussion disqus respond reviews "
    "share sharing social follow subscribe newsletter signup login search form tags meta byline skip tool toolbar hidden "
    "content main article post entry story body text page blog articlebody maincontent"
).split()
_TAG = {t: i for i, t in enumerate(TAGS)}
_OTHER = len(TAGS)
_WORD = {w: len(TAGS) + 1 + i for i, w in enumerate(WORDS)}
_SHAPE = len(TAGS) + 1 + len(WORDS)
#: Shape features: 8 of length, 5 of link share, then stop, comma, copyright, bar, is under form, chain of list, bias.
FEATURES = _SHAPE + 24
#: Kinds of parent-child pair, by the child.
KINDS = {"#text": 0, "p": 1, "li": 3, "td": 3, "dd": 3, "dt": 3, "ul": 4, "ol": 4, "dl": 4, "table": 4, "div": 5, "section": 5, "article": 6, "main": 6}
KINDS |= dict.fromkeys("h1 h2 h3 h4 h5 h6 blockquote pre figure".split(), 2) | dict.fromkeys("nav header footer aside form".split(), 7)
N_KINDS = 9
#: Depth of the tree, at most.
MAX_DEPTH = 512


@dataclass
class Tree:
    """Nodes in page order, each after its parent; runs of text are leaves."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    words: list[list[int]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, words: list[int], text: str | None = None, linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


@lru_cache(4096)
def attribute_words(attrs: str) -> list[int]:
    found = {_WORD[w] for value in _NAMED.findall(attrs) for x in _WORDS.findall(value) if (w := x.lower()) in _WORD}
    found |= {_WORD[w] for value in _NAMED.findall(attrs) if (w := value.strip("\"'").lower().replace("-", "").replace("_", "")) in _WORD}
    if _HIDDEN.search(attrs):
        found.add(_WORD["hidden"])
    return sorted(found)


def parse(page: str | None) -> Tree:
    """A tolerant reading of any string, in linear time: unclosed, misnested and stray tags are put right as browsers do, roughly.

    What is nested deeper than MAX_DEPTH hangs on the element at that depth, as in
    browsers; no text is lost.
    """
    tree = Tree()
    stack = [tree.add("html", -1, [])]
    opened: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    seen: set[str] = set()
    run: list[tuple[str, bool]] = []
    links = 0

    def cut(down: int):
        while len(stack) > down:
            opened[tree.tag[stack.pop()]].pop()

    def push(tag: str, words: list[int]):
        seen.add(tag)
        opened[tag].append(len(stack))
        stack.append(tree.add(tag, inmost(), words))

    def inmost() -> int:
        return stack[min(len(stack), MAX_DEPTH) - 1]

    def flush():
        nonlocal links
        if run:
            text = " ".join("".join(html.unescape(t) for t, _ in run).split())
            if text:
                body()
                tree.add("#text", inmost(), [], text, sum(len(t) for t, a in run if a))
            run.clear()

    def body():
        """What is in no body yet opens one, as in browsers."""
        if tree.tag[stack[-1]] in ("html", "head"):
            cut(1)
            push("body", [])

    def close(down: int):
        nonlocal links
        flush()
        cut(down)
        links = 0

    at, page = 0, page or ""
    limit = page.rfind(">") + 1  # beyond it no tag ends
    while m := _TOKEN.search(page, at, limit):
        if m.start() > at:
            run.append((page[at : m.start()], links > 0))
        at = m.end()
        if name := m["tag"]:
            name = name.lower()
            if name in RAW:
                if not m["attrs"].rstrip().endswith("/") or name not in ("svg", "math"):
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                    at = end.end() if end else len(page)
            elif name in INLINE:
                links += name == "a" and links == 0
            elif name in VOID:
                flush()
            elif name in ("html", "frameset") or name == "body" and "body" in seen:
                continue
            else:
                if name in ENDS:
                    inner, outer = ENDS[name]
                    above = max((opened[t][-1] for t in outer if opened[t]), default=0)
                    below = [opened[t][k] for t in (*inner, "p") if (k := bisect(opened[t], above)) < len(opened[t])]
                    if below:
                        close(min(below))
                else:
                    while len(stack) > 1 and ((t := tree.tag[stack[-1]]) == "p" or t == name and name[0] == "h" and name[1:].isdigit()):
                        close(len(stack) - 1)
                flush()
                if name not in ("head", "body"):
                    body()
                push(name, attribute_words(m["attrs"] or ""))
        elif name := m["end"]:
            name = name.lower()
            if name == "a":
                links = 0
            elif name in INLINE or name in ("body", "html"):
                continue
            elif name == "p" or name == "br":
                flush()
                if name == "p" and tree.tag[stack[-1]] == "p":
                    close(len(stack) - 1)
            else:
                if opened[name]:
                    close(opened[name][-1])
                else:
                    flush()
    if at < len(page):  # browsers drop a tag that never ends
        run.append((_UNENDED.split(page[at:], 1)[0], links > 0))
    flush()
    return tree


@dataclass
class Forest:
    """The trees of many pages as flat arrays."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    node: np.ndarray  # of each feature
    feature: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 1)))[1:]


def plant(trees: list[Tree]) -> Forest:
    parents, depths, kinds, nodes, found = [], [], [], [], []
    base = 0
    for t in trees:
        n = len(t.tag)
        size, linked, depth = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if t.text[i] is not None:
                size[i], linked[i] = len(t.text[i]), min(t.linked[i], len(t.text[i]))
            if i:
                size[t.parent[i]] += size[i]
                linked[t.parent[i]] += linked[i]
        for i in range(n):
            if i:
                depth[i] = depth[t.parent[i]] + 1
            share = linked[i] / size[i] if size[i] else 0.0
            f = [_TAG.get(t.tag[i], _OTHER), _SHAPE + 23]
            f += t.words[i]
            f.append(_SHAPE + min(7, max(0, size[i].bit_length() - 2)))
            f.append(_SHAPE + 8 + (share > 0) + (share > 0.3) + (share > 0.6) + (share > 0.95))
            if (x := t.text[i]) is not None:
                f += [_SHAPE + 13 + k for k, c in enumerate((x[-1] in ".!?…:;\"”»", "," in x, "©" in x, "|" in x)) if c]
            nodes += [base + i] * len(f)
            found += f
            parents.append(base + t.parent[i] if i else -1)
            kinds.append(KINDS.get(t.tag[i], 8))
        depths += depth
        base += n
    return Forest(*(np.array(x, np.int64) for x in (parents, depths, kinds, nodes, found)))


@dataclass
class Weights:
    node: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    pair: np.ndarray = field(default_factory=lambda: np.zeros((N_KINDS, 2, 2)))  # kind, parent, child


def sum_product(forest: Forest, w: Weights) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each node (n x 2) and of each parent-child pair (n x 2 x 2), and the log of the partition functions."""
    n = len(forest.parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = np.bincount(forest.node, w.node[forest.feature], n)
    own, pair = belief, w.pair[forest.kind]
    up = np.zeros((n, 2))
    for level in reversed(forest.levels):
        up[level] = np.logaddexp.reduce(pair[level] + own[level][:, None, :], axis=2)
        np.add.at(own, forest.parent[level], up[level])
    roots = np.flatnonzero(forest.parent < 0)
    log_z = float(np.logaddexp.reduce(own[roots], axis=1).sum())
    joint = np.zeros((n, 2, 2))
    total = own.copy()
    for level in forest.levels:
        above = total[forest.parent[level]] - up[level]  # the parent without what this child told it
        x = above[:, :, None] + pair[level] + own[level][:, None, :]
        total[level] = np.logaddexp.reduce(x, axis=1)
        joint[level] = x
    z = np.logaddexp.reduce(total, axis=1)
    return np.exp(total - z[:, None]), np.exp(joint - z[:, None, None]) * (forest.parent >= 0)[:, None, None], log_z


def train(pages: list[tuple[str, set[str]]], steps: int = 250, rate: float = 0.2, decay: float = 0.0002) -> Weights:
    """Maximum likelihood over labelled pages: (html, the texts of its content runs).

    A run is content if its text is listed, an element if some run below it is.
    """
    trees = [parse(p) for p, _ in pages]
    label = np.concatenate([labels_of(t, content) for t, (_, content) in zip(trees, pages)])
    forest, w = plant(trees), Weights()
    child = np.flatnonzero(forest.parent >= 0)
    seen_node = np.bincount(forest.feature, label[forest.node], FEATURES)
    seen_pair = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen_pair, (forest.kind[child], label[forest.parent[child]], label[child]), 1)
    moments = [np.zeros(FEATURES + N_KINDS * 4) for _ in range(2)]
    for t in range(1, steps + 1):
        node, joint, _ = sum_product(forest, w)
        expected = np.zeros((N_KINDS, 2, 2))
        np.add.at(expected, forest.kind[child], joint[child])
        slope = np.concatenate([seen_node - np.bincount(forest.feature, node[forest.node, 1], FEATURES), (seen_pair - expected).ravel()]) / len(pages)
        slope -= decay * np.concatenate([w.node, w.pair.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        step = rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-8)
        w = Weights(w.node + step[:FEATURES], w.pair + step[FEATURES:].reshape(N_KINDS, 2, 2))
    return w


def labels_of(tree: Tree, content: set[str]) -> np.ndarray:
    label = np.array([x is not None and x in content for x in tree.text], np.int64)
    for i in range(len(label) - 1, 0, -1):
        label[tree.parent[i]] |= label[i]
    return label


def extract(pages: list[str | None], w: Weights) -> list[list[str]]:
    """The content runs of each page, in page order."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    content = sum_product(plant(trees), w)[0][:, 1] > 0.5
    out, base = [], 0
    for t in trees:
        out.append([x for i, x in enumerate(t.text) if x is not None and content[base + i]])
        base += len(t.tag)
    return out


def extract_main_text(pages: DataFrame, weights: Weights, html_column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text in a new column; a map, nothing is shuffled.

    Null, empty and markup-only pages have an empty text; whole pages are read,
    whatever their length; repeated rows are each read; an empty table gives no
    rows.  Other columns pass through; ``name`` must not be one of them.
    """
    reserved(pages, name)
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def read(source: list[str | None]):
        texts = []
        for k in range(0, len(source), 64):
            texts += ["\n".join(x) for x in extract(source[k : k + 64], sent.value)]
        return (texts,)

    return read_columns(pages, html_column, {name: "string"}, read)


def op6_tree_marginals(spark, sf_dir, training_pages=600):
    from tidemark.llm.html_pages import labelled_pages

    weights = train(labelled_pages(training_pages))
    found = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), weights)
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
