"""Main text of pages by a tree-structured graphical model over DOM nodes.

A page is a tree of block elements and runs of text (``html_tree``).  Each node has main text below it or
has none; its potential is linear in features of its tag, names, size, links and place, and each pair of
parent and child has a table of four potentials by the kinds of the two.  Sum-product messages pass up
from the leaves and down again, level by level for many pages at once, and give exact marginals.  Weights
are fitted to labelled pages by the same messages: the gradient is what was seen minus what is expected.
A page's text is that of the leaves whose marginal is one half or more.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import table
from sparkloom.llm.html_pages import labelled_pages
from sparkloom.llm.html_tree import Tree, parse

#: The model is fitted on so many made pages (``html_pages``), in so many steps.
TRAIN_PAGES, STEPS, PENALTY = 2500, 140, 2e-5
#: Logs of ratios are held within this, so that products of two fit a double.
MOST = 150.0
#: Characters of pages whose trees are held at once; a longer page is held alone.
HELD = 2 << 20
#: Parts of names that tell regions apart.
STEMS = (
    "comment disqus repl respond discuss cookie consent gdpr privacy notice alert popup modal overlay nav menu breadcrumb pagin pager toc sidebar side aside rail widget related recommend trending advert sponsor promo commercial adsby "
    "head masthead topbar brand logo foot bottom copyright colophon legal share sharing social follow tag toolbar print newsletter subscri signup search login form article content post entry story main body text single prose"
).split()
_TAGS = "#page #text article main section div aside nav header footer form fieldset table tbody tr td th ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address dialog details summary center hgroup menu".split()
TAG = {t: k for k, t in enumerate(_TAGS)}
OTHER = len(TAG)
SECTIONS = frozenset("section div aside nav header footer form fieldset table tbody tr td th ul ol dl dialog details center menu #page".split())
#: Kinds of nodes in pairs: leaf, main element, part of a page, other block.
KINDS = 4
_KIND = np.array([0 if t == "#text" else 1 if t in ("article", "main") else 2 if t in SECTIONS else 3 for t in _TAGS] + [2])
#: Numbers in steps, each step a feature; see ``_numbers``.
_STEPS = [
    np.array([2, 4, 8, 15, 30, 60, 120, 300]), np.array([0.01, 0.2, 0.4, 0.6, 0.8, 0.95]), np.array([0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98]), np.array([0.005, 0.02, 0.05, 0.1, 0.25, 0.5, 0.8]),
    np.array([1.5, 2.5, 4.5, 9.5, 20.5]), np.array([2, 4, 8, 16, 32]), np.array([0.1, 0.5, 0.9]), np.array([1.5, 2.5, 3.5, 5.5, 8.5]), np.array([0.5]), np.array([0.5]),
]


@dataclass
class Forest:
    """Nodes of many trees, parents before children; ``features`` are the ids from ``first`` on."""

    parent: np.ndarray
    level: np.ndarray
    tag: np.ndarray
    page: np.ndarray
    features: np.ndarray
    first: np.ndarray
    levels: list[np.ndarray]

    def pair(self) -> np.ndarray:
        """The kind of each node's pair with its parent."""
        kind = _KIND[self.tag]
        return np.where(self.parent >= 0, KINDS * kind[np.maximum(self.parent, 0)] + kind, 0)


@functools.lru_cache(1 << 14)
def name_features(words: tuple[str, ...]) -> tuple[str, ...]:
    """Whole words, and the stems in them: names differ in how parts are joined."""
    found = dict.fromkeys(f"={w}" for w in words)
    found.update((f"~{s}", None) for w in words for s in STEMS if s in w)
    return tuple(found)


def _numbers(trees: list[Tree], parent: np.ndarray, level: np.ndarray, levels: list[np.ndarray], page: np.ndarray) -> np.ndarray:
    """By node: words, share of linked characters, place in the page, share of its text, leaves, words a leaf,
    share of leaves that end like sentences, depth, a sign of rights or of a list of links, whether the tree has main elements."""
    texts = [x for t in trees for x in t.text]
    linked = np.array([x for t in trees for x in t.linked], np.float64)
    size = np.array([len(x) if x else 0 for x in texts], np.float64)
    words = np.array([x.count(" ") + 1 if x else 0 for x in texts], np.float64)
    leaf = np.array([x is not None for x in texts])
    ends = np.array([bool(x) and x.rstrip("\"'»”)")[-1:] in ".!?…:;。" for x in texts], np.float64)
    sign = np.array([bool(x) and ("©" in x or " | " in x or " · " in x) for x in texts], np.float64)
    before = np.cumsum(size) - size
    start = before.copy()
    sums = np.stack((size, words, linked, leaf.astype(np.float64), ends), 1)
    for at in reversed(levels[1:]):
        np.add.at(sums, parent[at], sums[at])
    size, words, linked, leaves, ends = sums.T
    first = np.flatnonzero(parent < 0)
    total, origin = np.maximum(size[first], 1)[page], before[first][page]
    n = np.maximum(leaves, 1)
    main = np.bincount(page, weights=[t in ("article", "main") for x in trees for t in x.tag], minlength=len(trees)) > 0
    return np.stack((words, linked / np.maximum(size, 1), (start + size / 2 - origin) / total, size / total, leaves, words / n, ends / n, level, sign, main[page]), 1)


def _levels(level: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(level, kind="stable")
    return np.split(order, np.searchsorted(level[order], np.arange(1, int(level.max(initial=0)) + 1)))


def forest(trees: list[Tree], vocabulary: dict[str, int]) -> Forest:
    sizes = np.array([len(t.parent) for t in trees])
    offset = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(trees)), sizes)
    own = np.array([p for t in trees for p in t.parent])
    parent = np.where(own >= 0, own + offset[page], -1)
    flat: list[int] = []
    for t in trees:
        depth: list[int] = []
        for p in t.parent:
            depth.append(depth[p] + 1 if p >= 0 else 0)
        flat += depth
    level = np.array(flat)
    levels = _levels(level)
    tag = np.array([TAG.get(x, OTHER) for t in trees for x in t.tag])
    numbers = _numbers(trees, parent, level, levels, page)
    leaf = tag == TAG["#text"]
    columns = [np.zeros(len(tag), np.int64), 1 + tag]
    base = 2 + OTHER
    #: A leaf's features are its own; its tag's place is taken by its parent's.
    columns.append(np.where(leaf, base + tag[np.maximum(parent, 0)], -1))
    base += 1 + OTHER
    #: A tag means another thing inside of a main element than beside it.
    own_main = _KIND[tag] == 1
    inside = np.zeros(len(tag), bool)
    for at in levels[1:]:
        inside[at] = inside[parent[at]] | own_main[parent[at]]
    columns.append(base + 2 * tag + inside)
    base += 2 * (1 + OTHER)
    for k, steps in enumerate(_STEPS):
        columns.append(base + np.searchsorted(steps, numbers[:, k], "right") + leaf * (len(steps) + 1))
        base += 2 * (len(steps) + 1)
    dense = np.stack(columns, 1)
    node, _ = np.nonzero(dense >= 0)
    ids = dense[dense >= 0]
    named = [(i, base + vocabulary[f]) for i, w in enumerate(w for t in trees for w in t.words) if w for f in name_features(w) if f in vocabulary]
    if named:
        at, more = np.array(named).T
        node, ids = np.concatenate((node, at)), np.concatenate((ids, more))
        order = np.argsort(node, kind="stable")
        node, ids = node[order], ids[order]
    return Forest(parent, level, tag, page, ids, np.searchsorted(node, np.arange(len(tag))), levels)


def width(vocabulary: dict[str, int]) -> int:
    return 5 + 4 * OTHER + sum(2 * (len(s) + 1) for s in _STEPS) + len(vocabulary)


def sum_product(f: Forest, score: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(main text) of each node, P(parent's state, own state) of each pair with a parent).

    ``score`` is a node's evidence for main text; ``pairs`` are (kind, parent's state, own state) potentials.
    A message between two nodes of two states is one number, the log of its ratio.
    """
    none_none, none_some, some_none, some_some = np.exp(pairs)[f.pair()].reshape(-1, 4).T
    belief = score.astype(np.float64)
    up, below = np.zeros_like(belief), np.ones_like(belief)
    for at in reversed(f.levels[1:]):
        below[at] = x = np.exp(np.clip(belief[at], -MOST, MOST))
        up[at] = np.log((some_none[at] + some_some[at] * x) / (none_none[at] + none_some[at] * x))
        np.add.at(belief, f.parent[at], up[at])
    joint = np.zeros((len(belief), 4))
    for at in f.levels[1:]:  # belief now has what came up; what comes down is added
        y = np.exp(np.clip(belief[f.parent[at]] - up[at], -MOST, MOST))
        belief[at] += np.log((none_some[at] + some_some[at] * y) / (none_none[at] + some_none[at] * y))
        joint[at] = np.stack((none_none[at], none_some[at] * below[at], some_none[at] * y, some_some[at] * y * below[at]), 1)
    joint /= np.maximum(joint.sum(1, keepdims=True), 1e-300)
    return 1 / (1 + np.exp(-np.clip(belief, -MOST, MOST))), joint.reshape(-1, 2, 2)


def targets(trees: list[Tree], f: Forest) -> np.ndarray:
    """Whether a node has main text below it, from the labels of leaves; without a label a leaf is main text."""
    state = np.array([x is not None and label != "0" for t in trees for x, label in zip(t.text, t.label, strict=True)])
    for at in reversed(f.levels[1:]):
        np.logical_or.at(state, f.parent[at], state[at])
    return state.astype(np.int64)


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, f: Forest) -> np.ndarray:
        return sum_product(f, self.score(f), self.pairs)[0]

    def score(self, f: Forest) -> np.ndarray:
        return np.add.reduceat(self.weights[f.features], f.first)


def fit(pages: list[str], steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """Weights by penalised likelihood of labelled pages (``data-label`` attributes), with Adam's steps on all of them."""
    trees = [parse(p) for p in pages]
    seen: dict[str, int] = {}
    for t in trees:
        for w in t.words:
            for name in name_features(w):
                seen[name] = seen.get(name, 0) + 1
    vocabulary = {name: k for k, name in enumerate(sorted(name for name, n in seen.items() if n >= 3))}
    f = forest(trees, vocabulary)
    y = targets(trees, f)
    kind, size = f.pair(), width(vocabulary)
    node = np.repeat(np.arange(len(y)), np.diff(np.append(f.first, len(f.features))))
    inner = np.flatnonzero(f.parent >= 0)
    model = Model(vocabulary, np.zeros(size), np.zeros((KINDS * KINDS, 2, 2)))
    real = np.zeros_like(model.pairs)
    np.add.at(real, (kind[inner], y[f.parent[inner]], y[inner]), 1)
    flat = lambda a, b: np.concatenate((a, b.ravel()))
    at, first, second = flat(model.weights, model.pairs), 0.0, 0.0
    for k in range(1, steps + 1):
        p, joint = sum_product(f, model.score(f), model.pairs)
        expected = np.zeros_like(real)
        np.add.at(expected, kind[inner], joint[inner])
        slope = flat(np.bincount(f.features, weights=(y - p)[node], minlength=size), real - expected) / len(y) - penalty * at
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        at = at + 0.1 * (1 - 0.9 * k / steps) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        model.weights, model.pairs = at[:size], at[size:].reshape(real.shape)
    return model


@functools.lru_cache(2)
def trained(pages: int = TRAIN_PAGES) -> Model:
    return fit(labelled_pages(pages))


def texts(pages: list[str], model: Model) -> list[str]:
    """Main text of each page."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    f = forest(trees, model.vocabulary)
    main = model.marginals(f) >= 0.5
    out, at = [], 0
    for t in trees:
        out.append("\n".join(x for x, m in zip(t.text, main[at : at + len(t.text)], strict=True) if x is not None and m))
        at += len(t.text)
    return out


def extract(df: DataFrame, page: str, model: Model | None = None, text: str = "text") -> DataFrame:
    """``df`` with the main text of its pages and ``n_chars``, its code points, in place of ``page``.

    Null, empty and blank pages have an empty text, a page without markup is text as a whole, and very long
    pages are taken whole.  Rows that repeat are done each.  Columns named like the results are replaced.
    """
    model = model or trained()
    kept = [c for c in df.columns if c not in (page, text, "n_chars")]
    inside = [f"c{k}" for k in range(len(kept))]
    kinds = "".join(f"{i} {df.schema[c].dataType.simpleString()}, " for i, c in zip(inside, kept, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [p or "" for p in batch.column(len(kept)).to_pylist()]
            start = 0
            while start < len(pages):
                stop, held = start + 1, len(pages[start])
                while stop < len(pages) and held + len(pages[stop]) <= HELD:
                    held += len(pages[stop])
                    stop += 1
                found = texts(pages[start:stop], model)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*inside, "text", "n_chars"])
                start = stop

    out = df.select(*[F.col(f"`{c}`").alias(i) for i, c in zip(inside, kept, strict=True)], F.col(page).cast("string").alias("page")).mapInArrow(run, f"{kinds}text string, n_chars bigint")
    return out.select(*[F.col(i).alias(c) for i, c in zip(inside, kept, strict=True)], F.col("text").alias(text), "n_chars")


def op11_tree_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``; see ``extract``."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "html").select("page_id", "url", "text", "n_chars")


#: The table's pages mark their main text as an article; SQL can take it by that mark, as the model must find it.
ORACLE = r"""
WITH inside AS (
    SELECT page_id, url, string_split(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:h1|p)>', chr(1), 'g'), chr(1)) AS parts FROM pages
), plain AS (
    SELECT page_id, url, list_filter(list_transform(parts, lambda p: trim(regexp_replace(
           replace(replace(replace(replace(regexp_replace(p, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda p: p <> '') AS parts FROM inside
)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10)))::BIGINT AS n_chars FROM plain"""
