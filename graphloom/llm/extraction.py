"""Main text of web pages: gradient-boosted trees over features of block elements, and hierarchical decoding.

The trees give each element the log odds that it holds main text. Decoding keeps or drops elements so that no kept
element lies in a dropped one and the sum of the log odds of the kept ones is largest: from the leaves up, an element is
worth its own log odds and what its children are worth where that is positive, and is kept if its parent is and it is
worth more than nothing. The trees are learned on the driver from made-up pages (page_maker) whose main text is known.

What the words in classes, ids and the like tell is learned too: every word falls into a bucket by its hash, and a bucket's
weight is by how much the elements that have it hold main text more often than others, in log odds; a word that was never
seen weighs nothing. Weights come from half of the pages and trees from the other, so that trees don't trust words that
only the weights' pages have.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import slices
from .dom import Node, parse
from .page_maker import Maker

#: Pages that the model learns from, buckets of attribute tokens, and how many elements a bucket's weight is held back by.
PAGES, SEED, HASHED, HELD_BACK = 1200, 6, 4096, 2.0
TREES, DEPTH = 60, 5
TAGS = "root html body article main section div p h1 h2 h3 h4 ul ol li nav header footer aside form table tr td blockquote pre figure figcaption fieldset dialog dl".split()
TAG_ID = {t: i for i, t in enumerate(TAGS)}


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % HASHED


def token_weights(pages: list[tuple[list[Node], np.ndarray]]) -> np.ndarray:
    """Of each bucket: the log odds of main text in elements that have one of its tokens, less those of all elements."""
    seen, holding, nodes, held = np.zeros(HASHED), np.zeros(HASHED), 0, 0.0
    for page, y in pages:
        nodes, held = nodes + len(page), held + y.sum()
        for x, hold in zip(page, y):
            at = list({bucket(t) for t in x.tokens})
            seen[at] += 1
            holding[at] += hold
    share = min(max(held / max(nodes, 1), 1e-3), 1 - 1e-3)
    yes, no = holding + HELD_BACK * share, seen - holding + HELD_BACK * (1 - share)
    return np.log(yes / no) - np.log(share / (1 - share))


def features(nodes: list[Node], weights: np.ndarray) -> np.ndarray:
    """A row for each node: its tag, depth, size and density of its subtree, links, weights of attribute tokens of itself, its
    parent and ancestors, its place among its siblings and how it compares with them."""
    n = len(nodes)
    parent = np.array([max(x.parent, 0) for x in nodes])
    end = np.array([x.end for x in nodes])
    depth = np.array([x.depth for x in nodes])
    tag = np.array([TAG_ID.get(x.tag, len(TAGS)) for x in nodes])
    own = np.array([[sum(len(t) for _, t in x.runs), x.links, x.inline, sum(t.count(".") + t.count(",") for _, t in x.runs), len(x.runs)] for x in nodes], float).reshape(n, 5)
    sums = np.concatenate((np.zeros((1, 5)), np.cumsum(own, axis=0)))
    here = np.arange(n)
    chars, links, inline, stops, runs = (sums[end] - sums[here]).T
    below = end - here
    total = max(chars[0], 1)
    # least, largest and total weight of the node's own tokens, and how many it has
    told = np.zeros((n, 4))
    for i, x in enumerate(nodes):
        if x.tokens:
            w = weights[list({bucket(t) for t in x.tokens})]
            told[i] = w.min(), w.max(), w.sum(), len(w)
    above = np.column_stack([np.minimum(told[:, 0], 0), np.maximum(told[:, 1], 0), told[:, 2]])  # least, largest, total of the node and its ancestors
    tag_above = np.zeros((n, 8))  # nav header footer aside form article/main, li, table
    groups = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 4, "article": 5, "main": 5, "li": 6, "table": 7}
    index = np.zeros(n)
    children = np.zeros(n)
    for i, x in enumerate(nodes):
        if x.tag in groups:
            tag_above[i, groups[x.tag]] = 1
        if i:
            up = above[parent[i]]
            above[i] = min(above[i, 0], up[0]), max(above[i, 1], up[1]), above[i, 2] + up[2]
            tag_above[i] = np.maximum(tag_above[i], tag_above[parent[i]])
            index[i] = children[parent[i]]
            children[parent[i]] += 1
    siblings = np.maximum(children[parent], 1)
    density = chars / below
    family = np.bincount(parent[1:], chars[1:], n)[parent]
    rival = np.zeros(n)
    np.maximum.at(rival, parent[1:], chars[1:])
    before = sums[here][:, 0] / total
    cols = [depth, np.log1p(chars), np.log1p(below), np.log1p(density), chars / total, links / np.maximum(chars, 1), inline / np.maximum(chars, 1) * 100, stops / np.maximum(chars, 1) * 100,
            np.log1p(own[:, 0]), own[:, 1] / np.maximum(own[:, 0], 1), runs, index, siblings, index / siblings, children, chars / np.maximum(family, 1), chars / np.maximum(rival[parent], 1), before, density / np.maximum(density[parent], 1e-9), links[parent] / np.maximum(chars[parent], 1), tag, tag[parent]]
    one_hot = [tag == i for i in range(len(TAGS))]
    return np.column_stack([*cols, *one_hot, told, above, told[parent], above[parent], tag_above])


def labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a made-up page, and which of them hold main text."""
    nodes = parse(page)
    holds = np.zeros(len(nodes))
    inside = False
    for _, i, k in sorted((place, i, k) for i, x in enumerate(nodes) for k, (place, _) in enumerate(x.runs)):
        place, text = nodes[i].runs[k]
        inside = "\1" in text
        nodes[i].runs[k] = (place, text.replace("\1", "").replace("\2", ""))
        holds[i] = max(holds[i], inside)
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] = max(holds[nodes[i].parent], holds[i])
    return nodes, holds


@dataclass
class Model:
    weights: np.ndarray
    trees: boosting.Boosted

    def log_odds(self, pages: list[list[Node]]) -> np.ndarray:
        """Of the nodes of all pages, one after another."""
        return self.trees.log_odds(np.concatenate([features(nodes, self.weights) for nodes in pages])) if pages else np.empty(0)


@lru_cache(maxsize=2)
def learned(pages: int = PAGES, seed: int = SEED) -> Model:
    maker = Maker(seed)
    made = [labelled(maker.page()) for _ in range(pages)]
    weights, rest = token_weights(made[: pages // 2]), made[pages // 2 :]
    return Model(weights, boosting.fit(np.concatenate([features(nodes, weights) for nodes, _ in rest]), np.concatenate([y for _, y in rest]), TREES, DEPTH))


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    worth = log_odds.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if worth[i] > 0:
            worth[nodes[i].parent] += worth[i]
    kept = worth > 0
    for i in range(1, len(nodes)):
        kept[i] &= kept[nodes[i].parent]
    return kept


def main_text(nodes: list[Node], kept: np.ndarray) -> str:
    """Texts of the kept elements, a block a line, in page order."""
    # of runs at one place, those of inner (later) elements come first: an outer one's run is what follows them
    runs = sorted((place, -i, text) for i, x in enumerate(nodes) if kept[i] for place, text in x.runs)
    return "\n".join(text for _, _, text in runs)


def extract_pages(pages: list[str | None], model: Model) -> list[str]:
    parsed = [parse(p) for p in pages]
    odds = model.log_odds(parsed)
    out, at = [], 0
    for nodes in parsed:
        out.append(main_text(nodes, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract(spark: SparkSession, pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """pages (without html) with text: the main text, '' if there is none.

    Null and empty pages give ''. Text without markup is main text if the model takes it so. Pages are read whole, of
    any size and depth; repeated rows are extracted each. An earlier column named text is replaced.
    """
    shared = spark.sparkContext.broadcast(model or learned())
    rest = [c for c in pages.columns if c not in (html, "text")]
    schema = pages.select(*rest, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html, 2 << 20):
            texts = extract_pages(batch.column(html).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, "text"])

    return pages.select(*rest, html).mapInArrow(run, schema)
