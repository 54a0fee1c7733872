"""Boosted regression trees on rows that stand for many: what the tasks of a fit and of a scoring run.

Trees of fixed depth, least squares, logistic loss: the steps of Spark's ``GBTClassifier``, with all features as
numbers of ranges. A level of a tree needs sums per (node, range) alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

DEPTH, STEP = 5, 0.1
NODES, LEAVES = (1 << DEPTH) - 1, 1 << DEPTH
#: Ranges of a feature at most.
RANGES = 32
#: Features are summed together as long as their ranges make no more combinations.
COMBINATIONS = 1 << 10
#: A gain that is a smaller share of what is there already is the error of sums.
ROUNDING = 1e-10


def packed(ranges: np.ndarray) -> np.ndarray:
    """A number per row: up to eight features of at most 128 ranges."""
    out = np.zeros((len(ranges), 8), np.uint8)
    out[:, : ranges.shape[1]] = ranges
    return out.view("<u8").ravel()


def merged(ranges: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows as one with the sum of their weights, in an order that does not depend on how they came."""
    keys, at, back = np.unique(packed(ranges) << np.uint64(1) | label.astype(np.uint64), return_index=True, return_inverse=True)
    return ranges[at], label[at], np.bincount(back, weight, len(keys))


def together(sizes: Sequence[int]) -> list[list[int]]:
    """Features in groups, the largest first; a pass over the rows serves a group."""
    groups: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        fits = [g for g in groups if math.prod(sizes[i] for i in g) * sizes[f] <= COMBINATIONS]
        fits[0].append(f) if fits else groups.append([f])
    return groups


class Sums:
    """Weights and weighted targets per (node, feature, range)."""

    def __init__(self, ranges: np.ndarray, sizes: Sequence[int]):
        self.sizes, self.groups = sizes, together(sizes)
        self.shapes = [tuple(sizes[f] for f in g) for g in self.groups]
        self.codes = [
            np.ravel_multi_index([ranges[:, f] for f in g], shape).astype(np.int32)
            for g, shape in zip(self.groups, self.shapes, strict=True)
        ]

    def count(self, node: np.ndarray, width: int, rows: np.ndarray | slice, weight: np.ndarray, pull: np.ndarray) -> list[np.ndarray]:
        """Per group an array (2, nodes, ranges of its features) of the chosen rows."""
        node, weight, pull = node[rows], weight[rows], pull[rows]
        made = []
        for code, shape in zip(self.codes, self.shapes, strict=True):
            cells = math.prod(shape)
            at = node * cells + code[rows]
            made.append(np.stack([np.bincount(at, x, width * cells) for x in (weight, pull)]).reshape(2, width, *shape))
        return made

    def next_level(
        self, before: list[np.ndarray] | None, node: np.ndarray, width: int, weight: np.ndarray, pull: np.ndarray
    ) -> list[np.ndarray]:
        """The sums of a level from those of the level before: of two nodes made from one, the rows of the
        smaller are counted, and the other is the rest."""
        if before is None:
            return self.count(node, 1, slice(None), weight, pull)
        smaller = np.bincount(node, minlength=width).reshape(-1, 2).argmin(axis=1)
        less = np.zeros(width, bool)
        less[2 * np.arange(width // 2) + smaller] = True
        few = self.count(node >> 1, width // 2, np.flatnonzero(less[node]), weight, pull)
        out = []
        for whole, part in zip(before, few, strict=True):
            both = np.stack([part, whole - part], axis=2)
            both[:, smaller == 1] = both[:, smaller == 1][:, :, ::-1]
            out.append(both.reshape(2, width, *part.shape[2:]))
        return out

    def by_feature(self, made: list[np.ndarray]) -> list[np.ndarray]:
        """Per feature an array (2, nodes, ranges)."""
        out: list[np.ndarray] = [None] * len(self.sizes)
        for g, sums in zip(self.groups, made, strict=True):
            for j, f in enumerate(g):
                out[f] = sums.sum(axis=tuple(2 + k for k in range(len(g)) if k != j))
        return out


def best_splits(sums: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Per node the feature and its last range to the left, weight and pull there, and whether that gains at all."""
    whole = sums[0].sum(axis=2)
    left = np.concatenate([np.cumsum(s, axis=2)[:, :, :-1] for s in sums], axis=2)
    right = whole[:, :, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        least = (whole[1] ** 2 / whole[0])[:, None]
        gain = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - least
    gain = np.where((left[0] > 0) & (right[0] > 0) & (gain > ROUNDING * least), gain, 0.0)
    if not gain.shape[1]:
        none = np.zeros(len(gain), np.int64)
        return none, none, whole, whole, none > 0
    best = gain.argmax(axis=1)
    owner = np.repeat(np.arange(len(sums)), [s.shape[2] - 1 for s in sums])
    upto = np.concatenate([np.arange(s.shape[2] - 1) for s in sums])
    nodes = np.arange(len(gain))
    return owner[best], upto[best], left[:, nodes, best], whole, gain[nodes, best] > 0


def fit_trees(
    ranges: np.ndarray, label: np.ndarray, weight: np.ndarray, sizes: Sequence[int], rounds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, upto, value) of all trees, each a row per tree: a row of ``ranges`` goes right where its range is
    greater than ``upto``. A node that does not split sends all rows left."""
    sums, n, features = Sums(ranges, sizes), len(label), len(sizes)
    flat, first = ranges.ravel(), np.arange(n) * features
    sign = 2.0 * label - 1.0
    margin = np.zeros(n)
    feature, upto = np.zeros((rounds, NODES), np.int64), np.full((rounds, NODES), 255, np.int64)
    value = np.zeros((rounds, LEAVES))
    for t in range(rounds):
        # the first tree is fitted on the labels, as a whole; the others on the gradient, in steps
        pull = weight * (sign if t == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin)))
        node, made = np.zeros(n, np.intp), None
        for level in range(DEPTH):
            width = 1 << level
            made = sums.next_level(made, node, width, weight, pull)
            f, u, left, whole, splits = best_splits(sums.by_feature(made))
            own = slice(width - 1, 2 * width - 1)
            feature[t, own], upto[t, own] = np.where(splits, f, 0), np.where(splits, u, 255)
            node = 2 * node + (flat[first + feature[t, own][node]] > upto[t, own][node])
        left = np.where(splits, left, whole)
        ends = np.stack([left, np.where(splits, whole - left, 0.0)], axis=2).reshape(2, LEAVES)
        value[t] = np.divide(ends[1], ends[0], out=np.zeros(LEAVES), where=ends[0] > 0) * (STEP if t else 1.0)
        margin += value[t][node]
    return feature, upto, value


def spark_trees(model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trees of a ``GBTClassificationModel`` on ranges, as :func:`fit_trees` returns them."""
    weights = model.treeWeights
    feature, upto = np.zeros((len(weights), NODES), np.int64), np.full((len(weights), NODES), 255, np.int64)
    value = np.zeros((len(weights), LEAVES))

    def walk(t: int, node, place: int) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            while place < NODES:
                place = 2 * place + 1
            value[t, place - NODES] = node.prediction() * weights[t]
            return
        feature[t, place], upto[t, place] = node.split().featureIndex(), math.floor(node.split().threshold())
        walk(t, node.leftChild(), 2 * place + 1)
        walk(t, node.rightChild(), 2 * place + 2)

    for t, tree in enumerate(model._java_obj.trees()):
        walk(t, tree.rootNode(), 0)
    return feature, upto, value


def leaf_tables(feature: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """(features, ranges, trees): which leaves, as bits, a range of a feature leaves open in each tree. What all
    features of a row leave open is its leaf."""
    ranges, trees = np.arange(RANGES)[:, None], np.arange(len(feature))
    out = np.full((feature.max(initial=0) + 1, RANGES, len(feature)), (1 << LEAVES) - 1, np.uint32)
    for level in range(DEPTH):
        half = LEAVES >> level + 1
        for place in range(1 << level):
            node, left = (1 << level) - 1 + place, ((1 << half) - 1) << 2 * half * place
            shut = np.where(ranges > upto[:, node], np.uint32(left), np.uint32(left << half))
            out[feature[:, node], :, trees] &= ~shut.T
    return out


def score_leaves(ranges: np.ndarray, tables: np.ndarray, value: np.ndarray, rows: int = 256) -> np.ndarray:
    """The probability of each row of ``ranges``; equal rows are scored once."""
    if not len(ranges):
        return np.zeros(0)
    _, at, back = np.unique(packed(ranges), return_index=True, return_inverse=True)
    once, first = ranges[at], np.arange(len(value)) * LEAVES
    margin = np.zeros(len(once))
    for a in range(0, len(once), rows):
        part = once[a : a + rows]
        open_ = tables[0].take(part[:, 0], axis=0)
        for f in range(1, len(tables)):
            open_ &= tables[f].take(part[:, f], axis=0)
        leaf = np.bitwise_count((open_ & (~open_ + np.uint32(1))) - np.uint32(1))
        margin[a : a + rows] = value.ravel().take(first + leaf).sum(axis=1)
    return (1.0 / (1.0 + np.exp(-2.0 * margin)))[back]


def score_trees(ranges: np.ndarray, feature: np.ndarray, upto: np.ndarray, value: np.ndarray, rows: int = 256) -> np.ndarray:
    return score_leaves(ranges, leaf_tables(feature, upto), value, rows)
