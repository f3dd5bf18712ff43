"""Boosted trees by histograms, for several training sets that differ in the fold they leave out.

Features are binned once and rows with equal bins are combined, with a count for each (label, fold). A level of the trees of
all training sets is one aggregation to gradient sums per (set, node, feature, bin); the driver holds these sums and the trees.
Trees that are older than ``KEPT`` rounds are in a written column of margins, so that a job evaluates few trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions.lineage import cut
from outturn.functions.partials import matrix, vector_sum

KEPT = 25
#: Patterns of a task: below that, a task costs more than its work.
TASK_PATTERNS = 20_000
#: Gradients are summed as whole multiples of this, so that the order of tasks has no say.
UNIT = 2.0**-24


@dataclass
class Tree:
    """A full binary tree: inner nodes and leaves by number; a node without a split sends all rows to the left."""

    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray

    def descend(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Number of the node of each row among those ``levels`` below the root."""
        node = np.zeros(len(bins), np.int16)
        for level in range(levels):
            right = np.zeros(len(bins), bool)
            for at in range(2**level):
                feature, edge = self.feature[2**level - 1 + at], self.edge[2**level - 1 + at]
                if feature >= 0:
                    right |= (node == at) & (bins[:, feature] > edge)
            node = 2 * node + right
        return node


@dataclass
class Boosted:
    """One ensemble for each training set, over the same bins."""

    edges: list[np.ndarray]
    base: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(self.edges)], 1)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """A column for each training set."""
        return self.base + added(self.trees, bins, len(self.base))


def added(rounds: list[list[Tree]], bins: np.ndarray, sets: int) -> np.ndarray:
    """What the trees say of each row; a comparison of a whole column at a time, so columns lie together."""
    bins = np.asfortranarray(bins)
    out = np.zeros((len(bins), sets), order="F")
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += tree.value[tree.descend(bins, len(tree.value).bit_length() - 1)]
    return out


def bin_edges(train: DataFrame, width: int, numeric: int, bins: int = 64) -> list[np.ndarray]:
    """Quantiles of the first ``numeric`` elements of ``x``; the others are 0 or 1. A value goes left if it is at most the edge."""
    columns = [F.get("x", F.lit(i)).alias(f"x{i}") for i in range(numeric)]
    shares = [k / bins for k in range(1, bins)]
    found = train.select(*columns).approxQuantile([f"x{i}" for i in range(numeric)], shares, 0.1 / bins) if numeric else []
    return [np.unique(q) for q in found] + [np.array([0.5])] * (width - numeric)


def binned(x: Column, edges: list[np.ndarray]) -> Column:
    """Number of edges below each element."""
    def one(i: int, edge: np.ndarray) -> Column:
        value = F.get(x, F.lit(i))
        if len(edge) == 1:
            return (value > float(edge[0])).cast("int")
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edge]), lambda e: e < value))

    return F.array(*[one(i, e) for i, e in enumerate(edges)])


def left_out(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of label 0 and 1 of each training set: those of all folds but its own."""
    halves = np.hsplit(counts.astype(np.float64), 2)
    return tuple(half.sum(1, keepdims=True) - half for half in halves)


def best_splits(g: np.ndarray, h: np.ndarray, w: np.ndarray, offset: np.ndarray, least: int) -> tuple:
    """Feature (or -1), edge and the sums of both children of a node, given sums per slot of all features."""
    total = [v[: offset[1]].sum() for v in (g, h, w)]
    before = [np.r_[0, np.cumsum(v)] for v in (g, h, w)]
    start = np.repeat(offset[:-1], np.diff(offset))
    left = [b[1:] - b[start] for b in before]
    right = [t - v for t, v in zip(total, left, strict=True)]
    last = np.zeros(len(g), bool)
    last[offset[1:] - 1] = True
    fits = ~last & (left[2] >= least) & (right[2] >= least) & (left[1] > 1e-3) & (right[1] > 1e-3)
    gain = np.full(len(g), -np.inf)
    gain[fits] = left[0][fits] ** 2 / left[1][fits] + right[0][fits] ** 2 / right[1][fits] - total[0] ** 2 / max(total[1], 1e-300)
    at = int(np.argmax(gain))
    if not gain[at] > 1e-12:
        return -1, 0, total, total
    feature = int(np.searchsorted(offset, at, "right")) - 1
    return feature, at - int(offset[feature]), [v[at] for v in left], [v[at] for v in right]


def ready(patterns: DataFrame) -> DataFrame:
    """The written patterns in memory, in as many tasks as their number is worth."""
    out = cut(patterns)
    return out.coalesce(1 + out.count() // TASK_PATTERNS).persist()


#: Patterns of a block: a row of the table that the trees are fitted on.
BLOCK = 8192
_BLOCKS = "n int, x binary, c binary, margin binary"


def _blocks(base: np.ndarray):
    """Patterns to rows of up to ``BLOCK`` of them, whose bins, counts and margins are matrices column by column."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, c = matrix(part, "x").astype(np.int16), matrix(part, "c").astype(np.int64)
                margin = np.tile(base, (len(x), 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int32()), *[pa.array([m.tobytes("F")], pa.binary()) for m in (x, c, margin)]],
                    ["n", "x", "c", "margin"],
                )

    return run


def _matrices(batch):
    """Bins, counts and margins of each block of a batch."""
    columns = [batch.column(batch.schema.get_field_index(name)) for name in ("n", "x", "c", "margin")]
    for n, *blocks in zip(*columns, strict=True):
        yield tuple(
            np.frombuffer(b.as_buffer(), kind).reshape(n.as_py(), -1, order="F")
            for b, kind in zip(blocks, (np.int16, np.int64, np.float64), strict=True)
        )


def _written(blocks: DataFrame) -> DataFrame:
    return cut(blocks).persist()


def fit_boosted(
    patterns: DataFrame, edges: list[np.ndarray], totals: np.ndarray, rounds: int = 200, depth: int = 3, rate: float = 0.05, least: int = 20
) -> Boosted:
    """Trees of logistic loss for all training sets at once.

    ``patterns`` has arrays ``x`` of bins and ``c`` of counts: label 0 of each fold, then label 1. ``totals`` are the sums of ``c``.
    """
    sets = len(totals) // 2
    offset = np.r_[0, np.cumsum([len(e) + 1 for e in edges])]
    slots = int(offset[-1])
    zeros, ones = left_out(totals[None, :])
    model = Boosted(edges, np.log(ones / zeros)[0])
    state = _written(patterns.select("x", "c").mapInArrow(_blocks(model.base), _BLOCKS))
    fresh: list[list[Tree]] = []
    try:
        for done in range(rounds):
            trees = [Tree(np.full(2**depth - 1, -1), np.zeros(2**depth - 1, np.int64), np.zeros(2**depth)) for _ in range(sets)]
            grown = False
            for level in range(depth):
                nodes = 2**level
                found = vector_sum(state, _gradients(list(fresh), trees, level, offset), 3 * sets * nodes * slots, "bigint")
                g, h, w = found.reshape(3, sets, nodes, slots) * np.array([UNIT, UNIT, 1.0])[:, None, None, None]
                grown = False
                for k, tree in enumerate(trees):
                    for node in range(nodes):
                        grown |= _split(tree, level, node, depth, best_splits(g[k, node], h[k, node], w[k, node], offset, least), rate)
                if not grown:
                    break
            if level == 0 and not grown:
                break
            fresh.append(trees)
            model.trees.append(trees)
            if len(fresh) == KEPT and done + 1 < rounds:
                later = _written(state.mapInArrow(_moved(list(fresh)), _BLOCKS))
                state.unpersist()
                state, fresh = later, []
    finally:
        state.unpersist()
    return model


def _split(tree: Tree, level: int, node: int, depth: int, found: tuple, rate: float) -> bool:
    """Enters a split and the values of the leaves that lie first below its children; true if there is one."""
    feature, edge, left, right = found
    if not left[2]:
        return False
    at = 2**level - 1 + node
    span = 2 ** (depth - level)
    tree.feature[at], tree.edge[at] = feature, edge
    tree.value[node * span] = -rate * left[0] / max(left[1], 1e-300)
    if feature >= 0:
        tree.value[node * span + span // 2] = -rate * right[0] / max(right[1], 1e-300)
    return feature >= 0


def _gradients(fresh: list[list[Tree]], trees: list[Tree], level: int, offset: np.ndarray):
    sets, nodes, slots = len(trees), 2**level, int(offset[-1])
    width = np.diff(offset)
    two, others = np.flatnonzero(width == 2), np.flatnonzero(width != 2)

    def block(bins: np.ndarray, counts: np.ndarray, margin: np.ndarray) -> np.ndarray:
        zeros, ones = left_out(counts)
        p = 1 / (1 + np.exp(-(margin + added(fresh, bins, sets))))
        weight = zeros + ones
        # whole numbers below 2^53, so sums of them are exact in any order
        values = [np.rint((weight * p - ones) / UNIT), np.rint(weight * p * (1 - p) / UNIT), weight]
        above = bins[:, two].astype(float)
        rows = np.arange(len(bins))
        out = np.zeros((3, sets, nodes, slots))
        for k in range(sets):
            node = trees[k].descend(bins, level).astype(np.int64)
            spread = np.zeros((len(bins), 3, nodes))
            for i, v in enumerate(values):
                spread[rows, i, node] = v[:, k]
            right = (above.T @ spread.reshape(len(bins), -1)).reshape(len(two), 3, nodes).transpose(1, 2, 0)
            out[:, k, :, offset[two] + 1] = right.transpose(2, 0, 1)
            out[:, k, :, offset[two]] = (spread.sum(0)[:, :, None] - right).transpose(2, 0, 1)
            for f in others:
                at = node * width[f] + bins[:, f]
                for i, v in enumerate(values):
                    found = np.bincount(at, v[:, k], nodes * width[f])
                    out[i, k, :, offset[f] : offset[f + 1]] = found.reshape(nodes, -1)
        return out.astype(np.int64).ravel()

    return lambda batch: sum(block(*part) for part in _matrices(batch))


def _moved(fresh: list[list[Tree]]):
    """Adds what trees say to the margins of each block."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                moved = [(margin + added(fresh, bins, margin.shape[1])).tobytes("F") for bins, _, margin in _matrices(batch)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(moved, pa.binary())], ["n", "x", "c", "margin"])

    return run
