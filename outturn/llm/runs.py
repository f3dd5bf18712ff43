"""Operator 11: periodic runs of words, found with suffix trees.

A run is a longest stretch of words with smallest period q, here of at least ``least_words`` words and ``least_periods``
periods. Words that occur fewer than ``least_periods`` times in a text lie in no run, so they cut it into stretches. For each
stretch Ukkonen's trees of the stretch and of its reversal answer longest common extensions: an Euler tour visits the lowest
common ancestor of neighbouring leaves between them, and a sparse table over those visits gives the ancestor of any two leaves in
constant time. Every run has a Lyndon root that is the longest Lyndon word at its start for one of the two orders of the
alphabet; so each word gives two candidate roots, and each is extended to both sides. All of this is linear in the stretch but
for the sparse table; candidates of all places are extended at once.

Results of corner cases: a null, empty or blank text has no words and no runs; a word of any length counts once; every row gives
one row, so repeated rows and ids give repeated results; a null id is kept and never rebuilt by ``recurring``; other columns of
the input are not read. The memory of a task is a batch of texts and the trees of one stretch.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from outturn.llm.common import column_of, map_texts, texts_of

LEAST_WORDS, LEAST_PERIODS = 24, 3

SCHEMA = (
    "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
    "strongest struct<start:bigint,length:bigint,period:bigint>, collapsed string"
)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def ukkonen(text: list[int]) -> tuple[dict[int, int], list[int], int]:
    """Suffix tree of symbols that end with the only 0: edges by (node * width + symbol), string depth of nodes, width.

    Leaves are the nodes without edges; one of depth d is the suffix that starts at len(text) - d.
    """
    n, width = len(text), max(text) + 1
    start, stop, link, depth = [0], [0], [0], [0]
    edges: dict[int, int] = {}
    node = edge = length = waiting = 0
    for i, symbol in enumerate(text):
        waiting += 1
        fresh = 0
        while waiting:
            if not length:
                edge = i
            key = node * width + text[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                start.append(i)
                stop.append(n)
                link.append(0)
                depth.append(n - i + waiting - 1)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                begin = start[child]
                span = stop[child] - begin
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if text[begin + length] == symbol:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                middle = len(start)
                start += (begin, i)
                stop += (begin + length, n)
                link += (0, 0)
                depth += (waiting - 1, n - i + waiting - 1)
                edges[key] = middle
                edges[middle * width + symbol] = middle + 1
                edges[middle * width + text[begin + length]] = child
                start[child] = begin + length
                if fresh:
                    link[fresh] = middle
                fresh = middle
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return edges, depth, width


class Tree:
    """Suffix tree of symbols (1 and up) with ranks of suffixes and constant-time longest common extensions."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.n = len(symbols)
        edges, depth, self.width = ukkonen([*symbols.tolist(), 0])
        self.keys = np.fromiter(edges.keys(), np.int64, len(edges))
        self.child = np.fromiter(edges.values(), np.int64, len(edges))
        self.depth = np.array(depth, np.int64)
        self.parent = np.zeros(len(depth), np.int64)
        self.parent[self.child] = self.keys // self.width
        self.inner = np.zeros(len(depth), bool)
        self.inner[self.parent[self.child]] = True
        tour = self._tour(self.keys % self.width)
        leaves = np.flatnonzero(~self.inner[tour])
        self.rank = self._ranks(tour[leaves])
        # the tour comes back to the common ancestor of two neighbouring leaves before it goes down to the second one
        visit = np.zeros(len(leaves), np.int32)
        visit[1:] = self.depth[self.parent[tour[leaves[:-1] + 1]]]
        self.table = [visit]
        while 2 ** len(self.table) <= len(visit):
            half = 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def _tour(self, weight: np.ndarray) -> np.ndarray:
        """Nodes in the order in which a walk that takes children by ascending weight first meets them."""
        order = np.lexsort((-weight, self.keys // self.width))
        kids = self.child[order].tolist()
        ends = np.searchsorted((self.keys // self.width)[order], np.arange(len(self.depth) + 1)).tolist()
        inner = self.inner.tolist()
        met, todo = [], [0]
        while todo:
            node = todo.pop()
            met.append(node)
            if inner[node]:
                todo += kids[ends[node] : ends[node + 1]]
        return np.array(met)

    def _ranks(self, leaves: np.ndarray) -> np.ndarray:
        out = np.empty(self.n + 1, np.int64)
        out[self.n + 1 - self.depth[leaves]] = np.arange(self.n + 1)
        return out

    def opposite_rank(self) -> np.ndarray:
        """Ranks of suffixes when the order of all symbols but the end is turned round."""
        symbol = self.keys % self.width
        tour = self._tour(np.where(symbol > 0, self.width - symbol, 0))
        return self._ranks(tour[~self.inner[tour]])

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, which differ."""
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


def longest_lyndon(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place: up to the next suffix of a smaller rank."""
    ranks, todo = rank.tolist(), []
    out = [0] * len(ranks)
    for i, r in enumerate(ranks):
        while todo and ranks[todo[-1]] > r:
            k = todo.pop()
            out[k] = i - k
        todo.append(i)
    return np.array(out[:-1], np.int64)


def runs_of(symbols: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of a stretch of symbols (1 and up), by start, then period; least_periods is 2 or more."""
    n = len(symbols)
    tree, back = Tree(symbols), Tree(symbols[::-1])
    at = np.tile(np.arange(n), 2)
    period = np.r_[longest_lyndon(tree.rank), longest_lyndon(tree.opposite_rank())]
    fits = (period * least_periods <= n) & (at + period <= n)
    at, period = at[fits], period[fits]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    right = tree.extension(at, at + period)
    left = back.extension(n - at, n - at - period)
    length = left + period + right
    long = length >= np.maximum(least_words, least_periods * period)
    found = np.unique(np.stack([at - left, period, length], 1)[long], axis=0)
    return found[:, [0, 2, 1]]


def runs_in(ids: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of the runs of a text, given the ids of its words."""
    if len(ids) < least_words:
        return np.zeros((0, 3), np.int64)
    often = np.bincount(ids)[ids] >= least_periods
    edge = np.flatnonzero(np.diff(np.r_[False, often, False]))
    found = []
    for a, b in edge.reshape(-1, 2)[np.diff(edge)[::2] >= least_words].tolist():
        _, symbols = np.unique(ids[a:b], return_inverse=True)
        part = runs_of(symbols + 1, least_words, least_periods)
        part[:, 0] += a
        found.append(part)
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def strongest(runs: np.ndarray) -> dict[str, int] | None:
    """The run of the greatest length / period, then smallest start and period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best["period"] > best["length"] * period:
            best = {"start": start, "length": length, "period": period}
    return best


def recurring(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places to take words from, for the tenth of all documents whose words recur by the rule of the query; else None."""
    mark = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if mark % 10 or not n:
        return None
    start = mark // 10 % n
    period = 1 + (n - start) // (3 + mark // 10 % 8)
    return np.r_[np.arange(start), start + np.arange(n - start) % period]


def find_runs(
    documents: DataFrame,
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
    reorder: Callable[[int | None, int], np.ndarray | None] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, all runs by start and period, the strongest one, and the text with each run kept once.

    ``reorder`` may give, for an id and a number of words, the places from which the words are taken instead of the text's own order.
    """
    if least_periods < 2:
        raise ValueError("a run has two periods at least")

    def make():
        def one(doc_id, text):
            words = text.encode().split()
            places = reorder(doc_id, len(words)) if reorder else None
            if places is not None:
                words = [words[k] for k in places.tolist()]
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            found = runs_in(ids, least_words, least_periods)
            if len(found):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, found[:, 0] + found[:, 2], 1)
                np.add.at(edge, found[:, 0] + found[:, 1], -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            rows = [{"start": s, "length": n, "period": p} for s, n, p in found.tolist()]
            return len(ids), rows, strongest(found), b" ".join(words).decode()

        def step(batch):
            ids = column_of(batch, "doc_id")
            rows = [one(i, t) for i, t in zip(ids.to_pylist(), texts_of(batch), strict=True)]
            n, runs, top, text = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(top, _RUN), pa.array(text, pa.string())],
                ["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )

        return step

    chosen = documents.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"cast(`{text_column}` as string) as text")
    return map_texts(chosen, ["doc_id", "text"], make, SCHEMA)
