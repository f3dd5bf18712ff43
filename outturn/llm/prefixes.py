"""Operator 13: prefix trie of conversations from sorted sequences, their LCPs and a sparse table of range minima.

A conversation is the sequence of its turns, each known by a digest. Equal sequences become one weighted row; the rows are sorted
and dealt by range, so that the members of a node are neighbours. A task goes over its range in blocks. For each block it has the
longest common prefix (LCP) of neighbours and a sparse table of their range minima; every candidate prefix (row, depth) finds how
far its members reach to the left and to the right by a binary search in the table of its own, and the node is told by the row at
which it begins. Sums over the interval give what the block knows of the node; all of it is additive, so that nodes which reach
over several blocks are summed by Spark. Between tasks, the first and last rows of ranges tell what was counted twice.

A sequence shared by a third of all conversations is one row, and a node above a third of all rows is one partial row a block.
Only the member ids of one node, which a hash reads in order, pass through one task, in chunks and without being held.

Results of corner cases: rows without conv_id are left out; a null role or text is empty; turns of equal number are ordered by
role, then by the MD5 of the text, a repeated row counting as one more turn; an empty table has no nodes; long conversations are
one row of 20 bytes a turn; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.llm.common import ranges, staged

#: Sequences and turns that a task holds at a time.
BLOCK_ROWS, BLOCK_TURNS = 4096, 1 << 18
#: Turns of a range, and ids of a chunk of members.
RANGE_TURNS, CHUNK = 1 << 20, 4096
WORD = r"[^\x20\x09-\x0D]+"

NODE = "key binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint"
PART = f"{NODE}, path binary, words array<int>, last int"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order, each with its digest (16 bytes in hex) and number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").alias("turn"), role.alias("role"), F.md5(F.concat(F.md5(role), text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select(
        "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns")
    )


def with_shared_openings(own: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations whose first h turns are those of the conversation c - c % every, h = crc32(c) % (most + 1)."""
    c = F.col("conv_id")
    openings = own.where(c % every == 0).select(c.alias("base"), F.slice("turns", 1, most).alias("opening"))
    h = (F.crc32(c.cast("string")) % (most + 1)).cast("int")
    own = own.select("conv_id", "turns", (c - c % every).alias("base"), h.alias("h"))
    none = F.slice("turns", 1, 0)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none)
    first = F.coalesce(F.slice("opening", F.lit(1), F.col("h")), none)
    return own.join(openings, "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 16
    x, y = (np.frombuffer(v, np.uint64, n // 8) for v in (a, b))
    return int(np.argmax(x != y)) // 2


class RangeMinima:
    """Sparse table of minima over all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 ** len(self.rows) <= len(values):
            half = 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima over low..high, both included."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.rows[k][low[at]], self.rows[k][high[at] + 1 - (1 << k)])
        return out

    def reach_right(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last r for which all values at start + 1 .. r are at least ``bound``, by binary search."""
        at, last = start.copy(), len(self.rows[0]) - 1
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            ok = at + (1 << k) <= last
            ok[ok] = row[at[ok] + 1] >= bound[ok]
            at[ok] += 1 << k
        return at

    def reach_left(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first l for which all values at l + 1 .. start are at least ``bound``, by binary search."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            ok = at - (1 << k) >= 0
            ok[ok] = row[at[ok] - (1 << k) + 1] >= bound[ok]
            at[ok] -= 1 << k
        return at


class Keys:
    """Digests of all prefixes of the row at hand; what it shares with the row before isn't hashed again."""

    def __init__(self) -> None:
        self.state = [hashlib.md5(usedforsecurity=False)]
        self.digest = [self.state[0].digest()]

    def move(self, path: bytes, shared: int) -> list[bytes]:
        del self.state[shared + 1 :], self.digest[shared + 1 :]
        for at in range(16 * shared, len(path), 16):
            state = self.state[-1].copy()
            state.update(path[at : at + 16])
            self.state.append(state)
            self.digest.append(state.digest())
        return self.digest


def block_nodes(rows: list[dict], shared: int, following: dict | None, keys: Keys) -> dict[str, list]:
    """What a block of sorted distinct sequences knows of its nodes.

    ``shared`` is the LCP of the first row with the row before it, ``following`` the row after the last one.
    """
    paths = [r["path"] for r in rows]
    size = np.array([len(p) // 16 for p in paths], np.int64)
    lcp = np.array([shared, *map(common_turns, paths[:-1], paths[1:])], np.int64)
    after = np.r_[lcp[1:], common_turns(paths[-1], following["path"]) if following else -1]
    offset = np.r_[0, np.cumsum(size + 1)]
    upto = np.zeros(offset[-1], np.int64)  # words of the first d turns, at offset + d
    for at, r in zip(offset.tolist(), rows, strict=False):
        upto[at + 1 : at + 1 + len(r["words"])] = np.cumsum(r["words"])
    weight = np.array([r["n"] for r in rows], np.int64)
    conv = RangeMinima(np.array([r["conv_id"] for r in rows], np.int64))
    whole = upto[offset[1:] - 1]

    def running(values: np.ndarray) -> np.ndarray:
        return np.r_[0, np.cumsum(values)]

    convs, weighted, leaves = running(weight), running(weight * whole), running(after < size)
    fresh = running(whole - upto[offset[:-1] + lcp])

    row = np.repeat(np.arange(len(rows)), size + 1)
    depth = ranges(np.zeros(len(rows)), size + 1)
    table = RangeMinima(lcp)
    left, right = table.reach_left(row, depth), table.reach_right(row, depth)
    own = np.flatnonzero(left == row)
    row, depth, right = row[own], depth[own], right[own]

    n = convs[right + 1] - convs[row]
    before = upto[offset[row] + np.maximum(depth, 1) - 1]
    top = np.maximum(lcp[row], np.maximum(depth, 1) - 1)
    distinct = whole[row] - upto[offset[row] + top] + fresh[right + 1] - fresh[row + 1]
    wide = len(rows) + 1
    level = np.sort(lcp * wide + np.arange(len(rows)))
    branches = np.searchsorted(level, depth * wide + right, "right") - np.searchsorted(level, depth * wide + row, "right")
    branches = branches + ((size[row] > depth) & (lcp[row] <= depth))

    key, parent = [], []
    place = np.searchsorted(row, np.arange(len(rows) + 1)).tolist()
    depths = depth.tolist()
    for k, path in enumerate(paths):
        digest = keys.move(path, int(lcp[k]))
        for d in depths[place[k] : place[k + 1]]:
            key.append(digest[d])
            parent.append(digest[d - 1] if d else None)
    return {
        "key": key, "parent": parent, "depth": depths, "conv_id": conv.least(row, right), "n_convs": n, "n_children": branches,
        "n_leaves": leaves[right + 1] - leaves[row], "saved": weighted[right + 1] - weighted[row] - n * before - distinct,
    }


_TYPES = {
    "key": pa.binary(), "parent": pa.binary(), **dict.fromkeys(["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved"], pa.int64()),
    "path": pa.binary(), "words": pa.list_(pa.int32()), "last": pa.int32(),
}


def _batch(columns: dict[str, list], names=tuple(_TYPES)) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[c], _TYPES[c]) if c in columns else pa.nulls(n, _TYPES[c]) for c in names]
    return pa.RecordBatch.from_arrays(arrays, list(names))


def _partials(batches):
    """Nodes of each block of a sorted range, then the first and the last row of the range."""
    block: list[dict] = []
    turns, shared, first, keys = 0, 0, None, Keys()
    for batch in batches:
        for r in batch.to_pylist():
            if block and (len(block) >= BLOCK_ROWS or turns + len(r["words"]) > BLOCK_TURNS):
                yield _batch(block_nodes(block, shared, r, keys))
                shared = common_turns(block[-1]["path"], r["path"])
                block, turns = [], 0
            block.append(r)
            turns += len(r["words"])
            first = first or r
    if first:
        yield _batch(block_nodes(block, shared, None, keys))
        ends = [first, block[-1]]
        yield _batch({"path": [e["path"] for e in ends], "words": [e["words"] for e in ends], "last": [0, 1]})


def _corrections(batches):
    """What neighbouring ranges count twice: the first row of one against the last row of the one before."""
    names = list(_TYPES)[:8]
    for batch in batches:
        for r in batch.to_pylist():
            both, digest = common_turns(r["before"], r["path"]), Keys().move(r["before"], 0)
            upto = np.r_[0, np.cumsum(r["words"], dtype=np.int64)]
            ended = both == len(r["before"]) // 16
            depth = np.arange(both + 1)
            yield _batch(
                {
                    "key": digest[: both + 1], "parent": [None, *digest[:both]], "depth": depth, "n_convs": depth * 0,
                    "n_children": -(depth < both).astype(np.int64), "n_leaves": np.full(both + 1, -int(ended)),
                    "saved": upto[both] - upto[np.maximum(depth, 1) - 1],
                },
                names,
            )


def _hashed(batches):
    """SHA-256 of the chunks of each key, which come one after the other."""
    key, state = None, None
    for batch in batches:
        done = {"key": [], "hash": []}
        for k, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if state:
                    done["key"].append(key)
                    done["hash"].append(state.hexdigest())
                key, state = k, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        yield pa.RecordBatch.from_arrays([pa.array(done["key"], pa.binary()), pa.array(done["hash"], pa.string())], ["key", "hash"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "hash"])


def _member_hashes(rows: DataFrame) -> DataFrame:
    """(key, hash): SHA-256 of the ids of each sequence in ascending order, joined by commas."""
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    chunks = rows.groupBy("path", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(ids.alias("ids"))
    key: Column = F.unhex(F.md5("path"))
    dealt = chunks.select(key.alias("key"), "ids", "chunk").repartition("key").sortWithinPartitions("key", "chunk")
    return dealt.select("key", "ids").mapInArrow(_hashed, "key binary, hash string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row per node: smallest member, depth, parent's smallest member, counts, saved words and hash of the members that end there.

    ``turns`` has one row per conversation: conv_id and an array of (digest, words), as ``sequences`` gives it.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = staged(
        turns.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"].cast("int")).alias("words")), "sequences"
    )
    alike = rows.groupBy("path").agg(F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_TURNS)
    dealt = alike.repartitionByRange(parts, "path").sortWithinPartitions("path")
    part = staged(dealt.mapInArrow(_partials, PART), "partials")

    edges = part.where("last is not null").select("path", "words", "last")
    in_order = F.lag("path").over(_everything().orderBy("path", "last"))
    borders = edges.select("path", "words", "last", in_order.alias("before")).where("last = 0 and before is not null")
    names = [c.split()[0] for c in NODE.split(", ")]
    known = part.where("last is null").select(*names).union(borders.mapInArrow(_corrections, NODE).select(*names))
    nodes = staged(
        known.groupBy("key", "parent", "depth").agg(
            F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved"))
        ),
        "nodes",
    )
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(above, "parent", "left").join(_member_hashes(rows), "key", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
            F.coalesce("hash", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def _everything():
    """Only for the edges of ranges, two rows a task."""
    from pyspark.sql import Window

    return Window.partitionBy()
