"""Operator 8: exact n-gram Jaccard join by partitioning the universe of shingles.

Sets that are close in size share a band. A band cuts the universe into segments by hash. Two sets of a band that reach
the similarity differ in at most H shingles, so if the segments' allotments sum to H + 1, some segment differs by less than its
allotment: one segment of allotment 1 is equal, or one of allotment 2 differs by one shingle at most and shares a
one-deletion neighbour. The allotment of a band is the one of least estimated cost. Candidates are verified on whole sets.

Keys travel once, in blocks of some bytes a key, and of keys that the same sets share one stays. Copies meet at their smallest
id first. Candidates of a segment value are joined to its smallest set, the linked ones are
contracted to components, and only pairs between different components are formed afterwards, where parity sketches as long as
their sets ask for leave a link possible; no link between different texts is lost.

Results of corner cases: a null, empty or blank text has the empty set and is linked with nothing; fewer words than a shingle
make one shingle of all words; equal texts link; rows with equal ids are one document; a null id is left out.
"""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outturn.llm.buckets import partitions
from outturn.llm.common import column_of, discard, lists, map_texts, ranges, slices, staged, texts_of

SHINGLE = 3
#: Ratio between the ends of a size band.
BAND = 1.4
#: Longs of the Bloom filter that picks the documents to verify: ten bits for each counted id between these bounds. A filter that is
#: too small lets more sets through, which the joins drop.
FILTER_LONGS, MOST_LONGS, FILTER_HASHES = 1 << 14, 1 << 20, 3
#: Buckets in which shingles are counted; the counts bound how far two sets differ.
BUCKETS = 64
#: Least longs of a parity sketch, and its bits a shingle at least. Every shingle flips one bit, so two sketches differ in no more bits than
#: the sets in shingles; a sketch much shorter than its set is full of flips and tells nothing. Lengths are powers of two: the halves of
#: a long sketch, one flipped by the other, are the sketch of half its length.
PARITY, PARITY_BITS = 8, 2

#: Segment keys of a block, keys that a task holds before it writes blocks, and shingles for which there is a task that groups keys.
BLOCK, HELD, TASK_SHINGLES = 8192, 1 << 20, 1 << 21

#: Sets of a key that are compared at a time with as many others, and pairs whose longs are held at once.
CELL, PAIRS = 4096, 1 << 20

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text; words are split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < n:
        total = np.uint64(len(words))
        for h in hashed:
            total = scramble(np.array([total]) * MIX[0] + h)[0]
        return np.array([total], np.uint64)
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = scramble(total * MIX[0] + hashed[k : len(words) - n + 1 + k])
    return np.unique(total)


class Plan:
    """Bands and the allotment of each, for links of 100 * intersection >= percent * union.

    A band has ``single`` segments of allotment 1 and ``double`` ones of allotment 2; every set leaves out its ``spare``
    smallest single segments. That is exact: linked sets then agree in spare + 1 segments or more, equal segments have equal
    sizes, so the largest of those is left out by neither. Empty and tiny segments, which many sets share, go that way.
    """

    def __init__(self, percent: int, documents: int) -> None:
        self.percent, self.documents = percent, documents
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, math.floor(self.starts[-1] * BAND)))
        self.chosen: dict[int, tuple[int, int, int]] = {}

    def most_apart(self, band: int) -> int:
        """Bound of the symmetric difference of linked sets, the smaller of which lies in the band."""
        large = self.starts[band + 1] - 1
        return (100 - self.percent) * (large + 100 * large // self.percent) // (100 + self.percent)

    def allotment(self, band: int) -> tuple[int, int, int]:
        """(single, double, spare) of the least cost: keys made, and sets that would meet by chance."""
        if band not in self.chosen:
            need = self.most_apart(band) + 1
            doubles = sorted({d for d in (*range(9), need // 8, need // 4, need // 2) if 2 * d <= need})
            options = [
                (single + spare, double, spare)
                for double in doubles for single in [need - 2 * double]
                for spare in sorted({int(single * share) for share in (0, 0.1, 0.2, 0.3)})
            ]
            self.chosen[band] = min(options, key=lambda o: self._cost(band, *o))
        return self.chosen[band]

    def _cost(self, band: int, single: int, double: int, spare: int) -> float:
        width = (self.starts[band] + self.starts[band + 1]) / 2 / (single + double)
        size = np.arange(int(width + 8 * math.sqrt(width) + 8))
        mass = np.exp(size * math.log(width) - width - np.array([math.lgamma(k + 1) for k in size]))
        low = np.cumsum(mass) - mass
        kept = np.clip(low + mass - np.maximum(low, spare / single if single else 0), 0, None)
        # half of a set may be passages that other sets have too; segments of those alone meet
        alike = 0.25**size
        chance = single * float((kept * alike).sum()) + double * float((mass * 0.25 ** np.maximum(size - 1, 0) * (size + 1)).sum())
        return single - spare + double * (1 + width) + min(self.documents, 10**8) * 0.001 * chance

    def band(self, size: int) -> int:
        return bisect.bisect_right(self.starts, size) - 1

    def keys(self, values: np.ndarray) -> np.ndarray:
        """All segment keys of a set: of its own band, and of the band below if a linked set can lie there."""
        size = len(values)
        if not size:
            return np.zeros(0, np.uint64)
        own = self.band(size)
        out = [self._band_keys(values, own)]
        least = -(-self.percent * size // 100)
        if own and least < self.starts[own]:
            out.append(self._band_keys(values, own - 1))
        return np.concatenate(out)

    def _band_keys(self, values: np.ndarray, band: int) -> np.ndarray:
        single, double, spare = self.allotment(band)
        total = single + double
        segment = (scramble(values ^ MIX[3]) % np.uint64(total)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        element = scramble(values[order] + MIX[4])
        sums = np.r_[np.uint64(0), np.cumsum(element, dtype=np.uint64)]
        ends = np.searchsorted(segment[order], np.arange(total + 1))
        sizes = np.diff(ends)
        tag = scramble((np.uint64(band) << np.uint64(44)) + np.arange(total, dtype=np.uint64) * MIX[0] + MIX[1])
        whole = sums[ends[1:]] - sums[ends[:-1]]
        # a wrapping sum of scrambled shingles stands for a segment, and taking one shingle out is a subtraction
        kept = np.sort(np.argsort(-sizes[:single], kind="stable")[: single - spare])
        out = [scramble((whole * MIX[2] + tag)[np.r_[kept, np.arange(single, total)]])]
        if double:
            which = np.arange(single, total)
            member = ranges(ends[single:-1], sizes[single:])
            owner = np.repeat(which, sizes[single:])
            out.append(scramble((whole[owner] - element[member]) * MIX[2] + tag[owner]))
        return np.concatenate(out)


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _sketch(values: np.ndarray) -> bytes:
    counts = np.bincount((scramble(values ^ MIX[2]) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.int32).tobytes()


def _parity(values: np.ndarray) -> np.ndarray:
    longs = PARITY
    while 64 * longs < PARITY_BITS * len(values):
        longs *= 2
    bit = (scramble(values + MIX[1]) % np.uint64(64 * longs)).astype(np.int64)
    odd = np.bincount(bit, minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _flips(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two parity sketches differ, the longer one folded to the length of the other."""
    longs = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(p.reshape(-1, longs), 0) for p in (x, y))
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def _sets(documents: DataFrame, n: int, make_row, schema: str) -> DataFrame:
    def make():
        def step(batch):
            yield make_row(column_of(batch, "doc_id"), [shingles(t, n) for t in texts_of(batch)])

        return step

    return map_texts(documents, ["doc_id", "text"], make, schema)


def _measures(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, set size, digest, bucket counts and parities of every document."""

    def row(ids, sets):
        parities = [_parity(s) for s in sets]
        parity = np.concatenate(parities) if sets else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array(map(len, sets), pa.int64()), pa.array(map(_digest, sets), pa.binary()),
                pa.array(map(_sketch, sets), pa.binary()), lists(parity, np.fromiter(map(len, parities), np.int64, len(sets)), pa.int64()),
            ],
            ["doc_id", "n_shingles", "digest", "sketch", "parity"],
        )

    return _sets(documents, n, row, "doc_id bigint, n_shingles bigint, digest binary, sketch binary, parity array<bigint>")


def _segment_keys(documents: DataFrame, n: int, plan: Plan, bloom, buckets: int) -> DataFrame:
    """Segment keys of the documents that the Bloom filter lets through, as blocks of (tag, id) dealt to buckets by the key.

    A tag is 32 bits of the rest of a key. Keys that fall together only add sets to a group, which are then compared in vain.
    """

    def make():
        have = bloom.value

        def step(batch):
            batch = batch.filter(pa.array(_let_through(have, batch)))
            keys = [plan.keys(shingles(t, n)) for t in texts_of(batch)]
            counts = np.fromiter(map(len, keys), np.int64, len(keys))
            if counts.sum():
                flat, ids = np.concatenate(keys), column_of(batch, "doc_id").to_numpy(zero_copy_only=False)
                yield flat % np.uint64(buckets), (flat // np.uint64(buckets)).astype(np.uint32), np.repeat(ids, counts)

        return step

    def blocks(held):
        bucket, tag, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(bucket, kind="stable")
        bucket, tag, doc = bucket[order].astype(np.int64), tag[order], doc[order]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        starts = np.concatenate([np.arange(x, y, BLOCK) for x, y in zip(edges[:-1], edges[1:], strict=True)])
        ends = np.r_[starts[1:], len(bucket)]
        rows = []
        for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
            least = int(doc[x:y].min())
            narrow = int(doc[x:y].max()) - least < 1 << 32
            # ids as distances from the least one, in four bytes where they fit
            rows.append((least if narrow else None, tag[x:y].tobytes(), (doc[x:y] - least).astype(np.uint32).tobytes() if narrow else doc[x:y].tobytes()))
        least, tags, docs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts], pa.int64()), pa.array(least, pa.int64()), pa.array(tags, pa.binary()), pa.array(docs, pa.binary())],
            ["bucket", "least", "tags", "docs"],
        )

    def run(batches):
        step, held, waiting = make(), [], 0
        for batch in batches:
            for part in slices(batch):
                for made in step(part):
                    held.append(made)
                    waiting += len(made[0])
                if waiting > HELD:
                    yield blocks(held)
                    held, waiting = [], 0
        if held:
            yield blocks(held)

    return documents.select("doc_id", "text").mapInArrow(run, "bucket bigint, least bigint, tags binary, docs binary")


def _groups(blocks: DataFrame, tasks: int) -> DataFrame:
    """(key, doc_id, size): the sets that share a segment key with others. Keys that the same sets share count once, under a digest of these sets."""

    def met(held):
        tag = np.concatenate([np.frombuffer(t, np.uint32) for _, t, _ in held])
        doc = np.concatenate([
            np.frombuffer(d, np.int64) if least is None else np.frombuffer(d, np.uint32).astype(np.int64) + least for least, _, d in held
        ])
        order = np.lexsort((doc, tag))
        tag, doc = tag[order], doc[order]
        new = np.r_[True, (tag[1:] != tag[:-1]) | (doc[1:] != doc[:-1])]
        tag, doc = tag[new], doc[new]
        starts = np.flatnonzero(np.r_[True, tag[1:] != tag[:-1]])
        sizes = np.diff(np.r_[starts, len(tag)])
        digest = scramble(np.add.reduceat(scramble(doc.view(np.uint64) + MIX[2]), starts) * MIX[0] + sizes.astype(np.uint64))
        shared = np.flatnonzero(sizes > 1)
        digest, first = np.unique(digest[shared], return_index=True)
        starts, sizes = starts[shared[first]], sizes[shared[first]]
        for low in range(0, len(first), BLOCK):
            part = slice(low, low + BLOCK)
            # a group of many sets leaves in pieces
            at = ranges(starts[part], sizes[part])
            columns = np.repeat(digest[part].view(np.int64), sizes[part]), doc[at], np.repeat(sizes[part], sizes[part])
            for k in range(0, len(at), HELD):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + HELD], pa.int64()) for c in columns], ["key", "doc_id", "size"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for bucket, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield from met(held)
                    held = []
                now = bucket
                held.append(block)
        if held:
            yield from met(held)

    dealt = blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "key bigint, doc_id bigint, size bigint").distinct()


def _filter_bits(ids: np.ndarray, longs: int) -> np.ndarray:
    """Bit numbers of ids in the Bloom filter, one column for each hash."""
    x = ids.astype(np.int64).view(np.uint64)
    return np.stack([scramble(x + MIX[k]) % np.uint64(64 * longs) for k in range(FILTER_HASHES)], 1)


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bloom filter of the ids, combined by Spark; at most MOST_LONGS rows of it reach the driver."""
    longs, count = FILTER_LONGS, ids.count()
    while longs < MOST_LONGS and 64 * longs < 10 * count:
        longs *= 2

    def bits(batches):
        for batch in batches:
            place = np.unique(_filter_bits(batch.column(0).to_numpy(zero_copy_only=False), longs))
            value = np.uint64(1) << (place % np.uint64(64))
            yield pa.RecordBatch.from_arrays(
                [pa.array((place // np.uint64(64)).astype(np.int32)), pa.array(value.view(np.int64))], ["at", "bits"]
            )

    rows = ids.mapInArrow(bits, "at int, bits bigint").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    out = np.zeros(longs, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _let_through(have: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Which rows' ids the Bloom filter has."""
    place = _filter_bits(column_of(batch, "doc_id").to_numpy(zero_copy_only=False), len(have))
    return ((have[place // np.uint64(64)] >> (place % np.uint64(64))) & np.uint64(1)).all(1)


def _wanted_sets(documents: DataFrame, n: int, bloom) -> DataFrame:
    """Sets of the documents that the Bloom filter lets through."""

    def make():
        have = bloom.value

        def step(batch):
            batch = batch.filter(pa.array(_let_through(have, batch)))
            if batch.num_rows:
                sets = pa.array([shingles(t, n).tobytes() for t in texts_of(batch)], pa.binary())
                yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), sets], ["doc_id", "shingles"])

        return step

    return map_texts(documents, ["doc_id", "text"], make, "doc_id bigint, shingles binary")


def _possible(pairs: DataFrame, measures: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their sizes and bucket counts don't rule out."""
    left = measures.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = measures.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))

    def keep(batches):
        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            sa, sb = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.int32).reshape(-1, BUCKETS).astype(np.int64) for k in (4, 5)
            )
            apart = na + nb - 2 * (-(-percent * (na + nb) // (100 + percent)))
            ok = np.abs(sa - sb).sum(1) <= apart
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    joined = pairs.join(left, "a").join(right, "b")
    close = joined.where(F.lit(percent) * F.greatest("na", "nb") <= F.lit(100) * F.least("na", "nb"))
    return close.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(keep, "a bigint, b bigint")


def _not_apart(pairs: DataFrame, measures: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their whole parity sketches don't rule out; few others of them are linked, so few whole sets travel."""
    left = measures.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("parity").alias("pa"))
    right = measures.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("parity").alias("pb"))

    def keep(batches):
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            sketches = [[s.values.to_numpy() for s in batch.column(k)] for k in (4, 5)]
            flips = np.fromiter(map(_flips, *sketches), np.int64, batch.num_rows)
            ok = (100 + percent) * flips <= (100 - percent) * total
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb")
    return joined.mapInArrow(keep, "a bigint, b bigint")


def _met_apart(rows: DataFrame, tasks: int, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different components ``c`` that share a key, where sizes and parities don't rule them out.

    A key of many sets is cut into blocks of some CELL sets, and a task compares two blocks of it at a time.
    """

    def pairs_of(cells):
        keys = np.stack([cells.column(k).to_numpy() for k in range(3)])
        block, doc, c, size = (cells.column(k).to_numpy() for k in range(3, 7))
        lists_of = cells.column(7).combine_chunks()
        offsets, flat = lists_of.offsets.to_numpy(), lists_of.values.to_numpy()
        longs = np.diff(offsets)
        new = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
        ends = np.repeat(np.r_[new[1:], len(doc)], np.diff(np.r_[new, len(doc)]))
        later = ends - np.arange(len(doc)) - 1
        cuts = np.searchsorted(np.cumsum(later), np.arange(PAIRS, later.sum() + 1, PAIRS), side="right")
        for part in np.split(np.arange(len(doc)), cuts):
            i, j = np.repeat(part, later[part]), ranges(part + 1, later[part])
            # rows of two different blocks meet where these blocks do, rows of one block where it meets itself
            ok = (c[i] != c[j]) & ((block[i] != block[j]) | (keys[1][i] == keys[2][i]))
            ok &= percent * np.maximum(size[i], size[j]) <= 100 * np.minimum(size[i], size[j])
            i, j = i[ok], j[ok]
            i, j = np.where(longs[i] <= longs[j], i, j), np.where(longs[i] <= longs[j], j, i)
            shape, kind = np.unique(np.stack([longs[i], longs[j]]), axis=1, return_inverse=True)
            for k, (short, long) in enumerate(shape.T.tolist()):
                of = np.flatnonzero(kind == k)
                for low in range(0, len(of), max(1, PAIRS // long)):
                    x, y = (at[of[low : low + max(1, PAIRS // long)]] for at in (i, j))
                    flips = flat[offsets[x][:, None] + np.arange(short)]
                    for at in range(0, long, short):
                        flips = flips ^ flat[offsets[y][:, None] + np.arange(at, at + short)]
                    differ = np.bitwise_count(flips.view(np.uint64)).sum(1, dtype=np.int64)
                    kept = (100 + percent) * differ <= (100 - percent) * (size[x] + size[y])
                    yield np.stack([np.minimum(doc[x], doc[y])[kept], np.maximum(doc[x], doc[y])[kept]])

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = pa.Table.from_batches([batch])
                held = now if held is None else pa.concat_tables([held, now])
                last = [held.column(k)[-1].as_py() for k in range(3)]
                done = np.flatnonzero(np.logical_or.reduce([held.column(k).to_numpy() != v for k, v in enumerate(last)]))
                end = int(done[-1]) + 1 if len(done) else 0
            else:
                end = held.num_rows if held is not None else 0
            if end:
                found = [x for x in pairs_of(held.slice(0, end).combine_chunks()) if x.size]
                if found:
                    once = np.unique(np.concatenate(found, 1), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in once], ["a", "b"])
                held = held.slice(end)

    blocks, others = F.col("blocks"), F.col("other")
    block = F.pmod(F.xxhash64("doc_id"), blocks).alias("block")
    cells = (
        rows.select("key", "doc_id", "c", "n_shingles", "parity", block, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("key", F.least("block", others).alias("p"), F.greatest("block", others).alias("q"), "block", "doc_id", "c", "n_shingles", "parity")
    )
    dealt = cells.repartition(tasks, "key", "p", "q").sortWithinPartitions("key", "p", "q")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, documents: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs whose whole sets reach the similarity."""
    spark = documents.sparkSession
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    bloom = spark.sparkContext.broadcast(_bloom(ids))
    sets = _wanted_sets(documents, n, bloom)

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component_id) of all ends of ``edges`` (a, b): the smallest id reachable, by large and small stars.

    Every round joins all larger neighbours of a node to its smallest one, then all smaller ones; the graph shrinks to stars in
    few rounds, each of which is written to the shared folder.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        )
        before_now, now = now, staged(small, "stars")
        discard(before_now)
        mark = now.agg(F.count("*"), F.sum(F.expr("xxhash64(u, v) % 1000000007"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("doc_id")).distinct()
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).union(
        roots.select("doc_id", F.col("doc_id").alias("component_id"))
    )


def near_copies(
    documents: DataFrame, percent: int = 90, n: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest id reachable by links."""
    documents = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null")
    measures = staged(_measures(documents, n).dropDuplicates(["doc_id"]), "measures")
    full = measures.where("n_shingles > 0")
    # Copies meet at the smallest id that has their digest; partial minima keep a hot digest small.
    copies = full.groupBy("digest").agg(F.min("doc_id").alias("uid"))
    member = staged(full.select("doc_id", "digest").join(copies, "digest").select("doc_id", "uid"), "members")
    first = staged(
        full.join(member.where("doc_id = uid").select("doc_id"), "doc_id").select("doc_id", "n_shingles", "sketch", "parity"), "first"
    )
    documents_first, all_shingles = first.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    plan = Plan(percent, documents_first)

    tasks = max(partitions(documents), all_shingles // TASK_SHINGLES)
    bloom = documents.sparkSession.sparkContext.broadcast(_bloom(first.select("doc_id")))
    keys = _segment_keys(documents, n, plan, bloom, 2 * tasks)
    met = _groups(keys, tasks).join(first.select("doc_id"), "doc_id", "left_semi")
    met = staged(met.select("key", "doc_id", "size"), "met")
    # The hub of a group is its set that meets the most others: in a group of near copies, the text they come from.
    busy = met.groupBy("doc_id").agg(F.sum("size").alias("busy"))
    hubs = met.join(busy, "doc_id").groupBy("key").agg(F.max(F.struct("busy", (-F.col("doc_id")).alias("minus"))).alias("top"))
    star = met.join(hubs.select("key", (-F.col("top.minus")).alias("hub")), "key").where("doc_id <> hub")
    star = star.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()
    tried = staged(_not_apart(_possible(star, first, percent), first, percent), "tried")
    linked = staged(_verified(tried, documents, n, percent), "linked")
    near = staged(components(linked), "near")

    # Segment values that still join different components: only pairs between those remain, and only those
    # whose sizes and parities allow a link are formed.
    seen = met.join(near, "doc_id", "left").select("key", "doc_id", F.coalesce("component_id", "doc_id").alias("c"))
    mixed = (
        seen.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("n")).where("x <> y")
        .select("key", F.ceil(F.col("n") / CELL).cast("bigint").alias("blocks"))
    )
    open_ = seen.join(mixed, "key").join(first.select("doc_id", "n_shingles", "parity"), "doc_id")
    # written first, so that Spark doesn't move the anti-join to the pairs as they repeat in many groups
    pairs = staged(_met_apart(open_, tasks, percent), "pairs")
    more = staged(_not_apart(_possible(pairs.join(tried, ["a", "b"], "left_anti"), first, percent), first, percent), "more")
    discard(met, near, tried, pairs)
    final = components(linked.union(_verified(more, documents, n, percent)))
    return (
        measures.select("doc_id", "n_shingles").join(member, "doc_id", "left")
        .join(final.withColumnRenamed("doc_id", "uid"), "uid", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "uid", "doc_id").alias("component_id"))
    )
