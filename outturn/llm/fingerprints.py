"""Operator 5: document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs (lines, cut at sentence ends and, where those are far apart, after words chosen by hash). The digest of each goes
into three cells of a sketch. The difference of two sketches holds only what differs; cells with one digest left are peeled until
all differing digests are recovered. If peeling fails, larger sketches are made, sized by what the failed difference shows.
The likeness is the share of paragraph digests (of both texts) that the recovered difference leaves out.

Results of corner cases: a null text counts as empty; an empty text has the sketch of no paragraph, and two of those have
likeness 1; equal texts have equal fingerprints; rows of an equal id follow each other by text; rows with a null id are left out;
the successor of the last document is the first one, of a single document itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outturn.llm.buckets import bucket_of, id_bounds, partitions
from outturn.llm.common import ranges
from outturn.llm.jaccard import MIX, scramble

#: Cells of each of the three parts of the sketch that a fingerprint shows.
BASE = 8
LONG, ROWS = 240, 256
WORDS = re.compile(r"\s*\S+|\s+")
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+[ \t]*\n*|\n+|$)")


def paragraphs(text: str) -> list[str]:
    """Parts that joined give the text; a change in one part leaves the cuts of others."""
    out = []
    for part in SENTENCE.findall(text):
        if len(part) <= LONG:
            if part:
                out.append(part)
            continue
        run: list[str] = []
        for word in WORDS.findall(part):
            run.append(word)
            if xxhash.xxh3_64_intdigest(word.strip()) % 8 == 0:
                out.append("".join(run))
                run = []
        if run:
            out.append("".join(run))
    return out


def digests(text: str) -> np.ndarray:
    """A 64-bit digest of each paragraph; the k-th copy of one has its own digest."""
    parts = [p.encode("utf-8", "surrogatepass") for p in paragraphs(text)]
    seen: dict[bytes, int] = defaultdict(int)
    copy = np.zeros(len(parts), np.uint64)
    for i, part in enumerate(parts):
        copy[i] = seen[part]
        seen[part] += 1
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    return np.unique(scramble(keys + copy * MIX[0]))


PARTS = np.arange(3, dtype=np.int64)[:, None]
SHIFTS = np.array([0, 21, 42], np.uint64)[:, None]


class Sketches:
    """Sketches of many owners in flat arrays: three parts of ``sizes[owner]`` cells (a power of two) each.

    A cell has a count, the xor of its digests and the xor of their checks.
    """

    def __init__(self, sizes: np.ndarray) -> None:
        self.sizes = sizes
        self.start = np.cumsum(3 * sizes) - 3 * sizes
        total = int(3 * sizes.sum())
        self.count = np.zeros(total, np.int64)
        self.key = np.zeros(total, np.uint64)
        self.check = np.zeros(total, np.uint64)

    def put(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> Sketches:
        both = scramble(np.concatenate([keys ^ MIX[1], keys + MIX[4]]))
        bits, check = (both[: len(keys)] >> SHIFTS).astype(np.int64), both[len(keys) :]
        size = self.sizes[owner]
        at = (self.start[owner] + PARTS * size + (bits & (size - 1))).ravel()
        np.add.at(self.count, at, np.concatenate([sign] * 3))
        np.bitwise_xor.at(self.key, at, np.concatenate([keys] * 3))
        np.bitwise_xor.at(self.check, at, np.concatenate([check] * 3))
        return self

    def of(self, which: np.ndarray) -> Sketches:
        """The sketches of some owners, in that order."""
        out = Sketches(self.sizes[which])
        at = ranges(self.start[which], 3 * out.sizes)
        out.count, out.key, out.check = self.count[at], self.key[at], self.check[at]
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.sizes)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def differing(self) -> np.ndarray:
        """About how many digests each difference holds: a cell of a part stays empty with probability exp(-d / size)."""
        empty = np.add.reduceat((self.count == 0) & (self.key == 0), self.start, dtype=np.int64)
        return self.sizes * np.log(3 * self.sizes / np.maximum(empty, 0.1))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (owner, digest, sign: 1 only in the first, -1 only in the second), and the owners with hidden ones."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        cell_owner = np.repeat(np.arange(len(self.sizes)), 3 * self.sizes)
        while True:
            one = np.flatnonzero(np.abs(self.count) == 1)
            one = one[scramble(self.key[one] + MIX[4]) == self.check[one]]
            if not len(one):
                break
            owner, keys, sign = cell_owner[one], self.key[one], self.count[one]
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            first = np.r_[True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]
            owner, keys, sign = owner[first], keys[first], sign[first]
            self.put(owner, keys, -sign)
            found.append((owner, keys, sign))
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        hidden = np.unique(cell_owner[left])
        return *(np.concatenate(x) for x in zip(*found, strict=True)), hidden


class Fingerprints:
    """Digests of many texts and the sketches that their fingerprints show."""

    def __init__(self, texts: list[str]) -> None:
        self.digests = [digests(t) for t in texts]
        self.sizes = np.array(list(map(len, self.digests)), np.int64)
        owner = np.repeat(np.arange(len(texts)), self.sizes)
        keys = np.concatenate([*self.digests, np.zeros(0, np.uint64)])
        self.sketches = Sketches(np.full(len(texts), BASE, np.int64)).put(owner, keys, np.ones(len(keys), np.int64))

    def shown(self) -> list[str]:
        rows, s = len(self.digests), self.sketches
        parts = [self.sizes.astype(np.uint32), s.count.astype(np.int16), s.key, (s.check & np.uint64(0xFFFF)).astype(np.uint16)]
        flat = np.hstack([np.ascontiguousarray(p).view(np.uint8).reshape(rows, -1) for p in parts])
        return [base64.b64encode(r.tobytes()).decode() for r in flat]


def differences(a: Fingerprints, at_a: np.ndarray, b: Fingerprints, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of all paragraphs in which text at_a[i] of ``a`` and at_b[i] of ``b`` differ.

    Shown sketches are subtracted and peeled first; pairs that keep hidden digests get larger sketches, until none is left.
    """
    pairs = np.arange(len(at_a))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    delta = a.sketches.of(at_a).minus(b.sketches.of(at_b))
    while len(pairs):
        guess, size = delta.differing(), delta.sizes
        owner, keys, sign, hidden = delta.peel()
        bad = np.zeros(len(pairs), bool)
        bad[hidden] = True
        good = ~bad[owner]
        out.append((pairs[owner[good]], keys[good], sign[good]))
        most = (a.sizes[at_a] + b.sizes[at_b])[pairs]
        # more than three cells for two digests are needed to peel; a digest pair that no sketch parts is compared as it is
        wanted = np.maximum(2 * size, 1 << np.ceil(np.log2(np.maximum(1.0, 0.5 * np.minimum(most, guess)))).astype(np.int64))
        over = bad & (size > 64 * (most + BASE))
        for k in np.flatnonzero(over):
            x, y = a.digests[at_a[pairs[k]]], b.digests[at_b[pairs[k]]]
            for one, other, mark in ((x, y, 1), (y, x, -1)):
                rest = np.setdiff1d(one, other)
                out.append((np.full(len(rest), pairs[k]), rest, np.full(len(rest), mark)))
        keep = bad & ~over
        pairs, wanted = pairs[keep], wanted[keep]
        if not len(pairs):
            break
        delta = Sketches(wanted)
        for texts, at, mark in ((a, at_a, 1), (b, at_b, -1)):
            held = [texts.digests[k] for k in at[pairs]]
            owner = np.repeat(np.arange(len(pairs)), list(map(len, held)))
            keys = np.concatenate(held)
            delta.put(owner, keys, np.full(len(keys), mark))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def likeness(a: Fingerprints, at_a: np.ndarray, b: Fingerprints, at_b: np.ndarray) -> np.ndarray:
    pair, _, _ = differences(a, at_a, b, at_b)
    total = a.sizes[at_a] + b.sizes[at_b]
    apart = np.bincount(pair, minlength=len(at_a))
    return np.where(total > 0, (total - apart) / np.maximum(total, 1), 1.0)


def edited(text: str, successor: str) -> str:
    """The last half of the text replaced by as much of the beginning of its successor."""
    half = len(text) // 2
    return text[: len(text) - half] + successor[:half]


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_paragraphs int"
)


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of the edited text, and the likeness to the edited and to the next text.

    Documents go to buckets of ids; the first one of a bucket also goes to the bucket before it, as a successor only.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    count = partitions(docs)
    bounds = id_bounds(docs, 4 * count)
    bucket = bucket_of(bounds)
    # one row for each bucket
    heads = docs.select("doc_id", bucket.alias("b")).groupBy("b").agg(F.min("doc_id").alias("head")).orderBy("b").collect()
    before = [(h["head"], heads[k - 1]["b"]) for k, h in enumerate(heads)]
    spark = docs.sparkSession
    again = F.broadcast(spark.createDataFrame(before, "doc_id bigint, earlier int"))
    rows = docs.join(again, "doc_id", "left").select(
        "doc_id", "text",
        F.explode(
            F.when(F.col("earlier").isNull(), F.array(F.struct(bucket.alias("b"), F.lit(0).alias("last"))))
            .otherwise(F.array(F.struct(bucket.alias("b"), F.lit(0).alias("last")), F.struct(F.col("earlier").alias("b"), F.lit(1).alias("last"))))
        ).alias("to"),
    )
    dealt = rows.select("to.b", "to.last", "doc_id", "text").repartition(count, "b").sortWithinPartitions("b", "last", "doc_id", "text")

    def run(batches):
        held: list[tuple[int, int, int, str]] = []
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                held += zip(*(c.to_pylist() for c in batch.slice(start, ROWS).columns), strict=True)
                yield from rows_of(held)
                # the last row waits for its successor; one that is only a successor is done
                held = [h for h in held[-1:] if not h[1]]

    def rows_of(held):
        own = np.array([k for k in range(len(held) - 1) if not held[k][1] and held[k][0] == held[k + 1][0]], np.int64)
        if not len(own):
            return
        texts = [h[3] for h in held]
        changed = [edited(texts[k], texts[k + 1]) for k in own]
        before, after = Fingerprints(texts), Fingerprints(changed)
        shown = before.shown()
        columns = [
            [held[k][2] for k in own], [len(texts[k]) for k in own],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            [shown[k] for k in own], after.shown(), likeness(before, own, after, np.arange(len(own))),
            likeness(before, own, before, own + 1), before.sizes[own],
        ]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return dealt.mapInArrow(run, SCHEMA)
