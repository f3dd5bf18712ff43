"""Operator 12: near duplicates by an LSH forest of MinHash signatures.

Each document has ``ORDERS`` signatures, each of ``LEVELS`` minima of independent permutations, ten bits a level, in one number.
Sorting a signature puts documents side by side that share a long prefix; every document takes its neighbours of the longest common
prefix as candidates. Around them lies a region: the documents that share the first ``SHALLOW`` levels, or more levels where more than
``CROWDED`` documents share these, up to all of them. In a region every document is also tried against the one that meets most others.
Linked documents are contracted to components, and pairs of a region that still lie in different components are tried
last, so that a group of near copies costs its size and not its square. Links are confirmed on full sets.

A link is found if some order has both documents in one region. At the least similarity of 85 % and the greatest depth, which only
crowded regions have, one order does with 0.85^6 = 38 %, and all 32 miss with a chance of 2e-7; most regions have the least depth, at
which it is 1e-13. No bucket is cut: crowded regions get deeper, and at the greatest depth they are taken as they are.

Equal sets meet at their smallest id before all this. Tables of the steps lie in the shared folder and are deleted as soon as what
follows from them is written.

Results of corner cases: a null, empty or blank text has the empty set, is linked with nothing and kept; fewer words than a shingle
make one shingle of all words; equal texts link; rows with equal ids are one document, that of the least digest; a null id is left
out; other columns of the input are not read. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.llm.common import column_of, discard, lists, map_texts, staged, texts_of
from outturn.llm.jaccard import components, scramble, shingles

SHINGLE, PERCENT = 5, 85
ORDERS, LEVELS, SHALLOW, BITS = 32, 6, 3, 10
#: Documents of a region from which on it gets deeper.
CROWDED = 256
#: Longs of the parity sketch: every shingle flips one bit, so two sketches differ in no more bits than the sets in shingles.
PARITY = 8
SIGNED = "doc_id bigint, n_shingles bigint, digest binary, parity array<bigint>, signatures array<bigint>"


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Factor and summand of x -> a x + b modulo 2^32, one for each level of each order."""
    drawn = scramble(np.arange(1, 2 * ORDERS * LEVELS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = (drawn >> np.uint64(32)).astype(np.uint32).reshape(2, -1)
    return a | np.uint32(1), b


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ORDERS signatures for each non-empty set."""
    points = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), ORDERS), np.int64)
    for k, (a, b) in enumerate(zip(*permutations(), strict=True)):
        least = np.minimum.reduceat(points * a + b, starts).astype(np.uint64)
        level = scramble(least + np.uint64(k << 32)) >> np.uint64(64 - BITS)
        out[:, k // LEVELS] = out[:, k // LEVELS] << BITS | level.astype(np.int64)
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """PARITY longs for each set."""
    place = (scramble(np.concatenate(sets) + np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(64 * PARITY)).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), [*map(len, sets)])
    odd = np.bincount(owner * 64 * PARITY + place, minlength=len(sets) * 64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(documents: DataFrame, n: int) -> DataFrame:
    def make():
        def step(batch):
            sets = [shingles(t, n) for t in texts_of(batch)]
            full = [s for s in sets if len(s)]
            has = np.array([len(s) > 0 for s in sets], bool)
            sign = signatures(full) if full else np.zeros((0, ORDERS), np.int64)
            odd = parities(full) if full else np.zeros(0, np.int64)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "doc_id"), pa.array([*map(len, sets)], pa.int64()), pa.array(digest, pa.binary()),
                    lists(odd, has * PARITY, pa.int64()), lists(sign.ravel(), has * ORDERS, pa.int64()),
                ],
                ["doc_id", "n_shingles", "digest", "parity", "signatures"],
            )

        return step

    return map_texts(documents, ["doc_id", "text"], make, SIGNED)


def prefix(depth: int) -> Column:
    return F.shiftright("signature", BITS * (LEVELS - depth))


def _regions(distinct: DataFrame) -> DataFrame:
    """(tree, depth, prefix, doc_id, signature, n) of all documents that share a region of n documents."""
    rows = distinct.select("doc_id", F.posexplode("signatures").alias("tree", "signature"))

    def met(rows: DataFrame, depth: int) -> DataFrame:
        rows = rows.withColumns({"depth": F.lit(depth), "prefix": prefix(depth)})
        size = rows.groupBy("tree", "prefix").agg(F.count("*").alias("n")).where("n > 1")
        return rows.join(size, ["tree", "prefix"]).select("tree", "depth", "prefix", "doc_id", "signature", "n")

    out, here = None, staged(met(rows, SHALLOW), "regions")
    stages = [here]
    for depth in range(SHALLOW + 1, LEVELS + 1):
        calm = here.where(F.col("n") <= CROWDED)
        out = calm if out is None else out.union(calm)
        here = staged(met(here.where(F.col("n") > CROWDED).select("doc_id", "tree", "signature"), depth), "regions")
        stages.append(here)
    whole = staged(out.union(here), "regions")
    discard(*stages)
    return whole


def _neighbours(regions: DataFrame) -> DataFrame:
    """Each document's neighbour of the most, then longest, common prefixes: pairs a < b.

    Pairs that lie on the border of two ranges are left to the regions, which hold them too.
    """

    def beside(batches):
        last = None
        for batch in batches:
            tree, sign, doc = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            if last is not None:
                tree, sign, doc = np.r_[last[0], tree], np.r_[last[1], sign], np.r_[last[2], doc]
            if len(doc):
                last = tree[-1], sign[-1], doc[-1]
            shared = np.zeros(max(0, len(doc) - 1), np.int64)
            for depth in range(SHALLOW, LEVELS + 1):
                at = BITS * (LEVELS - depth)
                shared[sign[1:] >> at == sign[:-1] >> at] = depth
            ok = (shared > 0) & (tree[1:] == tree[:-1])
            a, b = doc[:-1][ok], doc[1:][ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(shared[ok])], ["a", "b", "shared"]
            )

    in_order = regions.select("tree", "signature", "doc_id").repartitionByRange("tree", "signature", "doc_id")
    pairs = in_order.sortWithinPartitions("tree", "signature", "doc_id").mapInArrow(beside, "a bigint, b bigint, shared bigint")
    weight = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    both = weight.select(F.col("a").alias("doc_id"), F.struct("shared", F.col("b").alias("other")).alias("best")).union(
        weight.select("b", F.struct("shared", F.col("a").alias("other")))
    )
    best = both.groupBy("doc_id").agg(F.max("best.shared").alias("shared"), F.max_by("best.other", "best").alias("other"))
    return best.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()


def _stars(regions: DataFrame) -> DataFrame:
    """Every document of a region with the one that meets the most others: pairs a < b."""
    busy = regions.groupBy("doc_id").agg(F.sum("n").alias("busy"))
    region = ["tree", "depth", "prefix"]
    marked = regions.join(busy, "doc_id").select(*region, "doc_id", "busy")
    hub = marked.groupBy(*region).agg(F.max_by("doc_id", F.struct("busy", -F.col("doc_id"))).alias("hub"))
    star = regions.join(hub, region).where("doc_id <> hub")
    return star.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()


def _sides(documents: DataFrame, name: str, *more: Column | str) -> DataFrame:
    parity = [F.col("parity")[k].alias(f"{name}{k}") for k in range(PARITY)]
    return documents.select(*more, F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n{name}"), *parity)


def _close(percent: int) -> Column:
    """What sizes and parities of a pair must fulfil."""
    total = F.col("na") + F.col("nb")
    size = F.lit(percent) * F.greatest("na", "nb") <= F.lit(100) * F.least("na", "nb")
    differ = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(PARITY)), F.lit(0))
    return size & (F.lit(100 + percent) * differ <= F.lit(100 - percent) * total)


def _possible(pairs: DataFrame, distinct: DataFrame, percent: int) -> DataFrame:
    joined = pairs.join(_sides(distinct, "a"), "a").join(_sides(distinct, "b"), "b")
    return joined.where(_close(percent)).select("a", "b")


def _sets(pairs: DataFrame, documents: DataFrame, distinct: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles) of the documents of pairs; of rows with one id, the one that was measured."""

    def make():
        def step(batch):
            sets = [shingles(t, n).tobytes() for t in texts_of(batch)]
            same = [xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, column_of(batch, "digest").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])
            yield out.filter(pa.array(same, pa.bool_()))

        return step

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    wanted = documents.join(distinct.select("doc_id", "digest").join(ids, "doc_id", "left_semi"), "doc_id")
    return map_texts(wanted, ["doc_id", "text", "digest"], make, "doc_id bigint, shingles binary").dropDuplicates(["doc_id"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity.

    The partners of a document are dealt over as many tasks as the session has, so a centre of a large group is in no single one.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def salt(other: str) -> Column:
        return F.pmod(F.xxhash64(other), F.lit(parts))

    def dealt(one: str, other: str, as_: str) -> DataFrame:
        used = pairs.select(one, salt(other).alias("salt")).distinct()
        return used.join(sets.select(F.col("doc_id").alias(one), F.col("shingles").alias(as_)), one)

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    left = pairs.withColumn("salt", salt("b")).join(dealt("a", "b", "x"), ["a", "salt"]).select("a", "b", "x", salt("a").alias("salt"))
    return left.join(dealt("b", "a", "y"), ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def near_duplicates(
    documents: DataFrame, percent: int = PERCENT, n: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest id reachable by links."""
    documents = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    documents = documents.where("doc_id is not null")
    row = F.min(F.struct("digest", "n_shingles", "parity", "signatures")).alias("row")
    measures = staged(_signed(documents, n).groupBy("doc_id").agg(row).select("doc_id", "row.*"), "measures")
    full = measures.where("n_shingles > 0")
    # Copies meet at the smallest id that has their digest; partial minima keep a hot digest small.
    copies = full.groupBy("digest").agg(F.min("doc_id").alias("uid"))
    member = staged(full.select("doc_id", "digest").join(copies, "digest").select("doc_id", "uid"), "members")
    own = member.where("doc_id = uid").select("doc_id")
    distinct = staged(full.join(own, "doc_id").select("doc_id", "digest", "n_shingles", "parity", "signatures"), "distinct")

    regions = _regions(distinct)
    tried = staged(_possible(_neighbours(regions).union(_stars(regions)).distinct(), distinct, percent), "tried")
    sets = staged(_sets(tried, documents, distinct, n), "sets")
    linked = staged(_confirmed(tried, sets, percent), "linked")
    discard(sets)
    near = staged(components(linked), "near")

    # Regions that still hold different components: only pairs between those remain, and only the ones
    # whose sizes and parities allow a link leave the join.
    region = ["tree", "depth", "prefix"]
    seen = regions.join(near, "doc_id", "left").select(*region, "doc_id", F.coalesce("component_id", "doc_id").alias("c"))
    mixed = seen.groupBy(*region).agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select(*region)
    open_ = staged(
        seen.join(mixed, region).join(distinct.select("doc_id", "n_shingles", "parity"), "doc_id"), "open"
    )
    left, right = (_sides(open_, s, *region, F.col("c").alias(f"c{s}")) for s in "ab")
    same = [left[c] == right[c] for c in region]
    cross = left.join(right, [*same, F.col("a") < F.col("b"), F.col("ca") != F.col("cb"), _close(percent)])
    more = staged(cross.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "more")
    discard(regions, near, open_)
    sets = staged(_sets(more, documents, distinct, n), "sets")
    final = staged(components(linked.union(_confirmed(more, sets, percent))), "final")
    discard(sets, more, tried, linked, distinct)
    return (
        measures.select("doc_id", "n_shingles").join(member, "doc_id", "left")
        .join(final.withColumnRenamed("doc_id", "uid"), "uid", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "uid", "doc_id").alias("component_id"))
    )
