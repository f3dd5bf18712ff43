"""Operator 3: training-order materialisation of token ids.

Sequences are numbered by document; a keyed Feistel permutation with cycle-walking gives each number a slot of the global
order, a bijection that any task can compute and invert. Rows are dealt to shards by ranges of slots, and a shard is one binary body
of records of equal length, so that slot s lies at byte (s mod per_shard) * record length of shard s / per_shard:
reading goes forward and resumes at any slot.

Documents are rows of ``ids array<int>``, or of ``packed binary`` made by ``tokenised``, written little-endian at a fixed width
(``Ids``) with an end and a pad id that the vocabulary doesn't use otherwise. A table that has ``text`` in place of ids is written
as the bytes of UTF-8. Rows are dealt once by units, which are ranges of ids, numbered inside their task from the unit's first
number, and dealt once more to shards. An id with more rows than a unit should have is split by a hash of its rows into units of
its own.

Results of corner cases: a null or empty text, or null or empty ids, is a sequence of the end id alone; repeated rows have
sequences of their own, which go on counting where they share an id; rows with a null id are left out; an empty table makes no
shard; an id that doesn't fit the width is an error. Rows equal in id and text lie in one unit.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outturn.llm.buckets import bucket_of, id_bounds, partitions
from outturn.llm.common import column_of, discard, map_texts, shared_folder, staged, texts_of, written
from outturn.llm.jaccard import MIX, scramble
from outturn.llm.pieces import Encoder, vocabulary


@dataclass(frozen=True)
class Ids:
    """How ids are written: bytes of an id, the id after a document, and the id that fills its last record."""

    width: int
    end: int
    pad: int

    def pack(self, ids) -> bytes:
        values = np.asarray(ids, np.int64)
        if len(values) and not 0 <= values.min() <= values.max() < 1 << 8 * self.width:
            raise ValueError(f"ids do not fit {self.width} bytes")
        return values.astype(f"<u{self.width}").tobytes()

    def unpack(self, record: bytes) -> np.ndarray:
        return np.frombuffer(record, f"<u{self.width}").astype(np.int64)


#: UTF-8 never has the bytes 254 and 255.
UTF8 = Ids(1, 255, 254)
#: Ids of a record, records of a shard, rounds of the permutation.
LENGTH, PER_SHARD, ROUNDS = 1024, 2048, 6


def permuted(number: np.ndarray, total: int, key: int, back: bool = False) -> np.ndarray:
    """The slot of each number below ``total`` (or the number of each slot): a keyed bijection of 0..total-1."""
    half = np.uint64(max(1, (max(1, total - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = scramble(np.arange(1, ROUNDS + 1, dtype=np.uint64) * MIX[0] + np.uint64(key))
    x = np.asarray(number).astype(np.uint64)
    outside = np.arange(len(x))
    while len(outside):  # values beyond the range walk on along their cycle
        left, right = x[outside] >> half, x[outside] & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (scramble(left ^ k) & mask), left
            else:
                left, right = right, left ^ (scramble(right ^ k) & mask)
        x[outside] = (left << half) | right
        outside = outside[x[outside] >= np.uint64(total)]
    return x.astype(np.int64)


def ids_of(model_path: str) -> Ids:
    """Two bytes an id where the vocabulary and a pad id fit them, else four."""
    words = vocabulary(model_path)
    width = 2 if words.size < 1 << 16 else 4
    return Ids(width, words.end, (1 << 8 * width) - 1)


def packed(documents: DataFrame, kind: Ids) -> DataFrame:
    """doc_id and the bytes of the ids, without the end id; null ids or text are no bytes."""
    docs = documents.withColumn("doc_id", F.col("doc_id").cast("bigint")).where("doc_id is not null")
    if "packed" in documents.columns:
        return docs.select("doc_id", F.coalesce("packed", F.lit(b"")).alias("body"))
    if "ids" not in documents.columns:
        return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))

    def make():
        def step(batch):
            # ids stay arrays: lists of Python numbers would take many times their space
            bodies = [kind.pack(ids.values.to_numpy(zero_copy_only=False)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["doc_id", "body"])

        return step

    return map_texts(docs.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), ["doc_id", "ids"], make, "doc_id bigint, body binary")


UNIT = "b int, hot bigint, piece bigint, unit int, start bigint, earlier bigint"


def numbered(docs: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Packed documents with their unit, its first number and the sequences that its id has in earlier units; the number of sequences.

    ``size`` is the bytes of a record. Units are ranges of ids, and parts of those ids that have more rows than a range should
    have; their number follows the session's partitions, and only their totals reach the driver.
    """
    spark, ranges = docs.sparkSession, 4 * partitions(docs)
    most = max(1, docs.count() // ranges)
    parts = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    # at most ``ranges`` ids have more rows than that
    parts = F.broadcast(parts.select("doc_id", F.ceil(F.col("n") / most).alias("parts")))
    dealt = docs.join(parts, "doc_id", "left").select(
        "doc_id", "body", bucket_of(id_bounds(docs, ranges)).alias("b"),
        F.when(F.col("parts").isNull(), 0).otherwise(F.col("doc_id")).alias("hot"),
        F.when(F.col("parts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("body"), F.col("parts"))).cast("bigint").alias("piece"),
    )
    count = F.floor((F.octet_length("body") + size) / size).cast("bigint")
    totals = dealt.groupBy("b", "hot", "piece").agg(F.sum(count).alias("n")).orderBy("b", F.col("piece") > 0, "hot", "piece").collect()
    units, start, of, first = [], 0, None, 0
    for k, t in enumerate(totals):
        if not t["piece"] or t["hot"] != of:
            of, first = t["hot"] if t["piece"] else None, start
        units.append((t["b"], t["hot"], t["piece"], k, start, start - first))
        start += t["n"]
    rows = dealt.join(F.broadcast(spark.createDataFrame(units, UNIT)), ["b", "hot", "piece"])
    return rows.select("unit", "start", "earlier", "doc_id", "body"), start


def sequences(rows: DataFrame, total: int, key: int, length: int = LENGTH, kind: Ids = UTF8) -> DataFrame:
    """Rows (slot, doc_id, seq_no, ids) of records, the last of a document not filled up yet; units lie together, sorted by id."""
    size = length * kind.width
    end = kind.pack([kind.end])

    def make():
        now, doc, number, seq = None, None, 0, 0

        def step(batch):
            nonlocal now, doc, number, seq
            docs, numbers, seqs, records = [], [], [], []
            units, starts, earlier, ids = (c.to_pylist() for c in batch.columns[:4])
            for unit, start, before, own, body in zip(units, starts, earlier, ids, batch.column(4), strict=True):
                if unit != now:
                    now, number, doc = unit, start, None
                if own != doc:  # rows of an equal id go on counting
                    doc, seq = own, before
                data = body.as_py() + end
                n = -(-len(data) // size)
                docs += [own] * n
                numbers += range(number, number + n)
                seqs += range(seq, seq + n)
                records += [data[k * size : (k + 1) * size] for k in range(n)]
                number, seq = number + n, seq + n
            slot = permuted(np.array(numbers, np.int64), total, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(docs, pa.int64()), pa.array(seqs, pa.int64()), pa.array(records, pa.binary())],
                ["slot", "doc_id", "seq_no", "ids"],
            )

        return step

    return map_texts(rows, ["unit", "start", "earlier", "doc_id", "body"], make, "slot bigint, doc_id bigint, seq_no bigint, ids binary")


SHARD = "shard bigint, first_slot bigint, doc_id array<bigint>, seq_no array<bigint>, body binary"


def write_shards(documents: DataFrame, path: str, key: int, length: int = LENGTH, per_shard: int = PER_SHARD, kind: Ids = UTF8, own: bool = False) -> int:
    """Writes all sequences in training order under ``path``; returns their number. ``documents`` has ``packed``, ``ids`` or ``text``.

    Records are written between the two shuffles, so that the disk holds one of them at a time; ``own``: ``documents`` is a staged
    table that nobody needs any longer then, and is deleted.
    """
    docs, total = numbered(packed(documents, kind), length * kind.width)
    together = docs.repartition(partitions(docs), "unit").sortWithinPartitions("unit", "doc_id", "body")
    pad, size = kind.pack([kind.pad]), length * kind.width
    records = staged(sequences(together, total, key, length, kind), "records")
    if own:
        discard(documents)
    rows = records.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("bigint"))
    dealt = rows.repartition(partitions(docs), "shard").sortWithinPartitions("shard", "slot")

    def run(batches):
        now, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "slot", "doc_id", "seq_no", "ids")), strict=True):
                if row[0] != now and held:
                    yield shard(now, held)
                    held = []
                now = row[0]
                held.append(row[1:])
        if held:
            yield shard(now, held)

    def shard(number, held):
        slots = [h[0] for h in held]
        if slots != list(range(number * per_shard, number * per_shard + len(held))):
            raise ValueError(f"shard {number} has a gap")
        columns = [[number], [slots[0]], [[h[1] for h in held]], [[h[2] for h in held]], [b"".join(h[3] + pad * ((size - len(h[3])) // kind.width) for h in held)]]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in SHARD.split(", ")])

    written(dealt.mapInArrow(run, SHARD), path)
    discard(records)
    return total


def read_records(spark: SparkSession, path: str, first_slot: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD, kind: Ids = UTF8) -> DataFrame:
    """Records from a slot on: (slot, shard, at, doc_id, seq_no, ids); earlier shards are not read."""
    size = length * kind.width
    shards = spark.read.schema(SHARD).parquet(path).where(F.col("shard") >= first_slot // per_shard)

    def run(batches):
        for batch in batches:
            for number, start, docs, seqs, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.arange(len(docs)) * size
                keep = start + np.arange(len(docs)) >= first_slot
                ids = [body[a : a + size] for a in at]
                columns = [pa.array(start + np.arange(len(docs))), pa.array([number] * len(docs), pa.int64()), pa.array(at), pa.array(docs, pa.int64()), pa.array(seqs, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in columns], ["slot", "shard", "at", "doc_id", "seq_no", "ids"])

    return shards.mapInArrow(run, "slot bigint, shard bigint, at bigint, doc_id bigint, seq_no bigint, ids binary")


def tokenised(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the packed piece ids of each text, encoded once: they are counted and dealt from what was written."""
    width = ids_of(model_path).width

    def make():
        encoder = Encoder(model_path)

        def step(batch):
            flat, counts = encoder.encode(texts_of(batch))
            ends = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts * width, out=ends[1:])
            bodies = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype(f"<u{width}"))])
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), bodies], ["doc_id", "packed"])

        return step

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    return staged(map_texts(docs, ["doc_id", "text"], make, "doc_id bigint, packed binary"), "ids")


def materialise(documents: DataFrame, key: int = 20_240_229, kind: Ids = UTF8, own: bool = False) -> DataFrame:
    """Writes the shards to the shared folder and returns one row for each record read back, with its SHA-256; ``own`` as in ``write_shards``."""
    spark = documents.sparkSession
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(documents, path, key, kind=kind, own=own)

    def run(batches):
        for batch in batches:
            ids = batch.column(5).to_pylist()
            length = [int(np.count_nonzero(np.frombuffer(x, f"<u{kind.width}") != kind.pad)) for x in ids]
            digest = [hashlib.sha256(x).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(length, pa.int32()), pa.array(digest)], ["slot", "shard", "at", "doc_id", "seq_no", "n_ids", "ids_sha256"]
            )

    schema = "slot bigint, shard bigint, at bigint, doc_id bigint, seq_no bigint, n_ids int, ids_sha256 string"
    return read_records(spark, path, kind=kind).mapInArrow(run, schema)
