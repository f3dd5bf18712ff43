"""Operator 7: benchmark decontamination with suffix arrays of the training texts.

Every slice of documents is a shard. Its words that can take part in a match are laid out in one array, the suffixes of which are
sorted by prefix doubling; every benchmark suffix is then looked up by binary search. The range of suffixes that share its
first words gives all occurrences, which are extended to the longest verbatim match with its place. Texts never leave
their task. The benchmark is cut into blocks of about ``block_words`` words. One block is broadcast at a time: a larger benchmark
takes a pass over the documents for each block, whose matches are written to the shared folder under the text's 64-bit hash, and the
block is given up before the next one is read. So neither the driver nor a task ever holds more than one block.

An item above ``block_words`` words is cut into pieces that share all but one word of a window. Its hits are whole; a match that runs
across a border is told as one match for each piece.

Results of corner cases: a null or empty text has no words and is never hit; an item without words or without an id has no
windows; equal item ids count once; an empty benchmark hits nothing; repeated documents are judged each.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.llm.common import column_of, discard, map_texts, ranges, staged, text_key, texts_of

WINDOW = 10
#: Letters, digits and bytes above ASCII are parts of words; A-Z becomes a-z and all else a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Pairs of occurrence and benchmark suffix that are extended at once.
PAIRS_AT_ONCE = 1 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Block:
    """Some benchmark items: word ids, all words in one array, and the suffixes that start a window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.names = sorted({str(i) for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.ids: dict[bytes, int] = {}
        flat, suffix, width, item, left = [], [], [], [], []
        for name, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text or "")]
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if words else 0):
                suffix.append(len(flat) + k)
                width.append(size)
                item.append(number[str(name)])
                left.append(len(words) - k)
            flat += [*words, 0]
        self.flat = np.array([*flat, 0], np.int64)
        self.suffix, self.width = np.array(suffix, np.int64), np.array(width, np.int64)
        self.item, self.left = np.array(item, np.int64), np.array(left, np.int64)
        self.depth = int(self.left.max()) if len(left) else 0
        # three words fit one number only while there are fewer than 2^20 different ones
        self.gram = int(min([3 if len(self.ids) < 1 << 20 else 2, *width]))
        full = np.flatnonzero(self._grams(self.flat) >= 0) if len(left) else np.zeros(0, np.int64)
        self.grams = np.unique(self._grams(self.flat)[full])

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        """A number for the ``gram`` words that start at each place, -1 where one of them is in no item."""
        key, ok = ids.astype(np.int64), ids > 0
        base = len(self.ids) + 1
        for k in range(1, self.gram):
            later = np.r_[ids[k:], np.zeros(min(k, len(ids)), ids.dtype)]
            key, ok = key * base + later, ok & (later > 0)
        return np.where(ok, key, -1)

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Places whose next ``gram`` words also follow each other somewhere in an item."""
        key = self._grams(ids)
        place = np.flatnonzero(key >= 0)
        if not len(place) or not len(self.grams):
            return place[:0]
        at = np.minimum(np.searchsorted(self.grams, key[place]), len(self.grams) - 1)
        return place[self.grams[at] == key[place]]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` words, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    have, order = 1, np.argsort(rank, kind="stable")
    while have < depth:
        ahead = np.r_[rank[have:], np.zeros(min(have, len(rank)), np.int64)]
        key = rank * (len(rank) + 2) + ahead
        order = np.argsort(key, kind="stable")
        put = key[order]
        fresh = np.cumsum(np.r_[True, put[1:] != put[:-1]])
        rank = np.empty_like(rank)
        rank[order] = fresh
        have *= 2
        if fresh[-1] == len(rank):
            break
    return order


def _bound(text: np.ndarray, order: np.ndarray, block: Block, upper: bool) -> np.ndarray:
    """For each benchmark suffix the first place in ``order`` whose words are above its window (or not below it)."""
    low = np.zeros(len(block.suffix), np.int64)
    high = np.full(len(block.suffix), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        sign = np.zeros(len(open_), np.int64)
        same = np.arange(len(open_))
        step = 0
        while len(same):
            same = same[step < block.width[open_[same]]]
            difference = text[order[middle[same]] + step] - block.flat[block.suffix[open_[same]] + step]
            sign[same] = np.sign(difference)
            same = same[difference == 0]
            step += 1
        below = sign <= 0 if upper else sign < 0
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
    return low


def shard_matches(ids: np.ndarray, block: Block) -> tuple[np.ndarray, ...]:
    """Left-maximal verbatim matches (place, item, length) and the hit places of the words ``ids`` (0: in no item)."""
    none = np.zeros(0, np.int64)
    starts = block.starts(ids)
    if not len(starts):
        return none, none, none, none
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + block.gram, len(ids)), -1)
    place = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    # A break after every run, so that no match crosses words that were left out.
    breaks = np.flatnonzero(np.diff(place) != 1) + 1
    text = np.insert(ids[place], breaks, 0)
    origin = np.insert(place, breaks, -1)
    order = suffix_array(text, block.depth)
    padded = np.r_[text, np.zeros(block.depth + 1, text.dtype)]
    low, high = _bound(padded, order, block, False), _bound(padded, order, block, True)
    hit = np.zeros(len(text) + 1, np.int64)
    at, what, length = [], [], []
    found = np.flatnonzero(high > low)
    sizes = (high - low)[found]
    part = np.cumsum(sizes) // PAIRS_AT_ONCE
    for chunk in np.split(found, np.flatnonzero(np.diff(part)) + 1) if len(found) else []:
        count = (high - low)[chunk]
        j = np.repeat(chunk, count)
        p = order[ranges(low[chunk], count)]
        np.add.at(hit, p, 1)
        np.add.at(hit, p + block.width[j], -1)
        s = block.suffix[j]
        before = np.where(p > 0, text[p - 1], 0)
        first = (s == 0) | (block.flat[s - 1] == 0) | (before != block.flat[s - 1])
        p, j, s = p[first], j[first], s[first]
        size = block.width[j].copy()
        going = np.arange(len(p))
        while len(going):
            step = size[going]
            going = going[step < block.left[j[going]]]
            step = size[going]
            going = going[padded[p[going] + step] == block.flat[s[going] + step]]
            size[going] += 1
        at.append(origin[p])
        what.append(block.item[j])
        length.append(size)
    if not at:
        return none, none, none, none
    return np.concatenate(at), np.concatenate(what), np.concatenate(length), origin[np.cumsum(hit[:-1]) > 0]


#: Parts of a block's size that items are dealt to and blocks are packed from.
PARTS = 8
NO_WORD = r"[^0-9A-Za-z\x80-\x{10FFFF}]+"


def block_items(benchmark: DataFrame, block_words: int, window: int) -> list[DataFrame]:
    """The items (item_id, text) of each block; only the number of words of each part passes the driver."""
    words = F.filter(F.split("text", NO_WORD), lambda w: w != "")
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), "text", F.size(words).cast("bigint").alias("n")
    )
    total = items.agg(F.sum("n")).first()[0] or 0
    if total <= block_words:
        return [items.select("item_id", "text")]
    step = max(1, block_words - window + 1)
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)).cast("int"), F.lit(step)),
        lambda at: F.array_join(F.slice(words, at + 1, block_words), " "),
    )
    cut = F.when(F.col("n") > block_words, pieces).otherwise(F.array("text"))
    items = items.select("item_id", F.explode(cut).alias("text")).distinct()
    parts = PARTS * -(-total // block_words)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    sizes = items.groupBy(part.alias("part")).agg(F.sum(F.size(F.filter(F.split("text", NO_WORD), lambda w: w != ""))).alias("n"))
    starts, held = [0], 0
    for r in sizes.orderBy("part").toLocalIterator():
        if held and held + r["n"] > block_words:
            starts.append(r["part"])
            held = 0
        held += r["n"]
    return [items.where(part.between(low, high - 1)) for low, high in zip(starts, [*starts[1:], parts], strict=True)]


MATCHES = "matches array<struct<item_id: string, at: int, words: int>>"


def _matches_of(documents: DataFrame, items: DataFrame | None, window: int, id_column: str, text_column: str) -> tuple:
    """Per document n_words, n_hit, items, longest and all matches with ``items`` as one block, and its broadcast; None counts words only."""
    rows = [] if items is None else [tuple(r) for r in items.collect()]
    shared = documents.sparkSession.sparkContext.broadcast(Block(rows, window))
    kind = documents.schema[id_column].dataType.simpleString()

    def make():
        block = shared.value

        def step(batch):
            words = [words_of(t) for t in texts_of(batch, text_column)]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            # one empty word between documents
            begin = np.cumsum(counts + 1) - (counts + 1)
            hits = np.zeros(int((counts + 1).sum()), bool)
            matches: list[set] = [set() for _ in words]
            if block.depth:
                ids = np.zeros(len(hits), np.int64)
                ids[ranges(begin, counts)] = np.fromiter(
                    (i for w in words for i in map(block.ids.get, w, repeat(0))), np.int64, int(counts.sum())
                )
                at, item, length, hit = shard_matches(ids, block)
                hits[hit] = True
                owner = np.searchsorted(begin, at, "right") - 1
                for d, p, i, n in zip(owner.tolist(), (at - begin[owner]).tolist(), item.tolist(), length.tolist(), strict=True):
                    matches[d].add((p, block.names[i], n))
            total = np.r_[0, np.cumsum(hits)]
            found = [sorted(m) for m in matches]
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, id_column), pa.array(counts), pa.array(total[begin + counts] - total[begin]),
                    pa.array([sorted({i for _, i, _ in m}) for m in found], pa.list_(pa.string())),
                    pa.array([max((n for _, _, n in m), default=0) for m in found], pa.int32()),
                    pa.array(
                        [[{"item_id": i, "at": p, "words": n} for p, i, n in m] for m in found],
                        pa.list_(pa.struct([("item_id", pa.string()), ("at", pa.int32()), ("words", pa.int32())])),
                    ),
                ],
                ["doc_id", "n_words", "n_hit", "items", "longest", "matches"],
            )

        return step

    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, longest int, {MATCHES}"
    return map_texts(documents, [id_column, text_column], make, schema), shared


def _covered(matches: Column) -> Column:
    """Number of words inside matches that are ordered by place: every window inside a match is an occurrence, and each lies in one."""
    def add(so_far: Column, m: Column) -> Column:
        end = m["at"] + m["words"]
        fresh = F.greatest(end - F.greatest(so_far["end"], m["at"]), F.lit(0))
        return F.struct(F.greatest(so_far["end"], end).alias("end"), (so_far["n"] + fresh).alias("n"))

    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(matches, none, add, lambda so_far: so_far["n"])


def find_matches(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 1_000_000,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Per document: n_words, n_hit (words in a benchmark window), sorted item ids, the longest match, and all matches."""
    blocks = block_items(benchmark, block_words, window)
    if len(blocks) == 1:
        return _matches_of(documents, blocks[0], window, id_column, text_column)[0]
    texts = documents.select(F.col(id_column).alias("doc_id"), text_key(text_column).alias("_key"), F.col(text_column).alias("text"))
    passes = []
    for items in blocks:
        found, shared = _matches_of(texts, items, window, "_key", "text")
        passes.append(staged(found.where("size(matches) > 0").select(F.col("doc_id").alias("_key"), "matches").distinct(), "matches"))
        shared.destroy()
    every = reduce(DataFrame.unionAll, passes).groupBy("_key").agg(F.flatten(F.collect_list("matches")).alias("found"))
    by_place = F.transform("found", lambda m: F.struct(m["at"].alias("at"), m["item_id"].alias("item_id"), m["words"].alias("words")))
    back = F.transform(
        F.sort_array(F.array_distinct(by_place)), lambda m: F.struct(m["item_id"].alias("item_id"), m["at"].alias("at"), m["words"].alias("words"))
    )
    every = staged(every.select(F.col("_key").alias("_found"), back.alias("_matches")), "matches")
    discard(*passes)
    # words are counted where the texts lie; only id, key and that number meet the matches
    counted, _ = _matches_of(texts.select(F.struct("doc_id", "_key").alias("doc_id"), "text"), None, window, "doc_id", "text")
    none = F.array().cast(every.schema["_matches"].dataType)
    rows = counted.select("doc_id.doc_id", "doc_id._key", "n_words").join(every, F.col("_key") == F.col("_found"), "left")
    rows = rows.withColumn("matches", F.coalesce("_matches", none))
    return rows.select(
        "doc_id", "n_words", _covered(F.col("matches")).alias("n_hit"),
        F.sort_array(F.array_distinct(F.col("matches.item_id"))).alias("items"),
        F.coalesce(F.array_max(F.col("matches.words")), F.lit(0)).alias("longest"), "matches",
    )
