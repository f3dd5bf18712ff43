"""Operator 4: SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of a batch lie one after the other in a flat array of symbols. In each round every word finds the
best rank among its neighbouring pairs (a segmented minimum) and merges all leftmost, non-overlapping pairs of
that rank at once; the array is compacted and finished words leave it, until no pair remains. Merging
all occurrences at once equals the one-by-one order, unless a merged piece can start a pair of a better or equal rank;
those pieces are found from the vocabulary, and of them only the leftmost pair of a word is merged in a round.
A word of more than QUEUED characters could need as many rounds, so its pairs wait in a queue by rank and place instead.

Results of corner cases: a null text counts as empty; an empty text has the end id only and decodes to "";
characters outside of the vocabulary become byte pieces; rows that repeat are encoded each; null ids are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from outturn.llm.common import column_of, lists, map_texts, ranges, texts_of

SPACE = "▁"
PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NONE = np.int32(2**31 - 1)
#: Characters of a word from which on its pairs are merged through a queue: rounds of such a word could be as many as its characters.
QUEUED = 256
#: Distinct words whose pieces a task remembers before it starts anew; longer words are not remembered.
REMEMBERED, LONG_WORD = 150_000, 48


class Vocabulary:
    """Pieces, pair ranks and byte pieces of a SentencePiece BPE model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.size, self.end, self.unknown = size, model.eos_id(), model.unk_id()
        names = [model.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = np.full(256, self.unknown, np.int32)
        self.raw: list[bytes] = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i):
                self.raw.append(b"")
            elif model.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.raw.append(name.replace(SPACE, " ").encode())
        self.leads = np.array([name.startswith(SPACE) for name in names])
        ids = {names[i]: i for i in normal}
        self.ids = ids
        # Symbols: piece ids first, then single characters that only occur inside pieces.
        self.symbols = dict(ids)
        for name in list(ids):
            for char in name:
                self.symbols.setdefault(char, len(self.symbols) + size)
        order = {score: rank for rank, score in enumerate(sorted({model.get_score(i) for i in normal}, reverse=True))}
        rank = {i: order[model.get_score(i)] for i in normal}
        self.base = size + len(self.symbols) + 1
        keys, made, ranks = [], [], []
        self.careful = np.zeros(self.base, bool)
        for name, whole in ids.items():
            for cut in range(1, len(name)):
                left, right = self.symbols.get(name[:cut]), self.symbols.get(name[cut:])
                if left is None or right is None:
                    continue
                keys.append(left * self.base + right)
                made.append(whole)
                ranks.append(rank[whole])
                for part, text in ((left, name[:cut]), (right, name[cut:])):
                    if len(text) > 1 and rank[whole] <= rank[part]:
                        self.careful[part] = True
        sort = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[sort]
        self.made = np.array(made, np.int32)[sort]
        self.ranks = np.array(ranks, np.int32)[sort]
        # Neighbours inside pieces, by numbers of characters; 0 is a character outside of all of them. Nothing merges across others.
        chars = sorted({c for name in ids if len(name) > 1 for c in name})
        self.number = np.zeros(0x110000, np.int16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.near = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for name in ids:
            if len(name) > 1:
                at = self.number[[ord(c) for c in name]]
                self.near[at[:-1], at[1:]] = True
        self.by_point = -1 - np.arange(0x110000, dtype=np.int64)
        for name, symbol in self.symbols.items():
            if len(name) == 1:
                self.by_point[ord(name)] = symbol
        # A space mark only ever leads a piece, so nothing merges across the start of a run of them.
        self.splits = not any(SPACE in name.lstrip(SPACE) for name in ids)

    def words(self, text: str) -> list[str]:
        """The parts of a text between which nothing can merge; joined they are the normalised text."""
        if not text:
            return []
        marked = text.replace(SPACE, " ")
        if not self.splits:
            return [SPACE + marked.replace(" ", SPACE)]
        return PARTS.findall(SPACE + marked.replace(" ", SPACE))

    def parts(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The words cut where no piece has the two characters side by side, and the number of parts of each."""
        text = "".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        number = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        edge = np.ones(len(text) + 1, bool)
        edge[1:-1] = ~self.near[number[:-1], number[1:]]
        ends = np.cumsum(sizes)
        edge[ends] = True
        before = np.r_[0, np.cumsum(edge)]
        at = np.flatnonzero(edge).tolist()
        return [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], before[ends] - before[ends - sizes]

    def _pairs(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pair that starts at each place of ``at``; rank NONE where nothing merges."""
        rank, made = np.full(len(at), NONE, np.int32), np.zeros(len(at), np.int64)
        after = np.minimum(at + 1, len(symbol) - 1)
        near = np.flatnonzero((after > at) & (owner[at] == owner[after]) & (symbol[at] >= 0) & (symbol[after] >= 0))
        key = symbol[at[near]] * self.base + symbol[after[near]]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        rank[near[hit]], made[near[hit]] = self.ranks[place[hit]], self.made[place[hit]]
        return rank, made

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the number of ids of each."""
        long = [k for k, w in enumerate(words) if len(w) > QUEUED]
        if not long:
            return self._by_rounds(words)
        flat, counts = self._by_rounds(["" if len(w) > QUEUED else w for w in words])
        ends, parts, last = np.cumsum(counts), [], 0
        for k in long:
            ids, size = self._by_queue(words[k])
            parts += [flat[last : ends[k]], ids]
            last, counts[k] = ends[k], size
        return np.concatenate([*parts, flat[last:]]), counts

    def _by_queue(self, word: str) -> tuple[np.ndarray, int]:
        """Ids of one word: the pair of the best rank, then of the leftmost place, is merged next."""
        if not hasattr(self, "table"):
            self.table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, back = np.unique(points, return_inverse=True)
        symbols = np.array([self.symbols.get(chr(k), -1 - int(k)) for k in kinds], np.int64)[back]
        n, base, table = len(symbols), self.base, self.table
        rank, _ = self._pairs(symbols, np.zeros(n, np.int64), np.arange(n))
        at = np.flatnonzero(rank != NONE)
        queue = np.sort((rank[at].astype(np.int64) << 32) | at).tolist()
        symbol, gone = symbols.tolist(), -(1 << 40)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        place = (1 << 32) - 1

        def wait(i: int, j: int) -> None:
            if symbol[i] >= 0 and symbol[j] >= 0:
                found = table.get(symbol[i] * base + symbol[j])
                if found:
                    heappush(queue, found[0] << 32 | i)

        while queue:
            best = heappop(queue)
            i = best & place
            j = after[i]
            if j < 0 or symbol[i] < 0 or symbol[j] < 0:
                continue
            found = table.get(symbol[i] * base + symbol[j])
            if not found or found[0] != best >> 32:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = found[1], gone
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                wait(i, k)
            if before[i] >= 0:
                wait(before[i], i)
        left = np.array(symbol, np.int64)
        left = left[left != gone]
        ids, _ = self._spell(left, np.zeros(len(left), np.int64), 1)
        return ids, len(ids)

    def _by_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(words)
        owner = np.repeat(np.arange(len(words), dtype=np.int64), np.fromiter(map(len, words), np.int64, len(words)))
        # A character outside of all pieces is a symbol below zero; it never merges.
        symbol = self.by_point[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        done_symbol, done_owner = [], []
        if len(symbol):
            pair_rank, made = self._pairs(symbol, owner, np.arange(len(symbol)))
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(pair_rank, starts)
            size = np.diff(np.r_[starts, len(symbol)])
            finished = np.repeat(best == NONE, size)
            if finished.any():
                done_symbol.append(symbol[finished])
                done_owner.append(owner[finished])
            chosen = np.flatnonzero((pair_rank == np.repeat(best, size)) & (pair_rank != NONE))
            if not len(chosen):
                break
            # Of overlapping pairs the leftmost wins, then every second one.
            fresh = np.r_[True, chosen[1:] != chosen[:-1] + 1]
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - run_start) % 2 == 0]
            careful = self.careful[made[chosen]]
            if careful.any():
                first = np.r_[True, owner[chosen[1:]] != owner[chosen[:-1]]]
                # one careful pair in a word keeps the whole round of that word to its leftmost pair
                of_word = np.cumsum(first) - 1
                slow = np.zeros(of_word[-1] + 1, bool)
                slow[of_word[careful]] = True
                chosen = chosen[first | ~slow[of_word]]
            symbol[chosen] = made[chosen]
            keep = ~finished
            keep[chosen + 1] = False
            moved = np.cumsum(keep)[chosen] - 1
            symbol, owner, pair_rank, made = symbol[keep], owner[keep], pair_rank[keep], made[keep]
            # only the pairs around a merged symbol are new
            fresh = np.zeros(len(symbol), bool)
            fresh[moved] = fresh[np.maximum(moved - 1, 0)] = True
            again = np.flatnonzero(fresh)
            pair_rank[again], made[again] = self._pairs(symbol, owner, again)
        if done_symbol:
            symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
            sort = np.argsort(owner, kind="stable")
            symbol, owner = symbol[sort], owner[sort]
        return self._spell(symbol, owner, len(words))

    def _spell(self, symbol: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece of their own become the byte pieces of their character."""
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.size))
        if len(odd):
            chars = {v: k for k, v in self.symbols.items() if v >= self.size}
            width = np.ones(len(symbol), np.int64)
            spelled = {}
            for s in np.unique(symbol[odd]).tolist():
                char = chr(-1 - s) if s < 0 else chars[s]
                spelled[s] = self.byte_ids[np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8)]
            width[odd] = [len(spelled[s]) for s in symbol[odd].tolist()]
            out = np.repeat(symbol, width)
            place = np.cumsum(width) - width
            out[ranges(place[odd], width[odd])] = np.concatenate([spelled[s] for s in symbol[odd].tolist()])
            owner = np.repeat(owner, width)
            symbol = out
        return symbol.astype(np.int32), np.bincount(owner, minlength=n)

    def decode_all(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of many lists of ids, given as flat ids and the length of each list."""
        if not hasattr(self, "raw_flat"):
            self.raw_size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
            self.raw_start = np.cumsum(self.raw_size) - self.raw_size
            self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        sizes = self.raw_size[flat]
        data = self.raw_flat[ranges(self.raw_start[flat], sizes)].tobytes()
        ends, byte_ends = np.cumsum(counts), np.r_[0, np.cumsum(sizes)]
        # a control id anywhere but at the end may part bytes from each other
        control = np.r_[0, np.cumsum(sizes == 0)]
        out = []
        for start, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            if start == end:
                out.append("")
            elif control[end - 1] > control[start]:
                out.append(self.decode(flat[start:end].tolist()))
            else:
                part = data[byte_ends[start] + bool(self.leads[flat[start]]) : byte_ends[end]]
                out.append(_text(part))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; bytes that are not UTF-8 become U+FFFD each."""
        out, run = [], []
        for i in ids:
            if self.raw[i]:
                run.append(self.raw[i])
            elif run:  # a control id parts bytes from each other
                out.append(b"".join(run))
                run = []
        if run:
            out.append(b"".join(run))
        first = next((i for i in ids if self.raw[i]), None)
        if first is not None and self.leads[first]:
            out[0] = out[0][1:]
        return "".join(map(_text, out))


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return _lenient(data)


def _lenient(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(data[at : at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(out)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Numbers(dict):
    """Numbers strings in the order in which they are first asked for; ``new`` are those since it was emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, string: str) -> int:
        number = self[string] = len(self)
        self.new.append(string)
        return number


class Remembered:
    """Flat ids of strings; those met before are looked up, the others are made by ``make(strings)``."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.make = make
        self._forget()

    def _forget(self) -> None:
        self.place = Numbers()
        self.flat = np.zeros(0, np.int32)
        self.start = self.count = np.zeros(0, np.int64)

    def look_up(self, strings: Iterable[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the ``n`` strings and the number of ids of each."""
        at = np.fromiter(map(self.place.__getitem__, strings), np.int64, n)
        new = self.place.new
        if new:
            ids, counts = self.make(new)
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(counts) - counts]
            self.count = np.r_[self.count, counts]
            self.flat = np.r_[self.flat, ids]
        counts = self.count[at]
        flat = self.flat[ranges(self.start[at], counts)]
        if len(self.place) > REMEMBERED or max(map(len, new), default=0) > LONG_WORD * 100:
            self._forget()
        else:
            self.place.new = []
        return flat, counts


class Encoder:
    """Encodes texts of a task; pieces of words, and of parts of words, seen before are looked up."""

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary(path)
        self.of_words = Remembered(self._by_parts)
        self.of_parts = Remembered(self.vocabulary.encode_words)

    def _words(self, text: str) -> list[str]:
        """The words of a text without the space mark that each begins with."""
        if text and self.vocabulary.splits and "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text:
            return text.split(" ")
        return [w[1:] for w in self.vocabulary.words(text)]

    def _by_parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = self.vocabulary.parts([SPACE + w for w in words])
        flat, counts = self.of_parts.look_up(parts, len(parts))
        totals, ends = np.r_[0, np.cumsum(counts)], np.cumsum(sizes)
        return flat, totals[ends] - totals[ends - sizes]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts without end ids, and the number of ids of each."""
        split = [self._words(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat, counts = self.of_words.look_up(chain.from_iterable(split), int(sizes.sum()))
        totals, ends = np.r_[0, np.cumsum(counts)], np.cumsum(sizes)
        return flat, totals[ends] - totals[ends - sizes]


def encode(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", end: bool = True) -> DataFrame:
    """One row per row of ``df``: the id and ``ids array<int>`` of the whole text, with the end id if asked."""
    kind = df.schema[id_column].dataType.simpleString()

    def make():
        encoder = Encoder(model_path)

        def step(batch):
            flat, counts = encoder.encode(texts_of(batch, text_column))
            if end:
                ends = np.cumsum(counts)
                flat, counts = np.insert(flat, ends, encoder.vocabulary.end), counts + 1
            ids = lists(flat, counts, pa.int32())
            yield pa.RecordBatch.from_arrays([column_of(batch, id_column), ids], ["doc_id", "ids"])

        return step

    return map_texts(df, [id_column, text_column], make, f"doc_id {kind}, ids array<int>")


def decode(df: DataFrame, model_path: str) -> DataFrame:
    """``df`` of doc_id and ids with the decoded ``text`` beside them; null ids decode to ""."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def make():
        words = vocabulary(model_path)

        def step(batch):
            ids = column_of(batch, "ids")
            counts = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            text = pa.array(words.decode_all(ids.flatten().to_numpy(zero_copy_only=False), counts), pa.string())
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), ids, text], ["doc_id", "ids", "text"])

        return step

    return map_texts(df, ["doc_id", "ids"], make, f"doc_id {kind}, ids array<int>, text string")
