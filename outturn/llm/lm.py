"""Operator 10: scoring by a causal self-attention model, written in numpy, on subword ids.

Lower-cased words are spelled in a small inventory of bytes and of those pieces of a public vocabulary that the corpus uses most. The model predicts each next id from the ids before it in
its window: embeddings of ids and hashed pairs, one head of masked self-attention with a learnt bias per distance, a
hidden layer, and a softmax in two steps (class, then id in the class). Its logits start from id pairs counted over the words of the
whole training corpus, so what it knows grows with the input. Windows overlap: each gives context to the ids at its end,
and every id is scored once, in batches.

Training: every span of every training document is dealt by a hash to one round and one group of bounded size; in a round each group
trains a copy of the weights, and the copies are averaged by Spark, so that scores don't depend on how the input is split.

Pieces of the inventory, id pairs and contexts are counted over all words. The word base (counts of words and ends, add one) is exact: frequent words are looked up in a table of at most
``FREQUENT`` words, the others meet their counts in a join.

Results of corner cases: a null or empty text is one end token; without training rows all counts are 0 and the pair table is
flat; repeated rows count and are scored each; rows with a null id are scored as training rows.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.llm.common import column_of, lists, map_texts, ranges, remainder, shared_folder, staged, texts_of
from outturn.llm.jaccard import MIX, scramble
from outturn.llm.pieces import SPACE, vocabulary

#: Ids: end of text, bytes, then pieces; they fall into CLASSES classes of as many ids.
SIZE, CLASSES = 1024, 32
END, BYTES, BOUND = 0, 1, SIZE
#: Beginnings of words that have a context of their own.
CONTEXTS = 3072
#: Weight of the previous id against what a beginning of a word has been followed by.
BACK = 20.0
#: Widths of embeddings and of the hidden layer, hashed pairs, ids of a window and ids scored in it.
WIDTH, HIDDEN, PAIRS = 16, 32, 2048
WINDOW, SCORED = 32, 24
#: Rounds that the spans are dealt to, each span to one; spans that a copy of the model is trained on in a round; spans that a task holds.
ROUNDS, GROUP, HELD = 8, 2048, 1024
#: Windows of a step; rate of a step; numbers of a row in which copies travel.
STEP, RATE, SLICE = 64, 0.1, 8192
#: Bound of the words of the broadcast table, and of the words that a task counts before it hands them on.
FREQUENT, COUNTED = 200_000, 400_000
REMEMBERED = 400_000


def inventory(path: str, words: list[bytes], counts: np.ndarray) -> list[str]:
    """The space mark and the pieces that the model file's encoding of these words uses most, weighted by their counts."""
    return most_used(path, piece_weights(path, words, counts))


def piece_weights(path: str, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    source = vocabulary(path)
    spelled = [SPACE + w.decode("utf-8", "surrogatepass") for w in words if w]
    ids, sizes = source.encode_words(spelled)
    return np.bincount(ids, weights=np.repeat(counts[[k for k, w in enumerate(words) if w]], sizes), minlength=source.size)


def most_used(path: str, weight: np.ndarray) -> list[str]:
    names = {i: n for n, i in vocabulary(path).ids.items()}
    order = np.argsort(-weight, kind="stable")
    ascii_ = {chr(b) for b in range(128)}
    used = [names[i] for i in order.tolist() if weight[i] > 0 and i in names and names[i] not in ascii_ and names[i] != SPACE]
    return [SPACE, *used[: SIZE - BYTES - 256 - 1]]


class Trie:
    """The inventory as a dense transition table, so that all places of many words are matched at once."""

    def __init__(self, names: list[str]) -> None:
        pieces = {n: BYTES + 256 + k for k, n in enumerate(names)}
        chars = sorted({c for p in pieces for c in p})
        self.chars = np.array([ord(c) for c in chars])
        self.longest = max(map(len, pieces))
        number = {c: k + 1 for k, c in enumerate(chars)}
        table, final = [[0] * (len(chars) + 1) for _ in range(2)], [-1, -1]  # 0: no way on, 1: start
        for piece, id_ in pieces.items():
            node = 1
            for c in piece:
                if not table[node][number[c]]:
                    table[node][number[c]] = len(table)
                    table.append([0] * (len(chars) + 1))
                    final.append(-1)
                node = table[node][number[c]]
            final[node] = id_
        self.table, self.final = np.array(table, np.int32), np.array(final, np.int32)

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids by greedy longest match and the number of ids of each word; bytes where no piece fits."""
        points = np.frombuffer("".join(w + "\x00" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        kind = np.where(self.chars[at] == points, at + 1, 0)
        kind = np.r_[kind, np.zeros(self.longest, np.int64)]
        n = len(points)
        size, found = np.ones(n, np.int64), np.full(n, -1, np.int64)
        walking, node = np.arange(n), np.ones(n, np.int64)  # places from which a longer piece may still come
        for k in range(self.longest):
            node = self.table[node, kind[walking + k]]
            walking, node = walking[node > 0], node[node > 0]
            if not len(walking):
                break
            hit = self.final[node]
            good = walking[hit >= 0]
            size[good], found[good] = k + 1, hit[hit >= 0]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        chosen = np.zeros(n, bool)
        place = ends - lengths
        live = place < ends
        place, ends = place[live], ends[live]
        while len(place):
            chosen[place] = True
            place = place + size[place]
            live = place < ends
            place, ends = place[live], ends[live]
        where = np.flatnonzero(chosen)
        ids, widths = found[where], np.ones(len(where), np.int64)
        plain = (ids < 0) & (points[where] < 128)
        ids[plain] = points[where[plain]] + BYTES
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            spelled = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) + BYTES for c in points[where[odd]].tolist()]
            widths[odd] = list(map(len, spelled))
            wide = np.repeat(ids, widths)
            wide[ranges((np.cumsum(widths) - widths)[odd], widths[odd])] = np.concatenate([s.astype(np.int64) for s in spelled])
            ids = wide
        owner = np.repeat(np.arange(len(words)), lengths + 1)[where]
        return ids, np.bincount(owner, weights=widths, minlength=len(words)).astype(np.int64)


def spell(words: list[bytes], trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and counts of words; the empty word is the end."""
    ids, counts = trie.spell([SPACE + w.decode("utf-8", "surrogatepass") if w else "" for w in words])
    ends = np.flatnonzero(counts == 0)
    ids = np.insert(ids, (np.cumsum(counts) - counts)[ends], END)
    counts = counts.copy()
    counts[ends] = 1
    return ids, counts


def prefix_hashes(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of the ids of its word up to each id."""
    out = scramble(ids.astype(np.uint64) + MIX[2])
    starts = np.cumsum(counts) - counts
    for k in range(1, int(counts.max(initial=0))):
        at = starts[counts > k] + k
        if k > 12:  # longer beginnings are nobody's context
            out[at] = 0
            continue
        out[at] = scramble(out[at - 1] * MIX[0] + ids[at].astype(np.uint64) + MIX[2])
    return out


class Speller:
    """Ids of words and the context row after each id; words seen before are looked up."""

    def __init__(self, trie: Trie, prior: Prior | None = None) -> None:
        self.trie, self.prior = trie, prior
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.row = np.zeros(0, np.int16), np.zeros(0, np.int16)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of the word lists, the context rows after them, and the number of ids of each list."""
        if len(self.place) > REMEMBERED:
            self._forget()
        place = self.place
        new = list({w for words in texts for w in words if w not in place})
        if new:
            ids, counts = spell(new, self.trie)
            row = self.prior.rows(ids, counts) if self.prior else ids
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(counts) - counts]
            self.count = np.r_[self.count, counts]
            self.flat, self.row = np.r_[self.flat, ids.astype(np.int16)], np.r_[self.row, row.astype(np.int16)]
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        word = np.fromiter(map(place.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        per_word = self.count[word]
        at = ranges(self.start[word], per_word)
        totals = np.r_[0, np.cumsum(per_word)]
        ends = np.cumsum(sizes)
        return self.flat[at], self.row[at], totals[ends] - totals[ends - sizes]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


# --- the model -----------------------------------------------------------------------------------------------------


def fresh(seed: int = 1) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)

    def normal(*shape):
        return (draw.standard_normal(shape) * 0.3 / math.sqrt(shape[0] if shape[0] < SIZE else 4)).astype(np.float32)

    return {
        "ids": normal(SIZE, WIDTH), "pairs": normal(PAIRS, WIDTH), "q": normal(WIDTH, WIDTH), "k": normal(WIDTH, WIDTH), "v": normal(WIDTH, WIDTH),
        "o": normal(WIDTH, WIDTH), "bias": np.zeros((SCORED, WINDOW), np.float32), "hidden": normal(WIDTH, HIDDEN), "shift": np.zeros(HIDDEN, np.float32),
        "class": np.zeros((HIDDEN, CLASSES), np.float32), "inside": np.zeros((CLASSES, HIDDEN, SIZE // CLASSES), np.float32),
    }


#: Scored place i of a window sees the inputs up to its own.
FUTURE = np.where(np.arange(WINDOW)[None] > np.arange(WINDOW - SCORED, WINDOW)[:, None], np.float32(-1e9), np.float32(0))
#: Row sums as products with a vector of ones.
ONES = np.ones(max(CLASSES, SIZE // CLASSES), np.float32)


def beginnings(ids: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, last id, id that follows, weight) at each place of words behind their first id."""
    hashes = prefix_hashes(ids, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids)) - (np.cumsum(sizes) - sizes)[owner]
    following = np.where(place == sizes[owner] - 1, BOUND, np.r_[ids[1:], [0]])
    deep = np.flatnonzero((place > 0) & (hashes != 0))
    return hashes[deep], ids[deep], following[deep], weight[owner[deep]]


def followers(known: np.ndarray, hashes: np.ndarray, following: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of weights by known hash and id that follows."""
    out = np.zeros((len(known), SIZE + 1))
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        use = known[at] == hashes
        np.add.at(out, (at[use], following[use]), weight[use])
    return out


class Prior:
    """log P(class | context) and log P(id | class, context) from counts.

    A context is the previous id, or the beginning of the word so far where that is one of the CONTEXTS most frequent ones.
    """

    def __init__(self, counts: np.ndarray, words: tuple | None = None, contexts: tuple | None = None) -> None:
        """``counts[a, b]``: b after a inside words; row and column BOUND stand for the space between words and the end.

        ``contexts``: hashes (sorted), last ids and counts of followers of the beginnings of words that have a row; or
        ``words``: flat ids, number of ids and count of each word, from which they are made.
        """
        inside, starts = counts[:SIZE, :SIZE], counts[BOUND, :SIZE]
        start = (starts + 0.01) / (starts + 0.01).sum()
        any_ = inside.sum(0)
        any_ = (any_ + 0.1) / (any_ + 0.1).sum()
        # what follows: a piece of the same word, or (last column) its end
        next_ = np.hstack([inside, counts[:SIZE, BOUND:]])
        flat = np.r_[0.5 * any_, 0.5]
        chance = (next_ + 4.0 * flat) / (next_.sum(1, keepdims=True) + 4.0)
        if contexts is None:
            hashes, last, following, weight = beginnings(*words)
            known, at, back = np.unique(hashes, return_index=True, return_inverse=True)
            mass = np.bincount(back, weights=weight, minlength=len(known))
            top = np.sort(np.argsort(-mass, kind="stable")[:CONTEXTS])
            contexts = known[top], last[at[top]], followers(known[top], hashes, following, weight)
        self.known, last, seen = contexts
        longer = (seen + BACK * chance[last]) / (seen.sum(1, keepdims=True) + BACK)
        rows = np.vstack([chance, longer])
        rows = rows[:, :SIZE] + rows[:, SIZE:] * start
        rows[END] = start
        rows /= rows.sum(1, keepdims=True)
        grouped = rows.reshape(len(rows), CLASSES, -1)
        by_class = grouped.sum(2)
        self.classes = np.log(by_class).astype(np.float32)
        self.inside = np.log(grouped / by_class[:, :, None]).astype(np.float32)

    def rows(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The context row that each id of some words leads to."""
        if not len(self.known):
            return ids
        hashes = prefix_hashes(ids, counts)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, SIZE + at, ids)


def forward(
    w: dict, prior: Prior, inputs: np.ndarray, pairs: np.ndarray, before: np.ndarray, targets: np.ndarray, keep: dict | None = None
) -> np.ndarray:
    """log P of each target (windows x SCORED); intermediate values go to ``keep`` for the way back."""
    b = len(inputs)
    e = w["ids"][inputs] + w["pairs"][pairs]
    flat = e.reshape(-1, WIDTH)
    both = (flat @ np.hstack([w["k"], w["v"]])).reshape(b, WINDOW, 2 * WIDTH)
    k, v = both[:, :, :WIDTH], both[:, :, WIDTH:]
    # a column of ones after the values gives the sum of each row's weights in the same product
    counted = np.ones((b, WINDOW, WIDTH + 1), np.float32)
    counted[:, :, :WIDTH] = v
    last = np.ascontiguousarray(e[:, WINDOW - SCORED :])
    q = (last.reshape(-1, WIDTH) @ (w["q"] * np.float32(1 / math.sqrt(WIDTH)))).reshape(b, SCORED, WIDTH)
    a = q @ k.transpose(0, 2, 1)
    a += w["bias"] + FUTURE
    if a.max() > 60:
        np.minimum(a, 60, out=a)
    np.exp(a, out=a)
    c = (a @ counted).reshape(-1, WIDTH + 1)
    total = c[:, WIDTH:]
    c = c[:, :WIDTH] / total
    u = last.reshape(-1, WIDTH) + c @ w["o"]
    h = u @ w["hidden"]
    h += w["shift"]
    np.maximum(h, 0, out=h)
    target = targets.ravel()
    before = before.ravel()
    group, member = target // (SIZE // CLASSES), target % (SIZE // CLASSES)
    by_class = h @ w["class"]
    by_class += prior.classes[before]
    order = np.argsort(group.astype(np.uint8), kind="stable")
    ends = np.searchsorted(group[order], np.arange(CLASSES + 1))
    sorted_h = h[order]
    inside = prior.inside[before[order], group[order]]
    for g in range(CLASSES):
        if ends[g] < ends[g + 1]:
            inside[ends[g] : ends[g + 1]] += sorted_h[ends[g] : ends[g + 1]] @ w["inside"][g]
    rows = np.arange(len(target))
    out = by_class[rows, group]
    within = inside[rows, member[order]]
    p_class, p_inside = np.exp(by_class, out=by_class), np.exp(inside, out=inside)
    sum_class, sum_inside = p_class @ ONES[:CLASSES], p_inside @ ONES[: SIZE // CLASSES]
    out -= np.log(sum_class)
    out[order] += within - np.log(sum_inside)
    if keep is not None:
        keep |= dict(e=e, k=k, v=v, q=q, a=a / total.reshape(b, SCORED, 1), c=c, u=u, h=h, last=last, group=group, member=member, order=order, ends=ends, sorted_h=sorted_h,
                     p_class=p_class / sum_class[:, None], p_inside=p_inside / sum_inside[:, None])
    return out.reshape(targets.shape)


def backward(w: dict, m: dict, inputs: np.ndarray, pairs: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean of -log P over the valid targets."""
    b, root = len(inputs), np.float32(1 / math.sqrt(WIDTH))
    share = (valid.ravel() / max(1, valid.sum())).astype(np.float32)
    rows = np.arange(len(share))
    g_class = m["p_class"].copy()
    g_class[rows, m["group"]] -= 1
    g_class *= share[:, None]
    g_inside = m["p_inside"].copy()
    g_inside[rows, m["member"][m["order"]]] -= 1
    g_inside *= share[m["order"]][:, None]
    out = {"class": m["h"].T @ g_class, "inside": np.zeros_like(w["inside"])}
    g_h = g_class @ w["class"].T
    back = np.zeros_like(g_h)
    for g in range(CLASSES):
        part = slice(m["ends"][g], m["ends"][g + 1])
        if part.start < part.stop:
            out["inside"][g] = m["sorted_h"][part].T @ g_inside[part]
            back[part] = g_inside[part] @ w["inside"][g].T
    g_h[m["order"]] += back
    g_h *= m["h"] > 0
    out["hidden"], out["shift"] = m["u"].T @ g_h, g_h.sum(0)
    g_u = g_h @ w["hidden"].T
    out["o"] = m["c"].T @ g_u
    g_c = (g_u @ w["o"].T).reshape(b, SCORED, WIDTH)
    g_a = g_c @ m["v"].transpose(0, 2, 1)
    g_a -= (g_a * m["a"]).sum(2, keepdims=True)
    g_a *= m["a"]
    out["bias"] = g_a.sum(0)
    g_v = (m["a"].transpose(0, 2, 1) @ g_c).reshape(-1, WIDTH)
    g_q = (g_a @ m["k"]).reshape(-1, WIDTH) * root
    g_k = (g_a.transpose(0, 2, 1) @ m["q"]).reshape(-1, WIDTH)
    flat, last = m["e"].reshape(-1, WIDTH), m["last"].reshape(-1, WIDTH)
    out["q"], out["k"], out["v"] = last.T @ g_q, flat.T @ g_k, flat.T @ g_v
    g_e = (g_k @ w["k"].T + g_v @ w["v"].T).reshape(b, WINDOW, WIDTH)
    g_e[:, WINDOW - SCORED :] += (g_u + g_q @ w["q"].T).reshape(b, SCORED, WIDTH)
    for name, index, size in (("ids", inputs, SIZE), ("pairs", pairs, PAIRS)):
        order = np.argsort(index.ravel(), kind="stable")
        at = index.ravel()[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[name] = np.zeros((size, WIDTH), np.float32)
        out[name][at[first]] = np.add.reduceat(g_e.reshape(-1, WIDTH)[order], first, axis=0)
    return out


def pair_hash(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (scramble(before.astype(np.uint64) * np.uint64(SIZE) + ids.astype(np.uint64) + MIX[0]) % np.uint64(PAIRS)).astype(np.int32)


def windows(flat: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(inputs, pairs, contexts, targets, valid, owner) of the windows of texts given as flat ids, context rows and lengths."""
    lead = WINDOW - SCORED + 1
    padded_counts = counts + lead + 1 + SCORED
    base = np.cumsum(padded_counts) - padded_counts
    padded = np.full(int(padded_counts.sum()), END, np.int32)
    context = padded.copy()
    inside = ranges(base + lead + 1, counts)
    padded[inside], context[inside] = flat, rows
    hashed = np.r_[np.int32(0), pair_hash(padded[:-1], padded[1:])]
    n = -(-counts // SCORED)
    owner = np.repeat(np.arange(len(counts)), n)
    j = ranges(np.zeros(len(n), np.int64), n)
    begin = base[owner] + 1 + j * SCORED
    at = begin[:, None] + np.arange(WINDOW)
    place = j[:, None] * SCORED + np.arange(SCORED)
    targets = padded[begin[:, None] + lead + np.arange(SCORED)]
    return padded[at], hashed[at], context[at[:, WINDOW - SCORED :]], targets, place < counts[owner][:, None], owner


def train(w: dict, prior: Prior, inputs, pairs, before, targets, valid, seed: int, seen: dict | None = None) -> dict:
    """One pass of scaled gradient steps over the windows, in a seeded order; the scales in ``seen`` go on from call to call."""
    w = {k: v.copy() for k, v in w.items()}
    seen = {} if seen is None else seen
    for k, v in w.items():
        seen.setdefault(k, np.full_like(v, 1e-6))
    order = np.random.default_rng(seed).permutation(len(inputs))
    for at in range(0, len(order), STEP):
        pick = order[at : at + STEP]
        keep: dict = {}
        forward(w, prior, inputs[pick], pairs[pick], before[pick], targets[pick], keep)
        for name, slope in backward(w, keep, inputs[pick], pairs[pick], valid[pick]).items():
            past = seen[name]
            past *= np.float32(0.999)
            past += slope * slope
            slope *= np.float32(RATE)
            slope /= np.sqrt(past)
            w[name] -= slope
    return w


# --- the corpus ----------------------------------------------------------------------------------------------------


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all training rows; the empty word counts the ends."""

    def make():
        def step(batch):
            counts: Counter = Counter()
            texts = texts_of(batch)
            for text in texts:
                counts.update(words_of(text))
            counts[b""] = len(texts)
            yield counts

        return step

    def run(batches):
        total: Counter = Counter()
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for counts in step(batch.slice(at, 512)):
                    total.update(counts)
                if len(total) > COUNTED:
                    yield rows(total)
                    total = Counter()
        if total:
            yield rows(total)

    def rows(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "c"])

    return training.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def pair_counts(counts: DataFrame, names: list[str]) -> np.ndarray:
    """Id pairs inside words and at their ends, weighted by word counts; at most (SIZE + 1)^2 rows reach the driver."""

    def run(batches):
        total, trie = np.zeros((SIZE + 1) ** 2), Trie(names)
        for batch in batches:
            c = batch.column(1).to_numpy()
            ids, sizes = spell(batch.column(0).to_pylist(), trie)
            ends = np.cumsum(sizes)
            flat = np.insert(ids, np.r_[0, ends], BOUND)  # one bound between words
            owner = np.r_[np.repeat(np.arange(len(c)), sizes + 1)]
            total += np.bincount(flat[:-1] * (SIZE + 1) + flat[1:], weights=c[owner], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    rows = counts.mapInArrow(run, "pair bigint, n double").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((SIZE + 1) ** 2)
    out[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return out.reshape(SIZE + 1, SIZE + 1)


def summed(counts: DataFrame, make, keys: list[str]) -> DataFrame:
    """Sums over all words, by ``keys``, of the n of ``make()`` on batches of words and their counts."""

    def run(batches):
        step = make()
        for batch in batches:
            *columns, n = step([bytes(w) for w in batch.column(0).to_pylist()], batch.column(1).to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(n)], [*keys, "n"])

    schema = ", ".join(f"{k} bigint" for k in keys) + ", n double"
    return counts.select("word", "c").mapInArrow(run, schema).groupBy(*keys).agg(F.sum("n").alias("n"))


def counted_inventory(counts: DataFrame, path: str) -> list[str]:
    """``inventory`` over all words; one row for each used piece of the vocabulary reaches the driver."""

    def make():
        def step(words, c):
            weight = piece_weights(path, words, c)
            at = np.flatnonzero(weight)
            return at, weight[at]

        return step

    rows = summed(counts, make, ["id"]).toPandas()
    weight = np.zeros(vocabulary(path).size)
    weight[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return most_used(path, weight)


def counted_contexts(counts: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The CONTEXTS heaviest beginnings over all words, their last ids and what follows them."""

    def masses():
        trie = Trie(names)

        def step(words, c):
            hashes, last, _, weight = beginnings(*spell(words, trie), c)
            known, at, back = np.unique(hashes, return_index=True, return_inverse=True)
            return known.view(np.int64), last[at], np.bincount(back, weights=weight, minlength=len(known))

        return step

    top = summed(counts, masses, ["hash", "last"]).orderBy(F.desc("n"), "hash").limit(CONTEXTS).toPandas()
    known, last = top["hash"].to_numpy(np.int64).view(np.uint64), top["last"].to_numpy(np.int64)
    order = np.argsort(known)
    known, last = known[order], last[order]

    def follow():
        trie = Trie(names)

        def step(words, c):
            hashes, _, following, weight = beginnings(*spell(words, trie), c)
            at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
            use = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            pair, back = np.unique(at[use] * (SIZE + 1) + following[use], return_inverse=True)
            return pair, np.bincount(back, weights=weight[use], minlength=len(pair))

        return step

    seen = np.zeros(len(known) * (SIZE + 1))
    if len(known):
        rows = summed(counts, follow, ["pair"]).toPandas()
        seen[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return known, last, seen.reshape(len(known), SIZE + 1)


#: Bits of a key that one histogram tells apart.
DIGITS = 13


def least_fitting(rows: DataFrame, key: Column, most: int, room: int) -> tuple[int, int]:
    """The least bound that at most ``room`` rows reach by their key in 0..most, and the number of those rows."""
    shift, reached = max(0, most.bit_length() - DIGITS), 0
    while True:
        digit = F.shiftright(key, shift)
        for d, n in sorted(rows.groupBy(digit.alias("d")).count().collect(), reverse=True):
            if reached + n > room:
                break
            reached += n
        else:
            return 0, reached
        if not shift:
            return d + 1, reached
        rows = rows.where(digit == d)
        shift = max(0, shift - DIGITS)


def frequent_words(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The FREQUENT words of the largest counts, and the others; a large tie at the edge is cut by hash."""
    least, reached = least_fitting(counts, F.col("c"), most, FREQUENT)
    chosen = F.col("c") >= least
    if least and reached < FREQUENT // 2:
        mixed = F.xxhash64("word").bitwiseAND(F.lit(2**62 - 1))
        bound, _ = least_fitting(counts.where(F.col("c") == least - 1), mixed, 2**62 - 1, FREQUENT - reached)
        chosen = chosen | ((F.col("c") == least - 1) & (mixed >= bound))
    return counts.where(chosen), counts.where(~chosen)


#: Words of a training span; spans after which a task hands them on.
SPAN, SPANS = 64, 1024


def training_spans(training: DataFrame, names: list[str], shared) -> DataFrame:
    """Ids of all spans of every training document, and a mark of each that follows from its id, place and words alone."""

    def make():
        speller = Speller(Trie(names), pickle.loads(shared.value))

        def step(batch):
            held, marks = [], []
            for doc_id, text in zip(column_of(batch, "doc_id").to_pylist(), texts_of(batch), strict=True):
                words, name = [*words_of(text), b""], zlib.crc32(str(doc_id).encode())
                for k in range(0, len(words), SPAN):
                    held.append(words[k : k + SPAN])
                    marks.append(xxhash.xxh3_64_intdigest(b" ".join(held[-1]), name + (k // SPAN << 32)) >> 2)
                if len(held) >= SPANS:
                    yield record(held, marks)
                    held, marks = [], []
            if held:
                yield record(held, marks)

        def record(spans, marks):
            flat, rows, counts = speller.ids(spans)
            return pa.RecordBatch.from_arrays(
                [lists(flat, counts, pa.int16()), lists(rows, counts, pa.int16()), pa.array(marks, pa.int64())], ["ids", "contexts", "mark"]
            )

        return step

    return map_texts(training, ["doc_id", "text"], make, "ids array<smallint>, contexts array<smallint>, mark bigint")


def dealt_spans(spans: DataFrame) -> DataFrame:
    """The spans written to the shared folder, a folder for each round."""
    spark = spans.sparkSession
    path = f"{shared_folder(spark)}/spans-{uuid.uuid4().hex}"
    spans.withColumn("turn", (F.col("mark") % ROUNDS).cast("int")).write.partitionBy("turn").parquet(path)
    return spark.read.schema(f"{SPANS_SCHEMA}, turn int").parquet(path)


SPANS_SCHEMA = "ids array<smallint>, contexts array<smallint>, mark bigint"


def train_rounds(spans: DataFrame, prior: Prior) -> dict[str, np.ndarray]:
    """Weights trained in ROUNDS rounds on spans dealt by their marks; each span is trained once.

    In a round each group of some GROUP spans, in the order of their marks, trains a copy that starts from the weights of the round before;
    the copies are averaged by their windows. Groups follow from the marks and from the number of spans, so input
    splits and tasks have no say. Copies travel in slices that are summed by Spark; one row for each slice reaches the driver.
    """
    weights = fresh()
    scales = {k: np.full_like(v, 1e-6) for k, v in weights.items()}
    names = list(weights)
    spark = spans.sparkSession
    spans = dealt_spans(spans)
    groups = max(1, round(spans.count() / (ROUNDS * GROUP)))

    def flattened(*sets: dict) -> np.ndarray:
        return np.concatenate([s[k].ravel() for s in sets for k in names]).astype(np.float64)

    def rebuilt(flat: np.ndarray) -> list[dict]:
        out, at = [], 0
        for _ in range(2):
            part = {}
            for k in names:
                part[k] = flat[at : at + weights[k].size].reshape(weights[k].shape).astype(np.float32)
                at += weights[k].size
            out.append(part)
        return out

    length = 2 * sum(weights[k].size for k in names)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(pickle.dumps((weights, scales, prior)))

        def run(batches, shared=shared, turn=turn):
            total, windows_seen, last = np.zeros(length), 0, None
            w = seen = None
            held: list = []

            def learn():
                nonlocal w, n
                counts = np.concatenate([h[2] for h in held])
                *made, _ = windows(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), counts)
                w = train(w, p, *made, turn, seen)
                n += len(made[0])
                held.clear()

            def leave():
                nonlocal total, windows_seen
                if held:
                    learn()
                if n:
                    total += n * flattened(w, seen)
                    windows_seen += n

            n, waiting = 0, 0
            for batch in batches:
                group, ids, contexts = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
                edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
                for start, stop in zip(edge, [*edge[1:], len(group)], strict=True):
                    if group[start] != last:
                        if last is not None:
                            leave()
                        last, n, waiting = group[start], 0, 0
                        w, seen, p = pickle.loads(shared.value)
                    while start < stop:
                        size = min(stop - start, HELD - waiting)
                        part = ids.slice(start, size)
                        counts = np.diff(part.offsets.to_numpy()).astype(np.int64)
                        held.append((part.flatten().to_numpy(), contexts.slice(start, size).flatten().to_numpy(), counts))
                        start, waiting = start + size, waiting + size
                        if waiting == HELD:
                            learn()
                            waiting = 0
            if last is not None:
                leave()
            if windows_seen:
                at = np.arange(0, length, SLICE)
                parts = [total[k : k + SLICE].tobytes() for k in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(parts, pa.binary()), pa.array(np.full(len(at), windows_seen))], ["at", "part", "n"]
                )

        def summed_parts(batches):
            sums: dict[int, list] = {}
            for batch in batches:
                for at, part, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    one = sums.setdefault(at, [0.0, 0])
                    one[0], one[1] = one[0] + np.frombuffer(part), one[1] + n
            yield pa.RecordBatch.from_arrays(
                [pa.array([*sums], pa.int64()), pa.array([s[0].tobytes() for s in sums.values()], pa.binary()), pa.array([s[1] for s in sums.values()], pa.int64())],
                ["at", "part", "n"],
            )

        slices = "at bigint, part binary, n bigint"
        mine = spans.where(F.col("turn") == turn).select((F.floor(F.col("mark") / ROUNDS) % groups).alias("g"), "ids", "contexts", "mark")
        in_order = mine.repartitionByRange(groups, "g").sortWithinPartitions("g", "mark").select("g", "ids", "contexts")
        copies = in_order.mapInArrow(run, slices)
        rows = copies.repartition("at").mapInArrow(summed_parts, slices).collect()
        shared.unpersist()
        if rows:
            flat = np.concatenate([np.frombuffer(r["part"]) / r["n"] for r in sorted(rows, key=lambda r: r["at"])])
            weights, scales = rebuilt(flat)
    return weights


CHUNK = 512


def log10_scores(w: dict, prior: Prior, flat: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each text, given as flat ids, context rows and lengths."""
    out = np.zeros(len(counts))
    # texts are taken in runs of bounded size, so that windows of one run fit
    part = np.cumsum(counts) // 200_000
    starts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(counts)]
    ends = np.r_[0, np.cumsum(counts)]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        inputs, pairs, before, targets, valid, owner = windows(flat[ends[a] : ends[b]], rows[ends[a] : ends[b]], counts[a:b])
        got = np.zeros(len(inputs))
        for k in range(0, len(inputs), CHUNK):
            c = slice(k, k + CHUNK)
            got[c] = np.where(valid[c], forward(w, prior, inputs[c], pairs[c], before[c], targets[c]), 0).sum(1)
        out[a:b] = np.bincount(owner, weights=got, minlength=b - a)
    return out / math.log(10)


def score_texts(documents: DataFrame, path: str, modulus: int = 7, out: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text")
    training = documents.where(remainder(F.col("doc_id"), modulus) != out)
    counts = staged(word_counts(training), "words")
    total, kinds, most = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max("c"), F.lit(0))).first()
    top, others = frequent_words(counts, most)
    frequent = {bytes(r["word"]): math.log10(r["c"] + 1) for r in top.collect()}
    names = counted_inventory(counts, path)
    prior = Prior(pair_counts(counts, names), contexts=counted_contexts(counts, names))
    spans = training_spans(training, names, spark.sparkContext.broadcast(pickle.dumps(prior)))
    weights = train_rounds(spans, prior)
    shared = spark.sparkContext.broadcast(pickle.dumps((weights, prior, frequent)))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        w, p, known = pickle.loads(shared.value)
        speller = Speller(Trie(names), p)

        def step(batch):
            texts = [[*words_of(t), b""] for t in texts_of(batch)]
            scores = log10_scores(w, p, *speller.ids(texts))
            sums, met, rare = [], [], []
            for words in texts:
                logs = list(map(known.get, words, repeat(-1.0)))
                if -1.0 in logs:
                    rare.append([x for x, v in zip(words, logs, strict=True) if v < 0])
                    logs = [v for v in logs if v >= 0]
                else:
                    rare.append([])
                sums.append(math.fsum(logs))
                met.append(len(logs))
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(met, pa.int64()), pa.array(sums, pa.float64()),
                    pa.array(scores, pa.float64()), pa.array(rare, pa.list_(pa.binary())),
                ],
                ["doc_id", "n_tokens", "met", "sums", "score", "rare"],
            )

        return step

    schema = f"doc_id {kind}, n_tokens bigint, met bigint, sums double, score double, rare array<binary>"
    scored = staged(map_texts(documents, ["doc_id", "text"], make, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode("rare").alias("word")).join(others, "word")
    rest = rest.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    lost = float(math.log10(total + kinds + 1))
    return scored.drop("rare").join(rest, "row", "left").select(
        "doc_id", (remainder(F.col("doc_id"), modulus) == out).alias("held_out"), "n_tokens",
        (F.col("met") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("sums") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(lost)).alias("base_score"), "score",
    )
