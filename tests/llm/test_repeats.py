"""Periodic runs, the LSH forest and the prefix trie against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, brute_components

from outturn.llm import forest, prefixes, runs
from outturn.llm.common import table
from outturn.llm.queries import QUERIES

# --- 11: periodic runs -----------------------------------------------------------------------------------------------


def brute_runs(words, least_words=24, least_periods=3):
    found, n = set(), len(words)
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            run = words[i : i + length]
            if length >= max(least_words, least_periods * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                found.add((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] * 10**12 // r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_equal_brute_force():
    draw = random.Random(1)
    for _ in range(2000):
        n, size = draw.randint(0, 60), draw.choice([1, 2, 2, 3, 5])
        words = [draw.randrange(size) for _ in range(n)]
        if n > 4 and draw.random() < 0.5:
            start, period = draw.randrange(n), draw.randint(1, 6)
            words = [words[i] if i < start else words[start + (i - start) % period] for i in range(n)]
        least, periods = draw.choice([2, 5, 24]), draw.choice([2, 3])
        assert [*map(tuple, runs.runs_in(np.array(words, np.int64), least, periods).tolist())] == brute_runs(words, least, periods)


def test_extensions_equal_comparison():
    draw = np.random.default_rng(2)
    for size in (1, 2, 5):
        symbols = draw.integers(1, size + 1, 200)
        tree = runs.Tree(symbols)
        i, j = draw.integers(0, 201, (2, 500))
        i, j = i[i != j], j[i != j]
        for a, b, found in zip(i, j, tree.extension(i, j), strict=True):
            same = np.r_[symbols[a:][: 200 - max(a, b)] == symbols[b:][: 200 - max(a, b)], False]
            assert found == np.argmin(same)


def test_runs_query_equals_brute_force(spark, sf_dir):
    found = [tuple(r) for r in QUERIES["op11_runs"](spark, sf_dir).orderBy("doc_id").collect()]
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    assert found == [brute_row(r["doc_id"], r["text"]) for r in docs]
    assert any(r[1] for r in found)


def test_runs_of_odd_rows(spark):
    line = "a b c d e f g h "
    texts = [None, "", " \n\t", "w " * 23, "w " * 24, line * 3, line * 3 + "x", "y " + line * 4000, "Aa aA " * 20, "z" * 100_000]
    rows = [(None, t, "en", "s", 1, 7) for t in texts] + [(3, line * 3, "de", "s", 1, 8)] * 2
    odd = spark.createDataFrame(rows, SCHEMA + ", runs int").repartition(3)
    found = runs.find_runs(odd).collect()
    assert len(found) == len(rows)
    shape = sorted((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"][:20]) for r in found)
    assert shape == sorted([
        (0, [], ""), (0, [], ""), (0, [], ""), (23, [], ("w " * 23)[:20]), (24, [(0, 24, 1)], "w"), (24, [(0, 24, 8)], line.strip()[:20]),
        (25, [(0, 24, 8)], "a b c d e f g h x"), (32_001, [(1, 32_000, 8)], "y " + line.strip()), (40, [(0, 40, 2)], "Aa aA"),
        (1, [], "z" * 20), *[(24, [(0, 24, 8)], line.strip()[:20])] * 2,
    ])
    assert runs.find_runs(spark.createDataFrame([], SCHEMA)).collect() == []


# --- 12: LSH forest --------------------------------------------------------------------------------------------------


def edited(words, draw, share):
    return [draw.choice("abcdefgh") + str(draw.randrange(99)) if draw.random() < share else w for w in words]


def corpus(draw, groups, size):
    texts = []
    for _ in range(groups):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.randint(3, 160))]
        texts += [" ".join(edited(base, draw, draw.choice([0, 0.005, 0.01, 0.02, 0.05]))) for _ in range(draw.randint(1, size))]
    return texts + ["", None, " ", "one two", "one two", "ONE two", "three"]


@pytest.mark.parametrize("crowded", [256, 2])
def test_forest_equals_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(forest, "CROWDED", crowded)
    texts = corpus(random.Random(crowded), 40, 8)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    found = forest.near_duplicates(docs).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in found] == [tuple(x) for x in brute_components(texts, 85, 5)]


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """A group far above the size from which regions get deeper, around one text that all copies come from."""
    monkeypatch.setattr(forest, "CROWDED", 16)
    draw = random.Random(4)
    base = [f"w{draw.randrange(3000)}" for _ in range(150)]
    texts = [" ".join(edited(base, draw, 0.008)) for _ in range(300)] + [" ".join(base)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    found = forest.near_duplicates(docs).orderBy("doc_id").collect()
    assert [r["component_id"] for r in found] == [x[1] for x in brute_components(texts, 85, 5)]


def test_signatures_agree_as_often_as_sets_do():
    draw = np.random.default_rng(5)
    agree = []
    for _ in range(60):
        both, one, two = draw.integers(0, 2**63, 850), draw.integers(0, 2**63, 75), draw.integers(0, 2**63, 75)
        x, y = forest.signatures([np.unique(np.r_[both, z].astype(np.uint64)) for z in (one, two)])
        agree.append([x >> forest.BITS * (forest.LEVELS - d) == y >> forest.BITS * (forest.LEVELS - d) for d in range(1, forest.LEVELS + 1)])
    for depth, share in enumerate(np.mean(agree, axis=(0, 2)), 1):
        assert abs(share - 0.85**depth) < 0.04


def test_forest_of_odd_rows(spark):
    rows = [(None, "a b c d e f", "x"), (1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "A b C d e f", "x"), (9, "a B c d e f", "x")]
    rows += [(9, "a B c d e f", "y"), (7, "a b", "x"), (6, "A B", "x"), (5, "word " * 50_000, "x"), (8, "word " * 70_000, "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in forest.near_duplicates(odd).collect()}
    assert found == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (2, 4), 9: (2, 4), 7: (1, 6), 6: (1, 6), 5: (1, 5), 8: (1, 5)}
    assert forest.near_duplicates(odd).count() == 9
    assert forest.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


# --- 13: prefix trie -------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5((hashlib.md5(role.encode()).hexdigest() + text).encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, mark, text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    members, ends, kids, leaves, saved = (defaultdict(kind) for kind in (list, list, int, int, int))
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + v[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, convs in members.items():
        words = len(node[-1][1].encode().split()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * words
            leaves[node[:d]] += not kids[node]
    return [
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in members.items()
    ]


def trie(conversations):
    own = prefixes.with_shared_openings(prefixes.sequences(conversations))
    return [tuple(r) for r in prefixes.prefix_trie(own).collect()]


def as_set(rows):
    return sorted(rows, key=lambda r: tuple(-1 if v is None else v for v in r))


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefixes, "BLOCK_ROWS", block)
    draw = random.Random(block)
    rows = [
        (draw.choice([None, *range(60)]), draw.choice([None, 0, 1, 2, 3]), draw.choice([None, "a", ""]), draw.choice([None, "x", "x y", ""]), 5, b"k")
        for _ in range(200)
    ]
    odd = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, words int, path binary").repartition(4)
    assert as_set(trie(odd)) == as_set(brute_trie([r[:4] for r in rows]))


def test_trie_query_equals_brute_force(spark, sf_dir):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, sf_dir, "conversations").collect()]
    assert as_set(tuple(r) for r in QUERIES["op13_prefixes"](spark, sf_dir).collect()) == as_set(brute_trie(rows))


def test_trie_of_few_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert trie(spark.createDataFrame([], schema)) == []
    assert trie(spark.createDataFrame([(None, 1, "a", "b")], schema)) == []
    alike = spark.range(1, 5001).select(
        (F.col("id") * 20).alias("conv_id"), F.explode(F.array(*map(F.lit, range(6)))).alias("turn"), F.lit("u").alias("role"), F.lit("one two").alias("text")
    )
    rows = as_set(trie(alike))
    assert [r[:7] for r in rows] == [(20, d, 20 if d else None, 5000, int(d < 6), 1, 4999 * 2 * (7 - max(d, 1))) for d in range(7)]


def test_table_of_minima_reaches_as_far_as_a_scan():
    draw = np.random.default_rng(6)
    values = draw.integers(0, 4, 70)
    table_ = prefixes.RangeMinima(values)
    start, bound = np.repeat(np.arange(70), 5), np.tile(np.arange(5), 70)
    for s, b, r, left in zip(start, bound, table_.reach_right(start, bound), table_.reach_left(start, bound), strict=True):
        right = s
        while right + 1 < 70 and values[right + 1] >= b:
            right += 1
        low = s
        while low > 0 and values[low] >= b:
            low -= 1
        assert (r, left) == (right, low)
