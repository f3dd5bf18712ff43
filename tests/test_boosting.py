"""Folded fits against fits of one fold written out, and the report that uses them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outturn.operators import boosting, models

FOLDS = 3


@pytest.fixture(scope="module")
def cases():
    draw = np.random.default_rng(0)
    real, flags = np.round(draw.normal(size=(1200, 3)), 1), draw.integers(0, 2, (1200, 3))
    y = (draw.random(1200) < 1 / (1 + np.exp(1 - 1.5 * real[:, 0] + flags[:, 1] * real[:, 1]))).astype(int)
    return np.hstack([real, flags]), y, draw.integers(0, FOLDS, 1200)


@pytest.fixture(scope="module")
def ready(spark, cases):
    rows = [([float(v) for v in x], int(y), int(f)) for x, y, f in zip(*cases, strict=True)]
    return spark.createDataFrame(rows, "x array<double>, broke int, fold int").repartition(5)


def totals_of(patterns):
    return np.array(patterns.agg(*[F.sum(F.get("c", F.lit(i))) for i in range(2 * FOLDS)]).first(), float)


def one_ensemble(bins, edges, y, use, rounds, rate=0.05, least=20, depth=3):
    margin = np.full(len(bins), np.log(y[use].mean() / (1 - y[use].mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (np.rint(v / boosting.UNIT) * boosting.UNIT for v in (p - y, p * (1 - p)))
        added = np.zeros(len(bins))

        def grow(rows, level):
            inside = rows & use
            best, split = 1e-12, None
            for f, e in [(f, e) for f in range(bins.shape[1]) for e in range(len(edges[f]))] if level < depth else []:
                left, right = inside & (bins[:, f] <= e), inside & (bins[:, f] > e)
                if min(left.sum(), right.sum()) >= least and min(h[left].sum(), h[right].sum()) > 1e-3:
                    gain = sum(g[m].sum() ** 2 / h[m].sum() for m in (left, right)) - g[inside].sum() ** 2 / h[inside].sum()
                    if gain > best + 1e-9:
                        best, split = gain, (f, e)
            if split is None:
                added[rows] = -rate * g[inside].sum() / h[inside].sum()
                return
            grow(rows & (bins[:, split[0]] <= split[1]), level + 1)
            grow(rows & (bins[:, split[0]] > split[1]), level + 1)

        grow(np.ones(len(bins), bool), 0)
        margin += added
    return margin


def test_boosting_equals_each_fold_on_its_own(ready, cases, monkeypatch):
    monkeypatch.setattr(boosting, "KEPT", 3)
    x, y, fold = cases
    edges = boosting.bin_edges(ready, 6, 3, 16)
    patterns = models._patterns(ready, boosting.binned(F.col("x"), edges), FOLDS)
    model = boosting.fit_boosted(patterns, edges, totals_of(patterns), rounds=8)
    bins = model.bins(x)
    assert {tuple(r["x"]) for r in patterns.select("x").collect()} == set(map(tuple, bins.tolist()))
    for k in range(FOLDS):
        assert model.margins(bins)[:, k] == pytest.approx(one_ensemble(bins, edges, y, fold != k, 8), abs=1e-7)


def test_logits_and_platt_scaling_solve_their_equations(ready, cases):
    x, y, fold = cases
    patterns = boosting.ready(models._patterns(ready, F.col("x"), FOLDS))
    totals = totals_of(patterns)
    theta = models.fit_ridge_logits(patterns, 6, totals)
    platt = models.fit_platt(patterns, lambda x: x @ theta[:, :-1].T + theta[:, -1], totals)
    design = np.hstack([x, np.ones((len(x), 1))])
    for k in range(FOLDS):
        use, held = fold != k, fold == k
        weight = np.where(y == 1, use.sum() / (2 * y[use].sum()), use.sum() / (2 * (1 - y[use]).sum()))[use]
        p = 1 / (1 + np.exp(-design[use] @ theta[k]))
        assert 0.3 * design[use].T @ (weight * (p - y[use])) + np.r_[theta[k][:-1], 0] == pytest.approx(0, abs=1e-6)
        margin, pos = design[held] @ theta[k], y[held].sum()
        target = np.where(y[held] == 1, (pos + 1) / (pos + 2), 1 / (held.sum() - pos + 2))
        p = 1 / (1 + np.exp(-(platt[k][0] * margin + platt[k][1])))
        assert [((p - target) * margin).sum(), (p - target).sum()] == pytest.approx([0, 0], abs=1e-6)


def test_folds_are_stratified(spark):
    rows = spark.range(503).selectExpr("id as cik", "cast(id % 9 = 0 as int) as broke", "cast('2001-01-01' as date) as announced")
    fold = models.stratified_folds(rows, 5, "broke", ["cik", "announced"])
    sizes = rows.groupBy("broke", fold.alias("fold")).count().collect()
    for label, n in ((1, 56), (0, 447)):
        parts = [r["count"] for r in sizes if r["broke"] == label]
        assert len(parts) == 5 and sum(parts) == n and max(parts) - min(parts) <= 1


def test_patterns_travel_in_blocks_and_sum_exactly(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 64)
    draw = np.random.default_rng(1)
    edges = [np.arange(9.0), np.array([0.5]), np.array([]), np.array([0.5])]
    x = np.stack([draw.integers(0, len(e) + 1, 700) for e in edges], 1)
    counts = draw.integers(0, 3, (700, 2 * FOLDS))
    rows = [(a, b) for a, b in zip(x.tolist(), counts.tolist(), strict=True)]
    patterns = spark.createDataFrame(rows, "x array<int>, c array<bigint>").repartition(3)
    base = np.array([-1.0, 0.2, 0.7])
    blocks = patterns.mapInArrow(boosting._blocks(base), boosting._BLOCKS)
    sizes = [r["n"] for r in blocks.select("n").collect()]
    assert sum(sizes) == 700 and max(sizes) <= 64 and len(sizes) < 20
    offset = np.r_[0, np.cumsum([len(e) + 1 for e in edges])]
    splits = [(np.array([0, 1, -1]), np.array([k, 0, 0])) for k in range(FOLDS)]
    trees = [boosting.Tree(f, e, np.arange(4) / 8) for f, e in splits]
    got = boosting.vector_sum(blocks, boosting._gradients([trees], trees, 1, offset), 3 * FOLDS * 2 * offset[-1], "bigint")
    want = np.zeros((3, FOLDS, 2, offset[-1]), np.int64)
    zeros, ones = boosting.left_out(counts)
    for k in range(FOLDS):
        root = x[:, 0] > k
        leaf = np.where(root, 2, x[:, 1] > 0)  # the right node has no split, so all its rows go left
        p = 1 / (1 + np.exp(-(base[k] + trees[k].value[leaf])))
        w = (zeros + ones)[:, k]
        for i, v in enumerate(((w * p - ones[:, k]) / boosting.UNIT, w * p * (1 - p) / boosting.UNIT, w)):
            for f in range(4):
                np.add.at(want[i, k], (root.astype(int), offset[f] + x[:, f]), np.rint(v).astype(np.int64))
    assert (got == want.ravel()).all()
