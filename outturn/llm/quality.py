"""Operator 1: document quality by Bradley-Terry pairwise ranking.

Every document gets a few measures of its bytes, words and lines, cut into bins at quantiles. Labelled training
documents of either label are paired; a logistic loss on the difference of their features learns a strength, the score of a
document. The quantile of training strengths that separates the labels best is the threshold, and strengths are mapped so that it
lies at the given probability. At most ``LABELLED`` labelled rows, those of the smallest hashes, are used to fit.

Results of corner cases: null and empty texts get the score of a text without words; if training rows lack one of the labels,
every score is the share of label 1 (0.5 without rows); repeated rows are scored each; a null id is never learnt from.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outturn.llm.common import column_of, fit_logistic, lists, map_texts, remainder, sigmoid, staged, texts_of
from outturn.llm.toxicity import sample_of

#: Bound of labelled rows that are fitted, pairs for each of them, and bins of a measure.
LABELLED, PAIRS, BINS = 20_000, 6, 8

UPPER, LOWER, DIGIT = (np.array([lo <= b <= hi for b in range(256)]) for lo, hi in ((65, 90), (97, 122), (48, 57)))
HIGH = np.arange(256) >= 128
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
STOP = np.isin(np.arange(256), [ord(c) for c in ".,;:?'\"-()"])
OTHER = ~(UPPER | LOWER | DIGIT | HIGH | SPACE | STOP)
MEASURES = 18


def measures(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    if not data.strip():
        return [0.0] * MEASURES
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    solid = max(1, int(counts[~SPACE].sum()))
    words = data.split()
    kinds = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = counts[counts > 0] / n
    pairs = len(set(zip(words, words[1:], strict=False)))
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(n), math.log1p(len(words)), solid / len(words),
        counts[UPPER].sum() / solid, counts[DIGIT].sum() / solid, counts[STOP].sum() / solid, counts[OTHER].sum() / solid,
        counts[HIGH].sum() / solid, counts[SPACE].sum() / n, counts[10] / n,
        len(kinds) / len(words), max(kinds.values()) / len(words), pairs / max(1, len(words) - 1), runs / len(words),
        len(set(lines)) / len(lines), len(words) / len(lines), float(-(share * np.log2(share)).sum()),
        math.log1p(max(map(len, kinds))),
    ]


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and the measures of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch):
            rows = np.array([measures(t) for t in texts_of(batch)], float).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), lists(rows, np.full(batch.num_rows, MEASURES), pa.float64())], ["doc_id", "measures"]
            )

        return step

    return map_texts(documents, ["doc_id", "text"], make, f"doc_id {kind}, measures array<double>")


def fit_pairs(z: np.ndarray, winner: np.ndarray, loser: np.ndarray, weight: np.ndarray, l2: float = 1.0, block: int = 8192) -> np.ndarray:
    """Strengths per feature by damped Newton steps on the logistic loss of feature differences, formed block by block."""
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        slope, curve = -l2 * beta, l2 * np.eye(len(beta))
        for k in range(0, len(winner), block):
            d, w = z[winner[k : k + block]] - z[loser[k : k + block]], weight[k : k + block]
            p = sigmoid(d @ beta)
            slope += d.T @ (w * (1 - p))
            curve += (d * (w * p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(curve, slope)
        step /= max(1.0, np.abs(step).max() / 4)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


class Ranking:
    """Bins, strengths and the map from strength to score."""

    def __init__(self, x: np.ndarray, y: np.ndarray, threshold: float) -> None:
        self.flat = None
        if len(y) == 0 or y.min() == y.max():
            self.flat = float(y.mean()) if len(y) else 0.5
            return
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        z = self.features(x)
        draw = np.random.default_rng(7)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        # every row meets as many rows of the other label
        a = np.r_[np.repeat(good, PAIRS), draw.choice(good, PAIRS * len(bad))]
        b = np.r_[draw.choice(bad, PAIRS * len(good)), np.repeat(bad, PAIRS)]
        weight = np.r_[np.full(PAIRS * len(good), 1 / len(good)), np.full(PAIRS * len(bad), 1 / len(bad))]
        weight *= len(y) / weight.sum()
        self.beta = fit_pairs(z, a, b, weight)
        s = z @ self.beta
        # the quantile of strengths that agrees with most labels, each label counting the same
        levels = np.quantile(s, np.linspace(0.005, 0.995, 199))
        hits = [(np.mean(s[good] >= t) + np.mean(s[bad] < t), -abs(k - 100)) for k, t in enumerate(levels)]
        self.cut = float(levels[max(range(len(levels)), key=hits.__getitem__)])
        self.slope = max(0.05, float(fit_logistic((s - self.cut)[:, None], y.astype(float))[0]))
        self.shift = math.log(threshold / (1 - threshold))

    def features(self, x: np.ndarray) -> np.ndarray:
        hot = [(np.searchsorted(e, c, "right")[:, None] == np.arange(len(e) + 1)).astype(float) for e, c in zip(self.edges, x.T, strict=True)]
        return np.hstack([*hot, np.clip((x - self.mean) / self.spread, -4, 4)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return sigmoid(self.shift + self.slope * (self.features(x) @ self.beta - self.cut))


def score_quality(documents: DataFrame, labels: DataFrame, modulus: int = 5, out: int = 0, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted."""
    rows = staged(measured(documents.select("doc_id", "text")), "measures")
    sample = sample_of(labels, "quality", modulus, out, LABELLED)
    known = rows.join(F.broadcast(sample), "doc_id").select("measures", "label").toPandas()
    x = np.stack(known["measures"].to_numpy()) if len(known) else np.zeros((0, MEASURES))
    ranking = Ranking(x, known["label"].to_numpy(), threshold)

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranking.score(flat), pa.float64())], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), modulus) == out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
