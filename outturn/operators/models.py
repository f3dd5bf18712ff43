"""Calibrated probability of a break: preprocessing, two classifiers, Platt averaging."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions import vocab
from outturn.functions.lineage import cut
from outturn.functions.partials import matrix, newton, vector_sum
from outturn.functions.ranks import order_statistics
from outturn.operators import boosting

RARE = "rare"
# a level that training never had: it gets no column
UNSEEN = "<unseen>"
_KEY = ["cik", "announced"]


class TooFewEvents(ValueError):
    """The training rows cannot support a fit."""


@dataclass
class Preprocessing:
    """Fitted on the training table and applied to any other."""

    frequent: dict[str, list[str]]
    rare: dict[str, list[str]]
    filled: dict[str, float]
    pipeline: PipelineModel

    def prepare(self, frame: DataFrame) -> DataFrame:
        return _prepare(frame, self.frequent, self.rare, self.filled)

    def transform(self, frame: DataFrame) -> DataFrame:
        return self.pipeline.transform(self.prepare(frame))


def _prepare(
    frame: DataFrame, frequent: dict[str, list[str]], rare: dict[str, list[str]], filled: dict[str, float]
) -> DataFrame:
    numbers = vocab.NUMERIC_FEATURES + vocab.BINARY_FEATURES
    return frame.withColumns(
        {
            **{f"{c}_in": F.coalesce(F.col(c).cast("double"), F.lit(filled[c])) for c in numbers},
            **{
                f"{c}_in": F.when(F.col(c).isin(levels), F.col(c)).when(
                    F.col(c).isin(rare[c]) | F.col(c).isNull() & F.lit(None in rare[c]), F.lit(RARE)
                ).otherwise(F.lit(UNSEEN))
                for c, levels in frequent.items()
            },
        }
    )


def fit_preprocessing(train: DataFrame, min_frequency: int = 25) -> Preprocessing:
    """Median or most frequent value for gaps, scaled numbers, one column per frequent level.

    Levels rarer than ``min_frequency`` share one column; levels never seen get none. The
    level lists are bounded by the two-digit sectors and the four considerations.
    """
    frequent: dict[str, list[str]] = {}
    rare: dict[str, list[str]] = {}
    for c in vocab.CATEGORICAL_FEATURES:
        counts = train.groupBy(c).agg(F.count(F.lit(1)).alias("n")).collect()
        frequent[c] = sorted(r[c] for r in counts if r["n"] >= min_frequency and r[c] is not None)
        rare[c] = [r[c] for r in counts if r["n"] < min_frequency or r[c] is None]
    typed = train.select(
        *[F.col(c).cast("double").alias(c) for c in vocab.NUMERIC_FEATURES + vocab.BINARY_FEATURES]
    )
    filled: dict[str, float] = {}
    for columns, strategy in ((vocab.NUMERIC_FEATURES, "median"), (vocab.BINARY_FEATURES, "mode")):
        present = typed.agg(*[F.count(c).alias(c) for c in columns]).first()
        usable = [c for c in columns if present[c]]
        surrogates = {}
        if usable:
            imputer = Imputer(inputCols=usable, outputCols=usable, strategy=strategy, relativeError=1e-4)
            surrogates = imputer.fit(typed).surrogateDF.first().asDict()
        filled |= {c: surrogates.get(c, 0.0) for c in columns}
    categories = vocab.CATEGORICAL_FEATURES
    stages = [
        VectorAssembler(inputCols=[f"{c}_in" for c in vocab.NUMERIC_FEATURES], outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        StringIndexer(
            inputCols=[f"{c}_in" for c in categories], outputCols=[f"{c}_no" for c in categories],
            handleInvalid="keep", stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(
            inputCols=[f"{c}_no" for c in categories], outputCols=[f"{c}_hot" for c in categories],
            dropLast=True,  # the last column is that of unseen levels
        ),
        VectorAssembler(
            inputCols=["scaled", *[f"{c}_in" for c in vocab.BINARY_FEATURES], *[f"{c}_hot" for c in categories]],
            outputCol="features",
        ),
    ]
    pipeline = Pipeline(stages=stages).fit(_prepare(train, frequent, rare, filled))
    return Preprocessing(frequent, rare, filled, pipeline)


def stratified_folds(rows: DataFrame, folds: int, label: str, key: list[str], seed: int = 0) -> Column:
    """Number of the fold of a row: every class is cut into equal parts along a seeded hash of the key."""
    ticket = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in key]), 12)
    ranks = {f"_at{j}": (lambda n, j=j: F.ceil(n * j / folds).cast("bigint") - 1) for j in range(1, folds)}
    limits = order_statistics(rows.select(label, ticket.alias("_ticket")), "_ticket", ranks, [label]).collect()
    fold = F.lit(0)
    for row in limits:
        above = sum((F.when(ticket > F.lit(int(row[f"_at{j}"])), 1).otherwise(0) for j in range(1, folds)), F.lit(0))
        fold = F.when(F.col(label) == F.lit(row[label]), above).otherwise(fold)
    return fold


def _patterns(ready: DataFrame, x: Column, folds: int) -> DataFrame:
    """Distinct ``x`` and, of each label and fold, how many rows have it."""
    counts = [
        F.sum(((F.col("broke") == label) & (F.col("fold") == k)).cast("bigint")) for label in (0, 1) for k in range(folds)
    ]
    return ready.withColumn("x", x).groupBy("x").agg(F.array(*counts).alias("c"))


def _log_loss(eta: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    return one * np.logaddexp(0, -eta) + zero * np.logaddexp(0, eta)


def fit_ridge_logits(patterns: DataFrame, width: int, totals: np.ndarray, strength: float = 0.3) -> np.ndarray:
    """Balanced logistic regressions of all training sets at once, a row of coefficients and an intercept for each.

    The loss is half the squared length of the coefficients plus ``strength`` times the weighted log loss, as in a fit on rows whose
    classes weigh the same.
    """
    folds = len(totals) // 2
    zeros, ones = boosting.left_out(totals[None, :])
    balance = [(zeros + ones)[0] / (2 * part[0]) for part in (zeros, ones)]
    size = width + 1

    def evaluate(theta: np.ndarray) -> tuple:
        def partial(batch):
            x = np.hstack([matrix(batch, "x"), np.ones((batch.num_rows, 1))])
            zero, one = (w * b for w, b in zip(boosting.left_out(matrix(batch, "c")), balance, strict=True))
            out = []
            for k in range(folds):
                eta = x @ theta[k]
                p = 1 / (1 + np.exp(-eta))
                total = zero[:, k] + one[:, k]
                out += [_log_loss(eta, one[:, k], zero[:, k]).sum(keepdims=True), x.T @ (total * p - one[:, k])]
                out.append(((x * (total * p * (1 - p))[:, None]).T @ x).ravel())
            return np.concatenate(out)

        rows = vector_sum(patterns, partial, folds * (1 + size + size * size)).reshape(folds, -1) * strength
        plain = np.r_[np.ones(width), 0.0]
        loss = rows[:, 0] + 0.5 * (theta**2 * plain).sum(1)
        return loss, rows[:, 1 : 1 + size] + theta * plain, rows[:, 1 + size :].reshape(-1, size, size) + np.diag(plain)

    return newton(evaluate, np.zeros((folds, size)))


def fit_platt(patterns: DataFrame, margins, totals: np.ndarray) -> np.ndarray:
    """Slope and intercept on the margin of each training set, from the fold it left out, with smoothed targets."""
    neg, pos = np.split(totals.astype(float), 2)
    folds = len(pos)
    hit, miss = (pos + 1) / (pos + 2), 1 / (neg + 2)

    def evaluate(theta: np.ndarray) -> tuple:
        def partial(batch):
            zero, one = np.hsplit(matrix(batch, "c").astype(float), 2)
            margin = margins(matrix(batch, "x"))
            target = one * hit + zero * miss
            eta = margin * theta[:, 0] + theta[:, 1]
            p = 1 / (1 + np.exp(-eta))
            slope, curve = (zero + one) * p - target, (zero + one) * p * (1 - p)
            loss = _log_loss(eta, target, zero + one - target)
            return np.concatenate([v.sum(0) for v in (loss, slope * margin, slope, curve * margin**2, curve * margin, curve)])

        loss, s0, s1, c0, c1, c2 = vector_sum(patterns, partial, 6 * folds).reshape(6, folds)
        return loss, np.stack([s0, s1], 1), np.stack([np.stack([c0, c1], 1), np.stack([c1, c2], 1)], 1)

    return newton(evaluate, np.zeros((folds, 2)))


@dataclass
class CalibratedModel:
    """Averages the calibrated probabilities of one model per fold."""

    preprocessing: Preprocessing
    platt: np.ndarray
    logits: np.ndarray | None = None
    boosted: boosting.Boosted | None = None

    def score(self, frame: DataFrame) -> DataFrame:
        """Adds ``p``, the probability of a break."""
        x = vector_to_array("features")
        scored = self.preprocessing.transform(frame).withColumn("p", self._mean(x))
        return scored.select(*frame.columns, "p")

    def _mean(self, x: Column) -> Column:
        model, platt = self.boosted, self.platt
        if model is not None:

            @F.pandas_udf("double")
            def probability(rows: pd.Series) -> pd.Series:
                if not len(rows):
                    return pd.Series([], dtype=float)
                margin = model.margins(model.bins(np.stack(rows.to_numpy())))
                return pd.Series((1 / (1 + np.exp(-(margin * platt[:, 0] + platt[:, 1])))).mean(1))

            return probability(x)
        parts = []
        for theta, (slope, intercept) in zip(self.logits, platt, strict=True):
            margin = sum((F.get(x, F.lit(i)) * float(b) for i, b in enumerate(theta[:-1])), F.lit(float(theta[-1])))
            parts.append(1 / (1 + F.exp(-(margin * float(slope) + float(intercept)))))
        return sum(parts, F.lit(0.0)) / len(parts)


def fit_calibrated(
    train: DataFrame,
    kind: str = "logistic",
    seed: int = 0,
    folds: int = 5,
    rounds: int = 200,
    key: list[str] = _KEY,
) -> CalibratedModel:
    """Platt scaling over folds: fit on the others, calibrate on the held-out one.

    Rows of equal features are combined first, with a count for each label and fold; from then on every pass over them serves
    the models of all folds.
    """
    if kind not in ("logistic", "boosted"):
        raise ValueError(f"unknown model {kind!r}, expected 'logistic' or 'boosted'")
    preprocessing = fit_preprocessing(train)
    ready = cut(
        preprocessing.transform(train).withColumn("fold", stratified_folds(train, folds, "broke", key, seed))
        .select(vector_to_array("features").alias("x"), "broke", "fold")
    )
    classes = {int(r["broke"]): r["n"] for r in ready.groupBy("broke").agg(F.count("*").alias("n")).collect()}
    if min(classes.get(0, 0), classes.get(1, 0)) < folds:
        raise TooFewEvents(f"every one of {folds} folds needs a row of both outcomes")
    width = ready.select(F.size("x")).first()[0]
    if kind == "boosted":
        edges = boosting.bin_edges(ready, width, len(vocab.NUMERIC_FEATURES))
        patterns = boosting.ready(_patterns(ready, boosting.binned(F.col("x"), edges), folds))
    else:
        patterns = boosting.ready(_patterns(ready, F.col("x"), folds))
    try:
        totals = np.array(patterns.agg(*[F.sum(F.get("c", F.lit(i))) for i in range(2 * folds)]).first(), float)
        if kind == "boosted":
            model = boosting.fit_boosted(patterns, edges, totals, rounds)
            platt = fit_platt(patterns, lambda x: model.margins(x.astype(np.int64)), totals)
            return CalibratedModel(preprocessing, platt, boosted=model)
        logits = fit_ridge_logits(patterns, width, totals)
        return CalibratedModel(preprocessing, fit_platt(patterns, lambda x: x @ logits[:, :-1].T + logits[:, -1], totals), logits)
    finally:
        patterns.unpersist()
