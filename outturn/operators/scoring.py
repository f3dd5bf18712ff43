"""Is a probability worth believing? Calibration, ranking and value, with intervals.

Every operator takes rows of (p, y): the predicted probability of a break and 0/1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions import vocab
from outturn.functions.lineage import cut
from outturn.functions.ranks import interpolated, running_sums

def _p() -> Column:
    return F.col("p")


def _y() -> Column:
    return F.col("y")


def brier(scores: DataFrame, base_rate: float) -> DataFrame:
    """Brier score, that of always predicting ``base_rate``, and the skill over it."""
    sums = scores.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").alias("breaks"),
        F.avg(F.pow(_p() - _y(), F.lit(2))).alias("brier"),
        F.avg(F.pow(F.lit(float(base_rate)) - _y(), F.lit(2))).alias("brier_of_base_rate"),
    )
    return sums.withColumn(
        "skill", F.coalesce(1 - F.col("brier") / F.nullif("brier_of_base_rate", F.lit(0.0)), F.lit(0.0))
    )


def calibration_bins(breaks: int) -> int:
    return min(5, max(2, breaks // 8))


def calibration_curve(scores: DataFrame, bins: int | None = None) -> DataFrame:
    """Mean prediction and observed rate per quantile bin; empty bins are left out."""
    if bins is None:
        bins = calibration_bins(scores.agg(F.sum("y")).first()[0] or 0)
    edges = interpolated(scores, "p", [i / bins for i in range(1, bins)])
    index = sum((F.when(_p() > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return scores.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed")
    )


def calibration_error(curve: DataFrame) -> DataFrame:
    """Expected calibration error: the unweighted mean gap over the bins."""
    return curve.agg(F.avg(F.abs(F.col("observed") - F.col("predicted"))).alias("ece"))


def _cells(scores: DataFrame) -> DataFrame:
    return scores.groupBy("p").agg(
        F.sum("y").cast("bigint").alias("pos"), F.sum(1 - _y()).cast("bigint").alias("neg")
    )


def auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve from ranks of distinct scores; null without both classes."""
    ranked = running_sums(cut(_cells(scores)), "p", ["neg"])
    won = F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))
    sums = ranked.agg(
        F.sum(won).alias("won"),
        (F.sum("pos").cast("double") * F.sum("neg")).alias("pairs"),
    )
    return sums.select((F.col("won") / F.nullif("pairs", F.lit(0.0))).alias("auc"))


def expected_value(
    scores: DataFrame,
    thresholds: list[float] = vocab.EV_THRESHOLDS,
    gain: float = vocab.GAIN_ON_COMPLETION,
    loss: float = vocab.LOSS_ON_BREAK,
) -> DataFrame:
    """Per threshold: take every deal with p at or below it and see what it paid."""
    sums = []
    for i, t in enumerate(thresholds):
        taken = _p() <= t
        sums += [
            F.count_if(taken).alias(f"taken{i}"),
            F.sum(F.when(taken, _y()).otherwise(0)).alias(f"breaks{i}"),
        ]
    row = scores.agg(F.count(F.lit(1)).alias("deals"), *sums)
    parts = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"), F.col(f"taken{i}").alias("deals_taken"),
                F.col(f"breaks{i}").cast("bigint").alias("breaks_taken"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    taken, broke = F.col("deals_taken"), F.col("breaks_taken")
    total = gain * (taken - broke) - loss * broke
    return row.select("deals", F.inline(parts)).select(
        "threshold", "deals_taken",
        (taken / F.nullif("deals", F.lit(0))).alias("share_taken"),
        "breaks_taken",
        (total / F.nullif(taken, F.lit(0))).alias("ev_per_deal"),
        total.alias("total"),
    )


#: Poisson(1) by inversion of 32-bit draws: the weight is the number of these that a draw reaches.
POISSON = [int(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(12)]
#: Cells and copies that are weighted at a time.
WEIGHED = 512


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every bit; the same steps are plain arithmetic in SQL."""
    low = np.uint64(2**32 - 1)
    x = (x ^ (x >> np.uint64(16))) * np.uint64(0x7FEB352D) & low
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0x846CA68B) & low
    return x ^ (x >> np.uint64(16))


def poisson_weights(p: np.ndarray, y: int, counts: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """For each cell the weights of its rows in each draw: a row's is a function of score, outcome, copy, draw and seed."""
    place = np.floor(p * 2.0**52).astype(np.uint64)
    key = mixed(mixed(np.uint64(seed) ^ (place & np.uint64(2**32 - 1))) ^ (place >> np.uint64(32)))
    key = mixed(key ^ np.uint64(y))
    out = np.zeros((len(p), draws), np.int64)
    draw = np.arange(draws, dtype=np.uint64)
    limits = np.array(POISSON, np.uint64)
    for first in range(0, int(counts.max(initial=0)), WEIGHED):
        here = np.flatnonzero(counts > first)
        size = np.minimum(counts[here] - first, WEIGHED)
        for at in range(0, len(here), WEIGHED):
            cell, n = here[at : at + WEIGHED], size[at : at + WEIGHED]
            for copy in range(int(n.max())):
                which = cell[n > copy]
                drawn = mixed(mixed(key[which] ^ np.uint64(first + copy))[:, None] ^ draw)
                out[which] += np.searchsorted(limits, drawn, "right")
    return out


def bootstrap_sums(scores: DataFrame, draws: int = 400, seed: int = 0) -> DataFrame:
    """Per draw, the weighted sums any statistic of (p, y) is a function of.

    Every row gets a Poisson(1) weight per draw, which approximates resampling with
    replacement at a size that varies slightly. The weight is computed from the row's score, outcome,
    copy number, draw and seed alone, so neither ranges nor tasks have a say. Rows with the same (p, y) are
    combined, the cells are sorted by range, and a task goes over its range in batches and leaves one row
    per draw: nothing is multiplied by the number of draws on its way through a shuffle.

    Columns: draw, pos, neg, sq_error, won (pairs ranked correctly, ties half).
    """

    def weigh(batches):
        pos, below, sq_error, won = (np.zeros(draws) for _ in range(4))
        least = None
        for cells in batches:
            if least is None and len(cells):
                least = float(cells["p"].iloc[0])
            for at in range(0, len(cells), WEIGHED):
                part = cells.iloc[at : at + WEIGHED]
                p = part["p"].to_numpy(float)
                one, zero = (poisson_weights(p, y, part[c].to_numpy(np.int64), draws, seed) for y, c in ((1, "pos"), (0, "neg")))
                upto = below + np.cumsum(zero, 0)
                won += (one * (upto - 0.5 * zero)).sum(0)
                pos += one.sum(0)
                sq_error += ((1 - p) ** 2) @ one + (p**2) @ zero
                below = upto[-1]
        if least is not None:
            yield pd.DataFrame(
                {"least": least, "draw": np.arange(draws), "pos": pos, "neg": below, "sq_error": sq_error, "won": won}
            )

    cells = cut(_cells(scores.where("p is not null")))
    schema = "least double, draw int, pos double, neg double, sq_error double, won double"
    parts = cells.repartitionByRange("p").sortWithinPartitions("p").mapInPandas(weigh, schema)
    # pairs across ranges: every positive beats the negatives of the ranges below
    across = running_sums(parts, "least", ["neg"], ["draw"], bounded=True)
    return across.groupBy("draw").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("sq_error").alias("sq_error"),
        F.sum(F.col("won") + F.col("pos") * F.col("neg_below")).alias("won"),
    )


def weighted_brier() -> Column:
    return F.col("sq_error") / (F.col("pos") + F.col("neg"))


def weighted_auc() -> Column:
    return F.col("won") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0.0))


def bootstrap_interval(
    sums: DataFrame, statistics: dict[str, Column] | None = None, level: float = 0.95
) -> DataFrame:
    """(statistic, low, high): percentile interval over the draws that have an event.

    A statistic is any Column over the sums of :func:`bootstrap_sums`.
    """
    statistics = statistics or {"brier": weighted_brier(), "auc": weighted_auc()}
    tail = (1 - level) / 2
    with_event = sums.where("pos > 0")
    wide = with_event.agg(
        *[F.percentile(c, F.array(F.lit(tail), F.lit(1 - tail))).alias(n) for n, c in statistics.items()]
    )
    names = F.array(
        *[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("q")) for n in statistics]
    )
    return wide.select(F.inline(names)).select(
        "statistic", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high")
    )
