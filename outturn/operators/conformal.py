"""Prediction sets with a coverage guarantee, marginal and per class."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions.ranks import order_statistics

def _p() -> Column:
    return F.col("p")


def _y() -> Column:
    return F.col("y")


def stratified_split(
    rows: DataFrame, fraction: float, label: str, key: list[str], seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(rest, held): ``round(fraction * n)`` rows of every class held out.

    Rows are ordered by a seeded hash of their key, so the split does not depend on how
    the data is partitioned. Only one threshold per class is looked up; the rows
    themselves are never ranked in one place.
    """
    ticket = F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in key])
    # 52 bits: exact as a double, which is what the range edges are made of
    numbered = rows.withColumn("_ticket", F.shiftrightunsigned(ticket, 12))
    last: dict[str, Callable[[Column], Column]] = {
        "_last": lambda n: F.round(n * fraction).cast("bigint") - 1
    }
    thresholds = order_statistics(numbered, "_ticket", last, [label]).select(label, "_last").collect()
    held = F.lit(False)
    for row in thresholds:
        if row["_last"] is not None:
            held = held | ((F.col(label) == row[label]) & (F.col("_ticket") <= row["_last"]))
    return numbered.where(~held).drop("_ticket"), numbered.where(held).drop("_ticket")


def _true_class_gap() -> Column:
    """One minus the probability given to the class that happened."""
    return F.when(_y() == 1, 1 - _p()).otherwise(1 - (1 - _p()))


def _rank(confidence: float) -> Callable[[Column], Column]:
    return lambda n: F.ceil((n + 1) * confidence) - 1


def thresholds(calibration: DataFrame, confidence: float = 0.9) -> dict[str, float]:
    """marginal, class 0 and class 1 thresholds; infinite when a class is too small."""
    gaps = calibration.select("y", _true_class_gap().alias("gap"))
    per_class = order_statistics(gaps, "gap", {"at": _rank(confidence)}, ["y"]).collect()
    overall = order_statistics(gaps, "gap", {"at": _rank(confidence)}).first()

    def value(found: float | None) -> float:
        return math.inf if found is None else float(found)

    by_class = {int(r["y"]): value(r["at"]) for r in per_class}
    return {
        "marginal": value(overall["at"]),
        "class_0": by_class.get(0, math.inf),
        "class_1": by_class.get(1, math.inf),
    }


def prediction_sets(test: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Adds, per method, whether each label is in the set.

    ``marginal`` uses one threshold, ``corrected`` adds the likelier label to an empty
    set, ``conditional`` uses a threshold per class.
    """
    def inside(gap: Column, limit: float) -> Column:
        return gap <= F.lit(limit)

    has1 = inside(1 - _p(), limits["marginal"])
    has0 = inside(1 - (1 - _p()), limits["marginal"])
    empty = ~has1 & ~has0
    likelier1 = _p() > 1 - _p()
    return test.select(
        "*",
        has0.alias("marginal_0"), has1.alias("marginal_1"),
        (has0 | (empty & ~likelier1)).alias("corrected_0"),
        (has1 | (empty & likelier1)).alias("corrected_1"),
        inside(1 - (1 - _p()), limits["class_0"]).alias("conditional_0"),
        inside(1 - _p(), limits["class_1"]).alias("conditional_1"),
    )


def coverage_summary(sets: DataFrame) -> DataFrame:
    """Per method: coverage overall and per class, set sizes."""
    methods = ["marginal", "corrected", "conditional"]
    long = sets.select(
        "y",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("method"),
                        F.when(_y() == 1, F.col(f"{m}_1")).otherwise(F.col(f"{m}_0")).cast("double").alias("covered"),
                        (F.col(f"{m}_0").cast("int") + F.col(f"{m}_1").cast("int")).alias("size"),
                    )
                    for m in methods
                ]
            )
        ),
    )
    size = F.col("size")
    return long.groupBy("method").agg(
        F.avg("covered").alias("coverage"),
        F.avg(F.when(_y() == 1, F.col("covered"))).alias("coverage_on_breaks"),
        F.avg(F.when(_y() == 0, F.col("covered"))).alias("coverage_on_completions"),
        F.avg((size == 0).cast("double")).alias("empty"),
        F.avg((size == 1).cast("double")).alias("singleton"),
        F.avg((size == 2).cast("double")).alias("both_labels"),
        F.avg(size.cast("double")).alias("mean_set_size"),
    )


def coverage(calibration: DataFrame, test: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Calibrate on one table of (p, y), report coverage on another."""
    return coverage_summary(prediction_sets(test, thresholds(calibration, confidence)))
