"""How much of the accretion answer comes from which assumption."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outturn.functions import vocab
from outturn.functions.dealmath import COLUMNS, VECTORS, earnings, funding
from outturn.operators.scenario import INPUTS, inputs

Ranges = dict[str, tuple[float, float]]


def tornado(scenarios: DataFrame, ranges: Ranges | None = None, key: str = "scenario_id") -> DataFrame:
    """One row per (scenario, assumption): accretion at its low and high, others at base.

    ``place`` is 1 for the widest swing of a scenario; equal swings are placed by name.
    """
    ranges = ranges or vocab.ASSUMPTION_RANGES
    moves = F.array(
        *[
            F.struct(
                F.lit(n).alias("assumption"), F.lit(float(lo)).alias("low_value"),
                F.lit(float(hi)).alias("high_value"),
            )
            for n, (lo, hi) in ranges.items()
        ]
    )
    moved = scenarios.select(key, *INPUTS, F.inline(moves))

    def accretion(df: DataFrame, end: str) -> DataFrame:
        x = inputs(
            {
                n: F.when(F.col("assumption") == n, F.col(f"{end}_value")).otherwise(F.col(n))
                for n in ranges
            }
        )
        staged = df.withColumn("_x", F.struct(*[c.alias(n) for n, c in x.items()]))
        at = {n: F.col("_x")[n] for n in INPUTS}
        staged = staged.withColumn(
            "_f", F.struct(*[c.alias(n) for n, c in funding(at, COLUMNS).items()])
        )
        f = {n: F.col("_f")[n] for n in ("new_debt", "new_equity", "cash_from_balance_sheet")}
        return staged.withColumn(f"accretion_at_{end}", earnings(at, f, COLUMNS)["accretion_pct"])

    both = accretion(accretion(moved, "low"), "high")
    swings = both.select(
        key, "assumption", "low_value", "high_value", "accretion_at_low", "accretion_at_high",
        F.abs(F.col("accretion_at_high") - F.col("accretion_at_low")).alias("swing_pp"),
    )
    widest = Window.partitionBy(key).orderBy(F.round("swing_pp", 9).desc(), "assumption")
    return swings.withColumn("place", F.row_number().over(widest))


def uniform_draws(ranges: Ranges, samples: int, seed: int) -> np.ndarray:
    """samples x assumptions, every assumption uniform in its range, same for every scenario."""
    source = random.Random(seed)
    return np.array(
        [[source.uniform(lo, hi) for lo, hi in ranges.values()] for _ in range(samples)]
    )


#: Scenarios that are evaluated at a time: their draws stay in the processor's cache.
BLOCK = 16


def _variance_shares(
    design: np.ndarray, solver: np.ndarray, usable: np.ndarray, outputs: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For each row of outputs, squared coefficients of the standardised regression as shares, and its R squared.

    ``solver`` is the pseudo-inverse of ``design``, whose columns are the ``usable`` draws and a constant.
    """
    spread = outputs.std(axis=1, ddof=1, keepdims=True)
    y = np.divide(outputs - outputs.mean(axis=1, keepdims=True), spread, out=np.zeros_like(outputs), where=spread > 0)
    beta = y @ solver.T
    residual = ((y - beta @ design.T) ** 2).sum(axis=1)
    squares = np.zeros((len(outputs), len(usable)))
    squares[:, usable] = beta[:, :-1] ** 2
    total, size = squares.sum(axis=1, keepdims=True), (y**2).sum(axis=1)
    fit = np.divide(residual, size, out=np.ones_like(size), where=size > 0)
    return squares / np.where(total > 0, total, 1.0), np.maximum(0.0, 1.0 - fit)


def variance_decomposition(
    scenarios: DataFrame,
    ranges: Ranges | None = None,
    samples: int = 4000,
    seed: int = 0,
    key: str = "scenario_id",
) -> DataFrame:
    """Per scenario: accretion when all assumptions vary together, and where it comes from.

    The draws are one small matrix shared by all scenarios, so each task evaluates its
    own scenarios as vectors and nothing is exploded or shuffled.
    """
    ranges = ranges or vocab.ASSUMPTION_RANGES
    names = list(ranges)
    draws = uniform_draws(ranges, samples, seed)
    spread = draws.std(axis=0, ddof=1)
    standardised = np.divide(
        draws - draws.mean(axis=0), spread, out=np.zeros_like(draws), where=spread > 0
    )
    usable = standardised.any(axis=0)
    design = np.column_stack([standardised[:, usable], np.ones(samples)])
    solver = np.linalg.pinv(design)
    columns = {n: draws[:, i] for i, n in enumerate(names)}

    def accretion(x: dict) -> np.ndarray:
        return earnings(x, funding(x, VECTORS), VECTORS)["accretion_pct"]

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        at = {n: rows[n].to_numpy()[:, None] for n in INPUTS}
        y = np.array(np.broadcast_to(accretion(at | columns), (len(rows), samples)), float)
        shares, r_squared = _variance_shares(design, solver, usable, y)
        low, high = np.percentile(y, [5, 95], axis=1)
        numbers = [
            np.broadcast_to(accretion(at), (len(rows), 1))[:, 0], y.mean(axis=1), y.std(axis=1, ddof=1), low, high,
            (y > 0).mean(axis=1), r_squared,
        ]
        named = [dict(zip(names, row, strict=True)) for row in shares.tolist()]
        return pd.DataFrame(dict(zip(fields, [rows[key].to_numpy(), *numbers, named], strict=True)))

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                yield block(batch.iloc[start : start + BLOCK])

    fields = [
        key, "base_accretion_pct", "mean_accretion_pct", "std_accretion_pp", "p5", "p95",
        "share_accretive", "linear_r_squared", "share_of_variance",
    ]
    key_type = scenarios.schema[key].dataType.simpleString()
    schema = ", ".join(
        [f"{key} {key_type}", *[f"{f} double" for f in fields[1:-1]],
         "share_of_variance map<string,double>"]
    )
    found = scenarios.select(key, *INPUTS).mapInPandas(evaluate, schema)
    return found.withColumns({"samples": F.lit(samples), "dominant": dominant("share_of_variance")})


def dominant(shares: str, target: float = 0.8) -> F.Column:
    """The assumptions making up the first ``target`` of the variance, largest first."""
    ranked = F.array_sort(
        F.transform(
            F.map_entries(shares), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("name"))
        )
    )
    before = F.transform(
        ranked,
        lambda e, i: F.struct(
            e["name"].alias("name"),
            F.aggregate(F.slice(ranked, 1, i), F.lit(0.0), lambda a, b: a - b["minus"]).alias("sum"),
        ),
    )
    return F.transform(F.filter(before, lambda e: e["sum"] < target), lambda e: e["name"])
