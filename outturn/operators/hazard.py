"""Cause-specific proportional hazards, its assumption test, and concordance.

Rows are combined to distinct (day, event, covariates) patterns once. Each Newton step is
one aggregation of the patterns to sums per day; the driver only ever holds those sums,
at most one row per day of the horizon, and k x k matrices.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions import vocab
from outturn.functions.lineage import cut
from outturn.functions.ranks import running_sums

_Z975 = 1.959963984540054


@dataclass
class HazardFit:
    fitted: bool
    n: int
    events: int
    reason: str = ""
    penalizer: float = 0.0
    covariates: list[str] = field(default_factory=list)
    coefficients: np.ndarray | None = None
    standard_errors: np.ndarray | None = None
    concordance: float | None = None
    proportional_p: np.ndarray | None = None

    def rows(self) -> list[tuple]:
        """(covariate, hazard_ratio, ci_low, ci_high, p, proportional_hazards_p)."""
        if not self.fitted:
            return []
        out = []
        for i, name in enumerate(self.covariates):
            b, se = self.coefficients[i], self.standard_errors[i]
            out.append(
                (name, math.exp(b), math.exp(b - _Z975 * se), math.exp(b + _Z975 * se),
                 two_sided_p(b / se), float(self.proportional_p[i]))
            )
        return out

    @property
    def events_per_covariate(self) -> float:
        return self.events / max(len(self.covariates), 1)


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _patterns(frame: DataFrame, covariates: list[str], horizon: int) -> DataFrame:
    cases = frame.select(
        F.least("duration_days", F.lit(horizon)).alias("day"),
        F.col("observed_break").cast("int").alias("event"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)],
    ).dropna()
    xs = [f"x{i}" for i in range(len(covariates))]
    return cases.groupBy("day", "event", *xs).agg(F.count(F.lit(1)).alias("cases"))


def _day_sums(patterns: DataFrame, scaled: list[Column], beta: np.ndarray) -> dict[str, np.ndarray]:
    """Per day, in ascending order: weighted moments of all cases and of the events."""
    k = len(scaled)
    score = sum((F.lit(float(b)) * z for b, z in zip(beta, scaled)), F.lit(0.0))
    weight = F.col("cases") * F.exp(score)
    died = F.col("event") == 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = [weight, *[weight * z for z in scaled], *[weight * scaled[i] * scaled[j] for i, j in pairs]]
    sums = [F.sum(m).alias(f"all{n}") for n, m in enumerate(moments)]
    sums += [F.sum(F.when(died, m).otherwise(0.0)).alias(f"died{n}") for n, m in enumerate(moments)]
    sums += [F.sum(F.when(died, F.col("cases")).otherwise(0)).alias("d"), F.sum("cases").alias("n")]
    sums += [F.sum(F.when(died, F.col("cases") * z).otherwise(0.0)).alias(f"dx{i}") for i, z in enumerate(scaled)]
    table = np.array(
        [tuple(r) for r in patterns.groupBy("day").agg(*sums).orderBy("day").collect()], dtype=float
    )
    m = len(moments)

    def unpack(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        square = np.zeros((len(block), k, k))
        for n, (i, j) in enumerate(pairs):
            square[:, i, j] = square[:, j, i] = block[:, 1 + k + n]
        return block[:, 0], block[:, 1 : 1 + k], square

    def at_risk(a: np.ndarray) -> np.ndarray:
        return np.cumsum(a[::-1], axis=0)[::-1]

    everyone = [at_risk(a) for a in unpack(table[:, 1 : 1 + m])]
    events = unpack(table[:, 1 + m : 1 + 2 * m])
    tail = table[:, 1 + 2 * m :]
    return {"risk": everyone, "died": events, "d": tail[:, 0], "n": tail[:, 1], "dx": tail[:, 2:]}


def _derivatives(s: dict) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, gradient, Hessian and event-averaged risk means, ties by Efron.

    Tied events take away growing shares of the day's deaths. Everything follows from six sums over the shares.
    """
    k = s["dx"].shape[1]
    loglik, gradient, hessian = 0.0, s["dx"].sum(axis=0), np.zeros((k, k))
    means = np.zeros_like(s["dx"])
    for t in np.flatnonzero(s["d"] > 0):
        (r0, r1, r2), (d0, d1, d2) = ([part[t] for part in s[name]] for name in ("risk", "died"))
        logs, one, first, one2, first2, second2 = _tie_sums(r0, d0, int(s["d"][t]))
        mean = r1 * one - d1 * first
        crossed = np.outer(r1, d1)
        loglik -= logs
        means[t] = mean / s["d"][t]
        gradient = gradient - mean
        hessian -= r2 * one - d2 * first
        hessian += np.outer(r1, r1) * one2 - (crossed + crossed.T) * first2 + np.outer(d1, d1) * second2
    return loglik, gradient, hessian, means


def _tie_sums(risk: float, died: float, ties: int, block: int = 1 << 16) -> np.ndarray:
    """Sums over shares q = 0, 1/ties, ... below 1 of log r, 1/r, q/r, 1/r^2, q/r^2 and q^2/r^2, r = risk - q * died.

    The shares are taken in blocks, so memory does not grow with the ties.
    """
    out = np.zeros(6)
    for start in range(0, ties, block):
        q = np.arange(start, min(ties, start + block)) / ties
        r = risk - q * died
        i = 1 / r
        out += [np.log(r).sum(), i.sum(), (q * i).sum(), (i * i).sum(), (q * i * i).sum(), (q * q * i * i).sum()]
    return out


def fit_hazard(
    frame: DataFrame,
    covariates: list[str] = vocab.STRUCTURE_COVARIATES,
    penalizer: float = 0.1,
    horizon: int = vocab.SURVIVAL_HORIZON_DAYS,
    max_steps: int = 50,
) -> HazardFit:
    """Hazard of a break among deals still live, on complete cases.

    Covariates are standardised for the fit and the ridge penalty counts once per case.
    Refuses with fewer than five events.
    """
    patterns = cut(_patterns(frame, covariates, horizon))
    k = len(covariates)
    xs = [F.col(f"x{i}") for i in range(k)]
    case = F.col("cases")
    first = patterns.agg(
        F.coalesce(F.sum("cases"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("event") == 1, case).otherwise(0)), F.lit(0)).alias("events"),
        *[(F.sum(case * x) / F.sum(case)).alias(f"m{i}") for i, x in enumerate(xs)],
    ).first()
    n, events = int(first["n"]), int(first["events"])
    if events < 5 or events == n:
        return HazardFit(False, n, events, "too few events to fit")
    mean = np.array([first[f"m{i}"] for i in range(k)])
    squares = patterns.agg(
        *[F.sum(case * F.pow(x - F.lit(float(m)), 2)).alias(f"s{i}") for i, (x, m) in enumerate(zip(xs, mean))]
    ).first()
    std = np.sqrt(np.array(list(squares)) / (n - 1))
    if not (std > 0).all():
        flat = [c for c, v in zip(covariates, std) if not v > 0]
        return HazardFit(False, n, events, f"no variation in {', '.join(flat)}")
    scaled = [(x - F.lit(float(m))) / F.lit(float(v)) for x, m, v in zip(xs, mean, std)]

    beta = np.zeros(k)
    sums = _day_sums(patterns, scaled, beta)

    def objective(s: dict, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loglik, gradient, hessian, _ = _derivatives(s)
        loglik += float(s["dx"].sum(axis=0) @ b)
        return (
            loglik - n * penalizer / 2 * float(b @ b),
            gradient - n * penalizer * b,
            hessian - n * penalizer * np.eye(k),
        )

    value, gradient, hessian = objective(sums, beta)
    for _ in range(max_steps):
        step = np.linalg.solve(-hessian, gradient)
        for _ in range(20):
            trial_sums = _day_sums(patterns, scaled, beta + step)
            trial = objective(trial_sums, beta + step)
            if trial[0] >= value - 1e-12:
                break
            step = step / 2
        beta, sums = beta + step, trial_sums
        value, gradient, hessian = trial
        if np.abs(step).max() < 1e-8:
            break

    variance = np.linalg.inv(-hessian)
    risk = sum((F.lit(float(b / v)) * x for b, v, x in zip(beta, std, xs)), F.lit(0.0))
    return HazardFit(
        True, n, events, "", penalizer, list(covariates),
        beta / std,
        np.sqrt(np.diag(variance)) / std,
        concordance(patterns.withColumn("risk", risk), "day", "event", "risk", horizon, "cases"),
        _proportionality(sums, variance),
    )


def _proportionality(s: dict, variance: np.ndarray) -> np.ndarray:
    """p per covariate: do scaled Schoenfeld residuals move with the rank of the day?"""
    d, events = s["d"], s["d"].sum()
    *_, means = _derivatives(s)
    earlier = np.cumsum(s["n"]) - s["n"]
    rank = earlier + (s["n"] + 1) / 2  # average rank of a day's cases
    centred = rank - (d * rank).sum() / events
    residuals = s["dx"] - d[:, None] * means
    scaled = events * residuals @ variance
    moved = (centred[:, None] * scaled).sum(axis=0)
    statistic = moved**2 / (events * np.diag(variance) * (d * centred**2).sum())
    return np.array([math.erfc(math.sqrt(v / 2)) for v in statistic])


def concordance(
    df: DataFrame, day: str, event: str, risk: str, horizon: int, count: str | None = None
) -> float | None:
    """Share of comparable pairs where the earlier event had the higher risk, ties half.

    A pair is comparable when one case has its event strictly before the other's day, or
    on the day the other is censored. No pairs are formed: two different days first differ
    in exactly one binary digit, so grouping days by their leading digits splits all pairs
    into one group each, and within a group the pairs are counted from ranks.
    """
    levels = max(horizon, 1).bit_length()
    n = F.col(count) if count else F.lit(1)
    cells = df.groupBy(
        F.col(day).cast("int").alias("day"), (F.col(event) == 1).alias("died"), F.col(risk).alias("risk")
    ).agg(F.sum(n).alias("cases"))

    def member(level: int) -> Column:
        upper = F.col("day").bitwiseAND(1 << level) != 0
        return F.struct(
            F.lit(level).alias("level"), F.shiftright("day", level + 1).alias("prefix"),
            F.when(~upper & F.col("died"), F.col("cases")).otherwise(0).alias("sooner"),
            F.when(upper, F.col("cases")).otherwise(0).alias("later"),
        )

    same_day = F.struct(
        F.lit(-1).alias("level"), F.col("day").alias("prefix"),
        F.when(F.col("died"), F.col("cases")).otherwise(0).alias("sooner"),
        F.when(~F.col("died"), F.col("cases")).otherwise(0).alias("later"),
    )
    grouped = (
        cells.select("risk", F.inline(F.array(same_day, *[member(b) for b in range(levels)])))
        .where("sooner > 0 or later > 0")
        .groupBy("level", "prefix", "risk")
        .agg(F.sum("sooner").alias("sooner"), F.sum("later").alias("later"))
    )
    keys = ["level", "prefix"]
    ranked = running_sums(cut(grouped), "risk", ["later"], keys)
    won = F.col("sooner") * (F.col("later_below") + 0.5 * F.col("later"))
    totals = ranked.groupBy(*keys).agg(
        F.sum(won).alias("won"),
        (F.sum("sooner").cast("double") * F.sum("later")).alias("pairs"),
    ).agg(F.sum("won").alias("won"), F.sum("pairs").alias("pairs")).first()
    return totals["won"] / totals["pairs"] if totals["pairs"] else None
