"""Do the terms carry information? A logit with standard errors, and its refusals."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions import vocab
from outturn.functions.stats import chi_square_tail
from outturn.operators.features import complete_cases, varying

_Z975 = 1.959963984540054
_MAX_SPAN = 1e6
_MAX_COEFFICIENT = 20.0  # per standard deviation; only separation gets here


@dataclass
class LogitFit:
    fitted: bool
    n: int
    events: int
    reason: str = ""
    dropped: list[str] = field(default_factory=list)
    # name -> (odds_ratio, ci_low, ci_high, p)
    odds: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)
    pseudo_r_squared: float | None = None
    llr_p: float | None = None

    @property
    def parameters(self) -> int:
        return len(self.odds) + 1

    @property
    def events_per_parameter(self) -> float:
        return self.events / self.parameters

    @property
    def underpowered(self) -> bool:
        return self.events_per_parameter < vocab.EVENTS_PER_PARAMETER

    @property
    def carry_information(self) -> list[str]:
        return [n for n, (_, low, high, _) in self.odds.items() if not low <= 1.0 <= high]


def fit_logit(frame: DataFrame, covariates: list[str], label: str = "broke", max_iter: int = 100) -> LogitFit:
    """Logit on complete cases; refuses when the coefficients are not identified.

    Cases with the same covariates and outcome are combined to one weighted row first, so
    a fit on flags costs the same however many deals there are. Newton steps with halving;
    each is one aggregation of the patterns to a handful of sums.
    """
    cases = complete_cases(frame, [*covariates, label])
    patterns = cases.groupBy(*covariates, label).agg(F.count(F.lit(1)).alias("cases")).persist()
    try:
        return _fit_patterns(patterns, covariates, label, max_iter)
    finally:
        patterns.unpersist()


def _fit_patterns(patterns: DataFrame, covariates: list[str], label: str, max_iter: int) -> LogitFit:
    sizes = patterns.agg(
        F.coalesce(F.sum("cases"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("cases") * F.col(label)), F.lit(0)).alias("events"),
    ).first()
    n, events = int(sizes["n"]), int(sizes["events"])
    if events < 5 or events == n:
        return LogitFit(False, n, events, "too few events")
    usable = varying(patterns, covariates)
    dropped = sorted(set(covariates) - set(usable))
    if not usable:
        return LogitFit(False, n, events, "no covariate varies in the complete cases", dropped)
    # zero mean and unit spread while fitting, so the result does not hang on units
    moments = patterns.agg(
        *[(F.sum(F.col("cases") * F.col(c)) / n).alias(f"m_{c}") for c in usable],
        *[(F.sum(F.col("cases") * F.col(c) * F.col(c)) / n).alias(f"s_{c}") for c in usable],
    ).first()
    mean = {c: float(moments[f"m_{c}"]) for c in usable}
    spread = {c: math.sqrt(max(float(moments[f"s_{c}"]) - mean[c] ** 2, 1e-300)) for c in usable}
    scaled = patterns.select(
        F.col(label).cast("double").alias("label"), F.col("cases").cast("double").alias("cases"),
        *[((F.col(c).cast("double") - mean[c]) / spread[c]).alias(c) for c in usable],
    )
    separated = "separation: a covariate predicts the outcome exactly, so its coefficient is not identified"
    columns = [F.lit(1.0), *[F.col(c) for c in usable]]
    beta = np.zeros(len(columns))
    value, gradient, information = _moments(scaled, columns, beta)
    converged = False
    for _ in range(max_iter):
        try:
            step = np.linalg.solve(information, gradient)
        except np.linalg.LinAlgError:
            return LogitFit(False, n, events, f"singular system (usually {separated})", dropped)
        for _ in range(20):
            trial = _moments(scaled, columns, beta + step)
            if trial[0] >= value - 1e-9:
                break
            step = step / 2
        beta, (value, gradient, information) = beta + step, trial
        if np.abs(step).max() < 1e-9 * max(1.0, np.abs(beta).max()):
            converged = True
            break
        if np.abs(beta).max() > _MAX_COEFFICIENT:
            break
    rate = events / n
    null_value = n * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
    if value > -1e-6 * n:
        return LogitFit(False, n, events, f"perfect {separated}", dropped)
    if not converged:
        return LogitFit(False, n, events, f"did not converge, which here means {separated}", dropped)
    errors = np.sqrt(np.diag(np.linalg.inv(information)))
    odds = {}
    for c, b, se in zip(usable, beta[1:], errors[1:]):
        z = b / se
        b, se = float(b) / spread[c], float(se) / spread[c]
        if not math.isfinite(se) or 2 * _Z975 * se > math.log(_MAX_SPAN):
            return LogitFit(False, n, events, separated, dropped)
        odds[c] = (
            math.exp(b), math.exp(b - _Z975 * se), math.exp(b + _Z975 * se),
            math.erfc(abs(z) / math.sqrt(2)),
        )
    return LogitFit(
        True, n, events, "", dropped, odds,
        1 - value / null_value,
        chi_square_tail(2 * (value - null_value), len(usable)),
    )


def _moments(
    patterns: DataFrame, columns: list[Column], beta: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and information at ``beta``: one aggregation, one row."""
    k = len(columns)
    eta = sum((F.lit(float(b)) * c for b, c in zip(beta, columns)), F.lit(0.0))
    read = patterns.withColumn("_eta", eta).withColumn("_mu", 1 / (1 + F.exp(-F.col("_eta"))))
    eta, mu, case, y = (F.col(c) for c in ("_eta", "_mu", "cases", "label"))
    log_total = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    sums = [F.sum(case * (y * eta - log_total))]
    sums += [F.sum(case * (y - mu) * c) for c in columns]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums += [F.sum(case * mu * (1 - mu) * columns[i] * columns[j]) for i, j in pairs]
    row = list(read.agg(*[s.alias(f"s{n}") for n, s in enumerate(sums)]).first())
    information = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1 + k :]):
        information[i, j] = information[j, i] = v
    return float(row[0]), np.array(row[1 : 1 + k]), information
