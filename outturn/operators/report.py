"""The model report: frame, survival, scores, inference and coverage in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outturn.functions import vocab
from outturn.functions.lineage import cut
from outturn.operators import conformal, scoring
from outturn.operators.features import frame_counts, time_split
from outturn.operators.hazard import HazardFit, fit_hazard
from outturn.operators.inference import LogitFit, fit_logit
from outturn.operators.models import TooFewEvents, fit_calibrated
from outturn.operators.survival import curve_report

#: ``note`` says what a number can't: reasons of refusals, names of dropped covariates, years of a split.
SCHEMA = "section string, metric string, value double, n bigint, note string"


def _long(df: DataFrame, section: str, label: str | None = None) -> DataFrame:
    """One row per numeric column of a small result table."""
    values = [c for c in df.columns if c != label]
    typed = df.select(*([label] if label else []), *[F.col(c).cast("double").alias(c) for c in values])
    metric = F.concat_ws(":", F.col(label).cast("string"), "_m") if label else F.col("_m")
    return typed.unpivot([label] if label else [], values, "_m", "value").select(
        F.lit(section).alias("section"), metric.alias("metric"), "value",
        F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("note"),
    )


def _hazard_rows(section: str, fit: HazardFit) -> list[tuple]:
    rows = [
        (section, "fitted", float(fit.fitted), fit.n, fit.reason or None), (section, "events", float(fit.events), fit.n, None),
    ]
    if fit.fitted:
        rows += [
            (section, "concordance", fit.concordance, fit.n, None),
            (section, "events_per_covariate", fit.events_per_covariate, fit.n, None),
            (section, "penalizer", fit.penalizer, fit.n, None),
        ]
    names = ("hazard_ratio", "ci_low", "ci_high", "p", "proportional_hazards_p")
    return rows + [
        (section, f"{row[0]}:{m}", float(v), fit.n, None) for row in fit.rows() for m, v in zip(names, row[1:])
    ]


def _logit_rows(section: str, fit: LogitFit) -> list[tuple]:
    rows = [
        (section, "fitted", float(fit.fitted), fit.n, fit.reason or None), (section, "events", float(fit.events), fit.n, None),
        (section, "dropped_as_constant", float(len(fit.dropped)), fit.n, "|".join(fit.dropped) or None),
    ]
    if not fit.fitted:
        return rows
    rows += [
        (section, "parameters", float(fit.parameters), fit.n, None),
        (section, "events_per_parameter", fit.events_per_parameter, fit.n, None),
        (section, "underpowered", float(fit.underpowered), fit.n, None),
        (section, "pseudo_r_squared", fit.pseudo_r_squared, fit.n, None),
        (section, "llr_p", fit.llr_p, fit.n, None),
        (section, "carry_information", float(len(fit.carry_information)), fit.n, "|".join(fit.carry_information) or None),
    ]
    names = ("odds_ratio", "ci_low", "ci_high", "p")
    for c, odds in fit.odds.items():
        rows += [(section, f"{c}:{m}", float(v), fit.n, None) for m, v in zip(names, odds)]
        rows.append((section, f"{c}:crosses_one", float(odds[1] <= 1.0 <= odds[2]), fit.n, None))
    return rows


def _sizes(rows: DataFrame, section: str, part: str, note: str | None = None) -> DataFrame:
    """Rows, breaks and share of breaks of a part of the frame."""
    counts = rows.agg(
        F.count(F.lit(1)).alias(f"{part}:deals"), F.coalesce(F.sum("broke"), F.lit(0)).alias(f"{part}:breaks"),
        F.avg("broke").alias(f"{part}:base_rate"),
    )
    return _long(counts, section).withColumn("note", F.lit(note).cast("string"))


def score_report(scored: DataFrame, base_rate: float, draws: int, seed: int, section: str) -> DataFrame:
    """Calibration, ranking, value and bootstrap intervals of scored rows (p, y)."""
    scored = cut(scored.select("p", "y"))
    curve = scoring.calibration_curve(scored)
    intervals = scoring.bootstrap_interval(scoring.bootstrap_sums(scored, draws, seed))
    return (
        _long(scoring.brier(scored, base_rate), section)
        .unionAll(_long(scoring.auc(scored), section))
        .unionAll(_long(scoring.calibration_error(curve), section))
        .unionAll(_long(curve, f"{section}:calibration", "bin"))
        .unionAll(_long(scoring.expected_value(scored), f"{section}:value", "threshold"))
        .unionAll(_long(intervals, f"{section}:interval", "statistic"))
    )


def fit_and_score(
    frame: DataFrame, kind: str, cutoff_year: int, draws: int = 400, seed: int = 0, rounds: int = 200
) -> DataFrame:
    """Trained before the cutoff year, tested from it on."""
    train, test = time_split(frame, cutoff_year)
    sizes = _sizes(train, kind, "trained_on", f"<{cutoff_year}").unionAll(_sizes(test, kind, "tested_on", f">={cutoff_year}"))
    base_rate = train.agg(F.avg("broke")).first()[0]
    model = fit_calibrated(train, kind, seed, rounds=rounds)
    scored = model.score(test).withColumn("y", F.col("broke"))
    return sizes.unionAll(score_report(scored, base_rate, draws, seed, kind))


def conformal_report(
    frame: DataFrame, cutoff_year: int, confidence: float = 0.9, seed: int = 0, split: str = "time"
) -> DataFrame:
    """Coverage under the time split, or under a random one as a diagnostic."""
    key = ["cik", "announced"]
    if split == "random":
        train, test = conformal.stratified_split(frame, 0.33, "broke", key, seed)
    else:
        train, test = time_split(frame, cutoff_year)
    fit_part, calibration = conformal.stratified_split(train, 0.3, "broke", key, seed + 1)
    model = fit_calibrated(fit_part, "logistic", seed)
    held, tested = (
        cut(model.score(part).select("p", F.col("broke").alias("y"))) for part in (calibration, test)
    )
    section = f"conformal:{split}"
    return (
        _sizes(calibration, section, "calibrated_on").unionAll(_sizes(test, section, "tested_on"))
        .unionAll(_long(conformal.coverage(held, tested, confidence), section, "method"))
    )


def model_report(
    labelled: DataFrame,
    censored: DataFrame,
    cutoff_year: int = vocab.SPLIT_YEAR,
    draws: int = 400,
    seed: int = 0,
    rounds: int = 200,
) -> DataFrame:
    """(section, metric, value, n, note) rows. ``censored`` is the frame with pending deals."""
    spark = labelled.sparkSession
    labelled, censored = cut(labelled), cut(censored)
    small = [
        *_hazard_rows("hazard:structure", fit_hazard(censored, vocab.STRUCTURE_COVARIATES)),
        *_hazard_rows("hazard:terms", fit_hazard(censored, vocab.TERM_COVARIATES)),
        *_logit_rows("inference:structure", fit_logit(labelled, vocab.STRUCTURE_COVARIATES)),
        *_logit_rows("inference:terms", fit_logit(labelled, vocab.TERM_COVARIATES)),
    ]
    parts = [_long(frame_counts(labelled), "frame"), _long(curve_report(censored), "survival")]
    fits = {
        "logistic": lambda: fit_and_score(labelled, "logistic", cutoff_year, draws, seed),
        "boosted": lambda: fit_and_score(labelled, "boosted", cutoff_year, draws, seed, rounds),
        "conformal:time": lambda: conformal_report(labelled, cutoff_year, seed=seed),
        "conformal:random": lambda: conformal_report(labelled, cutoff_year, seed=seed, split="random"),
    }
    for section, fit in fits.items():
        try:
            parts.append(fit())
            small.append((section, "fitted", 1.0, None, None))
        except TooFewEvents as reason:
            small.append((section, "fitted", 0.0, None, str(reason)))
    parts.append(spark.createDataFrame(small, SCHEMA))
    return reduce(DataFrame.unionAll, parts)
