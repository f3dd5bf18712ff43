"""The feature frame: what was known at the announcement, and nothing that came later."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions import forms, vocab


def latest_per_episode(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One row per (cik, announced): the last one by ``order``.

    A table without that column has no last row; the one that is greatest as text is taken, the same on every run.
    """
    keys = ["cik", "announced"]
    rest = [c for c in rows.columns if c not in keys]
    by = F.col(order) if order in rows.columns else F.to_json(F.struct(*rest))
    last = F.max_by(F.struct(*rest), by).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def check_no_leakage(frame: DataFrame) -> DataFrame:
    """Raises when an outcome column is among the features."""
    leaked = sorted(vocab.LEAKY_FIELDS & set(frame.columns))
    if leaked:
        raise ValueError(f"outcome columns reached the feature frame: {leaked}")
    return frame


def build_frame(
    universe: DataFrame,
    verdicts: DataFrame,
    terms: DataFrame,
    data_cut: str | date,
    window_start: str = vocab.FRAME_WINDOW_START,
    window_end: str = vocab.FRAME_WINDOW_END,
    include_pending: bool = False,
) -> DataFrame:
    """One row per labelled episode announced in [window_start, window_end).

    A terminated episode stays only when its verdict is ``confirmed``; otherwise its real
    outcome is unknown. Pending episodes can be kept as censored ones (``broke`` null).
    """
    allowed = vocab.RESOLVED_LABELS + (["pending"] if include_pending else [])
    announced = F.col("announced")
    inside = universe.where(
        F.col("label").isin(allowed)
        & (announced >= F.lit(window_start).cast("date"))
        & (announced < F.lit(window_end).cast("date"))
    )
    keys = ["cik", "announced"]
    confirmed = (
        latest_per_episode(verdicts).where(F.col("status") == vocab.CONFIRMED)
        .select(*keys, F.lit(True).alias("confirmed"))
    )
    read = latest_per_episode(terms).where(F.col("status") == vocab.EXTRACTED).select(
        *keys,
        *vocab.TERM_FIELDS,
        *[F.col(f).cast("int").alias(f) for f in vocab.FLAG_FIELDS],
        F.when(
            (F.col("break_fee_pct") > 0) & (F.col("break_fee_pct") <= vocab.BREAK_FEE_PCT_MAX),
            F.col("break_fee_pct"),
        ).alias("break_fee_pct"),
        "consideration",
        F.lit(1).alias("has_terms"),
    )
    joined = inside.join(confirmed, keys, "left").join(read, keys, "left")
    kept = joined.where((F.col("label") != "terminated") | F.col("confirmed"))
    broke = F.when(F.col("label") == "terminated", 1).when(
        F.col("label").isin(vocab.COMPLETED_LABELS), 0
    )
    days = F.col("days_to_resolution")
    open_days = F.datediff(F.lit(str(data_cut)).cast("date"), announced)

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    return check_no_leakage(
        kept.select(
            "cik", "company", "announced",
            F.year("announced").alias("year"),
            broke.alias("broke"),
            forms.sector(F.col("sic")).alias("sector"),
            flag(F.col("tender_offer_filing")).alias("tender_offer_filing"),
            flag(F.col("going_private")).alias("going_private"),
            flag(F.col("shell")).alias("shell"),
            *vocab.TERM_FIELDS,
            *vocab.FLAG_FIELDS,
            "break_fee_pct",
            F.coalesce("consideration", F.lit("unknown")).alias("consideration"),
            F.coalesce("has_terms", F.lit(0)).alias("has_terms"),
            F.when(days.isNull(), open_days).otherwise(F.greatest(days, F.lit(1))).alias("duration_days"),
            F.when(days.isNull(), 0).otherwise(broke).alias("observed_break"),
            F.when(days.isNull(), 0).otherwise(1 - broke).alias("observed_close"),
        )
    )


def time_split(frame: DataFrame, cutoff_year: int = vocab.SPLIT_YEAR) -> tuple[DataFrame, DataFrame]:
    """(train, test): announced before the cutoff year, and from it on."""
    return frame.where(F.col("year") < cutoff_year), frame.where(F.col("year") >= cutoff_year)


def frame_counts(frame: DataFrame) -> DataFrame:
    return frame.agg(
        F.count(F.lit(1)).alias("deals"),
        F.coalesce(F.sum("broke"), F.lit(0)).alias("confirmed_breaks"),
        F.coalesce(F.sum("has_terms"), F.lit(0)).alias("with_extracted_terms"),
    )


def complete_cases(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.select(*columns).dropna()


def varying(frame: DataFrame, columns: list[str]) -> list[str]:
    """The columns with more than one value, found in one pass over minima and maxima."""
    spread = frame.agg(
        *[(F.min(c) != F.max(c)).alias(c) for c in columns]
    ).first()
    return [c for c in columns if spread[c]]
