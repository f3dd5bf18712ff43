"""Incremental runs: keep finished rows, redo only what is missing or failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outturn.functions import vocab


def split_done(
    wanted: DataFrame, previous: DataFrame, keys: list[str], retryable: list[str] = vocab.RETRYABLE
) -> tuple[DataFrame, DataFrame]:
    """(reused rows of ``previous``, outstanding rows of ``wanted``).

    Include the source and the extractor among ``keys``, so that switching either redoes
    the work instead of reusing rows made another way.
    """
    finished = previous.where(~F.col("status").isin(retryable))
    targets = wanted.select(*keys).distinct()
    return (
        finished.join(targets, keys, "left_semi"),
        wanted.join(finished.select(*keys), keys, "left_anti"),
    )


def since_day(wanted: DataFrame, since: str | None, day: str = "announced") -> DataFrame:
    """Targets whose day is ``since`` or later; one without a day is left out as well. No ``since`` keeps all."""
    return wanted if since is None else wanted.where(F.col(day) >= F.lit(since).cast("date"))


def run_counts(
    wanted: DataFrame, previous: DataFrame, keys: list[str], since: str | None = None, day: str = "announced",
    retryable: list[str] = vocab.RETRYABLE,
) -> DataFrame:
    """One row: targets, those left out as earlier than ``since``, reused from ``previous`` and outstanding.

    Every target is counted once in one of the last three; a key that ``previous`` holds several times is reused once, and
    null keys are never found in it.
    """
    finished = previous.where(~F.col("status").isin(retryable)).select(*keys, F.lit(True).alias("_done")).distinct()
    late = F.lit(True) if since is None else F.coalesce(F.col(day) >= F.lit(since).cast("date"), F.lit(False))
    marked = wanted.select(*keys, late.alias("_late")).join(finished, keys, "left")
    done = F.col("_done").isNotNull()
    return marked.agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(~F.col("_late")).alias("excluded"),
        F.count_if(F.col("_late") & done).alias("reused"),
        F.count_if(F.col("_late") & ~done).alias("outstanding"),
    )


def resume(
    wanted: DataFrame,
    previous: DataFrame,
    keys: list[str],
    work: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Reused rows plus freshly worked ones; write the result to a new path."""
    reused, outstanding = split_done(wanted, previous, keys)
    return reused.unionByName(work(outstanding), allowMissingColumns=True)
