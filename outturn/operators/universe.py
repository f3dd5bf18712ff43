"""The deal universe: labelled episodes with the attributes of their company."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outturn.functions import forms, vocab
from outturn.operators.outcomes import label_outcomes
from outturn.operators.timeline import episode_timeline


def index_names(announcements: DataFrame) -> DataFrame:
    """The first company name seen in the index per entity, used when history has none."""
    return announcements.groupBy("cik").agg(
        F.min_by("company", F.struct("filed", "accession")).alias("index_name")
    )


def attach_company(
    labelled: DataFrame, companies: DataFrame, names: DataFrame | None = None
) -> DataFrame:
    """Inner join on cik: entities without a history table entry drop out (see `coverage`)."""
    attributes = companies.select(
        "cik",
        F.col("name").alias("company_name"),
        F.coalesce("sic", F.lit("")).alias("sic"),
        F.coalesce("sic_description", F.lit("")).alias("sic_description"),
        "tickers",
        "exchanges",
    )
    rows = labelled.join(attributes, "cik")
    fallback = F.lit("")
    if names is not None:
        rows = rows.join(names, "cik", "left")
        fallback = F.coalesce("index_name", F.lit(""))
    company = F.coalesce(F.nullif(F.col("company_name"), F.lit("")), fallback)
    shell = forms.is_shell_sic(F.col("sic")) | (F.col("label") == "completed_shell")
    return rows.select(
        *labelled.columns,
        company.alias("company"),
        "sic",
        "sic_description",
        shell.alias("shell"),
        "tickers",
        "exchanges",
    )


def build_universe(
    filings: DataFrame,
    companies: DataFrame,
    data_cut: str | date,
    announcements: DataFrame | None = None,
    gap_days: int = vocab.EPISODE_GAP_DAYS,
    **horizons: int,
) -> DataFrame:
    """History (and, if given, an announcement index) to labelled universe rows."""
    timeline = episode_timeline(filings, announcements, gap_days)
    labelled = label_outcomes(timeline, data_cut, **horizons)
    names = None
    if announcements is not None and "company" in announcements.columns:
        names = index_names(announcements)
    return attach_company(labelled, companies, names)


def attach_announcements(universe: DataFrame, arrays: DataFrame) -> DataFrame:
    """Adds ``announcement_forms`` and ``announcement_accessions`` of each episode, in filing order.

    ``arrays`` are the rows of ``episode_arrays``; the chunks of a long episode are put together again by ``chunk_no``.
    """
    chunk = F.struct("chunk_no", "announcement_forms", "announcement_accessions")
    whole = arrays.groupBy("cik", "announced").agg(F.sort_array(F.collect_list(chunk)).alias("chunks")).select(
        "cik", "announced", F.flatten("chunks.announcement_forms").alias("announcement_forms"),
        F.flatten("chunks.announcement_accessions").alias("announcement_accessions"),
    )
    return universe.join(whole, ["cik", "announced"], "left")


def history_window(announcements: DataFrame, lead_days: int = vocab.HISTORY_LEAD_DAYS) -> DataFrame:
    """Per entity, the earliest day of history worth loading."""
    return announcements.groupBy("cik").agg(
        F.date_sub(F.min("filed"), lead_days).alias("since")
    )


def coverage(announcements: DataFrame, companies: DataFrame, universe: DataFrame) -> DataFrame:
    """Targets, targets without a history, and episodes, as one row."""
    targets = announcements.select("cik").distinct()
    without = targets.join(companies.select("cik"), "cik", "left_anti")
    counts = (
        targets.select(F.lit("targets").alias("metric"))
        .unionAll(without.select(F.lit("targets_without_history")))
        .unionAll(universe.select(F.lit("episodes")))
    )
    return counts.agg(
        *[
            F.count_if(F.col("metric") == m).alias(m)
            for m in ("targets", "targets_without_history", "episodes")
        ]
    )
