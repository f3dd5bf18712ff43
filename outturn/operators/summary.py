"""Rates with their denominators, distributions and coverage over the universe."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions import vocab
from outturn.functions.ranks import order_statistics, tenths
from outturn.operators.resume import run_counts

COUNTS = ["episodes", "resolved", "completed", "break_events", "unresolved", *vocab.EXCLUDED_LABELS]


def _is(labels: list[str]) -> Column:
    return F.col("label").isin(labels)


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("episodes"),
        F.count_if(_is(vocab.RESOLVED_LABELS)).alias("resolved"),
        F.count_if(_is(vocab.COMPLETED_LABELS)).alias("completed"),
        F.count_if(_is(vocab.BREAK_LABELS)).alias("break_events"),
        F.count_if(_is(["unresolved"])).alias("unresolved"),
        *[F.count_if(_is([label])).alias(label) for label in vocab.EXCLUDED_LABELS],
    ]


def label_counts(universe: DataFrame) -> DataFrame:
    """(label, n) over the closed label list, zeros included."""
    counted = universe.agg(*[F.count_if(_is([label])).alias(label) for label in vocab.LABELS])
    return counted.unpivot([], vocab.LABELS, "label", "n")


def labels_by_year(universe: DataFrame) -> DataFrame:
    return universe.groupBy(F.year("announced").alias("year")).agg(
        *[F.count_if(_is([label])).alias(label) for label in vocab.LABELS]
    )


def outcome_rates(universe: DataFrame) -> DataFrame:
    """Counts and rates for all deals, shell companies and operating companies.

    Rates are null where their denominator is zero.
    """
    segment = F.when(F.coalesce("shell", F.lit(False)), "shell").otherwise("operating")
    parts = universe.groupBy(segment.alias("segment")).agg(*_counts())
    total = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    return (
        total.select(F.lit("all").alias("segment"), *COUNTS)
        .unionByName(parts)
        .withColumns(
            {
                "completion_rate": F.col("completed") / F.nullif("resolved", F.lit(0)),
                "unresolved_share": F.col("unresolved") / F.nullif("episodes", F.lit(0)),
            }
        )
    )


def sign_to_close(universe: DataFrame) -> DataFrame:
    """n, p10, median and p90 of days to completion, as plain sorted-list positions."""
    completed = universe.where(_is(vocab.COMPLETED_LABELS))
    return order_statistics(
        completed, "days_to_resolution",
        {"p10": tenths(1), "median": tenths(5), "p90": tenths(9)}, bounded=True,
    )


def item_coverage(universe: DataFrame) -> DataFrame:
    """Per announcement year, the share of episodes with any item-code evidence."""
    has_item = F.exists("evidence", lambda e: e.startswith("item"))
    return universe.groupBy(F.year("announced").alias("year")).agg(
        F.avg(has_item.cast("double")).alias("coverage")
    )


def reliable_window(
    universe: DataFrame, data_cut: str | date, floor: float = vocab.ITEM_COVERAGE_FLOOR
) -> DataFrame:
    """One row: the first year at or above the coverage floor and the censored years."""
    cut = F.lit(str(data_cut)).cast("date")
    open_days = F.datediff(cut, F.make_date("year", F.lit(12), F.lit(31)))
    return item_coverage(universe).agg(
        F.min(F.when(F.col("coverage") >= floor, F.col("year"))).alias("first_usable_year"),
        F.sort_array(
            F.collect_list(F.when(open_days < vocab.SURVIVAL_DAYS, F.col("year")))
        ).alias("right_censored_years"),
    )


def break_rate_by_year(universe: DataFrame) -> DataFrame:
    return universe.groupBy(F.year("announced").alias("year")).agg(
        (
            F.count_if(_is(vocab.BREAK_LABELS))
            / F.greatest(F.count_if(_is(vocab.RESOLVED_LABELS)), F.lit(1))
        ).alias("break_rate")
    )


def form_frequencies(episode_filings: DataFrame) -> DataFrame:
    """Announcement filings per form, most frequent first, ties by name."""
    counted = episode_filings.groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "form")


def top_categories(
    universe: DataFrame, column: str = "sic_description", k: int = vocab.TOP_CATEGORIES
) -> DataFrame:
    """The k most frequent non-blank categories, ties by name."""
    named = universe.where(F.coalesce(F.col(column), F.lit("")) != "")
    counted = named.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(k)


def announcement_stats(announcements: DataFrame) -> DataFrame:
    return announcements.agg(
        F.count(F.lit(1)).alias("announcement_filings"),
        F.count_distinct("cik").alias("distinct_ciks"),
    )


def verdict_stats(verdicts: DataFrame) -> DataFrame:
    """(section, key, n): statuses, reasons, fees extracted and rows to retry."""
    statuses = verdicts.groupBy(F.lit("status").alias("section"), F.col("status").alias("key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    reasons = (
        verdicts.select(F.explode("reasons").alias("key"))
        .groupBy(F.lit("reason").alias("section"), "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = verdicts.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("break_fee_usd") != 0).alias("break_fee_extracted"),
        F.count_if(F.col("status").isin(vocab.RETRYABLE)).alias("retry_needed"),
    ).unpivot([], ["candidates", "break_fee_extracted", "retry_needed"], "key", "n")
    return statuses.unionByName(reasons).unionByName(
        totals.select(F.lit("total").alias("section"), "key", "n")
    )


def run_stats(
    results: DataFrame, wanted: DataFrame, previous: DataFrame, keys: list[str], since: str | None = None
) -> DataFrame:
    """``verdict_stats`` of a resumed run's rows, with what it left out, reused and worked on.

    ``wanted`` are all candidates, also those before ``since``; ``previous`` are the rows of the earlier run.
    """
    counts = run_counts(wanted, previous, keys, since).select(
        F.col("excluded").alias("excluded_count"), F.col("reused").alias("reused_from_previous_run"), "outstanding"
    )
    names = counts.columns
    rows = counts.unpivot([], names, "key", "n").select(F.lit("run").alias("section"), "key", "n")
    if since is not None:
        before = rows.where("key = 'excluded_count'").select(F.lit("excluded_before").alias("section"), F.lit(since).alias("key"), "n")
        rows = rows.unionByName(before)
    return verdict_stats(results).unionByName(rows)


def extraction_stats(terms: DataFrame, by: list[str] = ()) -> DataFrame:
    """Coverage, mixes and reconciliation shares over extracted rows, optionally grouped.

    Grouped by ``extractor`` it compares extractors on the same documents.
    """
    by = list(by)
    done = F.col("status") == vocab.EXTRACTED
    check = F.col("reconciliation.status")
    extracted = F.count_if(done)

    def filled(name: str) -> Column:
        return F.col(name).cast("string").isNotNull() & (F.col(name).cast("string") != "")

    wide = terms.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"),
        extracted.alias("extracted"),
        *[
            (F.count_if(done & filled(f)) / F.nullif(extracted, F.lit(0))).alias(f"coverage_{f}")
            for f in vocab.COVERAGE_FIELDS
        ],
        *[
            F.count_if(done & (F.col("consideration") == c)).alias(f"consideration_{c}")
            for c in ("cash", "stock", "cash_and_stock", "unknown")
        ],
        F.count_if(done & F.col("press_release").isNotNull()).alias("with_press_release"),
        *[
            F.count_if(done & (check == s)).alias(s)
            for s in (vocab.RECONCILED, vocab.MISMATCH, vocab.INSUFFICIENT)
        ],
        F.count_if(F.col("status").isin(vocab.RETRYABLE)).alias("retry_needed"),
    )
    checkable = F.col(vocab.RECONCILED) + F.col(vocab.MISMATCH)
    return wide.withColumns(
        {
            "checkable": checkable,
            "reconciled_share_of_checkable": F.col(vocab.RECONCILED) / F.nullif(checkable, F.lit(0)),
            "reconciled_share_of_extracted": F.col(vocab.RECONCILED)
            / F.nullif(F.col("extracted"), F.lit(0)),
        }
    )


def premium_errors(terms: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, median and p90 of the absolute premium error, as sorted-list positions."""
    errors = terms.where(F.col("status") == vocab.EXTRACTED).select(
        *by, F.col("reconciliation.absolute_error_pp").alias("error_pp")
    )
    return order_statistics(errors, "error_pp", {"median": tenths(5), "p90": tenths(9)}, by)


def break_rate_bounds(universe: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Break rate if no undecided candidate is a break, and if all of them are."""
    undecided = [vocab.UNCLEAR, vocab.NO_DOCUMENT, vocab.NO_SECTION, vocab.FETCH_FAILED]
    resolved = universe.select(
        F.when(_is(vocab.RESOLVED_LABELS), 1).otherwise(0).alias("resolved"),
        F.lit(0).alias("confirmed"), F.lit(0).alias("undecided"),
    )
    decided = verdicts.select(
        F.lit(0).alias("resolved"),
        F.when(F.col("status") == vocab.CONFIRMED, 1).otherwise(0).alias("confirmed"),
        F.when(F.col("status").isin(undecided), 1).otherwise(0).alias("undecided"),
    )
    sums = resolved.unionByName(decided).agg(
        *[F.sum(c).alias(c) for c in ("resolved", "confirmed", "undecided")]
    )
    resolved_count = F.nullif(F.col("resolved"), F.lit(0))
    return sums.withColumns(
        {
            "lower": F.col("confirmed") / resolved_count,
            "upper": (F.col("confirmed") + F.col("undecided")) / resolved_count,
        }
    )


def dataset_counts(universe: DataFrame, verdicts: DataFrame) -> DataFrame:
    both = universe.select(F.lit("episodes").alias("t")).unionAll(verdicts.select(F.lit("breaks")))
    return both.agg(
        F.count_if(F.col("t") == "episodes").alias("episodes"),
        F.count_if(F.col("t") == "breaks").alias("breaks_read"),
    )


def summary(universe: DataFrame, data_cut: str | date, members: DataFrame) -> DataFrame:
    """(section, metric, value) rows of the headline report, ready to be written.

    ``members`` are the announcement filings of the universe's episodes.
    """
    def long(df: DataFrame, section: str, key: str | None, values: list[str]) -> DataFrame:
        metric = F.col("_m") if key is None else F.concat_ws(":", F.col(key).cast("string"), "_m")
        doubled = df.select(*([key] if key else []), *[F.col(v).cast("double").alias(v) for v in values])
        return doubled.unpivot([key] if key else [], values, "_m", "value").select(
            F.lit(section).alias("section"), metric.alias("metric"), "value"
        )

    rates = outcome_rates(universe)
    window = reliable_window(universe, data_cut)
    censored = window.select(F.explode("right_censored_years").alias("year"), F.lit(1).alias("censored"))
    rate_columns = [c for c in rates.columns if c != "segment"]
    return (
        long(label_counts(universe), "labels", "label", ["n"])
        .unionAll(long(rates, "rates", "segment", rate_columns))
        .unionAll(long(sign_to_close(universe), "sign_to_close_days", None, ["n", "p10", "median", "p90"]))
        .unionAll(long(labels_by_year(universe), "by_year", "year", vocab.LABELS))
        .unionAll(long(break_rate_by_year(universe), "break_rate_by_year", "year", ["break_rate"]))
        .unionAll(long(item_coverage(universe), "item_code_coverage", "year", ["coverage"]))
        .unionAll(long(top_categories(universe), "top_sic", "sic_description", ["n"]))
        .unionAll(long(window, "reliable_window", None, ["first_usable_year"]))
        .unionAll(long(censored, "right_censored_years", "year", ["censored"]))
        .unionAll(long(form_frequencies(members), "announcement_forms", "form", ["n"]))
    )
