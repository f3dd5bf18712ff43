"""Selections over the universe and verdict tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_episodes(
    universe: DataFrame,
    labels: list[str],
    since: str | None = None,
    until: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Episodes with a label, announced in [since, until), the first ``limit`` in order."""
    chosen = universe.where(F.col("label").isin(labels))
    if since:
        chosen = chosen.where(F.col("announced") >= F.lit(since).cast("date"))
    if until:
        chosen = chosen.where(F.col("announced") < F.lit(until).cast("date"))
    return chosen.orderBy("announced", "cik").limit(limit) if limit else chosen


def search_deals(
    universe: DataFrame,
    label: str | None = None,
    year: int | None = None,
    query: str | None = None,
    shell: bool | None = None,
) -> DataFrame:
    """Every matching deal; see :func:`page_with_total` for a page with its total."""
    found = universe
    if label:
        found = found.where(F.col("label") == label)
    if year:
        found = found.where(F.year("announced") == year)
    if shell is not None:
        found = found.where(F.coalesce("shell", F.lit(False)) == shell)
    if query:
        needle = query.lower()
        tickers = F.coalesce(F.array_join("tickers", " "), F.lit(""))
        found = found.where(
            F.lower("company").contains(needle) | F.lower(tickers).contains(needle)
        )
    return found


def page(found: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must lie in 1..500 and offset must not be negative")
    return found.orderBy("announced", "cik").offset(offset).limit(limit)


def page_with_total(found: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page whose rows carry ``total``, the number of all matching rows.

    ``found`` is read twice; cut it first where it is costly. A page beyond the end has no rows.
    """
    return page(found, limit, offset).withColumn("total", F.lit(found.count()).cast("bigint"))


def with_status(verdicts: DataFrame, status: str | None = None) -> DataFrame:
    return verdicts.where(F.col("status") == status) if status else verdicts


def validation_sample(rows: DataFrame, n: int, seed: int = 0, key: list[str] = ("cik", "announced")) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run and cluster."""
    ticket = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return rows.orderBy(ticket, *key).limit(n)
