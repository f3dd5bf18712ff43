"""Company histories: JSON with one array per column, turned into filing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = ["form", "filingDate", "items", "accessionNumber", "reportDate", "primaryDocument"]
_BLOCK = ", ".join(f"{f}: array<string>" for f in _FIELDS)
PAGE_SCHEMA = ", ".join(f"{f} array<string>" for f in _FIELDS)
HISTORY_SCHEMA = f"""
cik string, name string, sic string, sicDescription string,
tickers array<string>, exchanges array<string>,
filings struct<recent: struct<{_BLOCK}>,
               files: array<struct<name: string, filingFrom: string, filingTo: string>>>
"""


def read_histories(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One JSON object per line (or file), with only the fields used here."""
    return spark.read.schema(HISTORY_SCHEMA).json(paths)


def read_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Older-history pages: the array block at top level, with the page name."""
    pages = spark.read.schema(PAGE_SCHEMA).json(paths)
    return pages.select("*", F.col("_metadata.file_name").alias("name"))


def companies(histories: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return histories.select(
        F.col("cik").cast("bigint").alias("cik"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("sic", F.lit("")).alias("sic"),
        F.coalesce("sicDescription", F.lit("")).alias("sic_description"),
        F.coalesce("tickers", none).alias("tickers"),
        F.coalesce("exchanges", none).alias("exchanges"),
    )


def _filing_rows(blocks: DataFrame, block: str, page_no: Column) -> DataFrame:
    prefix = f"{block}." if block else ""

    def at(field: str) -> Column:
        value = F.get(F.col(f"_{field}"), F.col("pos"))
        return F.coalesce(value, F.lit(""))

    return (
        blocks.select(
            "cik",
            page_no.alias("page_no"),
            *[F.col(prefix + f).alias(f"_{f}") for f in _FIELDS[1:]],
            F.posexplode(prefix + "form").alias("pos", "form"),
        )
        .select(
            "cik",
            F.struct("page_no", "pos").alias("seq"),
            "form",
            at("filingDate").try_cast("date").alias("filed"),
            at("items").alias("items"),
            at("accessionNumber").alias("accession"),
            at("reportDate").try_cast("date").alias("report_date"),
            at("primaryDocument").alias("primary_document"),
        )
    )


def recent_filings(histories: DataFrame) -> DataFrame:
    """The filings of the main block; absent arrays read as empty strings."""
    keyed = histories.withColumn("cik", F.col("cik").cast("bigint"))
    return _filing_rows(keyed, "filings.recent", F.lit(-1))


def page_index(histories: DataFrame) -> DataFrame:
    """Which older pages belong to which company, in order, with the day each ends."""
    return histories.select(
        F.col("cik").cast("bigint").alias("cik"),
        F.posexplode("filings.files").alias("page_no", "page"),
    ).select(
        "cik", "page_no", F.col("page.name").alias("name"),
        F.coalesce(F.nullif("page.filingTo", F.lit("")), F.lit("9999-12-31"))
        .cast("date").alias("filing_to"),
    )


def older_filings(histories: DataFrame, pages: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """Filings on older pages, skipping pages that end before the company's ``since``.

    ``since`` has cik and since; the pages not needed are dropped before they are read
    into rows.
    """
    wanted = page_index(histories)
    if since is not None:
        wanted = (
            wanted.join(since.select("cik", "since"), "cik", "left")
            .where(F.col("since").isNull() | (F.col("filing_to") >= F.col("since")))
            .drop("since")
        )
    return _filing_rows(wanted.join(pages, "name"), "", F.col("page_no"))


def filing_history(
    histories: DataFrame, pages: DataFrame | None = None, since: DataFrame | None = None
) -> DataFrame:
    """All filings of every company. ``seq`` keeps source order for same-day filings."""
    rows = recent_filings(histories)
    if pages is not None:
        rows = rows.unionByName(older_filings(histories, pages, since))
    return rows
