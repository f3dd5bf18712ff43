"""Queries over the readers: tables are written out as raw text or JSON and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outturn.functions import forms
from outturn.functions.lineage import shared_path
from outturn.plans import adapters as A
from outturn.plans.shaping import plain
from outturn.sources import facts as facts_source
from outturn.sources import index, markup, submissions, tables

# Index lines per quarter: header, ruler, rows, and some lines that are no rows.
_LINES = f"""
select concat(cast(year(filed) as string), 'Q', cast(quarter(filed) as string)) as file, 100 as at,
  case when cik % 50 = 7 then concat('damaged row ', accession)
    else concat(form, '     Customer ', cast(cik as string), ' Inc.     ', cast(cik as string), '  ', cast(filed as string),
      '  edgar/data/', cast(cik as string), '/', accession, '.txt') end as line
from ({A.FILINGS}) f
union all
select distinct concat(cast(year(filed) as string), 'Q', cast(quarter(filed) as string)), n,
  case n when 0 then 'Form Type   Company Name   CIK   Date Filed   File Name'
    when 1 then '10-K   Header Example Co   77   1990-01-01   edgar/data/77/0.txt' when 2 then '-----------------' else '' end
from ({A.FILINGS}) f cross join (select 0 as n union all select 1 union all select 2 union all select 3) h
"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return A.adapt(spark, sf, _LINES).withColumn("block", F.lit(0))


def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    kept = index.kept_rows(index.scan_index(_lines(spark, sf)), forms.is_announcement(F.col("form")))
    return plain(kept)


def index_counts(spark: SparkSession, sf: str) -> DataFrame:
    return plain(index.scan_counts(index.scan_index(_lines(spark, sf))))


def index_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return plain(index.rejected_lines(index.scan_index(_lines(spark, sf))))


def missing_quarters(spark: SparkSession, sf: str) -> DataFrame:
    present = A.filings(spark, sf).select(F.year("filed").alias("year"), F.quarter("filed").alias("quarter"))
    kept = present.where((F.col("year") * 4 + F.col("quarter")) % 5 != 0)
    return plain(index.missing_quarters(index.quarters(spark, 1995, 2001), kept))


# One history per order: its lines as parallel arrays, some of them absent.
def _histories(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.adapt(
        spark, sf,
        f"select f.*, cast(split_part(accession, '-', 1) as bigint) as order_no from ({A.FILINGS}) f",
    )
    row = F.struct("accession", "form", "filed", "items")
    lists = rows.groupBy("order_no", "cik").agg(F.sort_array(F.collect_list(row)).alias("r"))
    recent = F.struct(
        F.col("r.form").alias("form"), F.col("r.filed").cast("array<string>").alias("filingDate"),
        F.when(F.col("order_no") % 4 != 0, F.col("r.items")).alias("items"),
        F.col("r.accession").alias("accessionNumber"),
    )
    payload = F.to_json(
        F.struct(
            F.col("cik").cast("string").alias("cik"), F.lit("Name").alias("name"), F.lit("3571").alias("sic"),
            F.struct(recent.alias("recent")).alias("filings"),
        )
    )
    parsed = F.from_json("payload", submissions.HISTORY_SCHEMA)
    return lists.select(payload.alias("payload")).select(parsed.alias("h")).select("h.*")


def filing_history(spark: SparkSession, sf: str) -> DataFrame:
    history = submissions.filing_history(_histories(spark, sf))
    return plain(history.select("cik", "accession", F.col("seq.pos").alias("pos"), "form", "filed", "items", "primary_document"))


def history_companies(spark: SparkSession, sf: str) -> DataFrame:
    return plain(submissions.companies(_histories(spark, sf)).distinct())


# Histories whose older filings lie on a page for each year; every third company has no day before which pages are skipped.
_PAGED = f"""
select f.*, cast(split_part(accession, '-', 1) as bigint) as order_no, year(filed) as y, (cik + year(filed)) % 2 = 0 as old,
  concat('o', split_part(accession, '-', 1), '-', cast(cik as string), '-', cast(year(filed) as string), '.json') as page from ({A.FILINGS}) f
"""


def paged_history(spark: SparkSession, sf: str) -> DataFrame:
    """The main block and the older pages of every history, those pages skipped that end before the company's day."""
    rows = A.adapt(spark, sf, _PAGED)
    row = F.struct("accession", "form", F.col("filed").cast("string").alias("filingDate"), "items")
    at_page = rows.where("old").groupBy("order_no", "cik", "page").agg(F.sort_array(F.collect_list(row)).alias("r"), F.max("filed").alias("last"))

    def block(r: str) -> list:
        fields = {"form": "form", "filingDate": "filingDate", "items": "items", "accessionNumber": "accession"}
        return [F.col(f"{r}.{of}").alias(name) for name, of in fields.items()]

    pages = at_page.select(F.to_json(F.struct(*block("r"))).alias("payload"), F.col("page").alias("name")).select(
        F.from_json("payload", submissions.PAGE_SCHEMA).alias("p"), "name"
    ).select("p.*", "name")
    files = at_page.groupBy("order_no", "cik").agg(
        F.sort_array(F.collect_list(F.struct(F.col("page").alias("name"), F.col("last").cast("string").alias("filingTo")))).alias("files")
    )
    recent = rows.where("not old").groupBy("order_no", "cik").agg(F.sort_array(F.collect_list(row)).alias("r"))
    payload = F.to_json(F.struct(F.col("cik").cast("string").alias("cik"), F.struct(F.struct(*block("r")).alias("recent"), "files").alias("filings")))
    histories = recent.join(files, ["order_no", "cik"], "full").select(F.from_json(payload, submissions.HISTORY_SCHEMA).alias("h")).select("h.*")
    companies = rows.where("cik % 3 <> 0").select("cik").distinct()
    since = companies.select("cik", F.expr("make_date(1993 + cast(cik % 5 as int), 7, 1)").alias("since"))
    found = submissions.filing_history(histories, pages, since)
    return plain(found.select("cik", "accession", (F.col("seq.page_no") >= 0).alias("older"), F.col("seq.pos").alias("pos"), "form", "filed", "items"))


_STAGE_ROWS = "cik bigint, filed date, accession string, form string, items string"


def stage_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Filings written as ordered JSON lines, read back, and put together with a table that was never written."""
    path = shared_path(spark, "rows")
    rows = A.filings(spark, sf)
    tables.write_rows(rows, path, ["filed", "cik"])
    read = tables.read_rows(spark, path, _STAGE_ROWS).withColumn("source", F.lit("written"))
    absent = tables.read_rows(spark, f"{path}-absent", _STAGE_ROWS).withColumn("source", F.lit("absent"))
    return plain(read.unionByName(absent))


def rewritten_quarters(spark: SparkSession, sf: str) -> DataFrame:
    """Filings by quarter, every quarter of the even years written again without its annual and quarterly reports."""
    path = shared_path(spark, "quarters")
    rows = A.filings(spark, sf).select("cik", "filed", "accession", "form")
    index.write_quarters(rows, path)
    index.write_quarters(rows.where("year(filed) % 2 = 0 and form not in ('10-K', '10-Q')"), path)
    return plain(spark.read.parquet(path).select("cik", "filed", "accession", "form", "year", "quarter"))


# One fact payload per order, under one of two namespaces.
_PAYLOADS = f"""
select cik, concat('{{"cik": ', cast(cik as string), ', "facts": {{"', case when seq % 5 = 0 then 'ifrs-full' else 'us-gaap' end, '": {{"', tag,
  '": {{"units": {{"USD": [{{"val": ', cast(value as string), ', "end": "', cast(period_end as string), '", "filed": "', cast(filed as string),
  '", "form": "', form, '"}}, {{"end": "1990-01-01", "filed": "1990-02-01", "form": "10-K"}}]}}}}}}}}}}') as payload from ({A.FACTS}) f
"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.from_json("payload", facts_source.FACTS_SCHEMA)
    payloads = A.adapt(spark, sf, _PAYLOADS).select(parsed.alias("p")).select("p.*")
    return facts_source.flat_facts(payloads)


def company_facts(spark: SparkSession, sf: str) -> DataFrame:
    return plain(_facts(spark, sf).drop("seq"))


def namespaced_facts(spark: SparkSession, sf: str) -> DataFrame:
    return plain(facts_source.first_namespace(_facts(spark, sf)).select("cik", "namespace", "tag", "value", "filed"))


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """One listing per supplier, with names of every kind and sizes that do not parse."""
    suppliers = A.table(spark, sf, "supplier")
    size = F.when(F.col("s_suppkey") % 3 == 0, "n/a").otherwise(F.col("s_suppkey").cast("string"))
    items = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit("text.gif").alias("type"), size.alias("size"))
            for name in ("a.htm", "B.HTML", "c.txt", "d.pdf", "e.htm.zip")
        ]
    )
    listings = suppliers.select(F.col("s_suppkey").alias("cik"), F.col("s_name").alias("accession"), items.alias("items"))
    return plain(markup.directory_listing(listings).drop("seq"))


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return plain(markup.to_text(A.table(spark, sf, "pages")).select("page_id", "body"))


QUERIES = {
    "index_rows": index_rows,
    "index_counts": index_counts,
    "index_rejects": index_rejects,
    "missing_quarters": missing_quarters,
    "filing_history": filing_history,
    "history_companies": history_companies,
    "paged_history": paged_history,
    "stage_rows": stage_rows,
    "rewritten_quarters": rewritten_quarters,
    "company_facts": company_facts,
    "namespaced_facts": namespaced_facts,
    "directory_listing": listing,
    "page_text": page_text,
}

_F = f"with f as materialized ({A.FILINGS})"
_QUARTER = "year(filed)::varchar || 'Q' || quarter(filed)::varchar"
_BLOCK = "p|div|br|tr|table|li|ul|ol|h1|h2|h3|h4|h5|h6|td|th|section|article"


def _page_sql() -> str:
    def drop(column: str, pattern: str, by: str = "''") -> str:
        return f"regexp_replace({column}, '{pattern}', {by}, 'gi')"

    text = "html"
    for tag in ("script", "style"):
        text = drop(text, f"(?s)<{tag}[^>]*>.*?</{tag}>")
    text = drop(text, "(?s)<!--.*?-->")
    text = drop(text, "<![^>]*>")
    text = drop(text, "(?s)<head>.*?</head>")
    text = drop(text, f"</?({_BLOCK})(\\s[^>]*)?>", "chr(10)")
    text = drop(text, "</?[a-z][^>]*>")
    for _ in range(2):  # markup and text are both decoded
        for name, char in (("&copy;", 169), ("&middot;", 183), ("&quot;", 34), ("&amp;", 38)):
            text = f"replace({text}, '{name}', chr({char}))"
    text = drop(text, "[ \\t]+", "' '")
    text = drop(text, "\\n\\s*\\n\\s*\\n+", "chr(10) || chr(10)")
    text = drop(text, " *\\n *", "chr(10)")
    return f"select page_id, trim({text}, chr(10) || ' ') as body from pages"


def oracles() -> dict[str, str]:
    facts = f"f as ({A.FACTS})"
    return {
        "index_rows": _F + f""" select {_QUARTER} as file, form, 'Customer ' || cik || ' Inc.' as company, cik, filed::varchar as filed,
            'edgar/data/' || cik || '/' || accession || '.txt' as path, accession from f
            where cik % 50 <> 7 and split_part(form, '/', 1) in ('DEFM14A','PREM14A','DEFM14C','PREM14C','SC 14D9','SC 13E3')""",
        "index_counts": _F + f" select {_QUARTER} as file, count(*) as seen, count(*) filter (cik % 50 = 7) as unparsed from f group by 1",
        "index_rejects": _F + f" select {_QUARTER} as file, 'damaged row ' || accession as line from f where cik % 50 = 7",
        "missing_quarters": _F + """ select y::bigint as year, q::bigint as quarter from range(1995, 2002) t(y), range(1, 5) u(q)
            where (y, q) not in (select (year(filed), quarter(filed)) from f where (year(filed) * 4 + quarter(filed)) % 5 <> 0)""",
        "filing_history": _F + """, o as (select *, split_part(accession, '-', 1)::bigint as order_no from f)
            select cik, accession, row_number() over (partition by order_no order by accession) - 1 as pos, form, filed::varchar as filed,
             case when order_no % 4 <> 0 then items else '' end as items, '' as primary_document from o""",
        "history_companies": _F + " select distinct cik, 'Name' as name, '3571' as sic, '' as sic_description, '' as tickers, '' as exchanges from f",
        "paged_history": f"""with f as materialized ({_PAGED}), p as (select *, max(filed) over (partition by order_no, cik, y) as last from f)
            select cik, accession, old as older, row_number() over (partition by order_no, cik, old, case when old then y end order by accession) - 1 as pos,
             form, filed::varchar as filed, items from p
            where not old or cik % 3 = 0 or last >= make_date(1993 + (cik % 5)::int, 7, 1)""",
        "stage_rows": _F + " select cik, filed::varchar as filed, accession, form, items, 'written' as source from f",
        "rewritten_quarters": _F + """ select cik, filed::varchar as filed, accession, form, year(filed) as year, quarter(filed) as quarter from f
            where year(filed) % 2 = 1 or form not in ('10-K', '10-Q')
             or (year(filed), quarter(filed)) not in (select (year(filed), quarter(filed)) from f where form not in ('10-K', '10-Q'))""",
        "company_facts": f"""with {facts} select cik, case when seq % 5 = 0 then 'ifrs-full' else 'us-gaap' end as namespace, tag, 'USD' as unit,
            round(value, 6) as value, period_end::varchar as period_end, filed::varchar as filed, form, year(period_end) as fiscal_year from f""",
        "namespaced_facts": f"""with {facts}, s as (select *, case when seq % 5 = 0 then 2 else 1 end as k from f)
            select cik, case k when 2 then 'ifrs-full' else 'us-gaap' end as namespace, tag, round(value, 6) as value, filed::varchar as filed
            from s qualify k = min(k) over (partition by cik, tag)""",
        "directory_listing": """select s_suppkey as cik, s_name as accession, name, 'text.gif' as kind,
            case when s_suppkey % 3 = 0 then 0 else s_suppkey end as size from supplier, (values ('a.htm'), ('B.HTML'), ('c.txt')) v(name)""",
        "page_text": _page_sql(),
    }
