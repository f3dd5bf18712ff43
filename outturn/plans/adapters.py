"""Views that give the provided tables the shape of filings data.

Each adapter is one SELECT that Spark SQL and DuckDB read the same way, so a query
and its check start from identical rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

FILINGS = """
with k as (select o_custkey cik, cast(l_shipdate as date) filed,
  concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string),
    cast(l_suppkey as string), cast(cast(l_shipdate as date) as string)) accession,
  (l_orderkey*31 + l_linenumber*17 + l_partkey*7) % 100 k
  from lineitem join orders on l_orderkey=o_orderkey)
select cik, filed, accession, case when k<3 then 'DEFM14A' when k<4 then 'PREM14A' when k<5 then 'SC 14D9/A'
 when k<6 then 'SC 13E3' when k<7 then '25-NSE' when k<8 then '15-12B' when k<40 then '10-Q'
 when k<50 then '10-K' when k<85 then '8-K' else '4' end form,
 case when k between 50 and 84 then case when k<54 then '1.01,9.01' when k<58 then '1.02, 9.01'
  when k<60 then '2.01,9.01' when k<61 then '5.01' when k<62 then '5.06,9.01' else '7.01,9.01' end
  else '' end items from k
"""

COMPANIES = """
select c_custkey as cik, case when c_custkey % 50 = 0 then '' else c_name end as name,
  case when c_custkey % 17 = 0 then '6770' when c_custkey % 23 = 0 then ''
       else cast(1000 + c_nationkey * 37 as string) end as sic,
  case when c_custkey % 23 = 0 then '' else c_mktsegment end as sic_description,
  case when c_custkey % 3 = 0 then concat('T', cast(c_custkey as string)) else '' end as ticker
from customer where c_custkey % 101 <> 0
"""

NOTICES = """
select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string),
    cast(l_suppkey as string), cast(cast(l_shipdate as date) as string)) as doc_id, b as unaffected, p as premium,
  concat('Item 1.01. Entry into a Material Definitive Agreement.', chr(10), chr(10),
   'On 3 March 2015 each share converts into $', cast(cast(floor(c/100) as bigint) as string), '.', lpad(cast(c%100 as string),2,'0'), ' per share in cash. ',
   'That is a premium of approximately ', cast(case when l_orderkey%7=0 then p+9 else p end as string), '% to the ',
   case when l_orderkey%11=0 then '30-day average of the ' else '' end,
   case when l_orderkey%13=0 then 'recent price' else concat('closing price of $', cast(b as string), '.00') end,
   ' on 2 March 2015. The Company will pay a termination fee of $', cast(10+l_suppkey as string), ' million. ',
   'The equity value of $', cast(1000+l_partkey as string), ' million applies.', chr(10), chr(10),
   'Item 1.02. Termination of a Material Definitive Agreement.', chr(10), chr(10),
   case l_linenumber%4 when 0 then 'On 3 March 2015 the merger agreement was terminated by mutual consent.'
     when 1 then 'On 3 March 2015 the Company terminated its revolving credit facility.'
     when 2 then 'On 3 March 2015 the parties described certain arrangements.'
     else 'On 3 March 2015 the credit agreement was terminated after the merger agreement was terminated following antitrust objections.' end, chr(10)) as body
from (select *, 10+l_orderkey%90 as b, 10+l_partkey%50 as p, (10+l_orderkey%90)*(110+l_partkey%50) as c from lineitem) t
"""

FACTS = """
select o_custkey as cik, case o_orderpriority when '1-URGENT' then 'Revenues' when '2-HIGH' then 'SalesRevenueNet'
  when '3-MEDIUM' then 'NetIncomeLoss' else 'ProfitLoss' end as tag,
  case when o_orderkey%3=0 then '10-Q' else '10-K' end as form, cast(date_trunc('year', o_orderdate) as date) as period_end,
  cast(o_orderdate as date) as filed, o_totalprice as value, o_orderkey as seq from orders
"""

SCENARIOS = """
select p_partkey as scenario_id, 8e8 as a_net_income, 4e8 as a_diluted_shares, 50.0e0 as a_share_price, 1e9 as a_cash, 2e9 as a_debt, 1.8e9 as a_ebitda, 5e9 as a_book_equity,
  1e8+p_size*1e6 as t_net_income, 1e8 as t_diluted_shares, p_retailprice/50 as t_share_price, 1.5e8 as t_cash, 6e8 as t_debt, 3e8 as t_ebitda, 9e8 as t_book_equity,
  p_retailprice/50*(1.1e0+(p_partkey%40)/100.0e0) as offer_per_share, (p_partkey%11)/10.0e0 as cash_consideration_pct, (p_partkey%5)/4.0e0 as cash_from_balance_sheet_pct,
  0.03e0+(p_partkey%7)/100.0e0 as new_debt_rate, 0.02e0 as forgone_cash_yield, 0.25e0 as tax_rate, (p_partkey%30)*1e7 as pretax_synergies, 0.4e0+(p_partkey%4)/5.0e0 as synergy_phasing,
  5e7 as transaction_fees, p_partkey%2=0 as refinance_target_debt, (p_partkey%10)*1e8 as intangible_step_up, 10.0e0 as intangible_life_years from part
"""

SCORES = """
select l.doc_id, l.quality as truth, least(0.99e0, d.n_chars/20000.0e0) as p
from labels l join documents d on d.doc_id=l.doc_id
"""

# index rows as an index file would list them: name and path derived from the filing
INDEX_ROWS = f"""
select form, concat('Customer ', cast(cik as string)) as company, cik, filed,
  concat('edgar/data/', cast(cik as string), '/', accession, '.txt') as path, accession
from ({FILINGS}) f
"""

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


#: Tables whose rows are built into texts or modelled, and the keys by which they are dealt before that.
DEALT = {
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey"], "part": ["p_partkey"], "documents": ["doc_id"], "pages": ["page_id"],
}
#: A view that joins a dealt table: dealt by the key of the join, its rows are shuffled and sorted once.
JOINED = {"lineitem join orders on l_orderkey=o_orderkey": ("lineitem", ["l_orderkey"])}
#: Rows of a dealt table in a task. More rows make more tasks, not larger ones.
TASK_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """A provided table; one whose files may be a single row group is dealt to all tasks of the session.

    Only the columns that a query reads are dealt: for notices and filings a few integers a row, before any text is built.
    A table of many rows raises the number of shuffle partitions of the session, which the steps behind it go by; small ones are
    put together again by Spark.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if name not in DEALT:
        return df
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = -(-df.count() // TASK_ROWS)
    if needed > partitions:
        partitions = needed
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return df.repartition(max(spark.sparkContext.defaultParallelism, partitions), *(keys or DEALT[name]))


def adapt(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The adapter over the tables of ``sf_dir``, through session-local views."""
    keys = dict(by for join, by in JOINED.items() if join in sql)
    for name in TABLES:
        if name in sql:
            table(spark, sf_dir, name, keys.get(name)).createOrReplaceTempView(name)
    return spark.sql(sql)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt(spark, sf_dir, FILINGS)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    has = F.col("ticker") != ""
    return adapt(spark, sf_dir, COMPANIES).select(
        "cik", "name", "sic", "sic_description",
        F.when(has, F.array("ticker")).otherwise(F.array().cast("array<string>")).alias("tickers"),
        F.when(has, F.array(F.lit("NYSE"))).otherwise(F.array().cast("array<string>")).alias("exchanges"),
    )
