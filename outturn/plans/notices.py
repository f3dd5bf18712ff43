"""Queries over notice texts: sections, verdicts, terms, passages, document choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outturn.functions import patterns as P
from outturn.functions import vocab
from outturn.functions.lineage import cut
from outturn.operators import search, summary
from outturn.operators.breaks import classify, confirm_breaks
from outturn.operators.documents import announcement_texts, press_releases, primary_documents
from outturn.operators.passages import locate_passages
from outturn.operators.resume import resume, since_day
from outturn.operators.sections import item_sections, section, section_body
from outturn.operators.terms import (
    deterministic, extract_for_episodes, extract_terms, reconcile, structured,
)
from outturn.operators.timeline import announcement_report
from outturn.plans import adapters as A
from outturn.plans.shaping import plain
from outturn.sources.tables import slim

# long texts: a document around two anchors, far apart in most rows
LONG_TEXTS = """
select doc_id, concat(text, ' The TERMINATION fee applies. ', text, ' Equity  value as stated. ', text) as body from documents
"""
# a directory listing per filing, with the document types and names a filing may have
REFS = f"""
select accession, form, items, case when k % 4 = 0 then concat('main', cast(k as string), '.htm') else '' end as primary_document,
  case n when 0 then concat('main', cast(k as string), '.htm') when 1 then concat('dex99-1_', cast(k as string), '.htm')
         when 2 then concat('form8-k', cast(k as string), '.html') when 3 then concat('plain', cast(k as string), '.txt')
         else 'R2.htm' end as name,
  case when n = 3 and k % 5 = 1 then form else 'text.gif' end as kind,
  100 + (k * 7 + n * 31) % 50 as size, n as seq
from (select f.*, length(accession) + cik % 97 as k from ({A.FILINGS}) f where form like '8-K%') t
  cross join (select 0 as n union all select 1 union all select 2 union all select 3 union all select 4) s
where (k + n) % 3 <> 0
"""


def notices(spark: SparkSession, sf: str) -> DataFrame:
    return A.adapt(spark, sf, A.NOTICES)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return notices(spark, sf).select(
        F.col("doc_id").alias("accession"), F.lit("notice.txt").alias("name"), "body"
    )


def verdict_rows(spark: SparkSession, sf: str, universe: DataFrame) -> DataFrame:
    candidates = universe.where("label = 'terminated'")
    return confirm_breaks(candidates, _documents(spark, sf))


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    from outturn.plans.deals import universe

    return verdict_rows(spark, sf, universe(spark, sf))


def terms_rows(spark: SparkSession, sf: str, universe: DataFrame, timeline: DataFrame) -> DataFrame:
    """Terms per resolved episode, from the report nearest its announcement."""
    wanted = search.select_episodes(universe, vocab.RESOLVED_LABELS)
    reports = announcement_report(timeline).select("cik", "announced", "accession")
    texts = _documents(spark, sf).select(
        "accession", F.col("name").alias("document"), F.lit(None).cast("string").alias("press_release"), "body"
    )
    return extract_for_episodes(wanted.join(reports, ["cik", "announced"]), texts)


def sections(spark: SparkSession, sf: str) -> DataFrame:
    split = item_sections(notices(spark, sf))
    return plain(split.select("doc_id", F.inline(F.map_entries("sections"))).toDF("doc_id", "code", "section"))


def section_bodies(spark: SparkSession, sf: str) -> DataFrame:
    split = item_sections(notices(spark, sf))
    return plain(split.select("doc_id", section_body(section(vocab.ITEM_TERMINATION)).alias("text")))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    split = item_sections(notices(spark, sf)).withColumn("section", section(vocab.ITEM_TERMINATION))
    return plain(
        classify(split).select("doc_id", "status", "reasons", "break_fee_usd", "excerpt", "evidence")
    )


def confirmed_breaks(spark: SparkSession, sf: str) -> DataFrame:
    found = search.with_status(_verdicts(spark, sf), vocab.CONFIRMED)
    return plain(slim(found, vocab.BREAK_FIELDS))


def verdict_stats(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.verdict_stats(_verdicts(spark, sf)))


#: A run that looks at no candidate before this day.
RUN_SINCE = "1995-01-01"


def verdict_run(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a run after one that worked on two thirds of the candidates and failed to fetch half of those."""
    from outturn.plans.deals import universe

    wanted = cut(universe(spark, sf).where("label = 'terminated'"))
    keys, failed = ["cik", "announced"], F.col("cik") % 3 == 2
    earlier = cut(confirm_breaks(wanted.where("cik % 3 <> 0"), _documents(spark, sf)))
    earlier = earlier.withColumns(
        {"status": F.when(failed, vocab.FETCH_FAILED).otherwise(F.col("status")), "reasons": F.when(~failed, F.col("reasons"))}
    )
    results = resume(since_day(wanted, RUN_SINCE), earlier, keys, lambda rows: confirm_breaks(rows, _documents(spark, sf)))
    return plain(summary.run_stats(cut(results), wanted, earlier, keys, RUN_SINCE))


def break_rate_bounds(spark: SparkSession, sf: str) -> DataFrame:
    from outturn.plans.deals import universe

    built = cut(universe(spark, sf))
    return plain(summary.break_rate_bounds(built, verdict_rows(spark, sf, built)))


def dataset_counts(spark: SparkSession, sf: str) -> DataFrame:
    from outturn.plans.deals import universe

    built = cut(universe(spark, sf))
    return plain(summary.dataset_counts(built, verdict_rows(spark, sf, built)))


_TERM_COLUMNS = [
    "cash_per_share", "exchange_ratio", "stated_premium_pct", "unaffected_price", "premium_baseline",
    "termination_fee_usd", "parent_termination_fee_usd", "equity_value_usd", "outside_date",
    "financing_condition", "go_shop", "hsr", "cfius", "tender_offer", "consideration", "break_fee_pct", "chars",
]


def terms(spark: SparkSession, sf: str) -> DataFrame:
    return plain(extract_terms(notices(spark, sf)).select("doc_id", *_TERM_COLUMNS))


def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    checked = reconcile(extract_terms(notices(spark, sf)))
    return plain(checked.select("doc_id", "reconciliation.*"))


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Every notice through both extractors; every third response is not JSON."""
    texts = notices(spark, sf).withColumns(
        {
            "status": F.lit(vocab.EXTRACTED),
            "press_release": F.lit(None).cast("string"),
            "response": F.when(
                F.col("premium") % 3 != 0,
                F.to_json(
                    F.struct(
                        (F.col("unaffected") * (100 + F.col("premium")) / 100).alias("cash_per_share"),
                        F.col("premium").cast("double").alias("stated_premium_pct"),
                        F.lit("close").alias("premium_baseline"),
                        F.col("unaffected").cast("double").alias("unaffected_price"),
                    )
                ),
            ).otherwise("no answer"),
        }
    )
    columns = ["extractor", "status", "press_release", *vocab.COVERAGE_FIELDS, "consideration", "reconciliation"]
    return (
        reconcile(deterministic(texts)).select(*columns)
        .unionByName(reconcile(structured(texts)).select(*columns))
    )


def extraction_stats(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.extraction_stats(_extracted(spark, sf), ["extractor"]))


def premium_errors(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.premium_errors(_extracted(spark, sf), ["extractor"]))


def episode_terms(spark: SparkSession, sf: str) -> DataFrame:
    from outturn.plans.deals import timeline, universe_of

    events = timeline(spark, sf)
    return plain(
        terms_rows(spark, sf, universe_of(spark, sf, events), events).select(
            "cik", "announced", "label", "status", "accession", "document", "source", "extractor",
            "cash_per_share", "equity_value_usd", "break_fee_pct",
            F.col("reconciliation.status").alias("reconciliation"),
        )
    )


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return plain(locate_passages(A.adapt(spark, sf, LONG_TEXTS)).select("doc_id", "passages"))


def primary_choice(spark: SparkSession, sf: str) -> DataFrame:
    refs = A.adapt(spark, sf, REFS)
    filings = refs.select("accession", "form", "primary_document").distinct()
    return plain(primary_documents(refs.select("accession", "name", "kind", "size", "seq"), filings))


def announcement_text_choice(spark: SparkSession, sf: str) -> DataFrame:
    refs = cut(A.adapt(spark, sf, REFS))
    filings = refs.select("accession", "form", "primary_document").distinct()
    listing = refs.select("accession", "name", "kind", "size", "seq")
    bodies = listing.select("accession", "name", F.concat_ws(" ", F.lit("text of"), "name", F.lit("in"), "accession").alias("body"))
    return plain(
        announcement_texts(primary_documents(listing, filings), press_releases(listing), bodies)
    )


QUERIES = {
    "item_sections": sections,
    "section_bodies": section_bodies,
    "verdicts": verdicts,
    "confirmed_breaks": confirmed_breaks,
    "verdict_stats": verdict_stats,
    "verdict_run": verdict_run,
    "break_rate_bounds": break_rate_bounds,
    "dataset_counts": dataset_counts,
    "terms": terms,
    "reconciliation": reconciliation,
    "extraction_stats": extraction_stats,
    "premium_errors": premium_errors,
    "episode_terms": episode_terms,
    "passages": passages,
    "primary_documents": primary_choice,
    "announcement_texts": announcement_text_choice,
}

# -- the same answers in SQL: the notices are templated, so plain string tests suffice --

_SECOND = "'Item 1.02. Termination of a Material Definitive Agreement.'"
_PLAIN = f"""select *, trim(substr(body, 1, strpos(body, {_SECOND}) - 1), chr(10) || ' ') as s101,
  trim(substr(body, strpos(body, {_SECOND})), chr(10) || ' ') as s102 from n"""
_TEXT = f"trim(substr(body, strpos(body, {_SECOND}) + length({_SECOND})), chr(10) || ' ')"
_READ = f"""select *, {_TEXT} as text,
  case when contains(body, 'mutual consent') then 'confirmed' when contains(body, 'revolving credit facility') then 'unrelated' else 'unclear' end as status,
  case when contains(body, 'mutual consent') then 'mutual' when contains(body, 'antitrust') then 'regulatory' else '' end as reasons,
  case when contains(body, 'mutual consent') then 'merger:merger agreement' when contains(body, 'revolving credit facility') then 'other:revolving credit'
    when contains(body, 'antitrust') then 'merger:merger agreement|other:credit agreement' else '' end as evidence from n"""
_TERMS = """select *, contains(body, '30-day average') as averaged,
  regexp_extract(body, '\\$(\\d+\\.\\d\\d) per share in cash', 1)::double as cash,
  regexp_extract(body, 'approximately (\\d+)%', 1)::double as stated,
  try_cast(regexp_extract(body, 'closing price of \\$(\\d+\\.00)', 1) as double) as price,
  regexp_extract(body, 'termination fee of \\$(\\d+) million', 1)::double * 1e6 as fee,
  regexp_extract(body, 'equity value of \\$(\\d+) million', 1)::double * 1e6 as equity from n"""
_CHECK = """select *, 100 * (cash / price - 1) as implied, case when price is null then 'insufficient'
    when averaged then 'insufficient' when abs(100 * (cash / price - 1) - stated) <= 1.5 then 'reconciled' else 'mismatch' end as check from t"""
N = f"with n as materialized ({A.NOTICES})"
_ALL_TERMS = f"t as materialized ({_TERMS}), c as materialized ({_CHECK})"

# appended to the universe CTEs: verdicts and terms per episode
FRAME_CTES = f""",
n as materialized ({A.NOTICES}), r as materialized ({_READ}), {_ALL_TERMS},
verdict as materialized (select u.*, r.status, r.reasons, r.evidence as proof, r.text from uni u
  join r on r.doc_id = u.resolved_accession where u.label = 'terminated'),
cand as (select e.cik, e.announced, min((abs(i.filed - e.announced), i.filed, i.accession)) as best
  from ep e join item i on i.cik = e.cik and i.form like '8-K%' and i.tokens like '%,1.01,%'
   and i.filed between e.announced - 200 and e.last_announcement + 120 group by all),
term as materialized (select u.cik, u.announced, u.label, c.doc_id, c.cash as cash_per_share, c.stated as stated_premium_pct,
   c.fee as termination_fee_usd, c.equity as equity_value_usd, round(100 * c.fee / c.equity, 3) as break_fee_pct, c.check
  from uni u join cand on cand.cik = u.cik and cand.announced = u.announced join c on c.doc_id = cand.best[3]
  where u.label in ('completed', 'completed_shell', 'terminated'))
"""


def _share(condition: str) -> str:
    return f"round(count(*) filter ({condition})::double / count(*), 6)"


def _extraction_sql() -> str:
    answered = "premium % 3 <> 0"
    both = f"""x as (select 'deterministic' as extractor, cash, null::double as ratio, stated, price, fee, equity, "check",
        case when "check" <> 'insufficient' then round(abs(implied - stated), 2) end as err from c
      union all select 'model', case when {answered} then unaffected * (100 + premium) / 100 end, null,
        case when {answered} then premium end, case when {answered} then unaffected end, null, null,
        case when {answered} then 'reconciled' else 'insufficient' end,
        case when {answered} then round(abs(100 * ((unaffected * (100 + premium) / 100) / unaffected::double - 1) - premium), 2) end from c)"""
    return f"{N}, {_ALL_TERMS}, {both}"


def oracles() -> dict[str, str]:
    from outturn.plans.deals import UNIVERSE

    episode = UNIVERSE + FRAME_CTES
    coverage = {
        "cash_per_share": "cash is not null", "exchange_ratio": "false", "stated_premium_pct": "stated is not null",
        "unaffected_price": "price is not null", "termination_fee_usd": "fee is not null",
        "parent_termination_fee_usd": "false", "equity_value_usd": "equity is not null",
        "outside_date": "false", "financing_condition": "false",
    }
    anchors = """a as (select doc_id, regexp_replace(body, '[ \\t]+', ' ', 'g') as flat from (""" + LONG_TEXTS + """)),
      s as (select *, strpos(flat, ' The TERMINATION fee applies. ') + 4 as s1 from a),
      b as (select *, s1 + 15 as e1, length(flat) - strpos(reverse(flat), reverse(' Equity value as stated. ')) - 23 as s2 from s),
      w as (select *, s2 + 12 as e2, length(flat) as len from b)"""
    return {
        "item_sections": f"{N}, p as ({_PLAIN}) select doc_id, '1.01' as code, s101 as section from p union all select doc_id, '1.02', s102 from p",
        "section_bodies": f"{N} select doc_id, {_TEXT} as text from n",
        "verdicts": f"{N}, r as ({_READ}) select doc_id, status, reasons, null::double as break_fee_usd, text as excerpt, evidence from r",
        "confirmed_breaks": episode + """select cik, company, announced::varchar as announced, resolved_on::varchar as resolved_on,
            days_to_resolution, status, reasons, null::double as break_fee_usd, 'notice.txt' as document, text as excerpt from verdict where status = 'confirmed'""",
        "verdict_stats": episode + """select 'status' as section, status as key, count(*) as n from verdict group by 2
            union all select 'reason', reasons, count(*) from verdict where reasons <> '' group by 2
            union all select 'total', 'candidates', count(*) from verdict
            union all select 'total', 'break_fee_extracted', 0 union all select 'total', 'retry_needed', 0""",
        "verdict_run": episode + f""", late as (select *, announced >= date '{RUN_SINCE}' as late from verdict)
            select 'status' as section, status as key, count(*) as n from late where late group by 2
            union all select 'reason', reasons, count(*) from late where late and reasons <> '' group by 2
            union all select 'total', 'candidates', count(*) from late where late
            union all select 'total', 'break_fee_extracted', 0 union all select 'total', 'retry_needed', 0
            union all select 'excluded_before', '{RUN_SINCE}', count(*) from late where not late
            union all select 'run', 'excluded_count', count(*) from late where not late
            union all select 'run', 'reused_from_previous_run', count(*) from late where late and cik % 3 = 1
            union all select 'run', 'outstanding', count(*) from late where late and cik % 3 <> 1""",
        "break_rate_bounds": episode + """, k as (select (select count(*) from uni where label in ('completed','completed_shell','terminated')) as resolved,
             (select count(*) from verdict where status = 'confirmed') as confirmed, (select count(*) from verdict where status = 'unclear') as undecided)
            select *, round(confirmed::double / resolved, 6) as lower, round((confirmed + undecided)::double / resolved, 6) as upper from k""",
        "dataset_counts": episode + "select (select count(*) from uni) as episodes, (select count(*) from verdict) as breaks_read",
        "terms": f"""{N}, {_ALL_TERMS} select doc_id, cash as cash_per_share, null::double as exchange_ratio, stated as stated_premium_pct,
            price as unaffected_price, case when averaged then 'average' else 'close' end as premium_baseline, fee as termination_fee_usd,
            null::double as parent_termination_fee_usd, equity as equity_value_usd, null::varchar as outside_date,
            null::boolean as financing_condition, false as go_shop, false as hsr, false as cfius, false as tender_offer,
            'cash' as consideration, round(100 * fee / equity, 3) as break_fee_pct, length(body) as chars from c""",
        "reconciliation": f"""{N}, {_ALL_TERMS} select doc_id, "check" as status,
            case when "check" <> 'insufficient' then round(implied, 2) end as implied_premium_pct,
            case when "check" <> 'insufficient' then stated end as stated_premium_pct,
            case when "check" <> 'insufficient' then round(abs(implied - stated), 2) end as absolute_error_pp,
            case when price is null then 'no cash price or no unaffected price found'
             when averaged then 'premium quoted against an average, not the unaffected close' when "check" = 'reconciled' then ''
             else 'extracted figures do not satisfy the document''s own arithmetic' end as note from c""",
        "extraction_stats": _extraction_sql() + f""" select extractor, count(*) as episodes, count(*) as extracted,
            {', '.join(f"{_share(c)} as coverage_{f}" for f, c in coverage.items())},
            count(*) filter (cash is not null) as consideration_cash, 0::bigint as consideration_stock, 0::bigint as consideration_cash_and_stock,
            count(*) filter (cash is null) as consideration_unknown, 0::bigint as with_press_release,
            count(*) filter ("check" = 'reconciled') as reconciled, count(*) filter ("check" = 'mismatch') as mismatch,
            count(*) filter ("check" = 'insufficient') as insufficient, 0::bigint as retry_needed,
            count(*) filter ("check" <> 'insufficient') as checkable,
            round(count(*) filter ("check" = 'reconciled')::double / nullif(count(*) filter ("check" <> 'insufficient'), 0), 6) as reconciled_share_of_checkable,
            {_share('"check" = ' + "'reconciled'")} as reconciled_share_of_extracted from x group by extractor""",
        "premium_errors": _extraction_sql() + """, v as (select extractor, list(err order by err) filter (err is not null) as e from x group by extractor)
            select extractor, len(e) as n, e[len(e) // 2 + 1] as median, e[len(e) * 9 // 10 + 1] as p90 from v""",
        "episode_terms": episode + """select u.cik, u.announced::varchar as announced, u.label,
            case when t.doc_id is null then 'no_announcement_8k' else 'extracted' end as status, t.doc_id as accession,
            case when t.doc_id is not null then 'notice.txt' end as document, '8k' as source, 'deterministic' as extractor,
            t.cash_per_share, t.equity_value_usd, t.break_fee_pct,
            coalesce(t."check", 'insufficient') as reconciliation
            from uni u left join term t on t.cik = u.cik and t.announced = u.announced where u.label in ('completed', 'completed_shell', 'terminated')""",
        "passages": f"""with {anchors} select doc_id, case when s2 - 350 <= e1 + 350
            then substr(flat, greatest(s1 - 350, 0) + 1, least(e2 + 350, len) - greatest(s1 - 350, 0))
            else substr(flat, greatest(s1 - 350, 0) + 1, e1 + 350 - greatest(s1 - 350, 0)) || chr(10) || '[...]' || chr(10)
              || substr(flat, s2 - 350 + 1, least(e2 + 350, len) - (s2 - 350)) end as passages from w""",
        "primary_documents": f"""with r as ({REFS}), g as (select *, case when primary_document <> '' and name = primary_document then 4
              when kind = form then 3 when (name like '%.htm' or name like '%.html') and lower(name) not like 'r%' then 2
              when name like '%.txt' then 1 end as tier from r)
            select accession, name, size::bigint as size from (select *, row_number() over (partition by accession order by tier desc,
              case when tier = 2 and name like 'dex%' then 1 else 0 end, case when tier = 2 and name not like 'form8-k%' then 1 else 0 end,
              case when tier = 4 then 0 else -size end, seq) as k from g where tier is not null) where k = 1""",
        "announcement_texts": f"""with r as materialized ({REFS}), g as (select *, case when primary_document <> '' and name = primary_document then 4
              when kind = form then 3 when (name like '%.htm' or name like '%.html') and lower(name) not like 'r%' then 2
              when name like '%.txt' then 1 end as tier from r),
            m as (select accession, name as document from (select *, row_number() over (partition by accession order by tier desc,
              case when tier = 2 and name like 'dex%' then 1 else 0 end, case when tier = 2 and name not like 'form8-k%' then 1 else 0 end,
              case when tier = 4 then 0 else -size end, seq) as k from g where tier is not null) where k = 1),
            x as (select accession, name as press_release from r where name like 'dex99%')
            select accession, document, press_release, concat_ws(chr(10) || chr(10), 'text of ' || document || ' in ' || accession,
              'text of ' || press_release || ' in ' || accession) as body from m left join x using (accession)""",
    }
