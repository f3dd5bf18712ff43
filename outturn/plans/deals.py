"""Queries over the filings view: episodes, outcomes, the universe and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outturn.functions import forms, vocab
from outturn.functions.lineage import cut
from outturn.operators import search, summary
from outturn.operators.features import build_frame, check_no_leakage, frame_counts, time_split
from outturn.operators.outcomes import label_outcomes
from outturn.operators.pointintime import latest_annual, snapshot
from outturn.operators.resume import resume, split_done
from outturn.operators.survival import curve_report, survival_table
from outturn.operators.timeline import (
    announcement_days, announcement_report, episode_arrays, episode_filings, episode_timeline, episodes, timeline_of,
)
from outturn.operators.universe import attach_announcements, attach_company, build_universe, coverage, history_window
from outturn.plans import adapters as A
from outturn.plans.shaping import plain
from outturn.sources.tables import slim

DATA_CUT = "2001-12-31"
FRAME_START, FRAME_END, SPLIT_YEAR = "1993-01-01", "1999-01-01", 1997


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    return A.filings(spark, sf)


def _announcements(spark: SparkSession, sf: str) -> DataFrame:
    return _filings(spark, sf).where(forms.is_announcement(F.col("form")))


def universe(spark: SparkSession, sf: str) -> DataFrame:
    return build_universe(_filings(spark, sf), A.companies(spark, sf), DATA_CUT)


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """The episode timeline, written once for queries that read it several times."""
    return cut(episode_timeline(_filings(spark, sf)))


def universe_of(spark: SparkSession, sf: str, events: DataFrame) -> DataFrame:
    return attach_company(label_outcomes(events, DATA_CUT), A.companies(spark, sf))


def form_predicates(spark: SparkSession, sf: str) -> DataFrame:
    f, sic = F.col("form"), F.col("sic")
    rows = _filings(spark, sf).join(A.companies(spark, sf).select("cik", "sic"), "cik", "left")
    return plain(
        rows.select(
            "accession", "form",
            forms.is_announcement(f).alias("announcement"),
            forms.is_deregistration(f).alias("deregistration"),
            forms.is_periodic(f).alias("periodic"),
            forms.is_current_report(f).alias("current_report"),
            *[forms.has_item(F.col("items"), c).alias(f"item_{c.replace('.', '')}")
              for c in ("1.01", "1.02", "2.01", "5.01", "5.06")],
            forms.is_shell_sic(sic).alias("shell"),
            forms.sector(sic).alias("sector"),
        )
    )


def episode_table(spark: SparkSession, sf: str) -> DataFrame:
    return plain(episodes(episode_timeline(_filings(spark, sf))))


def short_gap_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return plain(episodes(episode_timeline(_filings(spark, sf), gap_days=200)))


def episode_members(spark: SparkSession, sf: str) -> DataFrame:
    days = announcement_days(_filings(spark, sf))
    return plain(
        episode_filings(_announcements(spark, sf), days).select("cik", "episode_no", "filed", "form", "accession")
    )


def episode_array_rows(spark: SparkSession, sf: str) -> DataFrame:
    days = announcement_days(_filings(spark, sf))
    return plain(episode_arrays(_announcements(spark, sf), days))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    labelled = label_outcomes(episode_timeline(_filings(spark, sf)), DATA_CUT)
    return plain(labelled.drop("resolved_document"))


def universe_rows(spark: SparkSession, sf: str) -> DataFrame:
    return plain(
        universe(spark, sf).select(
            "cik", "announced", "company", "sic", "sic_description", "shell", "tickers", "exchanges",
            "label", "days_to_resolution", "evidence",
        )
    )


def universe_from_index(spark: SparkSession, sf: str) -> DataFrame:
    """Announcements from an index scan, history from the filings, names from the index."""
    index = A.adapt(spark, sf, A.INDEX_ROWS).where(forms.is_announcement(F.col("form")))
    built = build_universe(_filings(spark, sf), A.companies(spark, sf), DATA_CUT, announcements=index)
    return plain(built.select("cik", "announced", "company", "label", "resolved_on", "n_announcements"))


def universe_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return plain(coverage(_announcements(spark, sf), A.companies(spark, sf), universe(spark, sf)))


def history_since(spark: SparkSession, sf: str) -> DataFrame:
    return plain(history_window(_announcements(spark, sf)))


def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.label_counts(universe(spark, sf)))


def labels_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.labels_by_year(universe(spark, sf)))


def outcome_rates(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.outcome_rates(universe(spark, sf)))


def sign_to_close(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.sign_to_close(universe(spark, sf)))


def item_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.item_coverage(universe(spark, sf)))


def reliable_window(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.reliable_window(universe(spark, sf), DATA_CUT, floor=0.7))


def break_rate_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.break_rate_by_year(universe(spark, sf)))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    """Announcement filings of the episodes of known companies."""
    days = announcement_days(_filings(spark, sf))
    known = A.companies(spark, sf).select("cik")
    return episode_filings(_announcements(spark, sf), days).join(known, "cik")


def form_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.form_frequencies(_members(spark, sf)))


def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.top_categories(universe(spark, sf)))


def announcement_stats(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary.announcement_stats(_announcements(spark, sf)))


def summary_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report in one table."""
    return plain(summary.summary(cut(universe(spark, sf)), DATA_CUT, _members(spark, sf)))


def announcement_reports(spark: SparkSession, sf: str) -> DataFrame:
    return plain(announcement_report(episode_timeline(_filings(spark, sf))).drop("primary_document"))


def _known(spark: SparkSession, sf: str) -> DataFrame:
    return episode_timeline(_filings(spark, sf)).select("cik", F.col("announced").alias("known_by"))


def latest_revenue(spark: SparkSession, sf: str) -> DataFrame:
    facts = A.adapt(spark, sf, A.FACTS)
    return plain(latest_annual(facts, _known(spark, sf), "revenue").drop("unit"))


def figure_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    taken = snapshot(A.adapt(spark, sf, A.FACTS), _known(spark, sf))
    return plain(
        taken.select(
            "cik", "known_by",
            *[F.col(c)[f].alias(f"{c}_{f}") for c in ("revenue", "net_income") for f in ("value", "tag", "filed")],
            F.col("cash").isNull().alias("cash_absent"),
        )
    )


def episode_selection(spark: SparkSession, sf: str) -> DataFrame:
    chosen = search.select_episodes(universe(spark, sf), vocab.RESOLVED_LABELS, "1995-01-01", "1997-01-01")
    return plain(chosen.select("cik", "announced", "label"))


def deal_search(spark: SparkSession, sf: str) -> DataFrame:
    found = search.search_deals(universe(spark, sf), label="completed", query="t1", shell=False)
    return plain(found.select("cik", "announced", "company", "tickers"))


def deal_page(spark: SparkSession, sf: str) -> DataFrame:
    found = cut(search.search_deals(universe(spark, sf), year=1995).select("cik", "announced", "label"))
    return plain(search.page_with_total(found, limit=50, offset=20))


def validation_sample(spark: SparkSession, sf: str) -> DataFrame:
    return plain(search.validation_sample(universe(spark, sf), 40, seed=7).select("cik", "announced", "label"))


def deal_export(spark: SparkSession, sf: str) -> DataFrame:
    days = cut(announcement_days(_filings(spark, sf)))
    arrays = episode_arrays(_announcements(spark, sf), days)
    return plain(slim(attach_announcements(universe_of(spark, sf, timeline_of(days)), arrays), vocab.DEAL_FIELDS))


def resumed_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A second run: finished rows are kept, failed and missing ones are redone."""
    wanted = universe(spark, sf).where("label = 'terminated'").select(
        "cik", "announced", F.col("resolved_accession").alias("accession")
    )
    earlier = wanted.where("cik % 3 <> 0").withColumn(
        "status", F.when(F.col("cik") % 3 == 1, vocab.CONFIRMED).otherwise(vocab.FETCH_FAILED)
    )
    keys = ["cik", "announced", "accession"]
    return plain(resume(wanted, earlier, keys, lambda rows: rows.withColumn("status", F.lit("redone"))))


def frame(spark: SparkSession, sf: str, include_pending: bool = False, window_end: str = FRAME_END) -> DataFrame:
    """The feature frame, with verdicts and terms read from the notices."""
    from outturn.plans import notices

    events = timeline(spark, sf)
    built = universe_of(spark, sf, events)
    return build_frame(
        built, notices.verdict_rows(spark, sf, built), notices.terms_rows(spark, sf, built, events),
        DATA_CUT, FRAME_START, window_end, include_pending,
    )


def feature_frame(spark: SparkSession, sf: str) -> DataFrame:
    return plain(frame(spark, sf))


def censored_frame(spark: SparkSession, sf: str) -> DataFrame:
    return plain(
        frame(spark, sf, include_pending=True, window_end="2002-01-01").select(
            "cik", "announced", "broke", "duration_days", "observed_break", "observed_close"
        )
    )


def feature_counts(spark: SparkSession, sf: str) -> DataFrame:
    train, test = time_split(check_no_leakage(frame(spark, sf)), SPLIT_YEAR)
    return plain(
        frame_counts(train).withColumn("part", F.lit("train"))
        .unionByName(frame_counts(test).withColumn("part", F.lit("test")))
    )


def _censored(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, include_pending=True, window_end="2002-01-01")


def survival_days(spark: SparkSession, sf: str) -> DataFrame:
    return plain(survival_table(_censored(spark, sf)))


def survival_report(spark: SparkSession, sf: str) -> DataFrame:
    return plain(curve_report(_censored(spark, sf)))


QUERIES = {
    "form_predicates": form_predicates,
    "episodes": episode_table,
    "episodes_short_gap": short_gap_episodes,
    "episode_members": episode_members,
    "episode_arrays": episode_array_rows,
    "outcomes": outcomes,
    "universe": universe_rows,
    "universe_from_index": universe_from_index,
    "universe_coverage": universe_coverage,
    "history_window": history_since,
    "label_counts": label_counts,
    "labels_by_year": labels_by_year,
    "outcome_rates": outcome_rates,
    "sign_to_close_days": sign_to_close,
    "item_coverage": item_coverage,
    "reliable_window": reliable_window,
    "break_rate_by_year": break_rate_by_year,
    "form_frequencies": form_frequencies,
    "top_categories": top_categories,
    "announcement_stats": announcement_stats,
    "summary_report": summary_report,
    "announcement_reports": announcement_reports,
    "latest_annual_revenue": latest_revenue,
    "figure_snapshot": figure_snapshot,
    "episode_selection": episode_selection,
    "deal_search": deal_search,
    "deal_page": deal_page,
    "validation_sample": validation_sample,
    "deal_export": deal_export,
    "resumed_verdicts": resumed_verdicts,
    "feature_frame": feature_frame,
    "censored_frame": censored_frame,
    "feature_counts": feature_counts,
    "survival_days": survival_days,
    "survival_report": survival_report,
}

# -- the same answers in SQL --------------------------------------------------

_LABEL_COUNTS = ", ".join(f"count(*) filter (label = '{label}') as {label}" for label in vocab.LABELS)


def _episodes_sql(gap: int = vocab.EPISODE_GAP_DAYS) -> str:
    return f"""
with f as materialized ({A.FILINGS}),
item as (select *, ',' || replace(items, ' ', '') || ',' as tokens from f),
ann as materialized (select * from f where split_part(form, '/', 1) in
  ('DEFM14A','PREM14A','DEFM14C','PREM14C','SC 14D9','SC 13E3')),
mark as materialized (select distinct cik, filed from item
  where split_part(form, '/', 1) in ('25','25-NSE','15-12B','15-12G') or (form like '8-K%' and tokens like '%,1.02,%')),
day as (select cik, filed, lag(filed) over (partition by cik order by filed) as prev
  from (select distinct cik, filed from ann)),
start as (select *, case when prev is null or filed - prev > {gap}
    or exists (select 1 from mark m where m.cik = day.cik and m.filed > day.prev and m.filed < day.filed)
  then 1 else 0 end as starts from day),
numbered as materialized (select *, sum(starts) over (partition by cik order by filed) as episode_no from start),
member as materialized (select a.*, n.episode_no from ann a join numbered n on a.cik = n.cik and a.filed = n.filed),
ep as materialized (select *, lead(announced) over (partition by cik order by announced) as next_announced from (
  select cik, episode_no, min(filed) as announced, max(filed) as last_announcement, count(*) as n_announcements,
    max(case when form like '%14D9%' then 1 else 0 end) as tender_offer_filing,
    max(case when form like '%13E3%' then 1 else 0 end) as going_private
  from member group by cik, episode_no))
"""


_OUTCOMES = _episodes_sql() + f""",
after as (select e.cik, e.episode_no, i.filed, i.accession, i.form, case
    when split_part(i.form, '/', 1) in ('25','25-NSE','15-12B','15-12G') then 'dereg' end as dereg,
    i.tokens, i.form like '8-K%' as current_report
  from ep e join item i on i.cik = e.cik and i.filed > e.announced
    and i.filed <= least(e.last_announcement + 900, coalesce(e.next_announced - 1, e.last_announcement + 900))),
firsts as (select cik, episode_no,
    min((filed, accession, form)) filter (dereg = 'dereg') as dereg,
    min((filed, accession, form)) filter (current_report and tokens like '%,5.01,%') as cc,
    min((filed, accession, form)) filter (current_report and tokens like '%,5.06,%') as se,
    min((filed, accession, form)) filter (current_report and tokens like '%,2.01,%') as co,
    min((filed, accession, form)) filter (current_report and tokens like '%,1.02,%') as te
  from after group by cik, episode_no),
per as (select cik, min(filed) as first_periodic, max(filed) as last_periodic from f
  where form in ('10-K','10-K/A','10-Q','10-Q/A','20-F','40-F') group by cik),
judged as (select e.*, x.dereg, x.cc, x.se, x.co, x.te,
    coalesce(p.first_periodic <= e.announced, false) as registrant,
    coalesce(p.last_periodic > e.last_announcement + 365, false) as survived
  from ep e left join firsts x using (cik, episode_no) left join per p using (cik)),
lab as materialized (select *, case when not registrant then 'not_registrant'
    when dereg is not null then 'completed' when se is not null then 'completed_shell'
    when cc is not null and not survived then 'completed'
    when survived then case when te is not null then 'terminated' when co is not null then 'acquirer_side' else 'unresolved' end
    when co is not null then 'completed'
    when date '{DATA_CUT}' - last_announcement < 400 then 'pending' else 'unresolved' end as label,
  case when not registrant then null when dereg is not null then dereg when se is not null then se
    when cc is not null and not survived then cc
    when survived then coalesce(te, co) else co end as hit
  from judged),
out as materialized (select *, hit[1] as resolved_on, hit[2] as resolved_accession, hit[3] as resolved_form,
  hit[1] - announced as days_to_resolution,
  concat_ws('|', 'dereg:' || dereg[3] || '@' || dereg[1]::varchar, 'item5.01:' || cc[3] || '@' || cc[1]::varchar,
    'item5.06:' || se[3] || '@' || se[1]::varchar, 'item2.01:' || co[3] || '@' || co[1]::varchar,
    'item1.02:' || te[3] || '@' || te[1]::varchar) as evidence
  from lab)
"""

UNIVERSE = _OUTCOMES + f""",
co as ({A.COMPANIES}),
uni as materialized (select o.*, co.name as company, co.sic, co.sic_description, co.ticker,
  (co.sic = '6770' or label = 'completed_shell') as shell, year(announced) as year from out o join co using (cik))
"""

_ITEM_SHARE = "avg(case when evidence like 'item%' or evidence like '%|item%' then 1.0 else 0.0 end)"
_RESOLVED = "label in ('completed','completed_shell','terminated')"
_RATES = f"""count(*) as episodes, count(*) filter ({_RESOLVED}) as resolved,
 count(*) filter (label in ('completed','completed_shell')) as completed, count(*) filter (label = 'terminated') as break_events,
 count(*) filter (label = 'unresolved') as unresolved, count(*) filter (label = 'acquirer_side') as acquirer_side,
 count(*) filter (label = 'not_registrant') as not_registrant,
 round(count(*) filter (label in ('completed','completed_shell'))::double / nullif(count(*) filter ({_RESOLVED}), 0), 6) as completion_rate,
 round(count(*) filter (label = 'unresolved')::double / nullif(count(*), 0), 6) as unresolved_share"""


def _asof_sql(names: str, tags: str, priority: str) -> str:
    """The best annual figure per (cik, known_by) for one concept, by plain range join."""
    return f"""select k.cik, k.known_by, '{names}' as concept,
  arg_max(x, (-x.priority, x.period_end, x.filed, -x.seq)) as best
  from known k join (select *, {priority} as priority from facts where tag in ({tags})
    and form in ('10-K','20-F','40-F')) x on x.cik = k.cik and x.filed <= k.known_by group by all"""


_KNOWN = f", facts as materialized ({A.FACTS}), known as (select cik, announced as known_by from ep)"
_REVENUE = _asof_sql("revenue", "'Revenues','SalesRevenueNet'", "case tag when 'Revenues' then 2 else 3 end")
_INCOME = _asof_sql("net_income", "'NetIncomeLoss','ProfitLoss'", "case tag when 'NetIncomeLoss' then 0 else 1 end")


def _item_flag(code: str) -> str:
    return f"(',' || replace(items, ' ', '') || ',') like '%,{code},%' as item_{code.replace('.', '')}"


def _frame_sql() -> str:
    from outturn.plans import notices

    return UNIVERSE + notices.FRAME_CTES + f""",
fr as materialized (select u.cik, u.company, u.announced, u.year,
  case when u.label = 'terminated' then 1 when u.label in ('completed','completed_shell') then 0 end as broke,
  case when length(u.sic) >= 2 then left(u.sic, 2) else 'unknown' end as sector,
  u.tender_offer_filing, u.going_private, u.shell::int as shell,
  t.cash_per_share, null::double as exchange_ratio, t.stated_premium_pct, t.termination_fee_usd,
  null::double as parent_termination_fee_usd, t.equity_value_usd,
  null::bigint as financing_condition, case when t.cik is not null then 0 end as go_shop,
  case when t.cik is not null then 0 end as hsr, case when t.cik is not null then 0 end as cfius,
  case when t.cik is not null then 0 end as tender_offer,
  case when t.break_fee_pct > 0 and t.break_fee_pct <= 20 then t.break_fee_pct end as break_fee_pct,
  case when t.cik is not null then 'cash' else 'unknown' end as consideration,
  case when t.cik is not null then 1 else 0 end as has_terms,
  case when u.days_to_resolution is null then date '{DATA_CUT}' - u.announced else greatest(u.days_to_resolution, 1) end as duration_days,
  u.days_to_resolution, u.label
  from uni u left join verdict v on v.cik = u.cik and v.announced = u.announced
  left join term t on t.cik = u.cik and t.announced = u.announced
  where u.announced >= date '{FRAME_START}' and u.announced < date '2002-01-01'
    and (u.label in ('completed','completed_shell','pending') or (u.label = 'terminated' and v.status = 'confirmed'))),
events as materialized (select *, case when days_to_resolution is null then 0 else broke end as observed_break,
  case when days_to_resolution is null then 0 else 1 - broke end as observed_close from fr)
"""


_LABELLED = f"label <> 'pending' and announced < date '{FRAME_END}'"
_CURVES = """,
byday as (select least(duration_days, 900) as day, count(*) as n, sum(observed_break)::bigint as breaks,
  sum(observed_close)::bigint as closes from events group by 1),
risk as (select *, (sum(n) over (order by day desc))::bigint as at_risk from byday),
curve as materialized (select day, at_risk, breaks, closes,
  product(1 - closes::double / at_risk) over (order by day) as still_open,
  product(1 - breaks::double / at_risk) over (order by day) as unbroken,
  product(1 - (breaks + closes)::double / at_risk) over (order by day) as s from risk),
cum as materialized (select *, sum(coalesce(before, 1.0) * breaks / at_risk) over (order by day) as incidence
  from (select *, lag(s) over (order by day) as before from curve))
"""


def _curve_at(column: str, day: int, start: str) -> str:
    return f"coalesce(max_by({column}, day) filter (day <= {day}), {start})"


def _long_sql(source: str, section: str, key: str | None, columns: list[str]) -> str:
    """The columns of a small table as (section, metric, value) rows."""
    before = f"{key}::varchar || ':' || " if key else ""
    return " union all ".join(
        f"select '{section}' as section, {before}'{c}' as metric, {c}::double as value from {source}" for c in columns
    )


def _summary_sql() -> str:
    parts = {
        "p_labels": f"""select label, coalesce(n, 0) as n from (values {', '.join(f"('{x}')" for x in vocab.LABELS)}) l(label)
            left join (select label, count(*) as n from uni group by label) using (label)""",
        "p_rates": f"""select 'all' as segment, {_RATES} from uni
            union all select case when shell then 'shell' else 'operating' end, {_RATES} from uni group by 1""",
        "p_close": """select len(v) as n, v[len(v) // 10 + 1] as p10, v[len(v) // 2 + 1] as median, v[len(v) * 9 // 10 + 1] as p90
            from (select list(days_to_resolution order by days_to_resolution) as v from uni where label in ('completed','completed_shell'))""",
        "p_years": f"select year, {_LABEL_COUNTS} from uni group by year",
        "p_breaks": f"""select year, round(count(*) filter (label = 'terminated')::double
            / greatest(count(*) filter ({_RESOLVED}), 1), 6) as break_rate from uni group by year""",
        "p_items": f"select year, round({_ITEM_SHARE}, 6) as coverage from uni group by year",
        "p_sic": "select sic_description, count(*) as n from uni where sic_description <> '' group by 1 order by n desc, 1 limit 15",
        "p_window": f"select min(year) filter (coverage >= {vocab.ITEM_COVERAGE_FLOOR}) as first_usable_year from p_items",
        "p_censored": f"select year, 1 as censored from p_items where date '{DATA_CUT}' - make_date(year, 12, 31) < 365",
        "p_forms": "select form, count(*) as n from member where cik in (select cik from co) group by form",
    }
    rates = [
        "episodes", "resolved", "completed", "break_events", "unresolved", "acquirer_side", "not_registrant",
        "completion_rate", "unresolved_share",
    ]
    rows = [
        ("p_labels", "labels", "label", ["n"]), ("p_rates", "rates", "segment", rates),
        ("p_close", "sign_to_close_days", None, ["n", "p10", "median", "p90"]), ("p_years", "by_year", "year", vocab.LABELS),
        ("p_breaks", "break_rate_by_year", "year", ["break_rate"]), ("p_items", "item_code_coverage", "year", ["coverage"]),
        ("p_sic", "top_sic", "sic_description", ["n"]), ("p_window", "reliable_window", None, ["first_usable_year"]),
        ("p_censored", "right_censored_years", "year", ["censored"]), ("p_forms", "announcement_forms", "form", ["n"]),
    ]
    tables = "".join(f", {name} as materialized ({sql})" for name, sql in parts.items())
    return UNIVERSE + tables + " " + " union all ".join(_long_sql(*r) for r in rows)


def oracles() -> dict[str, str]:
    frame_sql = _frame_sql()
    episode_columns = """select cik, episode_no::bigint as episode_no, announced::varchar as announced,
      last_announcement::varchar as last_announcement, next_announced::varchar as next_announced, n_announcements from ep"""
    features = [
        "cik", "company", "announced::varchar as announced", "year::bigint as year", "broke", "sector",
        "tender_offer_filing", "going_private", "shell", "cash_per_share", "exchange_ratio", "stated_premium_pct",
        "termination_fee_usd", "parent_termination_fee_usd", "equity_value_usd", "financing_condition", "go_shop",
        "hsr", "cfius", "tender_offer", "round(break_fee_pct, 6) as break_fee_pct", "consideration", "has_terms",
        "duration_days::bigint as duration_days", "observed_break", "observed_close",
    ]
    return {
        "form_predicates": f"""with f as ({A.FILINGS}), co as ({A.COMPANIES})
            select accession, form,
             split_part(form,'/',1) in ('DEFM14A','PREM14A','DEFM14C','PREM14C','SC 14D9','SC 13E3') as announcement,
             split_part(form,'/',1) in ('25','25-NSE','15-12B','15-12G') as deregistration,
             form in ('10-K','10-K/A','10-Q','10-Q/A','20-F','40-F') as periodic, form like '8-K%' as current_report,
             {', '.join(_item_flag(c) for c in ('1.01', '1.02', '2.01', '5.01', '5.06'))},
             coalesce(sic, '') = '6770' as shell, case when length(coalesce(sic, '')) >= 2 then left(sic, 2) else 'unknown' end as sector
            from f left join co using (cik)""",
        "episodes": _episodes_sql() + episode_columns,
        "episodes_short_gap": _episodes_sql(200) + episode_columns,
        "episode_members": _episodes_sql() + """select cik, episode_no::bigint as episode_no, filed::varchar as filed, form, accession from member""",
        "episode_arrays": _episodes_sql() + """select cik, episode_no::bigint as episode_no, min(filed)::varchar as announced, 0::bigint as chunk_no,
            string_agg(form, '|' order by filed, accession, form) as announcement_forms,
            string_agg(accession, '|' order by filed, accession, form) as announcement_accessions from member group by cik, episode_no""",
        "outcomes": _OUTCOMES + """select cik, episode_no::bigint as episode_no, announced::varchar as announced,
            last_announcement::varchar as last_announcement, next_announced::varchar as next_announced, n_announcements,
            tender_offer_filing = 1 as tender_offer_filing, going_private = 1 as going_private, label,
            resolved_on::varchar as resolved_on, days_to_resolution, evidence, resolved_accession, resolved_form from out""",
        "universe": UNIVERSE + """select cik, announced::varchar as announced, company, sic, sic_description, shell, ticker as tickers,
            case when ticker = '' then '' else 'NYSE' end as exchanges, label, days_to_resolution, evidence from uni""",
        "universe_from_index": UNIVERSE + """select cik, announced::varchar as announced,
            case when company = '' then 'Customer ' || cik else company end as company, label,
            resolved_on::varchar as resolved_on, n_announcements from uni""",
        "universe_coverage": UNIVERSE + """select (select count(distinct cik) from ann) as targets,
            (select count(distinct cik) from ann where cik not in (select cik from co)) as targets_without_history,
            (select count(*) from uni) as episodes""",
        "history_window": _episodes_sql() + "select cik, (min(filed) - 1200)::varchar as since from ann group by cik",
        "label_counts": UNIVERSE + f"""select label, coalesce(n, 0) as n from (values {', '.join(f"('{x}')" for x in vocab.LABELS)}) l(label)
            left join (select label, count(*) as n from uni group by label) using (label)""",
        "labels_by_year": UNIVERSE + f"select year, {_LABEL_COUNTS} from uni group by year",
        "outcome_rates": UNIVERSE + f"""select 'all' as segment, {_RATES} from uni
            union all select case when shell then 'shell' else 'operating' end, {_RATES} from uni group by 1""",
        "sign_to_close_days": UNIVERSE + """, d as (select list(days_to_resolution order by days_to_resolution) as v from uni where label in ('completed','completed_shell'))
            select len(v) as n, v[len(v) // 10 + 1] as p10, v[len(v) // 2 + 1] as median, v[len(v) * 9 // 10 + 1] as p90 from d""",
        "item_coverage": UNIVERSE + f"""select year, round({_ITEM_SHARE}, 6) as coverage from uni group by year""",
        "reliable_window": UNIVERSE + f""", c as (select year, {_ITEM_SHARE} as coverage from uni group by year)
            select min(year) filter (coverage >= 0.7) as first_usable_year,
             coalesce(string_agg(year::varchar, '|' order by year) filter (date '{DATA_CUT}' - make_date(year, 12, 31) < 365), '') as right_censored_years from c""",
        "break_rate_by_year": UNIVERSE + f"""select year, round(count(*) filter (label = 'terminated')::double
             / greatest(count(*) filter ({_RESOLVED}), 1), 6) as break_rate from uni group by year""",
        "form_frequencies": UNIVERSE + "select form, count(*) as n from member where cik in (select cik from co) group by form",
        "top_categories": UNIVERSE + "select sic_description, count(*) as n from uni where sic_description <> '' group by 1 order by n desc, 1 limit 15",
        "summary_report": _summary_sql(),
        "announcement_stats": _episodes_sql() + "select count(*) as announcement_filings, count(distinct cik) as distinct_ciks from ann",
        "announcement_reports": _episodes_sql() + """, cand as (select e.cik, e.episode_no,
              min((abs(i.filed - e.announced), i.filed, i.accession, i.form)) as best
             from ep e join item i on i.cik = e.cik and i.form like '8-K%' and i.tokens like '%,1.01,%'
              and i.filed between e.announced - 200 and e.last_announcement + 120 group by all)
            select e.cik, e.episode_no::bigint as episode_no, e.announced::varchar as announced, e.last_announcement::varchar as last_announcement,
             best[2]::varchar as report_filed, best[4] as report_form, best[3] as accession from ep e left join cand using (cik, episode_no)""",
        "latest_annual_revenue": _episodes_sql() + _KNOWN + f""" select cik, known_by::varchar as known_by, concept, round(best.value, 6) as value,
            best.period_end::varchar as period_end, best.filed::varchar as filed, best.form as form, best.tag as tag from ({_REVENUE})""",
        "figure_snapshot": _episodes_sql() + _KNOWN + f""", r as ({_REVENUE}), i as ({_INCOME})
            select k.cik, k.known_by::varchar as known_by, round(r.best.value, 6) as revenue_value, r.best.tag as revenue_tag, r.best.filed::varchar as revenue_filed,
             round(i.best.value, 6) as net_income_value, i.best.tag as net_income_tag, i.best.filed::varchar as net_income_filed, true as cash_absent
            from (select distinct * from known) k left join r using (cik, known_by) left join i using (cik, known_by)""",
        "episode_selection": UNIVERSE + f"""select cik, announced::varchar as announced, label from uni
            where {_RESOLVED} and announced >= date '1995-01-01' and announced < date '1997-01-01'""",
        "deal_search": UNIVERSE + """select cik, announced::varchar as announced, company, ticker as tickers from uni
            where label = 'completed' and not shell and (lower(company) like '%t1%' or lower(ticker) like '%t1%')""",
        "deal_page": UNIVERSE + "select cik, announced::varchar as announced, label, count(*) over () as total from uni where year = 1995 order by uni.announced, cik limit 50 offset 20",
        "validation_sample": UNIVERSE + """select cik, announced::varchar as announced, label from uni
            order by md5('7|' || cik::varchar || '|' || uni.announced::varchar), cik, uni.announced limit 40""",
        "deal_export": UNIVERSE + """select uni.cik, company, sic_description, ticker as tickers, uni.announced::varchar as announced, label,
            resolved_on::varchar as resolved_on, days_to_resolution, announcement_forms, evidence, shell
            from uni join (select cik, episode_no, min(filed) as announced,
             string_agg(form, '|' order by filed, accession, form) as announcement_forms from member group by cik, episode_no) m
            on m.cik = uni.cik and m.announced = uni.announced""",
        "resumed_verdicts": UNIVERSE + """select cik, announced::varchar as announced, resolved_accession as accession,
            case when cik % 3 = 1 then 'confirmed' else 'redone' end as status from uni where label = 'terminated'""",
        "feature_frame": frame_sql + f"select {', '.join(features)} from events where {_LABELLED}",
        "censored_frame": frame_sql + """select cik, announced::varchar as announced, broke, duration_days::bigint as duration_days,
            observed_break, observed_close from events""",
        "feature_counts": frame_sql + f"""select case when year < {SPLIT_YEAR} then 'train' else 'test' end as part, count(*) as deals,
            sum(broke)::bigint as confirmed_breaks, sum(has_terms)::bigint as with_extracted_terms from events where {_LABELLED} group by 1""",
        "survival_days": frame_sql + _CURVES + """select day::bigint as day, at_risk, breaks, closes, round(still_open, 6) as still_open,
            round(unbroken, 6) as unbroken, round(incidence, 6) as incidence from cum""",
        "survival_report": frame_sql + _CURVES + f"""select min(day) filter (still_open <= 0.5) as median_days_to_close,
            {', '.join(f"round(1 - {_curve_at('still_open', d, '1.0')}, 6) as closed_by_{d}" for d in vocab.CURVE_DAYS)},
            {', '.join(f"round({_curve_at('incidence', d, '0.0')}, 6) as break_incidence_{d}" for d in vocab.CURVE_DAYS)},
            {', '.join(f"round(1 - {_curve_at('unbroken', d, '1.0')}, 6) as naive_break_risk_{d}" for d in vocab.CURVE_DAYS)},
            max(at_risk) as n, sum(breaks)::bigint as breaks, sum(closes)::bigint as closes,
            (max(at_risk) - sum(breaks) - sum(closes))::bigint as censored from cum""",
    }
