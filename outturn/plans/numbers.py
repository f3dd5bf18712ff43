"""Queries over scenarios and scores: deal arithmetic, calibration, coverage, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outturn.functions import vocab
from outturn.functions.lineage import cut
from outturn.operators import conformal, scoring
from outturn.operators.hazard import concordance, fit_hazard
from outturn.operators.inference import fit_logit
from outturn.operators.report import SCHEMA, _hazard_rows, _logit_rows, model_report
from outturn.operators.scenario import company_metrics, pro_forma, validate
from outturn.operators.sensitivity import tornado, uniform_draws, variance_decomposition
from outturn.plans import adapters as A
from outturn.plans.shaping import plain

SAMPLES, SEED = 4000, 0


def _scenarios(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = validate(A.adapt(spark, sf, A.SCENARIOS))
    return valid


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return A.adapt(spark, sf, A.SCORES).select("doc_id", "p", F.col("truth").alias("y"))


def pro_forma_rows(spark: SparkSession, sf: str) -> DataFrame:
    built = company_metrics(company_metrics(pro_forma(_scenarios(spark, sf)), "a_"), "t_")
    return plain(
        built.select(
            "scenario_id", "a_eps", "a_market_cap", "t_eps", "t_market_cap", "equity_purchase_price",
            "target_debt_refinanced", "cash_from_balance_sheet", "new_debt", "new_equity", "total_uses", "total_sources",
            "balances", "shares_issued", "pro_forma_shares", "pro_forma_net_income", "pro_forma_eps", "accretion_pct",
            "premium_pct", "goodwill", "pro_forma_net_debt", "pro_forma_net_debt_to_ebitda", "after_tax_synergies",
            "incremental_interest", "forgone_interest", "incremental_amortisation", "synergies_for_breakeven",
        ),
        digits=3,
    )


def rejected_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    odd = A.adapt(spark, sf, A.SCENARIOS).withColumns(
        {
            "tax_rate": F.when(F.col("scenario_id") % 7 == 0, 1.0).otherwise(F.col("tax_rate")),
            "synergy_phasing": F.col("synergy_phasing") + F.when(F.col("scenario_id") % 5 == 0, 1.0).otherwise(0.0),
            "t_share_price": F.when(F.col("scenario_id") % 11 == 0, 0.0).otherwise(F.col("t_share_price")),
            "new_debt_rate": F.when(F.col("scenario_id") % 13 == 0, 1.5).otherwise(0.06),
            "forgone_cash_yield": F.when(F.col("scenario_id") % 17 == 0, -0.1).otherwise(0.02),
            "intangible_life_years": F.when(F.col("scenario_id") % 19 == 0, 0.0).otherwise(10.0),
        }
    )
    return plain(validate(odd)[1].select("scenario_id", "problems"))


def tornado_rows(spark: SparkSession, sf: str) -> DataFrame:
    return plain(tornado(_scenarios(spark, sf)), digits=9)


def decomposition(spark: SparkSession, sf: str) -> DataFrame:
    found = variance_decomposition(_scenarios(spark, sf), samples=SAMPLES, seed=SEED)
    return plain(
        found.select(
            "scenario_id", "base_accretion_pct", "mean_accretion_pct", "std_accretion_pp", "p5", "p95",
            "share_accretive", "linear_r_squared",
            *[F.col("share_of_variance")[n].alias(f"share_{n}") for n in vocab.ASSUMPTION_RANGES], "dominant", "samples",
        )
    )


def brier(spark: SparkSession, sf: str) -> DataFrame:
    return plain(scoring.brier(_scores(spark, sf), 0.8))


def auc(spark: SparkSession, sf: str) -> DataFrame:
    return plain(scoring.auc(_scores(spark, sf)))


def calibration_curve(spark: SparkSession, sf: str) -> DataFrame:
    return plain(scoring.calibration_curve(cut(_scores(spark, sf)), 5))


def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return plain(scoring.calibration_error(scoring.calibration_curve(cut(_scores(spark, sf)))))


def expected_value(spark: SparkSession, sf: str) -> DataFrame:
    return plain(scoring.expected_value(_scores(spark, sf), [1.0, 0.005, 0.05, 0.1, 0.3]))


def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return plain(scoring.bootstrap_interval(scoring.bootstrap_sums(_scores(spark, sf))))


def conformal_coverage(spark: SparkSession, sf: str) -> DataFrame:
    scored = cut(_scores(spark, sf))
    return plain(conformal.coverage(scored.where("doc_id % 3 = 0"), scored.where("doc_id % 3 <> 0")))


def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    rest, held = conformal.stratified_split(cut(_scores(spark, sf)), 0.3, "y", ["doc_id"])
    parts = rest.select("y", F.lit("rest").alias("part")).unionAll(held.select("y", F.lit("held")))
    return plain(parts.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n")))


def duration_concordance(spark: SparkSession, sf: str) -> DataFrame:
    """How well the announcement's month ranks episode durations, over all episodes."""
    from outturn.operators.outcomes import label_outcomes
    from outturn.operators.timeline import episode_timeline
    from outturn.plans.deals import DATA_CUT

    labelled = label_outcomes(episode_timeline(A.filings(spark, sf)), DATA_CUT)
    open_days = F.datediff(F.lit(DATA_CUT).cast("date"), F.col("announced"))
    cases = labelled.select(
        F.least(F.coalesce("days_to_resolution", open_days), F.lit(900)).alias("day"),
        (F.col("label") == "terminated").cast("int").alias("event"),
        F.month("announced").cast("double").alias("risk"),
    )
    value = concordance(cases, "day", "event", "risk", 900)
    return plain(spark.createDataFrame([(value,)], "concordance double"))


def _frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from outturn.plans import deals

    censored = cut(deals.frame(spark, sf, include_pending=True, window_end="2002-01-01"))
    labelled = censored.where(
        F.col("broke").isNotNull() & (F.col("announced") < F.lit(deals.FRAME_END).cast("date"))
    )
    return labelled, censored


def hazard_ratios(spark: SparkSession, sf: str) -> DataFrame:
    _, censored = _frames(spark, sf)
    covariates = ["tender_offer_filing", "going_private", "shell", "break_fee_pct"]
    return plain(spark.createDataFrame(_hazard_rows("hazard", fit_hazard(censored, covariates)), SCHEMA))


def odds_ratios(spark: SparkSession, sf: str) -> DataFrame:
    labelled, _ = _frames(spark, sf)
    fit = fit_logit(labelled, vocab.STRUCTURE_COVARIATES)
    return plain(spark.createDataFrame(_logit_rows("inference", fit), SCHEMA))


def full_model_report(spark: SparkSession, sf: str) -> DataFrame:
    from outturn.plans.deals import SPLIT_YEAR

    labelled, censored = _frames(spark, sf)
    return plain(model_report(labelled, censored, SPLIT_YEAR))


QUERIES = {
    "pro_forma": pro_forma_rows,
    "rejected_scenarios": rejected_scenarios,
    "tornado": tornado_rows,
    "variance_decomposition": decomposition,
    "brier": brier,
    "auc": auc,
    "calibration_curve": calibration_curve,
    "calibration_error": calibration_error,
    "expected_value": expected_value,
    "bootstrap_intervals": bootstrap_intervals,
    "conformal_coverage": conformal_coverage,
    "split_counts": split_counts,
    "duration_concordance": duration_concordance,
    "hazard_ratios": hazard_ratios,
    "odds_ratios": odds_ratios,
    "model_report": full_model_report,
}

# -- the same answers in SQL --------------------------------------------------


def _staged(source: str, keep: str) -> str:
    """Accretion and its parts over a table of scenario columns, in three stages."""
    return f"""
z1 as (select *, offer_per_share * t_diluted_shares as eq, offer_per_share * t_diluted_shares * cash_consideration_pct as cp,
   case when refinance_target_debt then t_debt else 0 end as refi from {source}),
z2 as (select *, cp + refi + transaction_fees as need, least((cp + refi + transaction_fees) * cash_from_balance_sheet_pct, greatest(a_cash, 0)) as drawn0 from z1),
z3 as (select *, drawn0 + least(need - drawn0 - t_cash, 0) as drawn, greatest(need - drawn0 - t_cash, 0) as debt, eq - cp as stock from z2),
z4 as (select *, pretax_synergies * synergy_phasing * (1 - tax_rate) as syn, debt * new_debt_rate * (1 - tax_rate) as inter,
   drawn * forgone_cash_yield * (1 - tax_rate) as forgone, intangible_step_up / intangible_life_years * (1 - tax_rate) as amort,
   a_diluted_shares + stock / a_share_price as shares, a_net_income / a_diluted_shares as alone from z3),
z5 as (select {keep}, a_net_income + t_net_income + syn - inter - forgone - amort as income,
   100.0 * ((a_net_income + t_net_income + syn - inter - forgone - amort) / shares / alone - 1.0) as acc from z4)"""


def _double(v: float) -> str:
    """A literal DuckDB reads as a double, not a decimal."""
    text = repr(float(v))
    return text if "e" in text else f"{text}e0"


def _decomposition_sql() -> str:
    names = list(vocab.ASSUMPTION_RANGES)
    draws = uniform_draws(vocab.ASSUMPTION_RANGES, SAMPLES, SEED)
    import numpy as np

    x = (draws - draws.mean(axis=0)) / draws.std(axis=0, ddof=1)
    inverse = np.linalg.inv(x.T @ x)
    values = ",".join("(" + ",".join(_double(v) for v in [*row, *z]) + ")" for row, z in zip(draws, x))
    columns = ", ".join([*[f"d_{n}" for n in names], *[f"x_{n}" for n in names]])
    fixed = [
        "scenario_id", "a_net_income", "a_diluted_shares", "a_share_price", "a_cash", "t_net_income", "t_diluted_shares",
        "t_cash", "t_debt", "offer_per_share", "refinance_target_debt", "intangible_life_years",
    ]
    moved = ", ".join([*fixed, *[f"d_{n} as {n}" for n in names], *[f"x_{n}" for n in names]])
    xy = ", ".join(f"sum(x_{n} * acc) as xy_{n}" for n in names)
    beta = ", ".join(
        "(" + " + ".join(f"{_double(inverse[i, j])} * xy_{m}" for j, m in enumerate(names)) + f") / sd as b_{n}"
        for i, n in enumerate(names)
    )
    total = " + ".join(f"b_{n} * b_{n}" for n in names)
    shares = ", ".join(f"round(b_{n} * b_{n} / ({total}), 6) as share_{n}" for n in names)
    fit = " + ".join(f"b_{n} * xy_{n} / sd" for n in names)
    named = " union all ".join(f"select scenario_id, '{n}' as name, b_{n} * b_{n} / ({total}) as share from b" for n in names)
    varied = _staged("moved", "scenario_id, " + ", ".join(f"x_{n}" for n in names))
    return f"""with draw({columns}) as (values {values}), sc as materialized ({A.SCENARIOS}),
moved as (select {moved} from sc cross join draw), {varied},
m as (select scenario_id, avg(acc) as mean, stddev_samp(acc) as sd, quantile_cont(acc, 0.05) as p5, quantile_cont(acc, 0.95) as p95,
  avg((acc > 0)::int::double) as pos, {xy} from z5 group by scenario_id),
b as (select *, {beta} from m),
base as (with {_staged('sc', 'scenario_id')} select scenario_id, acc from z5),
ranked as (select *, coalesce(sum(share) over (partition by scenario_id order by share desc, name
  rows between unbounded preceding and 1 preceding), 0) as before from ({named})),
dom as (select scenario_id, string_agg(name, '|' order by share desc, name) filter (before < 0.8) as dominant from ranked group by scenario_id)
select scenario_id, dominant, {SAMPLES} as samples, round(base.acc, 6) as base_accretion_pct, round(mean, 6) as mean_accretion_pct, round(sd, 6) as std_accretion_pp,
  round(p5, 6) as p5, round(p95, 6) as p95, round(pos, 6) as share_accretive, round(({fit}) / {SAMPLES - 1}, 6) as linear_r_squared, {shares}
from b join base using (scenario_id) join dom using (scenario_id)"""


def _tornado_sql() -> str:
    names = list(vocab.ASSUMPTION_RANGES)
    fixed = """scenario_id, assumption, low_value, high_value, side, a_net_income, a_diluted_shares, a_share_price, a_cash, t_net_income,
      t_diluted_shares, t_cash, t_debt, offer_per_share, refinance_target_debt, intangible_life_years"""
    moved = ", ".join(
        f"case when assumption = '{n}' then case side when 'low' then low_value else high_value end else {n} end as {n}" for n in names
    )
    moves = ",".join(f"('{n}', {lo!r}::double, {hi!r}::double)" for n, (lo, hi) in vocab.ASSUMPTION_RANGES.items())
    return f"""with sc as materialized ({A.SCENARIOS}), mv(assumption, low_value, high_value) as (values {moves}),
side(side) as (values ('low'), ('high')), moved as (select {fixed}, {moved} from sc, mv, side),
{_staged('moved', 'scenario_id, assumption, low_value, high_value, side')},
w as (select scenario_id, assumption, low_value, high_value, max(acc) filter (side = 'low') as lo, max(acc) filter (side = 'high') as hi from z5 group by all)
select scenario_id, assumption, low_value, high_value, round(lo, 9) as accretion_at_low, round(hi, 9) as accretion_at_high, round(abs(hi - lo), 9) as swing_pp,
 row_number() over (partition by scenario_id order by round(abs(hi - lo), 9) desc, assumption) as place from w"""


_SCORES = f"with s as materialized (select doc_id, p, truth as y from ({A.SCORES}))"


def _curve_sql(bins: str) -> str:
    return f"""{_SCORES}, v as (select list(p order by p) as l, count(*) - 1 as last, {bins} as bins from s),
   pos as (select l, i::double * last / bins as spot from v, (select unnest(range(1, 5)) as i) where i < bins),
   e as (select l[floor(spot)::int + 1] + (l[ceil(spot)::int + 1] - l[floor(spot)::int + 1]) * (spot - floor(spot)) as edge from pos),
   b as (select s.*, (select count(*) from e where s.p > edge) as bin from s),
   c as (select bin, count(*) as n, avg(p) as predicted, avg(y) as observed from b group by bin)"""


def _conformal_sql() -> str:
    def limit(which: str) -> str:
        return f"""(select coalesce(list_extract(list(gap order by gap), ceil((count(*) + 1) * 0.9)::int), 'infinity'::double) from g where {which})"""

    return f"""{_SCORES}, g as materialized (select y, case when y = 1 then 1 - p else 1 - (1 - p) end as gap from s where doc_id % 3 = 0),
     q as materialized (select {limit('true')} as qm, {limit('y = 0')} as q0, {limit('y = 1')} as q1),
     t as materialized (select y, p, 1 - (1 - p) <= qm as m0, 1 - p <= qm as m1, 1 - (1 - p) <= q0 as c0, 1 - p <= q1 as c1 from s, q where doc_id % 3 <> 0),
     l as (select 'marginal' as method, y, m0 as h0, m1 as h1 from t
       union all select 'corrected', y, m0 or (not m0 and not m1 and not p > 1 - p), m1 or (not m0 and not m1 and p > 1 - p) from t
       union all select 'conditional', y, c0, c1 from t),
     z as (select method, y, (case when y = 1 then h1 else h0 end)::int::double as covered, h0::int + h1::int as size from l)
     select method, round(avg(covered), 6) as coverage, round(avg(covered) filter (y = 1), 6) as coverage_on_breaks,
      round(avg(covered) filter (y = 0), 6) as coverage_on_completions, round(avg((size = 0)::int), 6) as empty,
      round(avg((size = 1)::int), 6) as singleton, round(avg((size = 2)::int), 6) as both_labels, round(avg(size), 6) as mean_set_size
     from z group by method"""


def _mixed_sql(source: str, *parts: str) -> str:
    """``source`` with a column h: the parts entered one after the other into the hash of the draws."""
    sql = f"select *, 0::ubigint as h from ({source})"
    for part in parts:
        sql = f"select * replace (xor(h, ({part})::ubigint) as h) from ({sql})"
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
            sql = f"select * replace ((xor(h, h >> {shift}) * {factor}::ubigint) % 4294967296::ubigint as h) from ({sql})"
    return sql


def _bootstrap_sql(draws: int = 400, seed: int = 0) -> str:
    rows = f"""select p, y, copy, draw, floor(p * {_double(2.0 ** 52)})::ubigint as place
      from (select p, y, row_number() over (partition by p, y) - 1 as copy from s), (select unnest(range({draws})) as draw)"""
    first = f"xor({seed}::ubigint, place % 4294967296::ubigint)"
    hashed = _mixed_sql(rows, first, "place >> 32", "y", "copy", "draw")
    weight = " + ".join(f"(h >= {t}::ubigint)::int" for t in scoring.POISSON)
    return f"""{_SCORES}, w as materialized (select p, y, draw, {weight} as weight from ({hashed})),
     c as (select draw, p, sum(weight * y)::double as pos, sum(weight * (1 - y))::double as neg from w group by draw, p),
     r as (select *, coalesce(sum(neg) over (partition by draw order by p rows between unbounded preceding and 1 preceding), 0) as below from c),
     t as (select draw, sum(pos) as pos, sum(neg) as neg, sum(pos * (1 - p) * (1 - p) + neg * p * p) as sq, sum(pos * (below + 0.5 * neg)) as won
       from r group by draw having sum(pos) > 0),
     q as (select quantile_cont(sq / (pos + neg), [0.025, 0.975]) as brier, quantile_cont(won / nullif(pos * neg, 0), [0.025, 0.975]) as auc from t)
     select 'brier' as statistic, round(brier[1], 6) as low, round(brier[2], 6) as high from q
     union all select 'auc', round(auc[1], 6), round(auc[2], 6) from q"""


def _eliminated(source: str, size: int, right: int, keep: str, name: str) -> str:
    """CTEs that solve a system in one row: columns a_i_j of the matrix, then ``right`` columns of right-hand sides."""
    out, last = [], source
    for pivot in range(size):
        cells = [
            (f"a_{pivot}_{c} / a_{pivot}_{pivot}" if r == pivot else f"a_{r}_{c} - a_{r}_{pivot} * a_{pivot}_{c} / a_{pivot}_{pivot}") + f" as a_{r}_{c}"
            for r in range(size) for c in range(size + right)
        ]
        out.append(f"{name}_{pivot} as materialized (select {', '.join([keep, *cells])} from {last})")
        last = f"{name}_{pivot}"
    return ", ".join(out)


def _two_sided_sql(z: str) -> str:
    """Two-sided normal p by Simpson's rule, as there is no error function."""
    point = f"(abs({z}) * i / 2000.0e0)"
    weight = "case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end"
    total = f"(select sum(({weight}) * exp(-{point} * {point} / 2)) from (select unnest(range(2001)) as i))"
    return f"(1 - sqrt(2 / pi()) * abs({z}) / 6000.0e0 * {total})"


def _logit_sql(source: str, covariates: list[str], steps: int = 12) -> str:
    """A logit by Newton steps on the combined cases, written out; all covariates vary and none separates."""
    k = len(covariates) + 1
    x = ["1.0e0", *[f"x{i}" for i in range(1, k)]]
    named = ", ".join(f"{c}::double as x{i}" for i, c in enumerate(covariates, 1))
    parts = [f"pat as materialized (select {named}, broke::double as y, count(*)::double as n from ({source}) group by all)"]
    eta = " + ".join(f"b{i} * {v}" for i, v in enumerate(x))
    keep = ", ".join(f"b{i}" for i in range(k))
    parts.append(f"at_0 as materialized (select {', '.join(f'0.0e0 as b{i}' for i in range(k))})")
    for step in range(steps + 1):
        mu = f"mu_{step} as (select *, 1 / (1 + exp(-({eta}))) as mu, {eta} as eta from pat, at_{step})"
        square = [f"sum(n * mu * (1 - mu) * {x[i]} * {x[j]}) as a_{i}_{j}" for i in range(k) for j in range(k)]
        if step < steps:
            slope = [f"sum(n * (y - mu) * {v}) as a_{i}_{k}" for i, v in enumerate(x)]
            system = f"sys_{step} as materialized (select {', '.join(f'any_value(b{i}) as b{i}' for i in range(k))}, {', '.join(square + slope)} from mu_{step})"
            solved = _eliminated(f"sys_{step}", k, 1, keep, f"el_{step}")
            moved = ", ".join(f"b{i} + a_{i}_{k} as b{i}" for i in range(k))
            parts += [mu, system, solved, f"at_{step + 1} as materialized (select {moved} from el_{step}_{k - 1})"]
        else:
            unit = [f"{float(i == j)}e0 as a_{i}_{k + j}" for i in range(k) for j in range(k)]
            size = "sum(n) as cases, sum(n * y) as events, sum(n * (y * eta - greatest(eta, 0) - ln(1 + exp(-abs(eta))))) as ll"
            parts.append(mu)
            parts.append(f"sys as materialized (select {', '.join(f'any_value(b{i}) as b{i}' for i in range(k))}, {size}, {', '.join(square + unit)} from mu_{step})")
            parts.append(_eliminated("sys", k, k, f"{keep}, cases, events, ll", "inv"))
    parts.append(
        f"fit as materialized (select *, cases * (events / cases * ln(nullif(events / cases, 0)) + (1 - events / cases) * ln(nullif(1 - events / cases, 0))) as ll0 from inv_{k - 1})"
    )
    one = " union all ".join(
        f"select {i} as i, '{c}' as name, b{i} as b, sqrt(a_{i}_{k + i}) as se from fit" for i, c in enumerate(covariates, 1)
    )
    parts.append(f"""coef as materialized (select *, exp(b) as odds, exp(b - 1.959963984540054 * se) as low, exp(b + 1.959963984540054 * se) as high,
      {_two_sided_sql('b / se')} as p from ({one}))""")
    free = k - 1
    lr = "(2 * (ll - ll0))"
    if free != 3:
        raise ValueError("the tail is written for three covariates")
    tail = f"({_two_sided_sql(f'sqrt({lr})')} + sqrt(2 * {lr} / pi()) * exp(-{lr} / 2))"
    carry = "not (low <= 1 and 1 <= high)"
    metrics = [
        ("fitted", "1.0", "null"), ("events", "events", "null"), ("dropped_as_constant", "0.0", "null"), ("parameters", f"{k}.0", "null"),
        ("events_per_parameter", f"events / {k}", "null"), ("underpowered", f"(events / {k} < {vocab.EVENTS_PER_PARAMETER})::int", "null"),
        ("pseudo_r_squared", "1 - ll / ll0", "null"), ("llr_p", tail, "null"),
        ("carry_information", f"(select count(*) from coef where {carry})", f"(select string_agg(name, '|' order by i) from coef where {carry})"),
    ]
    rows = [f"select '{m}' as metric, ({v})::double as value, ({note})::varchar as note from fit" for m, v, note in metrics]
    rows += [
        f"select name || ':{m}', ({v})::double, null from coef"
        for m, v in (("odds_ratio", "odds"), ("ci_low", "low"), ("ci_high", "high"), ("p", "p"), ("crosses_one", f"(not ({carry}))::int"))
    ]
    few = "events < 5 or events = cases"
    return ", " + ", ".join(parts) + f""", found as ({' union all '.join(rows)}),
      size as (select sum(n) as cases, sum(n * y) as events from pat)
      select 'inference' as section, metric, round(value, 6) as value, cases::bigint as n, note from found, size where not ({few})
      union all select 'inference', m.metric, round(case m.metric when 'events' then events else 0 end, 6), cases::bigint,
        case m.metric when 'fitted' then 'too few events' end
      from size, (select unnest(['fitted', 'events', 'dropped_as_constant']) as metric) m where {few}"""


def oracles() -> dict[str, str]:
    from outturn.plans.deals import _LABELLED, DATA_CUT, SPLIT_YEAR, _OUTCOMES, _frame_sql

    keep = """scenario_id, a_net_income, a_diluted_shares, a_share_price, t_net_income, t_diluted_shares, t_share_price, a_debt, a_cash, a_ebitda,
      t_ebitda, t_debt, t_cash, t_book_equity, refinance_target_debt, offer_per_share, pretax_synergies, synergy_phasing, tax_rate,
      intangible_step_up, transaction_fees, eq, refi, drawn, debt, stock, syn, inter, forgone, amort, shares, alone"""
    ebitda = "(a_ebitda + t_ebitda + pretax_synergies * synergy_phasing)"
    net_debt = "(a_debt + debt + case when refinance_target_debt then 0 else t_debt end - greatest(a_cash - drawn, 0))"
    return {
        "pro_forma": f"""with sc as materialized ({A.SCENARIOS}), {_staged('sc', keep)} select scenario_id, round(a_net_income / a_diluted_shares, 3) as a_eps,
            round(a_share_price * a_diluted_shares, 3) as a_market_cap, round(t_net_income / t_diluted_shares, 3) as t_eps,
            round(t_share_price * t_diluted_shares, 3) as t_market_cap, round(eq, 3) as equity_purchase_price, round(refi, 3) as target_debt_refinanced,
            round(drawn, 3) as cash_from_balance_sheet, round(debt, 3) as new_debt, round(stock, 3) as new_equity,
            round(eq + refi + transaction_fees, 3) as total_uses, round(drawn + debt + stock + t_cash, 3) as total_sources,
            abs(drawn + debt + stock + t_cash - (eq + refi + transaction_fees)) < 1 as balances, round(stock / a_share_price, 3) as shares_issued,
            round(shares, 3) as pro_forma_shares, round(income, 3) as pro_forma_net_income, round(income / shares, 3) as pro_forma_eps,
            round(acc, 3) as accretion_pct, round(100.0 * (offer_per_share / t_share_price - 1.0), 3) as premium_pct,
            round(eq - t_book_equity - intangible_step_up, 3) as goodwill, round({net_debt}, 3) as pro_forma_net_debt,
            round({net_debt} / {ebitda}, 3) as pro_forma_net_debt_to_ebitda, round(syn, 3) as after_tax_synergies, round(inter, 3) as incremental_interest,
            round(forgone, 3) as forgone_interest, round(amort, 3) as incremental_amortisation,
            round((alone * shares - (income - syn)) / ((1 - tax_rate) * synergy_phasing), 3) as synergies_for_breakeven from z5""",
        "rejected_scenarios": f"""with sc as ({A.SCENARIOS}), p as (select scenario_id, concat_ws('|',
             case when scenario_id % 13 = 0 then 'new_debt_rate must be between 0 and 1' end,
             case when scenario_id % 17 = 0 then 'forgone_cash_yield must be between 0 and 1' end,
             case when synergy_phasing + case when scenario_id % 5 = 0 then 1 else 0 end > 1 then 'synergy_phasing must be between 0 and 1' end,
             case when scenario_id % 7 = 0 then 'tax_rate must be in [0, 1)' end,
             case when scenario_id % 11 = 0 then 't_share_price must be positive' end,
             case when scenario_id % 19 = 0 then 'intangible_life_years must be positive' end) as problems from sc)
            select * from p where problems <> ''""",
        "tornado": _tornado_sql(),
        "variance_decomposition": _decomposition_sql(),
        "brier": f"""{_SCORES}, b as (select count(*) as n, sum(y)::bigint as breaks, avg((p - y) * (p - y)) as brier, avg((0.8 - y) * (0.8 - y)) as ref from s)
            select n, breaks, round(brier, 6) as brier, round(ref, 6) as brier_of_base_rate, round(1 - brier / ref, 6) as skill from b""",
        "auc": f"""{_SCORES} select round(avg(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0.0 end), 6) as auc
            from s a join s b on a.y = 1 and b.y = 0""",
        "calibration_curve": _curve_sql("5") + " select bin, n, round(predicted, 6) as predicted, round(observed, 6) as observed from c",
        "calibration_error": _curve_sql("(select least(5, greatest(2, sum(y) // 8)) from s)") + " select round(avg(abs(observed - predicted)), 6) as ece from c",
        "expected_value": f"""{_SCORES}, t(threshold) as (values (1.0::double), (0.005), (0.05), (0.1), (0.3)),
            k as (select threshold, count(*) filter (p <= threshold) as taken, coalesce(sum(y) filter (p <= threshold), 0)::bigint as broke, count(*) as deals
             from s, t group by threshold)
            select threshold, taken as deals_taken, round(taken::double / deals, 6) as share_taken, broke as breaks_taken,
             round((3.0 * (taken - broke) - 20.0 * broke) / nullif(taken, 0), 6) as ev_per_deal, 3.0::double * (taken - broke) - 20.0::double * broke as total from k""",
        "bootstrap_intervals": _bootstrap_sql(),
        "conformal_coverage": _conformal_sql(),
        "odds_ratios": _frame_sql() + _logit_sql(f"select * from events where {_LABELLED}", vocab.STRUCTURE_COVARIATES),
        "split_counts": f"""{_SCORES}, c as (select y, count(*) as n from s group by y)
            select 'held' as part, y::bigint as y, round(n * 0.3)::bigint as n from c union all select 'rest', y, n - round(n * 0.3)::bigint from c""",
        "duration_concordance": _OUTCOMES + f""", e as materialized (select least(coalesce(days_to_resolution, date '{DATA_CUT}' - announced), 900) as day,
             label = 'terminated' as died, month(announced) as risk from out)
            select round(avg(case when a.risk > b.risk then 1.0 when a.risk = b.risk then 0.5 else 0.0 end), 6) as concordance
            from e a join e b on a.died and (b.day > a.day or (b.day = a.day and not b.died))""",
    }
