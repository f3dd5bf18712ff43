"""Survival, hazards, scores, inference and coverage against brute force in numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from outturn.functions.ranks import interpolated, order_statistics, running_sums, tenths
from outturn.functions.lineage import cut
from outturn.functions.stats import chi_square_tail
from outturn.operators import conformal, scoring
from outturn.operators.hazard import concordance, fit_hazard
from outturn.operators.inference import fit_logit
from outturn.operators.survival import curve_report, survival_table


@pytest.fixture(scope="module")
def deals():
    rng = np.random.default_rng(7)
    n = 400
    x = rng.integers(0, 2, n)
    z = rng.normal(size=n).round(2)
    t = np.ceil(rng.exponential(60 / np.exp(0.8 * x), n)).astype(int)
    kind = rng.choice(3, n, p=[0.25, 0.6, 0.15])
    return pd.DataFrame(
        {"duration_days": t, "observed_break": (kind == 0).astype(int),
         "observed_close": (kind == 1).astype(int), "x": x, "z": z}
    )


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(3)
    p = rng.beta(1, 8, 600).round(3)
    return pd.DataFrame({"id": range(600), "p": p, "y": (rng.random(600) < p * 1.5).astype(int)})


def test_running_sums_and_order_statistics(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"k": rng.choice(["a", "b"], 500, p=[0.9, 0.1]), "v": rng.normal(size=500).round(2)})
    df = spark.createDataFrame(data)
    cells = cut(df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))
    for r in running_sums(cells, "v", ["n"], ["k"]).collect():
        assert r["n_below"] == ((data.k == r["k"]) & (data.v < r["v"])).sum()
    got = {r["k"]: r for r in order_statistics(df, "v", {"p10": tenths(1), "p90": tenths(9)}, ["k"]).collect()}
    for k, part in data.groupby("k"):
        values = sorted(part.v)
        assert got[k]["p10"] == values[len(values) // 10] and got[k]["p90"] == values[len(values) * 9 // 10]
    assert interpolated(df, "v", [0.2, 0.5]) == pytest.approx(np.percentile(data.v, [20, 50]).tolist())
    empty = order_statistics(df.where("v > 99"), "v", {"m": tenths(5)}).first()
    assert empty["n"] == 0 and empty["m"] is None


def brute_curves(d):
    s_close = s_break = overall = 1.0
    incidence = 0.0
    out = {}
    for t in sorted(d.duration_days.unique()):
        r = (d.duration_days >= t).sum()
        b = d.observed_break[d.duration_days == t].sum()
        c = d.observed_close[d.duration_days == t].sum()
        incidence += overall * b / r
        s_close *= 1 - c / r
        s_break *= 1 - b / r
        overall *= 1 - (b + c) / r
        out[t] = (s_close, s_break, incidence)
    return out


def test_survival_curves(spark, deals):
    expected = brute_curves(deals)
    rows = survival_table(spark.createDataFrame(deals)).collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert (r["still_open"], r["unbroken"], r["incidence"]) == pytest.approx(expected[r["day"]])
    report = curve_report(spark.createDataFrame(deals)).first()
    assert report["n"] == 400 and report["breaks"] + report["closes"] + report["censored"] == 400
    assert report["naive_break_risk_90"] > report["break_incidence_90"] > 0
    assert report["median_days_to_close"] == min(t for t, v in expected.items() if v[0] <= 0.5)


def brute_log_likelihood(d, beta, penalizer):
    x = d[["x", "z"]].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.exp(x @ beta)
    total = 0.0
    for t in sorted(d.duration_days[d.observed_break == 1].unique()):
        died = ((d.duration_days == t) & (d.observed_break == 1)).to_numpy()
        risk = w[(d.duration_days >= t).to_numpy()].sum()
        total += (x[died] @ beta).sum()
        total -= sum(math.log(risk - i / died.sum() * w[died].sum()) for i in range(died.sum()))
    return total - len(d) * penalizer / 2 * (beta**2).sum()


@pytest.mark.parametrize("penalizer", [0.0, 0.1])
def test_hazard_is_the_maximum_of_the_penalised_likelihood(spark, deals, penalizer):
    fit = fit_hazard(spark.createDataFrame(deals), ["x", "z"], penalizer)
    assert fit.fitted and fit.events == deals.observed_break.sum()
    scale = deals[["x", "z"]].to_numpy(float).std(0, ddof=1)
    beta = fit.coefficients * scale
    best = brute_log_likelihood(deals, beta, penalizer)
    curvature = np.zeros((2, 2))
    h = 1e-3
    for i in range(2):
        e = np.eye(2)[i] * h
        assert brute_log_likelihood(deals, beta + e, penalizer) < best
        assert brute_log_likelihood(deals, beta - e, penalizer) < best
        for j in range(2):
            g = np.eye(2)[j] * h
            curvature[i, j] = (
                brute_log_likelihood(deals, beta + e + g, penalizer) - brute_log_likelihood(deals, beta + e - g, penalizer)
                - brute_log_likelihood(deals, beta - e + g, penalizer) + brute_log_likelihood(deals, beta - e - g, penalizer)
            ) / (4 * h * h)
    errors = np.sqrt(np.diag(np.linalg.inv(-curvature))) / scale
    assert fit.standard_errors == pytest.approx(errors, rel=1e-3)
    for _, ratio, low, high, p, ph in fit.rows():
        assert low <= ratio <= high and 0 <= p <= 1 and 0 <= ph <= 1
    risk = deals[["x", "z"]].to_numpy(float) @ fit.coefficients
    assert fit.concordance == pytest.approx(brute_concordance(deals, risk))


def brute_concordance(d, risk):
    won = pairs = 0.0
    t, e = d.duration_days.to_numpy(), d.observed_break.to_numpy()
    for i in np.flatnonzero(e == 1):
        for j in range(len(d)):
            if t[j] > t[i] or (t[j] == t[i] and e[j] == 0):
                pairs += 1
                won += 1 if risk[i] > risk[j] + 1e-12 else 0.5 if abs(risk[i] - risk[j]) <= 1e-12 else 0
    return won / pairs


def test_concordance_of_a_plain_column(spark, deals):
    got = concordance(spark.createDataFrame(deals), "duration_days", "observed_break", "z", 1023)
    assert got == pytest.approx(brute_concordance(deals, deals.z.to_numpy()))


def test_hazard_refuses_too_few_events(spark, deals):
    quiet = deals.assign(observed_break=0)
    assert not fit_hazard(spark.createDataFrame(quiet), ["x"]).fitted


def test_scores(spark, scores):
    df = spark.createDataFrame(scores)
    p, y = scores.p.to_numpy(), scores.y.to_numpy()
    row = scoring.brier(df, 0.1).first()
    assert row["brier"] == pytest.approx(((p - y) ** 2).mean())
    assert row["skill"] == pytest.approx(1 - ((p - y) ** 2).mean() / ((0.1 - y) ** 2).mean())
    gap = p[y == 1][:, None] - p[y == 0][None, :]
    expected_auc = ((gap > 0) + 0.5 * (gap == 0)).mean()
    assert scoring.auc(df).first()["auc"] == pytest.approx(expected_auc)
    curve = scoring.calibration_curve(df, 5)
    edges = np.percentile(p, [20, 40, 60, 80])
    bins = np.searchsorted(edges, p)
    for r in curve.collect():
        assert r["predicted"] == pytest.approx(p[bins == r["bin"]].mean())
        assert r["observed"] == pytest.approx(y[bins == r["bin"]].mean())
    assert sum(r["n"] for r in curve.collect()) == 600
    ev = {r["threshold"]: r for r in scoring.expected_value(df, [1.0, 0.05, 0.0]).collect()}
    taken = p <= 0.05
    assert ev[0.05]["deals_taken"] == taken.sum()
    assert ev[0.05]["ev_per_deal"] == pytest.approx(np.where(y[taken] == 1, -20, 3).mean())
    assert ev[1.0]["share_taken"] == 1.0
    assert p.min() > 0 and ev[0.0]["ev_per_deal"] is None or ev[0.0]["deals_taken"] > 0


def test_bootstrap_interval(spark, scores):
    df = spark.createDataFrame(scores)
    sums = scoring.bootstrap_sums(df, draws=200)
    interval = {r["statistic"]: r for r in scoring.bootstrap_interval(sums).collect()}
    p, y = scores.p.to_numpy(), scores.y.to_numpy()
    rng = np.random.default_rng(1)
    plain = []
    for _ in range(300):
        i = rng.integers(0, 600, 600)
        plain.append(((p[i] - y[i]) ** 2).mean())
    low, high = np.percentile(plain, [2.5, 97.5])
    assert interval["brier"]["low"] == pytest.approx(low, rel=0.15)
    assert interval["brier"]["high"] == pytest.approx(high, rel=0.15)
    assert interval["auc"]["low"] < scoring.auc(df).first()[0] < interval["auc"]["high"]
    again = {tuple(r) for r in scoring.bootstrap_sums(df, draws=200).collect()}
    assert again == {tuple(r) for r in sums.collect()}


def test_conformal_coverage(spark, scores):
    calibration, test = scores[scores.id % 3 == 0], scores[scores.id % 3 != 0]
    limits = conformal.thresholds(spark.createDataFrame(calibration), 0.9)
    gap = np.where(calibration.y == 1, 1 - calibration.p, calibration.p)
    rank = math.ceil((len(gap) + 1) * 0.9)
    assert limits["marginal"] == pytest.approx(np.sort(gap)[rank - 1])
    ones = np.sort(gap[calibration.y == 1])
    assert limits["class_1"] == pytest.approx(ones[math.ceil((len(ones) + 1) * 0.9) - 1])
    rows = {r["method"]: r for r in conformal.coverage(spark.createDataFrame(calibration), spark.createDataFrame(test)).collect()}
    assert rows["conditional"]["coverage_on_breaks"] >= rows["marginal"]["coverage_on_breaks"]
    assert rows["corrected"]["empty"] == 0.0 and rows["corrected"]["coverage"] >= rows["marginal"]["coverage"]
    for r in rows.values():
        assert r["empty"] + r["singleton"] + r["both_labels"] == pytest.approx(1.0)
    few = conformal.thresholds(spark.createDataFrame(calibration.head(3)), 0.9)
    assert few["marginal"] == math.inf


def test_stratified_split_is_exact_and_stable(spark, scores):
    df = spark.createDataFrame(scores)
    rest, held = conformal.stratified_split(df, 0.3, "y", ["id"])
    for label, n in scores.y.value_counts().items():
        assert held.where(F.col("y") == label).count() == round(0.3 * n)
    assert rest.count() + held.count() == 600
    _, again = conformal.stratified_split(df.repartition(5), 0.3, "y", ["id"])
    assert {r.id for r in held.collect()} == {r.id for r in again.collect()}


def test_logit_and_its_refusals(spark):
    rng = np.random.default_rng(5)
    x, z = rng.integers(0, 2, 800), rng.normal(size=800).round(1)
    y = (rng.random(800) < 1 / (1 + np.exp(2 - 1.2 * x))).astype(int)
    data = pd.DataFrame({"x": x, "z": z, "flat": 1, "broke": y})
    fit = fit_logit(spark.createDataFrame(data), ["x", "z", "flat"])
    assert fit.fitted and fit.dropped == ["flat"] and fit.parameters == 3
    design = np.column_stack([np.ones(800), x, z])
    beta = np.zeros(3)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-design @ beta))
        information = design.T @ (design * (mu * (1 - mu))[:, None])
        beta += np.linalg.solve(information, design.T @ (y - mu))
    errors = np.sqrt(np.diag(np.linalg.inv(information)))
    assert fit.odds["x"][0] == pytest.approx(math.exp(beta[1]), rel=1e-6)
    assert fit.odds["x"][1] == pytest.approx(math.exp(beta[1] - 1.959963984540054 * errors[1]), rel=1e-5)
    loglik = (y * np.log(mu) + (1 - y) * np.log(1 - mu)).sum()
    null = 800 * (y.mean() * np.log(y.mean()) + (1 - y.mean()) * np.log(1 - y.mean()))
    assert fit.pseudo_r_squared == pytest.approx(1 - loglik / null, rel=1e-6)
    assert fit.carry_information == ["x"] and not fit.underpowered

    separated = pd.DataFrame({"giveaway": [0] * 60 + [1] * 10, "z": z[:70], "broke": [0] * 60 + [1] * 10})
    refused = fit_logit(spark.createDataFrame(separated), ["giveaway", "z"])
    assert not refused.fitted and "separation" in refused.reason
    assert not fit_logit(spark.createDataFrame(data.assign(broke=0)), ["x"]).fitted
    assert "varies" in fit_logit(spark.createDataFrame(data), ["flat"]).reason


def test_chi_square_tail():
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert chi_square_tail(11.070497693516351, 5) == pytest.approx(0.05)


def test_draws_do_not_depend_on_ranges(spark):
    from outturn.operators.scoring import bootstrap_sums

    rows = spark.range(400).selectExpr("(id * 37 % 101) / 101.0 as p", "cast(id % 7 = 0 as int) as y")
    before, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("4", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            out.append([(r["draw"], r["pos"], r["neg"], r["won"], round(r["sq_error"], 9)) for r in bootstrap_sums(rows, 20).orderBy("draw").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_levels_that_training_never_had_get_no_column(spark):
    from outturn.functions import vocab
    from outturn.operators.models import fit_preprocessing

    numbers = vocab.NUMERIC_FEATURES + vocab.BINARY_FEATURES
    first, *others = vocab.CATEGORICAL_FEATURES
    rows = spark.range(60).selectExpr(
        "id", *[f"cast(id % 5 as double) as {c}" for c in numbers], *[f"'x' as {c}" for c in others],
        f"case when id < 30 then 'a' when id < 58 then 'b' else 'few' end as {first}",
    )
    ready = fit_preprocessing(rows)

    def hot(level):
        row = ready.transform(rows.limit(1).withColumn(first, F.lit(level))).first()
        return row[f"{first}_hot"].toArray().tolist()

    assert sum(hot("a")) == sum(hot("b")) == sum(hot("few")) == 1 and len({tuple(hot(x)) for x in ("a", "b", "few")}) == 3
    assert sum(hot("NEVER_SEEN")) == 0


def test_tie_sums_in_blocks_equal_the_whole():
    from outturn.operators.hazard import _tie_sums

    q = np.arange(1000) / 1000
    r = 5000.0 - q * 900.0
    whole = [np.log(r).sum(), (1 / r).sum(), (q / r).sum(), (1 / r**2).sum(), (q / r**2).sum(), (q**2 / r**2).sum()]
    assert _tie_sums(5000.0, 900.0, 1000, block=64) == pytest.approx(np.array(whole), rel=1e-12)


def test_a_million_ties_stay_in_bounded_memory():
    import tracemalloc

    from outturn.operators.hazard import _derivatives

    ties, k = 1_000_000, 4
    one = [np.array([2.0 * ties]), np.ones((1, k)), np.ones((1, k, k))]
    sums = {"risk": one, "died": [a / 2 for a in one], "d": np.array([float(ties)]), "n": np.array([2.0 * ties]), "dx": np.ones((1, k))}
    tracemalloc.start()
    _derivatives(sums)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
