"""Pro forma arithmetic against the published worked cases, and its identities."""


import pytest
from pyspark.sql import functions as F

from outturn.operators.scenario import company_metrics, pro_forma, validate, with_defaults
from outturn.operators.sensitivity import tornado, variance_decomposition

# Published results of the four worked cases.
ACQUIRER = dict(net_income=800e6, diluted_shares=400e6, share_price=50.0, cash=1e9, debt=2e9, ebitda=1.8e9, book_equity=5e9)
TARGET = dict(net_income=120e6, diluted_shares=100e6, share_price=20.0, cash=150e6, debt=600e6, ebitda=300e6, book_equity=900e6)
DEALS = {
    "base": dict(offer_per_share=26.0, cash_consideration_pct=0.6, cash_from_balance_sheet_pct=0.4,
                 pretax_synergies=100e6, transaction_fees=50e6, intangible_step_up=400e6),
    "all_cash": dict(offer_per_share=26.0),
    "all_stock": dict(offer_per_share=26.0, cash_consideration_pct=0.0, refinance_target_debt=False),
    "ruinous": dict(offer_per_share=80.0, new_debt_rate=0.09, transaction_fees=60e6, intangible_step_up=500e6),
}
PUBLISHED = {
    "base": (6.798954, 898_820_000, 420_800_000, 1.390909, 23_706_666.67, "pretax_synergies"),
    "all_cash": (-2.15625, 782_750_000, 400_000_000, 1.928571, 23_000_000, "pretax_synergies"),
    "all_stock": (2.018805, 922_250_000, 452_000_000, 0.690476, -24_333_333.33, "pretax_synergies"),
    "ruinous": (-61.490625, 308_075_000, 400_000_000, 4.528571, 655_900_000, "new_debt_rate"),
}


@pytest.fixture(scope="module")
def scenarios(spark):
    from outturn.operators.scenario import DEAL_DEFAULTS

    rows = []
    for name, deal in DEALS.items():
        row = {"scenario_id": name}
        row |= {f"a_{k}": v for k, v in ACQUIRER.items()} | {f"t_{k}": v for k, v in TARGET.items()}
        row |= {k: deal.get(k, v) for k, v in DEAL_DEFAULTS.items()} | {"offer_per_share": deal["offer_per_share"]}
        rows.append(row)
    return spark.createDataFrame(rows)


def test_published_cases(scenarios):
    for row in pro_forma(scenarios).collect():
        accretion, income, shares, leverage, breakeven, _ = PUBLISHED[row["scenario_id"]]
        assert row["accretion_pct"] == pytest.approx(accretion, rel=1e-6)
        assert row["pro_forma_net_income"] == pytest.approx(income, rel=1e-9)
        assert row["pro_forma_shares"] == pytest.approx(shares, rel=1e-9)
        assert row["pro_forma_net_debt_to_ebitda"] == pytest.approx(leverage, rel=1e-6)
        assert row["synergies_for_breakeven"] == pytest.approx(breakeven, rel=1e-8)
        assert row["balances"] is True
        if row["scenario_id"] == "all_stock":
            assert row["forgone_interest"] == pytest.approx(-2.25e6)


def test_breakeven_makes_the_deal_neutral(scenarios):
    solved = pro_forma(scenarios).select("scenario_id", "synergies_for_breakeven")
    again = scenarios.join(solved, "scenario_id").withColumn("pretax_synergies", F.col("synergies_for_breakeven"))
    for row in pro_forma(again.drop("synergies_for_breakeven")).collect():
        assert row["accretion_pct"] == pytest.approx(0.0, abs=1e-9)


def test_tornado_widest_swing(scenarios):
    rows = tornado(scenarios).orderBy("scenario_id", F.desc("swing_pp")).collect()
    for name, published in PUBLISHED.items():
        mine = [r for r in rows if r["scenario_id"] == name]
        assert len(mine) == 9 and mine[0]["assumption"] == published[5]
    base = {r["assumption"]: r for r in rows if r["scenario_id"] == "base"}
    assert base["pretax_synergies"]["accretion_at_low"] == pytest.approx(-2.1126425855513276)
    assert base["tax_rate"]["accretion_at_high"] == pytest.approx(6.966730038022817)


def test_decomposition_matches_published_shares(scenarios):
    row = variance_decomposition(scenarios.where("scenario_id = 'base'")).first()
    assert row["base_accretion_pct"] == pytest.approx(6.798954372623567)
    shares = row["share_of_variance"]
    for name, share in dict(pretax_synergies=0.6197, intangible_step_up=0.1369, synergy_phasing=0.1155, new_debt_rate=0.0877).items():
        assert shares[name] == pytest.approx(share, abs=1e-4)
    assert sum(shares.values()) == pytest.approx(1.0)
    assert row["dominant"][:2] == ["pretax_synergies", "intangible_step_up"]
    assert row["linear_r_squared"] > 0.8 and row["p5"] < row["mean_accretion_pct"] < row["p95"]


def test_constant_assumption_explains_nothing(scenarios):
    row = variance_decomposition(
        scenarios.limit(1), ranges={"pretax_synergies": (0.0, 1e8), "tax_rate": (0.25, 0.25)}, samples=200
    ).first()
    assert row["share_of_variance"]["tax_rate"] == 0.0
    assert row["share_of_variance"]["pretax_synergies"] == pytest.approx(1.0)


def test_validation_and_metrics(scenarios):
    bad = scenarios.withColumn("tax_rate", F.lit(1.0)).withColumn("a_diluted_shares", F.lit(0.0))
    valid, rejected = validate(scenarios.unionByName(bad))
    assert valid.count() == 4
    assert rejected.first()["problems"] == ["tax_rate must be in [0, 1)", "a_diluted_shares must be positive"]
    row = company_metrics(bad, "a_").first()
    assert row["a_eps"] is None and row["a_market_cap"] == 0.0
    assert with_defaults(scenarios.drop("tax_rate")).first()["tax_rate"] == 0.25
