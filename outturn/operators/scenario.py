"""Pro forma consequences of many deal scenarios, one row each.

A scenario row has the acquirer's figures (``a_*``), the target's (``t_*``) and the deal's
assumptions: offer_per_share, cash_consideration_pct, cash_from_balance_sheet_pct,
new_debt_rate, forgone_cash_yield, tax_rate, pretax_synergies, synergy_phasing,
transaction_fees, refinance_target_debt, intangible_step_up, intangible_life_years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions.dealmath import COLUMNS, earnings, funding

COMPANY_FIELDS = [
    "net_income", "diluted_shares", "share_price", "cash", "debt", "ebitda", "book_equity",
]
DEAL_DEFAULTS = {
    "cash_consideration_pct": 1.0,
    "cash_from_balance_sheet_pct": 0.0,
    "new_debt_rate": 0.06,
    "forgone_cash_yield": 0.02,
    "tax_rate": 0.25,
    "pretax_synergies": 0.0,
    "synergy_phasing": 1.0,
    "transaction_fees": 0.0,
    "refinance_target_debt": True,
    "intangible_step_up": 0.0,
    "intangible_life_years": 10.0,
}
INPUTS = [
    *[f"a_{f}" for f in COMPANY_FIELDS], *[f"t_{f}" for f in COMPANY_FIELDS],
    "offer_per_share", *DEAL_DEFAULTS,
]
FUNDING = [
    "equity_purchase_price", "target_debt_refinanced", "cash_from_balance_sheet",
    "new_debt", "new_equity", "target_cash_acquired",
]


def with_defaults(scenarios: DataFrame) -> DataFrame:
    """Fills assumptions and company figures the table does not have."""
    known = DEAL_DEFAULTS | {f"{side}_{n}": 0.0 for side in "at" for n in ("cash", "debt", "ebitda", "book_equity")}
    missing = {n: F.lit(v) for n, v in known.items() if n not in scenarios.columns}
    return scenarios.withColumns(missing) if missing else scenarios


def _problems() -> Column:
    def outside(name: str) -> Column:
        return F.when(~F.coalesce(F.col(name).between(0.0, 1.0), F.lit(False)), f"{name} must be between 0 and 1")

    def not_positive(name: str) -> Column:
        return F.when(~F.coalesce(F.col(name) > 0, F.lit(False)), f"{name} must be positive")

    return F.array_compact(
        F.array(
            outside("cash_consideration_pct"),
            outside("cash_from_balance_sheet_pct"),
            outside("new_debt_rate"),
            outside("forgone_cash_yield"),
            outside("synergy_phasing"),
            F.when(
                ~F.coalesce((F.col("tax_rate") >= 0) & (F.col("tax_rate") < 1), F.lit(False)),
                "tax_rate must be in [0, 1)",
            ),
            not_positive("a_diluted_shares"),
            not_positive("t_diluted_shares"),
            not_positive("a_share_price"),
            not_positive("t_share_price"),
            not_positive("offer_per_share"),
            not_positive("intangible_life_years"),
        )
    )


def validate(scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); rejected rows say why in ``problems``."""
    checked = scenarios.withColumn("problems", _problems())
    return (
        checked.where(F.size("problems") == 0).drop("problems"),
        checked.where(F.size("problems") > 0),
    )


def company_metrics(companies: DataFrame, prefix: str = "") -> DataFrame:
    """Adds eps and market_cap; eps is null when there are no shares."""
    shares = F.col(f"{prefix}diluted_shares")
    return companies.withColumns(
        {
            f"{prefix}eps": F.col(f"{prefix}net_income") / F.nullif(shares, F.lit(0.0)),
            f"{prefix}market_cap": F.col(f"{prefix}share_price") * shares,
        }
    )


def premium_pct(offer: Column, unaffected: Column) -> Column:
    """Null when the unaffected price is not positive."""
    return F.when(unaffected > 0, 100.0 * (offer / unaffected - 1.0))


def inputs(overrides: dict[str, Column] | None = None) -> dict[str, Column]:
    return {n: F.col(n) for n in INPUTS} | (overrides or {})


def pro_forma(scenarios: DataFrame) -> DataFrame:
    """Adds sources and uses, pro forma earnings, leverage and the synergy break-even."""
    x = inputs()
    funded = scenarios.withColumns(funding(x, COLUMNS))
    f = {n: F.col(n) for n in FUNDING}
    earned = funded.withColumns(earnings(x, f, COLUMNS))
    uses = f["equity_purchase_price"] + f["target_debt_refinanced"] + x["transaction_fees"]
    sources = (
        f["cash_from_balance_sheet"] + f["new_debt"] + f["new_equity"] + f["target_cash_acquired"]
    )
    phased = x["pretax_synergies"] * x["synergy_phasing"]
    ebitda = x["a_ebitda"] + x["t_ebitda"] + phased
    kept_debt = F.when(x["refinance_target_debt"], 0.0).otherwise(x["t_debt"])
    net_debt = (
        x["a_debt"] + f["new_debt"] + kept_debt
        - F.greatest(x["a_cash"] - f["cash_from_balance_sheet"], F.lit(0.0))
    )
    # earnings are linear in synergies and the share count does not depend on them
    required = (
        F.col("acquirer_standalone_eps") * F.col("pro_forma_shares")
        - (F.col("pro_forma_net_income") - F.col("after_tax_synergies"))
    )
    reach = (1.0 - x["tax_rate"]) * x["synergy_phasing"]
    return earned.withColumns(
        {
            "total_uses": uses,
            "total_sources": sources,
            "premium_pct": premium_pct(x["offer_per_share"], x["t_share_price"]),
            "goodwill": f["equity_purchase_price"] - x["t_book_equity"] - x["intangible_step_up"],
            "pro_forma_net_debt": net_debt,
            "pro_forma_net_debt_to_ebitda": F.when(ebitda > 0, net_debt / F.nullif(ebitda, F.lit(0.0))),
            "synergies_for_breakeven": required / F.nullif(reach, F.lit(0.0)),
        }
    ).withColumn("balances", F.abs(F.col("total_sources") - F.col("total_uses")) < 1.0)
