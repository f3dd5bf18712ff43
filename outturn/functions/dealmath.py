"""Merger arithmetic, written once for Columns and for numpy vectors.

``Ops`` holds the three functions the two worlds spell differently.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Callable

import numpy as np
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ops:
    least: Callable[[Any, Any], Any]
    greatest: Callable[[Any, Any], Any]
    choose: Callable[[Any, Any, Any], Any]


def _lit(x: Any) -> Any:
    return F.lit(x) if isinstance(x, (int, float)) else x


COLUMNS = Ops(
    lambda a, b: F.least(_lit(a), _lit(b)),
    lambda a, b: F.greatest(_lit(a), _lit(b)),
    lambda c, a, b: F.when(c, _lit(a)).otherwise(_lit(b)),
)


def _choose(condition: Any, a: Any, b: Any) -> Any:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(condition, a, b)


VECTORS = Ops(np.minimum, np.maximum, _choose)


def funding(x: dict[str, Any], ops: Ops) -> dict[str, Any]:
    """Sources and uses. Cash left over lowers the balance-sheet draw, below zero if it must."""
    equity = x["offer_per_share"] * x["t_diluted_shares"]
    cash = equity * x["cash_consideration_pct"]
    refinanced = ops.choose(x["refinance_target_debt"], x["t_debt"], 0.0)
    needed = cash + refinanced + x["transaction_fees"]
    drawn = ops.least(needed * x["cash_from_balance_sheet_pct"], ops.greatest(x["a_cash"], 0.0))
    shortfall = needed - drawn - x["t_cash"]
    return {
        "equity_purchase_price": equity,
        "target_debt_refinanced": refinanced,
        "cash_from_balance_sheet": drawn + ops.least(shortfall, 0.0),
        "new_debt": ops.greatest(shortfall, 0.0),
        "new_equity": equity - cash,
        "target_cash_acquired": x["t_cash"],
    }


def earnings(x: dict[str, Any], f: dict[str, Any], ops: Ops) -> dict[str, Any]:
    """Pro forma earnings per share and what moved them. ``f`` is the funding."""
    kept = 1.0 - x["tax_rate"]
    synergies = x["pretax_synergies"] * x["synergy_phasing"] * kept
    interest = f["new_debt"] * x["new_debt_rate"] * kept
    forgone = f["cash_from_balance_sheet"] * x["forgone_cash_yield"] * kept
    has_life = x["intangible_life_years"] > 0
    life = ops.choose(has_life, x["intangible_life_years"], 1.0)
    amortisation = ops.choose(has_life, x["intangible_step_up"] / life * kept, 0.0)
    income = x["a_net_income"] + x["t_net_income"] + synergies - interest - forgone - amortisation
    priced = x["a_share_price"] > 0
    issued = ops.choose(priced, f["new_equity"] / ops.choose(priced, x["a_share_price"], 1.0), 0.0)
    shares = x["a_diluted_shares"] + issued
    standalone = x["a_net_income"] / x["a_diluted_shares"]
    eps = income / shares
    return {
        "shares_issued": issued,
        "pro_forma_shares": shares,
        "pro_forma_net_income": income,
        "pro_forma_eps": eps,
        "acquirer_standalone_eps": standalone,
        "accretion_pct": 100.0 * (eps / standalone - 1.0),
        "after_tax_synergies": synergies,
        "incremental_interest": interest,
        "forgone_interest": forgone,
        "incremental_amortisation": amortisation,
    }
