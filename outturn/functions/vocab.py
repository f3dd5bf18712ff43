"""Closed vocabularies and default horizons.

Fixed values: each has to equal the published vocabulary for results to agree.
"""

from __future__ import annotations

# -- forms and item codes ---------------------------------------------------
ANNOUNCEMENT_FORMS = ["DEFM14A", "PREM14A", "DEFM14C", "PREM14C", "SC 14D9", "SC 13E3"]
DEREGISTRATION_FORMS = ["25", "25-NSE", "15-12B", "15-12G"]
PERIODIC_FORMS = ["10-K", "10-K/A", "10-Q", "10-Q/A", "20-F", "40-F"]
ANNUAL_FORMS = ["10-K", "20-F", "40-F"]
CURRENT_REPORT_PREFIX = "8-K"

ITEM_MATERIAL_AGREEMENT = "1.01"
ITEM_TERMINATION = "1.02"
ITEM_COMPLETION = "2.01"
ITEM_CHANGE_CONTROL = "5.01"
ITEM_SHELL_STATUS = "5.06"
SHELL_SIC = "6770"

# -- outcome labels ---------------------------------------------------------
LABELS = [
    "completed",
    "completed_shell",
    "terminated",
    "acquirer_side",
    "pending",
    "unresolved",
    "not_registrant",
]
COMPLETED_LABELS = ["completed", "completed_shell"]
BREAK_LABELS = ["terminated"]
RESOLVED_LABELS = COMPLETED_LABELS + BREAK_LABELS
EXCLUDED_LABELS = ["acquirer_side", "not_registrant"]

# -- horizons, in days ------------------------------------------------------
EPISODE_GAP_DAYS = 545
RESOLUTION_DAYS = 900
SURVIVAL_DAYS = 365
PENDING_DAYS = 400
HISTORY_LEAD_DAYS = 1200
AGREEMENT_LOOKBACK_DAYS = 200
AGREEMENT_LOOKAHEAD_DAYS = 120
SURVIVAL_HORIZON_DAYS = 900
CURVE_DAYS = [90, 180, 365, 730]

# -- thresholds -------------------------------------------------------------
ITEM_COVERAGE_FLOOR = 0.5
BREAK_FEE_PCT_MAX = 20.0
PREMIUM_CEILING_PCT = 200.0
RECONCILE_TOLERANCE_PP = 1.5
GAIN_ON_COMPLETION = 3.0
LOSS_ON_BREAK = 20.0
EV_THRESHOLDS = [1.0, 0.005, 0.01, 0.02, 0.03, 0.05]
TOP_CATEGORIES = 15
FRAME_WINDOW_START = "2007-01-01"
FRAME_WINDOW_END = "2025-01-01"
SPLIT_YEAR = 2019
EVENTS_PER_PARAMETER = 10

# -- verdict, extraction and reconciliation statuses ------------------------
CONFIRMED = "confirmed"
UNRELATED = "unrelated"
UNCLEAR = "unclear"
NO_DOCUMENT = "no_document"
NO_SECTION = "no_section"
FETCH_FAILED = "fetch_failed"
NO_ANNOUNCEMENT_8K = "no_announcement_8k"
EXTRACTED = "extracted"
RETRYABLE = [FETCH_FAILED]
RECONCILED = "reconciled"
MISMATCH = "mismatch"
INSUFFICIENT = "insufficient"

# -- modelling columns ------------------------------------------------------
TERM_FIELDS = [
    "cash_per_share",
    "exchange_ratio",
    "stated_premium_pct",
    "termination_fee_usd",
    "parent_termination_fee_usd",
    "equity_value_usd",
]
FLAG_FIELDS = ["financing_condition", "go_shop", "hsr", "cfius", "tender_offer"]
COVERAGE_FIELDS = [
    "cash_per_share",
    "exchange_ratio",
    "stated_premium_pct",
    "unaffected_price",
    "termination_fee_usd",
    "parent_termination_fee_usd",
    "equity_value_usd",
    "outside_date",
    "financing_condition",
]
LEAKY_FIELDS = {
    "resolved_on",
    "days_to_resolution",
    "resolved_accession",
    "resolved_form",
    "resolved_document",
    "evidence",
    "label",
    "listed",
    "tickers",
    "exchanges",
}
NUMERIC_FEATURES = ["year", "break_fee_pct", "stated_premium_pct", "equity_value_usd"]
BINARY_FEATURES = [
    "tender_offer_filing",
    "going_private",
    "shell",
    "has_terms",
    "financing_condition",
    "hsr",
    "cfius",
]
CATEGORICAL_FEATURES = ["sector", "consideration"]
STRUCTURE_COVARIATES = ["tender_offer_filing", "going_private", "shell"]
TERM_COVARIATES = ["break_fee_pct", "financing_condition", "hsr", "stated_premium_pct"]

# -- reported-figure concepts: candidate tags in order of preference --------
CONCEPTS = {
    "revenue": [
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "Revenues",
        "SalesRevenueNet",
        "SalesRevenueGoodsNet",
    ],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "diluted_shares": [
        "WeightedAverageNumberOfDilutedSharesOutstanding",
        "WeightedAverageNumberOfSharesOutstandingBasicAndDiluted",
    ],
    "basic_shares": ["WeightedAverageNumberOfSharesOutstandingBasic"],
    "eps_diluted": ["EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted"],
    "operating_income": ["OperatingIncomeLoss"],
    "depreciation_amortisation": [
        "DepreciationDepletionAndAmortization",
        "DepreciationAmortizationAndAccretionNet",
        "DepreciationAndAmortization",
    ],
    "interest_expense": ["InterestExpense", "InterestIncomeExpenseNet", "InterestExpenseDebt"],
    "tax_expense": ["IncomeTaxExpenseBenefit"],
    "pretax_income": [
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
    ],
    "cash": [
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
    ],
    "total_debt_noncurrent": ["LongTermDebtNoncurrent", "LongTermDebt"],
    "total_debt_current": ["DebtCurrent", "LongTermDebtCurrent"],
    "equity": [
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ],
}
FACT_NAMESPACES = ["us-gaap", "ifrs-full", "dei"]

# -- default assumption ranges for sensitivity ------------------------------
ASSUMPTION_RANGES = {
    "pretax_synergies": (0.0, 300e6),
    "cash_consideration_pct": (0.0, 1.0),
    "cash_from_balance_sheet_pct": (0.0, 1.0),
    "new_debt_rate": (0.03, 0.10),
    "tax_rate": (0.15, 0.30),
    "synergy_phasing": (0.4, 1.0),
    "intangible_step_up": (0.0, 1_000e6),
    "transaction_fees": (10e6, 120e6),
    "forgone_cash_yield": (0.0, 0.05),
}

# -- slim exports -----------------------------------------------------------
DEAL_FIELDS = [
    "cik", "company", "sic_description", "tickers", "announced", "label",
    "resolved_on", "days_to_resolution", "announcement_forms", "evidence", "shell",
]
BREAK_FIELDS = [
    "cik", "company", "announced", "resolved_on", "days_to_resolution",
    "status", "reasons", "break_fee_usd", "document", "excerpt",
]
