"""Deal terms read from announcement text, checked against the text's own arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions import patterns as P
from outturn.functions import vocab
from outturn.functions.lineage import cut
from outturn.functions.text import (
    all_matches, amount, first_match, flatten, fold, let, match_start, may_match, money, most_repeated,
    read_once, scale_factor, with_parts,
)
from outturn.operators.documents import only_wanted

_MODEL_FIELDS = """
cash_per_share double, exchange_ratio double, stated_premium_pct double,
premium_baseline string, unaffected_price double, termination_fee_usd double,
parent_termination_fee_usd double, equity_value_usd double, outside_date string
"""


def cash_per_share(flat: Column, part: Column) -> Column:
    """The price the document repeats, scaled by the word after its first mention; ``part`` holds all matches."""

    def scaled(price: Column) -> Column:
        after = F.substring(flat, F.position(price, flat) + F.length(price), F.lit(12))
        return amount(price) * scale_factor(F.regexp_extract(after, P.SCALE_WORD, 1))

    return let(most_repeated(all_matches(part, P.CASH_PER_SHARE, 1))["value"], scaled)


def premium(flat: Column) -> Column:
    """struct(value, at, matches): the most repeated plausible premium, either word order."""

    def figure(match: Column) -> Column:
        text = F.coalesce(first_match(match, P.PREMIUM, 1), first_match(match, P.PREMIUM, 2))
        number = text.try_cast("double")
        return F.when((number > 0) & (number <= vocab.PREMIUM_CEILING_PCT), text)

    def chosen(matches: Column) -> Column:
        best = most_repeated(F.transform(matches, lambda m: let(m, figure)))
        return let(
            best,
            lambda b: F.struct(b["value"].alias("value"), b["at"].alias("at"), matches.alias("matches")),
        )

    return let(all_matches(flat, P.PREMIUM), chosen)


def flags(flat: Column, lowered: Column) -> dict[str, Column]:
    def says(pattern: str) -> Column:
        return may_match(lowered, pattern) & flat.rlike(pattern)

    return {
        "financing_condition": F.when(says(P.NO_FINANCING_CONDITION), False).when(
            says(P.FINANCING_CONDITION), True
        ),
        "go_shop": says(P.GO_SHOP),
        "hsr": says(P.HSR),
        "cfius": says(P.CFIUS),
        "tender_offer": says(P.TENDER_OFFER),
    }


def extract_terms(documents: DataFrame, text: str = "body") -> DataFrame:
    """Adds the term columns, ``consideration`` and ``break_fee_pct`` to each document."""
    kept = documents.columns
    flat = F.col("_flat")
    found = F.col("_premium")
    at = F.col("_premium_start")
    end = at + F.length(F.get(found["matches"], found["at"]))
    sentence = F.substring_index(
        F.substring(flat, end + 1, F.lit(P.BASELINE_WINDOW)), ".", 1
    )
    beside = F.substring(flat, at + 1, end - at + P.PREMIUM_CONTEXT)
    stated = found["value"].isNotNull()
    lowered = F.col("_lowered")

    read = documents.withColumn("_flat", flatten(F.col(text))).withColumn("_lowered", fold(flat))
    read, parts = with_parts(read, "_flat", "_lowered", list(P.REACH))
    first, beside_premium = parts[P.PREMIUM]

    def where_possible(pattern: str, value: Callable[[Column], Column]) -> Column:
        part = parts[pattern][1]
        return F.when(part.isNotNull(), value(part))

    def fee(pattern: str) -> Column:
        return where_possible(pattern, lambda part: money(part, pattern))

    flattened = (
        read.withColumn("_premium", where_possible(P.PREMIUM, premium))
        .withColumn(
            "_premium_start",
            F.when(stated, first + match_start(beside_premium, P.PREMIUM, found["at"], found["matches"])),
        )
    )
    baseline = F.when(stated & sentence.rlike(P.AVERAGE_BASELINE), "average").when(stated, "close")
    figures = {
        "chars": F.length(text),
        "cash_per_share": where_possible(P.CASH_PER_SHARE, lambda part: cash_per_share(flat, part)),
        "exchange_ratio": where_possible(
            P.EXCHANGE_RATIO, lambda part: F.regexp_extract(part, P.EXCHANGE_RATIO, 1).try_cast("double")
        ),
        "stated_premium_pct": found["value"].cast("double"),
        "unaffected_price": F.when(stated, amount(F.regexp_extract(beside, P.UNAFFECTED, 1))),
        "premium_baseline": baseline,
        "termination_fee_usd": fee(P.TERMINATION_FEE),
        "parent_termination_fee_usd": fee(P.PARENT_FEE),
        "equity_value_usd": fee(P.EQUITY_VALUE),
        "outside_date": where_possible(P.OUTSIDE_DATE, lambda part: first_match(part, P.OUTSIDE_DATE, 1)),
    }
    return derive(read_once(flattened, kept, figures | flags(flat, F.col("_lowered"))))


def terms_from_responses(responses: DataFrame, text: str = "body", payload: str = "response") -> DataFrame:
    """Terms from a structured response per document; unreadable JSON yields no fields.

    The keyword flags still come from the text. The response table is produced outside.
    """
    kept = [c for c in responses.columns if c != payload]
    flat = F.col("_flat")
    parsed = F.from_json(F.col(payload), _MODEL_FIELDS, {"mode": "PERMISSIVE"})
    fields = [f.split()[0] for f in _MODEL_FIELDS.split(",")]
    flattened = responses.withColumns({"_flat": flatten(F.col(text)), "_parsed": parsed}).withColumn(
        "_lowered", fold(flat)
    )
    figures = {"chars": F.length(text), **{f: F.col("_parsed")[f] for f in fields}}
    return derive(read_once(flattened, kept, figures | flags(flat, F.col("_lowered"))))


def _present(name: str) -> Column:
    """A figure that is neither missing nor zero."""
    return F.coalesce(F.col(name) != 0, F.lit(False))


def derive(terms: DataFrame) -> DataFrame:
    cash, ratio = _present("cash_per_share"), _present("exchange_ratio")
    consideration = (
        F.when(cash & ratio, "cash_and_stock").when(cash, "cash").when(ratio, "stock")
        .otherwise("unknown")
    )
    pct = F.when(
        _present("termination_fee_usd") & _present("equity_value_usd"),
        F.round(100 * F.col("termination_fee_usd") / F.col("equity_value_usd"), 3),
    )
    return terms.withColumns({"consideration": consideration, "break_fee_pct": pct})


def reconcile(terms: DataFrame, tolerance_pp: float = vocab.RECONCILE_TOLERANCE_PP) -> DataFrame:
    """Adds ``reconciliation``: does consideration over unaffected price give the premium?"""
    cash, price = F.col("cash_per_share"), F.col("unaffected_price")
    stated = F.col("stated_premium_pct")
    implied = 100 * (cash / price - 1)
    error = F.abs(implied - stated)

    def result(status: str | Column, note: str, checked: bool = False) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(
            (F.lit(status) if isinstance(status, str) else status).alias("status"),
            (F.round(implied, 2) if checked else none).alias("implied_premium_pct"),
            (stated if checked else none).alias("stated_premium_pct"),
            (F.round(error, 2) if checked else none).alias("absolute_error_pp"),
            F.lit(note).alias("note"),
        )

    insufficient = vocab.INSUFFICIENT
    check = (
        F.when(
            cash.isNull() | price.isNull() | (price == 0),
            result(insufficient, "no cash price or no unaffected price found"),
        )
        .when(
            cash == price,
            result(
                insufficient,
                "unaffected price equals the consideration, so one of them is a misread",
            ),
        )
        .when(stated.isNull(), result(insufficient, "no stated premium found"))
        .when(
            F.col("premium_baseline") == "average",
            result(insufficient, "premium quoted against an average, not the unaffected close"),
        )
        .when(error <= tolerance_pp, result(vocab.RECONCILED, "", checked=True))
        .otherwise(
            result(
                vocab.MISMATCH,
                "extracted figures do not satisfy the document's own arithmetic",
                checked=True,
            )
        )
    )
    return terms.withColumn("reconciliation", check)


def deterministic(documents: DataFrame) -> DataFrame:
    """The pattern extractor: documents in, term columns out."""
    return extract_terms(documents).withColumn("extractor", F.lit("deterministic"))


def structured(documents: DataFrame) -> DataFrame:
    """The response-table extractor: documents with a ``response`` in, term columns out."""
    return terms_from_responses(documents).withColumn("extractor", F.lit("model"))


def extract_for_episodes(
    episodes: DataFrame,
    documents: DataFrame,
    extractor: Callable[[DataFrame], DataFrame] = deterministic,
    source: str = "8k",
) -> DataFrame:
    """Terms rows for episodes: status, term columns and reconciliation.

    ``episodes`` carry cik, company, announced, label and the accession of the document
    to read (null when there is no announcement report); ``documents`` hold accession,
    document, press_release and body. Any extractor of that shape can be passed.
    """
    texts = documents.select(
        "accession", "document", "press_release", "body",
        *[c for c in ("response",) if c in documents.columns],
    )
    wanted = cut(episodes.select("cik", "company", "announced", "label", "accession"))
    joined = wanted.join(only_wanted(texts, wanted, ["accession"]), "accession", "left")
    status = (
        F.when(F.col("accession").isNull(), vocab.NO_ANNOUNCEMENT_8K)
        .when(F.col("body").isNull(), vocab.NO_DOCUMENT)
        .otherwise(vocab.EXTRACTED)
    )
    read = reconcile(extractor(joined.withColumn("status", status)))
    return read.withColumn("source", F.lit(source)).drop("body")
