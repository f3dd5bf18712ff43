"""Sections, verdicts, terms and passages on small notices."""

import pytest
from pyspark.sql import functions as F

from outturn.operators.breaks import classify, defined_terms, named_instrument
from outturn.operators.passages import locate_passages
from outturn.operators.sections import is_title_only, item_sections, section, section_body
from outturn.operators.terms import extract_terms, reconcile, terms_from_responses


def docs(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string")


def sections_of(spark, body):
    return item_sections(docs(spark, body)).first()["sections"]


def verdict(spark, body, use_document=True):
    split = item_sections(docs(spark, body)).withColumn("section", section("1.02"))
    return classify(split, document="body" if use_document else None).first()


def section_verdict(spark, text):
    df = spark.createDataFrame([(text,)], "section string")
    return classify(df, document=None).first()


def terms(spark, body):
    return reconcile(extract_terms(docs(spark, body))).first()


CONTENTS_FIRST = """Current report

Item 1.01 Entry into an Agreement
Item 1.02 Termination of an Agreement
Item 9.01 Exhibits

Item 1.01. Entry into an Agreement.

On 4 May 2012 Acme signed an agreement and plan of merger.

ITEM 1.02. TERMINATION OF AN AGREEMENT.

On 9 June 2013 the parties mutually agreed to end the merger agreement after the
regulator had declined, for the second time, to clear the transaction they proposed.

Item 9.01 Exhibits.

(d) none.
"""


def test_body_wins_over_contents_and_every_code_is_found(spark):
    found = sections_of(spark, CONTENTS_FIRST)
    assert set(found) == {"1.01", "1.02", "9.01"}
    assert "mutually agreed to end" in found["1.02"]
    assert "Exhibits" not in found["1.02"]
    assert "mutually agreed" not in found["1.01"]


def test_listed_headings_share_the_narrative(spark):
    listed = (
        "Item 1.01.\n\nEntry into an Agreement.\n\nItem 1.02\n\nTermination of an Agreement.\n\n"
        "Item 2.03.\n\nDirect Obligation.\n\nOn 7 July 2008 the company repaid its term loan "
        "and the term loan was terminated.\n"
    )
    found = sections_of(spark, listed)
    for code in ("1.01", "1.02", "2.03"):
        assert "repaid its term loan" in found[code]
    assert verdict(spark, listed)["status"] == "unrelated"


def test_trailing_headings_keep_their_own_text(spark):
    found = sections_of(spark, "Item 5.02 Departure\nOn 1 May 2010 he left.\nItem 9.01 Exhibits\n")
    assert found["9.01"] == "Item 9.01 Exhibits"


def test_heading_over_several_lines_and_mid_sentence_mention(spark):
    wrapped = "Part 1\n\nItem\n1.02\n\nTermination\nof an Agreement\n\nOn 2 May 2007 the merger agreement was terminated.\n"
    assert "2 May 2007" in sections_of(spark, wrapped)["1.02"]
    assert sections_of(spark, "as described in this Item 1.02 of the terms") == {}
    assert sections_of(spark, "no items at all") == {}


def test_longest_section_can_be_a_contents_entry_that_borrowed_text(spark):
    # Known behaviour of "longest wins": the listed 1.02 heading borrows the long 5.02
    # narrative below it, and that beats the short real section.
    text = (
        "Item 1.02 Termination\nItem 5.02 Departure\nOn 1 May 2010 "
        + "a director resigned from the board. " * 10
        + "\nItem 1.02 Termination\nOn 2 May 2010 the lease ended."
    )
    assert "director resigned" in sections_of(spark, text)["1.02"]


def test_title_only(spark):
    df = spark.createDataFrame(
        [("Item 1.02\n\nTermination of an Agreement.",), ("Item 1.01.\n\nOn 1 March 2019 they signed.",)],
        "s string",
    )
    assert [r[0] for r in df.select(is_title_only(F.col("s"))).collect()] == [True, False]


def test_section_body_drops_its_heading(spark):
    df = spark.createDataFrame([("Item 1.02. Termination of an Agreement.\nSomething\n  else.",)], "s string")
    assert df.select(section_body(F.col("s"))).first()[0] == "Something else."


def notice(text):
    return "Item 1.02. Termination of a Material Definitive Agreement.\n\n" + text


@pytest.mark.parametrize(
    "text, status",
    [
        ("The Agreement and Plan of Merger was terminated on 3 May 2011.", "confirmed"),
        ("The Company terminated its revolving credit agreement.", "unrelated"),
        ("Reference is made to the Merger Agreement above.", "unclear"),
        ("", "unclear"),
        ("The amalgamation agreement was terminated and the loan agreement was repaid.", "confirmed"),
        ("The loan agreement was terminated together with the merger agreement.", "unclear"),
        ("The Company terminated the Lease for its offices.", "unrelated"),
        ("The Partnership terminated the Olive Grove Purchase Agreement with Farms Inc.", "unrelated"),
        ("The parties terminated certain arrangements.", "unclear"),
        ("The equity incentive plan was terminated.", "unrelated"),
    ],
)
def test_status(spark, text, status):
    assert section_verdict(spark, notice(text))["status"] == status


def test_missing_section(spark):
    row = section_verdict(spark, None)
    assert row["status"] == "no_section"
    assert row["reasons"] == [] and row["evidence"] == [] and row["excerpt"] == ""


def test_reasons_fee_and_wrapped_text(spark):
    row = section_verdict(
        spark,
        notice(
            "The Merger Agreement was terminated after the Department of\nJustice sued and the "
            "requisite\nstockholder approval was not\nobtained. It paid a termination fee of $40.5 million."
        ),
    )
    assert row["status"] == "confirmed"
    assert row["reasons"] == ["regulatory", "shareholder_vote"]
    assert row["break_fee_usd"] == 40_500_000
    assert "Department of Justice" in row["excerpt"]
    plain = section_verdict(spark, notice("The loan agreement was terminated, termination fee $5 million."))
    assert plain["break_fee_usd"] is None


ABBREVIATED = (
    'On 9 March the Company entered into a Business Combination Agreement (the "BCA") with '
    'Bidco. It also amended its revolving credit agreement (the "Credit Line").\n\n'
    + notice("On 26 July the BCA was terminated by mutual consent.\n")
)


def test_own_abbreviations_are_resolved(spark):
    row = verdict(spark, ABBREVIATED)
    assert row["status"] == "confirmed"
    assert row["evidence"] == ["merger:BCA"]
    assert verdict(spark, ABBREVIATED, use_document=False)["status"] == "unclear"


def test_nearest_phrase_classifies_a_term(spark):
    df = docs(spark, ABBREVIATED, 'They issued a release (the "Release").',
              'The merger agreement (the "Pact") and the indenture (the "Pact").')
    got = [r[0] for r in df.orderBy("doc_id").select(defined_terms(F.col("body"))).collect()]
    assert (got[0]["merger"], got[0]["other"]) == (["BCA"], ["Credit Line"])
    assert (got[1]["merger"], got[1]["other"]) == ([], [])
    assert (got[2]["merger"], got[2]["other"]) == ([], [])


def test_many_definitions_use_the_whole_lookback(spark):
    # forty short definitions in a row: each context still reaches 160 characters back
    text = "the merger agreement " + "".join(f'("A{i:02d}") ' for i in range(40))
    got = docs(spark, text).select(defined_terms(F.col("body"))).first()[0]
    reach = 160
    expected, at = [], text.index('("A00")')
    for i in range(40):
        start = at + i * 8
        if text.rfind("merger agreement", max(0, start - reach), start) >= 0:
            expected.append(f"A{i:02d}")
    assert got["merger"] == expected and 0 < len(expected) < 40


def test_a_document_that_mentions_a_merger_blocks_the_instrument_rule(spark):
    text = "They signed an agreement and plan of merger.\n\n" + notice("The Escrow Agreement was terminated in May.")
    assert verdict(spark, text)["status"] == "unclear"
    assert verdict(spark, text, use_document=False)["evidence"] == ["other:The Escrow Agreement"]


def test_named_instrument(spark):
    df = docs(spark, "the Material Definitive Agreement ended", "the Termination Agreement was signed",
              "the Escrow Agreement ended")
    got = [r[0] for r in df.orderBy("doc_id").select(named_instrument(F.col("body"))).collect()]
    assert got == [None, None, "Escrow Agreement"]


CASH = """
Each share converts into the right to receive $58.50 per share
in cash. This is a premium of approximately 30.0% to the closing
price of the common stock of $45.00 on 14 February.
Acme will pay a termination fee of $95 million. Bidco would pay a reverse
termination fee of $190 million. The equity value of $3,100 million.
The deal is not subject to any financing condition and needs the
Hart-Scott-Rodino waiting period. The End Date is December 31, 2020.
"""


def test_cash_terms(spark):
    row = terms(spark, CASH)
    assert row["cash_per_share"] == 58.5 and row["unaffected_price"] == 45.0
    assert row["stated_premium_pct"] == 30.0 and row["premium_baseline"] == "close"
    assert row["termination_fee_usd"] == 95e6
    assert row["parent_termination_fee_usd"] == 190e6
    assert row["equity_value_usd"] == 3.1e9
    assert row["break_fee_pct"] == 3.065
    assert row["outside_date"] == "December 31, 2020"
    assert row["financing_condition"] is False
    assert row["hsr"] is True and row["cfius"] is False and row["go_shop"] is False
    assert row["consideration"] == "cash"
    assert row["reconciliation"]["status"] == "reconciled"
    assert row["reconciliation"]["absolute_error_pp"] == 0.0


def test_repeated_value_wins_and_scale_is_read_at_its_first_mention(spark):
    row = terms(
        spark,
        "Options cost $9.75 per share. Holders get $58.50 per share in cash. The $58.50 per share "
        "price is a 30.0% premium to the closing price of $45.00. Peers had a premium of 12.0% on average.",
    )
    assert row["cash_per_share"] == 58.5
    assert row["stated_premium_pct"] == 30.0 and row["premium_baseline"] == "close"
    assert row["reconciliation"]["status"] == "reconciled"


def test_average_baseline_and_implausible_premium(spark):
    row = terms(spark, "A premium of 20.5% to the average closing price of $14.11; holders get $17.00 in cash.")
    assert row["premium_baseline"] == "average"
    assert row["reconciliation"]["status"] == "insufficient"
    assert "average" in row["reconciliation"]["note"]
    assert terms(spark, "a 300.0% premium to the close")["stated_premium_pct"] is None
    assert terms(spark, "a nearly 30% premium to the close")["stated_premium_pct"] == 30.0


def test_unaffected_price_only_beside_the_premium(spark):
    row = terms(spark, "Bidco shares had a closing price of $73.01. Holders get $16.45 per share in cash.")
    assert row["unaffected_price"] is None


def test_stock_terms_mismatch_and_collision(spark):
    stock = terms(spark, "Each share becomes 0.4506 shares of Bidco common stock, a premium of about 12.5%.")
    assert stock["consideration"] == "stock" and stock["exchange_ratio"] == 0.4506
    off = terms(spark, CASH.replace("58.50", "85.50"))
    assert off["reconciliation"]["status"] == "mismatch"
    assert off["reconciliation"]["absolute_error_pp"] == 60.0
    same = terms(spark, CASH.replace("58.50", "45.00"))
    assert "misread" in same["reconciliation"]["note"]


def test_passages_are_located_merged_and_cut(spark):
    filler = "This statement is dated 1 March. " * 300
    text = filler + "Holders get $5 per share in cash. " + filler + "A termination fee applies. " + filler
    row = locate_passages(docs(spark, text, "nothing here")).orderBy("doc_id").collect()
    passages = row[0]["passages"]
    assert passages.count("[...]") == 1
    assert "$5 per share in cash" in passages and "termination fee applies" in passages
    assert len(passages) < len(text) / 10
    assert row[1]["passages"] == ""
    first = text.index("per share in cash")
    lo, hi = first - 350, first + len("per share in cash") + 350
    assert passages.split("\n[...]\n")[0] == text[lo:hi]
    cut = locate_passages(docs(spark, text), budget=800).first()["passages"].split("\n[...]\n")
    assert cut[0] == text[lo:hi] and len(cut[0]) + len(cut[1]) == 800


def test_structured_responses(spark):
    good = '{"cash_per_share": 58.5, "stated_premium_pct": 30.0, "premium_baseline": "close", "unaffected_price": 45.0, "termination_fee_usd": 95000000}'
    df = spark.createDataFrame(
        [(0, "The Hart-Scott-Rodino period applies.", good), (1, "text", "not json")],
        "doc_id int, body string, response string",
    )
    rows = reconcile(terms_from_responses(df)).orderBy("doc_id").collect()
    assert rows[0]["reconciliation"]["status"] == "reconciled" and rows[0]["hsr"] is True
    assert rows[1]["cash_per_share"] is None and rows[1]["stated_premium_pct"] is None
