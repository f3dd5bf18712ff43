"""Patterns behind a test of their first character find what they find without it, and are tried at few places."""

import random
import re

import pytest
from pyspark.sql import functions as F

from outturn.functions import patterns as P
from outturn.functions.text import first_match, flatten, fold, may_match
from outturn.operators.sections import is_title_only

GUARDED = {
    name: getattr(P, name)
    for name in ("MERGER_AGREEMENT", "OTHER_AGREEMENT", "TERMINATION", "BREAK_FEE", "PREMIUM", "TERMINATION_FEE", "PARENT_FEE", "EQUITY_VALUE", "OUTSIDE_DATE", "ANCHORS")
} | P.REASONS
SAID = """merger agreement|the  transaction agreement|plan of arrangement|credit agreement|management agreement|at-the-market|equity incentive plan
|lease termination agreement|senior notes|swap agreement|terminated|mutually agreed to end|withdrawn|expired without|hart-scott-rodino|second request
|failed to obtain any antitrust|unsolicited proposal|shareholders did not approve|the requisite|debt financing failed|by the end date|material adverse change
|mutual consent|break-up fee of $3 million|premium of about 20%|a 3.5 percent premium|9% premium|company termination fee of $4|reverse termination fee equal to $5
|enterprise value is $6.5 billion|"outside date", June 3, 2016|go-shop|no shop|per share in cash|unaffected|exchange ratio""".replace("\n", "").split("|")


def texts(n=600):
    r = random.Random(5)
    odd = ["", " ", "  ", "\t", "\n", "x", "_", "7", "́", "ſ", "K", "ı", "İ", " ", " ", "​", "٣", "\x1c", "\x85", "(", "“", "é"]
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(1, 6)):
            w = r.choice(SAID)
            w = r.choice([str, str.upper, str.title])(w)
            if r.random() < 0.2:
                w = w.replace("s", "ſ").replace("k", "K").replace("i", r.choice("ıİ"))
            words += [r.choice(odd), w, r.choice(odd)]
        out.append("".join(words))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(t,) for t in texts()] + [(None,)], "t string").cache()


@pytest.mark.parametrize("name", GUARDED)
def test_a_guarded_pattern_finds_the_same(rows, name):
    pattern = GUARDED[name]
    assert pattern.startswith("(?![")
    plain = re.sub(r"^\(\?!\[.*?\]\)(\(\?<!\[A?\w+\]\))?", "", pattern, count=1)
    assert plain.startswith("(?iU)")
    every = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (pattern, plain)]
    assert rows.where(~every[0].eqNullSafe(every[1])).count() == 0
    assert rows.where(F.size(every[1]) > 0).count() > 0
    if pattern in P.NEEDED_WORDS:
        assert rows.where(F.col("t").rlike(plain) & ~may_match(fold(F.col("t")), pattern)).count() == 0


def test_flatten_leaves_what_the_plain_class_leaves(rows):
    plain = rf"[{P.INLINE_SPACE[2:-1]}\n][{P.SPACE_CHARS}]*| [{P.SPACE_CHARS}]+"
    assert rows.where(~flatten(F.col("t")).eqNullSafe(F.regexp_replace("t", plain, " "))).count() == 0
    assert rows.where(flatten(F.col("t")) != F.col("t")).count() > 100


def test_a_first_match_and_a_title_are_read_as_before(spark):
    rows = spark.createDataFrame(
        [("Item 1.02. Termination.", True), ("Item 1.02. Termination.\n \n", True), ("Item 1.02. T.\nfew words", True), ("Item 1.02. T.\non 3 May", False),
         ("Item 1.02. T.\n" + "w " * 100, False), ("Item 1.02. T.\n" + " " * 200 + "w", True), (None, None)], "t string, title boolean")
    assert rows.where(~is_title_only(F.col("t")).eqNullSafe(F.col("title"))).count() == 0
    found = rows.select(first_match(F.col("t"), r"T\.").alias("m")).collect()
    assert [r.m for r in found] == [None, None, "T.", "T.", "T.", "T.", None]
