"""Patterns run over the part of a text near their words, and a found row is made by a compiled step."""

import random

from pyspark.sql import functions as F

from outturn.functions import patterns as P
from outturn.functions.text import all_matches, flatten, fold, has_word, match_start, most_repeated, with_parts
from outturn.operators.terms import extract_terms

_BITS = [
    "premium of ", "approximately ", "12.5", "% ", "7", " percent", " premium", "a ", "an about ", "1234", "$", "$ 9.75 ", "per share", " in cash",
    " for each share", "in caſh", "0.1234 ", "shares of ", "validly issued, fully paid and nonassessable ", "Parent common stocK", "common stock",
    "company ", "Company", "parent ", "reverse ", "termination fee", " of ", " equal to ", "$10", " million", "equity value", "enterprise value",
    " transaction valued ", '"Outside Date"', "end date ", " June 30, 2016", ". ", "\n\n", "  ", " ", "\U0001f600", "İ", "ı", "other words ",
]


def test_parts_hold_all_matches(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(_BITS) for _ in range(draw.randrange(1, 90))) for _ in range(1500)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("flat", flatten(F.col("text")))
    rows, parts = with_parts(rows.withColumn("lowered", fold(F.col("flat"))), "flat", "lowered", list(P.REACH))
    none = F.array().cast("array<string>")
    found = {}
    for i, (pattern, (first, part)) in enumerate(parts.items()):
        whole, here = all_matches(F.col("flat"), pattern), F.coalesce(all_matches(part, pattern), none)
        at = F.when(F.size(whole) > 0, F.size(whole) - 1)
        found |= {
            f"n{i}": F.coalesce(F.size(whole), F.lit(0)), f"same{i}": F.coalesce(whole, none) == here,
            f"at{i}": match_start(F.col("flat"), pattern, at, whole).eqNullSafe(first + match_start(part, pattern, at, here)) | at.isNull(),
        }
    got = rows.select(*[c.alias(n) for n, c in found.items()]).collect()
    for i in range(len(parts)):
        assert sum(r[f"n{i}"] > 0 for r in got) > 3
        assert all(r[f"same{i}"] and r[f"at{i}"] for r in got)


def test_words_are_found_by_a_rare_end(spark):
    words = sorted({w for of in P.NEEDED_WORDS.values() for w in of})
    texts = [x for w in words for x in (w, f"so {w}s", w[1:], w[:-1], f"{w[1:]} {w}", "")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(*[(has_word(F.col("t"), w) == F.col("t").contains(w)).alias(f"w{i}") for i, w in enumerate(words)]).collect()
    assert all(all(r) for r in got)


def test_a_single_value_is_the_most_repeated(spark):
    rows = spark.createDataFrame([(["x"],), ([None],), ([],), (None,), (["b", None, "a", "a"],)], "v array<string>")
    got = [r[0] and tuple(r[0]) for r in rows.select(most_repeated(F.col("v"))).collect()]
    assert got == [("x", 0), None, None, None, ("a", 2)]


def test_no_pattern_stands_in_the_generator(spark):
    rows = spark.createDataFrame([("x", "a premium of 9%, the termination fee of $1 million")], "doc_id string, body string")
    plan = extract_terms(rows)._jdf.queryExecution().optimizedPlan().toString()
    generator = next(line for line in plan.splitlines() if "Generate inline" in line)
    assert "regexp" not in generator and "Contains" not in generator and "Filter" not in plan
