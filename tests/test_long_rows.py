"""Rows with many thousands of headings or anchors are read in seconds, with the results of short ones."""

import time


from outturn.functions import patterns as P
from outturn.operators.passages import locate_passages
from outturn.operators.sections import item_sections


def docs(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string")


def brute_sections(parts):
    """The longest text of each code: a heading without text takes the next narrative below it, the first wins a tie."""
    best, following = {}, None
    bodies = []
    for code, heading, told in reversed(parts):
        body = heading + told
        if not told:
            body = f"{body}\n{following}" if following is not None else body
        else:
            following = body
        bodies.append((code, body))
    for code, body in reversed(bodies):
        if code not in best or len(body) > len(best[code]):
            best[code] = body
    return best


def test_twenty_thousand_headings(spark):
    parts = []
    for i in range(20_000):
        code = f"{i * 7 % 97}.{i % 13:02d}"
        told = "" if i % 5 else f"\n\nOn day {i * 31 % 1009} {'x' * (i * 17 % 23)} was told."
        parts.append((code, f"Item {code}. Heading.", told))
    text = "\n\n".join(heading + told for _, heading, told in parts)
    start = time.time()
    found = item_sections(docs(spark, text)).select("sections").first()["sections"]
    assert time.time() - start < 40
    assert found == brute_sections(parts)


def test_without_headings_and_null(spark):
    rows = item_sections(docs(spark, None, "", "no heading")).orderBy("doc_id").collect()
    assert [r["sections"] for r in rows] == [None, {}, {}]


def test_twenty_thousand_anchors(spark):
    text = "".join(f"{'y' * 750} outside date {i}." for i in range(20_000))
    start = time.time()
    found = locate_passages(docs(spark, text)).select("passages").first()["passages"]
    assert time.time() - start < 40
    pieces = found.split(P.PASSAGE_JOIN)
    assert sum(map(len, pieces)) == P.PASSAGE_BUDGET
    assert [f" {i}." in p for i, p in enumerate(pieces[:-1])] == [True] * (len(pieces) - 1)
    assert len(pieces) == -(-P.PASSAGE_BUDGET // (P.PASSAGE_WINDOW + len("outside date")))


def test_budget_met_exactly(spark):
    body = "outside date" + "z" * 1000 + "outside date" + "z" * 1000 + "outside date"
    short = locate_passages(docs(spark, body), budget=362).select("passages").first()["passages"]
    assert short.startswith("outside date") and short.replace(P.PASSAGE_JOIN, "") == body[:362]
    assert locate_passages(docs(spark, body), budget=10_000).select("passages").first()["passages"].count("outside date") == 3
