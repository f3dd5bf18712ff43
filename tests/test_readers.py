"""Readers on files written by the test."""

import json

from pyspark.sql import functions as F

from outturn.functions import forms
from outturn.sources import facts, index, markup, submissions, tables

INDEX = """Description:   Index

Form Type   Company Name        CIK         Date Filed  File Name
-----------------------------------------------------------------
1-A              Cedar Holdings, Inc.               1001463     2020-01-29  edgar/data/1001463/0001185185-20-000088.txt
SC 14D9          Quill\xe9 Technologies, Inc             1591890     2020-02-20  edgar/data/1591890/0001193125-20-042128.txt
SC 13E3/A        Pine Inc.                          1649749     2020-01-06  edgar/data/1649749/0001193125-20-001745.txt

not a row at all
"""


def test_index_files(spark, tmp_path):
    (tmp_path / "q1.idx").write_bytes(INDEX.encode("latin-1"))
    (tmp_path / "q2.idx").write_bytes(INDEX.encode("latin-1"))
    scanned = index.scan_index(index.read_lines(spark, str(tmp_path)))
    kept = index.kept_rows(scanned, forms.is_announcement(F.col("form"))).where("file like '%q1.idx'").orderBy("form").collect()
    assert [r["form"] for r in kept] == ["SC 13E3/A", "SC 14D9"]
    assert kept[1]["company"] == "Quill\xe9 Technologies, Inc" and kept[1]["accession"] == "0001193125-20-042128"
    counts = index.scan_counts(scanned).collect()
    assert len(counts) == 2 and all((r["seen"], r["unparsed"]) == (4, 1) for r in counts)
    assert index.rejected_lines(scanned).first()["line"] == "not a row at all"
    index.write_quarters(index.kept_rows(scanned, F.lit(True)), str(tmp_path / "slim"))
    present = spark.read.parquet(str(tmp_path / "slim"))
    assert index.missing_quarters(index.quarters(spark, 2020, 2020), present).count() == 3


def test_histories_with_pages(spark, tmp_path):
    block = {"form": ["8-K", "10-K"], "filingDate": ["2020-05-01", "2020-02-01"], "items": ["1.01", None], "accessionNumber": ["x", "y"]}
    company = {
        "cik": "0000000042", "name": "Acme", "sic": "3571", "tickers": ["ACM"],
        "filings": {"recent": block, "files": [
            {"name": "p1.json", "filingTo": "2010-12-31"}, {"name": "p2.json", "filingTo": "1999-12-31"}]},
    }
    (tmp_path / "main").mkdir()
    (tmp_path / "pages").mkdir()
    (tmp_path / "main" / "c.json").write_text(json.dumps(company))
    for name, day in (("p1.json", "2010-01-01"), ("p2.json", "1999-01-01")):
        (tmp_path / "pages" / name).write_text(json.dumps({"form": ["10-Q"], "filingDate": [day], "accessionNumber": [name]}))
    histories = submissions.read_histories(spark, str(tmp_path / "main"))
    pages = submissions.read_pages(spark, str(tmp_path / "pages"))
    everything = submissions.filing_history(histories, pages)
    assert {r["accession"] for r in everything.collect()} == {"x", "y", "p1.json", "p2.json"}
    since = spark.createDataFrame([(42, "2005-01-01")], "cik bigint, s string").select("cik", F.col("s").cast("date").alias("since"))
    rows = {r["accession"]: r for r in submissions.filing_history(histories, pages, since).collect()}
    assert set(rows) == {"x", "y", "p1.json"}
    assert rows["y"]["items"] == "" and rows["x"]["primary_document"] == "" and rows["x"]["cik"] == 42
    row = submissions.companies(histories).first()
    assert row["tickers"] == ["ACM"] and row["exchanges"] == [] and row["sic_description"] == ""


def test_company_facts(spark, tmp_path):
    good = {"val": 5, "end": "2018-12-31", "filed": "2019-02-01", "form": "10-K"}
    payload = {"cik": 7, "facts": {
        "dei": {"Revenues": {"units": {"USD": [good]}}},
        "us-gaap": {"Revenues": {"units": {"USD": [good, {"val": None, "end": "2018-12-31", "filed": "2019-02-01"}, {"val": 1, "end": "2018-12-31"}]}}}}}
    (tmp_path / "f.json").write_text(json.dumps(payload))
    flat = facts.flat_facts(facts.read_company_facts(spark, str(tmp_path / "f.json")))
    assert flat.count() == 2 and flat.first()["fiscal_year"] == 2018
    assert [r["namespace"] for r in facts.first_namespace(flat).collect()] == ["us-gaap"]


def test_markup_to_text(spark):
    pages = [
        "<html><head><title>T</title><style>p{}</style></head><body><p>A&nbsp;&amp;amp; B<br>C</p><script>x='</p>'</script></body></html>",
        "plain &lt;text&gt;  with \xa0 blanks \n\n\n\n end ",
        "<div>5 &#36;&#x20AC; &copy2 &bogus; 1 < 2</div><!-- <p>no</p> -->",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = [r["body"] for r in markup.to_text(df).orderBy("id").collect()]
    assert got[0] == "A & B\nC"
    assert got[1] == "plain <text> with blanks\n\nend"
    assert got[2] == "5 $€ \xa92 &bogus; 1 < 2"


def test_rows_round_trip(spark, tmp_path):
    schema = "cik bigint, announced string"
    path = str(tmp_path / "rows")
    assert tables.read_rows(spark, path, schema).count() == 0
    tables.write_rows(spark.createDataFrame([(2, "b"), (1, "a")], schema), path)
    assert [r["cik"] for r in tables.read_rows(spark, path, schema).orderBy("cik").collect()] == [1, 2]
    assert tables.slim(spark.createDataFrame([(1, "a")], schema), ["announced", "gone"]).columns == ["announced"]


def test_references_of_any_length(spark):
    import html

    cases = [
        "&#0000000000000000000000065;", "&#x00000000000000000041;", "a&#1;b", "a&#x0B;b", "&#xFDD0;x", "&#x1FFFF;", "&#0;", "&#x110000;",
        "&#99999999999999999999999999;", "&#xFFFFFFFFFFFFFFFFFFFF;", "&#128;", "&#13;x", "&#x;", "x&amp" + "A" * (2 << 20) + "TAIL", "&#000;", "&notit;",
    ]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r["i"]: r["u"] for r in rows.select("i", markup.unescape(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(len(cases))] == [html.unescape(c) for c in cases]


def test_index_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "q1.idx").write_bytes(INDEX.encode("latin-1"))
    scanned = index.scan_index(index.read_lines(spark, str(tmp_path)))
    plan = scanned._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    odd = "10-K   A \ue000 Co   77   1990-01-01   edgar/data/77/0.txt"
    rows = spark.createDataFrame([(odd,), (odd.replace("\ue000", "B"),), ("x\ue000x\ue000x\ue000x\ue000x",), ("",), (None,)], "line string")
    found = [r["row"] for r in rows.select(index.parse_row(F.col("line")).alias("row")).collect()]
    assert found[0]["company"] == "A \ue000 Co" and found[1]["company"] == "A B Co" and found[2:] == [None] * 3
    assert found[0]["cik"] == found[1]["cik"] == 77 and found[1]["accession"] == "0"
