"""Episodes, outcomes, point-in-time lookups and resuming on small hand-made histories."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from outturn.functions import forms
from outturn.operators.features import check_no_leakage
from outturn.operators.outcomes import label_outcomes
from outturn.operators.pointintime import latest_annual, snapshot
from outturn.operators.resume import resume, run_counts, since_day, split_done
from outturn.operators.search import page
from outturn.operators.timeline import (
    announcement_days, announcement_report, episode_arrays, episode_timeline, episodes,
)

SCHEMA = "cik bigint, filed date, form string, items string, accession string"


def history(spark, *rows, cik=1):
    data = [(cik, date.fromisoformat(d), f, i, f"a{n}") for n, (d, f, i) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


BEFORE = ("2018-03-01", "10-K", "")
ANNOUNCED = ("2019-01-10", "DEFM14A", "")


def label(spark, *after, cut="2026-09-22"):
    rows = label_outcomes(episode_timeline(history(spark, BEFORE, ANNOUNCED, *after)), cut).collect()
    return rows[0]


@pytest.mark.parametrize(
    "after, expected",
    [
        ([("2019-06-01", "25-NSE", "")], "completed"),
        ([("2019-06-01", "25-NSE", ""), ("2021-03-01", "10-K", "")], "completed"),
        ([("2019-06-01", "8-K", "5.06, 9.01"), ("2021-03-01", "10-K", "")], "completed_shell"),
        ([("2019-06-01", "8-K/A", "5.01")], "completed"),
        ([("2019-06-01", "8-K", "5.01"), ("2021-03-01", "10-K", "")], "unresolved"),
        ([("2019-06-01", "8-K", "1.02"), ("2021-03-01", "10-K", "")], "terminated"),
        ([("2019-06-01", "8-K", "1.02")], "unresolved"),
        ([("2019-06-01", "8-K", "2.01"), ("2021-03-01", "10-K", "")], "acquirer_side"),
        ([("2019-06-01", "8-K", "2.01")], "completed"),
        ([("2019-06-01", "8-K", "11.02"), ("2021-03-01", "10-K", "")], "unresolved"),
        ([("2023-06-01", "25", "")], "unresolved"),  # past the resolution horizon
        ([], "unresolved"),
    ],
)
def test_outcome_precedence(spark, after, expected):
    assert label(spark, *after)["label"] == expected


def test_pending_registrant_and_evidence(spark):
    assert label(spark, cut="2019-06-01")["label"] == "pending"
    stranger = label_outcomes(episode_timeline(history(spark, ANNOUNCED, ("2019-06-01", "25", ""))), "2026-01-01")
    assert stranger.first()["label"] == "not_registrant"
    row = label(spark, ("2019-06-01", "8-K", "1.02"), ("2019-07-01", "25", ""), ("2019-08-01", "25", ""))
    assert row["evidence"] == ["dereg:25@2019-07-01", "item1.02:8-K@2019-06-01"]
    assert row["resolved_on"] == date(2019, 7, 1) and row["days_to_resolution"] == 172


def test_a_later_deal_does_not_resolve_an_earlier_one(spark):
    rows = history(
        spark, ("2014-03-01", "10-K", ""), ("2015-02-01", "PREM14A", ""), ("2016-05-02", "8-K", "1.02"),
        ("2016-06-01", "DEFM14A", ""), ("2017-07-03", "25", ""), ("2017-11-01", "10-Q", ""),
    )
    got = label_outcomes(episode_timeline(rows), "2020-01-01").orderBy("announced").collect()
    assert [r["label"] for r in got] == ["terminated", "completed"]


def test_episode_boundaries(spark):
    def starts(gap, *rows):
        found = episodes(episode_timeline(history(spark, *rows), gap_days=gap)).orderBy("announced").collect()
        return [(str(r["announced"]), str(r["last_announcement"]), r["n_announcements"]) for r in found]

    a, b = ("2015-01-01", "PREM14A", ""), ("2015-07-20", "DEFM14A", "")
    assert starts(545, a, b) == [("2015-01-01", "2015-07-20", 2)]
    assert starts(200, a, b) == [("2015-01-01", "2015-07-20", 2)]  # exactly 200 days is no gap
    assert len(starts(199, a, b)) == 2
    assert len(starts(545, a, ("2015-07-20", "15-12B", ""), b)) == 1  # same day is not between
    assert len(starts(545, a, ("2015-03-01", "8-K/A", "1.02"), b)) == 2


def test_arrays_continue_on_further_rows(spark):
    rows = history(spark, *[(f"2015-01-{d:02d}", "SC 14D9/A", "") for d in range(1, 8)])
    days = announcement_days(rows)
    chunks = episode_arrays(rows, days, chunk=3).orderBy("chunk_no").collect()
    assert [len(r["announcement_forms"]) for r in chunks] == [3, 3, 1]
    joined = [a for r in chunks for a in r["announcement_accessions"]]
    assert joined == [f"a{n}" for n in range(7)]


def test_one_huge_entity_matches_many_small_ones(spark):
    """The same history under one entity's key thousands of times gives the same label."""
    rows = history(spark, BEFORE, ANNOUNCED, ("2019-06-01", "8-K", "1.02"), ("2021-03-01", "10-K", ""))
    hot = rows.crossJoin(spark.range(3000)).withColumn("accession", F.concat("accession", F.col("id").cast("string")))
    got = label_outcomes(episode_timeline(hot.drop("id")), "2026-01-01").collect()
    assert [(r["label"], r["n_announcements"]) for r in got] == [("terminated", 3000)]


def test_nearest_report_prefers_the_earlier_one(spark):
    rows = history(spark, ("2019-01-05", "8-K", "1.01"), ANNOUNCED, ("2019-01-15", "8-K", "1.01"))
    assert announcement_report(episode_timeline(rows)).first()["accession"] == "a0"
    late = history(spark, ANNOUNCED, ("2019-05-09", "8-K", "1.01,9.01"))
    assert announcement_report(episode_timeline(late)).first()["accession"] == "a1"
    later = history(spark, ANNOUNCED, ("2019-05-11", "8-K", "1.01"))
    assert announcement_report(episode_timeline(later)).first()["accession"] is None


def test_figures_as_known(spark):
    facts = spark.createDataFrame(
        [
            (1, "Revenues", "10-K", date(2018, 12, 31), date(2019, 2, 20), 1000.0),
            (1, "Revenues", "10-K", date(2019, 12, 31), date(2020, 2, 25), 1200.0),
            (1, "Revenues", "10-Q", date(2019, 9, 30), date(2019, 10, 30), 300.0),
            (1, "Revenues", "10-K", date(2018, 12, 31), date(2020, 2, 20), 950.0),
            (1, "SalesRevenueNet", "10-K", date(2030, 1, 1), date(2019, 1, 1), 7.0),
        ],
        "cik bigint, tag string, form string, period_end date, filed date, value double",
    )
    known = spark.createDataFrame([(1, date(2020, 1, 10)), (1, date(2020, 2, 22)), (1, date(2020, 3, 1)), (1, date(2018, 1, 1))], "cik bigint, known_by date")
    got = {str(r["known_by"]): r["value"] for r in latest_annual(facts, known, "revenue").collect()}
    assert got == {"2020-01-10": 1000.0, "2020-02-22": 950.0, "2020-03-01": 1200.0}
    wide = {str(r["known_by"]): r for r in snapshot(facts, known, ["revenue", "cash"]).collect()}
    assert wide["2018-01-01"]["revenue"] is None and wide["2020-03-01"]["cash"] is None
    assert wide["2020-03-01"]["revenue"]["tag"] == "Revenues"


def test_resume_redoes_only_what_is_needed(spark):
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "cik bigint, source string")
    before = spark.createDataFrame([(1, "a", "confirmed"), (2, "b", "fetch_failed"), (9, "z", "confirmed")], "cik bigint, source string, status string")
    reused, outstanding = split_done(wanted, before, ["cik", "source"])
    assert [r.cik for r in reused.collect()] == [1] and sorted(r.cik for r in outstanding.collect()) == [2, 3]
    done = resume(wanted, before, ["cik", "source"], lambda d: d.withColumn("status", F.lit("new")))
    assert {r.cik: r.status for r in done.collect()} == {1: "confirmed", 2: "new", 3: "new"}
    switched = wanted.withColumn("source", F.lit("other"))
    assert split_done(switched, before, ["cik", "source"])[0].count() == 0


def test_run_counts_place_every_target_once(spark):
    day = date
    rows = [(1, day(2020, 1, 1)), (2, day(2021, 1, 1)), (3, day(2021, 1, 1)), (4, None), (None, day(2022, 1, 1)), (5, day(2022, 1, 1)), (5, day(2022, 1, 1))]
    wanted = spark.createDataFrame(rows, "cik bigint, announced date")
    before = [(1, rows[0][1], "confirmed"), (2, rows[1][1], "confirmed"), (2, rows[1][1], "unclear"), (3, rows[2][1], "fetch_failed"),
              (None, rows[4][1], "confirmed"), (5, rows[5][1], "confirmed"), (9, rows[5][1], "confirmed")]
    previous = spark.createDataFrame(before, "cik bigint, announced date, status string")
    keys = ["cik", "announced"]
    assert run_counts(wanted, previous, keys, "2021-01-01").first().asDict() == {"targets": 7, "excluded": 2, "reused": 3, "outstanding": 2}
    assert run_counts(wanted, previous, keys).first().asDict() == {"targets": 7, "excluded": 0, "reused": 4, "outstanding": 3}
    assert run_counts(wanted, previous.limit(0), keys, "2021-01-01").first()["outstanding"] == 5
    assert run_counts(wanted.limit(0), previous, keys).first().asDict() == {"targets": 0, "excluded": 0, "reused": 0, "outstanding": 0}
    assert sorted(r.cik or 0 for r in since_day(wanted, "2021-01-01").collect()) == [0, 2, 3, 5, 5]


def test_guards(spark):
    with pytest.raises(ValueError):
        check_no_leakage(spark.createDataFrame([(1, "x")], "cik int, tickers string"))
    with pytest.raises(ValueError):
        page(spark.range(1), limit=501)
    df = spark.createDataFrame([("1.01, 9.01",), ("11.01",), (None,)], "items string")
    assert [r[0] for r in df.select(forms.has_item(F.col("items"), "1.01")).collect()] == [True, False, False]
