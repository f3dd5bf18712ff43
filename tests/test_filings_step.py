"""The step from filings to episodes: how often tables are read, what has a day, and how many tasks there are."""

from datetime import date

import pytest

from outturn.operators.breaks import confirm_breaks
from outturn.operators.terms import extract_for_episodes
from outturn.operators.timeline import announcement_days, event_days
from outturn.plans import adapters, deals, notices


def rows_of(spark, *rows):
    data = [(cik, date.fromisoformat(d) if d else None, form, items, f"a{n}") for n, (cik, d, form, items) in enumerate(rows)]
    return spark.createDataFrame(data, "cik bigint, filed date, form string, items string, accession string")


def counted(spark, df):
    """``df`` and the number of its rows that were read so far."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), read


def test_periodic_reports_have_no_days(spark):
    periodic = [(1, f"20{y:02d}-03-01", "10-K", "") for y in range(10, 19)]
    found = rows_of(spark, *periodic, (1, "2015-01-05", "DEFM14A", ""), (1, "2015-03-01", "8-K", "1.02"), (2, "2015-01-05", "10-Q", ""))
    days = event_days(found).collect()
    assert len(days) == 4  # two days and the periodic reports of each entity
    row = announcement_days(found).first()
    assert (row["first_periodic"], row["last_periodic"]) == (date(2010, 3, 1), date(2018, 3, 1))
    assert row["next_termination"]["accession"] == "a10"


def test_null_days_and_forms(spark):
    found = rows_of(
        spark, (1, None, "10-K", ""), (1, None, "SC 14D9/A", ""), (1, "2015-01-05", None, None), (1, "2015-02-05", "10-K", None),
        (1, "2015-02-06", "8-K", None), (None, "2015-01-05", "SC 13E3", ""),
    )
    got = {(r["cik"], r["filed"], r["n_announced"], r["n_14d9"], r["n_13e3"], r["first_periodic"]) for r in announcement_days(found).collect()}
    assert got == {(1, None, 1, 1, 0, date(2015, 2, 5)), (None, date(2015, 1, 5), 1, 0, 1, None)}


def test_index_rows_are_announcements_whatever_their_form(spark):
    index = rows_of(spark, (1, "2015-01-05", None, ""), (1, "2015-01-05", "X 14D9", ""), (1, "2015-01-05", "DEFM14A", ""))
    day = event_days(rows_of(spark, (1, "2015-01-05", "8-K", "1.01"), (1, "2015-01-05", "SC 13E3", "")), index).first()
    assert (day["n_announced"], day["n_14d9"], day["n_13e3"], day["agreement"]["accession"]) == (3, 1, 0, "a0")


def test_candidates_are_computed_once(spark):
    schema = "cik bigint, company string, announced date, label string, resolved_on date, days_to_resolution int, accession string"
    asked = spark.createDataFrame([(n, "c", date(2015, 1, 5), "terminated", None, 1, f"a{n}") for n in range(50)], schema)
    texts = spark.createDataFrame([("a1", "n", "Item 1.02. Gone.")], "accession string, name string, body string")
    candidates, read = counted(spark, asked.withColumnRenamed("accession", "resolved_accession"))
    assert confirm_breaks(candidates, texts).count() == 50 and read.value == 50
    episodes, read = counted(spark, asked)
    documents = texts.selectExpr("accession", "name as document", "cast(null as string) as press_release", "body")
    assert extract_for_episodes(episodes, documents).count() == 50 and read.value == 50


@pytest.mark.parametrize("query, built", [(notices.break_rate_bounds, 1), (notices.dataset_counts, 1), (deals.deal_export, 2)])
def test_filings_are_built_once_for_each_use(spark, sf_dir, monkeypatch, query, built):
    """One pass makes days, and announcements are read in a second one; none is done twice."""
    read = []
    inner = adapters.filings

    def filings(*args):
        df, n = counted(spark, inner(*args))
        read.append(n)
        return df

    monkeypatch.setattr(adapters, "filings", filings)
    n = inner(spark, sf_dir).count()
    query(spark, sf_dir).collect()
    assert sum(r.value for r in read) == built * n


def test_tasks_follow_the_rows(spark, sf_dir, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(adapters, "TASK_ROWS", 300)
    try:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
        adapters.filings(spark, sf_dir)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == -(-lines // 300)
        assert adapters.table(spark, sf_dir, "lineitem").rdd.getNumPartitions() == -(-lines // 300)
        adapters.table(spark, sf_dir, "part")
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == -(-lines // 300)  # never lowered
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lines_are_shuffled_once_before_they_meet_their_orders(spark, sf_dir):
    plan = adapters.filings(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(l_orderkey" in line for line in plan.splitlines()) == 1
