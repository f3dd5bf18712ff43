"""Texts are dropped where they are read, and dealt once."""

import re

from pyspark.sql import functions as F

from outturn.functions.keyfilter import key_filter
from outturn.operators.documents import announcement_texts, only_wanted


def test_filter_holds_for_every_key_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 7).alias("n"))
    may = key_filter(keys, ["k", "n"])
    assert keys.where(~may(F.col("k"), F.col("n"))).count() == 0
    others = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("k"), (F.col("id") % 7).alias("n"))
    assert others.where(may(F.col("k"), F.col("n"))).count() < 600
    none = key_filter(keys.limit(0), ["k", "n"])
    assert others.where(none(F.col("k"), F.col("n"))).count() == 0


def test_a_full_filter_only_lets_more_through(spark, monkeypatch):
    monkeypatch.setattr("outturn.functions.keyfilter.MOST_LONGS", 64)
    bodies = spark.range(5000).select(F.col("id").cast("string").alias("accession"), F.lit("text").alias("body"))
    asked = bodies.where("accession like '%7'").select("accession")
    assert only_wanted(bodies, asked, ["accession"]).count() == 500


def exchanges_of(df, column):
    """Exchanges of the plan whose output has the column."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.findall(r"\(\d+\) (\w*Exchange)\n(.*?)\n\n", plan, re.S)
    return [name for name, text in nodes if re.search(rf"Input \[\d+\]: \[.*\b{column}#", text)]


def test_texts_are_in_one_exchange_at_most(spark, tmp_path):
    primary = spark.createDataFrame([("a", "m.htm", 1), ("b", "n.htm", 2), ("c", "gone.htm", 2)], "accession string, name string, size int")
    releases = spark.createDataFrame([("a", "ex99.htm")], "accession string, press_release string")
    rows = [("a", "m.htm", "main"), ("a", "ex99.htm", "release"), ("b", "n.htm", "other"), ("b", "zip", "no"), ("d", "m.htm", "no"), ("a", "m.htm", "main")]
    path = str(tmp_path / "bodies")
    spark.createDataFrame(rows, "accession string, name string, body string").write.parquet(path)
    bodies, before = spark.read.parquet(path), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = announcement_texts(primary, releases, bodies)
        assert len(exchanges_of(found, "body")) == 1
        assert len(exchanges_of(only_wanted(bodies, primary, ["accession"]), "body")) == 1
        assert sorted(map(tuple, found.collect()), key=str) == [
            ("a", "m.htm", "ex99.htm", "main\n\nrelease"), ("b", "n.htm", None, "other"), ("c", "gone.htm", None, None),
        ]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
