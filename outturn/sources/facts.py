"""Company facts: nested namespace, tag, unit and rows, turned into flat facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outturn.functions import vocab

_ROW = "struct<val: double, end: string, filed: string, form: string>"
FACTS_SCHEMA = f"""
cik bigint,
facts map<string, map<string, struct<units: map<string, array<{_ROW}>>>>>
"""


def read_company_facts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(FACTS_SCHEMA).json(paths)


def flat_facts(payloads: DataFrame) -> DataFrame:
    """One row per reported figure; rows without a value, period end or filing date go.

    ``seq`` keeps the order of a tag's figures for ties.
    """
    return (
        payloads.select("cik", F.explode("facts").alias("namespace", "tags"))
        .select("cik", "namespace", F.explode("tags").alias("tag", "block"))
        .select("cik", "namespace", "tag", F.posexplode("block.units").alias("unit_no", "unit", "rows"))
        .select("cik", "namespace", "tag", "unit_no", "unit", F.posexplode("rows").alias("row_no", "row"))
        .select(
            "cik", "namespace", "tag", "unit",
            F.struct("unit_no", "row_no").alias("seq"),
            F.col("row.val").alias("value"),
            F.col("row.end").try_cast("date").alias("period_end"),
            F.col("row.filed").try_cast("date").alias("filed"),
            F.coalesce("row.form", F.lit("")).alias("form"),
        )
        .where("value is not null and period_end is not null and filed is not null")
        .withColumn("fiscal_year", F.year("period_end"))
    )


def first_namespace(facts: DataFrame) -> DataFrame:
    """Keeps, per (cik, tag), only the first namespace in order that has any rows."""
    rank = F.array_position(F.lit(vocab.FACT_NAMESPACES), F.col("namespace"))
    ranked = facts.withColumn("_rank", rank).where("_rank > 0")
    best = ranked.groupBy("cik", "tag").agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, ["cik", "tag", "_rank"], "left_semi").drop("_rank")
