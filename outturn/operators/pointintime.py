"""Reported figures as they were known on a date."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outturn.functions import vocab


def _concept_table(concepts: list[str]) -> Column:
    """array(struct(concept, priority, tag)): an unknown concept names its own tag."""
    rows = chain.from_iterable(
        ((c, i, tag) for i, tag in enumerate(vocab.CONCEPTS.get(c, [c]))) for c in concepts
    )
    return F.array(
        *[
            F.struct(F.lit(c).alias("concept"), F.lit(i).alias("priority"), F.lit(t).alias("tag"))
            for c, i, t in rows
        ]
    )


def latest_figures(
    facts: DataFrame, known: DataFrame, concepts: list[str], annual_only: bool = True
) -> DataFrame:
    """Per (cik, known_by, concept): the latest period whose figure was filed by then.

    Tags are tried in the concept's order and the first with any figure wins; for one
    period the later filing wins. No row means the figure is absent, which is not zero.

    Facts are first reduced to one row per (cik, concept, filing day); query dates are
    then merged into the same timeline and read the best figure so far, so no fact is
    ever paired with every date.
    """
    if "seq" not in facts.columns:
        facts = facts.withColumn("seq", F.lit(0))
    for column in ("unit", "namespace"):
        if column not in facts.columns:
            facts = facts.withColumn(column, F.lit(None).cast("string"))
    table = _concept_table(concepts)
    tags = sorted({t for c in concepts for t in vocab.CONCEPTS.get(c, [c])})
    usable = facts.where(F.col("tag").isin(tags))
    if annual_only:
        usable = usable.where(F.col("form").isin(vocab.ANNUAL_FORMS))
    mapped = usable.select(
        "*", F.explode(F.filter(table, lambda r: r["tag"] == F.col("tag"))).alias("_as")
    )
    # first in source order wins among figures equal in period and filing day
    figure = F.struct(
        F.col("period_end"), F.col("filed"),
        F.struct("value", "form", "tag", "unit").alias("figure"),
    )
    depth = max(len(vocab.CONCEPTS.get(c, [c])) for c in concepts)
    one_per_period = (
        mapped.groupBy("cik", "_as", "filed", "period_end")
        .agg(F.min(F.struct("seq", "value", "form", "tag", "unit")).alias("_first"))
        .select("cik", "_as", "filed", "period_end", "_first.*")
    )
    by_day = one_per_period.groupBy("cik", F.col("_as.concept").alias("concept"), "filed").agg(
        *[F.max(F.when(F.col("_as.priority") == p, figure)).alias(f"best{p}") for p in range(depth)]
    )
    asked = known.select("cik", "known_by").distinct().select(
        "cik", F.explode(F.array(*[F.lit(c) for c in concepts])).alias("concept"),
        F.col("known_by").alias("filed"), F.lit(True).alias("asked"),
    )
    timeline = by_day.unionByName(asked, allowMissingColumns=True)
    so_far = (
        Window.partitionBy("cik", "concept")
        .orderBy("filed", F.col("asked").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    best = F.coalesce(*[F.col(f"so_far{p}") for p in range(depth)])
    return (
        timeline.select(
            "*", *[F.max(f"best{p}").over(so_far).alias(f"so_far{p}") for p in range(depth)]
        )
        .where("asked")
        .select("cik", F.col("filed").alias("known_by"), "concept", best.alias("best"))
        .where("best is not null")
        .select(
            "cik", "known_by", "concept",
            F.col("best.figure.value").alias("value"), F.col("best.period_end").alias("period_end"),
            F.col("best.filed").alias("filed"), F.col("best.figure.form").alias("form"),
            F.col("best.figure.tag").alias("tag"), F.col("best.figure.unit").alias("unit"),
        )
    )


def latest_annual(facts: DataFrame, known: DataFrame, concept: str, annual_only: bool = True) -> DataFrame:
    return latest_figures(facts, known, [concept], annual_only)


def snapshot(facts: DataFrame, known: DataFrame, concepts: list[str] | None = None) -> DataFrame:
    """One row per (cik, known_by) and a struct column per concept, null where absent."""
    concepts = concepts or list(vocab.CONCEPTS)
    found = latest_figures(facts, known, concepts)
    figure = F.struct("value", "period_end", "filed", "form", "tag", "unit")
    wide = found.groupBy("cik", "known_by").agg(
        *[F.max(F.when(F.col("concept") == c, figure)).alias(c) for c in concepts]
    )
    return known.select("cik", "known_by").distinct().join(wide, ["cik", "known_by"], "left")
