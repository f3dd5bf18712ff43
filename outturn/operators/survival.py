"""How long deals take, with completion and termination competing.

Durations are whole days clipped at a horizon, so every curve is computed from at most
one row per day: the only global windows run over that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outturn.functions import vocab


def survival_table(frame: DataFrame, horizon: int = vocab.SURVIVAL_HORIZON_DAYS) -> DataFrame:
    """One row per observed day with the number at risk and the three curves after it.

    ``still_open``: Kaplan-Meier with closing as the event; ``unbroken``: with breaking as
    the event; ``incidence``: cumulative incidence of a break under competing risks. Tied
    days are handled exactly.
    """
    by_day = frame.groupBy(F.least("duration_days", F.lit(horizon)).alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("observed_break").alias("breaks"),
        F.sum("observed_close").alias("closes"),
    )
    in_order = Window.orderBy("day")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    risk = by_day.withColumn("at_risk", F.sum("n").over(onward))

    def surviving(events) -> F.Column:
        return F.product((F.col("at_risk") - events) / F.col("at_risk")).over(upto)

    curves = risk.select(
        "day", "at_risk", "breaks", "closes",
        surviving(F.col("closes")).alias("still_open"),
        surviving(F.col("breaks")).alias("unbroken"),
        surviving(F.col("breaks") + F.col("closes")).alias("unresolved"),
    )
    before = F.coalesce(F.lag("unresolved").over(in_order), F.lit(1.0))
    return curves.withColumn("_step", before * F.col("breaks") / F.col("at_risk")).select(
        "day", "at_risk", "breaks", "closes", "still_open", "unbroken",
        F.sum("_step").over(upto).alias("incidence"),
    )


def curve_report(frame: DataFrame, days: list[int] = vocab.CURVE_DAYS) -> DataFrame:
    """One row: counts, median days to close, and the curves read at the given days."""
    day = F.col("day")

    def at(column: str, when: int, start: float) -> F.Column:
        return F.coalesce(F.max_by(column, F.when(day <= when, day)), F.lit(start))

    table = survival_table(frame)
    curves = table.agg(
        F.min(F.when(F.col("still_open") <= 0.5, day)).alias("median_days_to_close"),
        *[(1 - at("still_open", d, 1.0)).alias(f"closed_by_{d}") for d in days],
        *[at("incidence", d, 0.0).alias(f"break_incidence_{d}") for d in days],
        *[(1 - at("unbroken", d, 1.0)).alias(f"naive_break_risk_{d}") for d in days],
        F.coalesce(F.max("at_risk"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("breaks"), F.lit(0)).alias("breaks"),
        F.coalesce(F.sum("closes"), F.lit(0)).alias("closes"),
    )
    return curves.withColumn("censored", F.col("n") - F.col("breaks") - F.col("closes"))
