"""Ordering by an id without a sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bounds(documents: DataFrame, count: int) -> list[int]:
    """Approximate quantiles of doc_id, at most ``count`` - 1 of them; only that column is read."""
    shares = [k / count for k in range(1, count)]
    found = documents.select("doc_id").approxQuantile("doc_id", shares, 0.1 / count) if shares else []
    return sorted({int(x) for x in found})


def bucket_of(bounds: list[int]) -> Column:
    """Number of bounds that doc_id reaches, found by halving: a step for each binary digit of their number."""
    if not bounds:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        reached = F.get(array, middle) <= F.col("doc_id")
        done = at["low"] >= at["high"]
        return F.struct(
            F.when(~done & reached, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(~done & ~reached, middle).otherwise(at["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(steps, start, halve, lambda at: at["low"])


def partitions(documents: DataFrame) -> int:
    return max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
