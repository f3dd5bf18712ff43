"""The passages of a long document where terms are stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions import patterns as P
from outturn.functions.text import all_matches, let, pieces, read_once


def _spans(flat: Column, reach: int, budget: int) -> Column:
    """array(struct(lo, hi)): windows around the anchors, overlapping ones merged.

    Once closed windows exceed the budget no more are kept, so the array stays small however many anchors there are.
    """
    def widths(read: Column) -> Column:
        return F.zip_with(
            F.slice(pieces(flat, P.ANCHORS), 1, F.size(read["matches"])),
            read["matches"],
            lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("match"), read["chars"].alias("chars")),
        )

    span_type = "array<struct<lo:int,hi:int>>"
    zero = F.struct(
        F.lit(0).alias("at"),
        F.lit(None).cast("int").alias("lo"),
        F.lit(None).cast("int").alias("hi"),
        F.lit(0).alias("size"),
        F.array().cast(span_type).alias("closed"),
    )

    def as_span(lo: Column, hi: Column) -> Column:
        return F.array(F.struct(lo.alias("lo"), hi.alias("hi")))

    def step(state: Column, w: Column) -> Column:
        start = state["at"] + w["gap"]
        lo = F.greatest(start - reach, F.lit(0))
        hi = F.least(start + w["match"] + reach, w["chars"])
        joins = state["hi"].isNotNull() & (lo <= state["hi"])
        opens = state["hi"].isNotNull() & (lo > state["hi"])
        wanted = opens & (state["size"] <= budget)  # later spans are cut off anyway
        return F.struct(
            (start + w["match"]).alias("at"),
            F.when(joins, state["lo"]).otherwise(lo).alias("lo"),
            F.when(joins, F.greatest(state["hi"], hi)).otherwise(hi).alias("hi"),
            F.when(wanted, state["size"] + state["hi"] - state["lo"]).otherwise(state["size"]).alias("size"),
            F.when(wanted, F.concat(state["closed"], as_span(state["lo"], state["hi"])))
            .otherwise(state["closed"]).alias("closed"),
        )

    return F.aggregate(
        let(F.struct(all_matches(flat, P.ANCHORS).alias("matches"), F.length(flat).alias("chars")), widths), zero, step,
        lambda s: F.when(
            s["hi"].isNotNull(), F.concat(s["closed"], as_span(s["lo"], s["hi"]))
        ).otherwise(s["closed"]),
    )


def _within_budget(flat: Column, spans: Column, budget: int) -> Column:
    """Pieces in order until the budget is spent; the piece that exceeds it is cut."""
    zero = F.struct(
        F.lit(budget).alias("left"), F.lit(False).alias("full"),
        F.array().cast("array<string>").alias("pieces"),
    )

    def step(state: Column, s: Column) -> Column:
        size = s["hi"] - s["lo"]
        piece = F.substring(flat, s["lo"] + 1, F.least(size, state["left"]))
        return F.struct(
            F.when(state["full"], state["left"])
            .otherwise(F.greatest(state["left"] - size, F.lit(0))).alias("left"),
            (state["full"] | (size > state["left"])).alias("full"),
            F.when(state["full"], state["pieces"])
            .otherwise(F.concat(state["pieces"], F.array(piece))).alias("pieces"),
        )

    return F.aggregate(spans, zero, step, lambda s: s["pieces"])


def locate_passages(
    documents: DataFrame,
    text: str = "body",
    window: int = P.PASSAGE_WINDOW,
    budget: int = P.PASSAGE_BUDGET,
) -> DataFrame:
    """Adds ``passages``: the text around every anchor, merged, in order, within budget."""
    flat = F.col("_flat")
    located = documents.withColumn(
        "_flat", F.regexp_replace(F.col(text), r"[ \t]+", " ")
    ).withColumn("_spans", _spans(flat, window // 2, budget))
    pieces = _within_budget(flat, F.col("_spans"), budget)
    return read_once(located, documents.columns, {"passages": F.array_join(pieces, P.PASSAGE_JOIN)})
