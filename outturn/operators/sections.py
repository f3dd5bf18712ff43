"""Splitting a notice into its numbered items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions import patterns as P
from outturn.functions.text import flatten, let, pieces, strip


def is_title_only(segment: Column) -> Column:
    """Nothing but a heading: no remainder, or a short one without a digit.

    A remainder with a digit is not empty, so the digit is looked for first and only texts without one are measured.
    """

    def short(rest: Column) -> Column:
        return ~rest.rlike(P.ANY_DIGIT) & (F.length(strip(flatten(rest))) < P.TITLE_ONLY_CHARS)

    return let(F.regexp_replace(segment, P.TITLE_LINE, ""), short)


def segments(text: Column) -> Column:
    """array(struct(code, body, title_only)) in document order."""
    starting = F.filter(pieces(text, P.HEADING_SPLIT), lambda s: s.rlike(P.HEADING_CODE))
    bodies = F.transform(starting, strip)
    return F.transform(
        bodies,
        lambda b: F.struct(
            F.regexp_extract(b, P.HEADING_CODE, 1).alias("code"),
            b.alias("body"),
            is_title_only(b).alias("title_only"),
        ),
    )


def share_narratives(found: Column) -> Column:
    """Gives each heading without text the next narrative below it.

    A string of one mark per heading is searched for the next narrative, so nothing is copied while it is read.
    """

    def shared(of: Column) -> Column:
        def body(s: Column, i: Column) -> Column:
            at = F.position(F.lit("n"), of["marks"], i + 1)
            borrowed = F.concat_ws("\n", s["body"], F.get(of["found"], at - 1)["body"])
            return F.struct(
                s["code"].alias("code"),
                F.when(s["title_only"] & (at > 0), borrowed).otherwise(s["body"]).alias("body"),
            )

        return F.transform(of["found"], body)

    def marked(segments: Column) -> Column:
        marks = F.array_join(F.transform(segments, lambda s: F.when(s["title_only"], "t").otherwise("n")), "")
        return F.struct(segments.alias("found"), marks.alias("marks"))

    return let(let(found, marked), shared)


def longest_per_code(resolved: Column) -> Column:
    """map(code -> body): the longest body carrying each code, the first one on ties.

    One sort by code, falling length and place; the first of each code is taken.
    """

    def ranked(bodies: Column) -> Column:
        order = F.array_sort(
            F.transform(
                bodies,
                lambda s, i: F.struct(s["code"].alias("code"), (-F.length(s["body"])).alias("chars"), i.alias("at")),
            )
        )
        return F.struct(bodies.alias("bodies"), order.alias("order"))

    def first(of: Column) -> Column:
        tops = F.filter(of["order"], lambda e, i: (i == 0) | (F.get(of["order"], i - 1)["code"] != e["code"]))
        return F.map_from_entries(
            F.transform(tops, lambda e: F.struct(e["code"].alias("code"), F.get(of["bodies"], e["at"])["body"].alias("body")))
        )

    return let(let(resolved, ranked), first)


def item_sections(documents: DataFrame, text: str = "body") -> DataFrame:
    """Adds ``sections``, a map from item code to section text (empty without headings)."""
    return (
        documents.withColumn("_segments", segments(F.col(text)))
        .withColumn("_resolved", share_narratives(F.col("_segments")))
        .withColumn("sections", longest_per_code(F.col("_resolved")))
        .drop("_segments", "_resolved")
    )


def section(code: str, sections: str = "sections") -> Column:
    return F.try_element_at(F.col(sections), F.lit(code))


def section_body(section_text: Column) -> Column:
    """The section on one line, without a heading that would be its own evidence."""
    return strip(flatten(F.regexp_replace(section_text, P.HEADING_LINE, "")))
