"""Was it the merger that was terminated? Deterministic, and it abstains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outturn.functions import patterns as P
from outturn.functions import vocab
from outturn.functions.lineage import cut
from outturn.functions.text import (
    all_matches, first_match, flatten, fold, last_match_start, let, may_match, money, pieces, read_once, strip,
)
from outturn.operators.documents import only_wanted
from outturn.operators.sections import item_sections, section, section_body

# A definition is at least six characters, so this many cover any lookback window.
_NEIGHBOURS = P.DEFINITION_LOOKBACK // 6 + 2


def _definitions(flat: Column) -> Column:
    """array(struct(term, context)) for every abbreviation the text defines."""
    reach = F.lit(P.DEFINITION_LOOKBACK)
    # the text from the end of the previous definition up to each one, that one included
    led = F.zip_with(
        pieces(flat, P.DEFINITION),
        F.concat(F.array(F.lit("")), all_matches(flat, P.DEFINITION)),
        lambda gap, earlier: F.right(F.concat(earlier, gap), reach),
    )
    parts = F.struct(led.alias("led"), all_matches(flat, P.DEFINITION, 1).alias("terms"))

    def contexts(p: Column) -> Column:
        return F.transform(
            p["terms"],
            lambda t, i: F.struct(
                strip(t).alias("term"),
                F.right(
                    F.array_join(
                        F.slice(
                            p["led"],
                            F.greatest(i + 2 - _NEIGHBOURS, F.lit(1)),
                            F.least(i + 1, F.lit(_NEIGHBOURS)),
                        ),
                        "",
                    ),
                    reach,
                ).alias("context"),
            ),
        )

    return F.when(flat.rlike(P.DEFINITION), let(parts, contexts)).otherwise(
        F.array().cast("array<struct<term:string,context:string>>")
    )


def defined_terms(document: Column) -> Column:
    """struct(merger, other): the document's own abbreviations by what they stand for.

    A term takes the class of the nearest agreement phrase in front of it; a term the
    document puts in both classes is in neither.
    """
    bracketed = F.when(document.contains("(") | document.contains("["), document).when(document.isNotNull(), "")
    classed = F.transform(
        F.filter(let(flatten(bracketed), _definitions), lambda d: F.length(d["term"]) >= 2),
        lambda d: F.struct(
            d["term"].alias("term"),
            last_match_start(d["context"], P.MERGER_AGREEMENT).alias("merger"),
            last_match_start(d["context"], P.OTHER_AGREEMENT).alias("other"),
        ),
    )

    def split(c: Column) -> Column:
        merger = F.transform(F.filter(c, lambda d: d["merger"] > d["other"]), lambda d: d["term"])
        other = F.transform(F.filter(c, lambda d: d["other"] > d["merger"]), lambda d: d["term"])
        return F.struct(
            F.array_except(merger, other).alias("merger"),
            F.array_except(other, merger).alias("other"),
        )

    return let(classed, split)


def _own_term(text: Column, terms: Column) -> Column:
    """The first whole-word use of any of the terms, longest spelling first."""
    longest_first = F.reverse(
        F.array_sort(F.transform(terms, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    )
    quoted = F.transform(longest_first, lambda t: F.concat(F.lit(r"\Q"), t["t"], F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?U)\b("), F.array_join(quoted, "|"), F.lit(r")\b"))
    return F.when(F.size(terms) > 0, F.regexp_substr(text, pattern))


def named_instrument(text: Column) -> Column:
    """The first specifically named agreement, ignoring the generic ways of saying one."""
    names = F.transform(all_matches(text, P.NAMED_INSTRUMENT, 1), strip)
    return F.try_element_at(
        F.filter(names, lambda n: ~n.rlike(P.NOT_DISTINGUISHING)), F.lit(1)
    )


def break_fee(text: Column) -> Column:
    return money(text, P.BREAK_FEE)


def reasons(text: Column, lowered: Column | None = None) -> Column:
    """The reasons given; ``lowered`` is the folded text where there is a column of it."""
    lowered = fold(text) if lowered is None else lowered
    return F.array_compact(
        F.array(*[F.when(may_match(lowered, p) & text.rlike(p), F.lit(name)) for name, p in P.REASONS.items()])
    )


def classify(df: DataFrame, section_column: str = "section", document: str | None = "body") -> DataFrame:
    """Adds status, reasons, break_fee_usd, excerpt and evidence for each notice.

    ``document`` is the whole filing; it only resolves the abbreviations the filing
    defines for itself, and is read for the rows that need it.
    """
    whole = F.nullif(F.col(document), F.lit("")) if document else F.lit(None).cast("string")
    terminated = F.col("_terminated")
    text = F.col("_text")
    lowered = F.col("_lowered")
    kept = df.columns

    def named(pattern: str) -> Column:
        return F.when(terminated & may_match(lowered, pattern), first_match(text, pattern))

    read = (
        df.withColumn("_text", section_body(F.col(section_column)))
        .withColumn("_lowered", fold(text))
        .withColumn(
            "_terminated",
            F.coalesce(may_match(lowered, P.TERMINATION) & text.rlike(P.TERMINATION), F.lit(False)),
        )
        .withColumn("_merger", named(P.MERGER_AGREEMENT))
        .withColumn("_other", named(P.OTHER_AGREEMENT))
        .withColumn(
            "_terms",
            F.when(
                terminated & (F.col("_merger").isNull() | F.col("_other").isNull()),
                defined_terms(whole),
            ),
        )
        .withColumn("_merger", F.coalesce("_merger", _own_term(text, F.col("_terms.merger"))))
        .withColumn("_other", F.coalesce("_other", _own_term(text, F.col("_terms.other"))))
    )
    merger, other = F.col("_merger"), F.col("_other")
    merger_first = F.position(F.lower(merger), F.lower(text)) < F.position(
        F.lower(other), F.lower(text)
    )
    read_whole = F.coalesce(whole, text)
    silent = ~(may_match(fold(read_whole), P.MERGER_AGREEMENT) & read_whole.rlike(P.MERGER_AGREEMENT))
    instrument = F.when(
        terminated & merger.isNull() & other.isNull() & silent, named_instrument(text)
    )
    status = (
        F.when(F.col(section_column).isNull(), vocab.NO_SECTION)
        .when(~terminated, vocab.UNCLEAR)
        .when(merger.isNotNull() & (other.isNull() | merger_first), vocab.CONFIRMED)
        .when(merger.isNotNull(), vocab.UNCLEAR)
        .when(other.isNotNull() | F.col("_instrument").isNotNull(), vocab.UNRELATED)
        .otherwise(vocab.UNCLEAR)
    )
    instead = F.coalesce(other, F.col("_instrument"))
    no_text = F.array().cast("array<string>")
    judged = (
        read.withColumn("_instrument", instrument)
        .withColumn("_status", status)
    )
    kept_chars = F.when(terminated, P.EXCERPT_CHARS).otherwise(P.EXCERPT_CHARS_NO_TERMINATION)
    mentions = F.array(F.concat(F.lit("merger:"), merger), F.concat(F.lit("other:"), instead))
    found = {
        "status": F.col("_status"),
        "reasons": F.when(terminated, reasons(text, lowered)).otherwise(no_text),
        "break_fee_usd": F.when((F.col("_status") == vocab.CONFIRMED) & may_match(lowered, P.BREAK_FEE), break_fee(text)),
        "excerpt": F.coalesce(F.left(text, kept_chars), F.lit("")),
        "evidence": F.when(terminated, F.array_compact(mentions)).otherwise(no_text),
    }
    return read_once(judged, kept, found)


def confirm_breaks(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Verdict rows for break candidates, read from the document that reports them.

    ``candidates`` carry cik, company, announced, resolved_on, days_to_resolution and
    resolved_accession; ``documents`` hold accession, name and body of the primary
    document. A candidate without one is ``no_document``.
    """
    wanted = cut(candidates.select(
        "cik", "company", "announced", "resolved_on", "days_to_resolution",
        F.col("resolved_accession").alias("accession"),
    ))
    texts = documents.select("accession", F.col("name").alias("document"), "body")
    joined = wanted.join(only_wanted(texts, wanted, ["accession"]), "accession", "left")
    split = item_sections(joined).withColumn("section", section(vocab.ITEM_TERMINATION))
    return (
        classify(split)
        .withColumn(
            "status", F.when(F.col("body").isNull(), vocab.NO_DOCUMENT).otherwise(F.col("status"))
        )
        .drop("body", "sections", "section")
    )
