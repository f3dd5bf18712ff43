"""HTML or plain documents to readable text, and filing directory listings."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outturn.functions import patterns as P
from outturn.functions.text import all_matches, pieces, read_once, strip

_LEGACY_NAME_CHARS = 6  # the longest entity name that is valid without its semicolon


def _entity_table() -> Column:
    """Entity name (with or without semicolon) to text, as one folded map literal."""
    return F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")


def _code_point(number: Column) -> Column:
    """The character with this number; numbers that name none become U+FFFD.

    128 to 159 are read as windows-1252, as browsers do; control codes and noncharacters vanish.
    """
    as_text = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    remapped = F.element_at(
        F.lit([bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]),
        (number - 127).cast("int"),
    )
    invalid = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF) | number.isNull()
    silent = (
        number.between(1, 8) | number.isin(0x0B, 0x7F) | number.between(0x0E, 0x1F) | number.between(0xFDD0, 0xFDEF)
        | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    return F.when(invalid, "\ufffd").when(silent, "").when(number.between(128, 159), remapped).otherwise(as_text)


def _decoded(entity: Column, table: Column) -> Column:
    """One matched entity to its text; unknown names stay as written."""
    name = F.regexp_extract(entity, P.ENTITY, 1)
    rest = F.regexp_replace(entity, "^&", "")
    # without leading zeros, more digits than these are beyond every character
    hex_digits = F.regexp_extract(name, "^#[xX]0*([0-9a-fA-F]*)$", 1)
    hexadecimal = F.when(F.length(hex_digits) <= 8, F.conv(F.concat(F.lit("0"), hex_digits), 16, 10).try_cast("bigint"))
    digits = F.regexp_extract(name, "^#0*([0-9]*)$", 1)
    decimal = F.when(F.length(digits) <= 10, F.concat(F.lit("0"), digits).try_cast("bigint"))
    prefixes = [
        F.when(
            F.length(name) >= n,
            F.concat(F.try_element_at(table, F.substring(name, 1, n)), F.substring(rest, F.lit(n + 1), F.length(rest))),
        )
        for n in range(_LEGACY_NAME_CHARS, 1, -1)
    ]
    return (
        F.when(name.rlike("^#[xX]"), _code_point(hexadecimal))
        .when(name.startswith("#"), _code_point(decimal))
        .otherwise(F.coalesce(F.try_element_at(table, rest), *prefixes, entity))
    )


def unescape(text: Column) -> Column:
    """Character references replaced in one left-to-right pass."""
    table = _entity_table()
    decoded = F.transform(all_matches(text, P.ENTITY), lambda e: _decoded(e, table))
    joined = F.array_join(
        F.zip_with(
            pieces(text, P.ENTITY),
            F.concat(decoded, F.array(F.lit(""))),
            lambda gap, e: F.concat(gap, e),
        ),
        "",
    )
    return F.when(text.contains("&"), joined).otherwise(text)


def _without_tags(raw: Column) -> Column:
    text = F.regexp_replace(raw, P.DROPPED_MARKUP, "")
    text = F.regexp_replace(text, P.DROPPED_ELEMENT, "")
    text = F.regexp_replace(text, P.BLOCK_TAG, "\n")
    return F.regexp_replace(text, P.ANY_TAG, "")


def _tidy(text: Column) -> Column:
    """Inline blanks squeezed, runs of blank lines cut to one, every line trimmed."""
    text = F.translate(text, "\u00a0\u2009", "  ")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, rf"\n{P.SPACE}*\n{P.SPACE}*\n+", "\n\n")
    text = F.regexp_replace(text, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    text = F.regexp_replace(text, rf"{P.INLINE_SPACE}*\n{P.INLINE_SPACE}*", "\n")
    return strip(text)


def to_text(documents: DataFrame, raw: str = "html", out: str = "body") -> DataFrame:
    """Adds readable text: scripts, styles and heads skipped, block tags as line breaks.

    Only rows with a ``<`` go through the tag steps. References in markup are decoded
    twice, once as markup and once as text, which is what filings with double-escaped
    text need.
    """
    source = F.col(raw)
    stripped = F.when(source.contains("<"), F.col("_markup")).otherwise(source)
    decoded = (
        documents.withColumn(
            "_markup", F.when(source.contains("<"), _without_tags(source))
        )
        .withColumn("_markup", F.when(F.col("_markup").isNotNull(), unescape(F.col("_markup"))))
        .withColumn("_plain", unescape(stripped))
    )
    return read_once(decoded, documents.columns, {out: _tidy(F.col("_plain"))})


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole files as UTF-8 text, bad bytes replaced: path, raw."""
    return spark.read.format("binaryFile").load(paths).select(
        "path", F.decode("content", "UTF-8").alias("raw")
    )


def directory_listing(listings: DataFrame) -> DataFrame:
    """Document references of a filing: .htm, .html and .txt only, bad sizes read as 0.

    ``listings`` has cik, accession and items: array(struct(name, type, size)).
    """
    return (
        listings.select("cik", "accession", F.posexplode("items").alias("seq", "item"))
        .select(
            "cik", "accession", "seq",
            F.coalesce("item.name", F.lit("")).alias("name"),
            F.coalesce("item.type", F.lit("")).alias("kind"),
            F.coalesce(F.col("item.size").try_cast("bigint"), F.lit(0)).alias("size"),
        )
        .where(F.col("name").rlike(P.READABLE_SUFFIX))
    )
