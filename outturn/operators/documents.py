"""Which document of a filing to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outturn.functions import patterns as P
from outturn.functions.keyfilter import key_filter
from outturn.functions.lineage import cut


def _lower_is_first() -> F.Column:
    return -F.col("seq")


def primary_documents(refs: DataFrame, filings: DataFrame) -> DataFrame:
    """The primary document per filing, as (accession, name, size).

    ``refs`` has accession, name, kind, size and seq (listing order); ``filings`` has
    accession, form and primary_document. In order of preference: the named document;
    one whose type is the form, largest first; an HTML file that is no exhibit, then one
    that names the form, then the largest; the largest plain file without a dash.
    """
    wanted = filings.select(
        "accession", F.upper(F.trim("form")).alias("_form"),
        F.nullif("primary_document", F.lit("")).alias("_named"),
    )
    name, lower = F.col("name"), F.lower("name")
    html = name.rlike(P.HTML_SUFFIX) & ~lower.startswith("r")
    plain = lower.endswith(".txt") & ~name.contains("-")
    tier = (
        F.when(F.coalesce(name == F.col("_named"), F.lit(False)), 4)
        .when(F.upper(F.trim("kind")) == F.col("_form"), 3)
        .when(html, 2)
        .when(plain, 1)
    )
    preferred = F.struct(
        F.col("_tier"),
        F.when(F.col("_tier") == 2, ~name.rlike(P.EXHIBIT_NAME)).otherwise(True).alias("no_exhibit"),
        F.when(F.col("_tier") == 2, name.rlike(P.CURRENT_REPORT_NAME)).otherwise(True).alias("names_form"),
        F.when(F.col("_tier") == 4, 0).otherwise(F.col("size")).alias("size"),
        _lower_is_first().alias("order"),
    )
    best = F.max(F.struct(preferred.alias("rank"), "name", "size"))
    return (
        refs.join(wanted, "accession")
        .withColumn("_tier", tier)
        .where("_tier is not null")
        .groupBy("accession")
        .agg(best.alias("best"))
        .select("accession", F.col("best.name").alias("name"), F.col("best.size").alias("size"))
    )


def press_releases(refs: DataFrame) -> DataFrame:
    """The largest exhibit-99 document per filing, as (accession, press_release)."""
    name = F.col("name")
    candidates = refs.where(name.rlike(P.PRESS_RELEASE_NAME) & name.rlike(P.READABLE_SUFFIX))
    best = F.max(F.struct("size", _lower_is_first().alias("order"), "name"))
    return candidates.groupBy("accession").agg(best.alias("best")).select(
        "accession", F.col("best.name").alias("press_release")
    )


def only_wanted(bodies: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The documents someone asked for.

    A filter of the wanted keys is tested where the texts are read, so that those nobody wants are never shuffled, however many
    keys there are; the join behind it drops what the filter let through by chance.
    """
    asked = cut(wanted.select(*keys).where(F.col(keys[0]).isNotNull()).distinct())
    may = key_filter(asked, keys)
    return bodies.where(may(*[F.col(k) for k in keys])).join(asked, keys, "left_semi")


def announcement_texts(primary: DataFrame, releases: DataFrame, bodies: DataFrame) -> DataFrame:
    """accession, document, press_release and the two texts joined by a blank line.

    ``bodies`` has accession, name and body. An accession is one row with both chosen names; the texts are dealt by
    accession once, for the join, and put together where they are.
    """
    chosen = cut(
        primary.join(releases, "accession", "left").select("accession", F.col("name").alias("document"), "press_release")
    )
    names = chosen.select("accession", F.explode(F.array_compact(F.array("document", "press_release"))).alias("name"))
    may = key_filter(names, ["accession", "name"])
    texts = bodies.select("accession", "name", "body").where(may(F.col("accession"), F.col("name")))
    parts = {"main": "document", "release": "press_release"}
    read = (
        chosen.join(texts, "accession", "left")
        .groupBy("accession", "document", "press_release")
        .agg(*[F.max(F.when(F.col("name") == F.col(column), F.col("body"))).alias(part) for part, column in parts.items()])
    )
    return read.select(
        "accession", "document", "press_release",
        F.when(F.col("main").isNotNull(), F.concat_ws("\n\n", "main", "release")).alias("body"),
    )
