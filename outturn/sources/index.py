"""Quarterly index files: lines in, index rows out, nothing dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outturn.functions import patterns as P
from outturn.functions.lineage import cut
from outturn.functions.text import let, read_once


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Lines with their file and their order in it: file, block, at, line.

    Files stay splittable. ``block`` is where the split starts in the file and ``at``
    grows within a split, so (block, at) orders the lines of one file.
    """
    lines = spark.read.text(paths)
    # the text source keeps the bytes of a line as they are
    decoded = F.decode(F.col("value").cast("binary"), encoding)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.explode(F.split(decoded, r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("line"),
    )


_MARK = "\ue000"  # private use: a line that has it takes the slower path


def parse_row(line: Column) -> Column:
    """struct(form, company, cik, filed, path, accession), null when the line is no row.

    Anchored on the right (cik, date, path), never on column positions. The pattern runs once a line.
    """

    def row(part: list[Column]) -> Column:
        return F.struct(
            part[0].alias("form"),
            part[1].alias("company"),
            part[2].cast("bigint").alias("cik"),
            part[3].try_cast("date").alias("filed"),
            part[4].alias("path"),
            accession(part[4]).alias("accession"),
        )

    marked = F.regexp_replace(line, P.INDEX_ROW, _MARK.join(f"${i}" for i in range(1, 6)))
    once = let(F.split(marked, _MARK, -1), lambda p: F.when(F.size(p) == 5, row([F.get(p, i) for i in range(5)])))
    again = F.when(line.rlike(P.INDEX_ROW), row([F.regexp_extract(line, P.INDEX_ROW, i) for i in range(1, 6)]))
    return F.when(line.contains(_MARK), again).otherwise(once)


def accession(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def no_dash(accession_number: Column) -> Column:
    return F.replace(accession_number, F.lit("-"), F.lit(""))


#: Files whose rulers, one row each, are sent to all tasks; more are met by a join.
MOST_RULERS = 100_000


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines below each file's ruler of dashes, blank ones left out.

    The rulers are written and counted first, so that lines are read once for them: as long as they are few, no line is shuffled,
    however many of them one file has.
    """
    place = F.struct("block", "at")
    rulers = cut(
        lines.where(F.col("line").startswith(P.INDEX_RULER))
        .groupBy("file")
        .agg(F.min(place).alias("ruler"))
    )
    if rulers.count() <= MOST_RULERS:
        rulers = F.broadcast(rulers)
    return (
        lines.join(rulers, "file")
        .where((place > F.col("ruler")) & F.col("line").rlike(f"[^{P.SPACE_CHARS}]"))
        .drop("ruler")
    )


def scan_index(lines: DataFrame) -> DataFrame:
    """Data lines with ``row``, the parsed struct, null where a line would not parse."""
    below = data_lines(lines)
    return read_once(below, below.columns, {"row": parse_row(F.col("line"))})


def kept_rows(scanned: DataFrame, keep: Column) -> DataFrame:
    """Parsed rows whose form passes ``keep``, a predicate over the column ``form``."""
    return scanned.where(F.col("row").isNotNull()).select("file", "row.*").where(keep)


def rejected_lines(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("row").isNull()).select("file", "line")


def scan_counts(scanned: DataFrame) -> DataFrame:
    """Per file: data lines seen and lines that would not parse."""
    return scanned.groupBy("file").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("row").isNull()).alias("unparsed")
    )


def quarters(spark: SparkSession, start_year: int, end_year: int) -> DataFrame:
    return spark.range(start_year, end_year + 1).select(
        F.col("id").cast("int").alias("year"),
        F.explode(F.sequence(F.lit(1), F.lit(4))).alias("quarter"),
    )


def missing_quarters(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.join(present.select("year", "quarter").distinct(), ["year", "quarter"], "left_anti")


def write_quarters(rows: DataFrame, path: str) -> None:
    """Kept rows partitioned by the quarter they were filed in; rerun quarters are replaced."""
    (
        rows.withColumns({"year": F.year("filed"), "quarter": F.quarter("filed")})
        .write.option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "quarter")
        .mode("overwrite")
        .parquet(path)
    )
