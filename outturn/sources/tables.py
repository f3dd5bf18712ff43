"""Reading and writing the stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; a path that does not exist is an empty table."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(hadoop_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_rows(rows: DataFrame, path: str, order: list[str] = ("announced", "cik")) -> None:
    """JSON lines in a deterministic order, range-partitioned so no single task sorts all."""
    rows.orderBy(*order).write.mode("overwrite").json(path)


def write_payload(payload: DataFrame, path: str) -> None:
    """A result summary: (section, metric, value) rows, or a one-row struct, as JSON.

    Only the last, small rows meet in one task; what computes them stays spread.
    """
    payload.repartition(1).write.mode("overwrite").json(path)


def slim(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return rows.select(*[c for c in keep if c in rows.columns])


