"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch; a batch of whole texts has to fit a Python worker several times over.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="outturn-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Removes the shuffle files of a job when it has ended, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> None:
    """Writes ``df``, whose shuffle files are of no use afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut, and a lost executor costs only a read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    written(df, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables that ``staged`` wrote, once what was made of them has been written as well."""
    for df in frames:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def text_key(column: str = "text") -> Column:
    """64-bit hash of a whole text; a null text counts as empty. What follows from the text alone can be decided by it, whatever the ids."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def without_texts(documents: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows whose text's key is not in ``bad.key``."""
    return documents.join(bad.select(F.col("key").alias("_bad")), text_key() == F.col("_bad"), "left_anti")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(modulus), F.lit(0)).cast("int")


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def map_texts(
    df: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str
) -> DataFrame:
    """Runs ``make()`` once per task and its result on slices of each Arrow batch of ``columns``.

    The session's Arrow batches are kept to as many rows, as a worker holds a batch of whole texts in memory.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch):
                yield from step(part)

    return df.select(*columns).mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i]+1, ... of each i, one after the other."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(np.asarray(starts, np.int64) - (ends - counts), counts) + np.arange(total)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights (the last one is the intercept) by damped Newton steps on the weighted logistic loss."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(z)) if weight is None else weight
    beta, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ beta)
        slope = z.T @ (weight * (y - p)) - penalty * beta
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        step /= max(1.0, np.abs(step).max() / 4)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta
