"""Sums of short vectors over a table: each task adds up its own, Spark adds up the rest by position."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_sum(df: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], length: int, kind: str = "double") -> np.ndarray:
    """Sum over all rows of the vectors that ``partial`` makes of each Arrow batch.

    The length belongs to the model and not to the data, so the driver holds as much at any size. ``bigint`` sums don't depend on
    the order of tasks.
    """
    number = np.int64 if kind == "bigint" else np.float64

    def run(batches):
        total = np.zeros(length, number)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "value"])

    rows = df.mapInArrow(run, f"slot int, value {kind}").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(length, number)
    out[rows["slot"].to_numpy()] = rows["value"].to_numpy()
    return out


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    values = batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def newton(evaluate: Callable[[np.ndarray], tuple], theta: np.ndarray, steps: int = 60) -> np.ndarray:
    """Minimises one convex loss per row of ``theta`` by Newton steps, halved where they don't help.

    ``evaluate`` gives losses, gradients and Hessians of all rows at once.
    """
    loss, slope, curve = evaluate(theta)
    ridge = 1e-10 * np.eye(theta.shape[1])
    for _ in range(steps):
        step = np.linalg.solve(curve + ridge, -slope[:, :, None])[:, :, 0]
        for _ in range(20):
            trial = evaluate(theta + step)
            worse = ~(trial[0] <= loss + 1e-9 * np.maximum(1, np.abs(loss)))
            if not worse.any():
                break
            step[worse] /= 2
        theta = theta + step
        loss, slope, curve = trial
        if np.abs(step).max() < 1e-9 * max(1.0, np.abs(theta).max()):
            break
    return theta
