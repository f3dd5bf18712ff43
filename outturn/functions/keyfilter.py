"""A Bloom filter of wanted keys, built by Spark and tested where the rows with long texts are read."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longs of the largest filter: beyond some 1.6 million keys it lets more rows through, and the join that follows drops them.
MOST_LONGS = 1 << 18
HASHES, BITS_A_KEY = 4, 10
_LOW = 2**32 - 1


def key_filter(keys: DataFrame, columns: list[str]) -> Callable[..., Column]:
    """A test that holds for every row of ``keys`` and for few others; it takes the key columns of another table.

    The size follows the counted keys up to a bound. Tasks set their own bits and Spark joins them; one long for each used place of
    the filter comes to the driver.
    """
    hashed = keys.select(F.xxhash64(*columns).alias("h"))
    longs, count = 64, hashed.count()
    while longs < MOST_LONGS and 64 * longs < BITS_A_KEY * count:
        longs *= 2
    low, high = F.col("h").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned("h", 32)
    bit = F.explode(F.array(*[(low + high * i) % F.lit(64 * longs) for i in range(HASHES)])).alias("bit")
    place, value = F.shiftright("bit", 6).alias("place"), F.expr("shiftleft(1L, cast(bit % 64 as int))")
    rows = hashed.select(bit).groupBy(place).agg(F.bit_or(value).alias("bits")).collect()
    table = np.zeros(longs, np.uint64)
    for at, bits in rows:
        table[at] = np.uint64(bits & (2**64 - 1))
    have = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def wanted(h: pd.Series) -> pd.Series:
        x = h.to_numpy(np.int64).view(np.uint64)
        ok = np.ones(len(x), bool)
        for i in range(HASHES):
            at = ((x & np.uint64(_LOW)) + (x >> np.uint64(32)) * np.uint64(i)) % np.uint64(64 * longs)
            ok &= (have.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pd.Series(ok)

    return lambda *other: wanted(F.xxhash64(*other))
