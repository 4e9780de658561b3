"""A bitmap of hashed keys: which rows may have a key of a set, without a shuffle of the rows.

Rows that the bitmap rules out need not travel to a join or grouping; the others go to the exact one. The
bitmap has a fixed size. Where a set outgrows it, it rules out less, and results stay the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 8 MB on the driver and in each task.
BITS = 1 << 26


def may_hold(keys: DataFrame, *columns: str, bits: int = BITS):
    """A function that makes, of columns of the same types as keys' `columns`, a boolean column: false only where keys has no such row.

    Equal keys are one bit, nulls are keys like others; no rows rule out everything.
    """

    def place(values) -> Column:
        return F.pmod(F.xxhash64(*values), F.lit(bits))

    at = place([F.col(c) for c in columns]) + 1  # Spark's bitmaps count from 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("held"))
    held = np.zeros(-(-bits // 8 // 4096) * 4096, np.uint8)
    for r in rows.collect():  # as many as the bitmap has parts of 4 kB, whatever the number of keys
        held[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.held, np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(held)

    def test(places: pd.Series) -> pd.Series:
        x = places.to_numpy()
        return pd.Series((shared.value[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool))

    held_there = F.pandas_udf(test, "boolean")
    return lambda *values: held_there(place(values))
