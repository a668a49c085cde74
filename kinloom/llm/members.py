"""A set of keys as a filter of fixed size, small enough to broadcast whatever the input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 64-bit words of the filter (8 MB); fixed, so it may be broadcast.
WORDS = 1 << 20


def filter_of(keys: DataFrame) -> np.ndarray:
    """The filter of a column of long hashes ``key``. A key sets one bit; bits are combined before they are sent."""
    word = F.shiftrightunsigned("key", 6).bitwiseAND(WORDS - 1).cast("int").alias("word")
    words = keys.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(WORDS, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the set; what is in it always may."""
    keys = keys.view(np.uint64)
    words = table[((keys >> np.uint64(6)) & np.uint64(WORDS - 1)).astype(np.int64)]
    return (words >> (keys & np.uint64(63))) & np.uint64(1) == 1
