"""A bit filter of bounded size: which keys may stand in a small table, asked before the rows of a large one are shuffled.

A key (a 64-bit hash) sets three bits of one 64-bit word. The filter takes some 16 bits a key up to MOST_WORDS words (32 MB): it
stays that small for any number of keys, and then lets more rows through, never fewer. It is built by one aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithms of the least and greatest number of 64-bit words.
LEAST_LOG, MOST_LOG = 6, 22


def _masks(keys: np.ndarray) -> np.ndarray:
    one, six = np.uint64(1), np.uint64(63)
    return (one << (keys & six)) | (one << ((keys >> np.uint64(6)) & six)) | (one << ((keys >> np.uint64(12)) & six))


def build(keys: DataFrame, column: str, rows: int, most: int = MOST_LOG) -> np.ndarray:
    """The filter over the values of a long column that holds well-mixed hashes; rows: about how many there are.

    At most 2^most rows of two numbers come to the driver.
    """
    log = min(most, max(LEAST_LOG, (max(rows, 1) // 4).bit_length()))
    h = f"`{column}`"
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {s}) & 63 as int))" for s in (0, 6, 12))
    words = keys.where(F.col(column).isNotNull()).select(F.expr(f"shiftrightunsigned({h}, {64 - log})").alias("word"), F.expr(bits).alias("bits"))
    table = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << log, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter: never False for one that is."""
    keys = keys.view(np.uint64)
    log = len(words).bit_length() - 1
    masks = _masks(keys)
    return (words[(keys >> np.uint64(64 - log)).astype(np.int64)] & masks) == masks


def holds(words, column: str):
    """A boolean column: may_hold for a long column, with the filter as a broadcast variable."""
    @F.pandas_udf("boolean")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(may_hold(words.value, keys.to_numpy(np.int64)))

    return run(F.col(column))


def arrow(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())
