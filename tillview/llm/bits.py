"""A bit table of fixed size that tells which 64-bit values cannot be in a set."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_BITS = 24
MASK = (1 << TABLE_BITS) - 1


@dataclass(frozen=True)
class BitTable:
    """Two megabytes, whatever the size of the set: a full table only lets more pass."""

    bits: np.ndarray

    def _marked(self, bit: np.ndarray) -> np.ndarray:
        return (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        """Places of the unsigned values that may be in the set; none that is in it is left out."""
        near = np.flatnonzero(self._marked((values & np.uint64(MASK)).astype(np.int64)))
        high = (values[near] >> np.uint64(32)) & np.uint64(MASK)
        return near[self._marked(high.astype(np.int64))]


def bit_table(rows: DataFrame, value: str) -> BitTable:
    """The table of a column of longs; the driver gets a row per 64 bits at most."""
    low = F.col(value).bitwiseAND(F.lit(MASK))
    high = F.shiftrightunsigned(value, 32).bitwiseAND(F.lit(MASK))
    places = rows.select(F.explode(F.array(low, high)).alias("bit"))
    bits = F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")
    found = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(bits).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return BitTable(table.view(np.uint8))
