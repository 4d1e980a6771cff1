"""A bitmap of fixed size that tells most values apart from a set.

The set's values are hashed to two bits each; a value whose bits are not both
set is surely not in the set.  The bitmap is a literal of the plan, so rows are
tested where they are, before anything is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expr import Sql

# Bits per value, and the least and the largest number of bits of a bitmap.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 22


class Bitmap:
    """Of the 64-bit hashes in the column ``h`` of a table.

    The driver gets at most ``MOST_BITS / 64`` words.  A set that is too large for
    them fills the bitmap, which then lets more through; nothing is lost.
    """

    def __init__(self, hashes: DataFrame):
        distinct = hashes.select("h").distinct()
        wanted = BITS_EACH * max(1, distinct.count())
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length()))
        self.mask = bits - 1
        places = distinct.select(F.explode(F.expr(f"array({', '.join(self._places('h'))})")).alias("p"))
        words = dict(
            places.groupBy(F.expr("shiftright(p, 6)").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("value"))
            .collect()
        )
        listed = ",".join(str(words.get(i, 0)) for i in range(bits // 64))
        self.literal = f"cast(split('{listed}', ',') AS array<bigint>)"

    def _places(self, h: Sql) -> list[Sql]:
        return [f"({h} & {self.mask}L)", f"(shiftrightunsigned({h}, 32) & {self.mask}L)"]

    def may_hold(self, h: Sql) -> Sql:
        """False for a hash that is not in the set."""
        tests = [
            f"(shiftright(get({self.literal}, cast(shiftright({p}, 6) AS int)), "
            f"cast({p} & 63 AS int)) & 1L) = 1L"
            for p in self._places(h)
        ]
        return f"({' AND '.join(tests)})"
