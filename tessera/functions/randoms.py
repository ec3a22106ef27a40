"""Seeded random columns: the same seed and partitioning give the same values, other partitions other streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Engine:
    """A source of random columns; every column drawn has a stream of its own, in the order of the calls."""

    def __init__(self, seed: int):
        self.seed, self.drawn = seed, 0

    def _next(self) -> int:
        self.drawn += 1
        return self.seed + 0x9E3779B1 * (self.drawn - 1)

    def uniform(self, low: float = 0.0, high: float = 1.0) -> Column:
        return F.lit(low) + F.rand(self._next()) * F.lit(high - low)

    def integers(self, low: int, high: int) -> Column:
        """Whole numbers from ``low`` to ``high``, both included."""
        return F.least(F.floor(F.rand(self._next()) * F.lit(high - low + 1)) + F.lit(low), F.lit(high)).cast("bigint")

    def normal(self, mean: float = 0.0, deviation: float = 1.0) -> Column:
        return F.lit(mean) + F.randn(self._next()) * F.lit(deviation)
