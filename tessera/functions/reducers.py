"""Binary reducers as aggregates: named ones with partial sums, others as a fold by a tree of bounded rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import Scratch

#: Values that a step of a fold of one's own holds in one row, about.
FOLD = 1024


@dataclass(frozen=True)
class Reducer:
    """``aggregate`` reduces a column; ``merge(new, old)`` joins two reduced values; ``bounded``: its state has a fixed size."""

    aggregate: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    bounded: bool = True


_NAMED = {
    "sum": Reducer(F.sum, lambda a, b: a + b),
    "count": Reducer(F.count, lambda a, b: a + b),
    "min": Reducer(F.min, F.least),
    "max": Reducer(F.max, F.greatest),
    "bit_and": Reducer(F.bit_and, lambda a, b: a.bitwiseAND(b)),
    "bit_or": Reducer(F.bit_or, lambda a, b: a.bitwiseOR(b)),
    "bit_xor": Reducer(F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "and": Reducer(F.bool_and, lambda a, b: a & b),
    "or": Reducer(F.bool_or, lambda a, b: a | b),
    "product": Reducer(F.product, lambda a, b: a * b),
}


def folded(op: Callable[[Column, Column], Column]) -> Reducer:
    """An associative and commutative operation of one's own; an aggregate holds a group's values in one row."""

    def aggregate(column: Column) -> Column:
        values = F.array_sort(F.collect_list(column))
        return F.when(F.size(values) > 0, F.reduce(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.get(values, F.lit(0)), op))

    return Reducer(aggregate, op, bounded=False)


def reducer(op: str | Reducer | Callable[[Column, Column], Column]) -> Reducer:
    if isinstance(op, Reducer):
        return op
    if isinstance(op, str):
        if op not in _NAMED:
            raise ValueError(f"no reducer {op!r}; known: {sorted(_NAMED)}")
        return _NAMED[op]
    return folded(op)


def reduce_groups(rows: DataFrame, keys: list[str], value: str, op: str | Reducer | Callable, name: str) -> DataFrame:
    """(keys..., name): the values of each group reduced. Null values are left out; a group without others has null.

    Named reducers have partial sums. An operation of one's own goes up a tree: groups of more than FOLD values are
    dealt to seats, each seat is reduced, and the results are dealt again, so that no row holds a large group.
    """
    how = reducer(op)
    rows = rows.select(*keys, F.col(value).alias("_v"))
    while not how.bounded:
        most = rows.groupBy(*keys).agg(F.count("_v").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= FOLD:
            break
        dealt = rows.withColumn("_seat", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-2 * most // FOLD))))
        dealt = dealt.groupBy(*keys, "_seat").agg(how.aggregate(F.col("_v")).alias("_v"))
        rows = Scratch(rows.sparkSession, "fold").save(dealt.select(*keys, "_v"), "step")
    return rows.groupBy(*keys).agg(how.aggregate(F.col("_v")).alias(name))
