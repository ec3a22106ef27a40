"""Collective operations: one value from all rows, or one value for all tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.reducers import Reducer, reduce_groups

#: Bytes of a pickled value that is sent to all tasks at most.
BROADCAST_BYTES = 64 << 20


def all_reduce(df: DataFrame, value: str, op: str | Reducer | Callable[[Column, Column], Column], by: list[str] | None = None) -> DataFrame:
    """(by..., value): all values, or those of each group, merged; by a tree where the operation is one's own."""
    return reduce_groups(df, by or [], value, op, "value")


def logical_and(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return all_reduce(df, value, "and", by)


def logical_or(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return all_reduce(df, value, "or", by)


def is_same(df: DataFrame, value: str, by: list[str] | None = None, name: str = "same") -> DataFrame:
    """(by..., name): whether all values are equal; nulls are equal to nulls only. No rows at all are the same."""
    v = F.col(value)
    some, none = F.count(v), F.count(F.when(v.isNull(), 1))
    same = F.coalesce(F.min(v) == F.max(v), F.lit(True)) & ((some == 0) | (none == 0))
    return df.groupBy(*(by or [])).agg(same.alias(name))


def bcast(spark: SparkSession, value: object) -> Broadcast:
    """One value for all tasks; a value beyond BROADCAST_BYTES is refused, as every executor would hold it."""
    import pickle

    size = len(pickle.dumps(value))
    if size > BROADCAST_BYTES:
        raise ValueError(f"a broadcast of {size} bytes; at most {BROADCAST_BYTES}")
    return spark.sparkContext.broadcast(value)
