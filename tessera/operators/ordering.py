"""Dense indices, exclusive sums and dense arrays without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.session import Scratch


def _ranged(df: DataFrame, order: list[str], weight: Column) -> DataFrame:
    """Rows in ranges of ``order`` with their range's number and the sum of ``weight`` over all earlier ranges.

    The rows are written once, so that ranges stay as they are; only one small row for each range is collated.
    """
    scratch = Scratch(df.sparkSession, "ordering")
    ranged = df.withColumn("_w", weight).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = scratch.save(ranged, "ranges")
    sums = ranged.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(before.select("_part", "_before")), "_part")  # a row for each range


def with_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """``df`` with dense indices from 0 in the given order, which must be total for a definite result."""
    rows = _ranged(df, order, F.lit(1))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn(name, (F.col("_before") + within - 1).cast("bigint")).drop("_w", "_part", "_before")


def prefix_sum(df: DataFrame, order: list[str], value: str, name: str = "ps") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, in the given total order."""
    rows = _ranged(df, order, F.col(value))
    within = F.sum("_w").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, (F.col("_before") + F.coalesce(within, F.lit(0))).cast("bigint")).drop("_w", "_part", "_before")


def densify(df: DataFrame, n: int, default: Column) -> DataFrame:
    """(key, value) for every key from 0 to n - 1, with ``default`` where ``df`` has none."""
    every = df.sparkSession.range(n).withColumnRenamed("id", "key")
    own = df.withColumn("_there", F.lit(True))
    kind = df.schema["value"].dataType
    return every.join(own, "key", "left").select("key", F.when(F.col("_there"), F.col("value")).otherwise(default.cast(kind)).alias("value"))
