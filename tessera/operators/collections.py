"""Bags, sets, maps, arrays and their kin as DataFrames.

A collection wraps a DataFrame with a column ``value``, or with ``key`` and ``value``. Functions given to it take
and return Columns, so every chain of views compiles to one plan. Batches of keyed requests are DataFrames too:
``key``, arguments, and ``seq``, a column that puts requests in order. Where the order of arrival decides, the
smallest ``seq`` arrives first. Each batch replaces the state at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.reducers import Reducer, reduce_groups, reducer
from tessera.operators.ordering import densify, with_index
from tessera.session import Scratch

Fn = Callable[..., Column]


def _meet(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """A join on a column in which nulls are equal."""
    joined = left.join(right.withColumnRenamed(on, "_on"), F.col(on).eqNullSafe(F.col("_on")), how)
    return (joined.withColumn(on, F.coalesce(on, "_on")) if how == "full" else joined).drop("_on")


def _earliest(rows: DataFrame) -> Column:
    """Of several values of a key the one of the smallest ``seq``, without that column the smallest value; null is a value."""
    return (F.min_by(F.struct("value"), "seq") if "seq" in rows.columns else F.min(F.struct("value")))["value"].alias("value")


def _latest(rows: DataFrame) -> Column:
    return (F.max_by(F.struct("value"), "seq") if "seq" in rows.columns else F.max(F.struct("value")))["value"].alias("value")


class Collection:
    """What all kinds share: lazy views, reductions, top-k, gathering."""

    columns: tuple[str, ...] = ("value",)

    def __init__(self, df: DataFrame):
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"{type(self).__name__} needs columns {self.columns}, not {df.columns}")
        self.df = df.select(*self.columns)

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable, schema: str) -> Collection:
        """From a local list of values or (key, value) pairs."""
        rows = [r if isinstance(r, tuple) and len(cls.columns) > 1 else (r,) for r in rows]
        return cls(spark.createDataFrame(rows, schema))

    def _like(self, df: DataFrame) -> Collection:
        return type(self)(df)

    def _args(self) -> list[Column]:
        return [F.col(c) for c in self.columns]

    def transform(self, fn: Fn) -> Bag:
        return Bag(self.df.select(fn(*self._args()).alias("value")))

    def filter(self, predicate: Fn) -> Collection:
        return self._like(self.df.where(predicate(*self._args())))

    def flatten(self) -> Bag:
        """The elements of array values; empty and null arrays have none."""
        return Bag(self.df.select(F.explode("value").alias("value")))

    def for_all(self, fn: Callable[[DataFrame], object]) -> object:
        return fn(self.df)

    def collect_into(self, other: Collection) -> Collection:
        """All items of this collection inserted into another, under that one's rule of uniqueness.

        Into pairs go pairs, or values that are structs of two fields.
        """
        pairs = "key" in other.columns and "key" not in self.columns and not isinstance(other, CountingSet | TaggedBag)
        return other.insert(self.df.select("value.*").toDF("key", "value") if pairs else self.df)

    def insert(self, rows: DataFrame) -> Collection:
        return self._like(self.df.unionByName(rows.select(*self.columns)))

    def reduce(self, op: str | Reducer) -> object:
        """All values reduced to one; an empty collection raises."""
        how = reducer(op)
        if not how.bounded:
            if self.df.isEmpty():
                raise ValueError("reduce of an empty collection")
            return reduce_groups(self.df, [], "value", how, "v").first()["v"]
        row = self.df.agg(F.count(F.lit(1)).alias("n"), how.aggregate(F.col("value")).alias("v")).first()
        if not row["n"]:
            raise ValueError("reduce of an empty collection")
        return row["v"]

    def reduce_by_key(self, op: str | Reducer) -> Map:
        """(key, value) pairs reduced by key, with partial sums before the shuffle."""
        rows = self.df if "key" in self.df.columns else self.df.select("value.*").toDF("key", "value")
        return Map(reduce_groups(rows, ["key"], "value", op, "value"), unique=True)

    def topk(self, k: int, by: Fn | None = None) -> DataFrame:
        """The k largest items, of pairs those of largest value; ties go by key upwards."""
        first = by(*self._args()) if by else F.col("value")
        ties = [F.asc("key")] if "key" in self.columns else []
        return self.df.orderBy(first.desc(), *ties).limit(k)

    def gather(self) -> list:
        return [tuple(r) if len(r) > 1 else r[0] for r in self.df.collect()]

    def size(self) -> int:
        return self.df.count()

    def count(self, value) -> int:
        return self.df.where(F.col(self.columns[0]).eqNullSafe(F.lit(value))).count()

    def clear(self) -> Collection:
        return self._like(self.df.limit(0))

    def swap(self, other: Collection) -> None:
        self.df, other.df = other.df, self.df

    def save(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Collection:
        return cls(spark.read.parquet(path))


class Bag(Collection):
    """Items in no order, repeated ones included."""

    def rebalance(self, parts: int) -> Bag:
        return Bag(self.df.repartition(parts))

    def local_shuffle(self, seed: int) -> Bag:
        return Bag(self.df.sortWithinPartitions(F.rand(seed)))

    def global_shuffle(self, seed: int) -> Bag:
        return Bag(self.df.withColumn("_at", F.rand(seed)).repartitionByRange("_at").sortWithinPartitions("_at").drop("_at"))

    def pairs(self) -> Pairs:
        return Pairs(self.df.select("value.*").toDF("key", "value"))


class MultiSet(Collection):
    """Values that can be looked up; equal ones are kept."""

    def contains(self, requests: DataFrame) -> DataFrame:
        """``requests`` (value, ...) with a column ``contained``."""
        own = self.df.distinct().withColumn("_in", F.lit(True))
        return _meet(requests, own, "value", "left").withColumn("contained", F.coalesce("_in", F.lit(False))).drop("_in")

    def insert_contains(self, requests: DataFrame) -> tuple[Collection, DataFrame]:
        """Insert absent values of ``requests`` (value, seq); report for each request whether it was there before it."""
        first = requests.groupBy("value").agg(F.min("seq").alias("_first"))
        seen = _meet(self.contains(requests), first, "value", "inner")
        told = seen.withColumn("contained", F.col("contained") | (F.col("seq") > F.col("_first"))).drop("_first")
        new = seen.where(~F.col("contained")).select("value").distinct()
        return self._like(self.df.unionByName(new)), told

    def erase(self, values: DataFrame) -> Collection:
        """Without all copies of the given values."""
        return self._like(_meet(self.df, values.select("value").distinct(), "value", "left_anti"))


class Set(MultiSet):
    """Distinct values."""

    def __init__(self, df: DataFrame):
        super().__init__(df)
        self.df = self.df.distinct()

    def insert(self, rows: DataFrame) -> Set:
        return Set(self.df.unionByName(rows.select("value")))


class Pairs(Collection):
    """(key, value) rows, keys repeated."""

    columns = ("key", "value")

    def __init__(self, df: DataFrame, default: Column | None = None):
        super().__init__(df)
        self.default = F.lit(None) if default is None else default

    def _like(self, df: DataFrame) -> Pairs:
        return type(self)(df, self.default)

    def filter(self, predicate: Fn) -> Pairs:
        return self._like(self.df.where(predicate(*self._args())))

    def keys(self) -> Bag:
        return Bag(self.df.select(F.col("key").alias("value")))

    def values(self) -> Bag:
        return Bag(self.df.select("value"))

    def update(self, fn: Fn) -> Pairs:
        """Every value replaced by ``fn(key, value)``."""
        return self._like(self.df.select("key", fn(F.col("key"), F.col("value")).alias("value")))

    def _asked(self, requests: DataFrame, fold: Reducer | str) -> DataFrame:
        """(key, _arg, _asked): the requests (key, arg) of each key reduced."""
        return reduce_groups(requests, ["key"], "arg", fold, "_arg").withColumn("_asked", F.lit(True))

    def visit_if_contains(self, requests: DataFrame, fn: Callable[[Column, Column], Column], fold: Reducer | str) -> Pairs:
        """Reduce the requests (key, arg) of each key and apply ``fn(value, reduced)`` to that key's values.

        Null arguments do not count; requests of nulls alone give ``fn(value, null)``.
        """
        joined = _meet(self.df, self._asked(requests, fold), "key", "left")
        return self._like(joined.select("key", F.when(F.col("_asked"), fn(F.col("value"), F.col("_arg"))).otherwise(F.col("value")).alias("value")))

    def visit(self, requests: DataFrame, fn: Callable[[Column, Column], Column], fold: Reducer | str) -> Pairs:
        """As visit_if_contains; a key that is absent is inserted with the default value first."""
        joined = _meet(self.df.withColumn("_there", F.lit(True)), self._asked(requests, fold), "key", "full")
        value = F.when(F.col("_there"), F.col("value")).otherwise(self.default)
        return self._like(joined.select("key", F.when(F.col("_asked"), fn(value, F.col("_arg"))).otherwise(value).alias("value")))

    def visit_in_order(self, requests: DataFrame, fn: Callable[[Column, Column], Column]) -> Pairs:
        """``fn(value, arg)`` for each request (key, arg, seq) in turn; holds one key's requests in one row."""
        asked = requests.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "arg"))).alias("_args"))
        joined = _meet(self.df.withColumn("_there", F.lit(True)), asked, "key", "full")
        value = F.when(F.col("_there"), F.col("value")).otherwise(self.default)
        return self._like(joined.select("key", F.when(F.col("_args").isNull(), value).otherwise(F.reduce("_args", value, lambda v, x: fn(v, x["arg"]))).alias("value")))

    def erase(self, keys: DataFrame) -> Pairs:
        return self._like(_meet(self.df, keys.select("key").distinct(), "key", "left_anti"))

    def erase_pairs(self, pairs: DataFrame) -> Pairs:
        gone = pairs.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
        return self._like(self.df.join(gone, F.col("key").eqNullSafe(F.col("_k")) & F.col("value").eqNullSafe(F.col("_v")), "left_anti"))

    def gather_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys; absent keys have none."""
        return _meet(self.df, keys.select("key").distinct(), "key", "left_semi")

    def get(self, key) -> list:
        return [r["value"] for r in self.df.where(F.col("key").eqNullSafe(F.lit(key))).collect()]

    def at(self, key) -> object:
        found = self.get(key)
        if not found:
            raise KeyError(key)
        return found[0]


class Map(Pairs):
    """One value for each key; of several given for a key the first counts, by ``seq`` where there is one."""

    def __init__(self, df: DataFrame, default: Column | None = None, unique: bool = False):
        """``unique``: the keys are known to be, which saves a shuffle."""
        super().__init__(df if unique else df.groupBy("key").agg(_earliest(df)), default)

    def _like(self, df: DataFrame) -> Map:
        return type(self)(df, self.default, unique=True)

    def insert(self, rows: DataFrame) -> Map:
        """Insert (key, value[, seq]): a key that is there keeps its value, of several new ones the first counts."""
        new = _meet(rows.groupBy("key").agg(_earliest(rows)), self.df.select("key"), "key", "left_anti")
        return self._like(self.df.unionByName(new))

    def insert_or_assign(self, rows: DataFrame) -> Map:
        """Insert or overwrite (key, value, seq); of several the last counts."""
        new = rows.groupBy("key").agg(_latest(rows))
        return self._like(_meet(self.df, new.select("key"), "key", "left_anti").unionByName(new))

    def insert_if_missing_else_visit(self, rows: DataFrame, fn: Callable[[Column, Column], Column]) -> Map:
        """The first request (key, value, seq) of an absent key inserts its value; all others visit with theirs."""
        asked = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("_args"))
        joined = _meet(self.df.withColumn("_there", F.lit(True)), asked, "key", "full")
        args = F.when(F.col("_there"), F.coalesce("_args", F.array())).otherwise(F.slice("_args", 2, F.greatest(F.size("_args"), F.lit(1))))
        start = F.when(F.col("_there"), F.col("value")).otherwise(F.get("_args", F.lit(0))["value"])
        value = F.when(F.col("_args").isNull(), F.col("value")).otherwise(F.reduce(args, start, lambda v, x: fn(v, x["value"])))
        return self._like(joined.select("key", value.alias("value")))

    def reduce(self, op, rows: DataFrame | None = None):
        """Without ``rows``, all values reduced to one; else (key, value) rows merged in: a missing key takes the reduced value."""
        if rows is None:
            return super().reduce(op)
        how = reducer(op)
        new = reduce_groups(rows, ["key"], "value", how, "_new")
        joined = _meet(self.df.withColumn("_there", F.lit(True)), new, "key", "full")
        merged = F.when(F.col("_there").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("value")).otherwise(how.merge(F.col("_new"), F.col("value")))
        return self._like(joined.select("key", merged.alias("value")))


class MultiMap(Pairs):
    """Several values for a key."""

    def groups(self) -> DataFrame:
        """(key, values): each key's values in ascending order."""
        return self.df.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("values"))


class CountingSet(Map):
    """Keys with the number of times they were inserted."""

    @classmethod
    def counting(cls, bag: Collection) -> CountingSet:
        return cls(bag.df.groupBy(F.col(bag.columns[0]).alias("key")).agg(F.count(F.lit(1)).alias("value")), unique=True)

    def insert(self, rows: DataFrame) -> CountingSet:
        """Count each row's ``key``, or ``value`` where there is no key."""
        return self.add(Bag(rows.select(F.col("key" if "key" in rows.columns else "value").alias("value"))))

    def add(self, bag: Collection) -> CountingSet:
        return self._like(self.df.unionByName(CountingSet.counting(bag).df).groupBy("key").agg(F.sum("value").alias("value")))

    def count(self, key) -> int:
        return (self.get(key) or [0])[0]

    def count_all(self) -> int:
        return self.df.agg(F.coalesce(F.sum("value"), F.lit(0))).first()[0]


class TaggedBag(Map):
    """Items under generated tags, unique but in no order; tagged items are a written table, so tags stay as they are."""

    @classmethod
    def tagging(cls, bag: Bag) -> TaggedBag:
        tagged = bag.df.select(F.monotonically_increasing_id().alias("key"), "value")
        return cls(Scratch(bag.df.sparkSession, "tags").save(tagged, "items"), unique=True)

    def insert(self, rows: DataFrame) -> TaggedBag:
        """Items (value) under new tags; ``insert_tagged`` also tells them."""
        return self.insert_tagged(rows)[0]

    def insert_tagged(self, rows: DataFrame) -> tuple[TaggedBag, DataFrame]:
        """The bag with the items (value, ...), and the items with their tags (key, value, ...)."""
        first = (self.df.agg(F.max("key")).first()[0] or -1) + 1
        new = Scratch(rows.sparkSession, "tags").save(rows.withColumn("key", F.lit(first) + F.monotonically_increasing_id()), "items")
        return self._like(self.df.unionByName(new.select("key", "value"))), new

    def visit_if_exists(self, requests: DataFrame, fn: Callable[[Column, Column], Column], fold: Reducer | str) -> Pairs:
        """As visit_if_contains, by tag."""
        return self.visit_if_contains(requests, fn, fold)


class Array(Pairs):
    """Values under the indices 0 to n - 1; an index without a row has the default value."""

    def __init__(self, df: DataFrame, size: int | None = None, default: Column | None = None):
        super().__init__(df, default)
        if size is None:
            largest = self.df.agg(F.max("key")).first()[0]
            size = 0 if largest is None else largest + 1
        self.n = size

    def _like(self, df: DataFrame) -> Array:
        return Array(df, self.n, self.default)

    def clear(self) -> Array:
        return Array(self.df.limit(0), 0, self.default)

    def insert(self, rows: DataFrame) -> Array:
        """Assign (key, value[, seq]) to indices that are there; size and default stay."""
        return self.set(rows)

    @classmethod
    def from_values(cls, df: DataFrame, order: Iterable[str]) -> Array:
        """Values in the given order of columns, which must be unique, under dense indices."""
        indexed = with_index(df, list(order), "key").select("key", "value")
        return cls(indexed)

    @classmethod
    def of_size(cls, spark: SparkSession, size: int, kind: str, default: Column | None = None) -> Array:
        """An array of ``size`` default values of the type ``kind``; only other values take up rows."""
        return cls(spark.createDataFrame([], f"key bigint, value {kind}"), size, default)

    @classmethod
    def of_values(cls, spark: SparkSession, values: Iterable, kind: str) -> Array:
        """Values of a local list in its order."""
        rows = list(enumerate(values))
        return cls(spark.createDataFrame(rows, f"key bigint, value {kind}"), len(rows))

    @classmethod
    def from_bag(cls, bag: Bag) -> Array:
        """A bag's items under dense indices, in an order that is not defined but stays as it is."""
        placed = Scratch(bag.df.sparkSession, "array").save(bag.df.withColumn("_at", F.monotonically_increasing_id()), "items")
        return cls.from_values(placed, ["_at"])

    @classmethod
    def from_pairs(cls, df: DataFrame, default: Column | None = None) -> Array:
        """(key, value[, seq]) pairs; of equal keys the last counts; the size is the largest key and one."""
        return cls(df.groupBy("key").agg(_latest(df)), default=default)

    def dense(self) -> DataFrame:
        return densify(self.df, self.n, self.default)

    def set(self, rows: DataFrame) -> Array:
        new = self._checked(rows).groupBy("key").agg(_latest(rows))
        return self._like(self.df.join(new.select("key"), "key", "left_anti").unionByName(new))

    def _checked(self, rows: DataFrame) -> DataFrame:
        inside = (F.col("key") >= 0) & (F.col("key") < self.n)
        return rows.withColumn("key", F.when(inside, F.col("key")).otherwise(F.raise_error(F.lit("index out of range")).cast("bigint")))

    def apply(self, op: str | Reducer, rows: DataFrame) -> Array:
        """``value = op(value, arg)`` for each request (key, value), with partial reductions; the default takes part."""
        how = reducer(op)
        new = reduce_groups(self._checked(rows), ["key"], "value", how, "_new")
        joined = self.dense().join(new, "key", "left")
        return self._like(joined.select("key", F.when(F.col("_new").isNull(), F.col("value")).otherwise(how.merge(F.col("value"), F.col("_new"))).alias("value")))

    def plus(self, rows: DataFrame) -> Array:
        return self.apply("sum", rows)

    def minus(self, rows: DataFrame) -> Array:
        return self.apply("sum", rows.withColumn("value", -F.col("value")))

    def logical_and(self, rows: DataFrame) -> Array:
        return self.apply("and", rows)

    def logical_or(self, rows: DataFrame) -> Array:
        return self.apply("or", rows)

    def increment(self, keys: DataFrame) -> Array:
        return self.plus(keys.select("key", F.lit(1).alias("value")))

    def decrement(self, keys: DataFrame) -> Array:
        return self.minus(keys.select("key", F.lit(1).alias("value")))

    def multiplies(self, rows: DataFrame) -> Array:
        """Each product in turn, in the type of the values; needs ``seq`` only where overflow is wanted in order."""
        return self._in_order(rows, lambda v, x: v * x)

    def divides(self, rows: DataFrame, integral: bool = False) -> Array:
        """Each quotient in turn by ``seq``; integers are cut towards zero."""
        return self._in_order(rows, lambda v, x: (v / x).cast("bigint") if integral else v / x)

    def _in_order(self, rows: DataFrame, fn: Callable[[Column, Column], Column]) -> Array:
        kind = self.df.schema["value"].dataType
        asked = self._checked(rows).select("key", F.col("value").alias("arg"), F.col("seq") if "seq" in rows.columns else F.lit(0).alias("seq"))
        return self._like(Pairs(self.dense()).visit_in_order(asked, lambda v, x: fn(v, x).cast(kind)).df)

    def resize(self, n: int, fill: Column) -> Array:
        """Cut off, or extended by ``fill``, which is the default from then on."""
        kept = densify(self.df, self.n, self.default).where(F.col("key") < n)
        return Array(kept, n, fill)

    def sort(self, ties: DataFrame | None = None) -> Array:
        """Values in ascending order under the indices from 0; equal values are interchangeable."""
        return Array(with_index(self.dense().select("value", F.col("key").alias("_k")), ["value", "_k"], "key").select("key", "value"), self.n, self.default)
