import pytest
from pyspark.sql import functions as F

from tessera.functions import reducers
from tessera.functions.randoms import Engine
from tessera.operators.collectives import all_reduce, bcast, is_same
from tessera.operators.collections import Array, Bag, CountingSet, Map, MultiMap, MultiSet, Pairs, Set, TaggedBag
from tessera.operators.ordering import prefix_sum, with_index

INTS = [42, 1, 8, 16, 32, 3, 4, 5, 6, 7]
FISH = "one fish two fish red fish blue fish".split()


def rows(c):
    return sorted(tuple(r) for r in c.df.collect())


def test_views_and_reductions(spark):
    bag = Bag.of(spark, INTS, "value int")
    assert bag.reduce("sum") == 124
    assert bag.filter(lambda v: v % 2 == 0).reduce("sum") == 108
    assert bag.transform(lambda v: v + 1).reduce("sum") == 134
    assert bag.topk(2).collect() == [(42,), (32,)]
    assert bag.reduce(lambda a, b: F.greatest(a, b)) == 42
    with pytest.raises(ValueError):
        bag.clear().reduce("sum")


def test_flatten_skips_empty_and_null(spark):
    bag = Bag(spark.createDataFrame([([1, 2],), ([],), (None,)], "value array<int>"))
    assert sorted(bag.flatten().gather()) == [1, 2]


def test_counting(spark):
    counted = CountingSet.counting(Bag.of(spark, FISH, "value string"))
    assert counted.topk(1).collect() == [("fish", 4)]
    assert counted.count("fish") == 4 and counted.count("cat") == 0 and counted.count_all() == 8 and counted.size() == 5


def test_sets(spark):
    own = Set.of(spark, [1, 1, 2, 3], "value int")
    assert own.size() == 3
    asked = spark.createDataFrame([(2, 1), (9, 2), (9, 3)], "value int, seq int")
    after, told = own.insert_contains(asked)
    assert sorted((r.seq, r.contained) for r in told.collect()) == [(1, True), (2, False), (3, True)]
    assert after.size() == 4
    assert rows(MultiSet.of(spark, [1, 1, 2], "value int").erase(spark.createDataFrame([(1,)], "value int"))) == [(2,)]


def test_map_rules(spark):
    own = Map.of(spark, [("dog", "cat"), ("red", "green")], "key string, value string")
    new = spark.createDataFrame([("dog", "x", 1), ("new", "b", 3), ("new", "a", 2)], "key string, value string, seq int")
    assert rows(own.insert(new)) == [("dog", "cat"), ("new", "a"), ("red", "green")]
    assert rows(own.insert_or_assign(new)) == [("dog", "x"), ("new", "b"), ("red", "green")]
    assert rows(own.insert_if_missing_else_visit(new, lambda v, x: F.concat(v, x))) == [("dog", "catx"), ("new", "ab"), ("red", "green")]
    assert own.at("dog") == "cat"
    with pytest.raises(KeyError):
        own.at("none")


def test_map_visits_and_erases(spark):
    own = Map(spark.createDataFrame([(i, i) for i in range(5)], "key int, value int"), F.lit(0))
    asked = spark.createDataFrame([(1, 10), (1, 5), (9, 7)], "key int, arg int")
    assert dict(rows(own.visit(asked, lambda v, x: v + x, "sum"))) == {0: 0, 1: 16, 2: 2, 3: 3, 4: 4, 9: 7}
    assert dict(rows(own.visit_if_contains(asked, lambda v, x: v + x, "sum"))) == {0: 0, 1: 16, 2: 2, 3: 3, 4: 4}
    assert rows(own.erase(spark.createDataFrame([(0,), (1,)], "key int"))) == [(2, 2), (3, 3), (4, 4)]
    assert len(rows(own.erase_pairs(spark.createDataFrame([(2, 2), (3, 4)], "key int, value int")))) == 4
    merged = own.reduce("max", spark.createDataFrame([(1, 9), (1, 3), (7, 7)], "key int, value int"))
    assert dict(rows(merged))[1] == 9 and dict(rows(merged))[7] == 7


def test_multimap_groups_and_tags(spark):
    groups = MultiMap.of(spark, [("foo", "qux"), ("foo", "barr"), ("foo", "baz")], "key string, value string").groups()
    assert groups.collect() == [("foo", ["barr", "baz", "qux"])]
    assert len({r.key for r in TaggedBag.tagging(Bag.of(spark, FISH, "value string")).df.collect()}) == 8


def test_arrays(spark):
    own = Array(spark.createDataFrame([(i, i) for i in range(8)], "key bigint, value bigint"))
    ask = spark.createDataFrame([(1, 3), (1, 4)], "key bigint, value bigint")
    assert dict(rows(own.plus(ask)))[1] == 8 and dict(rows(own.minus(ask)))[1] == -6
    assert dict(rows(own.multiplies(ask)))[1] == 12
    assert dict(rows(own.increment(ask)))[1] == 3
    assert dict(rows(own.apply("bit_xor", ask)))[1] == 1 ^ 3 ^ 4
    assert sorted(map(tuple, own.resize(2, F.lit(-1)).resize(3, F.lit(-1)).dense().collect())) == [(0, 0), (1, 1), (2, -1)]
    with pytest.raises(Exception, match="index out of range"):
        rows(own.plus(spark.createDataFrame([(99, 1)], "key bigint, value bigint")))
    pairs = Array.from_pairs(spark.createDataFrame([(1, 2), (3, 6), (5, 10), (7, 14), (9, 18), (11, 22)], "key bigint, value bigint"), F.lit(0))
    assert pairs.n == 12 and [r.value for r in pairs.dense().orderBy("key").collect()][::2] == [0] * 6


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_sort_and_sums_do_not_depend_on_partitions(spark, parts):
    df = spark.createDataFrame([((i * 37) % 91,) for i in range(91)], "value int").repartition(parts)
    assert sorted((r.idx, r.value) for r in with_index(df, ["value"]).collect()) == [(i, i) for i in range(91)]
    sums = {r.value: r.ps for r in prefix_sum(df, ["value"], "value").collect()}
    assert sums == {i: i * (i - 1) // 2 for i in range(91)}


def test_shuffles_keep_items(spark):
    bag = Bag.of(spark, INTS, "value int")
    for other in (bag.rebalance(3), bag.local_shuffle(1), bag.global_shuffle(2)):
        assert sorted(other.gather()) == sorted(INTS)


def test_array_constructors(spark):
    def dense(a):
        return [r["value"] for r in a.dense().orderBy("key").collect()]

    assert dense(Array.of_size(spark, 3, "bigint", F.lit(7))) == [7, 7, 7]
    assert dense(Array.of_size(spark, 2, "string")) == [None, None]
    assert dense(Array.of_size(spark, 0, "string")) == []
    assert dense(Array.of_values(spark, FISH, "string")) == FISH
    for items in ([], ["5"], FISH):
        bag = Bag.of(spark, items, "value string")
        made = Array.from_bag(bag)
        assert made.n == len(items) and sorted(dense(made)) == sorted(items)
        assert sorted(r[0] for r in made.df.select("key").collect()) == list(range(len(items)))
    pairs = Bag(spark.createDataFrame([((0, "a"),), ((2, "c"),)], "value struct<key:bigint,value:string>")).pairs()
    assert dense(Array.from_pairs(pairs.df, F.lit("-"))) == ["a", "-", "c"]


def test_array_size_of_one_index(spark):
    assert Array(spark.createDataFrame([(0, 1)], "key bigint, value bigint")).n == 1
    assert Array(spark.createDataFrame([], "key bigint, value bigint")).n == 0


def test_null_keys_are_keys(spark):
    kind = "key string, value int"
    own = Map(spark.createDataFrame([(None, 1), ("a", 2)], kind), F.lit(0))
    new = spark.createDataFrame([(None, 5, 1), ("b", None, 2)], f"{kind}, seq int")
    assert sorted(rows_of(own.insert(new)), key=repr) == sorted([(None, 1), ("a", 2), ("b", None)], key=repr)
    assert sorted(rows_of(own.insert_or_assign(new)), key=repr) == sorted([(None, 5), ("a", 2), ("b", None)], key=repr)
    ask = spark.createDataFrame([(None, 4), ("c", None)], "key string, arg int")
    assert sorted(rows_of(own.visit(ask, lambda v, x: v + F.coalesce(x, F.lit(100)), "sum")), key=repr) == sorted([(None, 5), ("a", 2), ("c", 100)], key=repr)
    assert rows_of(own.erase(ask.select("key"))) == [("a", 2)]
    assert own.get(None) == [1] and own.count(None) == 1 and own.gather_keys(ask.select("key")).count() == 1
    bag = MultiSet.of(spark, [None, None, 1], "value int")
    told = bag.contains(spark.createDataFrame([(None,), (7,)], "value int")).collect()
    assert {r.value: r.contained for r in told} == {None: True, 7: False}
    assert bag.erase(spark.createDataFrame([(None,)], "value int")).gather() == [1]
    after, told = Set.of(spark, [1], "value int").insert_contains(spark.createDataFrame([(None, 1), (None, 2)], "value int, seq int"))
    assert sorted((r.seq, r.contained) for r in told.collect()) == [(1, False), (2, True)] and after.size() == 2


def rows_of(c):
    return [tuple(r) for r in c.df.collect()]


def test_rules_of_uniqueness(spark):
    pairs = spark.createDataFrame([("a", 3), ("a", 1), ("b", None)], "key string, value int")
    assert sorted(rows_of(Map(pairs))) == [("a", 1), ("b", None)] and Pairs(pairs).size() == 3
    counted = CountingSet(spark.createDataFrame([("a", 5)], "key string, value bigint"))
    assert sorted(rows_of(counted.insert(spark.createDataFrame([("a",), ("b",)], "key string")))) == [("a", 6), ("b", 1)]
    assert sorted(rows_of(Bag.of(spark, ["a", "a"], "value string").collect_into(counted))) == [("a", 7)]
    array = Array(spark.createDataFrame([(0, 1), (1, 2)], "key bigint, value int"), 5, F.lit(9))
    after = array.insert(spark.createDataFrame([(1, 7), (4, 8)], "key bigint, value int"))
    assert after.n == 5 and [r.value for r in after.dense().orderBy("key").collect()] == [1, 7, 9, 9, 8]
    both = Bag(spark.createDataFrame([((0, 3),), ((0, 4),)], "value struct<k:bigint,v:int>")).collect_into(array)
    assert both.n == 5 and sorted(rows_of(both)) == [(0, 4), (1, 2)]
    assert Map(pairs, F.lit(42)).clear().visit(spark.createDataFrame([("z", 1)], "key string, arg int"), lambda v, x: v + x, "sum").get("z") == [43]
    assert array.clear().n == 0
    logical = Array(spark.createDataFrame([(0, True), (1, True)], "key bigint, value boolean"))
    ask = spark.createDataFrame([(0, False), (0, True)], "key bigint, value boolean")
    assert dict(rows_of(logical.logical_and(ask)))[0] is False and dict(rows_of(logical.logical_or(ask)))[0] is True


def test_tags_of_later_items(spark):
    own = TaggedBag.tagging(Bag.of(spark, FISH, "value string"))
    after, told = own.insert_tagged(spark.createDataFrame([("cat",), ("dog",)], "value string"))
    tags = {r.key: r.value for r in told.collect()}
    assert len(tags) == 2 and after.size() == 10 and after.df.select("key").distinct().count() == 10
    assert {k: after.get(k) for k in tags} == {k: [v] for k, v in tags.items()}
    asked = told.select("key", F.lit("!").alias("arg"))
    assert sorted(v for _, v in rows_of(after.visit_if_exists(asked, lambda v, x: F.concat(v, x), "max")))[-8:] == sorted([*FISH, "cat!", "dog!"])[-8:]


def test_folds_go_up_a_tree(spark, monkeypatch):
    monkeypatch.setattr(reducers, "FOLD", 16)
    df = spark.range(2000).select((F.col("id") % 3).alias("key"), F.col("id").alias("value")).union(spark.createDataFrame([(9, None)], "key bigint, value bigint"))
    got = dict(map(tuple, all_reduce(df, "value", lambda a, b: a + b, ["key"]).collect()))
    assert got == {k: sum(range(k, 2000, 3)) for k in range(3)} | {9: None}
    assert Bag(df.select("value")).reduce(lambda a, b: F.greatest(a, b)) == 1999
    with pytest.raises(ValueError):
        Bag(df.select("value")).clear().reduce(lambda a, b: a + b)


def test_collectives(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "a"), (3, None)], "k int, v string")
    assert dict(map(tuple, is_same(df, "v", ["k"]).collect())) == {1: True, 2: True, 3: False}
    assert is_same(df, "v").first()[0] is False and is_same(df.limit(0), "v").first()[0] is True
    assert bcast(spark, {"x": 1}).value == {"x": 1}
    with pytest.raises(ValueError):
        bcast(spark, b"0" * (65 << 20))


def test_seeded_randoms(spark):
    draw = lambda seed: spark.range(50).select(Engine(seed).integers(3, 5).alias("a")).collect()
    assert draw(1) == draw(1) != draw(2) and {r.a for r in draw(1)} == {3, 4, 5}
    engine = Engine(4)
    row = spark.range(200).select(engine.uniform(2, 4).alias("u"), engine.uniform(2, 4).alias("w"), engine.normal(10, 0).alias("n")).collect()
    assert all(2 <= r.u < 4 and r.n == 10 for r in row) and any(r.u != r.w for r in row)
