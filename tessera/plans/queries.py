"""The registered queries over distributed collections, each with the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.collectives import all_reduce, is_same, logical_and, logical_or
from tessera.operators.collections import Array, Bag, CountingSet, Map, MultiMap, MultiSet, Pairs, Set, TaggedBag
from tessera.operators.graph import DisjointSet, SparseMatrix, components, pagerank, spanning_forest, spmv
from tessera.operators.ordering import prefix_sum
from tessera.session import Scratch
from tessera.sources.csv import type_string
from tessera.sources.outputs import write_daily
from tessera.sources.records import as_variants, json_erase, json_field, json_keep, null_counts, parse_records, row_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(df: DataFrame, **columns) -> DataFrame:
    return df.select(*(F.expr(e).alias(c) for c, e in columns.items()))


@_query("select count(*) as n from lineitem")
def scan_rowcount(spark, sf):
    return spark.createDataFrame([(row_count(spark, [f"{sf}/lineitem.parquet"]),)], "n bigint")


@_query("select event_id, user_id from events where event_type='purchase'")
def bag_filter(spark, sf):
    bag = Bag(_items(_t(spark, sf, "events"), value="struct(event_id, user_id, event_type)"))
    return bag.filter(lambda v: v["event_type"] == "purchase").df.select("value.event_id", "value.user_id")


@_query("select event_id, round(value*2,4) as v2 from events")
def bag_transform(spark, sf):
    bag = Bag(_items(_t(spark, sf, "events"), value="struct(event_id, value)"))
    return bag.transform(lambda v: F.struct(v["event_id"].alias("event_id"), F.round(v["value"] * 2, 4).alias("v2"))).df.select("value.*")


@_query("select vec_id, cast(unnest(embedding) as double) as v from embeddings")
def bag_flatten(spark, sf):
    bag = Bag(_items(_t(spark, sf, "embeddings"), value="transform(embedding, x -> struct(vec_id, double(x) as v))"))
    return bag.flatten().df.select("value.*")


@_query("select length(n_name) as len, count(*) as n from nation group by 1")
def map_keys_values(spark, sf):
    names = Map(_items(_t(spark, sf, "nation"), key="n_name", value="n_nationkey"))
    lengths = names.keys().transform(lambda k: F.length(k).cast("bigint"))
    return CountingSet.counting(lengths).df.toDF("len", "n")


@_query("select sum(cast(l_linenumber as bigint))::bigint as s from lineitem")
def reduce_sum(spark, sf):
    total = Bag(_items(_t(spark, sf, "lineitem"), value="bigint(l_linenumber)")).reduce("sum")
    return spark.createDataFrame([(total,)], "s bigint")


@_query("select event_type, count(*) as n from events where length(event_type)=5 group by 1")
def filter_transform_reduce_by_key(spark, sf):
    bag = Bag(_items(_t(spark, sf, "events"), value="event_type"))
    ones = bag.filter(lambda v: F.length(v) == 5).transform(lambda v: F.struct(v.alias("key"), F.lit(1).cast("bigint").alias("value")))
    return ones.reduce_by_key("sum").df.toDF("event_type", "n")


@_query("select l_suppkey, sum(l_linenumber)::bigint as s, min(l_quantity) as mn, max(l_quantity) as mx from lineitem group by 1")
def map_reduce_sum_min_max(spark, sf):
    rows = _t(spark, sf, "lineitem")
    s = Pairs(_items(rows, key="l_suppkey", value="l_linenumber")).reduce_by_key("sum").df.withColumnRenamed("value", "s")
    quantity = Pairs(_items(rows, key="l_suppkey", value="l_quantity"))
    mn, mx = (quantity.reduce_by_key(op).df.withColumnRenamed("value", n) for op, n in (("min", "mn"), ("max", "mx")))
    return s.join(mn, "key").join(mx, "key").withColumnRenamed("key", "l_suppkey")


@_query(r"select w, count(*) as n from (select unnest(regexp_split_to_array(regexp_replace(lower(text),'[^a-z\x{80}-\x{10FFFF}]+',' ','g'),' ')) w from documents) where w<>'' group by 1")
def counting_set_words(spark, sf):
    texts = Bag(_items(_t(spark, sf, "documents"), value=r"split(regexp_replace(lower(text), '[^a-z\\x{80}-\\x{10FFFF}]+', ' '), ' ')"))
    return CountingSet.counting(texts.flatten().filter(lambda w: w != "")).df.toDF("w", "n")


@_query("select count(*) as n, count(distinct user_id) as keys from events")
def counting_set_count_all(spark, sf):
    counted = CountingSet.counting(Bag(_items(_t(spark, sf, "events"), value="user_id")))
    return counted.df.agg(F.sum("value").alias("n"), F.count("key").alias("keys"))


@_query("select l_extendedprice from lineitem order by 1 desc limit 10")
def topk_value(spark, sf):
    return Bag(_items(_t(spark, sf, "lineitem"), value="l_extendedprice")).topk(10).toDF("l_extendedprice")


@_query("select user_id, count(*) as n from events group by 1 order by n desc, user_id limit 10")
def topk_pair_by_count(spark, sf):
    return CountingSet.counting(Bag(_items(_t(spark, sf, "events"), value="user_id"))).topk(10).toDF("user_id", "n")


@_query("select distinct l_suppkey from lineitem")
def set_distinct(spark, sf):
    return Set(_items(_t(spark, sf, "lineitem"), value="l_suppkey")).df.toDF("l_suppkey")


@_query("select o_custkey as k, count(c_custkey)>0 as contained from (select distinct o_custkey from orders) o left join (select c_custkey from customer where c_mktsegment='BUILDING') c on o_custkey=c_custkey group by 1")
def set_contains(spark, sf):
    own = Set(_items(_t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), value="c_custkey"))
    asked = Set(_items(_t(spark, sf, "orders"), value="o_custkey"))
    return own.contains(asked.df).withColumnRenamed("value", "k")


@_query("select event_id, row_number() over (partition by user_id order by event_id) > 1 or user_id in (select c_custkey from customer where c_acctbal < 0) as contained from events")
def set_insert_contains(spark, sf):
    rows = _items(_t(spark, sf, "events"), value="user_id", seq="event_id")
    own = Set(_items(_t(spark, sf, "customer").where("c_acctbal < 0"), value="c_custkey"))
    _, told = own.insert_contains(rows)
    return told.select(F.col("seq").alias("event_id"), "contained")


@_query("select count(*) as n from events where event_type='click'")
def multiset_count(spark, sf):
    n = MultiSet(_items(_t(spark, sf, "events"), value="event_type")).count("click")
    return spark.createDataFrame([(n,)], "n bigint")


@_query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity>=48)")
def batch_erase_by_key(spark, sf):
    orders = Set(_items(_t(spark, sf, "orders"), value="o_orderkey"))
    return orders.erase(_items(_t(spark, sf, "lineitem").where("l_quantity >= 48"), value="l_orderkey")).df.toDF("o_orderkey")


@_query("select c_custkey, c_nationkey from customer c where not exists (select 1 from (select o_custkey, (o_custkey%25)::int as nk from orders) o where o.o_custkey=c.c_custkey and o.nk=c.c_nationkey)")
def batch_erase_by_key_value(spark, sf):
    customers = Map(_items(_t(spark, sf, "customer"), key="c_custkey", value="c_nationkey"))
    return customers.erase_pairs(_items(_t(spark, sf, "orders"), key="o_custkey", value="int(o_custkey % 25)")).df.toDF("c_custkey", "c_nationkey")


@_query("select l_suppkey, count(*) as n from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal < 0) group by 1")
def gather_keys(spark, sf):
    counted = CountingSet.counting(Bag(_items(_t(spark, sf, "lineitem"), value="l_suppkey")))
    return counted.gather_keys(_items(_t(spark, sf, "supplier").where("s_acctbal < 0"), key="s_suppkey")).toDF("l_suppkey", "n")


@_query("select user_id, arg_min(event_type,event_id) as v from events group by 1")
def map_insert_first_wins(spark, sf):
    rows = _items(_t(spark, sf, "events"), key="user_id", value="event_type", seq="event_id")
    return Map(rows.limit(0)).insert(rows).df.toDF("user_id", "v")


@_query("select user_id, arg_max(event_type,event_id) as v from events group by 1")
def map_insert_or_assign_last_wins(spark, sf):
    rows = _items(_t(spark, sf, "events"), key="user_id", value="event_type", seq="event_id")
    return Map(rows.limit(0)).insert_or_assign(rows).df.toDF("user_id", "v")


@_query("select coalesce(user_id, c_custkey) as user_id, (coalesce(n, 0) + if(c_custkey is null, 0, 100))::bigint as v from (select user_id, count(*) as n from events group by 1) full join (select c_custkey from customer where c_acctbal < 0) on user_id = c_custkey")
def map_insert_if_missing_else_visit(spark, sf):
    rows = _items(_t(spark, sf, "events"), key="user_id", value="bigint(1)", seq="event_id")
    own = Map(_items(_t(spark, sf, "customer").where("c_acctbal < 0"), key="c_custkey", value="bigint(100)"))
    return own.insert_if_missing_else_visit(rows, lambda v, x: v + x).df.toDF("user_id", "v")


def _suppliers(spark, sf) -> Map:
    return Map(_items(_t(spark, sf, "supplier").where("s_acctbal >= 0"), key="s_suppkey", value="bigint(100)"), F.lit(0).cast("bigint"))


@_query("select coalesce(m.k,r.k) as k, coalesce(m.v,0)+coalesce(r.n,0) as v from (select s_suppkey as k, 100::bigint as v from supplier where s_acctbal>=0) m full join (select l_suppkey as k, count(*) as n from lineitem group by 1) r on m.k=r.k")
def map_visit_default_insert(spark, sf):
    asked = _items(_t(spark, sf, "lineitem"), key="l_suppkey", arg="bigint(1)")
    return _suppliers(spark, sf).visit(asked, lambda v, x: v + x, "sum").df.toDF("k", "v")


@_query("select m.k, m.v+coalesce(r.n,0) as v from (select s_suppkey as k, 100::bigint as v from supplier where s_acctbal>=0) m left join (select l_suppkey as k, count(*) as n from lineitem group by 1) r on m.k=r.k")
def map_visit_if_contains(spark, sf):
    asked = _items(_t(spark, sf, "lineitem"), key="l_suppkey", arg="bigint(1)")
    return _suppliers(spark, sf).visit_if_contains(asked, lambda v, x: v + x, "sum").df.toDF("k", "v")


@_query("select n_regionkey, array_to_string(list_sort(list(n_name)), ',') as names from nation group by 1")
def multimap_visit_group(spark, sf):
    groups = MultiMap(_items(_t(spark, sf, "nation"), key="n_regionkey", value="n_name")).groups()
    return groups.select(F.col("key").alias("n_regionkey"), F.array_join("values", ",").alias("names"))


@_query("select i as idx, coalesce(v,0)::bigint as v from range(0,(select max(l_suppkey)+1 from lineitem)) t(i) left join (select l_suppkey, max(l_linenumber) as v from lineitem group by 1) on l_suppkey=i")
def array_from_pairs_dense(spark, sf):
    pairs = _items(_t(spark, sf, "lineitem"), key="l_suppkey", value="bigint(l_linenumber)")
    return Array.from_pairs(pairs, F.lit(0)).dense().toDF("idx", "v")


@_query("select l_suppkey as idx, bit_and(l_linenumber) as ba, bit_or(l_linenumber) as bo, bit_xor(l_linenumber) as bx from lineitem group by 1")
def array_bit_ops(spark, sf):
    rows = _items(_t(spark, sf, "lineitem"), key="l_suppkey", value="l_linenumber")
    n = rows.agg(F.max("key")).first()[0] + 1
    empty = rows.limit(0)
    parts = [Array(empty, n, F.lit(d)).apply(op, rows).df.withColumnRenamed("value", c) for op, c, d in (("bit_and", "ba", -1), ("bit_or", "bo", 0), ("bit_xor", "bx", 0))]
    return parts[0].join(parts[1], "key").join(parts[2], "key").join(rows.select("key").distinct(), "key").withColumnRenamed("key", "idx")


@_query("select l_suppkey as idx, bool_and(l_quantity>1) as la, bool_or(l_quantity>=50) as lo from lineitem group by 1")
def array_logical_ops(spark, sf):
    rows = _t(spark, sf, "lineitem")
    keys = rows.select(F.col("l_suppkey").alias("key")).distinct()
    n = keys.agg(F.max("key")).first()[0] + 1
    la = Array(keys.withColumn("value", F.lit(True)), n, F.lit(True)).logical_and(_items(rows, key="l_suppkey", value="l_quantity > 1"))
    lo = Array(keys.withColumn("value", F.lit(False)), n, F.lit(False)).logical_or(_items(rows, key="l_suppkey", value="l_quantity >= 50"))
    both = keys.join(la.df.withColumnRenamed("value", "la"), "key").join(lo.df.withColumnRenamed("value", "lo"), "key")
    return both.withColumnRenamed("key", "idx")


@_query("select s_suppkey as idx, coalesce(n,0)::bigint as plus, (0-coalesce(n,0))::bigint as minus from supplier left join (select l_suppkey,count(*) n from lineitem group by 1) on l_suppkey=s_suppkey")
def array_plus_minus(spark, sf):
    keys = _items(_t(spark, sf, "lineitem"), key="l_suppkey")
    suppliers = _items(_t(spark, sf, "supplier"), key="s_suppkey")
    n = max(keys.agg(F.max("key")).first()[0], suppliers.agg(F.max("key")).first()[0]) + 1
    zero = Array(_items(suppliers, key="key", value="bigint(0)"), n, F.lit(0))
    plus, minus = zero.increment(keys).df.withColumnRenamed("value", "plus"), zero.decrement(keys).df.withColumnRenamed("value", "minus")
    return suppliers.join(plus, "key").join(minus, "key").withColumnRenamed("key", "idx")


@_query("select i as idx, coalesce(v,-1)::bigint as v from range(0,(select 2*max(s_suppkey)+2 from supplier)) t(i) left join (select s_suppkey k, 2*s_suppkey v from supplier) on k=i")
def array_resize(spark, sf):
    own = Array(_items(_t(spark, sf, "supplier"), key="s_suppkey", value="2 * s_suppkey"), default=F.lit(-1))
    return own.resize(2 * own.n, F.lit(-1)).dense().toDF("idx", "v")


@_query("select s_suppkey as idx, (s_suppkey * pow(2, coalesce(n, 0)))::bigint as v from supplier left join (select l_suppkey, count(*) as n from lineitem where l_quantity = 50 and l_tax = 0 and l_linenumber = 7 group by 1) on l_suppkey = s_suppkey")
def array_multiplies(spark, sf):
    asked = _items(_t(spark, sf, "lineitem").where("l_quantity = 50 and l_tax = 0 and l_linenumber = 7"), key="l_suppkey", value="bigint(2)", seq="l_orderkey")
    suppliers = _items(_t(spark, sf, "supplier"), key="s_suppkey", value="s_suppkey")
    n = max(d.agg(F.max("key")).first()[0] for d in (asked, suppliers) if not d.isEmpty()) + 1
    out = Array(suppliers, n, F.lit(0)).multiplies(asked).df
    return out.join(suppliers.select("key"), "key").toDF("idx", "v")


@_query("select row_number() over (order by o_totalprice, o_orderkey)-1 as idx, o_totalprice from orders")
def array_sort(spark, sf):
    values = _items(_t(spark, sf, "orders"), value="o_totalprice", o_orderkey="o_orderkey")
    return Array.from_values(values, ["o_orderkey"]).sort().df.toDF("idx", "o_totalprice")


@_query("select c_custkey, coalesce(sum(c_nationkey) over (order by c_custkey rows between unbounded preceding and 1 preceding),0)::bigint as ps from customer")
def prefix_sum_exclusive(spark, sf):
    return prefix_sum(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), ["c_custkey"], "c_nationkey").select("c_custkey", "ps")


@_query("select bool_and(l_tax>=0) as la, bool_or(l_quantity>49) as lo from lineitem")
def collective_logical(spark, sf):
    rows = _items(_t(spark, sf, "lineitem"), a="l_tax >= 0", o="l_quantity > 49")
    return logical_and(rows, "a").toDF("la").join(logical_or(rows, "o").toDF("lo"))  # a row each


@_query("select l_suppkey, min(l_returnflag)=max(l_returnflag) as same from lineitem group by 1")
def is_same_by_key(spark, sf):
    return is_same(_t(spark, sf, "lineitem"), "l_returnflag", ["l_suppkey"])


@_query("select source, count(distinct coalesce(toxic, -1)) <= 1 as same from documents left join labels using (doc_id) group by 1")
def is_same_with_nulls(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", "source").join(_t(spark, sf, "labels"), "doc_id", "left")
    return is_same(rows, "toxic", ["source"])


@_query("select l_suppkey, max(l_extendedprice) as value from lineitem group by 1")
def all_reduce_own_operation(spark, sf):
    return all_reduce(_t(spark, sf, "lineitem"), "l_extendedprice", lambda a, b: F.greatest(a, b), ["l_suppkey"])


_GRAPH = (
    "with recursive u as materialized (select l_orderkey a, 1000000+l_partkey b from lineitem union select 1000000+l_partkey, l_orderkey from lineitem), "
    "cc(n, m) using key (n) as (select n, n from (select distinct a as n from u) union "
    "select u.b, min(cc.m) from cc join u on u.a = cc.n join recurring.cc r on r.n = u.b where cc.m < r.m group by u.b)"
)
_STARS = "select o_orderkey as item, min(o_orderkey) over (partition by o_custkey) as rep from orders union all select 1000000000+o_custkey, min(o_orderkey) from orders group by o_custkey"


def _lines(spark, sf) -> DataFrame:
    return _items(_t(spark, sf, "lineitem"), a="l_orderkey", b="1000000 + l_partkey")


def _edges(spark, sf) -> DataFrame:
    return _lines(spark, sf).distinct()


@_query(f"{_GRAPH} select n as item, m as rep from cc")
def disjoint_set_components(spark, sf):
    return components(_lines(spark, sf))


@_query(f"{_GRAPH} select count(*) as size, count(distinct m) as num_sets from cc")
def disjoint_set_num_sets(spark, sf):
    sets = DisjointSet.empty(spark).union(_lines(spark, sf))
    return spark.createDataFrame([(sets.size(), sets.num_sets())], "size bigint, num_sets bigint")


def _customer_sets(spark, sf) -> DisjointSet:
    """Orders in the sets of their customers, joined in two batches."""
    orders = _t(spark, sf, "orders")
    sets = DisjointSet.empty(spark)
    for part in ("o_orderstatus = 'O'", "o_orderstatus <> 'O' or o_orderstatus is null"):
        sets = sets.union(_items(orders.where(part), a="o_orderkey", b="1000000000 + o_custkey"))
    return sets


@_query(_STARS)
def disjoint_set_batches(spark, sf):
    return _customer_sets(spark, sf).df


@_query(f"select * from ({_STARS}) where item in (select 1000000000+c_custkey from customer)")
def disjoint_set_all_find(spark, sf):
    return _customer_sets(spark, sf).all_find(_items(_t(spark, sf, "customer"), item="1000000000 + c_custkey"))


@_query(f"select 1000000000+c_custkey as item, coalesce(rep, 1000000000+c_custkey) as rep from customer left join ({_STARS}) on item = 1000000000+c_custkey")
def disjoint_set_visit(spark, sf):
    return _customer_sets(spark, sf).visit(_items(_t(spark, sf, "customer"), item="1000000000 + c_custkey"))[1]


@_query(f"select rep, count(*) as n from ({_STARS}) group by 1")
def disjoint_set_sizes(spark, sf):
    return _customer_sets(spark, sf).sizes()


# taken in the order of keys, the first order of each part or the first part of each order joins it: no plain SQL says
# which; tested against a sequential pass
@_query()
def union_and_execute_forest(spark, sf):
    lines = _lines(spark, sf)  # repeated ones are one edge
    apart = max(10_000_000, (lines.agg(F.max("b")).first()[0] or 0) + 1)
    return spanning_forest(lines.withColumn("seq", F.col("a") * apart + F.col("b")))


@_query("select o_orderkey as a, 1000000000+o_custkey as b, o_orderkey as seq, true as merged from orders")
def union_and_execute_customers(spark, sf):
    edges = _items(_t(spark, sf, "orders"), a="o_orderkey", b="1000000000 + o_custkey", seq="o_orderkey")
    return DisjointSet.empty(spark).union_and_execute(edges)[1]


@_query("select l_orderkey as row, sum(l_linenumber*(l_partkey%7))::bigint as y from lineitem group by 1")
def spmv_product(spark, sf):
    rows = _t(spark, sf, "lineitem")
    a = _items(rows, row="l_orderkey", col="l_partkey", value="bigint(l_linenumber)")
    x = _items(rows.select("l_partkey").distinct(), key="l_partkey", value="l_partkey % 7")
    return spmv(a, x).toDF("row", "y")


def _pagerank_sql(rounds: int) -> str:
    parts = [
        "e as materialized (select distinct l_orderkey a, 1000000+l_partkey b from lineitem)",
        "u as materialized (select a as r, b as c from e union all select b, a from e)",
        "d as materialized (select c, count(*) as k from u group by c)",
        "m as materialized (select u.r, u.c, 1.0::double / d.k as v from u join d using (c))",
        "p0 as materialized (select c as item, 1.0::double / (select count(*) from d) as rank from d)",
    ]
    for i in range(rounds):
        parts.append(f"p{i + 1} as materialized (select p.item, 0.15::double / (select count(*) from d) + 0.85::double * coalesce(x.s, 0) as rank from p{i} p left join (select m.r, sum(m.v * q.rank) as s from m join p{i} q on q.item = m.c group by m.r) x on x.r = p.item)")
    return f"with {', '.join(parts)} select item, round(rank * 1e9)::bigint as billionths from p{rounds}"


@_query(_pagerank_sql(5))
def pagerank_five(spark, sf):
    return pagerank(_edges(spark, sf), rounds=5).select("item", F.round(F.col("rank") * 1e9).cast("bigint").alias("billionths"))


@_query("select l_orderkey as row, l_partkey as col, arg_min(l_linenumber, l_linenumber)::bigint as value from lineitem group by 1, 2")
def sparse_matrix_insert(spark, sf):
    rows = _items(_t(spark, sf, "lineitem"), row="l_orderkey", col="l_partkey", value="bigint(l_linenumber)", seq="l_linenumber")
    return SparseMatrix(rows.limit(0)).insert(rows).df


@_query("select l_orderkey as row, l_partkey as col, (min(l_linenumber) + 1000 * any_value(p_size))::bigint as value from lineitem join part on p_partkey = l_partkey group by 1, 2")
def sparse_matrix_visit_column(spark, sf):
    rows = _items(_t(spark, sf, "lineitem"), row="l_orderkey", col="l_partkey", value="bigint(l_linenumber)")
    own = SparseMatrix(rows.limit(0)).insert(rows)
    return own.visit_column_mutate(_items(_t(spark, sf, "part"), col="p_partkey", arg="bigint(p_size)"), lambda r, c, v, x: v + 1000 * x).df


@_query("select event_type, count(*) as n from events group by 1")
def collect_into_counting_set(spark, sf):
    bag = Bag(_items(_t(spark, sf, "events"), value="event_type"))
    return bag.collect_into(CountingSet(spark.createDataFrame([], "key string, value bigint"), unique=True)).df.toDF("event_type", "n")


@_query("select s_suppkey as idx, coalesce(v, -1) as v from supplier left join (select l_suppkey, max(l_linenumber)::bigint as v from lineitem group by 1) on l_suppkey = s_suppkey")
def collect_into_array(spark, sf):
    suppliers = _items(_t(spark, sf, "supplier"), key="s_suppkey", value="bigint(-1)")
    pairs = Bag(_items(_t(spark, sf, "lineitem"), value="struct(l_suppkey, bigint(l_linenumber))"))
    return pairs.collect_into(Array(suppliers, default=F.lit(-1))).df.toDF("idx", "v")


@_query("select o_custkey, o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment='BUILDING')")
def multimap_probe(spark, sf):
    orders = MultiMap(_items(_t(spark, sf, "orders"), key="o_custkey", value="o_orderkey"))
    return orders.gather_keys(_items(_t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), key="c_custkey")).toDF("o_custkey", "o_orderkey")


def _labelled(spark, sf) -> DataFrame:
    """Documents with their labels, null where a document has none."""
    return _t(spark, sf, "documents").select("doc_id", "source").join(_t(spark, sf, "labels"), "doc_id", "left")


@_query("select toxic, count(*) as n, true as contained from documents left join labels using (doc_id) group by 1")
def counting_set_null_keys(spark, sf):
    keys = Bag(_items(_labelled(spark, sf), value="toxic"))
    counted = CountingSet.counting(keys)
    told = counted.keys().df.transform(MultiSet(keys.df).contains).withColumnRenamed("value", "toxic")
    return told.join(counted.df.toDF("_k", "n"), F.col("toxic").eqNullSafe(F.col("_k"))).select("toxic", "n", "contained")


@_query("select toxic, (100 + count(*))::bigint as v from documents left join labels using (doc_id) group by 1")
def map_visit_null_keys(spark, sf):
    rows = _labelled(spark, sf)
    own = Map(_items(rows, key="toxic", value="bigint(100)"))
    return own.visit(_items(rows, key="toxic", arg="bigint(1)"), lambda v, x: v + x, "sum").df.toDF("toxic", "v")


@_query("select source, toxic from documents left join labels using (doc_id) where toxic is not null")
def batch_erase_null_values(spark, sf):
    own = Pairs(_items(_labelled(spark, sf), key="toxic", value="source"))
    return own.erase(spark.createDataFrame([(None,)], "key int")).df.select(F.col("value").alias("source"), F.col("key").alias("toxic"))


@_query("select strftime(ts,'%Y')||'/'||month(ts)||'/'||day(ts) as path, count(*) as n from events group by 1")
def daily_output_paths(spark, sf):
    rows = _items(_t(spark, sf, "events"), seconds="unix_date(date(ts)) * 86400L + hour(ts) * 3600 + minute(ts) * 60 + int(second(ts))", line="string(event_id)")
    folder = Scratch(spark, "daily").path("days")
    write_daily(rows, folder)
    back = spark.read.option("recursiveFileLookup", "true").text(folder).select(F.regexp_extract("_metadata.file_path", "([0-9]+/[0-9]+/[0-9]+)$", 1).alias("path"))
    return back.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@_query("select event_id, cast(json_extract_string(props,'$.k') as bigint) as k from events")
def ndjson_field(spark, sf):
    rows = parse_records(_items(_t(spark, sf, "events"), value="'{\"id\":' || event_id || ',\"props\":' || props || '}'"))
    return rows.select(json_field(F.col("value"), "id", "bigint").alias("event_id"), F.expr("try_variant_get(value, '$.props.k', 'bigint')").alias("k"))


@_query("select event_id, 1 as erased, cast(json_extract_string(props,'$.k') as bigint) as k from events")
def ndjson_erase_and_keep(spark, sf):
    rows = parse_records(_items(_t(spark, sf, "events"), value="'{\"id\":' || event_id || ',\"k\":' || get_json_object(props, '$.k') || ',\"x\":[1]}'"))
    own = rows.select("value", json_erase(F.col("value"), ["x", "none"]).alias("left"), json_keep(F.col("value"), ["id", "k"]).alias("kept"))
    same = F.when(F.col("left.erased") == F.col("kept.erased"), F.col("left.erased")).cast("int")
    return own.select(json_field(F.col("kept.value"), "id", "bigint").alias("event_id"), same.alias("erased"), json_field(F.col("left.value"), "k", "bigint").alias("k"))


@_query("select case when regexp_full_match(f,'[+-]?[0-9]+') then 'I' when regexp_full_match(f,'[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then 'D' else 'S' end as t, count(*) as n from (select cast(p_size as varchar) f from part union all select cast(p_retailprice as varchar) from part union all select p_brand from part) group by 1")
def csv_type_string(spark, sf):
    rows = _items(_t(spark, sf, "part"), fields="array(string(p_size), string(p_retailprice), p_brand)")
    letters = Bag(rows.select(F.split(type_string(F.col("fields")), "").alias("value"))).flatten()
    return CountingSet.counting(letters).df.toDF("t", "n")


@_query("select count(doc_id)+count(quality)+count(toxic) as valid, 2*count(*)-count(quality)-count(toxic) as invalid from documents left join labels using (doc_id)")
def variant_null_counts(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id").join(_t(spark, sf, "labels"), "doc_id", "left")
    return null_counts(as_variants(rows))


@_query("select event_id from events")
def bag_global_shuffle(spark, sf):
    return Bag(_items(_t(spark, sf, "events"), value="event_id")).global_shuffle(7).df.toDF("event_id")


@_query("select event_id from events")
def bag_rebalance(spark, sf):
    return Bag(_items(_t(spark, sf, "events"), value="event_id")).rebalance(8).df.toDF("event_id")


@_query("select count(*) as n, count(*) as tags from customer")
def tagged_bag_tags(spark, sf):
    tagged = TaggedBag.tagging(Bag(_items(_t(spark, sf, "customer"), value="c_name")))
    return tagged.df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("tags"))
