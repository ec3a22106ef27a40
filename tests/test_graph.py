import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import graph
from tessera.operators.graph import DisjointSet, SparseMatrix, components, pagerank, spanning_forest, spmv
from tessera.session import TASK_ROWS, Scratch, small_tasks


def sequential(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    merged = []
    for a, b in edges:
        ra, rb = find(a), find(b)
        merged.append(ra != rb)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}, merged


def graphs():
    rng = random.Random(3)
    yield [(0, 0), (1, 1), (0, 1), (1, 2), (3, 4), (4, 5), (0, 3)]
    yield [(i, i + 1) for i in range(200)]
    yield [(0, i) for i in range(1, 50)] + [(99, 98)]
    yield [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    yield []


@pytest.mark.parametrize("edges", list(graphs()))
def test_components_and_forest(spark, edges):
    want, merged = sequential(edges)
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "a bigint, b bigint, seq bigint")
    assert {r.item: r.rep for r in components(df).collect()} == want
    assert {r.seq: r.merged for r in spanning_forest(df).collect()} == dict(enumerate(merged))


def test_products(spark):
    a = spark.createDataFrame([(0, 0, 2), (0, 1, 3), (1, 1, 4)], "row int, col int, value int")
    x = spark.createDataFrame([(0, 10), (1, 100)], "key int, value int")
    assert dict(map(tuple, spmv(a, x).collect())) == {0: 320, 1: 400}
    assert dict(map(tuple, spmv(a, x, F.min, lambda p, q: p + q).collect())) == {0: 12, 1: 104}
    ranks = pagerank(spark.createDataFrame([(0, 1), (1, 2)], "a int, b int"), rounds=5)
    assert sum(r.rank for r in ranks.collect()) == pytest.approx(1)


def test_matrix(spark):
    m = SparseMatrix(spark.createDataFrame([(0, 0, 1)], "row int, col int, value int"))
    m = m.insert(spark.createDataFrame([(0, 0, 9), (0, 1, 2), (2, 1, 3)], "row int, col int, value int"))
    assert sorted(map(tuple, m.df.collect())) == [(0, 0, 1), (0, 1, 2), (2, 1, 3)]
    assert m.rows().count() == 2 and m.row(0).count() == 2 and m.column(1).count() == 2
    assert sorted(r.value for r in m.update(F.col("row") == 0, lambda r, c, v: v * 10).df.collect()) == [3, 10, 20]


def test_graph_queries_take_every_row(spark, tmp_path):
    rng = random.Random(5)
    # a hub, a chain and random lines, few of them of large discount and quantity; repeated ones are one edge
    lines = [(i, 1) for i in range(1, 120)] + [x for i in range(200, 260) for x in ((i, i), (i, i + 1))] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(150)]
    lines += lines[::7]
    rows = [(a, b, rng.choice([0.0, 0.05, 0.1]), float(rng.randrange(1, 51))) for a, b in lines]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    ask = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    edges = sorted({(a, 1_000_000 + b) for a, b in lines})  # the order of seq
    want, merged = sequential(edges)
    assert {r.item: r.rep for r in ask("disjoint_set_components")} == want
    assert [tuple(r) for r in ask("disjoint_set_num_sets")] == [(len(want), len(set(want.values())))]
    assert {(r.a, r.b): r.merged for r in ask("union_and_execute_forest")} == dict(zip(edges, merged))
    near = {x: [] for x in want}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    rank = {x: 1 / len(near) for x in near}
    for _ in range(5):
        rank = {x: 0.15 / len(near) + 0.85 * sum(rank[y] / len(near[y]) for y in near[x]) for x in near}
    assert {r.item: r.billionths for r in ask("pagerank_five")} == pytest.approx({x: r * 1e9 for x, r in rank.items()}, abs=1)


def test_disjoint_sets_keep_their_state(spark):
    frame = lambda rows: spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "a bigint, b bigint, seq bigint")
    first, second = [(1, 2), (3, 4), (5, 5)], [(2, 9), (4, 3), (9, 1), (7, 5), (None, 3)]
    sets = DisjointSet.empty(spark).union(frame(first))
    assert (sets.size(), sets.num_sets(), sets.max_rank()) == (5, 3, 1)
    want, merged = sequential(first + second[:-1])
    after, told = sets.union_and_execute(frame(second))
    assert dict(map(tuple, after.df.collect())) == want and after.num_sets() == len(set(want.values()))
    assert sorted((r.seq, r.a, r.b, r.merged) for r in told.collect() if r.a is not None) == [(i, a, b, m) for i, ((a, b), m) in enumerate(zip(second, merged[len(first) :]))]
    items = spark.createDataFrame([(2,), (2,), (100,), (None,)], "item bigint")
    assert sorted(map(tuple, after.all_find(items).collect())) == [(2, 1)]
    more, seen = after.visit(items)
    assert sorted(map(tuple, seen.collect())) == [(2, 1), (2, 1), (100, 100)] and more.size() == after.size() + 1
    assert dict(map(tuple, after.sizes().collect())) == {1: 3, 3: 2, 5: 2}
    assert after.clear().size() == 0 and after.clear().max_rank() == 0
    after.swap(sets)
    assert after.size() == 5 and after.for_all(lambda df: df.count()) == 5


def test_matrix_visits(spark):
    m = SparseMatrix(spark.createDataFrame([(0, 0, 1), (0, 1, 2), (2, 1, 3)], "row int, col int, value int"))
    cells = lambda x: sorted(map(tuple, x.df.collect()))
    ask = spark.createDataFrame([(0, 0, 5), (0, 0, 6), (9, 9, 1)], "row int, col int, arg int")
    assert cells(m.visit_if_exists(ask, lambda r, c, v, x: (v + x).cast("int"))) == [(0, 0, 12), (0, 1, 2), (2, 1, 3)]
    assert cells(m.visit_column_mutate(spark.createDataFrame([(1, 10)], "col int, arg int"), lambda r, c, v, x: (v * x + r).cast("int"))) == [(0, 0, 1), (0, 1, 20), (2, 1, 32)]
    rows = spark.createDataFrame([(0, 0, 4, 1), (5, 5, 7, 2), (5, 5, 8, 3)], "row int, col int, value int, seq int")
    assert cells(m.insert_if_missing_else_visit(rows, lambda v, x: v + x)) == [(0, 0, 5), (0, 1, 2), (2, 1, 3), (5, 5, 15)]
    assert m.visit_column(spark.createDataFrame([(1, "x")], "col int, tag string")).count() == 2 and m.visit_row(spark.createDataFrame([(0,)], "row int")).count() == 2
    other = m.clear()
    other.swap(m)
    assert (m.size(), other.size(), other.copy().size()) == (0, 3, 3)


def test_no_join_groups_its_own_rows(spark, monkeypatch):
    """A hub's rows can be split among tasks only where both sides of a join are dealt out as they are read."""
    seen = []
    monkeypatch.setattr(Scratch, "save", lambda self, df, *x, save=Scratch.save: seen.append(df._jdf.queryExecution().optimizedPlan()) or save(self, df, *x))
    hub = spark.createDataFrame([(0, i, i) for i in range(1, 60)] + [(99, i, 100 + i) for i in range(40, 90)], "a bigint, b bigint, seq bigint")
    names = lambda plan: [plan.nodeName()] + [n for i in range(plan.children().size()) for n in names(plan.children().apply(i))]
    for ask in (components, spanning_forest):
        ask(hub).collect()
        tops = [names(p) for p in seen]
        assert any("Join" in t for t in tops)
        assert not [t for t in tops if "Join" in t and "Aggregate" in t[t.index("Join") :]]
        seen.clear()


def test_tasks_are_small_while_a_table_is_written(spark):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k) for k in keys]
    with small_tasks(spark, 40 * TASK_ROWS):
        assert spark.conf.get(keys[0]) == "40" and spark.conf.get(keys[1]) == f"{16 << 20}b"
    assert [spark.conf.get(k) for k in keys] == before


def test_forest_finds_no_components_by_the_way(spark, monkeypatch):
    monkeypatch.setattr(graph, "components", lambda *x: pytest.fail("a round hangs sets on each other itself"))
    df = spark.createDataFrame([(1, 2, 0), (2, 1, 1), (2, 3, 2), (5, 4, 3), (3, 1, 4), (4, 1, 5)], "a bigint, b bigint, seq bigint")
    assert {r.seq: r.merged for r in spanning_forest(df).collect()} == {0: True, 1: False, 2: True, 3: True, 4: False, 5: True}


def test_unions_take_their_sets_from_the_forest(spark, monkeypatch):
    frame = lambda rows: spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "a bigint, b bigint, seq bigint")
    first, second = [(5, 6), (8, 7), (9, 9), (30, 31)], [(6, 7), (1, 8), (20, 21), (22, 22), (9, 9), (21, 20), (5, 8)]
    sets = DisjointSet.empty(spark).union(frame(first))
    monkeypatch.setattr(graph, "components", lambda *x: pytest.fail("the forest has them"))
    want, merged = sequential(first + second)
    after, told = sets.union_and_execute(frame(second))
    assert sorted(map(tuple, after.df.collect())) == sorted(want.items())
    assert {r.seq: r.merged for r in told.collect()} == dict(enumerate(merged[len(first) :]))


def test_product_writes_its_vector_first(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Scratch, "save", lambda self, df, *x, save=Scratch.save: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(self, df, *x))
    a = spark.createDataFrame([(0, 0, 2), (0, 1, 3), (1, 1, 4)], "row int, col int, value int")
    x = a.groupBy(F.col("col").alias("key")).agg(F.sum("value").alias("value"))
    assert dict(map(tuple, spmv(a, x).collect())) == {0: 25, 1: 28}
    assert len(seen) == 2 and "Aggregate" in seen[0] and seen[1].count("Aggregate") == 1


def test_sets_of_lines_need_no_distinct_pass(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = []
    monkeypatch.setattr(Scratch, "save", lambda self, df, *x, save=Scratch.save: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(self, df, *x))
    assert [tuple(r) for r in entry.queries()["disjoint_set_num_sets"](spark, str(tmp_path)).collect()] == [(3, 1)]
    assert "Aggregate" not in seen[0]


def test_union_writes_its_sets_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, *x, save=Scratch.save: seen.append(df.columns) or save(self, df, name, *x))
    sets = DisjointSet.empty(spark).union(spark.createDataFrame([(1, 2), (3, 2)], "a bigint, b bigint"))
    assert dict(map(tuple, sets.df.collect())) == {1: 1, 2: 1, 3: 1}
    assert seen.count(["item", "rep"]) == 1 and len(seen) <= 9


def test_ranks_of_a_hub_dealt_over_lists(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIST", 3)
    edges = [(0, i) for i in range(1, 20)] + [(1, 2), (1, 2), (4, 4)]
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    near |= {50: [], None: []}
    rank = {x: 1 / len(near) for x in near}
    for _ in range(5):
        rank = {x: 0.15 / len(near) + 0.85 * sum(rank[y] / len(near[y]) for y in near[x]) for x in near}
    got = pagerank(spark.createDataFrame([*edges, (50, None)], "a int, b int"), rounds=5)
    assert dict(map(tuple, got.collect())) == pytest.approx(rank)


def test_batches_of_unions_are_joined_at_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, *x, save=Scratch.save: seen.append(name) or save(self, df, name, *x))
    frame = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    first, second = [(i, 1000 + i // 5) for i in range(0, 50, 2)], [(i, 1000 + i // 5) for i in range(1, 50, 2)]
    sets = DisjointSet.empty(spark).union(frame(first)).union(frame(second))
    assert dict(map(tuple, sets.df.collect())) == sequential(first + second)[0]
    # two batches written, then one round over all: items hang on what they share, larger than they are, so no second round
    assert seen == ["ends", "ends", "tree", "low", "sets"]
    more = [(3, 47), (2000, 2000), (7, 3000), (None, 5)]
    both = sets.union(frame(more[:2])).union(frame(more[2:]))
    assert dict(map(tuple, both.df.collect())) == sequential(first + second + more[:3])[0]
    assert dict(map(tuple, sets.df.collect())) == sequential(first + second)[0]


def test_components_hang_on_larger_or_smaller_neighbours(spark):
    rng = random.Random(11)
    for _ in range(2):
        edges = [(rng.randrange(60), 60 + rng.randrange(8)) for _ in range(40)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(30)] + [(200, 200), (5, 5)]
        got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
        assert len(got) == len({r.item for r in got}) and {r.item: r.rep for r in got} == sequential(edges)[0]


def test_forest_drops_circles_where_edges_are_read(spark, monkeypatch):
    counts = []
    monkeypatch.setattr(Scratch, "save", lambda self, df, *x, save=Scratch.save: (out := save(self, df, *x), counts.append(out.count()))[0])
    rng = random.Random(7)
    edges = [(a, b) for a in range(40) for b in range(40, 80)]
    rng.shuffle(edges)
    rows = [(a, b, i) for i, (a, b) in enumerate(edges)]
    # repeated edges are one; ones without an end or a place in the order merge nothing, and stay
    odd = [(1, None, 5000), (None, None, None), (2, None, None), (3, None, None), (1, 2, None), (9, 9, 5001)]
    df = spark.createDataFrame(rows + rows[:300] + odd, "a bigint, b bigint, seq bigint").coalesce(1)
    want = [(a, b, i, m) for (a, b, i), m in zip(rows, sequential(edges)[1])] + [(*x, False) for x in odd]
    assert sorted(map(repr, map(tuple, spanning_forest(df).collect()))) == sorted(map(repr, want))
    assert counts[0] == 79 and sum(counts) < len(edges)


def test_edges_held_at_a_time(monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(400)]
    seqs = rng.sample(range(1000), 400)
    table = pa.table({"u": [a for a, _ in edges], "v": [b for _, b in edges], "seq": seqs})
    ordered = sorted(zip(seqs, edges))
    merged = {s for (s, _), m in zip(ordered, sequential([e for _, e in ordered])[1]) if m}
    for held in (10, 60, 150, 1000):
        monkeypatch.setattr(graph, "HELD", held)
        left = pa.Table.from_batches(graph._thinned(iter(table.to_batches(max_chunksize=7))), table.schema)
        assert merged <= set(left["seq"].to_pylist()) <= set(seqs) and len(left) <= 400
    assert set(left["seq"].to_pylist()) == merged
    assert not list(graph._thinned(iter([])))
