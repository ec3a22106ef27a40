"""Union-find over edge lists: components, spanning forests, disjoint sets kept between batches; sparse matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Scratch

LIST = 1000
HELD = 1_000_000


def _flat(scratch: Scratch, tree: DataFrame, rows: int) -> DataFrame:
    """``tree`` (u, p, ...) of items below others with p replaced by the root above.

    Pointers double among the items that have others below them; leaves look theirs up once, and not at all where
    every item hangs on a root, as where all items are smaller, or all larger, than what they hang on.
    """
    span = tree.agg(F.min("u") > F.max("p"), F.max("u") < F.min("p")).first()
    if span[0] or span[1]:
        return tree
    tops = scratch.save(tree.select(F.col("p").alias("u")).distinct(), "tops", rows)
    inner = scratch.save(tree.select("u", "p").join(tops, "u", "left_semi"), "inner", rows)
    scratch.drop(tops)
    if inner.isEmpty():
        return tree
    while True:
        above = inner.select(F.col("u").alias("p"), F.col("p").alias("_q"))
        up = scratch.save(inner.join(above, "p", "left").select("u", F.coalesce("_q", "p").alias("p"), F.col("_q").isNotNull().alias("_moved")), "inner", rows)
        scratch.drop(inner)
        inner = up
        if up.where("_moved").isEmpty():
            break
        inner = up.drop("_moved")
        inner.table_path = up.table_path
    above = inner.select(F.col("u").alias("p"), F.col("p").alias("_q"))
    rest = [c for c in tree.columns if c != "p"]
    out = scratch.save(tree.join(above, "p", "left").select(*rest, F.coalesce("_q", "p").alias("p")), "tree", rows)
    scratch.drop(tree)
    return out


def _labels(scratch: Scratch, steps: list[DataFrame], rows: int) -> DataFrame:
    """(u, p) with the last root of every item below another, of the flat trees of successive contractions."""
    out = steps[-1].select("u", "p")
    for tree in reversed(steps[:-1]):
        later = out.select(F.col("u").alias("p"), F.col("p").alias("_q"))
        out = scratch.save(tree.join(later, "p", "left").select("u", F.coalesce("_q", "p").alias("p")), "labels", rows).union(out)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list, as (item, rep) with the smallest item as representative.

    A self edge adds a single item; edges with a null end are ignored. Each round every item hangs on its smallest
    neighbour where that is smaller, or every item on its largest where that is larger, whichever are more: half of
    the items at least. Every tree becomes its root and edges within a tree go. A hub's edges meet its row of a
    written table in a join, which the adaptive planner splits, never in one group. Labels are looked up backwards
    through the rounds, and the smallest item of each tree replaces its root.
    """
    scratch = Scratch(edges.sparkSession, "components")
    return _components(scratch, scratch.save(_ends(edges, a, b), "edges", 0))


def _ends(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v) with the larger end first, of the edges that have two ends."""
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    return ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))


def _components(scratch: Scratch, base: DataFrame) -> DataFrame:
    """As components, of written tables of ends (u, v)."""
    left = base.where("u <> v")
    rows = base.count()
    apart = None
    steps: list[DataFrame] = []
    while True:
        n, high, low = left.agg(F.count(F.lit(1)), F.approx_count_distinct("u"), F.approx_count_distinct("v")).first()
        apart = n if apart is None else apart
        if not n:
            break
        x, y, end = ("u", "v", F.min) if high >= low else ("v", "u", F.max)
        tree = scratch.save(left.groupBy(F.col(x).alias("u")).agg(end(y).alias("p")).withColumn("near", F.col("p")), "tree", rows)
        steps.append(tree := _flat(scratch, tree, rows))
        if n == tree.count():
            break  # one edge for each item below another: all are within trees
        up = left.select(F.col(x).alias("u"), F.col(y).alias("v")).join(tree, "u").where("v <> near").select(F.col("p").alias("u"), "v")
        up = up.join(tree.select(F.col("u").alias("v"), F.col("p").alias("_p")), "v", "left").select("u", F.coalesce("_p", "v").alias("v"))
        after = scratch.save(up.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "left", rows)
        if len(steps) > 1:
            scratch.drop(left)
        left = after
    alone = base.where("u = v").select(F.col("u").alias("item")).distinct()
    if not steps:
        return alone.select("item", F.col("item").alias("rep"))
    labels = _labels(scratch, steps, rows)
    low = _low(scratch, labels, rows)
    found = scratch.save(labels.join(low, "p").select(F.col("u").alias("item"), "rep").union(low), "sets", rows)
    if apart == rows:
        return found
    single = scratch.save(alone.join(found, "item", "left_anti").select("item", F.col("item").alias("rep")), "sets", rows)
    return found.union(single)


def _low(scratch: Scratch, labels: DataFrame, rows: int) -> DataFrame:
    """(p, rep), a written table: the smallest item of the tree of each root."""
    return scratch.save(labels.groupBy("p").agg(F.min("u").alias("_m")).select("p", F.least("p", "_m").alias("rep")), "low", rows)


def _joining(edges: pa.Table) -> pa.Table:
    """Of edges (u, v, seq) without nulls, those that join two sets when taken in the order of ``seq``."""
    if not edges.num_rows:
        return edges
    edges = edges.combine_chunks()
    ends = pa.chunked_array(edges["u"].chunks + edges["v"].chunks).combine_chunks().dictionary_encode()
    order = pc.sort_indices(edges["seq"]).to_numpy()
    ids = ends.indices.to_numpy()
    above, kept = list(range(len(ends.dictionary))), []
    for i, x, y in zip(order.tolist(), ids[: edges.num_rows][order].tolist(), ids[edges.num_rows :][order].tolist()):
        while above[x] != x:
            above[x] = x = above[above[x]]
        while above[y] != y:
            above[y] = y = above[above[y]]
        if x != y:
            above[x] = y
            kept.append(i)
    return edges.take(pa.array(kept, pa.int64()))


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v, seq) without those that join nothing among about ``HELD`` held at a time: they join nothing among all."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            left = _joining(pa.Table.from_batches(held))
            held, n = left.to_batches(), left.num_rows
            if 2 * n > HELD:
                yield from held
                held, n = [], 0
    if n:
        yield from _joining(pa.Table.from_batches(held)).to_batches()


def _forest(scratch: Scratch, own: DataFrame, labelled: bool = True) -> tuple[DataFrame | None, DataFrame | None]:
    """Of edges (u, v, seq), a written table: (seq) of those that join two sets and, where ``labelled``, (u, p), the root of each other end; None where none does.

    Each round every set takes its smallest outgoing edge and hangs on the set there; of two sets that take the
    same edge the smaller is the root, and no other cycle can be, since ``seq`` is unique.
    """
    rows = own.count()
    left = own.where("u <> v")
    chosen: list[DataFrame] = []
    steps: list[DataFrame] = []
    while True:
        ends = left.select(F.explode(F.array(F.struct("u", "v", "seq"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "seq"))).alias("e")).select("e.*")
        best = scratch.save(ends.groupBy("u").agg(F.min_by("v", "seq").alias("p"), F.min("seq").alias("seq")), "best", rows)
        if best.isEmpty():
            break
        back = best.select(F.col("u").alias("p"), F.col("p").alias("_back"))
        tree = scratch.save(best.join(back, "p").where("_back <> u or u > p").select("u", "p", "seq"), "tree", rows)
        scratch.drop(best)
        steps.append(tree := _flat(scratch, tree, rows))
        chosen.append(tree.select("seq"))
        if left.count() == tree.count():
            break  # all edges are taken
        up = left.join(tree.select("u", F.col("p").alias("_u"), F.col("seq").alias("_seq")), "u", "left").where("_seq is null or _seq <> seq")
        up = up.join(tree.select(F.col("u").alias("v"), F.col("p").alias("_v")), "v", "left")
        after = scratch.save(up.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"), "seq").where("u <> v"), "left", rows)
        if len(steps) > 1:
            scratch.drop(left)
        left = after
    if not chosen:
        return None, None
    return reduce(DataFrame.union, chosen), _labels(scratch, steps, rows) if labelled else None


def _told(own: DataFrame, chosen: DataFrame | None) -> DataFrame:
    if chosen is None:
        return own.withColumn("merged", F.lit(False))
    return own.join(chosen.withColumn("merged", F.lit(True)), "seq", "left").select("a", "b", "seq", F.coalesce("merged", F.lit(False)).alias("merged"))


def spanning_forest(edges: DataFrame, a: str = "a", b: str = "b", seq: str = "seq") -> DataFrame:
    """(a, b, seq, merged): ``merged`` is true of the edges that join two sets when taken in the order of unique ``seq``.

    Each task first drops the edges that close a circle among its own. Then each round every set takes its smallest
    outgoing edge, sets joined that way become one, and edges within a set are dropped; so the forest is the one that
    a sequential pass finds. The sets at least halve in number each round until none has an outgoing edge. A repeated
    edge with its ``seq`` is one edge; an edge with a null end or ``seq`` merges nothing. The edges are read twice.
    """
    scratch = Scratch(edges.sparkSession, "forest")
    own = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(seq).alias("seq"))
    ends = own.select(F.col("a").alias("u"), F.col("b").alias("v"), "seq").where("u <> v and seq is not null")
    chosen = _forest(scratch, scratch.save(ends.mapInArrow(_thinned, ends.schema), "edges", 0), False)[0]
    told = own.where("seq is not null").withColumn("merged", F.lit(False))
    if chosen is not None:
        none = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("a", "b")]
        told = told.union(chosen.select(*none, "seq", F.lit(True).alias("merged")))
    told = told.groupBy("seq").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("merged").alias("merged"))
    unordered = own.where("seq is null").distinct().withColumn("merged", F.lit(False))
    return told.select("a", "b", "seq", "merged").union(unordered)


class DisjointSet:
    """Items in disjoint sets, kept as (item, rep) with the smallest item of each set as its representative.

    A batch of unions is written as it comes. Those that have come since the sets were last asked for meet the state
    of before at once, when they are asked for again, and give a new state of written tables.
    """

    def __init__(self, df: DataFrame, ends: tuple[DataFrame, ...] = ()):
        self._df, self._new = df.select("item", "rep"), ends

    @property
    def df(self) -> DataFrame:
        if self._new:
            stars = self._df.select(F.greatest("item", "rep").alias("u"), F.least("item", "rep").alias("v"))
            self._df = _components(Scratch(stars.sparkSession, "components"), reduce(DataFrame.union, self._new, stars))
            self._new = ()
        return self._df

    @classmethod
    def empty(cls, spark: SparkSession, kind: str = "bigint") -> DisjointSet:
        return cls(spark.createDataFrame([], f"item {kind}, rep {kind}"))

    def _kept(self, df: DataFrame) -> DisjointSet:
        return DisjointSet(Scratch(self.df.sparkSession, "sets").save(df, "sets"))

    def union(self, edges: DataFrame, a: str = "a", b: str = "b") -> DisjointSet:
        """The sets after joining those of both ends of every edge; new items come in, a self edge alone adds one."""
        ends = Scratch(edges.sparkSession, "unions").save(_ends(edges, a, b), "ends", 0)
        return DisjointSet(self._df, (*self._new, ends))

    def union_and_execute(self, edges: DataFrame) -> tuple[DisjointSet, DataFrame]:
        """As union of edges (a, b, seq), with each edge as it was given and whether it merged two sets: (a, b, seq, merged)."""
        scratch = Scratch(self.df.sparkSession, "unions")
        own = scratch.save(edges.select("a", "b", "seq"), "edges", 0)
        rows, first = own.count(), self.df.isEmpty()
        ends = own.select(F.col("a").alias("u"), F.col("b").alias("v"), "seq")
        if not first:
            for end in ("u", "v"):
                ends = ends.join(self.df.withColumnsRenamed({"item": end, "rep": "_r"}), end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
            ends = scratch.save(ends.select("u", "v", "seq"), "ends", rows)
        chosen, labels = _forest(scratch, ends)
        alone = own.where("a = b").select(F.col("a").alias("item")).distinct()
        if labels is None:
            known = self.df
        else:  # of each set that took part, its smallest item for its root
            low = _low(scratch, labels, rows)
            known = scratch.save(labels.join(low, "p").select(F.col("u").alias("item"), "rep").union(low), "moved", rows)
            if not first:
                old = self.df.join(known.select(F.col("item").alias("rep"), F.col("rep").alias("_r")), "rep", "left").select("item", F.coalesce("_r", "rep").alias("rep"))
                known = scratch.save(old.union(known.join(self.df, "item", "left_anti").select("item", "rep")), "sets", rows)
        if not alone.isEmpty():
            known = scratch.save(known.union(alone.join(known, "item", "left_anti").select("item", F.col("item").alias("rep"))), "sets", rows)
        return DisjointSet(known), _told(own, chosen)

    def visit(self, items: DataFrame) -> tuple[DisjointSet, DataFrame]:
        """Of (item) requests: the sets with unknown items added as sets of their own, and each request's (item, rep)."""
        asked = items.select("item").where("item is not null")
        new = asked.distinct().join(self.df, "item", "left_anti").select("item", F.col("item").alias("rep"))
        after = self._kept(self.df.unionByName(new))
        return after, asked.join(after.df, "item")

    def all_find(self, items: DataFrame) -> DataFrame:
        """(item, rep) of the distinct known ones of the given items; unknown items are absent and stay unknown."""
        return self.df.join(items.select("item").distinct(), "item", "left_semi")

    def for_all(self, fn: Callable[[DataFrame], object]) -> object:
        return fn(self.df)

    def size(self) -> int:
        return self.df.count()

    def num_sets(self) -> int:
        return self.df.where("item = rep").count()

    def sizes(self) -> DataFrame:
        """(rep, n): the items of each set."""
        return self.df.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))

    def max_rank(self) -> int:
        """The height of the highest tree: every item hangs on its representative, so 1, or 0 where all stand alone."""
        return int(not self.df.where("item <> rep").isEmpty())

    def clear(self) -> DisjointSet:
        return DisjointSet(self.df.limit(0))

    def swap(self, other: DisjointSet) -> None:
        self._df, self._new, other._df, other._new = other._df, other._new, self._df, self._new


def spmv(matrix: DataFrame, vector: DataFrame, plus=F.sum, times=lambda x, y: x * y) -> DataFrame:
    """(key, value): the product of a sparse matrix (row, col, value) and a vector (key, value) over any semiring.

    The vector is a written table, so that a hot column's cells can be split among tasks; so is the product.
    """
    scratch = Scratch(matrix.sparkSession, "spmv")
    rows = matrix.count()
    v = scratch.save(vector.select(F.col("key").alias("col"), F.col("value").alias("_x")), "vector", rows)
    return scratch.save(matrix.join(v, "col").groupBy(F.col("row").alias("key")).agg(plus(times(F.col("value"), F.col("_x"))).alias("value")), "product", rows)


def pagerank(edges: DataFrame, a: str = "a", b: str = "b", damping: float = 0.85, rounds: int = 5) -> DataFrame:
    """(item, rank) after some rounds on an undirected edge list, repeated edges counting each time.

    A round deals out and sorts lists of an item's neighbours; those of an item with more than ``LIST`` are dealt by
    hash over several. An end whose other end is null is an item, and gives and gets nothing by that edge.
    """
    scratch = Scratch(edges.sparkSession, "pagerank")
    own = scratch.save(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), "edges", 0)
    rows = 2 * own.count()
    both = own.select(F.col("a").alias("row"), F.col("b").alias("col")).union(own.select("b", "a"))
    degree = scratch.save(both.groupBy("col").agg(F.count(F.lit(1)).alias("_n")), "degree", rows)
    n = max(degree.count(), 1)
    hot = degree.where(F.col("_n") > LIST).select("col", F.ceil(F.col("_n") / LIST).alias("_k"))
    cells = both.where("row is not null and col is not null")
    part = F.lit(0).cast("bigint")
    if not hot.isEmpty():
        cells, part = cells.join(hot, "col", "left"), F.coalesce(F.pmod(F.xxhash64("row"), "_k"), part)
    lists = scratch.save(cells.withColumn("_part", part).groupBy("col", "_part").agg(F.collect_list("row").alias("rows")).select("col", "rows"), "lists", rows)
    lists = scratch.save(lists.join(degree, "col").select("col", "rows", (1.0 / F.col("_n")).alias("share")), "lists", rows)
    bare = both.where("row is null or col is null").select(F.col("col").alias("key")).distinct()
    bare = None if bare.isEmpty() else scratch.save(bare.withColumn("_p", F.lit(0.0)), "bare", rows)
    rank = degree.select(F.col("col").alias("key"), F.lit(1.0 / n).alias("value"))
    for _ in range(rounds):
        given = lists.join(rank.select(F.col("key").alias("col"), "value"), "col").select(F.explode("rows").alias("key"), (F.col("share") * F.col("value")).alias("_p"))
        given = given if bare is None else given.union(bare)
        rank = scratch.save(given.groupBy("key").agg(F.sum("_p").alias("_p")).select("key", (F.lit((1 - damping) / n) + damping * F.col("_p")).alias("value")), "rank", rows)
    return rank.toDF("item", "rank")


class SparseMatrix:
    """Unique (row, col) cells with values; the first insertion of a cell counts."""

    def __init__(self, df: DataFrame):
        self.df = df.select("row", "col", "value")

    def insert(self, rows: DataFrame) -> SparseMatrix:
        new = rows.groupBy("row", "col").agg(F.min_by("value", "seq" if "seq" in rows.columns else "value").alias("value"))
        return SparseMatrix(self.df.unionByName(new.join(self.df, ["row", "col"], "left_anti")))

    def insert_if_missing_else_visit(self, rows: DataFrame, fn: Callable[[Column, Column], Column]) -> SparseMatrix:
        """The first request (row, col, value, seq) of an absent cell inserts its value; all others visit with theirs in turn."""
        asked = rows.groupBy("row", "col").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("_args"))
        joined = self.df.withColumn("_there", F.lit(True)).join(asked, ["row", "col"], "full")
        args = F.when(F.col("_there"), F.coalesce("_args", F.array())).otherwise(F.slice("_args", 2, F.greatest(F.size("_args"), F.lit(1))))
        start = F.when(F.col("_there"), F.col("value")).otherwise(F.get("_args", F.lit(0))["value"])
        value = F.when(F.col("_args").isNull(), F.col("value")).otherwise(F.reduce(args, start, lambda v, x: fn(v, x["value"])))
        return SparseMatrix(joined.select("row", "col", value.alias("value")))

    def row(self, key) -> DataFrame:
        return self.df.where(F.col("row") == F.lit(key))

    def column(self, key) -> DataFrame:
        return self.df.where(F.col("col") == F.lit(key))

    def rows(self) -> DataFrame:
        return self.df.select("row").distinct()

    def columns(self) -> DataFrame:
        return self.df.select("col").distinct()

    def update(self, where: Column, fn) -> SparseMatrix:
        """Values replaced by ``fn(row, col, value)`` in the cells that ``where`` picks."""
        return SparseMatrix(self.df.withColumn("value", F.when(where, fn(F.col("row"), F.col("col"), F.col("value"))).otherwise(F.col("value"))))

    def _visit(self, requests: DataFrame, on: list[str], fn) -> SparseMatrix:
        asked = requests.groupBy(*on).agg(F.sum("arg").alias("_arg"), F.lit(True).alias("_asked"))
        joined = self.df.join(asked, on, "left")
        return SparseMatrix(joined.withColumn("value", F.when(F.col("_asked"), fn(F.col("row"), F.col("col"), F.col("value"), F.col("_arg"))).otherwise(F.col("value"))))

    def visit_if_exists(self, requests: DataFrame, fn: Callable[[Column, Column, Column, Column], Column]) -> SparseMatrix:
        """``fn(row, col, value, arg)`` for the cells that requests (row, col, arg) name, args summed; absent cells stay absent."""
        return self._visit(requests, ["row", "col"], fn)

    def visit_column_mutate(self, requests: DataFrame, fn: Callable[[Column, Column, Column, Column], Column]) -> SparseMatrix:
        """``fn(row, col, value, arg)`` for every cell of the columns that requests (col, arg) name, args summed."""
        return self._visit(requests, ["col"], fn)

    def visit_column(self, requests: DataFrame) -> DataFrame:
        """(row, col, value, ...): each request (col, ...) with every cell of its column."""
        return self.df.join(requests, "col")

    def visit_row(self, requests: DataFrame) -> DataFrame:
        """(row, col, value, ...): each request (row, ...) with every cell of its row."""
        return self.df.join(requests, "row")

    def clear(self) -> SparseMatrix:
        return SparseMatrix(self.df.limit(0))

    def swap(self, other: SparseMatrix) -> None:
        self.df, other.df = other.df, self.df

    def copy(self) -> SparseMatrix:
        return SparseMatrix(self.df)

    def size(self) -> int:
        return self.df.count()
