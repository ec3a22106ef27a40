"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative for each group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import components
from tessera.session import Scratch

#: Distinct vectors for each cell, the most cells, and the vectors that the cells of one length are fitted on at most.
CELL_VECTORS, MOST_CELLS, SAMPLE_ROWS = 256, 16_384, 65_536
#: Distinct vectors of one length that share one cell without a fit.
FEW = 2 * CELL_VECTORS
#: A vector of 64 components is compared in every cell whose centre is at most so much less similar to it than its own
#: cell's. What two vectors of a given cosine differ by towards a centre shrinks with the root of the length, and so
#: does the reach. Of pairs at cosine 0.9 exactly, 0.99 meet at lengths from 8 to 384 (0.88 at 16 without the root).
REACH = 0.1
#: Vectors in one side of a block of products.
BLOCK = 1024


def unit_rows(raw: list[bytes], kind: str = "<f8") -> np.ndarray:
    """Vectors in double precision and of length one, from little-endian floats. The largest component goes first
    to one, so that neither large nor small ones leave the range of a double when squared."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bytes(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.asarray(v, kind).tobytes() for v in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], ["cid", "n", "width", "vector"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Centres of length one. An empty cell takes the vector that its centre serves worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own, near = np.zeros(len(x), np.int64), np.zeros(len(x))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096] @ centres.T
            own[a : a + 4096], near[a : a + 4096] = part.argmax(1), part.max(1)
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(k))
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        full = counts > 0
        sums[full] = np.add.reduceat(x[order], starts[full])
        lengths = np.sqrt((sums * sums).sum(1))
        worst = iter(np.argsort(near))
        for i in range(k):
            centres[i] = sums[i] / lengths[i] if lengths[i] > 1e-12 else x[next(worst)]
    return centres


def _assign(batches: Iterator[pa.RecordBatch], centres: dict[int, tuple[int, np.ndarray]], reach: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Each vector's home cell and the cells in its reach. Cells are numbered on from the first of their length; a
    length without centres has one cell, of a negative number."""
    for batch in batches:
        widths = batch.column(2).to_numpy()
        for width in np.unique(widths).tolist():
            own = batch.filter(pa.array(widths == width))
            for at in range(0, own.num_rows, 2048):
                part = own.slice(at, 2048)
                if width in centres:
                    first, middle = centres[width]
                    near = unit_rows(part.column(3).to_pylist(), kind) @ middle.T
                    home = near.argmax(1)
                    inside = near >= near[np.arange(len(home)), home][:, None] - reach * (64 / width) ** 0.5
                    cells = np.nonzero(inside)[1] + first
                    ends = np.concatenate([[0], np.cumsum(inside.sum(1))])
                    home = home + first
                else:
                    home = cells = np.full(part.num_rows, -width)
                    ends = np.arange(part.num_rows + 1)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(home.astype(np.int32)), lists], ["cid", "n", "vector", "home", "cells"])


def block_links(x: np.ndarray, y: np.ndarray, least: float, counted) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y that link and that ``counted(i, j)`` keeps."""
    i, j = np.nonzero(x @ y.T >= least)
    keep = counted(i, j)
    return i[keep], j[keep]


def _compare(table: pa.Table, least: float, kind: str) -> pa.Table:
    """One block of a cell: the homes of one part against the members of another; counts and connecting edges.

    A pair may meet in both vectors' home cells; then only the cell with the smaller number counts it. Two homes
    of one cell meet twice, once with each as the member; the one of the smaller number then counts. Not the links go out but each
    vector's count and its smallest partner by connection, at most one row for each vector of the block.
    """
    side = table.column("side").to_numpy()
    cell = int(table.column("cell")[0].as_py())
    split = [table.filter(pa.array(side == s)) for s in (0, 1)]
    if not all(t.num_rows for t in split):
        return _links([], [], [])
    cid, n, home = ([t.column(c).to_numpy() for t in split] for c in ("cid", "n", "home"))
    x, y = (unit_rows(t.column("vector").to_pylist(), kind) for t in split)
    lists = split[0].column("cells").combine_chunks()
    reached = np.repeat(np.arange(len(lists)) << 32, lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()
    reached.sort()

    def counted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        other = home[1][j].astype(np.int64)
        same = other == cell
        wanted = (i.astype(np.int64) << 32) + other
        both = reached[np.minimum(np.searchsorted(reached, wanted), len(reached) - 1)] == wanted
        return np.where(same, cid[0][i] < cid[1][j], ~both | (cell < other))

    i, j = block_links(x, y, least, counted)
    if not len(i):
        return _links([], [], [])
    ids = np.unique(np.concatenate([cid[0][i], cid[1][j]]))
    a, b = np.searchsorted(ids, cid[0][i]), np.searchsorted(ids, cid[1][j])
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, n[1][j])
    np.add.at(links, b, n[0][i])
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return _links(ids, ids[label], links)


def _links(a, b, links) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, reach: float = REACH) -> DataFrame:
    """Groups of vectors linked by cosine >= ``least``: (``key``, n_links, component_id, kept), a row for each row.

    Vectors that are null, zero, empty or that hold null or non-finite components link with nothing and are kept;
    vectors of different lengths do not link. Components are compared in double precision. Equal vectors are one
    class, weighted by its rows, so a vector that a third of the rows share costs one comparison; each row counts the
    others of its class. Null keys never represent a group that has another; rows that repeat a key and a vector
    count as vectors of their own. An empty table gives no rows; other columns are left out, whatever their names.

    Cells are fitted for each length on SAMPLE_ROWS vectors at most; every vector is indexed. A length with few
    vectors is one cell. A cell of any size is dealt out in blocks of BLOCK vectors; blocks send out counts and
    connections, never their pairs.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    as_kind = "array<float>" if kind == "<f4" else "array<double>"
    # adding zero makes -0.0 of 0.0
    plain = df.select(df[key].cast("bigint").alias("key"), F.transform(df[vector].cast(as_kind), lambda x: x + F.lit(0).cast("float" if kind == "<f4" else "double")).alias("v"))
    sound = F.coalesce(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = plain.withColumn("sound", sound)
    classes = marked.where("sound").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    if not total:
        return marked.select(F.col("key").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    packed = classes.select("cid", "n", F.size("v").alias("width"), "v").mapInArrow(partial(_bytes, kind=kind), "cid bigint, n bigint, width int, vector binary")
    many = classes.groupBy(F.size("v").alias("width")).count().where(F.col("count") > FEW).collect()  # each of them has FEW vectors or more
    centres: dict[int, tuple[int, np.ndarray]] = {}
    first = 0
    for width, n in sorted(many):
        share = min(1.0, 1.2 * SAMPLE_ROWS / n)
        chosen = packed.where((F.col("width") == width) & (F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
        x = unit_rows(chosen.limit(SAMPLE_ROWS).select("vector").toArrow().column(0).to_pylist(), kind)
        k = max(1, min(MOST_CELLS, n // CELL_VECTORS, len(x)))
        centres[width] = first, spherical_kmeans(x, k)
        first += k
    assign = partial(_assign, centres=centres, reach=reach, kind=kind)
    indexed = scratch.save(packed.repartition(max(1, total // 4096)).mapInArrow(assign, "cid bigint, n bigint, vector binary, home int, cells array<int>"), "cells")
    members = indexed.select("cid", "n", "vector", "home", "cells", F.explode("cells").alias("cell"))
    counts = members.groupBy("cell").agg(F.ceil(F.count(F.when(F.col("home") == F.col("cell"), 1)) / BLOCK).cast("int").alias("ps"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("qs")).where("ps > 0")
    dealt = members.join(counts, "cell")
    deal = lambda parts: F.pmod(F.xxhash64("cid", "cell"), F.col(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    one = dealt.where("home = cell").select("*", F.lit(0).alias("side"), deal("ps").alias("p"), spread("qs").alias("q"))
    two = dealt.select("*", F.lit(1).alias("side"), spread("ps").alias("p"), deal("qs").alias("q"))
    blocks = one.unionByName(two).select("cell", "p", "q", "side", "cid", "n", "vector", "home", F.when(F.col("side") == 0, F.col("cells")).alias("cells"))
    found = scratch.save(blocks.groupBy("cell", "p", "q").applyInArrow(lambda block: _compare(block, least, kind), "a bigint, b bigint, links bigint"), "links")
    linked = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    groups = components(found.select("a", "b")).select(F.col("item").alias("cid"), "rep")
    known = classes.join(groups, "cid", "left").join(linked, "cid", "left")
    known = scratch.save(known.select("v", "n", "least", F.coalesce("rep", "cid").alias("rep"), F.coalesce("links", F.lit(0)).alias("links")), "known")
    lows = known.groupBy("rep").agg(F.min("least").alias("component_id"))
    joined = known.join(lows, "rep").select(F.col("v").alias("w"), "component_id", (F.col("links") + F.col("n") - 1).alias("n_links"))
    sound_rows = marked.where("sound").join(joined, F.col("v") == F.col("w")).select("key", "n_links", "component_id")
    others = marked.where("not sound").select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    out = sound_rows.union(others)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
