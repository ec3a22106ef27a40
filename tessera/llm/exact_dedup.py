"""Exact deduplication by an extendible-hash index on shared files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import short_batches, slices, strings
from tessera.session import Scratch

#: Rows that a bucket holds before the directory splits it, and the most hash bits that the directory tells apart;
#: beyond 2 ** 17 buckets' worth of rows a bucket holds more.
BUCKET_ENTRIES, DIRECTORY_BITS = 2_000, 20
#: Rows of an owner task, which takes a range of buckets.
OWNER_ROWS = 50_000
#: Rows of one hash from which on their texts are compared with one of them where they are, not in an owner task.
HOT_ROWS = 10_000
#: Repeated hashes up to which their table, some 60 bytes a row, is broadcast, and bytes of hot texts; beyond, a join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Entries of one class that an owner task keeps until the class is complete; a longer class is resolved by a join.
HELD_ENTRIES = 64


class Directory:
    """An extendible-hash directory: cell ``hash >> (64 - depth)`` names the bucket that holds a hash's entries."""

    def __init__(self, capacity: int, limit: int):
        """``limit``: the most hash bits that the directory may tell apart."""
        self.capacity, self.limit = capacity, limit
        self.depth = 0
        self.cells = [(0, 0)]  # a bucket's local depth and its hash prefix of so many bits

    @classmethod
    def of(cls, counts: np.ndarray, capacity: int) -> Directory:
        """The directory after inserting ``counts[x]`` entries with leading bits x; its length is a power of two."""
        limit = (len(counts) - 1).bit_length()
        out = cls(capacity, limit)
        sums = np.concatenate([[0], np.cumsum(counts)])
        full = [(0, 0)]
        while full:
            depth, prefix = full.pop()
            width = limit - depth
            if width and sums[(prefix + 1) << width] - sums[prefix << width] > capacity:
                if depth == out.depth:  # the bucket fills its cell: the directory doubles
                    out.cells = [x for x in out.cells for _ in (0, 1)]
                    out.depth += 1
                shift = out.depth - depth - 1
                for half in (2 * prefix, 2 * prefix + 1):
                    out.cells[half << shift : (half + 1) << shift] = [(depth + 1, half)] * (1 << shift)
                    full.append((depth + 1, half))
        return out

    def numbers(self) -> np.ndarray:
        """The bucket number of each cell, in the order of the key ranges."""
        order = {x: i for i, x in enumerate(dict.fromkeys(self.cells))}
        return np.array([order[x] for x in self.cells], np.int64)


_ENTRY = "owner int, hash bigint, text string, sha string, ids array<{kind}>"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, owner, hash, sha): one entry for each distinct text of a slice, so that copies shrink before they meet."""
    for batch in slices(batches, "text"):
        at: dict[str, int] = {}
        ids: list[list] = []
        first: list[int] = []
        for i, (key, text) in enumerate(zip(batch.column(0).to_pylist(), strings(batch, "text"))):
            k = at.setdefault(text, len(ids))
            if k == len(ids):
                ids.append([])
                first.append(i)
            ids[k].append(key)
        picked = batch.take(pa.array(first))
        ids = [sorted(x, key=lambda v: (v is not None, v), reverse=True) for x in ids]
        yield pa.RecordBatch.from_arrays([picked.column(2), picked.column(3), picked.column(1), picked.column(4), pa.array(ids, pa.list_(batch.column(0).type))], ["owner", "hash", "text", "sha", "ids"])


def _owners(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Index leaves of sorted entries: chains of distinct texts for each hash, told apart by their bytes.

    Rows: entries (ids, and what is known of their class) and, for a class with many entries, its own row.
    """
    names = ["hash", "link", "entry", "sha", "ids", "keep_id", "group_size", "winner"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(kind), kind, pa.int64(), pa.int64()]
    chain: list[dict] = []
    current = None
    rows: list[tuple] = []

    def close() -> None:
        for link, c in enumerate(chain):
            if c["held"] is not None:
                rows.extend((current, link, n, c["sha"], ids, c["best"], c["size"], c["winner"]) for n, ids in enumerate(c["held"]))
            else:  # its entries went out before; they meet this row in a join
                rows.append((current, link, None, c["sha"], None, c["best"], c["size"], c["winner"]))
        chain.clear()

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for batch in slices(batches, "text"):
        hashes = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        shas = batch.column(2).to_pylist()
        lists = batch.column(3).to_pylist()
        for h, text, sha, ids in zip(hashes, texts, shas, lists):
            if h != current:
                close()
                current = h
            for link, c in enumerate(chain):
                if c["text"] == text:
                    break
            else:
                link, c = len(chain), {"text": text, "sha": sha, "best": None, "winner": None, "size": 0, "entries": 0, "held": []}
                chain.append(c)
            if c["winner"] is None or ids[0] is not None and (c["best"] is None or ids[0] > c["best"]):
                c["best"], c["winner"] = ids[0], c["entries"]
            c["size"] += len(ids)
            if c["held"] is not None:
                c["held"].append(ids)
                if len(c["held"]) > HELD_ENTRIES:
                    rows.extend((h, link, n, sha, x, None, None, None) for n, x in enumerate(c["held"]))
                    c["held"] = None
            else:
                rows.append((h, link, c["entries"], sha, ids, None, None, None))
            c["entries"] += 1
        if rows:
            yield out()
    close()
    if rows:
        yield out()


def _hot(plain: DataFrame, hot: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of hot hashes: (key, hash, sha, top), and those (key, text, hash, sha) whose text is not that of their hash's leader.

    The leader of a hash is a row with its largest key. Its text goes to where the others are; no task gathers them.
    """
    tops = hot.select(F.col("hash").alias("_h"), "top")
    of = (F.col("hash") == F.col("_h")) & F.col("key").eqNullSafe(F.col("top"))
    leaders = plain.join(F.broadcast(tops), of).groupBy("hash").agg(F.min("text").alias("leader"))
    leaders = scratch.save(leaders, "leaders")
    size = leaders.agg(F.sum(F.octet_length("leader"))).first()[0] or 0
    led = leaders.select(F.col("hash").alias("_h"), "leader")
    met = plain.join(F.broadcast(led) if size <= BROADCAST_BYTES else led, F.col("hash") == F.col("_h")).withColumn("same", F.col("text") == F.col("leader"))
    return met.where("same").select("key", "hash", "sha"), met.where("not same").select("key", "text", "hash", "sha")


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = BUCKET_ENTRIES, hash_bits: int = 64) -> DataFrame:
    """Groups of equal texts: a row for each row of ``df``: (``key``, keep_id, group_size, kept, text_sha256).

    The row with the largest key stays; a null key is smaller than any other, and of rows that tie in the largest
    key exactly one is kept. A null text counts as empty. An empty table gives no rows; other columns are left
    out, whatever their names. ``hash_bits`` below 64 weakens the hash, so that tests meet collisions.

    One pass counts hashes; a hash of one row needs no further look, and its text goes nowhere. From the others'
    counts the directory grows by splitting overfull buckets and doubling; it is written to the shared folder. A
    second pass sends each distinct text of a slice once to its bucket; owner tasks take ranges of buckets in the
    order of hashes, chain texts that share a hash and compare their bytes, and write index leaves to the shared
    folder. A class of many entries is never held: its entries join its leaf, a join that can be split. Texts of a
    hash with very many rows are compared with one of them where they are read, and only what differs from it is
    chained; so no text meets all its copies in one task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "exact")
    kind = df.schema[key].dataType
    plain = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"))
    hashed = F.xxhash64("text") if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 64 - hash_bits), 64 - hash_bits)
    plain = plain.withColumn("hash", hashed)
    hashes = scratch.save(plain.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("top")).where("n > 1"), "hashes")
    repeated, rows, hottest = hashes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    plain = plain.withColumn("sha", F.sha2("text", 256))
    few = lambda table: F.broadcast(table) if repeated <= BROADCAST_ROWS else table
    counts = hashes.select(F.col("hash").alias("_h"), "n")
    every = plain.join(few(counts), F.col("hash") == F.col("_h"), "left").drop("_h")
    single = every.where("n is null").select(F.col("key").alias("own"), F.col("key").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")

    # the directory, from counts of leading bits, and its buckets in ranges of about as many rows for each owner
    capacity = max(capacity, -(-rows >> 17))
    limit = min(DIRECTORY_BITS, max(1, (4 * rows // capacity).bit_length()))
    counted = hashes.groupBy(F.shiftrightunsigned("hash", 64 - limit).alias("cell")).agg(F.sum("n")).collect()  # at most 2 ** limit rows
    sizes = np.zeros(1 << limit, np.int64)
    for cell, n in counted:
        sizes[cell] = n
    directory = Directory.of(sizes, capacity)
    buckets = directory.numbers()
    held = np.zeros(len(set(buckets.tolist())), np.int64)
    np.add.at(held, np.repeat(buckets, 1 << (limit - directory.depth)), sizes)
    owners = (np.cumsum(held) - held) // OWNER_ROWS
    listed = [(i, int(x), int(owners[x])) for i, x in enumerate(buckets.tolist())]
    cells = scratch.save(spark.createDataFrame(listed, "cell bigint, bucket bigint, owner int"), "directory")

    chained, parts = every.where("n is not null"), []
    if hottest >= HOT_ROWS:
        hot = scratch.save(hashes.where(F.col("n") >= HOT_ROWS), "hot")  # a row for each HOT_ROWS rows at most
        known = F.broadcast(hot.select(F.col("hash").alias("_h")))
        same, other = _hot(plain.join(known, F.col("hash") == F.col("_h"), "left_semi"), hot, scratch)
        chained = chained.join(known, F.col("hash") == F.col("_h"), "left_anti").select(*other.columns).union(other)
        best = same.groupBy("hash").agg(F.count(F.lit(1)).alias("group_size"), F.max("key").alias("keep_id"))
        best = scratch.save(best.withColumnRenamed("hash", "_h"), "best")
        same = same.withColumn("at", F.monotonically_increasing_id())
        same = scratch.save(same, "same")  # rows that tie in the largest key are told apart by their place
        ties = same.join(F.broadcast(best), F.col("hash") == F.col("_h")).where(F.col("key").eqNullSafe(F.col("keep_id")))
        winners = ties.groupBy(F.col("hash").alias("_w")).agg(F.min("at").alias("winner"))
        led = same.join(F.broadcast(best), F.col("hash") == F.col("_h")).join(F.broadcast(winners), F.col("hash") == F.col("_w"))
        parts.append(led.select(F.col("key").alias("own"), "keep_id", "group_size", (F.col("at") == F.col("winner")).alias("kept"), "sha"))

    placed = chained.withColumn("_cell", F.shiftrightunsigned("hash", 64 - directory.depth) if directory.depth else F.lit(0).cast("bigint"))
    placed = placed.join(F.broadcast(cells.select(F.col("cell").alias("_cell"), "owner")), "_cell")  # at most 2 ** DIRECTORY_BITS rows
    entries = placed.select("key", "text", "owner", "hash", "sha").mapInArrow(_entries, _ENTRY.format(kind=kind.simpleString()))
    owned = entries.repartitionById(int(owners.max()) + 1, "owner").sortWithinPartitions("hash").select("hash", "text", "sha", "ids")
    leaf = T.StructType().add("hash", T.LongType()).add("link", T.IntegerType()).add("entry", T.LongType()).add("sha", T.StringType()).add("ids", T.ArrayType(kind)).add("keep_id", kind).add("group_size", T.LongType()).add("winner", T.LongType())
    leaves = scratch.save(owned.mapInArrow(partial(_owners, kind=to_arrow_type(kind)), leaf), "leaves")
    members = leaves.where("entry is not null")
    classes = leaves.where("entry is null").select("hash", "link", "keep_id", "group_size", "winner")
    direct = members.where("winner is not null")
    joined = members.where("winner is null").drop("keep_id", "group_size", "winner").join(classes, ["hash", "link"])
    out = direct.unionByName(joined).select(F.posexplode("ids").alias("n", "own"), "sha", "keep_id", "group_size", "entry", "winner")
    out = out.select("own", "keep_id", "group_size", ((F.col("entry") == F.col("winner")) & (F.col("n") == 0)).alias("kept"), "sha")
    for part in (single, *parts):
        out = out.unionByName(part)
    return out.select(F.col("own").alias(key), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
