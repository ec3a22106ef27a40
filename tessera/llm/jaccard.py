"""Near-duplicate texts: an n-gram Jaccard join filtered under several global token orders.

Two sets of Jaccard similarity t share a token among the first n - ceil(t n) + 1 of either under any order of
all tokens. Under one order, documents meet at their prefix tokens; a pair goes on only if their prefixes under
the other orders share tokens too, so many that the rest of the sets may still suffice, and if fixed-size maps
of token parities allow the similarity; only then are the whole sets compared. Every order goes by the estimated
frequency of a token first, so that common passages rarely stand in a prefix, and by a hash of its own next.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import short_batches, slices, small
from tessera.llm.trie import distinct
from tessera.operators.graph import components
from tessera.session import Scratch

#: Least similarity in hundredths, words of a shingle, further orders that filter pairs.
PERCENT, WORDS, ORDERS = 90, 3, 2
#: Counters of the frequency sketch (a power of two) and the parts in which tasks send it; it decides speed, never results.
SKETCH, PARTS = 1 << 20, 64
#: Classes at one token whose pairs are all tried at once, leaders of a larger meeting, and turns of leaders at most.
MEETING, LEADERS, TURNS = 48, 8, 6
#: Classes outside a meeting's largest group from which on its classes meet again at the next order's tokens.
AGAIN = 4096
#: Bits of a set's parity map (a multiple of 64): the bits in which two differ are at most the tokens not shared.
PARITY = 512
#: Bytes of text that a step of a task expands to words and shingles.
SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text one after another, sorted in each, and where each text's end.

    Words stand between ASCII white space, A to Z in lower case. A text with fewer words than a shingle is one
    shingle of all its words; a text without words has none.
    """
    bounds, numbers, known = distinct(pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    known = known.to_numpy(zero_copy_only=False)
    codes = pd.util.hash_array(known.astype(object), categorize=False).astype(np.uint64) if len(known) else np.zeros(0, np.uint64)
    empty = np.array([not x for x in known], bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    if empty.any():
        kept = ~empty[numbers]
        numbers, owner = numbers[kept], owner[kept]
    codes = codes[numbers]
    counts = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(codes) - words + 1), np.uint64)
        for k in range(words):
            total = mix(total + codes[k : k + len(total)] + np.uint64(0x9E3779B97F4A7C15))
        whole = owner[: len(total)] == owner[words - 1 : words - 1 + len(total)] if len(total) else np.zeros(0, bool)
        shingles, owners = total[whole], owner[: len(total)][whole]
        short = np.flatnonzero((counts > 0) & (counts < words))
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            x = np.zeros(1, np.uint64)
            for c in codes[starts[d] : starts[d] + counts[d]]:
                x = mix(x + c + np.uint64(0x9E3779B97F4A7C15))
            extra[i] = mix(x + np.uint64(counts[d]))[0]
    at = np.searchsorted(owners, short)
    shingles, owners = np.insert(shingles, at, extra), np.insert(owners, at, short)
    stops = np.cumsum(np.bincount(owners, minlength=len(texts)))
    for a, b in zip(np.concatenate([[0], stops])[:-1].tolist(), stops.tolist()):
        shingles[a:b].sort()
    first = np.ones(len(shingles), bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (owners[1:] != owners[:-1])
    return shingles[first], np.cumsum(np.bincount(owners[first], minlength=len(texts)))


def signature(tokens: np.ndarray) -> bytes:
    """Stands for a set: equal for equal sorted tokens."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, text) as (row, sign): the signature of each text's set, null for a text without words."""
    for batch in slices(batches, "text", SLICE_BYTES):
        tokens, ends = shingle_sets(batch.column(1), words)
        starts = np.concatenate([[0], ends])[:-1]
        signs = [signature(tokens[a:b]) if b > a else None for a, b in zip(starts.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.binary())], ["row", "sign"])


def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.uint32)
    shift = np.uint64(64 - (SKETCH - 1).bit_length())
    for batch in slices(batches, "text", SLICE_BYTES):
        tokens, _ = shingle_sets(batch.column(0), words)
        counts += np.bincount((tokens >> shift).astype(np.int64), minlength=SKETCH).astype(np.uint32)
    if counts.any():
        packed = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
            sums[part] = sums[part] + x if part in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])


def frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """How often tokens of each sketch cell occur in all texts, on a scale of quarter powers of two.

    Tasks send compressed counters once each, added up by part; the driver gets one fixed-size sketch.
    """
    sent = docs.select("text").mapInArrow(partial(_sketch, words=words), "part int, counts binary")
    rows = sent.repartition(min(PARTS, 16), "part").mapInArrow(_sum, "part int, counts binary").collect()
    out = np.zeros(SKETCH, np.uint32)
    for r in rows:
        out[r["part"] * (SKETCH // PARTS) : (r["part"] + 1) * (SKETCH // PARTS)] = np.frombuffer(r["counts"], np.uint32)
    typical = max(1.0, float(np.median(out)))
    return np.clip(4 * np.log2(np.maximum(out / typical, 1.0)), 0, 255).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def ordered_prefix(tokens: np.ndarray, ranks: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a set under one global order: by frequency, then by a hash of that order's own."""
    n = prefix_length(len(tokens), percent)
    with np.errstate(over="ignore"):
        place = (ranks.astype(np.uint64) << np.uint64(56)) | (mix(tokens + np.uint64(order) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(8))
    first = np.argpartition(place, n - 1)[:n] if 0 < n < len(place) else np.arange(len(place))
    return tokens[first[np.argsort(place[first])][:n]]


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each of PARITY residues of tokens whether an odd number of tokens has it."""
    odd = np.bincount((tokens % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _ranks(tokens: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return scale[(tokens >> np.uint64(64 - (SKETCH - 1).bit_length())).astype(np.int64)]


def _prefixes(batches: Iterator[pa.RecordBatch], scale: np.ndarray, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """For each text (key, text) its set's size and signature; for each set new to a slice its prefix under the first order."""
    for batch in slices(batches, "text", SLICE_BYTES):
        tokens, ends = shingle_sets(batch.column(1), words)
        seen: set[bytes] = set()
        sizes, signs, prefixes = [], [], []
        for a, b in zip(np.concatenate([[0], ends])[:-1].tolist(), ends.tolist()):
            own = tokens[a:b]
            sign = signature(own) if b > a else None
            sizes.append(b - a)
            signs.append(sign)
            fresh = sign is not None and sign not in seen
            seen.add(sign)
            prefixes.append(ordered_prefix(own, _ranks(own, scale), 0, percent).view(np.int64) if fresh else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["key", "n", "sign", "p0"])


def _sets(batches: Iterator[pa.RecordBatch], scale: np.ndarray, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of texts the sets new to a slice: signature, parities, prefixes under the other orders, all tokens."""
    for batch in slices(batches, "text", SLICE_BYTES):
        tokens, ends = shingle_sets(batch.column(0), words)
        out: dict[bytes, list] = {}
        for a, b in zip(np.concatenate([[0], ends])[:-1].tolist(), ends.tolist()):
            own = tokens[a:b]
            if b > a and (sign := signature(own)) not in out:
                ranks = _ranks(own, scale)
                out[sign] = [parity(own), *(ordered_prefix(own, ranks, k, percent).view(np.int64) for k in range(1, ORDERS + 1)), own.view(np.int64)]
        if out:
            columns = [pa.array(c, pa.list_(pa.int64())) for c in zip(*out.values())]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), *columns], ["sign", "odd", *(f"p{k}" for k in range(1, ORDERS + 1)), "tokens"])


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """The least shared tokens of two sets of these sizes: 100 s >= percent (n + m - s)."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100.0 + percent) - 1e-9)


def _may_suffice(x: str, y: str, n: Column, m: Column, percent: int) -> Column:
    """Whether two prefixes under one order leave room for enough shared tokens.

    Shared tokens up to the earlier of the two prefixes' ends are in both prefixes; the others lie behind it in
    the set whose prefix ends there.
    """
    rest = F.greatest(n - F.size(x), m - F.size(y))
    return F.size(F.array_intersect(x, y)) + rest >= _overlap(n, m, percent)


def _parities_fit(x: Column, y: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether the parities of two sets of these sizes differ in no more bits than tokens that only one of them may have."""
    bits = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(PARITY // 64)), F.lit(0))
    return bits <= n + m - 2 * _overlap(n, m, percent)


def _fits(x: Column, y: Column, percent: int) -> Column:
    """Length filter, then positional filter: the tokens from the shared one on may still suffice."""
    length = (x["n"] * 100 >= y["n"] * percent) & (y["n"] * 100 >= x["n"] * percent)
    return length & (F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= _overlap(x["n"], y["n"], percent))


class _Join:
    """The classes that meet, and the links found among them so far."""

    def __init__(self, scratch: Scratch, meetings: DataFrame, percent: int):
        self.scratch, self.meetings, self.percent = scratch, meetings, percent
        self.known: DataFrame | None = None  # (cid, n, odd, p1.., tokens)
        self.groups: DataFrame | None = None  # (item, rep) of linked classes

    def pairs(self, rows: DataFrame, others: DataFrame, on: list[str], where: Column, parities: bool = False) -> DataFrame:
        """Pairs (a, b) of classes that meet at ``on`` and pass the filters on sizes and places."""
        columns = ["cid", "n", "pos", "rep"] + ["odd"] * parities
        x = rows.select(*on, F.struct(*columns).alias("x"))
        y = others.select(*on, F.struct(*columns).alias("y"))
        met = x.join(y, on).where(where).where(_fits(F.col("x"), F.col("y"), self.percent))
        if parities:
            met = met.where(_parities_fit(F.col("x.odd"), F.col("y.odd"), F.col("x.n"), F.col("y.n"), self.percent))
        return met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))

    def link(self, pairs: DataFrame) -> bool:
        """Add those of the pairs that link: by their parities, by their prefixes under the other orders, then by whole sets; whether any did."""
        orders = [f"p{k}" for k in range(1, ORDERS + 1)]
        n, m = F.col("n_a"), F.col("n_b")
        steps = [
            (["n", "odd"], [_parities_fit(F.col("odd_a"), F.col("odd_b"), n, m, self.percent)]),
            (["n", *orders], [_may_suffice(f"{c}_a", f"{c}_b", n, m, self.percent) for c in orders]),
            (["n", "tokens"], [F.size(F.array_intersect("tokens_a", "tokens_b")) >= _overlap(n, m, self.percent)]),
        ]
        for columns, tests in steps:
            own = self.scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "own")
            n_own = own.count()
            if not n_own:
                return False
            known = self.known.join(small(own, n_own), "cid", "left_semi")  # only classes of these pairs are shuffled
            for x in "ab":
                pairs = pairs.join(known.select(F.col("cid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)), x)
            for test in tests:
                pairs = pairs.where(test)
            pairs = self.scratch.save(pairs.select("a", "b"), "passed")
        if pairs.isEmpty():
            return False
        if self.groups is not None:
            pairs = pairs.union(self.groups.select("item", "rep"))
        self.groups = self.scratch.save(components(pairs), "groups")
        return True

    def apart(self, meetings: DataFrame) -> DataFrame:
        """The rows, with the group of each class, of meetings whose classes no links connect yet."""
        if self.groups is None:
            return meetings.withColumn("rep", F.col("cid"))
        rows = meetings.join(self.groups.select(F.col("item").alias("cid"), "rep"), "cid", "left").withColumn("rep", F.coalesce("rep", "cid"))
        differ = rows.groupBy("token").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("r0 <> r1").select("token")
        return self.scratch.save(rows.join(differ, "token", "left_semi"), "apart")

    def run(self, sets) -> DataFrame | None:
        """The groups; ``sets`` gives whole sets of classes."""
        larger = F.col("x.cid") < F.col("y.cid")
        other = F.col("x.rep") != F.col("y.rep")
        few = self.meetings.where(F.col("classes") <= MEETING).withColumn("rep", F.col("cid"))
        pairs = self.scratch.save(self.pairs(few, few, ["token"], larger).distinct(), "pairs")
        large = self.meetings.where(F.col("classes") > MEETING)
        self.known = sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")).union(large.select("cid")).distinct())
        self.link(pairs)
        if large.isEmpty():
            return self.groups
        # leaders: in each turn every class tries those of one of its meetings; first the classes that the fewest
        # tokens of their own keep from the shared one, as the original of a group of copies, then others
        for turn in range(TURNS):
            left = self.apart(large)
            if left.isEmpty():
                return self.groups
            own, at = F.xxhash64("cid", F.lit(turn)), F.xxhash64("token", F.lit(turn))
            row = F.struct("token", "cid", "n", "pos", "rep")
            order = [F.col("pos"), own] if turn == 0 else [own]
            leaders = left.groupBy("token", F.pmod(own, F.lit(LEADERS)).alias("seat")).agg(F.min(F.struct(F.struct(*order).alias("o"), row.alias("row"))).alias("best"))
            chosen = [F.col("pos"), at] if turn == 0 else [at]
            tries = left.groupBy("cid").agg(F.min(F.struct(F.struct(*chosen).alias("o"), row.alias("row"))).alias("best"))
            pairs = self.pairs(tries.select("best.row.*"), leaders.select("best.row.*"), ["token"], other)
            if not self.link(self.scratch.save(pairs.distinct(), "pairs")):
                break
        left = self.apart(large)
        if not left.isEmpty():
            self.link(self.scratch.save(self.rest(left).distinct(), "pairs"))
        return self.groups

    def rest(self, left: DataFrame) -> DataFrame:
        """All pairs still apart: one class of each is outside its meeting's largest group, so only such are tried with all."""
        other = F.col("x.rep") != F.col("y.rep")
        shares = left.groupBy("token", "rep").agg(F.count(F.lit(1)).alias("own"))
        most = shares.groupBy("token").agg(F.max_by("rep", "own").alias("most"), (F.sum("own") - F.max("own")).alias("outside"))
        left = left.drop("classes").join(self.known.select("cid", "odd"), "cid").join(most, "token")
        left = self.scratch.save(left.withColumn("minor", F.col("rep") != F.col("most")).drop("most"), "left")
        some = left.where(F.col("outside") <= AGAIN)
        pairs = self.pairs(some.where("minor"), some, ["token"], other, parities=True)
        many = left.where(F.col("outside") > AGAIN)
        if not many.isEmpty():
            again = self.scratch.save(many.join(self.known.select("cid", F.explode("p1").alias("token1")), "cid"), "again")
            pairs = pairs.union(self.pairs(again.where("minor"), again, ["token", "token1"], other, parities=True))
        return pairs


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Groups of texts linked by shingle sets of Jaccard similarity of ``percent`` or more.

    (``key``, n_shingles, component_id, sign, lead), a row for each row of ``df``; ``component_id`` is the smallest
    key that links reach, ``sign`` stands for the set, ``lead`` is the smallest sign of the group's that has that
    key. A null text or one without words has no shingles, links with nothing and is its own group. Null keys keep
    their rows and never name a group that has another key; rows that repeat a key are rows like others; an empty
    table gives no rows; other columns are left out, whatever their names. Sets hold 64-bit hashes of shingles.

    Texts with equal sets are one class with one 128-bit signature. Classes meet at prefix tokens, which are counted
    with partial sums, so that only shared ones are joined. In a large meeting classes first try a few leaders, which
    joins the copies of one original at linear cost; pairs go on only while their classes are apart. What leaders
    leave apart meets again at the prefix tokens of a further order, so no link is lost. No group is ever collected;
    the state of each step is a written table.
    """
    spark = df.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "jaccard")
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"))
    scale = frequencies(docs, words)
    how = {"scale": scale, "words": words, "percent": percent}
    found = scratch.save(docs.mapInArrow(partial(_prefixes, **how), f"key {kind}, n bigint, sign binary, p0 array<bigint>"), "found")
    rows = scratch.save(found.select("key", "n", "sign"), "rows")
    classes = found.where("p0 is not null").dropDuplicates(["sign"]).withColumn("cid", F.monotonically_increasing_id())
    classes = scratch.save(classes, "classes")
    scratch.drop(found)

    # tokens where classes meet, one of them early enough for the smaller set of a pair
    at = classes.select("cid", "n", F.posexplode("p0").alias("pos", "token"))
    early = F.col("n") - F.col("pos") >= _overlap(F.col("n"), F.col("n"), percent)
    shared = at.groupBy("token").agg(F.count(F.lit(1)).alias("classes"), F.max(early).alias("early")).where("classes > 1 and early").drop("early")
    shared = scratch.save(shared, "shared")
    meetings = scratch.save(at.join(shared, "token"), "meetings")
    groups = None
    if not meetings.isEmpty():
        how_sets = partial(_sets, **how)
        lists = ", ".join(f"{c} array<bigint>" for c in ("odd", *(f"p{k}" for k in range(1, ORDERS + 1)), "tokens"))

        def sets(cids: DataFrame) -> DataFrame:
            """Whole sets of classes, from the texts under one key of each."""
            wanted = scratch.save(classes.join(cids, "cid", "left_semi").select("cid", "sign", "n", "key"), "wanted")
            keys = wanted.select(F.col("key").alias("own")).distinct()
            n = wanted.count()
            texts = docs.join(small(keys, n), docs["key"].eqNullSafe(keys["own"]), "left_semi").select("text")
            every = texts.mapInArrow(how_sets, f"sign binary, {lists}")
            known = scratch.save(every.join(small(wanted.drop("key"), n), "sign").drop("sign"), "known")
            # a set comes twice only where texts share a key
            return known if known.count() == n else scratch.save(known.dropDuplicates(["cid"]), "known")

        groups = _Join(scratch, meetings, percent).run(sets)

    named = rows.where("sign is not null").groupBy("sign").agg(F.min("key").alias("least"))
    named = named.join(classes.select("sign", "cid"), "sign").withColumn("rep", F.col("cid"))
    if groups is not None:
        linked = groups.select(F.col("item").alias("cid"), F.col("rep").alias("to"))
        named = named.join(linked, "cid", "left").withColumn("rep", F.coalesce("to", "cid"))
    named = scratch.save(named.select("sign", "least", "rep"), "named")
    lows = named.groupBy("rep").agg(F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull(), "least", "sign"))["sign"].alias("lead"))
    by_class = named.join(lows, "rep").select(F.col("sign").alias("class"), "component_id", "lead")
    out = rows.join(by_class, F.col("sign") == F.col("class"), "left")
    component = F.when(F.col("sign").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), "sign", "lead")
