"""Toxic passages by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import short_batches, slices
from tessera.llm.trie import distinct
from tessera.session import Scratch

#: Labelled rows that a model is fitted on at most, taken by a hash of their key; bounds the model too.
TRAIN_ROWS = 20_000
#: Strength of the Dirichlet prior, and what a neutral word costs a segment.
PRIOR, DRIFT = 4.0, 1.0
#: Word beginnings that stand in for words too rare to be known, and how pure they must be.
STEMS, PURE = (5, 4), 0.9
#: Evidence beyond which more does not count, in fitting the logistic scale as in using it.
MOST_EVIDENCE = 20.0
PREDICT = 0.3


@dataclass
class ToxicityModel:
    """Scores of words and stems; the extreme-value law of a clean text's best segment; a logistic scale."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda of the extreme-value law
    size: float = 0.1  # K of the same law
    offset: float = -2.0
    slope: float = 1.0

    def score(self, word: str) -> float:
        """The log-odds of one word above the drift; minus the drift if nothing speaks for toxicity."""
        if word in self.words:
            return self.words[word]
        for n in STEMS:
            if word[:n] in self.stems and len(word) > n:
                return self.stems[word[:n]]
        return -DRIFT

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.minimum(evidence, MOST_EVIDENCE), -30, 30)))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-case runs of letters and digits: bounds of each text, word numbers, distinct words ("" is none)."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN\pM]+", " ")
    bounds, numbers, words = distinct(pc.split_pattern(plain, " "))
    return bounds, numbers, words.to_numpy(zero_copy_only=False).tolist()


def segments(scores: list[float], places: list[int], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text whose other words cost ``drift`` each.

    ``scores`` are those of the words at ``places``, in order. One pass with a stack: a new segment merges with
    earlier ones while the stretch from an earlier lower start to it scores more than the earlier one's end. Each
    entry knows the nearest one below it that starts lower, and whatever lies between starts no lower than the
    entry, so a search goes along these pointers and the pass takes linear time.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, nearest lower start below
    total, previous = 0.0, -1
    for s, at in zip(scores, places):
        total -= drift * (at - previous - 1)
        previous = at
        if s <= 0:
            total += s
            continue
        first, left, total = at, total, total + s
        right = total
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((first, at, left, right, j))
                break
            first, left = stack[j][0], stack[j][2]
            below = stack[j][4]
            del stack[j:]
            j = below
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def _evidence(texts: pa.Array, model: ToxicityModel) -> tuple[np.ndarray, list[list[tuple[int, int, float]]], np.ndarray, np.ndarray]:
    """Of each text: extreme-value evidence, significant segments, words, and the score of its best segment."""
    bounds, numbers, words = words_of(texts)
    values = np.array([model.score(w) if w else 0.0 for w in words])[numbers] if words else np.zeros(0)
    real = np.array([bool(w) for w in words], bool)[numbers] if words else np.zeros(0, bool)
    counts = np.concatenate([[0], np.cumsum(real)])[bounds]
    lengths = np.diff(counts)
    values = values[real]
    hits = np.flatnonzero(values > -DRIFT)  # all other words cost the drift
    n = len(lengths)
    evidence, best, found = np.zeros(n), np.zeros(n), [[] for _ in range(n)]
    owners = np.searchsorted(counts, hits, "right") - 1
    cuts = np.flatnonzero(np.diff(owners, prepend=-1, append=n + 1)) if len(hits) else np.zeros(0, np.int64)
    for a, b in zip(cuts, cuts[1:]):
        i = int(owners[a])
        base = int(counts[i])
        own = segments(values[hits[a:b]].tolist(), (hits[a:b] - base).tolist(), DRIFT)
        best[i] = max((s for _, _, s in own), default=0.0)
        least = math.log(max(model.size * lengths[i], 1e-9))
        for first, last, s in own:
            if (bits := model.rate * s - least) > 0:
                evidence[i] += bits
                found[i].append((first, last, s))
    return evidence, found, lengths, best


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label and part that hold a word or a stem."""
    for batch in slices(batches, "text"):
        bounds, numbers, words = words_of(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        part = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(label)), np.diff(bounds))
        tokens: dict[str, int] = {}
        level = [np.array([tokens.setdefault(f"w{w}", len(tokens)) if w else -1 for w in words], np.int64)]
        for k in STEMS:
            level.append(np.array([tokens.setdefault(f"{k}{w[:k]}", len(tokens)) if len(w) >= k else -1 for w in words], np.int64))
        pairs = [np.unique(np.stack([x[numbers], owner]), axis=1) for x in level]
        pairs = np.concatenate([p[:, p[0] >= 0] for p in pairs], axis=1) if words else np.zeros((2, 0), np.int64)
        kinds = [np.bincount(pairs[0][(label[pairs[1]] == y) & (part[pairs[1]] == p)], minlength=len(tokens)) for y in (1, 0) for p in (0, 1)]
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(list(tokens)), *(pa.array(x.astype(np.int64)) for x in kinds)], ["token", "toxic0", "toxic1", "clean0", "clean1"])


def _features(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        evidence, _, lengths, best = _evidence(batch.column(0), model)
        yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(evidence), pa.array(lengths), pa.array(best)], ["label", "evidence", "words", "best"])


def extreme_values(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """Rate and size of the law P(best < s) = exp(-size words exp(-rate s)) that the best segments of clean texts follow.

    The likeliest pair; a text without any segment has a best score of zero, which counts as the law's value there.
    For each rate the likeliest size is known, so the search is over rates alone. Without segments the rate is 1.
    """
    hit = best > 0
    n = int(hit.sum())
    if not n:
        return 1.0, 0.5 / max(1.0, float(words.sum()))

    def likelihood(rate: float) -> tuple[float, float]:
        size = n / float((words * np.exp(-rate * best)).sum())
        return n * (math.log(rate) + math.log(size)) - rate * float(best[hit].sum()) - n, size

    low, high = math.log(0.02), math.log(5.0)
    for _ in range(60):  # the likelihood has one peak
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (a, high) if likelihood(math.exp(a))[0] < likelihood(math.exp(b))[0] else (low, b)
    rate = math.exp((low + high) / 2)
    return rate, likelihood(rate)[1]


def _tokens(rows: list, toxic: int, clean: int, kinds: tuple[int, ...]) -> ToxicityModel:
    """Log-odds above the corpus's own, each token's Dirichlet prior centred on its stem's, a stem's on the corpus's."""
    base = (toxic + 0.5) / (toxic + clean + 1)
    logit = lambda x: math.log(x / (1 - x))
    seen = {r["token"]: (sum(r[f"toxic{k}"] for k in kinds), sum(r[f"clean{k}"] for k in kinds)) for r in rows}
    chance: dict[str, float] = {}

    def of(token: str) -> float:
        if token not in chance:
            above = base
            for n in STEMS:
                if token[0] == "w" or n < int(token[0]):
                    if len(token) > n and f"{n}{token[1 : n + 1]}" in seen:
                        above = of(f"{n}{token[1 : n + 1]}")
                        break
            y1, y0 = seen[token]
            chance[token] = min(max((y1 + PRIOR * above) / (y1 + y0 + PRIOR), 1e-6), 1 - 1e-6)
        return chance[token]

    model = ToxicityModel()
    for token in seen:
        if token[0] == "w":
            model.words[token[1:]] = max(logit(of(token)) - logit(base) - DRIFT, -DRIFT)
        elif of(token) >= PURE:
            model.stems[token[1:]] = logit(of(token)) - logit(base) - DRIFT
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope of the chance of y = 1 given x, by Newton steps with a small ridge; the slope is not negative."""
    w = np.zeros(2)
    features = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + 0.05 * np.eye(2), features.T @ (y - p) - 0.05 * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = TRAIN_ROWS) -> ToxicityModel:
    """A model from labelled rows whose crc32(key as text) mod 4 is not 2; null keys, texts or labels teach nothing.

    At most about ``limit`` rows are used, chosen by a hash of their key, which also bounds what the driver gets:
    the words and stems that are commoner in toxic rows than in others, and a few numbers of each row. Three parts in
    four of the rows teach the words from which the law of extreme values and the logistic scale are then fitted on
    the others; all rows teach the words of the model.
    """
    short_batches(docs.sparkSession)
    remainder = F.crc32(F.col("key").cast("string")) % 4
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    known = known.groupBy("key").agg(F.max("label").alias("label")).where(remainder != 2)
    totals = known.groupBy("label").count().collect()
    share = min(1.0, limit / max(1, sum(r["count"] for r in totals)))
    known = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20))).withColumn("part", F.when(remainder == 3, 1).otherwise(0))
    text_of = docs.select(docs[key].alias("key"), docs[text].alias("text")).where("key is not null and text is not null")
    train = text_of.join(known, "key").select("text", "label", "part")
    train = Scratch(docs.sparkSession, "toxicity").save(train, "train")
    counted = train.mapInArrow(_counts, "token string, toxic0 bigint, toxic1 bigint, clean0 bigint, clean1 bigint")
    sums = counted.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("toxic0", "toxic1", "clean0", "clean1")))
    sizes = {(r["label"], r["part"]): r["count"] for r in known.groupBy("label", "part").count().collect()}
    toxic, clean = (sum(sizes.get((y, p), 0) for p in (0, 1)) for y in (1, 0))
    if not toxic or not clean:
        return ToxicityModel()
    base = toxic / (toxic + clean)
    hits = F.col("toxic0") + F.col("toxic1")
    rows = sums.where((hits >= 2) & (hits / (hits + F.col("clean0") + F.col("clean1")) > min(0.5, 2 * base))).collect()
    first = _tokens(rows, sizes.get((1, 0), 0), sizes.get((0, 0), 0), (0,))
    model = _tokens(rows, toxic, clean, (0, 1))
    held = train.where("part = 1").select("text", "label")
    features = lambda: np.array([list(r) for r in held.mapInArrow(partial(_features, model=first), "label int, evidence double, words bigint, best double").collect()], float).reshape(-1, 4)
    seen = features()
    clean = seen[(seen[:, 0] == 0) & (seen[:, 2] > 0)]
    if len(clean) and (seen[:, 0] == 1).any():
        first.rate, first.size = extreme_values(clean[:, 3], clean[:, 2])
        seen = features()  # evidence by the fitted law, summed over segments as in scoring
        first.offset, first.slope = logistic(np.minimum(seen[:, 1], MOST_EVIDENCE), seen[:, 0])
        model.rate, model.size, model.offset, model.slope = first.rate, first.size, first.offset, first.slope
    return model


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
    for batch in slices(batches, "text"):
        evidence, found, _, _ = _evidence(batch.column(1), model)
        spans = pa.array([[{"first": a, "last": b, "score": s} for a, b, s in x] for x in found], kind)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(evidence)), spans], ["row", "score", "passages"])


def score(df: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = PREDICT) -> DataFrame:
    """(row, score, passages, predicted) for each row: ``row`` is a struct of all columns of ``df``.

    ``passages`` are the significant segments as word numbers; evidence adds up over them and becomes the score.
    A null or empty text has no passages; null keys, repeated rows and further columns of any name pass through
    in ``row``. No shuffle; a task holds the model and one slice of texts.
    """
    short_batches(df.sparkSession)
    packed = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), df[text].alias("text"))
    passages = T.ArrayType(T.StructType().add("first", T.LongType()).add("last", T.LongType()).add("score", T.DoubleType()))
    schema = T.StructType().add("row", packed.schema["row"].dataType).add("score", T.DoubleType()).add("passages", passages)
    out = packed.mapInArrow(partial(_score, model=model), schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
