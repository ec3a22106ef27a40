"""Packing token sequences into windows of near-equal load by multiway differencing."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tessera.llm.common import short_batches, slices
from tessera.llm.trie import Memory, byte_characters, distinct

#: Bytes of words and their ids that a Python worker remembers between slices, and parts of words; it starts anew beyond them.
CACHE_BYTES, CACHE_PARTS = 48 << 20, 50_000
#: Tokens of short pieces that are balanced at once, and the longest such piece: bounds for memory and time.
GROUP_TOKENS, PIECE_TOKENS = 96 * 2048, 512
#: The split pattern of the tokenizer file, here with the letters and digits below U+0180.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: What the library itself is asked for: characters from U+0180, letters that change otherwise, controls, special tokens.
_ASK = re.compile("[^\x00-\u017f]|\u0130|[\x1c-\x1f]|<\\|")


class WordEncoder:
    """Ids as the tokenizers library gives them, worked out once for each distinct word between white space.

    The file's normaliser and split pattern never join what white space parts, so words stand for themselves.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table = str.maketrans({chr(b): c for b, c in byte_characters().items()})
        self.model = self.tokenizer.model
        self.memory = Memory(CACHE_BYTES)
        self.parts: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        if _ASK.search(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for x in _SPLIT.findall(word.lower()):
            if x not in self.parts:
                own = x if x.isascii() else x.encode().decode("latin-1").translate(self.table)
                ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(own)])
                if len(x) > 3:
                    out.append(ids)
                    continue
                self.parts[x] = ids  # marks, digits and short words
            out.append(self.parts[x])
        return b"".join(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts one after another, and where each text's end; null counts as empty."""
        bounds, numbers, words = distinct(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
        words = words.to_numpy(zero_copy_only=False).tolist()
        self.memory.trim()
        slots = self.memory.slots
        new = [x for x in words if x not in slots]
        self.memory.add(new, list(map(self._ids, new)))
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        ids, ends = self.memory.lists(np.fromiter(map(slots.__getitem__, words), np.int64, len(words))[numbers])
        return ids, np.concatenate([[0], ends])[bounds[1:]]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: the indices of ``sizes`` in ``k`` parts of near-equal sums.

    Each size starts as a partial partition with one loaded part. The two partitions with the widest
    imbalance are merged, the heaviest part of one with the lightest of the other, until one is left.
    A partition is held as its loaded parts only, in falling order of load.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]  # minus the spread, a tie-breaker, loaded parts
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)  # parts of a without load are its lightest: they meet the heaviest parts of b
        meet = b[free:]
        cut = len(a) - len(meet)
        merged = b[:free] + a[:cut] + [(x + y, p + q) for (x, p), (y, q) in zip(reversed(a[cut:]), meet)]
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == k else 0
        turn += 1
        heapq.heappush(heap, (least - merged[0][0], turn, merged))
    return [p for _, p in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most ``capacity`` each; their number rises from the least possible until all fit."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        parts = difference(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        k += max(1, k // 200)


_FIELDS = "key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def _run(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    end = end_id.to_bytes(4, "little")
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 33
    kind = None
    waiting: list[tuple] = []  # key, start, ids, doc_tokens of short pieces
    tokens = 0

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def balanced() -> list[tuple]:
        nonlocal sequence, tokens
        rows = []
        sizes = [len(x[2]) // 4 for x in waiting]
        for part in windows(sizes, capacity):
            offset = 0
            for i in part:
                key, start, ids, n = waiting[i]
                rows.append((key, start, sizes[i], ids, n, sequence, offset))
                offset += sizes[i]
            sequence += 1
        waiting.clear()
        tokens = 0
        return rows

    for batch in slices(batches, "text"):
        kind = batch.column(0).type
        rows = []
        ids_of, ends = own.encode(batch.column(1))
        raw, at = ids_of.tobytes(), 0
        for key, to in zip(batch.column(0).to_pylist(), ends.tolist()):
            ids = raw[4 * at : 4 * to] + end
            n, at = to - at + 1, to
            whole = n - n % capacity
            for start in range(0, whole, capacity):
                rows.append((key, start, capacity, ids[4 * start : 4 * (start + capacity)], n, sequence, 0))
                sequence += 1
            left = n - whole
            pieces = -(-left // min(PIECE_TOKENS, capacity))
            for i in range(pieces):
                a, b = whole + left * i // pieces, whole + left * (i + 1) // pieces
                waiting.append((key, a, ids[4 * a : 4 * b], n))
            tokens += left
            if tokens >= GROUP_TOKENS:
                rows += balanced()
        if rows:
            yield out(rows)
    if waiting:
        yield out(balanced())


def pack(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut each row's ids, ended by ``end_id``, into pieces and the pieces into sequences of ``capacity`` ids at most.

    Returns a row for each piece: (``key``, start, length, ids as little-endian 32-bit integers, doc_tokens,
    sequence_id, offset). Whole windows of a long text are sequences of their own; what is left of each text is
    cut into near-equal short pieces, which multiway differencing deals to windows of near-equal load. A null text
    counts as empty and gives the end id alone; null and repeated keys keep their rows; other columns are left out.
    No shuffle: each task packs what it reads, and its sequence ids start at its partition's number << 33.
    """
    short_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(partial(_run, path=path, capacity=capacity, end_id=end_id), _FIELDS.format(kind=kind))
    return out.withColumnRenamed("key", key)
