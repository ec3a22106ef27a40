"""BPE encoding and decoding by prefix-sharing trie traversal."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tessera.llm.common import short_batches, slices
from tessera.llm.trie import Memory, Merges, byte_characters, distinct, gather

#: Bytes of pieces of text and their encodings that a Python worker remembers between slices; it starts anew beyond them.
CACHE_BYTES = 48 << 20
#: Bytes of text that a step of a task encodes and decodes.
SLICE_BYTES = 1 << 20

#: The Unicode property White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
#: A space within a run of white space, which cutting before each space would split; also at the end of the text.
_RUN = f"[{SPACE}] (?:[{SPACE}]|$)"
#: The split pattern of byte-level vocabularies, here with the letters and digits below U+0180.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_FAR = re.compile("[^\x00-ſ]")


class ByteCodec:
    """Encodes and decodes as the byte-level tokenizer in ``path`` does without adding special tokens."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.special = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chars = {chr(b): c for b, c in byte_characters().items()}
        self.table = str.maketrans(self.chars)
        self.memory = Memory(CACHE_BYTES)
        back = {c: b for b, c in byte_characters().items()}
        tokens = {i: bytes(back[c] for c in t) for t, i in self.merges.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        spelled = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def _words(self, piece: str) -> list[str]:
        if _FAR.search(piece):
            return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]
        return [x.encode().decode("latin-1").translate(self.table) for x in _SPLIT.findall(piece)]

    def pieces(self, pieces: list[str]) -> np.ndarray:
        """Where the memory has the ids of distinct pieces of text, each as if it were a whole text without special tokens."""
        slots = self.memory.slots
        new = [x for x in dict.fromkeys(pieces) if x not in slots]
        words = [self._words(x) for x in new]
        known = self.merges.encode(sorted({x for w in words for x in w}))
        self.memory.add(new, [b"".join(map(known.__getitem__, w)) for w in words])
        return np.fromiter(map(slots.__getitem__, pieces), np.int64, len(pieces))

    def _whole(self, text: str) -> np.ndarray:
        """A text that holds special tokens or runs of spaces."""
        parts = self.marks.split(text) if self.marks else [text]
        return np.concatenate([np.array([self.special[x]], np.int32) if i % 2 else self.memory.lists(self.pieces([x]))[0] for i, x in enumerate(parts)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts one after another, and where each text's end; null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _RUN)
        for mark in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        plain = pc.if_else(odd, "", texts)
        bounds, numbers, words = distinct(pc.split_pattern(plain, " "))
        words = words.to_numpy(zero_copy_only=False).tolist()
        firsts = bounds[:-1]
        first_numbers, first_of = np.unique(numbers[firsts], return_inverse=True)
        numbers = numbers.astype(np.int64)
        numbers[firsts] = len(words) + first_of  # no space stands before the first piece
        self.memory.trim()
        slots = self.pieces([f" {x}" for x in words] + [words[i] for i in first_numbers])
        ids, ends = self.memory.lists(slots[numbers])
        ends = ends[bounds[1:] - 1]
        if pc.any(odd).as_py():
            parts = np.split(ids, ends[:-1])
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                parts[i] = np.frombuffer(self._whole(texts[int(i)].as_py()), np.int32)
            ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return ids, ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids one after another, ``ends`` being each text's end. Broken UTF-8 becomes U+FFFD."""
        raw, stops = gather(self.spelled, self.lengths, ids)
        raw = raw.tobytes()
        cuts = [0, *np.concatenate([[0], stops])[ends].tolist()]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


_CODECS: dict[str, ByteCodec] = {}


def codec(path: str) -> ByteCodec:
    """One codec for each file and Python process."""
    if path not in _CODECS:
        _CODECS[path] = ByteCodec(path)
    return _CODECS[path]


def _run(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in slices(batches, "text", SLICE_BYTES):
        ids, ends = own.encode(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(own.decode(ids, ends), pa.string())], ["key", "ids", "decoded"])


def bpe_round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each row's whole text: (``key``, ids array<int>, decoded string), a row for each row.

    A null text counts as empty and has no ids; null and repeated keys keep their rows; an empty table gives no
    rows; other columns are left out, whatever their names. No shuffle: a task holds the vocabulary, a bounded
    cache and one slice of texts; a very long text is a slice of its own.
    """
    short_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(partial(_run, path=path), f"key {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("key", key)
