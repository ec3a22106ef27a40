"""Unigram token counts by dynamic programming over a trie of distinct words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from tessera.llm.common import short_batches, slices
from tessera.llm.trie import distinct

#: Words whose counts a Python worker remembers between slices; it starts anew beyond them.
CACHE_WORDS = 500_000
#: The mark that stands for the white space before a word.
SPACE = "▁"


class UnigramCounter:
    """Counts the tokens of the likeliest segmentation of each word, the word's mark included.

    A piece's probability follows its rank in the vocabulary by Zipf's law. A character without a piece costs
    one token for each of its UTF-8 bytes, less likely than any piece. Of equally likely segmentations the one
    with fewer tokens counts. A word shares with its predecessor in sorted order, its neighbour in the trie in
    depth-first order, the scores and counts of their common prefix.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        total = math.log(sum(1 / r for r in range(1, len(kept) + 1)))
        self.scores = {model.id_to_piece(i): -math.log(r) - total for r, i in enumerate(kept, 1)}
        self.byte_score = -math.log(len(kept) + 1) - total
        self.prefixes = {t[:n] for t in self.scores for n in range(1, len(t) + 1)}
        self.steps: dict[str, tuple[str, list[tuple[int, float]]]] = {}
        self.memory: dict[str, tuple[int, float]] = {}

    def _step(self, grown: str) -> tuple[str, list[tuple[int, float]]]:
        state = grown
        while state and state not in self.prefixes:
            state = state[1:]
        pieces = [(len(state) - i, self.scores[state[i:]]) for i in range(len(state)) if state[i:] in self.scores]
        if grown[-1] not in self.scores:
            pieces.append((1, self.byte_score * len(grown[-1].encode("utf-8", "surrogatepass"))))
        self.steps[grown] = state, pieces
        return state, pieces

    def count(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """Tokens and log probability of each of distinct words, given in sorted order."""
        steps, scores = self.steps, self.scores
        if len(steps) > 1_000_000:
            steps.clear()
        out, previous = {}, ""
        best, counts, states = [0.0], [0], [""]  # by length of the prefix, the mark included
        for word in words:
            n = min(len(word), len(previous))
            shared = 0
            while shared < n and word[shared] == previous[shared]:
                shared += 1
            shared += bool(previous)  # the mark
            del best[shared + 1 :], counts[shared + 1 :], states[shared + 1 :]
            marked = SPACE + word
            state = states[shared]
            for at in range(shared, len(marked)):
                grown = state + marked[at]
                state, pieces = steps[grown] if grown in steps else self._step(grown)
                top, fewest = -math.inf, 0
                for size, score in pieces:
                    score += best[at + 1 - size]
                    n = counts[at + 1 - size] + (1 if size > 1 or marked[at] in scores else len(marked[at].encode("utf-8", "surrogatepass")))
                    if score > top or score == top and n < fewest:
                        top, fewest = score, n
                best.append(top)
                counts.append(fewest)
                states.append(state)
            out[word] = counts[-1], best[-1]
            previous = word
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, tokens and log probability of each whole text; null counts as empty."""
        bounds, numbers, words = distinct(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
        words = words.to_numpy(zero_copy_only=False).tolist()
        if len(self.memory) > CACHE_WORDS:
            self.memory.clear()
        self.memory.update(self.count(sorted(x for x in words if x and x not in self.memory)))
        known = [self.memory[x] if x else (0, 0.0) for x in words]
        tokens = np.array([x for x, _ in known], np.int64)[numbers] if known else np.zeros(0, np.int64)
        scores = np.array([x for _, x in known])[numbers] if known else np.zeros(0)
        real = np.array([bool(x) for x in words], np.int64)[numbers] if known else np.zeros(0, np.int64)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (real, tokens)]
        logs = np.array([scores[a:b].sum() for a, b in zip(bounds, bounds[1:])], np.float64)
        return *(x[bounds[1:]] - x[bounds[:-1]] for x in sums), logs


_COUNTERS: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(path)
    return _COUNTERS[path]


def _run(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for batch in slices(batches, "text"):
        words, tokens, logs = own.texts(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens), pa.array(logs)], ["key", "n_words", "n_tokens", "log_probability"])


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Unigram tokens of each row's whole text: (``key``, n_words, n_tokens, log_probability), a row for each row.

    Words stand between ASCII white space. A null, empty or blank text has no words and no tokens; null and
    repeated keys keep their rows; an empty table gives no rows; other columns are left out, whatever their
    names. No shuffle: a task holds the vocabulary, a bounded memory of words and one slice of texts.
    """
    short_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(partial(_run, path=path), f"key {kind}, n_words bigint, n_tokens bigint, log_probability double")
    return out.withColumnRenamed("key", key)
