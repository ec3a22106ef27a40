"""BPE over a trie of distinct words, and the step from texts to distinct words and back.

Distinct words in sorted order are their trie in depth-first order: a word shares with its predecessor the
states of their common prefix. The state of a prefix is the last token of its encoding. A token that ends a
prefix is its last token exactly when it may follow the last token of what stands before it, that is when no
merge across their border comes before the merges that build them; so each state follows from an earlier one,
once for all words below it.
"""

from __future__ import annotations

import json
import math
from array import array
from functools import cache

import numpy as np
import pyarrow as pa

#: Pairs of tokens and moves between states that a worker remembers, about 100 bytes each; it starts anew beyond them.
HELD = 400_000
#: Stands for the mark that some vocabularies put on a word's last character.
WORD_END = ""


@cache
def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """The vocabulary and merges of a tokenizer file, as a trie codec needs them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        short = (lambda t: t[: -len(suffix)] + WORD_END if suffix and t.endswith(suffix) else t) if suffix else (lambda t: t)
        self.end = WORD_END if suffix else ""
        self.ids = {short(t): i for t, i in model["vocab"].items()}
        self.names = {i: t for t, i in self.ids.items()}
        self.ranks: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = map(short, pair.split(" ") if isinstance(pair, str) else pair)
            self.ranks[a, b] = rank
            self.made.setdefault(a + b, (rank, a, b))
        self.prefixes = {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        self.clear()

    def clear(self) -> None:
        """Forget what was worked out; the vocabulary stays."""
        self.spines: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self.follows: dict[int, bool] = {}  # pairs of ids, as one number
        # states are vocabulary prefixes: their moves by character, and the tokens (size, id) that end them, longest first
        self.numbers, self.spelled = {"": 0}, [""]
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.held = 0

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The parts of a token along its left (1) or right (2) border, each with the merge that takes it up."""
        if (token, side) not in self.spines:
            out, taken, part = [], math.inf, token
            while part:
                out.append((part, taken))
                if part not in self.made:
                    break
                taken, part = self.made[part][0], self.made[part][side]
            self.spines[token, side] = out
        return self.spines[token, side]

    def _may_follow(self, before: int, token: int) -> bool:
        ok = True
        left = self._spine(self.names[token], 1)
        for a, taken_a in self._spine(self.names[before], 2):
            for b, taken_b in left:
                rank = self.ranks.get((a, b))
                if rank is not None and rank < taken_a and rank <= taken_b:
                    ok = False
        self.follows[before << 32 | token] = ok
        return ok

    def _move(self, state: int, character: str) -> int:
        """The state of a prefix grown by a character: its longest end that is a vocabulary prefix."""
        grown = self.spelled[state] + character
        while grown and grown not in self.prefixes:
            grown = grown[1:]
        if grown not in self.numbers:
            self.numbers[grown] = len(self.spelled)
            self.spelled.append(grown)
            self.moves.append({})
            self.ends.append(tuple((len(grown) - i, self.ids[grown[i:]]) for i in range(len(grown)) if grown[i:] in self.ids))
        self.moves[state][character] = self.numbers[grown]
        self.held += 1
        return self.numbers[grown]

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """The ids, as little-endian 32-bit integers, of distinct sorted words in byte characters.

        Of each prefix the trie keeps the last token and where that token begins, so a word takes memory in
        proportion to its length; its ids are read backwards from its end.
        """
        if len(self.follows) + self.held > HELD:
            self.clear()
        follows, moves, ends, end_mark = self.follows, self.moves, self.ends, self.end
        out, previous = {}, ""
        last, begin, states = [-1], array("q", [0]), array("q", [0])  # by length of the prefix
        for word in words:
            n = min(len(word), len(previous))
            shared = 0
            if word[:n] == previous[:n]:
                shared = n
            else:
                while word[shared] == previous[shared]:
                    shared += 1
            del last[shared + 1 :], begin[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            full = word + end_mark
            for at in range(shared, len(full)):
                character = full[at]
                own = moves[state]
                state = own[character] if character in own else self._move(state, character)
                for size, token in ends[state]:
                    before = at + 1 - size
                    if before:
                        ok = follows.get(last[before] << 32 | token)
                        if ok is None:
                            ok = self._may_follow(last[before], token)
                        if not ok:
                            continue
                    last.append(token)
                    begin.append(before)
                    states.append(state)
                    break
                else:
                    raise ValueError(f"the vocabulary has no token for {character!r}")
            ids, at = array("i"), len(full)
            while at:
                ids.append(last[at])
                at = begin[at]
            ids.reverse()
            out[word] = ids.tobytes()
            if end_mark:
                last.pop(), begin.pop(), states.pop()
            previous = word
        return out


def gather(values: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated lists, the ``picks``-th of each in turn, and where each pick ends."""
    starts = np.cumsum(lengths) - lengths
    sizes = lengths[picks]
    ends = np.cumsum(sizes)
    where = np.repeat(starts[picks] - (ends - sizes), sizes)
    where += np.arange(len(where))
    return values[where], ends


def distinct(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of lists of words: where each list begins and ends among all words, each word's number, the distinct words."""
    bounds = np.frombuffer(words.offsets.buffers()[1], np.int32)[words.offsets.offset : words.offsets.offset + len(words) + 1].astype(np.int64)
    coded = words.flatten().dictionary_encode()
    return bounds - bounds[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


class Memory:
    """Strings a worker has met and what they stand for, as lists of 32-bit integers.

    It starts anew beyond ``limit`` bytes, ENTRY_BYTES for each string beside its characters and integers.
    """

    ENTRY_BYTES = 160

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.values = np.zeros(1 << 16, np.int32)
        self.starts, self.used, self.characters = np.zeros(1 << 14, np.int64), 0, 0

    def trim(self) -> None:
        if self.ENTRY_BYTES * len(self.slots) + self.characters + 4 * self.used > self.limit:
            self.clear()

    def add(self, keys: list[str], packed: list[bytes]) -> None:
        """``packed`` has little-endian 32-bit integers."""
        first, n = len(self.slots), len(keys)
        while first + n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        new = np.frombuffer(b"".join(packed), np.int32)
        while self.used + len(new) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.used : self.used + len(new)] = new
        self.starts[first + 1 : first + n + 1] = self.used + np.cumsum(np.fromiter(map(len, packed), np.int64, n) // 4)
        self.used += len(new)
        self.characters += sum(map(len, keys))
        self.slots.update(zip(keys, range(first, first + n)))

    def lists(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists in ``slots`` one after another, and where each ends."""
        starts = self.starts[slots]
        sizes = self.starts[slots + 1] - starts
        ends = np.cumsum(sizes)
        where = np.repeat(starts - (ends - sizes), sizes)
        where += np.arange(len(where))
        return self.values[where], ends
