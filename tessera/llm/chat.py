"""Chat formatting in budgeted, turn-aligned windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import Scratch

#: Tokens (words and marks, by a simple count) of a window, and of the history that a later window repeats.
WINDOW_TOKENS, HISTORY_TOKENS = 512, 128

#: Marks of the template and the control strings that texts must not spell.
OPEN, ROLE_END, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Inside control strings this character keeps them apart; it is doubled wherever a text has it.
ESCAPE = "\\"
_HIDE = re.compile(re.escape(ESCAPE) + "|(?=" + "|".join(map(re.escape, CONTROL)) + ").", re.S)
_SHOW = re.compile(re.escape(ESCAPE) + "(.)", re.S)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    """Spell a text without control strings: an escape after the first character of each, and escapes doubled."""
    return _HIDE.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else f"{m[0]}{ESCAPE}.", text)


def unescape(text: str) -> str:
    return _SHOW.sub(lambda m: ESCAPE if m[1] == ESCAPE else "", text)


def size(text: str) -> int:
    """Tokens of a turn: its words and marks, and three for the template."""
    return len(_TOKEN.findall(text)) + 3


def spans(sizes: list[int], roles: list[str], window: int, history: int) -> list[tuple[int, int, int]]:
    """Windows as (first turn shown, first new turn, end), from prefix sums of turn sizes.

    A leading system turn is shown in every window and paid from its budget. New turns fill a window while the
    budget lasts, one at least; before them stand as many of the turns before as ``history`` allows, as long as
    the first new turn still fits.
    """
    sums = [0]
    for n in sizes:
        sums.append(sums[-1] + n)
    system = bool(roles) and roles[0] == "system"
    out, at = [], 0
    while at < len(sizes):
        kept = sizes[0] if system and at else 0
        first = at
        while first > int(system) and sums[at] - sums[first - 1] <= history and kept + sums[at + 1] - sums[first - 1] <= window:
            first -= 1
        end = at + 1
        while end < len(sizes) and kept + sums[end + 1] - sums[first] <= window:
            end += 1
        out.append((first, at, end))
        at = end
    return out


def format_window(turns: list[tuple[str, str]], shown: list[int], new: int) -> tuple[str, list[list[int]], list[list[int]]]:
    """The text of turns ``shown``, the character spans of its loss, and of its new turns (start, role end, end).

    Loss falls on the texts of assistant turns from ``new`` on; repeated ones are masked.
    """
    text, loss, fresh = "", [], []
    parts: list[str] = []
    at = 0
    for i in shown:
        role, own = escape(turns[i][0]), escape(turns[i][1])
        start = at + len(OPEN)
        begin = start + len(role) + len(ROLE_END)
        end = begin + len(own)
        parts += [OPEN, role, ROLE_END, own, CLOSE]
        at = end + len(CLOSE)
        if i >= new:
            fresh.append([start, begin, end])
            if turns[i][0] == "assistant":
                loss.append([begin, end])
    text = "".join(parts)
    return text, loss, fresh


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (key, role, text) with their place among all: the number of the range, then the row in it."""
    at = TaskContext.get().partitionId() << 40
    for batch in batches:
        sizes = pa.array([size(t) for t in batch.column(2).to_pylist()], pa.int64())
        places = pa.array(range(at, at + batch.num_rows), pa.int64())
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, places, sizes], ["key", "role", "text", "at", "size"])


def _shown(batches: Iterator[pa.RecordBatch], window: int, history: int) -> Iterator[pa.RecordBatch]:
    """Of sorted turns (key, place, size, system) the windows of ``spans`` that show each: (window, place, fresh, start).

    ``start`` is the place of the conversation's first turn, which names the conversation. Only the turns that a
    history can reach and the open window's tokens are held.
    """
    state: dict | None = None
    for batch in batches:
        rows: list[tuple] = []
        for key, at, n, system in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if state is None or state["key"] != key:
                # tail: turns that a history may repeat; held: tokens of the open window, a repeated system turn among them
                state = {"key": key, "start": at, "system": n if system else None, "window": 0, "held": n, "tail": deque(), "sum": 0}
            elif state["held"] + n <= window:
                state["held"] += n
            else:
                state["window"] += 1
                held = n + (state["system"] or 0)
                if state["system"] is not None:
                    rows.append((state["window"], state["start"], False, state["start"]))
                back = 0
                for before, m in reversed(state["tail"]):
                    if back + m > history or held + m > window:
                        break
                    back += m
                    held += m
                    rows.append((state["window"], before, False, state["start"]))
                state["held"] = held
            rows.append((state["window"], at, True, state["start"]))
            if at != state["start"] or state["system"] is None:
                state["tail"].append((at, n))
                state["sum"] += n
                while state["sum"] > history and state["tail"]:
                    state["sum"] -= state["tail"].popleft()[1]
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["window", "at", "fresh", "start"])


def _format(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    pairs = pa.list_(pa.list_(pa.int64()))
    for batch in batches:
        rows = []
        for key, window, turns in zip(*(batch.column(i).to_pylist() for i in range(3))):
            new = sum(not t["fresh"] for t in turns)
            rows.append((key, window, *format_window([(t["role"], t["text"]) for t in turns], list(range(len(turns))), new)))
        kinds = [kind, pa.int64(), pa.string(), pairs, pairs]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "window", "formatted", "loss", "fresh"])


def chat_windows(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", window: int = WINDOW_TOKENS, history: int = HISTORY_TOKENS) -> DataFrame:
    """Formatted windows of each conversation: (``key``, window, formatted, loss, fresh).

    ``loss`` and ``fresh`` are character spans of ``formatted``: the loss, and (role start, text start, text end)
    of the turns that the window shows first. Turns go by ``turn``, a null one first, ties by role and text. Null
    roles and texts count as empty; a null key is a conversation of its own; repeated rows are turns like others;
    an empty table gives no rows; further columns are left out, whatever their names. A turn longer than the
    budget has a window of its own, uncut. A system turn that comes first is repeated in every window.

    Windows are those of ``spans`` over the whole conversation, however long it is and whatever its turn numbers:
    turns are placed by ranges, one task reads a conversation's sizes in order, never its texts, and no group
    holds more than a window.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    rows = df.select(df[key].alias("key"), df[turn].cast("bigint").alias("turn"), F.coalesce(df[role], F.lit("")).alias("role"), F.coalesce(df[text], F.lit("")).alias("text"))
    order = ["key", "turn", "role", "text"]
    schema = T.StructType().add("key", kind).add("role", T.StringType()).add("text", T.StringType()).add("at", T.LongType()).add("size", T.LongType())
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "role", "text").mapInArrow(_place, schema)
    placed = Scratch(df.sparkSession, "chat").save(placed, "placed")
    sizes = placed.select("key", "at", "size", (F.col("role") == "system").alias("system")).repartition("key").sortWithinPartitions("key", "at")
    shown = sizes.mapInArrow(partial(_shown, window=window, history=history), "window bigint, at bigint, fresh boolean, start bigint")
    turns = shown.join(placed.select("key", "at", "role", "text"), "at")
    packed = turns.groupBy("start", "window").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct("at", "fresh", "role", "text"))).alias("turns"))
    spans_of = T.ArrayType(T.ArrayType(T.LongType()))
    schema = T.StructType().add("key", kind).add("window", T.LongType()).add("formatted", T.StringType()).add("loss", spans_of).add("fresh", spans_of)
    out = packed.select("key", "window", "turns").mapInArrow(partial(_format, kind=to_arrow_type(kind)), schema)
    return out.withColumnRenamed("key", key)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read turns and losses back from windows sorted by conversation and window; one row for each conversation."""
    state: dict | None = None
    rows: list[tuple] = []

    def close() -> None:
        if state is not None:
            rows.append((state["key"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

    for batch in batches:
        keys, texts, losses, fresh_of = (batch.column(i).to_pylist() for i in range(4))
        for key, text, loss, fresh in zip(keys, texts, losses, fresh_of):
            if state is None or state["key"] != key:
                close()
                state = {"key": key, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}
            for start, begin, end in fresh:
                role, own = unescape(text[start : begin - len(ROLE_END)]), unescape(text[begin:end])
                state["turns"].update(f"{role}\n{own}\n".encode())
                state["n"] += 1
            for begin, end in loss:
                own = unescape(text[begin:end])
                state["loss"].update(own.encode())
                state["chars"] += len(own)
            state["size"] += len(text)
        if rows:
            yield _rows(rows)
            rows.clear()
    close()
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(windows: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the windows of each conversation say when read back, one row each, streamed in order.

    A digest of a whole conversation follows its windows one by one; it keeps a hash state, never the texts.
    """
    own = windows.select(F.col(key).cast("bigint").alias("conv_id"), "window", "formatted", "loss", "fresh")
    sorted_ = own.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "formatted", "loss", "fresh")
    return sorted_.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
