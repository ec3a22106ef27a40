"""Lines and comma-separated fields in a lenient dialect, with ragged rows kept as they are."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.lines import first_line, lines

_INTEGER = r"^\s*[+-]?[0-9]+$"
_DOUBLE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_integer(field: Column) -> Column:
    """White space may lead but not follow; out of 64 bits is none."""
    return field.rlike(_INTEGER) & F.ltrim(field).try_cast("bigint").isNotNull()


def is_unsigned_integer(field: Column) -> Column:
    """As an integer; a minus is accepted and wraps when the value is taken."""
    return field.rlike(_INTEGER) & F.abs(F.ltrim(field).try_cast("decimal(21,0)")).between(F.lit(0), F.lit(Decimal((1 << 64) - 1)))


def is_double(field: Column) -> Column:
    return field.rlike(_DOUBLE) & F.ltrim(field).try_cast("double").isNotNull()


def as_integer(field: Column) -> Column:
    return F.when(is_integer(field), F.ltrim(field).try_cast("bigint"))


def as_unsigned_integer(field: Column) -> Column:
    value = F.ltrim(field).try_cast("decimal(21,0)")
    return F.when(is_unsigned_integer(field), F.when(value < 0, value + F.lit(Decimal(1 << 64))).otherwise(value))


def as_double(field: Column) -> Column:
    return F.when(is_double(field), F.ltrim(field).try_cast("double"))


def type_letter(field: Column) -> Column:
    """I, D or S: integer, double or string."""
    return F.when(is_integer(field), "I").when(is_double(field), "D").otherwise("S")


def type_string(fields: Column) -> Column:
    return F.array_join(F.transform(fields, type_letter), "")


_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"?', re.S)


def parse_quoted(line: str) -> list[str]:
    """Fields of a line that may have quotes: a backslash keeps the next character, what follows a closing quote
    up to the comma is dropped, a trailing empty field is none."""
    out, at = [], 0
    while at < len(line):
        while at < len(line) and line[at].isspace():
            at += 1
        if at >= len(line):
            break
        if line[at] == '"':
            m = _QUOTED.match(line, at)
            out.append(re.sub(r"\\(.)", r"\1", m[1], flags=re.S))
            at = line.find(",", m.end())
        else:
            end = line.find(",", at)
            out.append(line[at : end if end >= 0 else len(line)])
            at = end
        if at < 0:
            break
        at += 1
    return out


def _quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([parse_quoted(x) for x in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["fields"])


def parse(rows: DataFrame) -> DataFrame:
    """(fields array<string>) of text lines in ``value``; blank lines and lines that begin with # are dropped.

    Lines without quotes stay in SQL expressions; only the others go through Python.
    """
    kept = rows.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    cut = F.transform(F.split("value", ","), lambda x: F.regexp_replace(x, r"^\s+", ""))
    plain = kept.where(~F.col("value").contains('"')).select(cut.alias("fields"))
    plain = plain.select(F.when(F.element_at("fields", -1) == "", F.slice("fields", 1, F.size("fields") - 1)).otherwise(F.col("fields")).alias("fields"))
    quoted = kept.where(F.col("value").contains('"')).select("value").mapInArrow(_quoted, "fields array<string>")
    return plain.union(quoted).where(F.size("fields") > 0)


def read_csv(spark: SparkSession, paths: list[str], header: bool = False, recursive: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """(fields) of all files, and with ``header`` the number of each name; the first line of every file is then skipped.

    A name that occurs twice means its last field.
    """
    names: dict[str, int] = {}
    if header:
        names = {n: i for i, n in enumerate(parse_quoted(first_line(spark, paths, recursive) or ""))}
    return parse(lines(spark, paths, recursive, skip_first=header)), names


def named(rows: DataFrame, names: dict[str, int]) -> DataFrame:
    """Fields as columns; a row without a field has null there."""
    return rows.select(*(F.get("fields", F.lit(i)).alias(n) for n, i in names.items()))
