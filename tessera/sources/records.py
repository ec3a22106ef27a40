"""Newline-delimited JSON and Parquet, as rows, JSON text or variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.lines import expand, lines


def read_ndjson(spark: SparkSession, paths: list[str], strict: bool = True, recursive: bool = False) -> DataFrame:
    """(value variant) for each line; a line that is malformed or no object raises, or with ``strict`` off is null."""
    return parse_records(lines(spark, paths, recursive), strict)


def parse_records(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Text lines in ``value`` as variants; the same rules as ``read_ndjson``."""
    record = F.try_parse_json("value")
    sound = F.schema_of_variant(record).startswith("OBJECT")
    wrong = F.raise_error(F.concat(F.lit("no JSON object: "), F.col("value"))).cast("variant") if strict else F.lit(None).cast("variant")
    return rows.select(F.when(F.coalesce(sound, F.lit(False)), record).otherwise(wrong).alias("value"))


def json_field(record: Column, name: str, kind: str) -> Column:
    """A field of a record, null where it is absent or null."""
    return F.try_variant_get(record, f"$['{name}']", kind)


def _fields(record: Column) -> Column:
    return record.cast("map<string,variant>")


def _picked(record: Column, keep) -> Column:
    fields = _fields(record)
    left = F.map_filter(fields, keep)
    return F.struct(F.to_variant_object(left).alias("value"), (F.size(fields) - F.size(left)).alias("erased"))


def json_keep(record: Column, keys: list[str]) -> Column:
    """A record (variant object) with the given keys only: a struct of ``value`` and the number ``erased``."""
    return _picked(record, lambda k, _: k.isin(keys))


def json_erase(record: Column, keys: list[str]) -> Column:
    """A record (variant object) without the given keys: a struct of ``value`` and the number ``erased``."""
    return _picked(record, lambda k, _: ~k.isin(keys))


def read_parquet(spark: SparkSession, paths: list[str], columns: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """Rows of all Parquet files; ``columns`` prunes the scan."""
    rows = spark.read.parquet(*_parquet_files(spark, paths, recursive))
    return rows.select(*columns) if columns else rows


def as_json(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object with nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def as_text(df: DataFrame) -> DataFrame:
    """(value): each row's values with spaces between, [NA] for null."""
    return df.select(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("[NA]")) for c in df.columns)).alias("value"))


def as_variants(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(value array<variant>): each row's values in the order of its columns, null as null."""
    own = columns or df.columns
    return df.select(F.array(*(F.when(F.col(c).isNotNull(), F.to_variant_object(F.struct(F.col(c).alias("v"))).cast("map<string,variant>")["v"]) for c in own)).alias("value"))


def null_counts(rows: DataFrame) -> DataFrame:
    """(valid, invalid): of rows of variants how many values there are and how many are null."""
    nulls = F.size(F.filter("value", lambda v: v.isNull())).cast("bigint")
    return rows.agg(F.coalesce(F.sum(F.size("value") - nulls), F.lit(0)).alias("valid"), F.coalesce(F.sum(nulls), F.lit(0)).alias("invalid"))


def file_count(spark: SparkSession, paths: list[str], recursive: bool = False) -> int:
    return len(_parquet_files(spark, paths, recursive))


def _parquet_files(spark: SparkSession, paths: list[str], recursive: bool) -> list[str]:
    return [f for f in expand(spark, paths, recursive) if not f.rpartition("/")[2].startswith(("_", "."))]


def row_count(spark: SparkSession, paths: list[str], recursive: bool = False) -> int:
    """Rows of all files, which Spark takes from the files' footers as no column is read."""
    return read_parquet(spark, paths, recursive=recursive).count()


def schema(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(type, name) of the columns of the first file in sorted order."""
    first = _parquet_files(spark, paths, False)[:1]
    return [(kind, name) for name, kind in spark.read.parquet(*first).dtypes]


def schema_to_string(spark: SparkSession, paths: list[str]) -> str:
    return "\n".join(f"{kind} {name}" for kind, name in schema(spark, paths))
