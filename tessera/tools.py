"""Command line: rowcount, schema, dump and convert for Parquet and comma-separated files.

    python -m tessera.tools rowcount [-r|-v|-j] PATH...
    python -m tessera.tools schema PATH...
    python -m tessera.tools dump [-v|-j] PATH OUT
    python -m tessera.tools convert CSV OUT

rowcount takes the number from the files' footers; -r reads all rows, -v as variants, -j as JSON, and tells the seconds.
dump writes text lines, -v (as without it) with spaces between values and [NA] for null, -j as JSON objects.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.console import Timer, cout0
from tessera.session import local_session
from tessera.sources.csv import as_double, as_integer, read_csv, type_letter
from tessera.sources.records import as_json, as_text, as_variants, file_count, read_parquet, row_count, schema_to_string


def convert(spark, source: str, target: str) -> list[str]:
    """Write a CSV file as Parquet with columns col-N of the narrowest type that all rows allow; returns the types."""
    rows, _ = read_csv(spark, [source])
    width = rows.agg(F.max(F.size("fields"))).first()[0] or 0
    fields = [F.get("fields", F.lit(i)) for i in range(width)]
    worst = rows.agg(*(F.max(F.when(type_letter(f) == "I", 0).when(type_letter(f) == "D", 1).otherwise(2)).alias(f"c{i}") for i, f in enumerate(fields))).first() if width else []
    how = [(as_integer, "bigint"), (as_double, "double"), (lambda f: f, "string")]
    rows.select(*(how[k][0](f).alias(f"col-{i}") for i, (f, k) in enumerate(zip(fields, worst)))).write.mode("overwrite").parquet(target)
    return [how[k][1] for k in worst]


def rows_of(df: DataFrame, mode: str) -> DataFrame:
    """Rows as they are (r), as variants (v) or as JSON text (j)."""
    return {"r": lambda x: x, "v": as_variants, "j": as_json}[mode](df)


def rowcount(spark, paths: list[str], mode: str | None = None) -> tuple[int, float]:
    """(rows, seconds): from the footers, or by reading every value in the given mode."""
    timer = Timer()
    if mode is None:
        return row_count(spark, paths), timer.elapsed()
    read = rows_of(read_parquet(spark, paths), mode)
    size = sum((F.length(F.col(c).cast("string")) if c == "value" and mode == "j" else F.col(c).isNotNull().cast("int") for c in read.columns), F.lit(0))
    n = read.agg(F.count(F.lit(1)), F.sum(size)).first()[0]  # the sum makes the scan read every column
    return n, timer.elapsed()


def dump(spark, source: str, target: str, json: bool = False) -> tuple[int, int]:
    """Write the rows as text lines; (rows, values that could not be converted to text)."""
    rows = read_parquet(spark, [source])
    failed = rows.agg(*(F.count(F.when(F.col(c).isNotNull() & F.col(c).cast("string").isNull(), 1)).alias(f"c{i}") for i, c in enumerate(rows.columns)), F.count(F.lit(1)).alias("n")).first()
    (as_json if json else as_text)(rows).write.mode("overwrite").text(target)
    return failed["n"], sum(failed[:-1])


def main(args: list[str]) -> int:
    flags = [a[1:] for a in args if a in ("-r", "-v", "-j")]
    rest = [a for a in args[1:] if a not in ("-r", "-v", "-j")]
    if not rest or len(flags) > 1 or args[0] not in ("rowcount", "schema", "dump", "convert") or args[0] in ("dump", "convert") and len(rest) != 2:
        cout0(__doc__)
        return 2
    spark = local_session()
    command, mode = args[0], flags[0] if flags else None
    if command == "rowcount":
        n, seconds = rowcount(spark, rest, mode)
        cout0(f"{n} rows in {file_count(spark, rest)} files" + (f", {seconds:.2f} s" if mode else ""))
    elif command == "schema":
        cout0(schema_to_string(spark, rest))
    elif command == "dump":
        n, failed = dump(spark, *rest, json=mode == "j")
        cout0(f"{n} rows, {failed} conversion errors")
    else:
        cout0(" ".join(convert(spark, *rest)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
