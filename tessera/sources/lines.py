"""Lines of text files, with the first line of each file optionally skipped."""

from __future__ import annotations

import os
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def expand(spark: SparkSession, paths: list[str], recursive: bool = False) -> list[str]:
    """Files of files and folders, sorted, each once; what does not exist is left out, what cannot be read too, with a
    warning. Any Hadoop file system.

    ``local://`` names this machine's own files; on a cluster, whose executors do not share them, it is an error.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: set[str] = set()
    for path in paths:
        if path.startswith("local://"):
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError(f"{path}: executors of a cluster do not share local files")
            path = "file://" + os.path.abspath(path.removeprefix("local://"))
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(conf)
        if not fs.exists(where):
            continue
        try:
            if fs.getFileStatus(where).isFile():
                fs.access(where, jvm.org.apache.hadoop.fs.permission.FsAction.READ)
                found.add(fs.makeQualified(where).toString())
                continue
            files = fs.listFiles(where, recursive)
            while files.hasNext():
                found.add(files.next().getPath().toString())
        except Py4JJavaError as error:
            warnings.warn(f"{path} cannot be read and is left out: {error.java_exception.getMessage()}", stacklevel=2)
    return sorted(found)


def lines(spark: SparkSession, paths: list[str], recursive: bool = False, skip_first: bool = False) -> DataFrame:
    """(value) for each line; only line feeds end lines, so a carriage return stays.

    With ``skip_first`` the first line of every file goes. Files are split between tasks; the line that starts a
    file is the first row of its first block, found by one small row for each file.
    """
    files = expand(spark, paths, recursive)
    if not files:
        return spark.createDataFrame([], "value string")
    rows = spark.read.option("lineSep", "\n").text(files)
    if not skip_first:
        return rows
    placed = rows.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_id"))
    head = placed.where("file_block_start = 0").groupBy(F.col("file_path").alias("_p")).agg(F.min("_id").alias("_first"))
    return placed.join(head, (F.col("file_path") == F.col("_p")) & (F.col("_id") == F.col("_first")), "left_anti").select("value")


def first_line(spark: SparkSession, paths: list[str], recursive: bool = False) -> str | None:
    """The first line of the first file in sorted order."""
    files = expand(spark, paths, recursive)
    row = spark.read.option("lineSep", "\n").text(files[0]).first() if files else None
    return row[0] if row else None
