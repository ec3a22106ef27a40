"""Text output to many files named by a path column, also by day, on any file system that Spark writes to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_path(ts: Column) -> Column:
    """Year/month/day of a timestamp without padding."""
    return F.date_format(ts, "y/M/d")


def day_path_of_seconds(seconds: Column) -> Column:
    """The same of seconds since 1970 in UTC."""
    return day_path(F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")))


def write_lines(df: DataFrame, prefix: str, path: str = "path", line: str = "line", append: bool = False) -> int:
    """Write each row's ``line`` to the file ``prefix``/``path`` and return the number of files.

    Null lines and paths are skipped. Spark's text writer and its committer write one file for each path below a
    folder of this call's own, so a repeated task leaves nothing twice; then each finished file is renamed to its
    place. With ``append`` the lines that a file has come first in the new file, which replaces the old at once.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    root = hadoop.Path(prefix)
    fs = root.getFileSystem(conf)
    if fs.exists(root) and fs.getFileStatus(root).isFile():
        raise FileExistsError(prefix)
    fs.mkdirs(root)
    stage = hadoop.Path(root, f".attempt-{uuid.uuid4().hex}")
    rows = df.select(F.col(path).cast("string").alias("path"), F.col(line).cast("string").alias("value")).where("path is not null and value is not null")
    order = []
    if append:
        rows = rows.withColumn("_age", F.lit(1)).withColumn("_at", F.lit(0).cast("bigint"))
        there = [r["path"] for r in rows.select("path").distinct().collect() if fs.exists(hadoop.Path(root, r["path"]))]  # a row for each file
        for own in there:
            old = spark.read.option("lineSep", "\n").text(hadoop.Path(root, own).toString())
            rows = rows.unionByName(old.select(F.lit(own).alias("path"), "value", F.lit(0).alias("_age"), F.monotonically_increasing_id().alias("_at")))
        order = ["_age", "_at"]
    ready = rows.withColumn("_file", F.col("path")).repartition("path").sortWithinPartitions("_file", *order)
    ready.select("value", "_file").write.partitionBy("_file").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(stage.toString())
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    n = 0
    for folder in fs.listStatus(stage):
        name = folder.getPath().getName()
        if not name.startswith("_file="):
            continue
        parts = [x.getPath() for x in fs.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-")]
        target = hadoop.Path(root, unescape(name.removeprefix("_file=")))
        fs.mkdirs(target.getParent())
        if fs.exists(target):
            fs.delete(target, False)
        if len(parts) != 1 or not fs.rename(parts[0], target):
            raise OSError(f"{target} cannot be put in place")
        if fs.getScheme() == "file":  # a local file system keeps checksums in files beside
            fs.getRawFileSystem().delete(fs.getChecksumFile(target), False)
        n += 1
    fs.delete(stage, True)
    return n


def write_daily(df: DataFrame, prefix: str, seconds: str = "seconds", line: str = "line", append: bool = False) -> int:
    """Write each row's ``line`` to the file ``prefix``/year/month/day of its ``seconds`` since 1970 in UTC, without padding."""
    dated = df.select(day_path_of_seconds(F.col(seconds)).alias("path"), F.col(line).alias("line"))
    return write_lines(dated, prefix, append=append)
