"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
TASK_ROWS = 1_000_000
TASK_BYTES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 32 << 20,
    "spark.sql.files.maxPartitionBytes": 32 << 20,
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on a single machine a temporary one where that is unset.

    A cluster must name it: a folder of the driver's own would be another disk on every executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir is unset: set it to a folder that all executors of {master} share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="tessera-"))
    spark.sparkContext.setCheckpointDir(_LOCAL_ROOT[0])
    return f"file://{_LOCAL_ROOT[0]}"


@contextmanager
def small_tasks(spark: SparkSession, rows: int):
    """While it holds, tasks take about ``TASK_ROWS`` rows and ``TASK_BYTES`` of compressed data, of hot keys too, or the session's less.

    A row of two numbers is a few bytes of a shuffle or table and some 60 of a sort or hash map, so that Spark's own
    sizes let one task grow to gigabytes.
    """
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {k: spark.conf.get(k) for k in (*TASK_BYTES, "spark.sql.shuffle.partitions")}
    for key, most in TASK_BYTES.items():
        spark.conf.set(key, f"{min(size(before[key]), most)}b")
    spark.conf.set("spark.sql.shuffle.partitions", max(int(before["spark.sql.shuffle.partitions"]), -(-rows // TASK_ROWS)))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive any executor.

    ``drop`` removes a table that nothing reads any more; the rest goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write ``df`` and return the written table; its path is in ``table_path``.

        Where ``rows`` says about how many rows its plan deals out, tasks are kept small meanwhile.
        """
        path = self.path(name)
        with nullcontext() if rows is None else small_tasks(self.spark, rows):
            df.write.option("compression", "lz4").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.table_path = path
        return out

    def drop(self, table: DataFrame | str) -> None:
        path = table if isinstance(table, str) else table.table_path
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None and not os.environ.get("TESSERA_KEEP_SCRATCH"):
            try:
                self.drop(self.root)
            except Exception:  # the JVM may have ended first
                pass
