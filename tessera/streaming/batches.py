"""Collections kept up to date from streams: every micro-batch is one phase of keyed requests, then a barrier.

State is a table of (key, value) in a folder that all executors share, one version for each batch. The batch's number
names its version, so a batch that is run again after a failure replaces its own result and is counted once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


class VersionedState:
    """Versions of a table under ``folder``; the newest whole one below a batch is what the batch starts from."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the whole versions, smallest first; a folder without Spark's success file is not whole."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(x[1:]) for x in names if x.startswith("v") and x[1:].isdigit() and self._fs.exists(self._path(f"{self.folder}/{x}/_SUCCESS")))

    def before(self, batch: int) -> DataFrame | None:
        """The state that batch ``batch`` starts from; None if there is none yet."""
        older = [v for v in self.versions() if v < batch]
        return self.spark.read.parquet(f"{self.folder}/v{older[-1]}") if older else None

    def latest(self) -> DataFrame | None:
        versions = self.versions()
        return self.spark.read.parquet(f"{self.folder}/v{versions[-1]}") if versions else None

    def write(self, batch: int, state: DataFrame) -> None:
        """Write version ``batch`` and drop versions older than the one it came from."""
        state.write.mode("overwrite").parquet(f"{self.folder}/v{batch}")
        for v in self.versions():
            if v < batch and any(v < w < batch for w in self.versions()):
                self._fs.delete(self._path(f"{self.folder}/v{v}"), True)


def keep(stream: DataFrame, folder: str, checkpoint: str, step: Callable[[DataFrame | None, DataFrame], DataFrame], **trigger) -> StreamingQuery:
    """Start a query that replaces the state by ``step(state, batch)`` for each micro-batch; state is None at first.

    ``trigger`` goes to the stream's trigger; without it, what is there is read once and the query ends.
    """
    state = VersionedState(stream.sparkSession, folder)

    def phase(batch: DataFrame, number: int) -> None:
        state.write(number, step(state.before(number), batch))

    return stream.writeStream.foreachBatch(phase).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def reduce_by_key(stream: DataFrame, folder: str, checkpoint: str, reducer: Callable, **trigger) -> StreamingQuery:
    """Keep (key, value) reduced over all batches of a stream of (key, value).

    ``reducer`` is an associative aggregate of a column, such as ``F.sum``, ``F.min`` or ``F.max``. Each batch is
    reduced before it meets the state, so the union holds a row for each key of either.
    """

    def step(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        fresh = batch.groupBy("key").agg(reducer("value").alias("value"))
        if state is None:
            return fresh
        return state.unionByName(fresh).groupBy("key").agg(reducer("value").alias("value"))

    return keep(stream, folder, checkpoint, step, **trigger)
