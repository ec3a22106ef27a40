"""Output with the place it comes from, elapsed time, and figures of the jobs that a block of work ran."""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cout0(*values: object) -> None:
    """Values on the driver's standard output, once."""
    print(*values, flush=True)


def cerr0(*values: object) -> None:
    print(*values, file=sys.stderr, flush=True)


def _echo(batches: Iterator[pa.RecordBatch], errors: bool) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for line in batch.column(0).to_pylist():
            print(f"{part}: {line}", file=sys.stderr if errors else sys.stdout, flush=True)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def cout(df: DataFrame, value: str = "value", errors: bool = False) -> int:
    """Each row on the standard output (or error) of the executor that has it, after its partition's number; how many."""
    lines = df.select(F.col(value).cast("string").alias("value"))
    return lines.mapInArrow(partial(_echo, errors=errors), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def welcome(spark: SparkSession) -> str:
    """One line on the session: version, master, default parallelism."""
    context = spark.sparkContext
    return f"Spark {spark.version} at {context.master}, parallelism {context.defaultParallelism}"


class Timer:
    """Seconds since it was made or reset."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.began = time.perf_counter()

    def elapsed(self) -> float:
        return time.perf_counter() - self.began


class Stats:
    """Jobs, stages, tasks and failed tasks of what runs inside a ``with`` block, and its seconds."""

    def __init__(self, spark: SparkSession):
        self.spark, self.timer = spark, Timer()
        self.reset()

    def reset(self) -> None:
        self.jobs = self.stages = self.tasks = self.failed = 0
        self.seconds = 0.0

    def __enter__(self) -> Stats:
        self.group = f"stats-{uuid.uuid4().hex}"
        self.spark.sparkContext.setJobGroup(self.group, "stats")
        self.timer.reset()
        return self

    def __exit__(self, *_: object) -> None:
        self.seconds += self.timer.elapsed()
        context = self.spark.sparkContext
        context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        tracker = context.statusTracker()
        for job in tracker.getJobIdsForGroup(self.group):
            self.jobs += 1
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else []:
                if own := tracker.getStageInfo(stage):
                    self.stages += 1
                    self.tasks += own.numCompletedTasks
                    self.failed += own.numFailedTasks
        context.setLocalProperty("spark.jobGroup.id", None)

    def report(self) -> str:
        return f"{self.jobs} jobs, {self.stages} stages, {self.tasks} tasks, {self.failed} failed, {self.seconds:.2f} s"
