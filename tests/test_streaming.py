"""State kept from micro-batches: equal to one reduction of all rows, and unchanged when a batch runs again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.streaming.batches import VersionedState, keep, reduce_by_key


def _files(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "key string, value long").coalesce(1).write.mode("append").parquet(f"{folder}/p{i}")
    return spark.readStream.schema("key string, value long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_reduce_by_key_equals_one_reduction(spark, tmp_path):
    parts = [[("a", 1), ("b", 2), ("a", 3)], [("a", 10), (None, 5)], [("c", None), (None, 6), ("b", -2)]]
    stream = _files(spark, f"{tmp_path}/in", parts)
    reduce_by_key(stream, f"{tmp_path}/state", f"{tmp_path}/check", F.sum).awaitTermination(120)
    state = VersionedState(spark, f"{tmp_path}/state")
    assert {tuple(r) for r in state.latest().collect()} == {("a", 14), ("b", 0), ("c", None), (None, 11)}
    assert len(state.versions()) == 2


def test_a_repeated_batch_counts_once(spark, tmp_path):
    state = VersionedState(spark, f"{tmp_path}/state")
    one = spark.createDataFrame([("a", 1)], "key string, value long")
    assert state.latest() is None and state.versions() == []
    state.write(0, one)
    for _ in range(2):
        state.write(1, state.before(1).unionByName(one).groupBy("key").agg(F.sum("value").alias("value")))
    assert [tuple(r) for r in state.latest().collect()] == [("a", 2)]


def test_last_write_wins(spark, tmp_path):
    stream = _files(spark, f"{tmp_path}/in", [[("a", 1), ("b", 2)], [("a", 7)]])

    def assign(state, batch):
        return batch if state is None else state.join(batch, "key", "left_anti").unionByName(batch)

    keep(stream, f"{tmp_path}/state", f"{tmp_path}/check", assign).awaitTermination(120)
    got = {tuple(r) for r in VersionedState(spark, f"{tmp_path}/state").latest().collect()}
    assert {k for k, _ in got} == {"a", "b"} and len(got) == 2
