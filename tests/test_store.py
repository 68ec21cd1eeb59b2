"""Batches that are written once: replays, half-written batches, nulls, buckets."""

import pytest
from pyspark.sql import functions as F

from tallymark.sources.store import BatchLog, RecordStore

SCHEMA = "k string, seq long, v string"


@pytest.fixture
def store(spark, tmp_path):
    return RecordStore(spark, f"file://{tmp_path}/s", ["k"], buckets=8)


def rows(store):
    return sorted((tuple(r) for r in store.read().collect()), key=repr)


def test_first_wins_over_batches(spark, store):
    assert store.read() is None and store.log.table("records") is None
    batch = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert store.append(batch(("a", 2, "late"), ("a", 1, "first"), (None, 5, "n"), ("b", 1, "x"), ("b", 1, "w")), 0)
    assert store.append(batch(("a", 0, "no"), (None, 0, "no"), ("c", 9, "c"), ("c", None, "none")), "1")
    want = sorted([("a", 1, "first"), (None, 5, "n"), ("b", 1, "w"), ("c", None, "none")], key=repr)
    assert rows(store) == want
    # The same batch again, with other rows even, changes nothing.
    assert not store.append(batch(("z", 0, "no")), 1) and rows(store) == want
    assert store.append(spark.createDataFrame([], SCHEMA), 2) and rows(store) == want


def test_half_written_batches_change_nothing(spark, store, monkeypatch):
    store.append(spark.createDataFrame([("a", 1, "a")], SCHEMA), 0)
    bad = spark.createDataFrame([("b", 1, "b"), ("c", 1, "c")], SCHEMA).withColumn("v", F.when(F.col("k") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        store.append(bad, 1)
    assert rows(store) == [("a", 1, "a")] and not store.log.has(1)
    # All data written, but not the entry.
    good = spark.createDataFrame([("b", 1, "b")], SCHEMA)
    monkeypatch.setattr(BatchLog, "_at", lambda self, path, at=BatchLog._at: (_ for _ in ()).throw(OSError("cut off")) if "/log/_" in path else at(self, path))
    with pytest.raises(OSError):
        store.append(good, 1)
    monkeypatch.undo()
    assert rows(store) == [("a", 1, "a")]
    assert store.append(good, 1) and rows(store) == [("a", 1, "a"), ("b", 1, "b")]
    assert store.log.sweep() >= 1 and rows(store) == [("a", 1, "a"), ("b", 1, "b")]


def test_only_touched_buckets_are_read(spark, store):
    store.append(spark.range(500).select(F.col("id").cast("string").alias("k"), F.col("id").alias("seq"), F.lit("v").alias("v")), 0)
    plan = store.fresh(spark.createDataFrame([("7", 0, "x")], SCHEMA))._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("\n") if "FileScan parquet" in x and "_bucket" in x)
    assert "PartitionFilters: [" in scan and "_bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "v#" not in scan.split("FileScan parquet")[1].split("]")[0]


def test_columns_may_be_added(spark, store):
    store.append(spark.createDataFrame([("a", 1, "a")], SCHEMA), 0)
    store.append(spark.createDataFrame([("b", 1, "b", 3)], SCHEMA + ", more int"), 1)
    assert {(r.k, r.more) for r in store.read().collect()} == {("a", None), ("b", 3)}


def test_stream_into_the_store(spark, store, tmp_path):
    src = f"{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame([(str(i % 5), k * 10 + i, f"{k}") for i in range(4 + k)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):  # the second run finds nothing to do
        q = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(lambda df, i: store.append(df, i) and None).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.k for r in store.read().collect()) == ["0", "1", "2", "3", "4"]
