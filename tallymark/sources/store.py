"""Tables that grow by batches, each batch once: staged data, a log of commits, first record wins.

A batch writes its tables into a folder of its own attempt and then one entry into the log. What no entry names is not there,
so a half-written batch changes nothing, and a batch that the log has is not written again. Entries are renamed into place, which is one
step for the file system; a store has one writer at a time, as a streaming query has.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders that the records of a store are dealt into by key.
BUCKETS = 64


class BatchLog:
    """The batches of a folder that Spark's file systems reach, in the order of their commits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def entries(self) -> list[dict]:
        """The committed batches: batch, attempt, schemas by table. A few words for each batch."""
        fs, p = self._at(f"{self.path}/log")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
        text = self.spark.read.text([f"{self.path}/log/{n}" for n in names], wholetext=True).collect() if names else []
        return sorted((json.loads(r.value) for r in text), key=lambda e: e["order"])

    def has(self, batch: str) -> bool:
        return any(e["batch"] == str(batch) for e in self.entries())

    def commit(self, batch: str, tables: dict[str, DataFrame], by: dict[str, str] | None = None, kinds: dict[str, str] | None = None) -> bool:
        """Write the tables of a batch, partitioned by a column where `by` names one, as parquet or the format that `kinds` names;
        False if the log has the batch already."""
        entries, batch = self.entries(), str(batch)
        if any(e["batch"] == batch for e in entries):
            return False
        attempt = uuid.uuid4().hex
        for name, df in tables.items():
            w = df.write.format((kinds or {}).get(name, "parquet"))
            (w.partitionBy(by[name]) if name in (by or {}) else w).save(f"{self.path}/data/{attempt}/{name}")
        entry = {"batch": batch, "order": len(entries), "attempt": attempt, "schemas": {n: df.schema.json() for n, df in tables.items()}, "kinds": kinds or {}}
        fs, made = self._at(f"{self.path}/log/_{attempt}")
        out = fs.create(made)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not fs.rename(made, self._at(f"{self.path}/log/{len(entries):012d}.json")[1]):
            raise RuntimeError(f"another writer has committed to {self.path}")
        return True

    def table(self, name: str, latest: bool = False) -> DataFrame | None:
        """A table over all committed batches, or as the last batch that has it wrote it."""
        found = [e for e in self.entries() if name in e["schemas"]]
        out = None
        for e in found[-1:] if latest else found:
            schema = StructType.fromJson(json.loads(e["schemas"][name]))
            kind = e.get("kinds", {}).get(name, "parquet")
            df = self.spark.read.schema(schema).format(kind).load(f"{self.path}/data/{e['attempt']}/{name}")
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def sweep(self) -> int:
        """Delete the data of attempts that were never committed; how many there were. Only while no batch is being written."""
        fs, p = self._at(f"{self.path}/data")
        known = {e["attempt"] for e in self.entries()}
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in known] if fs.exists(p) else []
        for x in gone:
            fs.delete(x, True)
        return len(gone)


class RecordStore:
    """The first record of each key over batches: of one batch that of least seq, of several batches the earlier one's.

    Null keys are keys. Records lie in folders by the hash of their key; a batch is compared with the folders that it
    has keys in, and of these only the key columns are read.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], seq: str = "seq", buckets: int = BUCKETS):
        self.log, self.keys, self.seq, self.buckets = BatchLog(spark, path), keys, seq, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("_bucket")

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The records of a batch that the store would take, with their folder."""
        first = batch.groupBy(*self.keys).agg(F.min_by(F.struct(*batch.columns), F.struct(self.seq, F.to_json(F.struct(*batch.columns)))).alias("_r")).select("_r.*")
        first = first.select("*", self._bucket())
        store = self.log.table("records")
        if store is None:
            return first
        touched = [r[0] for r in batch.select(self._bucket()).distinct().collect()]  # one number for each folder at most
        known = store.where(F.col("_bucket").isin(touched)).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)], F.col("_bucket").alias("_b"))
        same = F.col("_bucket") == F.col("_b")
        for i, k in enumerate(self.keys):
            same &= F.col(k).eqNullSafe(F.col(f"_{i}"))
        return first.join(known, same, "left_anti")

    def append(self, batch: DataFrame, batch_id: int | str) -> bool:
        """Add a batch; False if it was added before. A body for foreachBatch."""
        if self.log.has(batch_id):
            return False
        return self.log.commit(batch_id, {"records": self.fresh(batch).repartition("_bucket")}, {"records": "_bucket"})

    def read(self) -> DataFrame | None:
        """All records, with their columns as given; None before the first batch."""
        store = self.log.table("records")
        return None if store is None else store.drop("_bucket")
