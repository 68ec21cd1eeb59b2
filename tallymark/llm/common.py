"""Shared pieces: the shared work folder, ranks, connected components, hashing."""

from __future__ import annotations

import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the rolling byte hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BREAKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a pattern of a word, for SQL.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of an Arrow batch between the JVM and a Python worker. Rows alone bound nothing where texts are long.
ARROW_BYTES = 4 << 20
#: Seconds of a written step from which its shuffle files are let go at once.
LONG_STEP = 3


def small_batches(spark: SparkSession, most_bytes: int = ARROW_BYTES) -> None:
    """Bound Arrow batches by bytes for the plans that follow; a smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most_bytes:
        spark.conf.set(key, str(most_bytes))


class Scratch:
    """Written tables in the folder that the cluster names in spark.checkpoint.dir.

    Lost executors cost no more than the step in hand, since each saved table
    is read back from shared storage. Only where the session names no folder and
    runs on this machine alone (tests) a temporary one is made and set.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="tallymark-")
            spark.conf.set("spark.checkpoint.dir", base)
        small_batches(spark)
        self.spark, self.base = spark, f"{base.rstrip('/')}/tallymark-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        began = time.monotonic()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        if time.monotonic() - began > LONG_STEP:
            self.release()
        return out

    def release(self) -> None:
        """Have the shuffle files of finished steps deleted: Spark does it when the driver collects garbage, which may be long after."""
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing later reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column laid end to end, and offsets; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every document, and the number of words by document.

    Words don't cross documents.
    """
    n = len(raw)
    solid = ~_BREAK[raw]
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | head[:n]))
    ends = np.flatnonzero(solid & (~after | head[1:])) + 1
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, ends, counts


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    upper = (raw >= 65) & (raw <= 90)
    return np.where(upper, raw + 32, raw).astype(np.uint8)


_POW = {}


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal wherever the bytes are."""
    n = len(raw)
    if _POW.get("n", -1) < n + 1:
        size = (n // (1 << 19) + 1) << 19
        _POW.update(n=size, up=powers(BASE, size), down=powers(BASE_INV, size))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POW["up"][:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _POW["down"][starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slices(table, most_bytes: int = 4 << 20, column: str = "text"):
    """Pieces of a record batch with a bounded number of bytes of one column (a single longer row stays whole)."""
    _, offsets = text_bytes(table.column(column))
    at, n = 0, table.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield table.slice(at, to - at)
        at = to


def unused(df: DataFrame, name: str) -> str:
    """name, behind as many underscores as it takes to be no column of df in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def rest_of(docs: DataFrame) -> list[str]:
    """The columns of docs besides doc_id and text."""
    return [c for c in docs.columns if c.lower() not in ("doc_id", "text")]


def ranked(scratch: Scratch, df: DataFrame, by: list, name: str = "pos") -> DataFrame:
    """df with a dense 0-based place in the order of `by`, from a range sort.

    Only one number per partition goes through the driver.
    """
    p = scratch.save(df.orderBy(*by).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = sorted((r[0], r[1]) for r in p.groupBy(part.alias("p")).count().collect())
    offsets, total = {}, 0
    for k, n in sizes:
        offsets[k], total = total, total + n
    if not offsets:
        return p.withColumn(name, F.lit(0).cast("long")).drop("_row")
    lookup = F.create_map(*[x for k, v in offsets.items() for x in (F.lit(k), F.lit(v))])
    return p.withColumn(name, (F.col("_row").bitwiseAND((1 << 33) - 1) + lookup[part]).cast("long")).drop("_row")


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the least node.

    Each round every root points to the neighbour, or itself, of least random
    priority; the graph is contracted along the pointers and what remains is
    written. A constant share of the roots goes in each round. Nodes without an
    edge to another node are not returned. Only minima are taken by key, so a
    hub of any degree is combined before it is shuffled.
    """
    e = scratch.save(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct())
    owner = None
    for k in range(200):
        priority = F.struct(F.xxhash64("b", F.lit(k)).alias("h"), F.col("b").alias("v"))
        own = F.struct(F.xxhash64("a", F.lit(k)).alias("h"), F.col("a").alias("v"))
        both = e.union(e.select("b", "a")).toDF("a", "b")
        to = scratch.save(both.groupBy("a").agg(F.min(priority).alias("p")).select(F.col("a").alias("node"), F.least(own, F.col("p"))["v"].alias("root")))
        now = to if owner is None else scratch.save(owner.join(to.withColumnRenamed("root", "up").withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        left = e.join(to.toDF("a", "ra"), "a").join(to.toDF("b", "rb"), "b").where("ra <> rb")
        left = scratch.save(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        scratch.drop(e, *([to] if owner is not None else []), *([owner] if owner is not None else []))
        owner, e = now, left
        if e.isEmpty():
            break
    else:
        raise RuntimeError("components are not finished after 200 rounds")
    low = owner.groupBy("root").agg(F.min("node").alias("component"))
    return owner.join(low, "root").select("node", "component")
