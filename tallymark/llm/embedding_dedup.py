"""Near-duplicate embeddings by lattice hashing.

In each table random projections take a vector to a few points of eight dimensions, and each
is decoded to the nearest point of the E8 lattice; the lattice points together name a cell. A
vector also goes to a neighbouring cell, with the nearest point of the other coset of D8
for the block that lies closest to the border. Vectors of a cell are compared by cosine in
double precision, block against block, and give a spanning forest of their links. In the
connected components of these, all pairs are compared once more, each once, to count links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, mix

LEAST = 0.9
#: Tables, lattice blocks of a table, scale of the projections, and vectors of a compared block.
TABLES, BLOCKS, SCALE, SIZE = 24, 3, 0.35, 192
SEED = 11


def e8_nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twice the nearest E8 point, twice the nearest of the other coset, and how much farther that is."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = (r.sum(-1) % 2) != 0
        e = y - r
        k = np.abs(e).argmax(-1)
        flip = np.where(np.take_along_axis(e, k[..., None], -1)[..., 0] >= 0, 1.0, -1.0) * odd
        np.put_along_axis(r, k[..., None], np.take_along_axis(r, k[..., None], -1) + flip[..., None], -1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    da, db = ((x - a) ** 2).sum(-1), ((x - b) ** 2).sum(-1)
    first = (da <= db)[..., None]
    near, other = np.where(first, a, b), np.where(first, b, a)
    return (2 * near).astype(np.int64), (2 * other).astype(np.int64), np.abs(da - db)


def cell_names(u: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE) -> np.ndarray:
    """The cells of unit vectors: for each table the own one and a neighbouring one."""
    rng = np.random.default_rng(SEED)
    dims = u.shape[1]
    out = np.empty((len(u), 2 * tables), np.uint64)
    weights = mix(np.arange(1, 8 * blocks + 1, dtype=np.uint64)).reshape(blocks, 8) | np.uint64(1)
    for t in range(tables):
        x = (scale * u @ rng.standard_normal((dims, 8 * blocks))).reshape(len(u), blocks, 8) + rng.random((blocks, 8))
        near, other, far = e8_nearest(x)
        part = (near.astype(np.uint64) * weights).sum(-1, dtype=np.uint64)
        alt = (other.astype(np.uint64) * weights).sum(-1, dtype=np.uint64)
        own = part.sum(1, dtype=np.uint64)
        k = far.argmin(1)
        rows = np.arange(len(u))
        out[:, 2 * t] = mix(own + np.uint64(t << 8))
        out[:, 2 * t + 1] = mix(own - part[rows, k] + alt[rows, k] + np.uint64(t << 8))
    return out


def _units(column: pa.Array) -> list[np.ndarray]:
    vectors = [np.array(x, np.float64) for x in column.to_pylist()]
    return [v / np.linalg.norm(v) for v in vectors]


def _forest(m: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    up = np.arange(len(ids))

    def root(a):
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    out = []
    for a, b in zip(*np.nonzero(m)):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            out.append((int(ids[a]), int(ids[b])))
    return out


def _links(t: pa.Table, least: float):
    ids, own = t.column("rep").to_numpy(), t.column("own").to_numpy()
    u = np.stack([np.frombuffer(x, np.float64) for x in t.column("unit").to_pylist()])
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    m = (u @ u.T) >= least
    np.fill_diagonal(m, False)
    if i != j:
        m &= own[:, None] != own[None, :]
    return ids, m


def _blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """df dealt into pairs of blocks of each key: own, i, j; keys with one row are left out."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    d = df.join(n.hint("merge"), key).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.select(key, "rep", "unit", "copies", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def embedding_dedup(vectors: DataFrame, least: float = LEAST, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector.

    Vectors link at cosine >= least. Null vectors, zero ones and those with null or non-finite
    components link with nothing. Vectors are compared with those of their own length.
    Equal vectors are one class, compared once and counted by their number. vec_ids should be
    distinct; a null vec_id links with nothing. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = v.where(F.coalesce(fine, F.lit(False)))
    classes = scratch.save(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                s = b.slice(k, 1000)
                units = _units(s.column("v"))
                length = np.array([len(x) for x in units])
                names = np.empty((len(units), 2 * tables), np.uint64)
                for n in np.unique(length):
                    some = np.flatnonzero(length == n)
                    names[some] = mix(cell_names(np.stack([units[x] for x in some]), tables, blocks, scale) + np.uint64(n))
                at = np.repeat(np.arange(len(units)), names.shape[1])
                raw = pa.array([x.tobytes() for x in units], pa.binary())
                yield pa.record_batch({"cell": pa.array(names.ravel().view(np.int64)), "rep": s.column("rep").take(pa.array(at)), "copies": s.column("copies").take(pa.array(at)), "unit": raw.take(pa.array(at))})

    cells = classes.select("rep", "copies", "v").mapInArrow(emit, "cell long, rep long, copies long, unit binary")

    def forest(t: pa.Table) -> pa.Table:
        ids, m = _links(t, least)
        e = _forest(np.triu(m, 1), ids)
        return pa.table({"a": pa.array([x[0] for x in e], pa.int64()), "b": pa.array([x[1] for x in e], pa.int64())})

    def count(t: pa.Table) -> pa.Table:
        ids, m = _links(t, least)
        return pa.table({"rep": pa.array(ids), "links": pa.array(m @ t.column("copies").to_numpy())})

    linked = scratch.save(components(scratch, _blocks(cells, "cell", SIZE).groupBy("cell", "i", "j").applyInArrow(forest, "a long, b long")))
    units = classes.join(linked, F.col("rep") == F.col("node")).select("rep", "copies", "component", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"rep": b.column("rep"), "copies": b.column("copies"), "component": b.column("component"), "unit": pa.array([x.tobytes() for x in _units(b.column("v"))], pa.binary())})

    units = units.mapInArrow(pack, "rep long, copies long, component long, unit binary")
    links = _blocks(units, "component", SIZE).groupBy("component", "i", "j").applyInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    per = classes.join(linked, F.col("rep") == F.col("node"), "left").join(links.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"), "left")
    per = per.select("v", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    usable = F.coalesce(fine, F.lit(False))
    out = v.withColumn("key", F.when(usable, F.col("v"))).join(per.withColumnRenamed("v", "key"), "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
