"""Product codes of vectors: codebooks of integers trained by rounds over all vectors, and a code for each vector.

Vectors become integers, are written once as columnar blocks (a row for each component) and are read again
in every round. A round is one treeAggregate: each block's distances from the entries accumulate
component by component, np.add.at sums and counts the parts of each entry in int64 tensors, and the tensors of the
partitions merge through a tree. What a round moves is a tensor for each partition, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, and the depth of the reduction tree.
BLOCK, DEPTH = 4096, 3


def _whole(block: bytes, dims: int, n: int, width: str) -> np.ndarray:
    """Integers of a block of n vectors, a row for each component."""
    return np.floor(np.frombuffer(block, width).reshape(dims, n).astype(np.float64) * SCALE).astype(np.int64)


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes by part, squared distances summed over parts) of a block; ties go to the lower index."""
    parts, entries, d = book.shape
    codes, error = np.zeros((parts, block.shape[1]), np.int64), np.zeros(block.shape[1], np.int64)
    for p in range(parts):
        far = np.zeros((entries, block.shape[1]), np.int64)
        for j in range(d):
            diff = block[p * d + j][None, :] - book[p, :, j][:, None]
            diff *= diff
            far += diff
        codes[p] = far.argmin(0)
        error += far[codes[p], np.arange(len(error))]
    return codes, error


def _survey(state: dict, row) -> dict:
    """By length: the number of vectors, the largest component, and the first ENTRIES of them by vec_id and then by components."""
    dims, ids = row.dims, row.ids
    x = np.frombuffer(row.block, row.width).reshape(dims, len(ids))
    key = [(i is None, 0 if i is None else i) for i in ids]
    last = heapq.nsmallest(ENTRIES, key)[-1]
    first = ((k, tuple(np.floor(x[:, n].astype(np.float64) * SCALE).tolist())) for n, k in enumerate(key) if k <= last)
    return _merge_surveys(state, {dims: (len(ids), float(np.abs(x).max(initial=0)), heapq.nsmallest(ENTRIES, first))})


def _merge_surveys(a: dict, b: dict) -> dict:
    out = dict(a)
    for dims, (n, most, first) in b.items():
        m = out.get(dims, (0, 0.0, []))
        out[dims] = (n + m[0], max(most, m[1]), heapq.nsmallest(ENTRIES, m[2] + first))
    return out


def _tally(books: dict):
    def add(state: dict, row) -> dict:
        """Sums and counts of the parts that each entry is nearest to."""
        block, book = _whole(row.block, row.dims, row.n, row.width), books[row.dims]
        codes, _ = nearest(block, book)
        sums, counts = state.setdefault(row.dims, (np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)))
        d = book.shape[2]
        for p in range(len(book)):
            np.add.at(sums[p], codes[p], block[p * d : (p + 1) * d].T)
            np.add.at(counts[p], codes[p], 1)
        return state

    return add


def _merge_tallies(a: dict, b: dict) -> dict:
    for dims, (sums, counts) in b.items():
        if dims in a:
            a[dims][0].__iadd__(sums)
            a[dims][1].__iadd__(counts)
        else:
            a[dims] = (sums, counts)
    return a


def blocks(vectors: DataFrame, block: int = BLOCK, parts: int = PARTS) -> DataFrame:
    """(dims, n, width, ids, labels, block) of the vectors without null or non-finite components, by length; dims is rounded up to a multiple of parts with zeros."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    width = "<f4" if kinds["embedding"] == "array<float>" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for at in range(0, t.num_rows, block):
                b = t.slice(at, block)
                lists = b.column("x").combine_chunks() if isinstance(b.column("x"), pa.ChunkedArray) else b.column("x")
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                for length in np.unique(n):
                    of = pa.array(np.flatnonzero(n == length))
                    flat = lists.take(of).flatten().to_numpy(zero_copy_only=False).astype(width).reshape(len(of), length)
                    dims = -(-int(length) // parts) * parts
                    x = np.zeros((dims, len(of)), width)
                    x[:length] = flat.T
                    one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), b.column(c).take(of))
                    yield pa.record_batch([pa.array([dims], pa.int32()), pa.array([len(of)], pa.int32()), pa.array([width]), one("vec_id"), one("label"), pa.array([x.tobytes()], pa.binary())], names=["dims", "n", "width", "ids", "labels", "block"])

    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    kept = vectors.where(sound).select("vec_id", "label", F.col("embedding").cast("array<float>" if width == "<f4" else "array<double>").alias("x"))
    return kept.mapInArrow(run, f"dims int, n int, width string, ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, block binary")


def train(packed: DataFrame, parts: int = PARTS, rounds: int = ROUNDS, depth: int = DEPTH) -> dict[int, np.ndarray]:
    """Codebooks (parts, entries, components of a part) by length from blocks()."""
    rows = packed.select("dims", "n", "width", "block").rdd
    found = packed.select("dims", "width", "ids", "block").rdd.treeAggregate({}, _survey, _merge_surveys, depth)
    for dims, (_, most, _) in found.items():
        if 4 * (most * SCALE + 1) ** 2 * max(dims, 1) >= 2.0**63:
            raise ValueError(f"components up to {most} are too large for 64-bit distances")
    books = {dims: np.array([x for _, x in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy() for dims, (_, _, first) in found.items()}
    for _ in range(rounds):
        for dims, (sums, counts) in rows.treeAggregate({}, _tally(books), _merge_tallies, depth).items():
            used = counts > 0
            books[dims][used] = sums[used] // counts[used][:, None]
    return books


def vector_codes(vectors: DataFrame, parts: int = PARTS, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors (vec_id, label, embedding).

    Vectors that are null or hold null or non-finite components are left out. Each component becomes
    floor(4096 * x). Codebooks begin with the parts of the 16 least vec_ids (null last; rows that repeat a
    vec_id count each, in the order of their components; fewer vectors make fewer entries). A length that the
    parts don't divide is filled up with zeros, and vectors of another length after that have codebooks of their own.
    Components so large that squared distances leave 64 bits raise a ValueError. label_error sums the errors of equal
    labels, nulls together. Further columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    packed = scratch.save(blocks(vectors, block, parts))
    books = train(packed, parts, rounds)
    sha = {dims: hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest() for dims, book in books.items()}
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                dims = b.column("dims")[k].as_py()
                codes, error = nearest(_whole(b.column("block")[k].as_py(), dims, b.column("n")[k].as_py(), b.column("width")[k].as_py()), books[dims])
                digits = np.ascontiguousarray(codes.T.astype(np.uint8))
                text = [r.tobytes().hex() for r in digits]
                yield pa.record_batch([b.column("ids").slice(k, 1).flatten(), b.column("labels").slice(k, 1).flatten(), pa.array(text, pa.string()), pa.array(error), pa.array([sha[dims]] * len(text), pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    coded = scratch.save(packed.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint, codebooks_sha256 string"))
    scratch.drop(packed)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for vector_codes over the table embeddings, whose vectors are of one length. Sums of integers below 2**53 are exact in doubles."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, p.p, arg_min(e, (list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x)) * {entries} + e) AS e,
  min(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x)) AS far FROM p JOIN c{k} c ON p.p = c.p GROUP BY r, p.p)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(u.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS x FROM (
  SELECT p, e, j, floor(sum(v) / count(*)) AS m FROM (SELECT a.p, a.e, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS j FROM a{k} a JOIN p ON a.r = p.r AND a.p = p.p) GROUP BY p, e, j) GROUP BY p, e) u ON c.p = u.p AND c.e = u.e)""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, x, row_number() OVER (ORDER BY vec_id, x) AS r FROM (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)),
p AS MATERIALIZED (SELECT r, q AS p, x[q * len(x) // {parts} + 1 : (q + 1) * len(x) // {parts}] AS x FROM v, range({parts}) t(q)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM p WHERE r <= {entries}),
{", ".join(steps)},
h AS (SELECT sha256(string_agg((y::BIGINT)::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM c{rounds})),
o AS (SELECT r, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o USING (r), h"""
