"""Removal of repeated byte strings with a sparse suffix array.

Of each document the suffixes at anchors are sorted: an anchor is the start with the
least hash among the GRAM-byte grams of some window of `length` bytes, leftmost on ties,
so that equal windows have equal anchors and every repeated string contains one. A cell
is an anchor with the windows that chose it, and its context the bytes of those windows.

Sampled splitters range-partition the suffixes by their leading bytes (three raw, the
rest of the gram named by hash); a gram that fills several ranges is dealt among them by
context. Each range is sorted by a multikey sort, one key word at a time among ties. A
cell whose whole context occurs earlier is covered; one whose gram occurs in another
context (or whose gram may go on across a boundary) has its windows compared one by one
in a second exchange: by 64-bit hashes, and where these are equal by their bytes. Whole
contexts are told apart by hashes alone, 64 bits of the context and 40 of the gram in it.

Rows are ordered, marked and cut by doc_id. Only where one is repeated or null they are first sorted by doc_id
and a hash of the text, and get a number for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, slices, span_hashes, text_bytes
from .similar import pack_buckets

LENGTH, GRAM = 100, 32
#: Documents in the sample for the splitters (its bound at every size), and contexts of a gram from which its windows are dealt one by one.
SAMPLE_DOCS, HOT = 2000, 2048
BATCH_BYTES = 3 << 20


def gram_names(raw: np.ndarray, x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The names of the grams at x with the hashes h: three raw bytes and the rest hashed, in the order of the suffixes' leading bytes."""
    lead = (raw[x].astype(np.uint64) << np.uint64(56)) | (raw[x + 1].astype(np.uint64) << np.uint64(48)) | (raw[x + 2].astype(np.uint64) << np.uint64(40))
    return lead | (h >> np.uint64(24))


def cells(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """doc, anchor, first and last window start (in the laid-out bytes) of every cell, with gram and context names."""
    span = length - gram + 1
    n = len(raw)
    p = np.arange(n)
    sizes = np.diff(offsets)
    doc_end = np.repeat(offsets[1:], sizes)
    window = p + length <= doc_end
    if not window.any():
        e = np.zeros(0, np.int64)
        return {"doc": e, "anchor": e, "first": e, "last": e, "g": e.view(np.uint64), "c": e.view(np.uint64)}
    last_gram = max(n - gram + 1, 0)
    h = np.full(n, ~np.uint64(0), np.uint64)
    h[:last_gram] = mix(span_hashes(raw, p[:last_gram], p[:last_gram] + gram))
    at, step = p.astype(np.int32), 1
    m = h
    while step * 2 <= span:
        right = np.full(n, ~np.uint64(0), np.uint64)
        right[: n - step] = m[step:]
        move = right < m
        shifted = np.zeros(n, np.int32)
        shifted[: n - step] = at[step:]
        m, at = np.where(move, right, m), np.where(move, shifted, at)
        step *= 2
    w = np.flatnonzero(window)
    other = w + span - step
    a = np.where(m[other] < m[w], at[other], at[w]).astype(np.int64)
    doc = np.searchsorted(offsets, w, side="right") - 1
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(w)]]) - 1
    out = {"doc": doc[first], "anchor": a[first], "first": w[first], "last": w[last]}
    x = out["anchor"]
    out["g"] = gram_names(raw, x, h[x])
    out["c"] = mix(span_hashes(raw, out["first"], out["last"] + length) + (x - out["first"]).astype(np.uint64))
    return out


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by several key words: ties of one word alone are sorted by the next."""
    order = np.argsort(keys[0], kind="stable")
    tie = np.zeros(len(order), np.int64)
    for before, key in zip(keys, keys[1:]):
        k = before[order]
        tie = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]) | (np.diff(tie) != 0)])) if len(order) else tie
        counts = np.bincount(tie) if len(order) else np.zeros(0, int)
        open_ = np.flatnonzero(counts[tie] > 1)
        if not len(open_):
            break
        sub = order[open_]
        order[open_] = sub[np.lexsort((key[sub], tie[open_]))]
    return order


def _bucket(g: np.ndarray, c: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    low, high = np.searchsorted(splitters, g, side="left"), np.searchsorted(splitters, g, side="right")
    return low + (c % (high - low + 1).astype(np.uint64)).astype(np.int64)


def _by_doc(doc: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(doc, kind="stable")
    d, rows = doc[order], rows[order]
    head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    cuts = np.concatenate([head, [len(d)]])
    return pa.record_batch({"row": pa.array(d[head]), "packed": pa.array([rows[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(head))], pa.binary())})


def _marks(row: np.ndarray, m: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Marks of four numbers packed with their row by bucket of rows, so that a range gives a row for each bucket, not for each document."""
    return pack_buckets(mix(row.view(np.uint64)), np.stack([row, m[:, 0] << 32 | m[:, 1], m[:, 2] << 32 | m[:, 3]], 1), buckets)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All marks of each document of one bucket."""
    raw = [x for b in batches for x in b.column("packed").to_pylist()]
    x = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 3)
    del raw
    if len(x):
        low = (1 << 32) - 1
        whole = _by_doc(x[:, 0], np.stack([x[:, 1] >> 32, x[:, 1] & low, x[:, 2] >> 32, x[:, 2] & low], 1).astype(np.int32))
        for k in range(0, whole.num_rows, 20_000):
            yield whole.slice(k, 20_000)


def _deal(batches: Iterator[pa.RecordBatch], length: int, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, BATCH_BYTES):
            raw, off = text_bytes(b.column("text"))
            k = cells(raw, off, length)
            ids = b.column("row").to_numpy(zero_copy_only=False)
            place = k["first"] - off[k["doc"]]
            shape = (k["anchor"] - k["first"] << 16) | (k["last"] - k["first"])
            rows = np.stack([k["g"].view(np.int64), k["c"].view(np.int64), ids[k["doc"]], place << 32 | shape], 1) if len(place) else np.zeros((0, 4), np.int64)
            yield pack_buckets(_bucket(k["g"], k["c"], splitters).astype(np.uint64), rows, len(splitters) + 1)


def _sort_range(batches: Iterator[pa.RecordBatch], length: int, splitters: np.ndarray, most: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each document the cells that matter: (first, anchor - first, last - first, kind): 2 covered, 1 to compare, 3 to compare window by window.

    Cells of a gram dealt over several ranges have kind 4, to compare in one of both ways:
    the number of its contexts in this range comes under no bucket, packed as (gram, contexts).
    """
    raw = [x for b in batches for x in b.column("packed").to_pylist()]
    rows = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 4)
    del raw
    g, c, doc, place = rows[:, 0].view(np.uint64), rows[:, 1].view(np.uint64), rows[:, 2], rows[:, 3]
    order = multikey_order(g, c, doc, place)
    g, c, doc, place = g[order], c[order], doc[order], place[order]
    if not len(g):
        return
    new_g = np.concatenate([[True], g[1:] != g[:-1]])
    first = new_g | np.concatenate([[True], c[1:] != c[:-1]])
    run = np.cumsum(new_g) - 1
    contexts = np.bincount(run, weights=first).astype(np.int64)[run]
    split = np.searchsorted(splitters, g, side="right") > np.searchsorted(splitters, g, side="left")
    kind = np.where(~first, 2, np.where(split, 4, np.where(contexts > most, 3, np.where(contexts > 1, 1, 0))))
    some = np.flatnonzero(new_g & split)
    if len(some):
        counts = np.stack([g[some].view(np.int64), contexts[some]], 1)
        yield pa.record_batch({"bucket": pa.array([None], pa.int32()), "packed": pa.array([counts.tobytes()], pa.binary())})
    keep = np.flatnonzero(kind)
    if len(keep):
        yield _marks(doc[keep], np.stack([place[keep] >> 32, (place[keep] >> 16) & 0xFFFF, place[keep] & 0xFFFF, kind[keep]], 1), buckets)


def _contexts(batches: Iterator[pa.RecordBatch], length: int, buckets: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The contexts of cells to compare, packed by gram (or by window): (gram, doc, first, windows) and the bytes.

    Of the grams dealt over several ranges the frequent ones are packed by window.
    """
    for whole in batches:
        for b in slices(whole, BATCH_BYTES):
            raw, off = text_bytes(b.column("text"))
            marks = [np.frombuffer(x, np.int32).reshape(-1, 4) for x in b.column("packed").to_pylist()]
            n = np.array([len(x) for x in marks])
            m = np.concatenate(marks).astype(np.int64) if len(marks) else np.zeros((0, 4), np.int64)
            doc = np.repeat(np.arange(len(marks)), n)
            some = m[:, 3] != 2
            m, doc = m[some], doc[some]
            first, lead, more = m[:, 0] + off[doc], m[:, 1], m[:, 2]
            key = span_hashes(raw, first + lead, first + lead + GRAM)
            single = (m[:, 3] == 3) | ((m[:, 3] == 4) & np.isin(gram_names(raw, first + lead, mix(key)), frequent))
            hot = np.flatnonzero(single)
            if len(hot):
                w = more[hot] + 1
                each = np.repeat(hot, w)
                start = first[each] + (np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w))
                cold = ~single
                key = np.concatenate([key[cold], span_hashes(raw, start, start + length)])
                doc = np.concatenate([doc[cold], doc[each]])
                first, more = np.concatenate([first[cold], start]), np.concatenate([more[cold], np.zeros(len(start), np.int64)])
            ids = b.column("row").to_numpy(zero_copy_only=False)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            filled, heads, texts = [], [], []
            for i in range(buckets):
                o = order[cuts[i] : cuts[i + 1]]
                if len(o):
                    filled.append(i)
                    heads.append(np.stack([key[o].view(np.int64), ids[doc[o]], first[o] - off[doc[o]], more[o] + 1], 1).tobytes())
                    size = more[o] + length
                    at = np.repeat(first[o] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    texts.append(raw[at].tobytes())
            yield pa.record_batch({"bucket": pa.array(filled, pa.int32()), "head": pa.array(heads, pa.binary()), "bytes": pa.array(texts, pa.binary())})


def _told_apart(name: np.ndarray, raw: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Names of windows of which equal ones have equal bytes: where the bytes differ all windows of the name are named by their bytes."""
    order = np.argsort(name, kind="stable")
    same = np.flatnonzero(name[order[1:]] == name[order[:-1]])
    clash = set()
    for k in range(0, len(same), 20_000):
        i, j = order[same[k : k + 20_000]], order[same[k : k + 20_000] + 1]
        window = np.arange(length)
        clash.update(name[i[(raw[start[i][:, None] + window] != raw[start[j][:, None] + window]).any(1)]].tolist())
    if clash:
        at = np.flatnonzero(np.isin(name, np.array(sorted(clash), np.uint64)))
        free = np.setdiff1d(np.arange(len(name) + len(at) + 1, dtype=np.uint64), name)
        texts = [raw[start[i] : start[i] + length].tobytes() for i in at]
        number = {t: n for t, n in zip(sorted(set(texts)), free)}
        name = name.copy()
        name[at] = [number[t] for t in texts]
    return name


def _compare(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows that start earlier too, as (doc, first byte, last byte + 1), kind 0."""
    heads, texts = [], []
    for b in batches:
        heads += b.column("head").to_pylist()
        texts += b.column("bytes").to_pylist()
    h = np.frombuffer(b"".join(heads), np.int64).reshape(-1, 4)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    del texts
    if not len(h):
        return
    n = h[:, 3]
    size = n + length - 1
    base = np.cumsum(size) - size
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    cell = np.repeat(np.arange(len(h)), n)
    # Hashed in pieces: the sums behind the hashes take many times the bytes.
    name, upto = np.empty(len(cell), np.uint64), np.cumsum(n)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(base // BATCH_BYTES)) + 1, [len(h)]])
    for i, j in zip(cuts[:-1], cuts[1:]):
        w = slice(upto[i] - n[i], upto[j - 1])
        start = base[cell[w]] - base[i] + inner[w]
        name[w] = span_hashes(raw[base[i] : base[j - 1] + size[j - 1]], start, start + length)
    doc, place = h[cell, 1], h[cell, 2] + inner
    name = _told_apart(name, raw, base[cell] + inner, length)
    order = multikey_order(name, doc, place)
    again = order[1:][name[order[1:]] == name[order[:-1]]]
    doc, place = doc[again], place[again]
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    if len(doc):
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)]))
        end = place[np.concatenate([new[1:], [len(doc)]]) - 1] + length
        yield _marks(doc[new], np.stack([place[new], np.zeros(len(new), np.int64), end - place[new], np.zeros(len(new), np.int64)], 1), buckets)


def _cut(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        kept_texts = []
        for t, marks in zip(b.column("text"), b.column("packed").to_pylist()):
            raw = np.frombuffer((t.as_py() or "").encode(), np.uint8)
            m = np.frombuffer(marks or b"", np.int32).reshape(-1, 4).astype(np.int64)
            m = m[(m[:, 3] == 2) | (m[:, 3] == 0)]
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, m[:, 0], 1)
            np.add.at(edge, np.where(m[:, 3] == 2, m[:, 0] + m[:, 2] + length, m[:, 0] + m[:, 2]), -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = raw[~gone].tobytes()
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if texts:
                kept_texts.append(kept.decode("utf-8", "ignore"))
        cols = {"doc_id": b.column("doc_id")} | {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}
        yield pa.record_batch(cols | ({"kept_text": pa.array(kept_texts, pa.string())} if texts else {}))


def substring_dedup(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each document, and kept_text if asked.

    Texts are UTF-8 bytes, null counting as empty. Each byte goes that lies in a string of
    `length` bytes that also starts earlier: in a document of smaller doc_id, or before in
    the same one. Strings are judged on the input. kept_text leaves out bytes of characters
    that were cut in two. A null doc_id sorts before all others. Rows of one doc_id, or of none,
    are documents of their own in the order of a hash of their texts, equal ones in any order,
    so that of each string one copy stays. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Read again where it lies: a copy of the texts would take the input's size on disk.
    plain = d.withColumn("row", F.col("doc_id"))
    if plain.where("row is null").isEmpty() and plain.groupBy("row").count().where("count > 1").isEmpty():
        d = plain
    else:
        # The last key deals equal rows over several ranges.
        d = plain.drop("row").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id())
        d = scratch.save(d.withColumn("row", F.monotonically_increasing_id()))
    hot, parts = HOT, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # A sample of a fixed number of documents, whatever the size of the table: those of least hash.
    some = d.join(F.broadcast(d.select("row").orderBy(F.xxhash64("row"), "row").limit(SAMPLE_DOCS)), "row")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, BATCH_BYTES):
                g = cells(*text_bytes(b.column("text")), length)["g"]
                yield pa.record_batch({"g": pa.array(g[mix(np.arange(len(g), dtype=np.uint64)) % np.uint64(8) == 0].view(np.int64))})

    seen = np.sort(np.array([r[0] for r in some.mapInArrow(sample, "g long").collect()], np.int64).view(np.uint64))
    splitters = seen[(np.arange(1, parts) * len(seen)) // parts] if len(seen) else np.zeros(0, np.uint64)
    dealt = d.mapInArrow(lambda it: _deal(it, length, splitters), "bucket int, packed binary")
    shape = "bucket int, packed binary"
    marks = scratch.save(dealt.repartition(parts, "bucket").mapInArrow(lambda it: _sort_range(it, length, splitters, hot, parts), shape))
    counts = np.frombuffer(b"".join(x[0] for x in marks.where("bucket is null").select("packed").collect()), np.int64).reshape(-1, 2)
    grams, of = np.unique(counts[:, 0].view(np.uint64), return_inverse=True)
    frequent = grams[np.bincount(of, weights=counts[:, 1], minlength=len(grams)) > hot]
    marks = marks.where("bucket is not null")
    # Marks are hashed, a task's share of them at a time, so that no join sorts the texts.
    by_row = lambda m: m.repartition(parts, "bucket").mapInArrow(_merged, "row long, packed binary").hint("shuffle_hash")
    dealt = d.join(by_row(marks), "row").mapInArrow(lambda it: _contexts(it, length, parts, frequent), "bucket int, head binary, bytes binary")
    found = scratch.save(dealt.repartition(parts, "bucket").mapInArrow(lambda it: _compare(it, length, parts), shape))
    out = d.join(by_row(marks.union(found)), "row", "left")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts
    return out.mapInArrow(lambda it: _cut(it, length, texts), kinds)
