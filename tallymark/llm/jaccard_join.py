"""Jaccard self-join of documents on word n-grams by PartEnum signatures.

Sets that are equal form one class, and only the least document of a class goes on.
Sizes are dealt into bands. In the family of a band (its sets and those of the band
below that are near enough) two similar sets differ in at most k elements. The domain
of elements is cut by hash into parts and each part into second-level parts. SPARE + 1
parts at least hold no more than k2 of the differences each; there, all but k2 of the
second-level parts agree. A set has one signature for each part and each subset of its
second-level parts with k2 left out: a hash of the elements there. Subsets without an
element give no signature; a set with more than SPARE parts where that happens takes part
once more under another cut, and with the last cut they count even if empty. If two
similar sets agree on empty subsets alone, both have more than SPARE such parts and meet
again, so no link is lost.

Sets that share a signature are compared by way of the group's least member and its other
members (see similar.py). All of this is exact but for 64-bit hashes of n-grams and 128-bit
hashes of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, mix, powers, slices, span_hashes, text_bytes, unused, word_spans
from .similar import SETS, leader_pairs, linked_components, pack_buckets, set_columns

NGRAM, PERCENT = 4, 85
#: Cuts of the domain.
CUTS = 3
#: Up to so many differences the cut is finer.
FINE = 40
BATCH_BYTES = 4 << 20


def bands(percent: int, most: int) -> list[tuple[int, int]]:
    """Bands of sizes: (least, greatest); the greatest is the least over the square of the threshold."""
    out, low = [], 1
    while low <= most:
        high = max(low, low * 10000 // (percent * percent))
        out.append((low, high))
        low = high + 1
    return out


def family_shape(high: int, percent: int) -> tuple[int, int, int, int]:
    """(parts, spare, second-level parts, left out) of the family whose greatest size is high.

    No parts if only equal sets are similar. Small sets, of which a common line is a
    large share, get subsets of more elements each.
    """
    k = 2 * (100 - percent) * high // (100 + percent)
    second, out = (5, 2) if k <= FINE else (3, 1)
    spare = 1 + k // 40
    return (k // (out + 1) + 1 + spare if k else 0), spare, second, out


def shingle_sets(column: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-grams of each text end to end, and offsets.

    Upper-case A-Z count as lower case. A text with fewer words than n has its whole
    sequence as its one element; one without words has none.
    """
    raw, offsets = text_bytes(column)
    raw = lower_ascii(raw)
    starts, ends, counts = word_spans(raw, offsets)
    h = span_hashes(raw, starts, ends)
    first = np.concatenate([[0], np.cumsum(counts)])
    docs = len(counts)
    doc = np.repeat(np.arange(docs), counts)
    w = powers(0xA0761D6478BD642F, n + 1)
    grams = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for i in range(n):
        grams += h[i : i + len(grams)] * w[n - i]
    whole = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    g, owner = mix(grams[whole]), doc[whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    extra = np.array([int(mix((h[first[d] : first[d + 1]] * w[1 : 1 + counts[d]]).sum(dtype=np.uint64, keepdims=True) + np.uint64(1 + counts[d]))[0]) for d in short], np.uint64)
    g, owner = np.concatenate([g, extra]), np.concatenate([owner, short])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=docs))]).astype(np.int64)


def signatures(g: np.ndarray, off: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of every set."""
    sizes = np.diff(off)
    table = bands(percent, int(sizes.max()) if len(sizes) else 0)
    lows, highs = np.array([b[0] for b in table] + [1 << 62]), np.array([b[1] for b in table] + [1 << 62])
    own = np.searchsorted(lows, sizes, side="right") - 1
    table += [(table[-1][1] + 1, max(table[-1][1] + 1, (table[-1][1] + 1) * 10000 // (percent * percent)))] if table else []
    out_set, out_sig = [], []
    for up in (0, 1):
        band = own + up
        take = sizes > 0
        if up:
            take &= np.array([sizes[i] * 100 >= percent * table[b][0] if b < len(table) else False for i, b in enumerate(band)], bool) if len(sizes) else take
        for b in np.unique(band[take]):
            sets = np.flatnonzero(take & (band == b))
            parts, spare, second, out = family_shape(table[b][1], percent)
            if not parts:
                continue  # equal sets are one class already
            for cut in range(CUTS):
                if not len(sets):
                    break
                n = sizes[sets]
                at = np.repeat(off[sets] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                x = g[at]
                key = mix(x + np.uint64(cut * 1000003 + 17))
                cell = np.repeat(np.arange(len(sets)), n) * (second * parts) + (key % np.uint64(second * parts)).astype(np.int64)
                sums = np.zeros(len(sets) * parts * second, np.uint64)
                order = np.argsort(cell, kind="stable")
                c = cell[order]
                heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                sums[c[heads]] = np.add.reduceat(mix(x[order] ^ np.uint64(0x5851F42D4C957F2D)), heads)
                full = np.zeros(len(sums), bool)
                full[c[heads]] = True
                full = full.reshape(-1, second)
                sums = mix(sums.reshape(-1, second) + np.arange(second, dtype=np.uint64))
                part = np.tile(np.arange(parts), len(sets))
                weak = np.zeros(len(part), bool)
                for one, kept in enumerate(combinations(range(second), second - out)):
                    some = full[:, kept].any(1)
                    weak |= ~some
                    emit = np.flatnonzero(some) if cut < CUTS - 1 else np.arange(len(some))
                    tag = mix((part[emit] * 64 + one).astype(np.uint64) + np.uint64((int(b) * CUTS + cut) << 32))
                    out_set.append(sets[emit // parts])
                    out_sig.append(mix(sums[emit][:, kept].sum(1, dtype=np.uint64) + tag))
                sets = sets[weak.reshape(-1, parts).sum(1) > spare]
    if not out_set:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_set), np.concatenate(out_sig)


def _prints(g: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    docs = len(off) - 1
    owner = np.repeat(np.arange(docs), np.diff(off))
    out = []
    for salt in (3, 5):
        sums = np.zeros(docs, np.uint64)
        np.add.at(sums, owner, mix(g + np.uint64(salt)))
        out.append(sums.view(np.int64))
    return out


def _sketch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, BATCH_BYTES):
            g, off = shingle_sets(b.column("text"), n)
            fa, fb = _prints(g, off)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_shingles": pa.array(np.diff(off)), "fa": pa.array(fa), "fb": pa.array(fb)})


def _deal(batches: Iterator[pa.RecordBatch], n: int, percent: int, buckets: int, sign) -> Iterator[pa.RecordBatch]:
    """Signatures packed by bucket: 16 bytes for each, the signature and the first fingerprint of its set.

    Equal sets of a batch are packed once.
    """
    for whole in batches:
        for b in slices(whole, BATCH_BYTES):
            g, off = shingle_sets(b.column("text"), n)
            fa = _prints(g, off)[0]
            sets, sig = sign(g, off, percent)
            first = np.zeros(len(fa), bool)
            first[np.unique(fa, return_index=True)[1]] = True
            keep = first[sets]
            sets, sig = sets[keep], sig[keep]
            yield pack_buckets(sig, np.stack([sig.view(np.int64), fa[sets]], 1), buckets)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The sets of texts whose fingerprints are those of the class that they stand for."""
    for whole in batches:
        for b in slices(whole, BATCH_BYTES):
            g, off = shingle_sets(b.column("text"), n)
            fa, fb = _prints(g, off)
            same = (fa == b.column("fa").to_numpy()) & (fb == b.column("fb").to_numpy())
            yield pa.record_batch({"node": b.column("node")} | set_columns(g, off)).filter(pa.array(same))


def jaccard_join(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, sign=signatures) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document.

    Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of word
    n-grams; component_id is the least doc_id reachable by links, itself included. Texts
    without words (null, empty, blank) have empty sets and link with nothing. Documents
    with equal sets are in one component. doc_ids should be distinct: rows of one doc_id
    give a row each, and share a component_id where their sets are equal. A row without a
    doc_id gives a row with a null component_id. An empty table gives no rows. sign takes
    sets, offsets and the percent, and names the signatures of each set. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = scratch.save(texts.mapInArrow(lambda it: _sketch(it, n), "doc_id long, n_shingles long, fa long, fb long"))
    same = ["n_shingles", "fa", "fb"]
    of_class = made.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    of_class = scratch.save(of_class.withColumn("node", F.monotonically_increasing_id()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    packed = texts.where("doc_id is not null").select("text").mapInArrow(lambda it: _deal(it, n, percent, parts, sign), "bucket int, packed binary")
    found = leader_pairs(scratch, packed, parts)
    # From fingerprints to classes; should several classes share one, all of them.
    of = lambda x: of_class.select(F.col("fa").alias(x), F.col("node").alias(f"n{x}"), F.col("n_shingles").alias("n"))
    stars = scratch.save(found.join(of("a").drop("n"), "a").join(of("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "n"))
    # Merged at every size: what hangs together grows with the corpus.
    nodes = stars.select("a").union(stars.select("b")).distinct().join(of_class, F.col("a") == F.col("node")).select("node", "rep", "fa", "fb")
    sets = nodes.hint("merge").join(texts, F.col("rep") == F.col("doc_id")).select("node", "fa", "fb", "text")
    sets = scratch.save(sets.mapInArrow(lambda it: _sets(it, n), SETS).dropDuplicates(["node"]))
    linked = linked_components(scratch, stars, sets, percent)
    scratch.drop(found, stars, sets)
    # Of each component the least doc_id.
    classes = of_class.join(linked.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(*same, "rep", F.coalesce("component", "node").alias("c"))
    low = classes.groupBy("c").agg(F.min("rep").alias("found"))
    classes = classes.join(low, "c").select(*same, "found")
    out = made.select("doc_id", *same).join(classes, same, "left")
    own = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def jaccard_stage(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of least doc_id, with the columns of docs."""
    i = unused(docs, "_id")
    keep = jaccard_join(docs).where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias(i)).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col(i)), "left_semi")
