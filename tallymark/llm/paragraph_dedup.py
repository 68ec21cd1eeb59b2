"""Substring deduplication by paragraphs: MinHash banding, exact Jaccard, components.

Paragraphs are stretches of WORDS words that begin at anchors: in every WINDOW positions
in a row the one where the hash of two words is least. So they depend on the words alone,
not on line ends or on what stands around, may overlap, and of a passage of WORDS + WINDOW - 1 words
that stands in two places at least one paragraph is the same in both. Texts shorter than
WORDS have none and are left alone.

Paragraphs are banded by MinHash over five-word shingles with one permutation: the hashes are cut into
one range more than two similar sets can have shingles apart, so in one range at least they agree. A
band is the minimum in a range with a fingerprint of what else is there. So every pair at the
threshold shares a band, whatever their anchors where not only equal ones may meet, but for equal 64-bit hashes; those that share a
band are verified by exact Jaccard on their whole sets (see similar.py). Of each
connected component of near-equal paragraphs the place that comes first stays, and with it
places that overlap it; the words of all others go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, mix, powers, slices, span_hashes, text_bytes, word_spans
from .similar import SETS, leader_pairs, linked_components, pack_buckets, set_columns, sketched

NGRAM, PERCENT = 5, 80
#: A passage of WORDS + WINDOW - 1 = 50 words is sure to hold a paragraph.
WORDS, WINDOW = 24, 27
#: Cuts of the hashes: sets with too few ranges that are not empty take part under the next one too, and with the last empty ranges count.
CUTS = 4
BATCH_BYTES = 3 << 20


def anchors(two: np.ndarray, first: np.ndarray, words: int = WORDS, window: int = WINDOW) -> np.ndarray:
    """The words at which paragraphs begin, from a hash of each word and the next one, and the first word of each text (and the end)."""
    n = np.diff(first)
    room = np.maximum(n - words + 1, 0)
    # Texts one after the other with a gap of a window, so that no window reaches into the next.
    begin = np.cumsum(room + window) - room - window
    size = int((room + window).sum()) if len(room) else 0
    value = np.full(size, ~np.uint64(0), np.uint64)
    word = np.repeat(first[:-1] - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
    at = np.repeat(begin - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
    value[at] = two[word]
    m, best, step = value, np.arange(size), 1
    while step * 2 <= window:
        right, place = np.full(size, ~np.uint64(0), np.uint64), best.copy()
        right[: size - step], place[: size - step] = m[step:], best[step:]
        move = right < m
        m, best = np.where(move, right, m), np.where(move, place, best)
        step *= 2
    starts = np.flatnonzero(np.repeat(room, room) - (at - np.repeat(begin, room)) >= np.minimum(np.repeat(room, room), window)) if len(at) else np.zeros(0, np.int64)
    w = at[starts]
    other = w + window - step
    found = np.unique(np.where(m[other] < m[w], best[other], best[w]))
    to_word = np.zeros(size, np.int64)
    to_word[at] = word
    return to_word[found]


class Paragraphs:
    """The paragraphs of a column of texts: doc, pos (first word in the doc), and their sets of shingles."""

    def __init__(self, column: pa.Array, n: int = NGRAM, words: int = WORDS, window: int = WINDOW):
        raw, offsets = text_bytes(column)
        self.base = offsets
        self.starts, self.ends, counts = word_spans(raw, offsets)
        h = span_hashes(lower_ascii(raw), self.starts, self.ends)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        two = mix(h + mix(np.concatenate([h[1:], h[:1]]) + np.uint64(29)))
        self.at = anchors(two, self.first, words, window)
        self.anchor = two[self.at]
        self.doc = np.searchsorted(self.first, self.at, side="right") - 1
        self.pos = self.at - self.first[self.doc]
        self.width = words - n + 1
        w = powers(0xA0761D6478BD642F, n + 1)
        g = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for i in range(n):
            g += h[i : i + len(g)] * w[n - i]
        self.g = mix(g)

    def sets(self, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles end to end, and offsets, of all paragraphs or of those that begin at the given words."""
        at = self.at if some is None else some
        x = np.sort(self.g[at[:, None] + np.arange(self.width)], axis=1)
        new = np.ones(x.shape, bool)
        new[:, 1:] = x[:, 1:] != x[:, :-1]
        return x[new], np.concatenate([[0], np.cumsum(new.sum(1))]).astype(np.int64)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit fingerprints of each set."""
        g, off = self.sets()
        out = [np.add.reduceat(mix(g + np.uint64(salt)), off[:-1]) if len(self.at) else np.zeros(0, np.uint64) for salt in (3, 5)]
        return out[0].view(np.int64), out[1].view(np.int64)

    def bands(self, percent: int = PERCENT, same_anchor: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, band signature): of each range of hashes the minimum and the sum of all there, with the anchor if only equal ones may meet.

        Similar sets of at most `width` shingles differ in 2 * width * (100 - percent) / (100 + percent) at most, and a set of n from
        any other in n * (100 - percent) / percent. One that has more ranges with shingles than that agrees on one of these with all
        that are similar to it. Two of which neither has meet under the next cut. Sets that are similar to equal ones alone have no bands.
        """
        g, off = self.sets()
        n = np.diff(off)
        ranges = 2 * self.width * (100 - percent) // (100 + percent) + 1
        apart = np.minimum(n * (100 - percent) // max(percent, 1), ranges - 1)
        own, some = [], np.flatnonzero(apart > 0)
        out = []
        for cut in range(CUTS):
            if not len(some):
                break
            at = np.repeat(off[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(int(n[some].sum()))
            x, row = g[at], np.repeat(np.arange(len(some)), n[some])
            if cut:
                x = mix(x + np.uint64(cut))
                order = np.lexsort((x, row))
                x = x[order]
            cell = row * ranges + ((x >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            full = np.zeros(len(some) * ranges, bool)
            full[cell[head]] = True
            sig = np.zeros(len(full), np.uint64)
            sig[cell[head]] = mix(x[head] + mix(np.add.reduceat(mix(x ^ np.uint64(0x5851F42D4C957F2D)), head)))
            emit = np.flatnonzero(full) if cut < CUTS - 1 else np.arange(len(full))
            own.append(some[emit // ranges])
            tag = (emit % ranges + cut * 1000003).astype(np.uint64)
            out.append(mix(sig[emit] + mix(self.anchor[own[-1]] + tag if same_anchor else tag)))
            some = some[full.reshape(-1, ranges).sum(1) <= apart[some]]
        return (np.concatenate(own), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _deal_bands(batches: Iterator[pa.RecordBatch], buckets: int, percent: int, same_anchor: bool) -> Iterator[pa.RecordBatch]:
    """(signature, fingerprint) packed by signature; equal paragraphs of a batch once."""
    for whole in batches:
        for b in slices(whole, BATCH_BYTES):
            p = Paragraphs(b.column("text"))
            fa = p.prints()[0]
            one = np.zeros(len(fa), bool)
            one[np.unique(fa, return_index=True)[1]] = True
            own, sig = p.bands(percent, same_anchor)
            own, sig = own[one[own]], sig[one[own]]
            key = sketched(sig, *p.sets(), own, 2 * p.width * (100 - percent) // (100 + percent))
            yield pack_buckets(sig, np.stack([key.view(np.int64), fa[own]], 1), buckets)


def _deal_places(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Places of paragraphs packed as (fa, fb, h, id, pos and flags), by fingerprint.

    Of a paragraph that is in the batch more than once only the first place goes to the bucket
    of its fingerprint; the others are known to repeat and are dealt out by place, so that no bucket
    gets all places of a common paragraph. Flags: 1 the row has an id, 2 repeats, 4 dealt by place.
    """
    for whole in batches:
        for b in slices(whole, BATCH_BYTES):
            p = Paragraphs(b.column("text"))
            if not len(p.at):
                continue
            fa, fb = p.prints()
            ids = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            has = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            h = b.column("h").to_numpy(zero_copy_only=False)
            _, one, back, n = np.unique(np.stack([fa, fb], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
            again = n[back.ravel()] > 1
            spread = again.copy()
            spread[one] = False
            flags = has[p.doc] | again.astype(np.int64) << 1 | spread.astype(np.int64) << 2
            rows = np.stack([fa, fb, h[p.doc], ids[p.doc], p.pos << 3 | flags], 1)
            key = np.where(spread, mix((h[p.doc] + p.pos).view(np.uint64)), fa.view(np.uint64))
            yield pack_buckets(key, rows, buckets)


def _deal_wanted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints of candidates packed like places, with position -1."""
    for b in batches:
        fa = b.column("fa").to_numpy(zero_copy_only=False)
        if len(fa):
            rows = np.zeros((len(fa), 5), np.int64)
            rows[:, 0], rows[:, 4] = fa, -1
            yield pack_buckets(fa.view(np.uint64), rows, buckets)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of one bucket whose paragraph repeats or is a candidate."""
    raw = [x for b in batches for x in b.column("packed").to_pylist()]
    rows = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 5)
    del raw
    if not len(rows):
        return
    wanted = np.unique(rows[rows[:, 4] == -1, 0])
    rows = rows[rows[:, 4] != -1]
    flags = rows[:, 4] & 7
    here = np.flatnonzero(flags < 4)
    fa = rows[here, 0]
    _, back, n = np.unique(fa, return_inverse=True, return_counts=True)
    keep = flags >= 4
    keep[here] = (n[back.ravel()] > 1) | (flags[here] & 2 > 0) | np.isin(fa, wanted)
    rows = rows[keep]
    for k in range(0, len(rows), 50_000):
        r = rows[k : k + 50_000]
        ids = pa.array(r[:, 3], mask=(r[:, 4] & 1) == 0)
        yield pa.record_batch({"fa": pa.array(r[:, 0]), "fb": pa.array(r[:, 1]), "id": ids, "h": pa.array(r[:, 2]), "pos": pa.array(r[:, 4] >> 3)})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the paragraphs that stand for their class, from the texts that hold them."""
    for whole in batches:
        for b in slices(whole, BATCH_BYTES):
            p = Paragraphs(b.column("text"))
            nodes, at = [], []
            for d, some in enumerate(b.column("some").to_pylist()):
                for x in some:
                    nodes.append(x["node"])
                    at.append(p.first[d] + x["pos"])
            if nodes:
                yield pa.record_batch({"node": pa.array(nodes, pa.int64())} | set_columns(*p.sets(np.array(at, np.int64))))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, BATCH_BYTES):
            p = Paragraphs(b.column("text"))
            count = np.bincount(p.doc, minlength=b.num_rows)
            removed, words, sha, kept = [], [], [], []
            for d, (t, gone) in enumerate(zip(b.column("text"), b.column("gone").to_pylist())):
                raw = (t.as_py() or "").encode()
                first = {x["c"]: x["pos"] for x in gone or () if x["stays"]}
                gone = sorted({x["pos"] for x in gone or () if not -WORDS < x["pos"] - first.get(x["c"], -WORDS) < WORDS})
                lo, hi = p.first[d], p.first[d + 1]
                edge = np.zeros(hi - lo + 1, np.int64)
                for x in gone:
                    edge[x] += 1
                    edge[x + WORDS] -= 1
                out = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                s = p.starts[lo:hi]
                heads, tails = np.flatnonzero(out[1:-1] & ~out[:-2]), np.flatnonzero(out[1:-1] & ~out[2:])
                base = p.base[d]
                pieces, upto = [], 0
                for i, j in zip(heads, tails):
                    pieces.append(raw[upto : s[i] - base])
                    upto = (s[j + 1] if j + 1 < len(s) else p.ends[lo + j]) - base
                pieces.append(raw[upto:])
                text = b"".join(pieces)
                removed.append(len(gone))
                words.append(int(out.sum()))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode())
            yield pa.record_batch(
                {"doc_id": b.column("doc_id"), "n_paragraphs": pa.array(count.astype(np.int64)), "n_removed": pa.array(removed, pa.int64()), "n_words_removed": pa.array(words, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept, pa.string())}
            )


def paragraph_dedup(docs: DataFrame, percent: int = PERCENT, same_anchor: bool = True) -> DataFrame:
    """(doc_id, n_paragraphs, n_removed, n_words_removed, kept_sha256, kept_text) for each document.

    n_removed counts paragraphs; a word goes if a removed paragraph holds it, with the breaks that
    follow it. First is the place of least doc_id (null before all), then hash of the text, then position. Null
    counts as empty; null, empty and short texts lose nothing. Case of A-Z is ignored. Rows that
    repeat doc_id and text count as one document and keep alike; different texts of one doc_id, or
    of none, are documents of their own. An empty table gives no rows. Other columns are ignored. With same_anchor
    only paragraphs that begin with the same two words are looked for, else all pairs at the threshold link.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    shape = "bucket int, packed binary"
    found = leader_pairs(scratch, d.select("text").mapInArrow(lambda it: _deal_bands(it, buckets, percent, same_anchor), shape), buckets, sketches=True)
    wanted = found.select(F.col("a").alias("fa")).union(found.select("b")).distinct().mapInArrow(lambda it: _deal_wanted(it, buckets), shape)
    places = d.mapInArrow(lambda it: _deal_places(it, buckets), shape).union(wanted)
    places = scratch.save(places.repartition(buckets, "bucket").mapInArrow(_repeated, "fa long, fb long, id long, h long, pos long"))
    place = F.struct(F.col("id").isNotNull().alias("has"), "id", "h", "pos")
    classes = scratch.save(places.groupBy("fa", "fb").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()))
    of = lambda x: classes.select(F.col("fa").alias(x), F.col("node").alias(f"n{x}"))
    stars = scratch.save(found.join(of("a"), "a").join(of("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    nodes = stars.select("a").union(stars.select("b")).distinct().join(classes, F.col("a") == F.col("node"))
    some = nodes.groupBy(F.col("first.id").alias("_id"), F.col("first.h").alias("_h")).agg(F.collect_list(F.struct("node", F.col("first.pos").alias("pos"))).alias("some"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    sets = d.join(some.hint("merge"), same).select("text", "some").mapInArrow(_extract, SETS)
    sets = scratch.save(sets.dropDuplicates(["node"]))
    linked = linked_components(scratch, stars, sets, percent)
    scratch.drop(found, stars, sets)
    classes = scratch.save(classes.join(linked.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("fa", "fb", "first", "n", F.coalesce("component", "node").alias("c")))
    first = scratch.save(classes.groupBy("c").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1"))
    open_ = classes.join(first.select("c"), "c").select("fa", "fb", "c")
    # All places of the components and, marked, their first ones, set against each other within the documents.
    gone = places.join(open_, ["fa", "fb"]).select("id", "h", "pos", "c", F.lit(False).alias("stays")).union(first.select("first.id", "first.h", "first.pos", "c", F.lit(True)))
    gone = gone.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("pos", "c", "stays")).alias("gone"))
    out = d.join(gone.hint("merge"), same, "left").select("doc_id", "text", "gone")
    return out.mapInArrow(_cut, "doc_id long, n_paragraphs long, n_removed long, n_words_removed long, kept_sha256 string, kept_text string")
