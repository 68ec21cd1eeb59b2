"""Components of similar sets from groups that hold every similar pair.

Sets that share a signature form a group, and similar sets share one by promise of
the signatures. Each group ties its members to its least one, its leader, and every
member is compared with its leaders exactly: rows grow with the members, not with their
pairs, and copies of one text are done with then. What is left are pairs of one
leader's members that are not in one component yet. Of these, a member linked to the leader and
one whose distance from it is over twice the limit can't be similar (Jaccard distance
obeys the triangle inequality), the others are tried block against block, first on the parities of their sets alone, and the
sets of those that may have a partner by these on small histograms, then exactly, and a pair of blocks gives back no more links than join its members. No pair of a group is left out.

Where sets are small a signature carries a sketch: the parities of the elements in 32 cells. Sets that differ in k
elements differ in k parities at most, so members of a group that differ in more are not tied to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, mix

#: Cells of a histogram, members of a block, elements of the sets that are compared with one leader in one task (a block may have four times as many).
CELLS, BLOCK, CHUNK = 256, 1024, 1 << 20
#: Members of a group from which it is parted by pieces of the sketches, comparisons of sketches in one bucket, and members near a centre that are asked each.
WIDE, MOST_TRIES, FEW = 256, 1 << 31, 16
#: Pairs of members whose parities are compared at once.
PAIRS = 1 << 19
SETS = "node long, n long, elements binary"


def pack_buckets(keys: np.ndarray, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of 64-bit words as one binary for each bucket, the key modulo their number."""
    bucket = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = np.ascontiguousarray(rows[order])
    some = np.flatnonzero(np.diff(cuts))
    return pa.record_batch({"bucket": pa.array(some.astype(np.int32)), "packed": pa.array([rows[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())})


def _unique(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])] if len(rows) else rows


def _unpacked(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    raw = [x for b in batches for x in b.column("packed").to_pylist()]
    return _unique(np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2))


def sketched(sig: np.ndarray, g: np.ndarray, off: np.ndarray, sets: np.ndarray, k: int) -> np.ndarray:
    """Signatures with sketches: 26 bits of each, the number of elements in which similar sets may differ (under 64), 32 parities of its set."""
    bit = np.uint64(1) << ((g >> np.uint64(20)) & np.uint64(31))
    parity = np.bitwise_xor.reduceat(bit, off[:-1]) if len(bit) else np.zeros(0, np.uint64)
    return (sig & np.uint64(0xFFFFFFC000000000)) | np.uint64(k << 32) | parity[sets]


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys the number of each one's group and the sizes of the groups."""
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return group, np.bincount(group) if len(key) else np.zeros(0, np.int64)


def _stars(group: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """(least member, other member) of groups given in order."""
    if not len(group):
        return np.zeros((0, 2), np.int64)
    head = np.concatenate([[True], group[1:] != group[:-1]])
    leader = np.minimum.reduceat(owner, np.flatnonzero(head))[np.cumsum(head) - 1]
    return np.stack([leader, owner], 1)[leader != owner]


def near_stars(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Stars that hold every pair of a group whose sketches allow it, from sorted keys with sketches.

    The first member of each group is a centre: those that differ from it in up to k parities are done with, for they make a group of
    their own with all who differ in up to k from one of them (and so in up to 2k from the centre). It goes on with the rest of each group.
    Groups of many members are first parted by pieces of the sketch, of which one at least is equal where k parities differ.
    What is left after MOST_TRIES comparisons is a star for each group.
    """
    high, k, sketch = key >> np.uint64(32), (key >> np.uint64(32)).astype(np.int64) & 63, key & np.uint64(0xFFFFFFFF)
    group, sizes = _grouped(high)
    wide = (sizes[group] > WIDE) & (k < 16) if len(key) else np.zeros(0, bool)
    parts = [(high[~wide], k[~wide], sketch[~wide], owner[~wide])]
    for piece in range(int(k[wide].max()) + 1 if wide.any() else 0):
        w = np.flatnonzero(wide & (k >= piece))
        low, to = piece * 32 // (k[w] + 1), (piece + 1) * 32 // (k[w] + 1)
        value = (sketch[w] >> low.astype(np.uint64)) & ((np.uint64(1) << (to - low).astype(np.uint64)) - np.uint64(1))
        parts.append((mix(high[w] + mix(value + np.uint64((piece + 1) << 40))), k[w], sketch[w], owner[w]))
    high, k, sketch, owner = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(high, kind="stable")
    high, k, sketch, owner = high[order], k[order], sketch[order], owner[order]
    out, tries = [], 0
    while True:
        group, sizes = _grouped(high)
        some = sizes[group] > 1 if len(high) else np.zeros(0, bool)
        high, k, sketch, owner = high[some], k[some], sketch[some], owner[some]
        if not len(high):
            break
        tries += len(high)
        group, sizes = _grouped(high)
        if tries > MOST_TRIES:
            out.append(_stars(group, owner))
            break
        centre = (np.cumsum(sizes) - sizes)[group]
        apart = np.bitwise_count(sketch ^ sketch[centre]).astype(np.int64)
        done, near = apart <= k, apart <= k
        # Who may be near one that is done with: up to FEW of these are asked each, of more only the centre is.
        count = np.bincount(group[done], minlength=len(sizes))
        other = np.flatnonzero(~done & (apart <= 2 * k) & (count[group] > 1))
        near[other[count[group[other]] > FEW]] = True
        other, asked = other[count[group[other]] <= FEW], np.flatnonzero(done)
        rank = np.arange(len(asked)) - (np.cumsum(count) - count)[group[asked]]
        for t in range(1, FEW):
            if not len(other):
                break
            with_ = np.full(len(sizes), -1)
            with_[group[asked[rank == t]]] = asked[rank == t]
            other = other[with_[group[other]] >= 0]
            hit = np.bitwise_count(sketch[other] ^ sketch[with_[group[other]]]) <= k[other]
            near[other[hit]] = True
            other = other[~hit]
        out.append(_stars(group[near], owner[near]))
        rest = apart > k
        high, k, sketch, owner = high[rest], k[rest], sketch[rest], owner[rest]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def group_stars(batches: Iterator[pa.RecordBatch], buckets: int, sketches: bool = False) -> Iterator[pa.RecordBatch]:
    """Of one bucket of packed (signature, member) each group's least member with every other one, packed by pair."""
    both = _unpacked(batches)
    if not len(both):
        return
    key, owner = both[:, 0], both[:, 1]
    pairs = _unique(near_stars(key.view(np.uint64), owner) if sketches else _stars(key, owner))
    if len(pairs):
        yield pack_buckets(mix(pairs[:, 0].view(np.uint64) + mix(pairs[:, 1].view(np.uint64))), pairs, buckets)


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): the distinct pairs of one bucket."""
    pairs = _unpacked(batches)
    for k in range(0, len(pairs), 100_000):
        yield pa.record_batch({"a": pa.array(pairs[k : k + 100_000, 0]), "b": pa.array(pairs[k : k + 100_000, 1])})


def leader_pairs(scratch: Scratch, packed: DataFrame, buckets: int, sketches: bool = False) -> DataFrame:
    """(a, b) of all groups of packed (signature, member): a leader and another member, each pair once."""
    stars = packed.repartition(buckets, "bucket").mapInArrow(lambda it: group_stars(it, buckets, sketches), "bucket int, packed binary")
    return scratch.save(stars.repartition(buckets, "bucket").mapInArrow(pair_rows, "a long, b long"))


def set_columns(g: np.ndarray, off: np.ndarray) -> dict[str, pa.Array]:
    """n and elements of sets of sorted 64-bit hashes laid end to end."""
    m = len(off) - 1
    return {"n": pa.array(np.diff(off).astype(np.int64)), "elements": pa.array([g[off[i] : off[i + 1]].tobytes() for i in range(m)], pa.binary())}


def parities(elements: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The parities of each set in at least twice as many cells as it has elements, a power of two of 64-bit words.

    Those of half as many cells are the two halves combined by xor.
    """
    words = 1 << np.ceil(np.log2(np.maximum(n / 32, 1))).astype(np.int64)
    begin = np.cumsum(words) - words
    cell = ((elements >> np.uint64(20)) & np.repeat(words * 64 - 1, n).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, np.repeat(begin, n) + (cell >> 6), np.uint64(1) << (cell & 63).astype(np.uint64))
    return [out[x : x + w].tobytes() for x, w in zip(begin, words)]


def _parities_apart(sketch: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many cells the parities of members x and y differ, over the cells of the smaller one: no more than the elements in which their sets differ."""
    words = np.array([len(s) // 8 for s in sketch], np.int64)
    out = np.zeros(len(x), np.int64)
    least = np.minimum(words[x], words[y])
    for c in np.unique(least).tolist():
        of = np.flatnonzero(least == c)
        used = np.unique(np.concatenate([x[of], y[of]]))
        table, at = np.zeros((len(used), c), np.uint64), np.zeros(len(words), np.int64)
        at[used] = np.arange(len(used))
        for w in np.unique(words[used]).tolist():
            some = used[words[used] == w]
            rows = np.frombuffer(b"".join(sketch[k] for k in some), np.uint64).reshape(-1, w)
            while rows.shape[1] > c:
                half = rows.shape[1] // 2
                rows = rows[:, :half] ^ rows[:, half:]
            table[at[some]] = rows
        step = max(PAIRS * 4 // c, 1)
        for k in range(0, len(of), step):
            o = of[k : k + step]
            out[o] = np.bitwise_count(table[at[x[o]]] ^ table[at[y[o]]]).sum(1, dtype=np.int64)
    return out


def _may_link(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The members that may be similar to another one by sizes, labels, leaders and parities, from rows sorted by pair of blocks (a, i, j)."""

    def kept(t: pa.Table) -> pa.Table:
        a, i, j, own, n, label = (t.column(c).to_numpy() for c in ("a", "i", "j", "own", "nb", "label"))
        near, mid = t.column("near").to_numpy(zero_copy_only=False), t.column("mid").to_numpy(zero_copy_only=False)
        sketch = t.column("sketch").to_pylist()
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        sizes = np.diff(np.append(head, len(a)))
        partners = np.repeat(head + sizes, sizes) - np.arange(len(a)) - 1
        upto = np.concatenate([[0], np.cumsum(partners)])
        keep, low = np.zeros(len(a), bool), 0
        while low < len(a):
            high = max(int(np.searchsorted(upto, upto[low] + PAIRS, side="right")) - 1, low + 1)
            p = partners[low:high]
            x = np.repeat(np.arange(low, high), p)
            y = x + 1 + np.arange(len(x)) - np.repeat(upto[low:high] - upto[low], p)
            free = ((i[x] == j[x]) | (own[x] != own[y])) & (label[x] != label[y]) & ~(near[x] & ~mid[y]) & ~(near[y] & ~mid[x])
            free &= (100 + percent) * np.minimum(n[x], n[y]) >= percent * (n[x] + n[y])
            x, y = x[free], y[free]
            free = (100 + percent) * ((n[x] + n[y] - _parities_apart(sketch, x, y)) // 2) >= percent * (n[x] + n[y])
            keep[x[free]] = keep[y[free]] = True
            low = high
        return t.filter(pa.array(keep)).drop_columns(["nb", "sketch"])

    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        a, i, j = (t.column(c).to_numpy() for c in ("a", "i", "j"))
        cut = len(a) - int(np.argmax(((a != a[-1]) | (i != i[-1]) | (j != j[-1]))[::-1])) if (a[0], i[0], j[0]) != (a[-1], i[-1], j[-1]) else 0
        if cut:
            yield from kept(t.slice(0, cut).combine_chunks()).to_batches()
        rest = t.slice(cut)
    if rest is not None:
        yield from kept(rest.combine_chunks()).to_batches()


def _against_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, both, na, nb, sketch): how many elements each member has in common with its leader, and its parities, from rows sorted so that the leader of a group comes first."""
    carry = None
    for t in batches:
        if not t.num_rows:
            continue
        own, a, ids = t.column("own").to_numpy(zero_copy_only=False), t.column("a").to_numpy(), t.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("elements").to_pylist()]
        if not own[0]:
            own, a, ids, sets = np.append(True, own), np.append(carry[0], a), np.append(carry[0], ids), [carry[1], *sets]
        lead = np.flatnonzero(own)
        carry = (a[lead[-1]], sets[lead[-1]])
        group = np.cumsum(own) - 1
        n = np.array([len(x) for x in sets], np.int64)
        elements = np.concatenate(sets)
        # The element's number in the batch and the group's make one exact key.
        x = np.unique(elements, return_inverse=True)[1].ravel() + np.repeat(group, n) * len(elements)
        of_lead = np.repeat(own, n)
        keys = x[of_lead]
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        hits = np.concatenate([[0], np.cumsum(keys[at] == x)])
        upto = np.cumsum(n)
        rest = np.flatnonzero(~own)
        if len(rest):
            both = (hits[upto] - hits[upto - n])[rest]
            sketch = parities(elements[~of_lead], n[rest])
            yield pa.record_batch({"a": pa.array(a[rest]), "b": pa.array(ids[rest]), "both": pa.array(both.astype(np.int64)), "na": pa.array(n[lead][group[rest]]), "nb": pa.array(n[rest]), "sketch": pa.array(sketch, pa.binary())})


def compared(scratch: Scratch, pairs: DataFrame, sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b, both, na, nb, sketch) of pairs (a, b) of nodes, with n of b if it is known; many partners of one a are dealt to several tasks by size."""
    sized = pairs if "n" in pairs.columns else pairs.join(sets.select(F.col("node").alias("b"), "n"), "b")
    total = sized.groupBy("a").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("chunks"))
    placed = scratch.save(sized.join(total, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.greatest("chunks", F.lit(1))).cast("int").alias("chunk")))
    members = placed.join(sets.select(F.col("node").alias("b"), "elements"), "b").select("a", "chunk", F.col("b").alias("node"), F.lit(False).alias("own"), "elements")
    leaders = placed.select("a", "chunk").distinct().join(sets.select(F.col("node").alias("a"), "elements"), "a").select("a", "chunk", F.col("a").alias("node"), F.lit(True).alias("own"), "elements")
    parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = members.union(leaders).repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", F.desc("own"))
    return scratch.save(rows.mapInArrow(_against_leaders, "a long, b long, both long, na long, nb long, sketch binary"))


def _try_blocks(percent: int):
    """Links that join members of two blocks of one leader: of those in one component no more than it takes."""

    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def run(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        own = t.column("own").to_numpy()
        nodes, n, label = (t.column(c).to_numpy() for c in ("b", "n", "label"))
        near, mid = t.column("near").to_numpy(zero_copy_only=False), t.column("mid").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        # Same component, both linked to the leader, or too far apart by the triangle inequality
        free = (label[left][:, None] != label[right]) & ~(near[left][:, None] & ~mid[right]) & ~(near[right] & ~mid[left][:, None])
        if i == j:
            free &= left[:, None] < right
        if not free.any():
            return empty
        off = np.concatenate([[0], np.cumsum(n)])
        g = np.frombuffer(b"".join(t.column("elements").to_pylist()), np.uint64)
        cell = np.repeat(np.arange(len(n)), n) * CELLS + (g >> np.uint64(50)).astype(np.int64) % CELLS
        h = np.minimum(np.bincount(cell, minlength=len(n) * CELLS).reshape(-1, CELLS), 255).astype(np.uint8)
        full = (h == 255).any(1)
        # Products of counts bound their minima from above, and all of them are one product of matrices, exact in 32 bits.
        most = h[left].astype(np.float32) @ h[right].astype(np.float32).T
        free &= (full[left][:, None] | full[right]) | ((100 + percent) * most >= percent * (n[left][:, None] + n[right]))
        if not free.any():
            return empty
        label = np.unique(label, return_inverse=True)[1]
        name = np.unique(g, return_inverse=True)[1]
        flag = np.zeros(len(g), bool)
        a, b = [], []
        for x in np.flatnonzero(free.any(1)):
            u, v = left[x], right[free[x]]
            v = v[label[v] != label[u]]
            most = np.where(full[u] | full[v], np.minimum(n[u], n[v]), np.minimum(h[u], h[v]).sum(1, dtype=np.int64))
            v = v[(100 + percent) * most >= percent * (n[u] + n[v])]
            if not len(v):
                continue
            flag[name[off[u] : off[u + 1]]] = True
            begin = np.cumsum(n[v]) - n[v]
            both = np.add.reduceat(flag[name[np.repeat(off[v] - begin, n[v]) + np.arange(int(n[v].sum()))]], begin, dtype=np.int64)
            flag[name[off[u] : off[u + 1]]] = False
            for w in v[(100 + percent) * both >= percent * (n[u] + n[v])]:
                if label[w] != label[u]:
                    label[label == label[w]] = label[u]
                    a.append(min(nodes[u], nodes[w]))
                    b.append(max(nodes[u], nodes[w]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def linked_components(scratch: Scratch, stars: DataFrame, sets: DataFrame, percent: int, block: int | None = None, chunk: int | None = None) -> DataFrame:
    """(node, component) of nodes that link with others: 100 * |A & B| >= percent * |A | B|.

    stars has (a, b) with a leader a of each group that b is in, and n of b if it is known; sets has a row for each node
    in them as SETS. component is the least node.
    """
    block, chunk = block or BLOCK, chunk or CHUNK
    linked = (100 + percent) * F.col("both") >= percent * (F.col("na") + F.col("nb"))
    twice = max(2 * percent - 100, 0)
    star = compared(scratch, stars, sets, chunk)
    first = scratch.save(star.where(linked).select("a", "b"))
    label = scratch.save(components(scratch, first).toDF("b", "label"))
    m = star.select("a", "b", "nb", "sketch", linked.alias("near"), ((100 + twice) * F.col("both") >= twice * (F.col("na") + F.col("nb"))).alias("mid"))
    m = scratch.save(m.join(label, "b", "left").select("a", "b", "nb", "sketch", "near", "mid", F.coalesce("label", "b").alias("label")))
    count = lambda c: F.count(F.when(c, 1))
    # Blocks of a bounded number of members and of elements
    blocks = lambda c: F.greatest(F.ceil(count(c) / block), F.ceil(F.coalesce(F.sum(F.when(c, F.col("nb"))), F.lit(0)) / (4 * chunk)))
    open_ = m.groupBy("a").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), count(~F.col("near")).alias("far"), blocks(~F.col("near")).alias("fars"), count(F.col("mid") & ~F.col("near")).alias("mids"), blocks(F.col("near")).alias("nears"))
    open_ = open_.where("l0 <> l1 and (far > 1 or mids > 0 and nears > 0)").select("a", F.greatest("fars", F.lit(1)).cast("int").alias("fars"), F.col("nears").cast("int").alias("nears"), "mids")
    # Members linked to the leader are tried only against those that may be near enough to them.
    m = m.join(open_, "a").where("not near or mids > 0")
    at = F.pmod(F.xxhash64("b"), F.when(F.col("near"), F.col("nears")).otherwise(F.col("fars"))).cast("int")
    m = m.withColumn("own", F.when(F.col("near"), -1 - at).otherwise(at))
    own, other = F.col("own"), F.col("other")
    with_far = F.sequence(F.lit(0), F.col("fars") - 1)
    with_near = F.when(F.col("mid") & (F.col("nears") > 0), F.transform(F.sequence(F.lit(1), F.col("nears")), lambda k: -k)).otherwise(F.array().cast("array<int>"))
    m = m.withColumn("other", F.explode(F.when(F.col("near"), with_far).otherwise(F.concat(with_far, with_near))))
    m = m.select("a", "b", "near", "mid", "label", "own", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), "nb", "sketch")
    # Sets go only with members that may have a partner.
    parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    m = m.repartition(parts, "a", "i", "j").sortWithinPartitions("a", "i", "j")
    m = scratch.save(m.mapInArrow(lambda it: _may_link(it, percent), "a long, b long, near boolean, mid boolean, label long, own int, i int, j int"))
    rows = m.join(sets.select(F.col("node").alias("b"), "n", "elements"), "b")
    more = rows.groupBy("a", "i", "j").applyInArrow(_try_blocks(percent), "a long, b long")
    return scratch.save(components(scratch, first.union(scratch.save(more))))
