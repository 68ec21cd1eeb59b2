"""SentencePiece encoding with several distinct sampled segmentations, and decoding.

A text with its word marks is a lattice whose edges are pieces of the vocabulary.
Edges are weighted by Zipf's law over the order of the pieces in the public
vocabulary file (log p = -log(rank + ZIPF_SHIFT) up to a constant); characters that
the vocabulary lacks go through byte pieces. No piece crosses the start of a word, so
the lattice of a text is the chain of the lattices of its words, and equal words of a
batch share one.

Gumbel top-k without replacement is a perturbed A-star search: the whole lattice
gets a Gumbel value, a partial path keeps the Gumbel of all its completions, and the
open node with the largest value is followed straight down to a leaf, since one child
always keeps its parent's value. The nodes left aside on the way get Gumbels cut off
at that value. With the exact mass of every partial path from the backward pass no
node is opened in vain, and the leaves come in falling order, all different. The
(k+1)-th value is the threshold of the inclusion probabilities. All random numbers
are a hash of the seed, the row key, and the place in the row.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, slices, small_batches, span_hashes, text_bytes

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
DRAWS, SEED, ZIPF_SHIFT = 2, 20240607, 10.0
#: Bytes of text that are handled at once.
BATCH_BYTES = 3 << 18
_MARK = "▁"
_MASK = (1 << 64) - 1


class Pieces:
    """The vocabulary as a trie over bytes in which a space stands for the word mark."""

    _cache: dict = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in cls._cache:
            cls._cache[path] = cls(path)
        return cls._cache[path]

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        self.byte_id = np.zeros(256, np.int32)
        normal = []
        size = len(m.pieces)
        self.bytes: list[bytes] = [b""] * size
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[1:-1], 16)] = i
                self.bytes[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == 1:
                raw = p.piece.replace(_MARK, " ").encode()
                self.bytes[i] = raw
                normal.append((-p.score, i, raw))
        order = sorted(normal)
        self.score = np.zeros(size, np.float64)
        for rank, (_, i, _) in enumerate(order):
            self.score[i] = -np.log(rank + ZIPF_SHIFT)
        self.score[self.byte_id] = -np.log(len(order) + ZIPF_SHIFT)
        self.score -= np.log(np.exp(self.score[[i for _, i, _ in order]]).sum() + np.exp(self.score[self.byte_id]).sum())
        steps: list[dict[int, int]] = [{}]
        ids = [-1]
        for _, i, raw in normal:
            s = 0
            for c in raw:
                t = steps[s].get(c)
                if t is None:
                    t = steps[s][c] = len(steps)
                    steps.append({})
                    ids.append(-1)
                s = t
            ids[s] = i
        self.next = np.full((len(steps), 256), -1, np.int32)
        for s, d in enumerate(steps):
            for c, t in d.items():
                self.next[s, c] = t
        self.id = np.array(ids, np.int32)
        self.longest = max(len(r) for _, _, r in normal)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])[:-1]

    def decode(self, ids) -> str:
        """The text of a sequence of ids: the exact inverse of every segmentation."""
        raw = b"".join(self.bytes[i] for i in ids)
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def _chain(n: np.ndarray) -> np.ndarray:
    """0..n0-1, 0..n1-1, ... laid end to end."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) - np.repeat(ends - n, n)


def _uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ((mix(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


class Lattices:
    """The lattices of the distinct words of a batch; nodes are byte places, edges sorted by node."""

    def __init__(self, v: Pieces, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n = ends - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)
        b = raw[at]
        self.start = np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64)
        self.length = n
        size = len(b)
        stop = np.repeat(self.start + n, n)
        place = np.arange(size)
        alive, state = place, np.zeros(size, np.int32)
        froms, lens, ids = [], [], []
        lead = (b & 0xC0) != 0x80
        width = np.where(b < 0x80, 1, np.where(b < 0xE0, 2, np.where(b < 0xF0, 3, 4)))
        lacking = lead.copy()
        alive, state = alive[lead], state[lead]
        for d in range(v.longest):
            ok = alive + d < stop[alive]
            alive, state = alive[ok], state[ok]
            state = v.next[state, b[alive + d]]
            ok = state >= 0
            alive, state = alive[ok], state[ok]
            if not len(alive):
                break
            i = v.id[state]
            hit = i >= 0
            froms.append(alive[hit])
            lens.append(np.full(int(hit.sum()), d + 1, np.int64))
            ids.append(i[hit])
            one = alive[hit & (width[alive] == d + 1)]
            lacking[one] = False
        # Characters without a piece of their own: one edge for each byte.
        lost = np.flatnonzero(lacking)
        w = width[lost]
        lost = np.repeat(lost, w) + _chain(w)
        lost = lost[lost < size]
        froms.append(lost)
        lens.append(np.ones(len(lost), np.int64))
        ids.append(v.byte_id[b[lost]])
        # Nodes are numbered by distance from the end of their word, so that the
        # edges of a distance lie together for the backward pass.
        far = stop - place
        longest = int(far.max()) if size else 0
        order = np.argsort(far.astype(np.uint16) if longest < 1 << 16 else far, kind="stable")
        number = np.empty(size, np.int64)
        number[order] = place
        self.start = number[self.start] if size else self.start
        count = np.zeros(size, np.int64)
        ranks = []
        for f in froms:
            ranks.append(count[f])
            count[f] += 1
        self.first = np.zeros(size + 1, np.int64)
        np.cumsum(count[order], out=self.first[1:])
        m = int(self.first[-1])
        self.to, self.ids, self.frm = np.empty(m, np.int64), np.empty(m, np.int32), np.repeat(place, count[order])
        self.final = np.empty(m, bool)
        for f, n_, i, r in zip(froms, lens, ids, ranks):
            at = self.first[number[f]] + r
            end = f + n_
            last = end == stop[f]
            self.to[at], self.ids[at], self.final[at] = np.where(last, 0, number[np.minimum(end, size - 1)]), i, last
        levels = np.concatenate([[0], np.cumsum(np.bincount(far, minlength=longest + 1))])[1:] if size else np.zeros(1, np.int64)
        beta, value = np.zeros(size), v.score[self.ids]
        q = np.empty(m)
        for k in range(len(levels) - 1):
            n0, n1 = levels[k], levels[k + 1]
            e0, e1 = self.first[n0], self.first[n1]
            if e0 == e1:
                continue
            x = value[e0:e1]
            x += np.where(self.final[e0:e1], 0.0, beta[self.to[e0:e1]])
            heads, nums = self.first[n0:n1] - e0, count[order[n0:n1]]
            some = nums > 0
            heads, nums = heads[some], nums[some]
            top = np.maximum.reduceat(x, heads)
            y = np.exp(x - np.repeat(top, nums))
            z = np.add.reduceat(y, heads)
            q[e0:e1] = y / np.repeat(z, nums)
            beta[n0:n1][some] = top + np.log(z)
        self.q = q
        self.log_q = np.minimum(value - beta[self.frm], 0.0)
        run = np.concatenate([[0.0], np.cumsum(q)])
        self.upto = run[1:] - run[self.first[self.frm]]

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each node by its probability."""
        e, stop = self.first[node], self.first[node + 1] - 1
        todo = np.flatnonzero((u > self.upto[e]) & (e < stop))
        while len(todo):
            e[todo] += 1
            todo = todo[(u[todo] > self.upto[e[todo]]) & (e[todo] < stop[todo])]
        return e

    def walk(self, word: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sampled path for each word of a sequence: its edges in order, and their number by word."""
        node, active = self.start[word].copy(), np.flatnonzero(self.length[word] > 0)
        steps, n = [], np.zeros(len(word), np.int64)
        d = 0
        while len(active):
            e = self.pick(node[active], _uniform(key[active], place[active] * np.int64(1 << 20) + d))
            steps.append((active, e))
            n[active] += 1
            node[active] = self.to[e]
            active = active[~self.final[e]]
            d += 1
        begin = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        for d, (a, e) in enumerate(steps):
            out[begin[a] + d] = e
        return out, n


def _segments(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of words: the first of a run of spaces, both sides of a line feed, and each document."""
    space, line = raw == 0x20, raw == 0x0A
    head = np.zeros(len(raw) + 1, bool)
    head[offsets] = True
    before_space, before_line = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before_space[1:], before_line[1:] = space[:-1], line[:-1]
    return np.flatnonzero(head[:-1] | (space & ~before_space) | line | before_line)


def sample_batch(v: Pieces, column: pa.Array, keys: np.ndarray, draws: int = DRAWS, seed: int = SEED) -> list[tuple[int, int, np.ndarray, float, float, bool]]:
    """(row, draw, ids, log_prob, inclusion, decoded) of the distinct segmentations of each text.

    Draws come in falling order of perturbed log probability; a text with fewer
    segmentations than draws gives as many as it has. log_prob is that of the
    segmentation among all of its text; inclusion is the probability of being drawn
    given the threshold, 1.0 where the draws exhaust the lattice. decoded says that the
    pieces give back the text byte by byte. Null counts as empty; an empty text has the
    one empty segmentation.
    """
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    # The word mark before each text, but for empty ones.
    sizes = np.diff(offsets)
    lead = (sizes > 0).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(sizes + lead)])
    full = np.full(int(off[-1]), 0x20, np.uint8)
    full[np.repeat(off[:-1] + lead - offsets[:-1], sizes) + np.arange(len(raw))] = raw
    starts = _segments(full, off) if len(full) else np.zeros(0, np.int64)
    ends = np.concatenate([starts[1:], [len(full)]]) if len(starts) else starts
    names, index, word = np.unique(span_hashes(full, starts, ends), return_index=True, return_inverse=True)
    lat = Lattices(v, full, starts[index], ends[index])
    words = np.searchsorted(starts, off)
    doc_of_word = np.repeat(np.arange(n), np.diff(words))
    place = np.arange(len(starts)) - words[doc_of_word]
    row_key = mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(seed & _MASK))
    log_other = np.log1p(-np.minimum(lat.q, 1.0), where=lat.q < 1 - 1e-12, out=np.full(len(lat.q), -np.inf))

    def path_all(round_: int):
        edges, per_word = lat.walk(word, mix(row_key + np.uint64(2 * round_ + 1))[doc_of_word], place)
        per_doc_end = np.concatenate([[0], np.cumsum(per_word)])
        return edges, per_doc_end

    def aside(edges: np.ndarray, off: np.ndarray, rows: np.ndarray, g: np.ndarray, from_: np.ndarray, r: int, top: int):
        """Of paths laid end to end: their log probabilities, running sums, and the best cut-off Gumbels aside each.

        A list of (value, path, place, mass) for each of the best, from place from_ of its path on.
        """
        run = np.concatenate([[0.0], np.cumsum(lat.log_q[edges])])
        sizes_ = np.diff(off)
        begin = np.repeat(off[:-1], sizes_)
        inner = np.arange(len(edges)) - begin
        mass = run[:-1] - run[begin] + log_other[edges]
        mass[inner < np.repeat(from_, sizes_)] = -np.inf
        u = _uniform(np.repeat(row_key[rows] + np.uint64(7919 * (2 * r + 2)), sizes_), inner)
        with np.errstate(divide="ignore", invalid="ignore"):
            val = mass - np.log(np.exp(mass - np.repeat(g, sizes_)) - np.log(u))
        val[mass == -np.inf] = -np.inf
        some = np.flatnonzero(sizes_ > 0)
        best = []
        for _ in range(top if len(some) else 0):
            most = np.maximum.reduceat(val, off[some])
            hit = np.flatnonzero(val == np.repeat(most, sizes_[some]))
            owner = np.searchsorted(off, hit, side="right") - 1
            one = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(hit) else np.zeros(0, bool)
            hit, owner = hit[one], owner[one]
            real = val[hit] > -np.inf
            hit, owner = hit[real], owner[real]
            best += zip(val[hit].tolist(), owner.tolist(), (hit - off[owner]).tolist(), mass[hit].tolist())
            val[hit] = -np.inf
        return run[off[1:]] - run[off[:-1]], run, best

    def scalar(key: int, at: int) -> float:
        x = (key + at * 0x9E3779B97F4A7C15) & _MASK
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
        return (((x ^ (x >> 31)) >> 11) + 0.5) / (1 << 53)

    edges, ends_w = path_all(0)
    off_p, rows, bounds = ends_w[words], np.arange(n), [ends_w[words[i] : words[i + 1] + 1] - ends_w[words[i]] for i in range(n)]
    g = -np.log(-np.log(_uniform(row_key, np.full(n, 1 << 40)))) if n else np.zeros(0)
    from_ = np.zeros(n, np.int64)
    heaps: list[list] = [[] for _ in range(n)]
    made: list[list] = [[] for _ in range(n)]  # of each text: (path, log prob, bounds, running sums)
    for r in range(draws):
        sums, run, best = aside(edges, off_p, rows, g, from_, r, draws - r)
        for j, i in enumerate(rows.tolist()):
            a, b = off_p[j], off_p[j + 1]
            made[i].append((edges[a:b], float(sums[j]), bounds[j], run[a:b]))
        for value, j, p, mass in best:
            i = int(rows[j])
            heapq.heappush(heaps[i], (-value, len(made[i]) - 1, p, mass, (int(edges[off_p[j] + p]),)))
        if r + 1 == draws:
            break
        f_edges, f_w = path_all(r + 1)
        new, new_rows, new_g, new_from, new_bounds = [], [], [], [], []
        for i in range(n):
            if not heaps[i]:
                continue
            neg, parent, p, mass, used = heapq.heappop(heaps[i])
            old, _, old_bounds, old_run = made[i][parent]
            key = (int(row_key[i]) + 104729 * (r + 2)) & _MASK
            node = int(lat.frm[old[p]])
            e0, e1 = int(lat.first[node]), int(lat.first[node + 1])
            q = lat.q[e0:e1].tolist()
            for x in used:
                q[x - e0] = 0.0
            left, pick, u = sum(q), -1, scalar(key, 0)
            mark = u * left
            for x, share in enumerate(q):
                if share > 0.0:
                    pick = x
                    mark -= share
                    if mark <= 0:
                        break
            tail = [e0 + pick]
            while not lat.final[tail[-1]]:
                to = int(lat.to[tail[-1]])
                f0, f1 = int(lat.first[to]), int(lat.first[to + 1])
                tail.append(min(f0 + bisect.bisect_left(lat.upto[f0:f1].tolist(), scalar(key, len(tail))), f1 - 1))
            w = int(np.searchsorted(old_bounds, p, side="right")) - 1
            after, stop = int(f_w[words[i] + w + 1]), int(f_w[words[i + 1]])
            new.append(np.concatenate([old[:p], tail, f_edges[after:stop]]))
            new_bounds.append(np.concatenate([old_bounds[: w + 1], f_w[words[i] + w + 1 : words[i + 1] + 1] - after + p + len(tail)]))
            new_rows.append(i)
            new_g.append(-neg)
            new_from.append(p + 1)
            # The node stays open without the edges used so far.
            rest = left - q[pick]
            if rest > 1e-12:
                m = mass - math.log(left) + math.log(rest)
                heapq.heappush(heaps[i], (-(m - math.log(math.exp(m + neg) - math.log(scalar(key, 1 << 30)))), parent, p, m, (*used, tail[0])))
        if not new:
            break
        edges, rows, g, from_, bounds = np.concatenate(new), np.array(new_rows), np.array(new_g), np.array(new_from), new_bounds
        off_p = np.concatenate([[0], np.cumsum([len(x) for x in new])])
    found = []
    for i in range(n):
        threshold = -heaps[i][0][0] if heaps[i] else -math.inf
        found.append([(e, lp, 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(lp - threshold, 50.0)))) for e, lp, _, _ in made[i]])

    out = []
    flat = [(i, d, lat.ids[e], lp, inc) for i, f in enumerate(found) for d, (e, lp, inc) in enumerate(f, 1)]
    # Decode all draws at once and compare with the texts.
    lengths = np.array([len(x[2]) for x in flat], np.int64)
    ids = np.concatenate([x[2] for x in flat]) if flat else np.zeros(0, np.int32)
    piece = v.length[ids]
    got = v.flat[np.repeat(v.offset[ids] - (np.cumsum(piece) - piece), piece) + np.arange(int(piece.sum()))] if len(ids) else np.zeros(0, np.uint8)
    got_off = np.concatenate([[0], np.cumsum(piece)])[np.concatenate([[0], np.cumsum(lengths)])]
    for k, (i, d, x, lp, inc) in enumerate(flat):
        a, b = got_off[k], got_off[k + 1]
        same = b - a == off[i + 1] - off[i] and np.array_equal(got[a:b], full[off[i] : off[i + 1]])
        out.append((i, d, x, lp, inc, bool(same)))
    return out


def encode(docs: DataFrame, draws: int = DRAWS, seed: int = SEED, model_path: str = MODEL_PATH, ids: bool = True) -> DataFrame:
    """One row per document and draw: doc_id, draw, n_pieces, log_prob, inclusion, ids_sha256, decoded, and ids if asked.

    A row's draws depend on its doc_id, its text and the seed alone: repeated rows draw
    the same. A null doc_id has the key 0. Other columns are ignored; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Pieces.load(model_path)
        for whole in batches:
            for b in slices(whole, BATCH_BYTES):
                keys = b.column("key").fill_null(0).to_numpy(zero_copy_only=False)
                rows = sample_batch(v, b.column("text"), keys, draws, seed)
                cols = {
                    "doc_id": b.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                    "draw": pa.array([r[1] for r in rows], pa.int32()),
                    "n_pieces": pa.array([len(r[2]) for r in rows], pa.int64()),
                    "log_prob": pa.array([round(r[3], 6) for r in rows], pa.float64()),
                    "inclusion": pa.array([r[4] for r in rows], pa.float64()),
                    "ids_sha256": pa.array([hashlib.sha256(r[2].astype("<i4").tobytes()).hexdigest() for r in rows], pa.string()),
                    "decoded": pa.array([r[5] for r in rows], pa.bool_()),
                }
                if ids:
                    flat = np.concatenate([r[2] for r in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32), pa.array(flat))
                yield pa.record_batch(cols)

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, draw int, n_pieces bigint, log_prob double, inclusion double, ids_sha256 string, decoded boolean" + ", ids array<int>" * ids
    return docs.selectExpr("doc_id", "cast(doc_id as bigint) as key", "cast(text as string) as text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, draw, text) from the ids of encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Pieces.load(model_path)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), b.column("draw"), pa.array([v.decode(x) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "draw", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "draw", "ids").mapInArrow(run, f"doc_id {kind}, draw int, text string")
