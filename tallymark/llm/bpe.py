"""Byte-level BPE encoding and decoding, long texts by concatenation of a tree of pieces.

A text of more than LEAF characters is halved until no piece is longer. The pieces are
rows of their own and encoded in parallel, wherever they cut; then neighbours are joined, level
by level. At a join the end of the left piece and the start of the right one are encoded again
as one window, which grows until it agrees exactly with both sides:

- on the left it begins where the library has parted words far enough from the end for
  nothing after it to matter, or, inside one long word, its first tokens are the old ones;
- on the right it parts words where the right piece does, far enough from the window's end, or,
  inside one long word, its last tokens are the old ones.

Words are parted by a scan that remembers nothing but its place and looks ahead by a few characters, or to the end of
a run of one class of characters. Within a word, tokens are its encoding if every two neighbours
are the encoding of the two. So the joined tokens are those of the whole text, special tokens included.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

VOCABULARY_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of a piece that is encoded at once, and pieces that one task joins.
LEAF, FAN = 1 << 15, 8
#: Tokens of a window's first try on each side, tokens that must agree, bytes by which parted words must lie from an end.
WINDOW, AGREE, MARGIN = 64, 4, 64
#: Bytes of text that are handled at once, and stretches whose ids are kept by a worker.
BATCH_BYTES, KEPT = 1 << 20, 1 << 19
#: Words are parted here whatever comes before and after.
_SURE = re.compile(r"(?<=\S)(?=[\t-\r ])")


class Vocabulary:
    """A vocabulary file of the tokenizers library; one for each file and worker."""

    _cache: dict = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls._cache:
            cls._cache[path] = cls(path)
        return cls._cache[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work out
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            setup = json.load(f)
        kinds = setup["model"]["type"], (setup["pre_tokenizer"] or {}).get("type"), (setup["decoder"] or {}).get("type")
        if kinds != ("BPE", "ByteLevel", "ByteLevel") or setup["normalizer"] or setup["pre_tokenizer"]["add_prefix_space"] or not setup["pre_tokenizer"]["use_regex"]:
            raise ValueError(f"{path} is no byte-level BPE without normalization")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        # Characters below 256 stand for the byte of their number, the others for the bytes that are left, in order.
        signs = sorted(ByteLevel.alphabet())
        own = {c: ord(c) for c in signs if ord(c) < 256}
        own |= zip((c for c in signs if ord(c) >= 256), (b for b in range(256) if chr(b) not in own))
        special = {t["id"] for t in setup["added_tokens"]}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        top = max(vocab.values()) + 1
        self.raw = [b""] * top
        for token, i in vocab.items():
            self.raw[i] = token.encode() if i in special or any(c not in own for c in token) else bytes(own[c] for c in token)
        self.length = np.array([len(x) for x in self.raw], np.int64)
        #: Whether a token begins at the start of a character.
        self.head = np.array([not x or x[0] & 0xC0 != 0x80 for x in self.raw])
        self.name = [str(i) for i in range(top)]
        self.kept: dict[str, tuple[int, ...]] = {}

    def ids(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, by stretches between places where words are surely parted; repeated ones are looked up."""
        cut = [_SURE.split(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.kept)
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = set(chain.from_iterable(cut))
        new = list(new)
        kept = self.kept
        kept.update(zip(new, (tuple(e.ids) for e in self.tok.encode_batch_fast(new, add_special_tokens=False))))
        for x in cut:
            yield list(chain.from_iterable(map(kept.__getitem__, x)))

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and whether each begins a parted word."""
        e = self.tok.encode(text, add_special_tokens=False)
        word = np.array(e.word_ids, np.int64)
        return np.array(e.ids, np.int32), np.concatenate([np.ones(min(len(word), 1), bool), word[1:] != word[:-1]])

    def bytes_of(self, ids) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids])

    def decode(self, ids) -> bytes:
        """UTF-8 of the decoded text; bytes that are none become replacement characters, unknown ids nothing."""
        top = len(self.raw)
        out = self.bytes_of([i for i in ids if 0 <= i < top])
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode(errors="replace").encode()
        return out

    def _left_edge(self, ids: np.ndarray, starts: np.ndarray, most: int) -> tuple[int, bool]:
        """Where a window begins in the left tokens, and whether nothing to the right can change what is before it."""
        low = len(ids) - most
        if low <= 0:
            return 0, True
        far = np.cumsum(self.length[ids[low:]][::-1])[::-1] >= MARGIN
        sure = np.flatnonzero(starts[low:] & far)
        if len(sure):
            return low + int(sure[-1]), True
        while low and not self.head[ids[low]]:
            low -= 1
        return low, low == 0

    def join(self, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of two texts laid end to end, from the tokens of each."""
        (li, ls), (ri, rs) = left, right
        if not len(li) or not len(ri):
            return right if len(ri) else left
        a = b = WINDOW
        while True:
            x, ok = self._left_edge(li, ls, a)
            y = min(b, len(ri))
            while y < len(ri) and not self.head[ri[y]]:
                y += 1
            tail, head = self.bytes_of(li[x:]), self.bytes_of(ri[:y])
            w, ws = self.whole((tail + head).decode())
            ws[0] = ls[x]
            ok = ok or (len(li) - x >= AGREE and np.array_equal(w[:AGREE], li[x : x + AGREE]))
            end = self._right_end(w, ws, ri, rs, y, len(tail), len(tail) + len(head))
            if ok and end:
                i, j = end
                return np.concatenate([li[:x], w[:i], ri[j:]]), np.concatenate([ls[:x], ws[:i], rs[j:]])
            a, b = a if ok else 2 * a, b if end else 2 * b

    def _right_end(self, w, ws, ri, rs, y: int, join: int, total: int) -> tuple[int, int] | None:
        """(tokens of the window, tokens of the right piece) up to a place from which on the right piece's tokens hold."""
        if y == len(ri):
            return len(w), y
        at = np.cumsum(self.length[w]) - self.length[w]
        old = join + np.cumsum(self.length[ri[:y]]) - self.length[ri[:y]]
        new_starts, old_starts = np.flatnonzero(ws), np.flatnonzero(rs[:y])
        both = np.intersect1d(at[new_starts], old[old_starts])
        both = both[both <= total - MARGIN]
        if len(both):
            return int(np.searchsorted(at, both[0])), int(np.searchsorted(old, both[0]))
        last = [p[k] for p, k in ((at, new_starts), (old, old_starts)) if len(k)]
        run = all(p[-1] <= total - MARGIN for p in last)
        if run and y >= AGREE and np.array_equal(w[-AGREE:], ri[y - AGREE : y]):
            return len(w), y
        return None


def _halves(text: str, leaf: int) -> list[str]:
    """A text halved until no piece has more characters than leaf: a whole binary tree's leaves."""
    n = 1 << max(math.ceil(math.log2(len(text) / leaf)), 0) if text else 1
    while n > 1 and -(-len(text) // n) > leaf:
        n *= 2
    return [text[i * len(text) // n : (i + 1) * len(text) // n] for i in range(n)]


def _results(v: Vocabulary, ids: list, digest: bool) -> dict[str, pa.Array]:
    """n_tokens and either the ids or the digests."""
    n = pa.array([len(x) for x in ids], pa.int64())
    if not digest:
        flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
        off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return {"n_tokens": n, "ids": pa.ListArray.from_arrays(off, pa.array(flat))}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    name = v.name
    return {"n_tokens": n, "ids_sha256": pa.array([sha(",".join([name[i] for i in x]).encode()) for x in ids], pa.string()), "decoded_sha256": pa.array([sha(v.decode(x)) for x in ids], pa.string())}


def encode(docs: DataFrame, path: str = VOCABULARY_PATH, leaf: int = LEAF, fan: int = FAN, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids as the tokenizers library gives them with add_special_tokens=False.

    With digest there are ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the
    decoded text) instead of ids. Strings of special tokens in a text become these tokens, as in the library.
    Null texts count as empty and have no tokens; rows that repeat a doc_id, or have none, each
    give a row; an empty table gives none; columns besides doc_id and text are ignored. A text of any
    length is encoded in pieces, and its ids are one row in the end. path must be there on every executor.
    """
    if leaf < 1 or fan < 2 or fan & (fan - 1):
        raise ValueError("leaf must be positive and fan a power of two")
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens bigint, ids array<int>"
    names = [x.split()[0] for x in given.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for b in slices(whole, BATCH_BYTES):
                texts = [t or "" for t in b.column("text").to_pylist()]
                short = [i for i, t in enumerate(texts) if len(t) <= leaf]
                cols = _results(v, list(v.ids([texts[i] for i in short])), digest)
                none = pa.nulls(len(short), pa.int32())
                yield pa.record_batch({"doc_id": b.column("doc_id").take(pa.array(short, pa.int64())), "row": none.cast(pa.int64()), "node": none, "nodes": none, "piece": none.cast(pa.string())} | cols)
                for i, t in enumerate(texts):
                    if len(t) > leaf:
                        row += 1
                        pieces = _halves(t, leaf)
                        n = len(pieces)
                        empty = {k: pa.nulls(n, c.type) for k, c in cols.items()}
                        yield pa.record_batch({"doc_id": b.column("doc_id").take(pa.array([i] * n, pa.int64())), "row": pa.array([row] * n, pa.int64()), "node": pa.array(range(n), pa.int32()), "nodes": pa.array([n] * n, pa.int32()), "piece": pa.array(pieces, pa.string())} | empty)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        for b in batches:
            for k in range(b.num_rows):
                i, s = v.whole(b.column("piece")[k].as_py())
                one = b.slice(k, 1)
                yield pa.record_batch([one.column("doc_id"), one.column("row"), one.column("node"), pa.array([i.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], names=["doc_id", "row", "node", "ids", "starts"])

    def joined(t: pa.Table) -> pa.Table:
        v = Vocabulary.load(path)
        t = t.sort_by("node")
        level = [(np.frombuffer(i, np.int32), np.frombuffer(s, bool)) for i, s in zip(t.column("ids").to_pylist(), t.column("starts").to_pylist())]
        while len(level) > 1:
            level = [v.join(*level[k : k + 2]) for k in range(0, len(level), 2)]
        return pa.table({"doc_id": t.column("doc_id").slice(0, 1), "row": t.column("row").slice(0, 1), "node": t.column("up").slice(0, 1), "ids": pa.array([level[0][0].tobytes()], pa.binary()), "starts": pa.array([level[0][1].tobytes()], pa.binary())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        for b in batches:
            for k in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[k].as_py(), np.int32)
                yield pa.record_batch({"doc_id": b.column("doc_id").slice(k, 1)} | _results(v, [ids.tolist()], digest))

    first = scratch.save(docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(cut, f"doc_id {kind}, row bigint, node int, nodes int, piece string, {given}"))
    out = first.where("row is null").select("doc_id", *names)
    left = first.agg(F.max("nodes")).first()[0]
    if not left:
        return out
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = first.where("row is not null").select("doc_id", "row", "node", "piece").repartition(parts, "row", "node")
    tokens = pieces.mapInArrow(leaves, f"doc_id {kind}, row bigint, node int, ids binary, starts binary")
    while left > 1:
        up = F.shiftright("node", fan.bit_length() - 1).alias("up")
        tokens = tokens.select("*", up).groupBy("row", "up").applyInArrow(joined, f"doc_id {kind}, row bigint, node int, ids binary, starts binary")
        left = -(-left // fan)
    return out.unionByName(tokens.mapInArrow(finish, f"doc_id {kind}, {given}"))


def decode(encoded: DataFrame, path: str = VOCABULARY_PATH) -> DataFrame:
    """(doc_id, text) from the ids of encode(), as the library's decode with skip_special_tokens=False; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([v.decode(x or []).decode() for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
