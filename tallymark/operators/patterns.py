"""Many names looked for in many texts at once, by hashes of what names begin with and of whole names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_sum, written

#: Characters of a block of joined texts at least.
BLOCK = 4096
#: Bytes of the beginning of a name that are looked for everywhere: the most of these that the name has.
LEADS = (1, 2, 3, 4, 6, 8)
#: Bytes of a longer beginning, looked for where the first 8 bytes of a name are: the most of these that the name has.
LONGER = (12, 16, 24)
#: Bits of the number of a hash in the tables of beginnings and of whole names: the least, the most, and how many more than the number of names has.
BITS = ((16, 26, 4), (16, 28, 4))
#: Factors of a hash for its numbers in these tables.
FACTORS = ((1, 0xD6E8FEB86659FD93), (1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Bytes of texts taken at a time.
SLICE = 1 << 18
#: Bits of the number of a hash among the stretches that a task remembers to have given.
SEEN = 20
#: Characters to set in the place of what is left out of a text: one that no name has.
GAPS = [chr(k) for k in (*range(1, 9), *range(14, 32), *range(0xE000, 0xE010))]
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts end to end, their offsets, sums of a hash up to each byte, and the factor that brings a place to the first one."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    n = len(raw) + 1
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, SLICE + 1), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    sums = np.zeros(n, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS["up"][: n - 1], out=sums[1:])
    return raw, off - off[0], sums, _POWERS["down"]


def _has(tables: list[np.ndarray], kind: int, h: np.ndarray) -> np.ndarray:
    """Where the hashes are that have all their bits in the table, which has a power of two of bytes."""
    table, at = tables[kind], None
    for factor in FACTORS[kind]:
        n = (h if at is None else h[at] * np.uint64(factor)) >> np.uint64(62 - len(table).bit_length())
        some = np.flatnonzero(table[(n >> np.uint64(3)).view(np.int64)] >> (n.astype(np.uint8) & np.uint8(7)) & np.uint8(1))
        at = some if at is None else at[some]
    return at


def _whole(h: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """A hash of a name from that of its bytes and their number."""
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(size).astype(np.uint64) * np.uint64(0x94D049BB133111EB)


def _leads(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the beginning that is looked for everywhere, and of the longer one, for names of these sizes."""
    lead = np.array(LEADS)[np.searchsorted(LEADS, size, side="right") - 1]
    return lead, np.where(size < LONGER[0], lead, np.array(LONGER)[np.searchsorted(LONGER, size, side="right") - 1])


def _name_numbers(batches: Iterator[pa.RecordBatch], bits: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(kind, word, bits, size): the numbers of beginnings (kind 0) and of whole names (1) as bits of words; size is the name's."""
    for b in batches:
        _, off, sums, down = _layout(b.column("name"))
        size, at = np.diff(off), off[:-1]
        lead, longer = _leads(size)
        for kind, n in ((0, lead), (0, longer), (1, size)):
            h = (sums[at + n] - sums[at]) * down[at]
            for factor in FACTORS[kind]:
                number = (((_whole(h, size) if kind else h) * np.uint64(factor)) >> np.uint64(64 - bits[kind])).astype(np.int64)
                bit = (np.uint64(1) << (number & 63).astype(np.uint64)).view(np.int64)
                yield pa.record_batch({"kind": pa.array(np.full(len(size), kind, np.int32)), "word": pa.array(number >> 6), "bits": pa.array(bit), "size": pa.array(size)})


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")), at + 1)
        yield b.slice(at, to - at)
        at = to


def _hits(batches: Iterator[pa.RecordBatch], tables: list[np.ndarray], sizes: list[int], ids: bool, seen: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Stretches of texts with the number of a name: each once in a text, or without ids once as long as `seen` has its hash."""
    groups: dict[int, dict[int, list[int]]] = {}
    for size, lead, longer in zip(sizes, *_leads(np.array(sizes, np.int64))) if sizes else ():
        groups.setdefault(int(lead), {}).setdefault(int(longer), []).append(size)
    for whole in batches:
        for b in _slices(whole):
            raw, off, sums, down = _layout(b.column("text"))
            for lead, some in groups.items():
                places = max(len(raw) - lead + 1, 0)
                at = _has(tables, 0, (sums[lead:] - sums[:places]) * down[:places])
                for longer, own in some.items():
                    x = at
                    if longer > lead:
                        x = x[: np.searchsorted(x, len(raw) - longer, side="right")]
                        x = x[_has(tables, 0, (sums[x + longer] - sums[x]) * down[x])]
                    for size in own:
                        y = x[: np.searchsorted(x, len(raw) - size, side="right")]
                        h = _whole((sums[y + size] - sums[y]) * down[y], size)
                        found = _has(tables, 1, h)
                        y, h = y[found], h[found]
                        if seen is not None:
                            new = np.flatnonzero(seen[(h >> np.uint64(64 - SEEN)).view(np.int64)] != h)
                            y, h = y[new], h[new]
                        d = np.searchsorted(off, y, side="right") - 1
                        fits = np.flatnonzero((y + size <= off[d + 1]) & _characters(raw, y, size))
                        y, h, d = y[fits], h[fits], d[fits]
                        one = np.unique(h, return_index=True)[1] if not ids else _firsts(d, h)
                        if not len(one):
                            continue
                        y, h, d = y[one], h[one], d[one]
                        if seen is not None:
                            seen[(h >> np.uint64(64 - SEEN)).view(np.int64)] = h
                        stretches = np.ascontiguousarray(raw[y[:, None] + np.arange(size)])
                        names = pa.Array.from_buffers(pa.string(), len(y), [None, pa.py_buffer(np.arange(0, (len(y) + 1) * size, size, np.int32)), pa.py_buffer(stretches)])
                        yield pa.record_batch(({"id": b.column("id").take(pa.array(d))} if ids else {}) | {"name": names})


def _characters(raw: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Whether stretches of this size begin and end with whole characters; others are no names."""
    good = (raw[at] & 0xC0) != 0x80
    for back, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        if size >= back:
            good &= raw[at + size - back] < least
    return good


def _firsts(d: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each pair of a text and a hash is first."""
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    return order[np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))] if len(order) else order


def _none_seen() -> np.ndarray:
    """Room for a hash by its first bits; at first each place has one that belongs elsewhere."""
    return (np.arange(1 << SEEN, dtype=np.uint64) ^ np.uint64(1)) << np.uint64(64 - SEEN)


def _finder(names: DataFrame) -> tuple[DataFrame, int, str | None, Callable[[], Callable[..., Iterator[pa.RecordBatch]]]]:
    """The names each once, the characters of the longest one, a character that none has, and what finds their stretches in batches of texts.

    A name has some bits of its own in the tables, so stretches that are no names stay few at any number of names, up to some millions;
    the tables have 40 MB at most.
    """
    n = written(names.select("name").where("name <> ''").distinct())
    gaps = [F.coalesce(F.bool_or(F.col("name").contains(c)), F.lit(False)) for c in GAPS]
    count, longest, *has = n.agg(F.count("*"), F.coalesce(F.max(F.length("name")), F.lit(0)), *gaps).first()
    bits = tuple(min(max(count.bit_length() + more, least), most) for least, most, more in BITS)
    numbers = written(n.mapInArrow(lambda batches: _name_numbers(batches, bits), "kind int, word long, bits long, size long"))
    sizes = sorted(r[0] for r in numbers.select("size").distinct().collect())  # lengths of names
    tables = [np.zeros(1 << b >> 6, np.int64) for b in bits]
    words = numbers.groupBy("kind", "word").agg(F.bit_or("bits").alias("bits")).toArrow()  # no more than names or words of the tables
    kind, word, some = (words.column(c).to_numpy() for c in ("kind", "word", "bits"))
    for k in (0, 1):
        tables[k][word[kind == k]] = some[kind == k]
    packed = [t.tobytes() for t in tables]

    def finder() -> Callable[..., Iterator[pa.RecordBatch]]:
        t, seen = [np.frombuffer(p, np.uint8) for p in packed], _none_seen()
        return lambda batches, ids: _hits(batches, t, sizes, ids, None if ids else seen)

    return n, longest, next((c for c, h in zip(GAPS, has) if not h), None), finder


def find_names(texts: DataFrame, names: DataFrame, ids: bool = True) -> DataFrame:
    """(id, name): the names (name) that are somewhere in texts (id, text), letter for letter; without ids each (name) that is in any text.

    Texts are read once, where they lie. At each place the hash of what may be the beginning of a name is looked up in a table of bits, and where
    it is there, that of the whole name in another; the stretches found are joined with the names. The tables have some bits for each name
    and no names, so neither all names meet all texts nor is a list of names sent to every task. Empty and null names are nowhere. ids must not repeat.
    """
    n, _, _, finder = _finder(names)
    t = texts.select(*(["id"] if ids else []), "text").where("text <> ''")
    kind = f"id {t.schema['id'].dataType.simpleString()}, " if ids else ""
    found = t.mapInArrow(lambda batches: finder()(batches, ids), f"{kind}name string")
    return (found if ids else found.distinct()).join(n, "name").select(*(["id"] if ids else []), "name")


def find_in_joined(texts: DataFrame, by: list[str], text: str, names: DataFrame) -> DataFrame:
    """(name): the names (name) that are somewhere in the text that all texts make in the order of `by` with a space between them.

    Texts are read once, where they lie. What a name may share with other texts, one character less than the longest name from
    either end, is all that is put in order and joined, of longer texts with a character between that no name has.
    """
    n, longest, gap, finder = _finder(names)
    # Without such a character all texts go whole.
    ends = max(longest - 1, 0) if gap else 1 << 30
    t = texts.select(*by, F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for b in batches:
            whole = b.column("text")
            long = pc.greater(pc.utf8_length(whole), 2 * ends)
            first = pc.utf8_slice_codeunits(whole, 0, ends)
            last = pc.utf8_slice_codeunits(whole, -ends) if ends else first
            yield pa.record_batch([*(b.column(c) for c in by), pc.if_else(long, pc.binary_join_element_wise(first, last, gap or ""), whole), pa.nulls(b.num_rows, pa.string())], [*by, "text", "name"])
            for f in find([b.filter(long)], False):
                nulls = [pa.nulls(f.num_rows, b.schema.field(c).type) for c in (*by, "text")]
                yield pa.record_batch([*nulls, f.column("name")], [*by, "text", "name"])

    both = written(t.mapInArrow(run, ", ".join(f"`{c}` {t.schema[c].dataType.simpleString()}" for c in (*by, "text")) + ", name string"))
    joined = joined_blocks(both.where("name is null"), by, "text", longest).select("text")
    found = both.where("name is not null").select("name").union(joined.mapInArrow(lambda batches: finder()(batches, False), "name string"))
    return found.distinct().join(n, "name").select("name")


def joined_blocks(texts: DataFrame, by: list[str], text: str, longest: int, block: int = BLOCK) -> DataFrame:
    """(id, text): blocks of the text that all texts make in the order of `by` with a space between them.

    Each block goes on with the first longest - 1 characters of the next one, so what is no longer than
    `longest` lies in a block wherever it is. by must be a total order; a null text counts as empty.
    """
    block = max(block, longest)
    d = texts.select(*by, F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(" ")).alias("_t"))
    d = running_sum(d.withColumn("_n", F.length("_t").cast("long")), by, "_n", "_end")
    first = f"(_end - _n) div {block}"
    d = d.select("_t", (F.col("_end") - F.col("_n")).alias("_from"), F.expr(f"explode(sequence({first}, (_end - 1) div {block}))").alias("id"))
    begin = F.greatest(F.col("id") * block - F.col("_from"), F.lit(0))
    part = F.substring("_t", (begin + 1).cast("int"), (F.col("id") * block + block - F.col("_from") - begin).cast("int"))
    d = d.select("id", "_from", part.alias("part"))
    whole = d.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_from", "part"))), lambda p: p["part"]), "").alias("text"))
    whole = written(whole)
    after = whole.select((F.col("id") - 1).alias("id"), F.substring("text", 1, max(longest - 1, 0)).alias("_next"))
    return whole.join(after, "id", "left").select("id", F.concat("text", F.coalesce("_next", F.lit(""))).alias("text"))
