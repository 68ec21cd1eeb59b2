"""Damage and least-cost repair of the structure of conversations.

A repaired conversation is empty or has role initials s?(ua)+. Rows are kept, given the role user or assistant, or
deleted, and empty turns are inserted. Turns are range-sorted and packed into segments of a
bounded number of rows, so that a conversation of any length is dealt over the table's partitions. Inside
hash-partitioned batches of segments one recursive DuckDB query advances all of them by one turn a step and keeps,
for each state of the grammar before the segment and at its present turn, the least cost with its audit. The tables of
neighbouring segments are then joined in rounds by the same recursion, a segment a step.

Keeping one audit for a state is enough: of two audits of equal cost over the same rows none is a proper beginning of
the other, since it would lack inserts alone, and those cost; so the order of the two stays whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BREAKS, Scratch

#: Rows and bytes of a segment, segments that are joined at once, characters of a text by which ranges are cut.
SEGMENT, SEGMENT_BYTES, FAN, PREFIX = 256, 1 << 20, 64, 200
DELETE, REROLE, INSERT, CUT_OFF = 3, 2, 2, 1
_BLANKS = "".join(map(chr, BREAKS))
#: States of the grammar: nothing yet, after s, after u, after a. From each the role that an insert or a new role has.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLES = {USER: "user", ASSISTANT: "assistant"}


class Repair(NamedTuple):
    """report: a row for each conversation; turns: its repaired turns."""

    report: DataFrame
    turns: DataFrame


def _inserts(state: int) -> list[tuple[int, str]]:
    """States that inserts lead to, each by the fewest."""
    out = [(state, "")]
    while (to := _NEXT[out[-1][0]]) not in [s for s, _ in out]:
        out.append((to, out[-1][1] + "I"))
    return out


def moves() -> list[tuple[int, str, int, int, str]]:
    """(state, kind of row, state after it, cost, edits): inserts before the row, then its edit.

    Kinds are s, u, a and o (another) by the initial of the role, upper-case where the text is cut off, x for rows that
    must go. A row is deleted before inserts rather than after them: D is less than I.
    """
    out = []
    for state in range(4):
        out += [(state, k, state, DELETE, "D") for k in "suaoSUAOx"]
        for at, letters in _inserts(state):
            cost = INSERT * len(letters)
            for k in "suao":
                for kind, more in ((k, 0), (k.upper(), CUT_OFF)):
                    if (k == "s" and at == EMPTY) or (k == "u" and at != USER) or (k == "a" and at == USER):
                        out.append((state, kind, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[k], cost + more, letters + "K"))
                    out.append((state, kind, _NEXT[at], cost + REROLE + more, letters + "R"))
    return out


def endings() -> list[tuple[int, int, str]]:
    """(state, cost, edits) of the inserts that make a conversation whole."""
    return [(EMPTY, 0, "")] + [(s, INSERT * len(x), x) for s in (SYSTEM, USER, ASSISTANT) for to, x in _inserts(s) if to == ASSISTANT]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage by crc32 of conv_id:turn modulo 20, equal rows once with their number."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(hit == 4, "user").otherwise(text("role")).alias("role"), F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"), F.when(hit == 3, 2).otherwise(1).alias("n"), hit.alias("hit"))
    return c.where("hit <> 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _seen(rows: DataFrame) -> DataFrame:
    """rows with `again`: whether role and text are those of a row of an earlier turn."""
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    key = F.sha2(F.col("text").cast("binary"), 256)
    first = rows.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), key.alias("h"), order.alias("o")).groupBy("c", "r", "h")
    first = first.agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (key == F.col("h"))
    return rows.join(first, same, "left").select(*rows.columns, F.coalesce(order != F.col("o"), F.lit(False)).alias("again"))


_SEGMENT = "seg bigint, kinds string, kept array<struct<role:string,text:string>>, first_turn bigint, last_turn bigint, turns bigint, least bigint, most bigint, first_initial string, last_initial string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_LEGAL = {"su", "ua", "au"}


class _Open:
    """The segment that is being filled."""

    def __init__(self, conv, turn, initial):
        self.conv, self.kinds, self.kept, self.bytes, self.size = conv, [], [], 0, 0
        self.first_turn, self.last_turn, self.turns, self.first_initial, self.last_initial = turn, turn, int(turn is not None), initial, None
        self.least = self.most = turn
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, kind: str, turn, initial: str, n: int = 1) -> None:
        if self.last_initial is not None:
            self.illegal += self.last_initial + initial not in _LEGAL
        self.illegal += n - 1  # no initial follows itself
        if turn is not None:
            self.turns += turn != self.last_turn
            self.least, self.most = turn if self.least is None else self.least, turn
        self.last_turn, self.last_initial = turn, initial
        self.kinds.append(kind * n)
        self.size += n

    def row(self, seg: int) -> tuple:
        return (self.conv, seg, "".join(self.kinds), self.kept, self.first_turn, self.last_turn, self.turns, self.least, self.most, self.first_initial, self.last_initial, self.blank, self.duplicate, self.truncated, self.illegal)


def _pack(most_rows: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of rows sorted by conversation and turn; their numbers rise with the order of the rows."""
        number, now, kind = TaskContext.get().partitionId() << 33, None, None
        done: list[tuple] = []
        held = 0
        types = [pa.int64(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), *[pa.int64()] * 5, *[pa.string()] * 2, *[pa.int64()] * 4]
        names = ["conv_id", *[c.strip().split(" ")[0] for c in _SEGMENT.replace("role:string,text:string", "").split(",")]]

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), [kind, *types])], names=names)

        for b in batches:
            kind = b.column("conv_id").type
            for conv, turn, role, text, n, again in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "again"))):
                initial, solid = role[:1], text.strip(_BLANKS)
                blank = not solid
                gone = n if blank or again else n - 1
                while n:
                    if now is None or now.conv != conv or now.size >= most_rows or now.bytes >= most_bytes:
                        if now is not None:
                            done.append(now.row(number))
                            held += now.bytes
                            number += 1
                        now = _Open(conv, turn, initial)
                        if len(done) >= 1000 or held >= 4 * most_bytes:
                            yield out()
                            done, held = [], 0
                    if n > gone:  # the first of equal rows
                        cut = solid[-1] not in ".!?"
                        k = initial if initial and initial in "sua" else "o"
                        now.add(k.upper() if cut else k, turn, initial)
                        now.truncated += cut
                        now.kept.append({"role": role, "text": text})
                        now.bytes += len(role) + len(text)
                        take = 1
                    else:
                        take = min(n, most_rows - now.size)
                        now.add("x", turn, initial, take)
                        if blank:
                            now.blank += take
                        else:
                            now.duplicate += take
                    n -= take
        if now is not None:
            done.append(now.row(number))
        if done:
            yield out()

    return run


#: Each step joins what has been reached with the moves from there; only the last step's rows have their place.
_WALK = """
WITH RECURSIVE walk(id, start, state, pos, best) USING KEY (id, start, state) AS (
  SELECT id, s::INT, s::INT, 0, {{'c': 0::BIGINT, 'a': ''}} FROM walks, range(4) t(s) WHERE NOT lead OR s = 0
  UNION
  SELECT w.id, w.start, m.after, w.pos + 1, min({{'c': w.best.c + m.cost, 'a': w.best.a || m.edits}}) FROM walk w {steps} GROUP BY ALL)
SELECT id, start, state, best.c AS cost, best.a AS audit FROM walk JOIN walks USING (id) WHERE pos = n"""
_TURNS = _WALK.format(steps="JOIN walks g ON g.id = w.id AND w.pos < g.n JOIN moves m ON m.state = w.state AND m.kind = g.kinds[w.pos + 1]")
_SEGMENTS = _WALK.format(steps="JOIN moves m ON m.id = w.id AND m.pos = w.pos AND m.state = w.state")


def _connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("SET temp_directory = ''")
    return con


def _walk_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, idx, many, start, state, cost, audit) of segments (conv_id, idx, many, kinds)."""
    con = _connection()
    columns = list(zip(*moves()))
    con.register("moves", pa.table(dict(zip(("state", "kind", "after", "cost", "edits"), (pa.array(columns[0], pa.int32()), pa.array(columns[1]), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4]))))))
    for b in batches:
        n = pa.array([len(k) for k in b.column("kinds").to_pylist()], pa.int32())
        con.register("walks", pa.table({"id": pa.array(range(b.num_rows), pa.int64()), "kinds": b.column("kinds"), "n": n, "lead": pa.array(np.asarray(b.column("idx")) == 0)}))
        t = con.sql(_TURNS).to_arrow_table()
        of = t.column("id").combine_chunks()
        yield from pa.table([*(b.column(c).take(of) for c in ("conv_id", "idx", "many")), t.column("start"), t.column("state"), t.column("cost"), t.column("audit").cast(pa.string())], names=["conv_id", "idx", "many", "start", "state", "cost", "audit"]).to_batches()


def _walk_segments(t: pa.Table) -> pa.Table:
    """The same of neighbouring segments of one conversation as one."""
    if not t.num_rows:
        return t.select(["conv_id", "up", "start", "state", "cost", "audit"])
    con = _connection()
    idx = np.asarray(t.column("idx"))
    con.register("moves", pa.table({"id": pa.array(np.zeros(len(idx), np.int64)), "pos": pa.array((idx - idx.min()).astype(np.int32)), "state": t.column("start"), "after": t.column("state"), "cost": t.column("cost"), "edits": t.column("audit")}))
    con.register("walks", pa.table({"id": pa.array([0], pa.int64()), "n": pa.array([int(idx.max() - idx.min()) + 1], pa.int32()), "lead": pa.array([bool(idx.min() == 0)])}))
    w = con.sql(_SEGMENTS).to_arrow_table()
    one = lambda c: pa.chunked_array([t.column(c).combine_chunks().take(pa.array([0] * w.num_rows, pa.int64()))])
    return pa.table([one("conv_id"), one("up"), w.column("start"), w.column("state"), w.column("cost"), w.column("audit").cast(pa.string())], names=["conv_id", "up", "start", "state", "cost", "audit"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seg, alone, state, edits): each segment's part of its conversation's audit and the state before it."""
    for b in batches:
        out = []
        for audit, segments in zip(b.column("audit").to_pylist(), b.column("segments").to_pylist()):
            a = np.frombuffer(audit.encode(), np.uint8)
            used, made = np.cumsum(a != ord("I")), np.cumsum(a != ord("D"))
            rows = np.cumsum([len(s["kinds"]) for s in segments])
            ends = np.searchsorted(used, rows) + 1
            ends[-1] = len(a)
            system = 0
            if len(made) and made[-1]:
                at = int(np.searchsorted(made, 1))
                if a[at] == ord("K"):
                    k = int(np.searchsorted(rows, used[at]))
                    system = int(segments[k]["kinds"][int(used[at]) - 1 - (int(rows[k - 1]) if k else 0)] in "sS")
            begin = 0
            for s, end in zip(segments, ends.tolist()):
                e = int(made[begin - 1]) if begin else 0
                state = EMPTY if not e else SYSTEM if system and e == 1 else USER if (e - system) % 2 else ASSISTANT
                out.append((s["seg"], len(segments) == 1, state, audit[begin:end]))
                begin = end
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.bool_(), pa.int32(), pa.string()))], names=["seg", "alone", "state", "edits"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of segments from their edits."""
    for b in batches:
        made = []
        for kinds, kept, state, edits in zip(*(b.column(c).to_pylist() for c in ("kinds", "kept", "state", "edits"))):
            row = of_kept = 0
            out = []
            for x in edits:
                kind = "" if x == "I" else kinds[row]
                given = kept[of_kept] if kind not in ("", "x") else None
                row, of_kept = row + bool(kind), of_kept + (given is not None)
                if x == "D":
                    continue
                to = SYSTEM if x == "K" and kind in "sS" else _NEXT[state]
                out.append({"edit": x, "role": given["role"] if x == "K" else _ROLES[to], "text": "" if x == "I" else given["text"]})
                state = to
            made.append(out)
        yield pa.record_batch([b.column("conv_id"), b.column("seg"), b.column("alone"), pa.array(made, pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])))], names=["conv_id", "seg", "alone", "made"])


def _hash_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, sha) of lines sorted by conversation and segment, one segment at a time; segments without turns have null lines."""
    now, first, sha, kind = None, True, None, None
    row = lambda: pa.record_batch([pa.array([now], kind), pa.array([sha.hexdigest()])], names=["conv_id", "sha"])
    for b in batches:
        kind = b.column("conv_id").type
        for conv, lines in zip(b.column("conv_id").to_pylist(), b.column("lines").to_pylist()):
            if sha is None or conv != now:
                if sha is not None:
                    yield row()
                now, first, sha = conv, True, hashlib.sha256()
            if lines is not None:
                sha.update((lines if first else "\n" + lines).encode())
                first = False
    if sha is not None:
        yield row()


def _walked(scratch: Scratch, numbered: DataFrame, kind: str, fan: int) -> DataFrame:
    """(conv_id, cost, audit) of whole conversations from their numbered segments, written."""
    made = "start int, state int, cost bigint, audit string"
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.select("conv_id", "idx", "many", "kinds").repartition(parts, "conv_id", "idx")
    turns = scratch.save(dealt.mapInArrow(_walk_turns, f"conv_id {kind}, idx bigint, many boolean, {made}"))
    whole, long = turns.where("not many").drop("many"), turns.where("many").drop("many")
    left = (numbered.agg(F.max("idx")).first()[0] or 0) + 1
    while left > 1:
        up = (F.col("idx") / fan).cast("bigint").alias("up")
        long = long.select("*", up).groupBy("conv_id", "up").applyInArrow(_walk_segments, f"conv_id {kind}, up bigint, {made}").withColumnRenamed("up", "idx")
        left = -(-left // fan)
    walks = whole.unionByName(long)
    cost = edits = F.lit(None)
    for s, c, x in endings():
        cost, edits = F.when(F.col("state") == s, c).otherwise(cost), F.when(F.col("state") == s, x).otherwise(edits)
    best = F.min(F.struct((F.col("cost") + cost).alias("cost"), F.concat("audit", edits).alias("audit")))
    best = scratch.save(walks.groupBy("conv_id").agg(best.alias("b")).select("conv_id", "b.cost", "b.audit"))
    scratch.drop(turns)
    return best


def repair(conversations: DataFrame, segment: int = SEGMENT, fan: int = FAN, segment_bytes: int = SEGMENT_BYTES) -> Repair:
    """The report and the repaired turns of conversations (conv_id, turn, role, text) after damage.

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of the input; a null
    one is a conversation too. turns: conv_id, seg, place (in the order of the two), edit (K, R or I), role, text.
    Null roles and texts count as one space. Rows of one conversation are taken by turn, nulls first; those of
    one turn by role and text, so that repeated rows are next to each other. A conversation without rows after
    damage has zeros, an empty audit and the hash of nothing. Further columns are ignored; an empty
    table gives no rows. A conversation's audit is one value in the end, and its repaired text is hashed by one task, a segment at a time.
    """
    scratch = Scratch(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = scratch.save(damaged(conversations))
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = _seen(rows).repartitionByRange(parts, *by, F.substring("text", 1, PREFIX)).sortWithinPartitions(*by, "text")
    segs = scratch.save(sorted_rows.mapInArrow(_pack(segment, segment_bytes), f"conv_id {kind}, {_SEGMENT}"))
    scratch.drop(rows)
    w = Window.partitionBy("conv_id").orderBy("seg")
    before = F.lag("last_initial").over(w)
    across = (before.isNotNull() & ~F.concat(before, "first_initial").isin(*_LEGAL)).cast("long")
    again = F.coalesce(F.lag("last_turn").over(w) == F.col("first_turn"), F.lit(False)).cast("long")
    numbered = segs.drop("kept").select("*", (F.row_number().over(w) - 1).cast("long").alias("idx"), (F.count(F.lit(1)).over(Window.partitionBy("conv_id")) > 1).alias("many"), (F.col("illegal") + across).alias("all_illegal"), (F.col("turns") - again).alias("all_turns"))
    numbered = scratch.save(numbered)
    total = lambda c, name: F.sum(c).alias(name)
    stats = numbered.groupBy("conv_id").agg(
        F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("all_turns"), F.lit(0)).alias("gaps"), total("blank", "blank"), total("duplicate", "duplicate"), total("truncated", "truncated"), total("all_illegal", "illegal")
    )
    walked = _walked(scratch, numbered, kind, fan)
    lists = numbered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "seg", "kinds"))).alias("segments"))
    both = lists.withColumnRenamed("conv_id", "c").join(walked, F.col("c").eqNullSafe(F.col("conv_id")))
    pieces = both.select("audit", "segments").mapInArrow(_pieces, "seg bigint, alone boolean, state int, edits string")
    made = segs.select("conv_id", "seg", "kinds", "kept").join(pieces, "seg").mapInArrow(_apply, f"conv_id {kind}, seg bigint, alone boolean, made array<struct<edit:string,role:string,text:string>>")
    made = scratch.save(made)
    scratch.drop(segs)
    lines = F.array_join(F.transform("made", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    alone = made.where("alone").select("conv_id", F.sha2(lines.cast("binary"), 256).alias("sha"))
    long = made.where("not alone").select("conv_id", "seg", F.when(F.size("made") > 0, lines).alias("lines")).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seg")
    hashes = alone.unionByName(long.mapInArrow(_hash_segments, f"conv_id {kind}, sha string"))
    all_ = conversations.select("conv_id").distinct()
    for part in (stats, walked, hashes):
        all_ = all_.unionByName(part, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    report = all_.groupBy("conv_id").agg(*map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    turns = made.select("conv_id", "seg", F.posexplode("made").alias("place", "t")).select("conv_id", "seg", "place", "t.edit", "t.role", "t.text")
    return Repair(report, turns)


def report_sql() -> str:
    """DuckDB SQL for the report over the table conversations."""
    lines = {USER: "user:\n", ASSISTANT: "assistant:\n"}

    def made(state: int, edits: str) -> tuple[str, str]:
        """Lines that the inserts add, and the role that a new role is."""
        text = ""
        for x in edits:
            if x == "I":
                state = _NEXT[state]
                text += lines[state]
        return text, _ROLES[_NEXT[state]]

    rows = lambda values: ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v + "'" for v in r) + ")" for r in values)
    return rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, range(2) r(k) WHERE hit <> 0 AND (k = 0 OR hit = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial FROM n),
x AS MATERIALIZED (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(k) ELSE k END AS kind,
  rn > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS k FROM f)),
moves(state, kind, after, cost, edits, inserted, new_role) AS (VALUES {rows((*m, *made(m[0], m[4])) for m in moves())}),
ends(state, cost, edits, inserted) AS (VALUES {rows((*e, made(e[0], e[2])[0]) for e in endings())}),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM x GROUP BY conv_id),
walk(conv_id, pos, state, best) AS (SELECT conv_id, 0::BIGINT, 0, {{'c': 0::BIGINT, 'a': '', 't': ''}} FROM s
  UNION ALL
  SELECT w.conv_id, w.pos + 1, m.after, min({{'c': w.best.c + m.cost, 'a': w.best.a || m.edits, 't': w.best.t || m.inserted || CASE right(m.edits, 1) WHEN 'D' THEN '' WHEN 'K' THEN x.role || ':' || x.text || chr(10) ELSE m.new_role || ':' || x.text || chr(10) END}})
  FROM walk w JOIN x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.rn = w.pos + 1 JOIN moves m ON m.state = w.state AND m.kind = x.kind GROUP BY ALL),
b AS (SELECT s.*, min({{'c': w.best.c + e.cost, 'a': w.best.a || e.edits, 't': w.best.t || e.inserted}}) AS best FROM s JOIN walk w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.pos = s.n JOIN ends e ON e.state = w.state GROUP BY ALL)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""
