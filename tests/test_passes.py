"""Passes as a stateful stream: flips, unchanged content, timers, restarts, a state to begin with."""

import pytest
from pyspark.sql import functions as F

from tallymark.streaming import passes

SCHEMA = "entity_id string, at timestamp, pass long, score double, dead boolean, hash string, attributes string, newest timestamp"
DAYS = {1: "2024-01-01", 2: "2024-01-06", 3: "2024-01-11", 4: "2024-01-20"}
ROWS = [
    # Up by hysteresis only, unchanged content, down, dead.
    ("a", 1, 48.0, False, "x", "one"), ("a", 2, 54.0, False, "y", "two"), ("a", 3, 90.0, False, "y", "lost"), ("a", 4, 90.0, False, "z", None),
    ("b", 1, 85.0, None, "x", "b1"), ("b", 2, None, False, "y", "b2"), ("b", 4, 60.0, True, "q", "b4"),
    ("c", 1, 60.0, False, None, "c1"), ("c", 3, 20.0, False, None, "c3"),
    ("d", 2, 30.0, False, "x", "d2"), (None, 2, 30.0, False, "x", "n"),
]


def frame(spark, rows):
    made = [(e, f"{DAYS[p]} 00:00:00", p, s, d, h, a, None if e == "d" else f"{DAYS[p]} 00:00:00") for e, p, s, d, h, a in rows]
    kinds = SCHEMA.replace("at timestamp", "at string").replace("newest timestamp", "newest string")
    return spark.createDataFrame(made, kinds).withColumn("at", F.col("at").cast("timestamp")).withColumn("newest", F.col("newest").cast("timestamp"))


def made(spark, out):
    return sorted((r.kind, r.entity_id, r["pass"], r.band, r.flip_from, r.changed, r.attributes, r.tier, r.due and str(r.due)[:10]) for r in spark.read.parquet(out).collect())


WANT = sorted([
    ("pass", "a", 1, "candidate", None, True, "one", "active", "2024-01-08"), ("pass", "a", 2, "candidate", None, True, "two", "active", "2024-01-13"),
    ("pass", "a", 3, "candidate", None, False, "two", "active", "2024-01-18"), ("pass", "a", 4, "leader", "candidate", True, None, "active", "2024-01-27"),
    ("pass", "b", 1, "leader", None, True, "b1", "active", "2024-01-08"), ("pass", "b", 2, "leader", None, True, "b2", "active", "2024-01-13"),
    ("pass", "b", 4, "unverified", "leader", True, "b4", "dead", None),
    ("pass", "c", 1, "contender", None, True, "c1", "active", "2024-01-08"), ("pass", "c", 3, "contender", None, False, "c1", "active", "2024-01-18"),
    ("pass", "d", 2, "candidate", None, True, "d2", "stable", "2024-03-06"),
    ("due", "c", 3, "contender", None, None, None, "active", "2024-01-18"),
], key=lambda r: r)


def test_passes_go_on_after_each_stop(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    for p in DAYS:
        frame(spark, [r for r in ROWS if r[1] == p]).write.mode("append").parquet(src)
        passes.refresh(spark, src, SCHEMA, out, check)
    assert made(spark, out) == WANT
    # Nothing new, and a pass that all have seen: no rows.
    passes.refresh(spark, src, SCHEMA, out, check)
    frame(spark, [("a", 4, 10.0, False, "zz", "late")]).write.mode("append").parquet(src)
    passes.refresh(spark, src, SCHEMA, out, check)
    assert made(spark, out) == WANT
    # All passes at once: the same states, whose timers run at the end.
    passes.refresh(spark, src, SCHEMA, f"{out}2", f"{check}2")
    assert [r for r in made(spark, f"{out}2") if r[0] == "pass"] == [r for r in WANT if r[0] == "pass"]
    assert [r for r in made(spark, f"{out}2") if r[0] == "due"] == [r for r in WANT if r[0] == "due"]


def test_state_to_begin_with(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    initial = spark.createDataFrame([("a", 1, "leader", "y", "kept", "active"), ("b", 9, "leader", "x", None, "active")], "entity_id string, pass long, band string, hash string, attributes string, tier string")
    frame(spark, [r for r in ROWS if r[1] == 2 and r[0] in ("a", "b")]).write.parquet(src)
    passes.refresh(spark, src, SCHEMA, out, check, initial=initial)
    assert made(spark, out) == [("pass", "a", 2, "leader", None, False, "kept", "active", "2024-01-13")]


@pytest.mark.parametrize("rows", [[], [(None, 1, 1.0, False, "x", "y")]])
def test_no_entities(spark, tmp_path, rows):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    frame(spark, rows).write.parquet(src)
    passes.refresh(spark, src, SCHEMA, out, check)
    assert spark.read.schema("kind string").parquet(out).count() == 0


def test_a_pass_asks_the_state_store_few_times():
    """One value is read and written for each entity and micro-batch, and timers are not listed."""
    from pyspark.sql import Row

    from tallymark.config import BandConfig, SnapshotConfig

    calls, kept = [], {}

    class Store:
        def getValueState(self, name, schema):
            self.name = name
            return self

        def get(self):
            calls.append("get")
            return kept.get("v")

        def update(self, v):
            calls.append("update")
            kept["v"] = v

        def deleteTimer(self, t):
            calls.append(("delete", t))

        def registerTimer(self, t):
            calls.append(("register", t))

    p = passes._Passes(BandConfig(), SnapshotConfig())
    p.init(Store())
    r = Row("number", "score", "dead", "hash", "attributes", "at_ms", "newest_ms")
    got = list(p.handleInputRows(("e",), iter([r(2, float("nan"), False, "y", None, 20, None), r(1, 90.0, False, "x", "o", 10, 10)]), None))
    assert [(x["pass"], x["band"], x["flip_to"]) for x in got] == [(1, "leader", None), (2, "leader", None)]
    stable = SnapshotConfig().stable_days * passes.DAY_MS
    assert calls == ["get", "update", ("register", 20 + stable)]
    calls.clear()
    assert [x["changed"] for x in p.handleInputRows(("e",), iter([r(3, 1.0, False, "y", "n", 30, None)]), None)] == [False]
    assert calls == ["get", "update", ("delete", 20 + stable), ("register", 30 + stable)]
    calls.clear()
    assert list(p.handleInputRows(("e",), iter([r(3, 1.0, False, "z", "n", 40, None)]), None)) == [] and calls == ["get"]
