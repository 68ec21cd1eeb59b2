"""Passes over entities as a stateful stream: what an entity was at its last pass is the state that the next one needs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..config import BandConfig, SnapshotConfig
from . import next_band

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
_OUT = "kind string, entity_id string, pass long, band string, flip_from string, flip_to string, changed boolean, attributes string, tier string, due_ms long"
_COLUMNS = [c.split(" ")[0] for c in _OUT.split(", ")]
_Out = Row(*_COLUMNS)


def _order(r: Row) -> tuple:
    """By pass, time, hash and attributes, nulls last."""
    return (r["number"], *((True, 0) if r[c] is None else (False, r[c]) for c in ("at_ms", "hash", "attributes")))


class _Passes(StatefulProcessor):
    """Band, content and progress of one entity in one value, so that a pass asks the state store once, and a timer for its next crawl."""

    def __init__(self, cfg: BandConfig, snapshot: SnapshotConfig):
        self.cfg, self.snapshot = cfg, snapshot

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "pass long, band string, tier string, hash string, attributes string, due_ms long")

    def _tier(self, dead: bool, at_ms: int, newest_ms) -> tuple[str, int | None]:
        s = self.snapshot
        if dead:
            return "dead", None
        if newest_ms is not None and at_ms - newest_ms <= s.active_window_days * DAY_MS:
            return "active", s.active_days
        return "stable", s.stable_days

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.last.get()
        known = state is not None
        seen, band, tier, old_hash, old_attributes, timer = state if known else (None,) * 6
        due, begun = timer, False
        for r in sorted(rows, key=_order):
            number = int(r["number"])
            if seen is not None and number <= seen:
                continue
            changed = not known or r["hash"] != old_hash
            before, dead, score = band, bool(r["dead"]), r["score"]
            if changed:
                band = next_band(score if score is not None and score == score else 0.0, band, dead, self.cfg)
            attributes = r["attributes"] if changed else old_attributes if old_attributes is not None else r["attributes"]
            tier, days = self._tier(dead, r["at_ms"], r["newest_ms"])
            flip = before is not None and band != before
            due = None if days is None else r["at_ms"] + days * DAY_MS
            yield _Out("pass", key[0], number, band, before if flip else None, band if flip else None, changed, attributes, tier, due)
            seen, old_hash, old_attributes, known, begun = number, r["hash"], attributes, True, True
        if begun:
            self.last.update((seen, band, tier, old_hash, old_attributes, due))
            if timer is not None and timer != due:
                self.handle.deleteTimer(timer)
            if due is not None and timer != due:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen, band, tier, old_hash, old_attributes, _ = self.last.get()
        self.last.update((seen, band, tier, old_hash, old_attributes, None))
        yield _Out("due", key[0], seen, band, None, None, None, None, tier, expiredTimerInfo.getExpiryTimeInMs())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        self.last.update((int(r["number"]), r["band"], r["tier"], r["hash"], r["attributes"], None))

    def close(self) -> None:
        pass


def entity_passes(passes: DataFrame, cfg: BandConfig = BandConfig(), snapshot: SnapshotConfig = SnapshotConfig(), initial: DataFrame | None = None) -> DataFrame:
    """A stream (entity_id, at, pass, score, dead, hash, attributes, newest) to what each pass made of each entity.

    Rows of kind `pass`: an entity whose hash is that of its last pass keeps its band and its attributes; of any other the band
    follows from score, band before and hysteresis, and flips are told. tier and due come from the
    re-crawl plan. Rows of kind `due`: the time for the next crawl has come, by the watermark of `at`, and no later pass came
    before. A pass that is not later than an entity's last one is left out; of equal ones the first by `at`, hash and attributes counts. A
    null score is 0, a null dead false, a null entity_id is left out. initial (entity_id, pass, band, hash, attributes, tier) is the state to
    begin with. The session's state store must be RocksDB, as refresh() sets it. A task holds the passes of one entity in one micro-batch.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    p = passes.withWatermark("at", "0 seconds").where("entity_id is not null")
    p = p.select("entity_id", "at", F.col("pass").cast("long").alias("number"), F.col("score").cast("double").alias("score"), F.coalesce("dead", F.lit(False)).alias("dead"), "hash", "attributes", ms("at").alias("at_ms"), ms("newest").alias("newest_ms"))
    state = None if initial is None else initial.select("entity_id", F.col("pass").cast("long").alias("number"), "band", "hash", "attributes", "tier").groupBy("entity_id")
    out = p.groupBy("entity_id").transformWithState(_Passes(cfg, snapshot), _OUT, "append", "EventTime", state)
    return out.select(*_COLUMNS[:-1], F.timestamp_millis("due_ms").alias("due"))


def refresh(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, **options) -> None:
    """Take what is new in the folder `source` as passes and append what they make of the entities to `out`.

    State, progress and what was written are in `checkpoint`: a refresh that was cut off goes on where it was, and one without new files writes nothing.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        stream = entity_passes(spark.readStream.schema(schema).parquet(source), **options)
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
