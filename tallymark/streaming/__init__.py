"""Stateful operators: band hysteresis over passes, and the token bucket as a fold over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BandConfig


def next_band(score: float, prev: str | None, dead: bool, cfg: BandConfig = BandConfig()) -> str:
    """The band rule of operators.evidence.assign_band for one row."""
    order = sorted(cfg.bands, key=lambda b: -b[1])
    if dead:
        return order[-1][0]
    plain = next((n for n, t in order if score >= t), order[-1][0])
    if prev is None:
        return plain
    least = dict(cfg.bands)
    a, b = least.get(prev, 0.0), least[plain]
    if a == b:
        return prev
    side = [n for n, t in order if (t > a if b > a else t < a) and score >= t + cfg.hysteresis]
    return side[0] if side else prev


def band_stream(scores: DataFrame, cfg: BandConfig = BandConfig()) -> DataFrame:
    """A streaming frame (entity_id, pass, score, dead) to (entity_id, pass, band, flip_from), state kept by entity.

    The passes of one micro-batch are taken in order; a pass that is not later than the last one seen is left out.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, prev = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("pass", kind="stable")
        out = []
        for p, score, dead in zip(rows["pass"], rows["score"], rows["dead"]):
            if seen is not None and p <= seen:
                continue
            band = next_band(float(score), prev, bool(dead), cfg)
            out.append((key[0], int(p), band, prev if prev is not None and prev != band else None))
            seen, prev = int(p), band
        if seen is not None:
            state.update((seen, prev))
        yield pd.DataFrame(out, columns=["entity_id", "pass", "band", "flip_from"])

    return scores.groupBy("entity_id").applyInPandasWithState(fold, "entity_id string, pass long, band string, flip_from string", "pass long, band string", "append", "NoTimeout")


def token_bucket(events: DataFrame, key: str, at: str, order: str, per_minute: float = 30.0) -> DataFrame:
    """events (key, at seconds, order) with `granted` from a bucket per key.

    The state depends on each answer before it, so this is a fold in order of time. Rows are dealt by key and sorted
    by Spark, and the state, two numbers, goes on from Arrow batch to Arrow batch: no key's history is held whole.
    A null key is a key. Events without a time are not granted and leave the bucket as it is.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last_key, tokens, last = False, None, per_minute, None
        for batch in batches:
            granted = []
            for k, t in zip(batch.column("_key").to_pylist(), batch.column("_at").to_pylist()):
                if not begun or k != last_key:
                    begun, last_key, tokens, last = True, k, per_minute, None
                if t is None:
                    granted.append(False)
                    continue
                if last is not None:
                    tokens = min(per_minute, tokens + (t - last) * per_minute / 60)
                last = t
                granted.append(tokens + 1e-9 >= 1)
                tokens -= granted[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(granted, pa.bool_())], [key, order, "granted"])

    e = events.select(key, order, F.col(at).cast("double").alias("_at"), F.to_json(F.struct(key)).alias("_key"))
    e = e.repartition("_key").sortWithinPartitions("_key", "_at", order)
    return e.mapInArrow(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, granted boolean")


def accumulate_stream(batch: DataFrame, store_path: str, keys: list[str]) -> None:
    """foreachBatch body: append the records of a micro-batch that the store lacks; the store only grows."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    try:
        store = spark.read.parquet(store_path).select(*keys)
        fresh = fresh.join(store, [fresh[k].eqNullSafe(store[k]) for k in keys], "left_anti")
    except Exception as e:  # the first batch finds no store
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").parquet(store_path)
