"""Snapshots: fingerprints, differences, churn, wake-ups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashtree import content_counts
from .patterns import find_in_joined, find_names
from .running import written


def fingerprint(records: DataFrame, entity: str = "entity_id", content: str = "content") -> DataFrame:
    """(entity_id, hash): SHA-256 over the sorted contents of each entity; rows without an entity are left out.

    The hashes of an entity pass through one digest in order, so no row holds them all; hash trees (hashtree.py)
    have no such order and say which ranges have changed.
    """
    counts = content_counts(records, entity, content)
    kind = counts.schema["entity_id"].dataType.simpleString()
    return counts.repartition("entity_id").sortWithinPartitions("entity_id", "h").mapInArrow(_digests, f"entity_id {kind}, hash string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (entity_id, h, n) in order to (entity_id, hash), an entity when the next one begins."""
    digest, last, kind = None, None, None
    for batch in batches:
        kind, done = batch.schema.field("entity_id").type, []
        for e, h, n in zip(*(batch.column(c).to_pylist() for c in ("entity_id", "h", "n"))):
            if digest is not None and e != last:
                done.append((last, digest.hexdigest()))
                digest = None
            if digest is None:
                digest, last, n = hashlib.sha256(h.encode()), e, n - 1
            again = f"\n{h}".encode()
            for k in range(0, n, 4096):
                digest.update(again * min(4096, n - k))
        if done:
            yield _entities(done, kind)
    if digest is not None:
        yield _entities([(last, digest.hexdigest())], kind)


def _entities(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, hashes = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hashes, pa.string())], ["entity_id", "hash"])


def last_fingerprint(records: DataFrame, entity: str = "entity_id", content: str = "content", seq: str = "seq") -> DataFrame:
    """(entity_id, hash) of the content that comes last for each entity; rows without an entity are left out."""
    last = F.max_by(F.coalesce(F.col(content), F.lit("")), F.col(seq))
    return records.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity_id")).agg(F.sha2(last, 256).alias("hash"))


def changed(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """(entity_id, changed): new or with another hash; entities that are gone are not listed."""
    p = prev.select("entity_id", F.col("hash").alias("_p"))
    return cur.join(p, "entity_id", "left").select("entity_id", (F.col("_p").isNull() | (F.col("_p") != F.col("hash"))).alias("changed"))


def carry_forward(cur: DataFrame, prev: DataFrame, marks: DataFrame, attributes: list[str]) -> DataFrame:
    """cur with the attributes of prev where the entity has not changed."""
    p = prev.select("entity_id", *[F.col(a).alias(f"_{a}") for a in attributes])
    d = cur.join(marks, "entity_id", "left").join(p, "entity_id", "left")
    for a in attributes:
        d = d.withColumn(a, F.when(F.coalesce("changed", F.lit(True)), F.col(a)).otherwise(F.coalesce(F.col(f"_{a}"), F.col(a))))
    return d.drop("changed", *[f"_{a}" for a in attributes])


def priority(history: DataFrame, entity: str, at: str, now: Column) -> DataFrame:
    """(entity_id, priority): changes weighed by their age, halving every 30 days."""
    days = F.greatest(F.timestamp_diff("MICROSECOND", F.col(at), now) / F.lit(86400e6), F.lit(0.0))
    return history.groupBy(F.col(entity).alias("entity_id")).agg(F.sum(F.pow(F.lit(2.0), -days / 30)).alias("priority"))


def wake_on_spike(frozen: DataFrame, titles: DataFrame, title: str = "title") -> DataFrame:
    """Frozen entities (entity_id, name) that a title names by name or id, keyed by both.

    Each title is looked at for itself; mentions() looks at the titles as one text.
    """
    woken = _woken(frozen, find_names(titles.select(F.lower(title).alias("text")), _keys(frozen), ids=False)).where("woken")
    return woken.select(F.explode(F.array("entity_id", "name")).alias("woken")).distinct()


def mentions(frozen: DataFrame, titles: DataFrame, by: list[str], title: str = "title", order: str = "entity_id") -> DataFrame:
    """(key, woken): for each name and id of frozen entities (order, entity_id, name) whether the titles name the entity.

    The titles are taken as one text in the order of `by`, with a space between them, so a name may begin in one
    and end in another. A key of several entities has what the last of them by `order` has, of one entity's
    equal name and id the name. Empty and null keys are left out.
    """
    frozen = written(frozen.select(F.col(order).alias("_o"), "entity_id", "name"))
    found = written(find_in_joined(titles.select(*by, F.lower(title).alias("_title")), by, "_title", _keys(frozen)))
    w = _woken(frozen, found)
    w = w.select("_o", "woken", F.posexplode(F.array("entity_id", "name")).alias("kind", "key"))
    last = F.struct("_o", "kind", "woken")
    return w.where("key <> ''").groupBy("key").agg(F.max_by("woken", last).alias("woken"))


def _keys(frozen: DataFrame) -> DataFrame:
    return frozen.select(F.explode(F.array(F.lower("name"), F.lower("entity_id"))).alias("name")).where("name <> ''").distinct()


def _woken(frozen: DataFrame, found: DataFrame) -> DataFrame:
    """frozen with whether its name or its id was found."""
    by_name, by_id = (found.select(F.col("name").alias(c), F.lit(True).alias(f"{c}_found")) for c in ("_name", "_id"))
    f = frozen.join(by_name, F.lower("name") == F.col("_name"), "left").join(by_id, F.lower("entity_id") == F.col("_id"), "left")
    return f.select(*frozen.columns, F.coalesce("_name_found", "_id_found", F.lit(False)).alias("woken"))
