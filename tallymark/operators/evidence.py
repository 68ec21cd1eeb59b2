"""Evidence: percentiles, decay, scores, bands."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BandConfig
from ..functions import expr as x
from ..sources.store import BatchLog
from .running import running_sum

OSSF = re.compile(r"critic|score_?card|ossf|chaoss", re.I)


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n, upto): distinct values that are not null, their counts and how many rows are not above them."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(counts, [value], "n", "upto")


def ecdf(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the share of rows whose value is not above its own; null values get 0."""
    d = df.withColumn("_v", F.col(value).cast("double"))
    counts = value_counts(d, "_v")
    total = counts.agg(F.max("upto").alias("total"))
    shares = counts.crossJoin(F.broadcast(total)).select("_v", (F.col("upto") / F.col("total")).alias("ecdf"))
    return d.join(shares, "_v", "left").withColumn(out, F.coalesce("ecdf", F.lit(0.0))).drop("_v", "ecdf")


def ecdf_pass(log: BatchLog, batch_id: int | str, df: DataFrame, value: str, out: str) -> DataFrame:
    """ecdf() of a batch's rows within all batches that the log has, this one included, without their rows.

    The log keeps the counts of distinct values, those of a new batch added to the last ones; a batch that it has is not
    counted again. Rows of a batch given again get their shares within all batches up to the last one.
    """
    d = df.withColumn("_v", F.col(value).cast("double"))
    if not log.has(batch_id):
        counts = d.where("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("n"))
        known = log.table("counts", latest=True)
        log.commit(batch_id, {"counts": counts if known is None else known.unionByName(counts).groupBy("_v").agg(F.sum("n").alias("n"))})
    counts = running_sum(log.table("counts", latest=True), ["_v"], "n", "upto")
    total = counts.agg(F.max("upto").alias("total"))
    shares = counts.crossJoin(F.broadcast(total)).select("_v", (F.col("upto") / F.col("total")).alias("ecdf"))
    return d.join(shares, "_v", "left").withColumn(out, F.coalesce("ecdf", F.lit(0.0))).drop("_v", "ecdf")


def winsorize(df: DataFrame, value: str, low: float = 1, high: float = 99) -> DataFrame:
    """df with value moved to the interpolated percentiles where it lies beyond them; a null stays null."""
    v = F.col(value).cast("double")
    counts = value_counts(df.select(v.alias("_v")), "_v")
    total = counts.agg(F.max("upto").alias("total"))
    at = [(F.col("total") - 1) * (q / 100) for q in (low, high)]
    below = [F.min(F.when(F.col("upto") > F.floor(a), F.col("_v"))) for a in at]
    above = [F.min(F.when(F.col("upto") > F.ceil(a), F.col("_v"))) for a in at]
    share = [F.first(a - F.floor(a)) for a in at]
    p = counts.crossJoin(F.broadcast(total)).agg(F.array(*[b + (t - b) * w for b, t, w in zip(below, above, share)]).alias("_p"))
    return df.crossJoin(F.broadcast(p)).withColumn(value, F.when(v.isNotNull(), F.least(F.greatest(v, F.col("_p")[0]), F.col("_p")[1]))).drop("_p")


def normalize_evidence(signals: DataFrame, cfg: BandConfig = BandConfig()) -> DataFrame:
    """signals (signal_type, primary_count, dt_months, network, dependents, authority, ...) with usage_pct, recency_w, score, dead.

    The percentile is over all types of the batch mixed. The network slot is the first that is
    not null of network, the top-k sum of dependents and authority; an empty array of dependents
    counts as 0. Columns whose names speak of criticality or scorecards are passed on.
    """
    s = ecdf(signals, "primary_count", "usage_pct")
    has = set(signals.columns)
    slots = []
    if "network" in has:
        slots.append(F.col("network").cast("double"))
    if "dependents" in has:
        slots.append(F.when(F.col("dependents").isNotNull(), x.top_sum(F.transform("dependents", lambda d: d["criticality"]), cfg.top_k)))
    if "authority" in has:
        slots.append(F.col("authority").cast("double"))
    kind, dt = F.col("signal_type"), F.col("dt_months")
    s = s.withColumn("recency_w", x.decay_weight(dt, x.half_life(kind, cfg)))
    s = s.withColumn("network_w", F.coalesce(*slots, F.lit(0.0)))
    return s.withColumn("score", F.col("usage_pct") * cfg.w_usage + F.col("recency_w") * cfg.w_recency + F.col("network_w") * cfg.w_network).withColumn("dead", x.mark_dead(kind, dt, cfg))


def ossf_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if OSSF.search(c)]


def entity_evidence(evidence: DataFrame) -> DataFrame:
    """(entity_id, dead, best, score_pct): dead if any signal is, best the largest score."""
    e = evidence.groupBy("entity_id").agg(F.bool_or("dead").alias("dead"), F.max("score").alias("best"))
    return e.withColumn("score_pct", x.score_percent(F.col("best")))


def raw_band(score: Column, cfg: BandConfig = BandConfig()) -> Column:
    out = F.lit(cfg.bands[-1][0])
    for name, least in sorted(cfg.bands, key=lambda b: b[1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def assign_band(score: Column, prev: Column, dead: Column, cfg: BandConfig = BandConfig()) -> Column:
    """The band after a score, given the band before: struct(band, flip_from, flip_to).

    A move up needs the higher band's threshold plus the hysteresis for each level that is
    left; a move down needs a score under the own threshold less the hysteresis, and then goes
    where the score stands with the hysteresis against it. A score in [0, hysteresis) never
    demotes; an unknown band before counts as threshold 0. Dead forces the lowest band.
    """
    h = cfg.hysteresis
    order = sorted(cfg.bands, key=lambda b: -b[1])
    lowest = order[-1][0]
    plain = raw_band(score, cfg)
    least = F.lit(0.0)
    for name, t in order:
        least = F.when(prev == name, t).otherwise(least)
    raw_least = F.lit(0.0)
    for name, t in order:
        raw_least = F.when(plain == name, t).otherwise(raw_least)
    up = F.lit(None).cast("string")
    for name, t in sorted(cfg.bands, key=lambda b: b[1]):
        up = F.when((F.lit(t) > least) & (score >= t + h), name).otherwise(up)
    down = F.lit(None).cast("string")
    for name, t in sorted(cfg.bands, key=lambda b: b[1]):
        down = F.when((F.lit(t) < least) & (score >= t + h), name).otherwise(down)
    band = (
        F.when(prev.isNull(), plain)
        .when(raw_least > least, F.coalesce(up, prev))
        .when(raw_least < least, F.coalesce(down, prev))
        .otherwise(prev)
    )
    band = F.when(F.coalesce(dead, F.lit(False)), F.lit(lowest)).otherwise(band)
    flipped = prev.isNotNull() & (band != prev)
    return F.struct(band.alias("band"), F.when(flipped, prev).alias("flip_from"), F.when(flipped, band).alias("flip_to"))


def filter_flagged(records: DataFrame, flags: DataFrame, repo: str = "repo") -> tuple[DataFrame, DataFrame]:
    """(kept, flagged) records by a list of repos; a missing repo counts as ''."""
    key = F.coalesce(F.col(repo), F.lit(""))
    f = flags.select(F.coalesce(F.col(flags.columns[0]), F.lit("")).alias("_f")).distinct()
    return records.join(f, key == F.col("_f"), "left_anti"), records.join(f, key == F.col("_f"), "left_semi")


def cadence(commits: DataFrame, message: str = "message", files: str = "files") -> DataFrame:
    return commits.where(~x.docs_only(F.col(message), F.col(files)))
