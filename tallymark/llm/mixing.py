"""Mixing sources to target weights along a time-varying curriculum.

Every source has a schedule of weights over training time 0 to 1. The integral of
the schedule, scaled to the source's target, is its cumulative demand for words;
the words of a source are laid end to end in a fixed pseudo-random order of its
documents, again from the start where the target asks for more than one epoch.
Inverting the demand at the middle of each copy gives its training position, and
documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, ranked, rest_of, unused

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Percent of all words that the mix takes, and the most epochs over a source.
SHARE_PERCENT, MOST_EPOCHS = 150, 2
#: A schedule for each weight in WEIGHTS: knots (time, relative weight), linear between.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))
#: Hexadecimal digits of the order key by which long sources are cut for the running sums.
CUT_DIGITS = 3


def source_targets(scratch: Scratch, sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, ord, weight, target) from (source, size) rows.

    ord is the 0-based place by code point with null last. Targets share the
    total by weight; those above most_epochs times their size stop there and
    the excess is shared again among the rest until none is above.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = ranked(scratch, s, [F.col("source").isNull(), "source"], "ord")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * most_epochs).cast("double")
    s = scratch.save(s.select("source", "source_size", "ord", weight.alias("weight"), cap.alias("cap")))
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share_percent / 100
    # A source stops at its cap when the level, target per weight, reaches cap / weight.
    # Each round takes the level of those still open; the stopped set only grows.
    level = 0.0
    while True:
        r = s.agg(
            F.sum(F.when(F.col("cap") <= F.col("weight") * level, F.col("cap"))).alias("held"),
            F.sum(F.when(F.col("cap") > F.col("weight") * level, F.col("weight"))).alias("open"),
        ).first()
        if not r.open or (total - (r.held or 0.0)) / r.open <= level:
            break
        level = (total - (r.held or 0.0)) / r.open
    return s.withColumn("target", F.least("cap", F.col("weight") * F.lit(level)))


def _inverse(u: Column, knots) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches the share u of its whole."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    whole, before, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        need = F.greatest(u * whole - before, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        x = need / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0))) - w0) / slope
        pieces.append((before + area, t0 + x))
        before += area
    for upto, t in reversed(pieces):
        out = F.when(u * whole <= upto, t).otherwise(out)
    return out


def plan_mix(docs: DataFrame, schedules=SCHEDULES, cut_digits: int = CUT_DIGITS, tie: str | None = None, **targets) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (start, words, position), taken.

    size counts the words of the text; null and empty texts have 0. A document
    gets as many whole copies as fit the target of its source, and the copy that
    crosses the target is taken in part, so that the words of a source sum to
    its target rounded down. The order key is the MD5 of doc_id, or without one that of the text's hash; documents of equal
    order key (repeated ids and rows) follow by size and then by that hash, so the order of the input doesn't count.
    tie names a column that stands in for the SHA-256 of the text; it is kept as tie. An empty table gives no rows; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    hashed = F.col(tie) if tie else F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.md5(F.coalesce(F.col("doc_id").cast("string"), hashed)).alias("key"), size.alias("size"), hashed.alias("tie"))
    d = scratch.save(d.withColumn("cut", F.substring("key", 1, cut_digits)))
    s = scratch.save(source_targets(scratch, d.select("source", "size"), **targets))
    # Running sums over a source of any size: sums of its cuts first, then within each cut.
    w = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = d.groupBy("source", "cut").agg(F.sum("size").alias("cut_size")).withColumn("cut_start", F.coalesce(F.sum("cut_size").over(w), F.lit(0)))
    cuts = cuts.select(F.col("source").alias("s"), F.col("cut").alias("c"), "cut_start").join(s.drop("weight", "cap"), F.col("s").eqNullSafe(F.col("source"))).drop("source")
    inner = Window.partitionBy("source", "cut").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    d = d.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("cut") == F.col("c")))
    begin = F.col("cut_start") + F.col("within")
    limit = F.floor("target").cast("long")
    most = targets.get("most_epochs", MOST_EPOCHS)

    def copy(k: int) -> Column:
        start = begin + k * F.col("source_size")
        words = F.greatest(F.least(F.col("size"), limit - start), F.lit(0)).cast("long")
        share = F.when(F.col("target") > 0, (start + words / 2) / F.col("target")).otherwise(0.0)
        at = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            at = F.when(F.col("ord") % len(schedules) == i, _inverse(share, knots)).otherwise(at)
        return F.struct(start.cast("long").alias("start"), words.alias("words"), at.alias("position"))

    copies = F.filter(F.array(*[copy(k) for k in range(most)]), lambda c: c["words"] > 0)
    d = d.select("doc_id", "source", "size", "source_size", "target", "key", copies.alias("copies"), "tie")
    return d.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda acc, c: acc + c["words"]))


def mix_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, first_position, second_position), range-sorted by training position.

    Positions are those of the first two copies. Documents that the mix leaves out come last.
    """
    m = plan_mix(docs)
    m = m.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.size("copies").cast("long").alias("copies"), *[F.round(F.get("copies", F.lit(k))["position"], 9).alias(c) for k, c in enumerate(("first_position", "second_position"))])
    return m.repartitionByRange(F.col("first_position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


def mix_stage(docs: DataFrame) -> DataFrame:
    """The training rows: each document once per copy, in the order of training positions.

    Rows keep the columns of docs and whole texts. The copy that crosses its
    source's target is in if at least half of its words are. Documents without
    words take no part in the mix. Of rows that repeat doc_id and text the one of greatest
    other columns as JSON takes part. Different texts of one doc_id, or of none, are documents of
    their own, told apart by the SHA-256 of the text.
    """
    tie = None
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        row, tie = unused(docs, "_r"), unused(docs, "_tie")
        best = F.max_by(F.struct(*docs.columns), F.to_json(F.struct("doc_id", *rest_of(docs))))
        one = docs.groupBy("doc_id", "text").agg(best.alias(row)).select(f"{row}.*")
        docs = Scratch(docs.sparkSession).save(one.withColumn(tie, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)))
    columns = [c for c in docs.columns if c != tie]
    m = plan_mix(docs, tie=tie).select("*", F.explode("copies").alias("c")).where("2 * c.words >= size")
    i, at, start, of = (unused(docs, x) for x in ("_id", "_at", "_start", "_of"))
    m = m.select(F.col("doc_id").alias(i), F.col("c.position").alias(at), F.col("c.start").alias(start), *([F.col("tie").alias(of)] if tie else []))
    match = F.col("doc_id").eqNullSafe(F.col(i))
    out = docs.join(m.distinct(), match & (F.col(tie) == F.col(of)) if tie else match)
    return out.repartitionByRange(at, start, "doc_id").sortWithinPartitions(at, start, "doc_id").select(*columns)
