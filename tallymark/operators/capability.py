"""Capability audits: the section slicer and the strict reading of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CapabilityConfig

#: What a classification may say.
LABELS = ("yes", "no", "partial", "unclear", "supported", "unsupported", "unknown")


def slice_sections(docs: DataFrame, key: str, text: str, cfg: CapabilityConfig = CapabilityConfig()) -> DataFrame:
    """(key, sliced): body lines under kept headings, else the first words of the whole body.

    A line stays if the nearest known heading before it is kept and every unknown heading
    in between is deeper than that one.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r]")).alias("pos", "line"))
    stripped = F.btrim("line")
    mark = F.regexp_extract(stripped, r"^(#{1,6})\s+(.*)$", 1)
    title = F.btrim(F.regexp_replace(F.lower(F.btrim(F.regexp_extract(stripped, r"^(#{1,6})\s+(.*)$", 2))), r"#+$", ""))
    lines = lines.withColumn("level", F.when(mark != "", F.length(mark))).withColumn("title", F.when(mark != "", title))
    kind = F.when(F.col("title").isin(*cfg.keep), "keep").when(F.col("title").isin(*cfg.drop), "drop")
    lines = lines.withColumn("kind", kind)
    w = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("section", F.count("kind").over(w))
    s = Window.partitionBy(key, "section").orderBy("pos")
    so_far = s.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("head", F.first("kind").over(s)).withColumn("head_level", F.first("level").over(s))
    lines = lines.withColumn("other", F.min(F.when(F.col("kind").isNull(), F.col("level"))).over(so_far))
    body = lines.where("level is null and trim(line) <> ''").withColumn("in", (F.col("head") == "keep") & (F.col("other").isNull() | (F.col("other") > F.col("head_level"))))
    item = F.struct("pos", "line")
    g = body.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("in"), item))).alias("kept"), F.array_sort(F.collect_list(item)).alias("all"))
    line = lambda a: F.transform(a, lambda v: v["line"])
    words = F.filter(F.split(F.array_join(line("all"), " "), r"\s+"), lambda v: v != "")
    sliced = F.when(F.size("kept") > 0, F.array_join(line("kept"), "\n")).otherwise(F.array_join(F.slice(words, 1, cfg.fallback_words), " "))
    return docs.select(key).distinct().join(g.select(key, sliced.alias("sliced")), key, "left").withColumn("sliced", F.coalesce("sliced", F.lit("")))


def parse_report(reply: Column) -> Column:
    """struct(valid, axes) of a JSON reply {"axes": [{"axis", "classification"}]}; extra keys, other labels and over 100 axes are invalid."""
    shape = "struct<axes:array<struct<axis:string,classification:string>>>"
    v = F.from_json(reply, shape)
    raw = F.from_json(reply, "struct<axes:array<string>>")["axes"]
    keys = F.json_object_keys(reply)
    ok = (
        (keys == F.array(F.lit("axes")))
        & (F.size(v["axes"]) <= 100)
        & F.forall(v["axes"], lambda a: a["axis"].isNotNull() & a["classification"].isin(*LABELS))
        & F.forall(raw, lambda a: F.size(F.json_object_keys(a)) == 2)
    )
    valid = F.coalesce(ok, F.lit(False))
    return F.struct(valid.alias("valid"), F.when(valid, v["axes"]).alias("axes"))
