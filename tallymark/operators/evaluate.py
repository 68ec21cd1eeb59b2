"""Evaluation and reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_sum


def recall(golden: DataFrame, caught: DataFrame, key: str = "snippet_id", flag: str = "is_true") -> DataFrame:
    """(caught_true, total_true, recall) over distinct true golden ids; 0.0 if there are none."""
    true = golden.where(flag).select(key).distinct()
    c = caught.select(key).distinct().withColumn("_c", F.lit(1))
    r = true.join(c, key, "left").agg(F.count("_c").alias("caught_true"), F.count(F.lit(1)).alias("total_true"))
    return r.withColumn("recall", F.coalesce(F.try_divide("caught_true", "total_true"), F.lit(0.0)))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, kappa): Cohen's kappa of two labels per row; 0.0 for no rows, 1.0 where chance and fact both agree fully."""
    cells = pairs.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = rows.join(cols, F.col("a") == F.col("b")).agg(F.sum(F.col("ra") * F.col("cb")).alias("chance"))
    t = total.crossJoin(chance)
    po = F.try_divide("same", "total")
    pe = F.coalesce(F.try_divide(F.col("chance"), F.col("total") * F.col("total")), F.lit(0.0))
    k = F.when(F.coalesce("total", F.lit(0)) == 0, 0.0).when(F.abs(1 - pe) < 1e-12, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return t.select(F.coalesce("total", F.lit(0)).cast("long").alias("n"), k.cast("double").alias("kappa"))


def kappa_of_runs(first: DataFrame, second: DataFrame, entity: str = "entity_id", label: str = "band") -> DataFrame:
    """(n, kappa) of the labels that two runs give the entities that are in both."""
    a, b = (d.select(F.col(entity).alias("_e"), F.col(label).alias(n)) for d, n in ((first, "_a"), (second, "_b")))
    return kappa(a.join(b, "_e"), "_a", "_b")


def coverage(counters: DataFrame, stage: str, sums: dict[str, str]) -> DataFrame:
    """Counters summed by stage."""
    return counters.groupBy(stage).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def report_lines(entities: DataFrame, coverage_rows: DataFrame | None = None) -> DataFrame:
    """(section, line_no, line): per band its entities by name, or (none), then coverage by stage.

    entities has name, band, score_pct; of equal names the first by entity_id counts.
    """
    e = entities.groupBy("name").agg(F.min_by(F.struct("band", "score_pct"), "entity_id").alias("e")).select("name", "e.*")
    order = F.create_map(*[F.lit(v) for kv in {"leader": 1, "contender": 2, "candidate": 3, "unverified": 4}.items() for v in kv])
    known = F.when(F.col("band").isin("leader", "contender", "candidate"), F.col("band")).otherwise("unverified")
    e = e.select(F.element_at(order, known).alias("section"), "name", F.concat(F.lit("- "), "name", F.lit(": "), F.format_number("score_pct", 2)).alias("line"))
    placed = running_sum(e, ["section", "name"], 1, "place")
    # One row for each section
    first = placed.groupBy("section").agg((F.min("place") - 1).alias("ahead"))
    lines = placed.join(F.broadcast(first), "section").select("section", (F.col("place") - F.col("ahead")).cast("int").alias("line_no"), "line")
    bands = entities.sparkSession.createDataFrame([(1, "leader"), (2, "contender"), (3, "candidate"), (4, "unverified")], "section int, band string")
    heads = bands.select("section", F.lit(0).alias("line_no"), F.concat(F.lit("## "), "band").alias("line"))
    none = bands.join(e.select("section").distinct(), "section", "left_anti").select("section", F.lit(1).alias("line_no"), F.lit("(none)").alias("line"))
    out = heads.unionByName(lines).unionByName(none)
    if coverage_rows is not None:
        c = running_sum(coverage_rows, ["stage"], 1, "_n").select(F.lit(5).alias("section"), F.col("_n").cast("int").alias("line_no"), F.concat_ws(" ", F.lit("- stage"), "stage", "text").alias("line"))
        out = out.unionByName(c)
    return out


def report_rows(entities: DataFrame, coverage_rows: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(section, name, part, pos, line): the whole report, to be read in the order of the columns before line.

    entities has entity_id, name, band, score_pct (may be null), axes (array of axis and classification)
    and competitors (map of name to count); findings has tool, entity, claim, quote; coverage_rows stage,
    tokens_in, tokens_out. Of entities of one name the first by entity_id counts; those without a name are
    left out. Sections 1 to 4 are the bands, 5 the evidence, 6 the coverage. The order lies in the
    columns, so nothing is numbered in one task; write it with a range sort.
    """
    spark = entities.sparkSession
    names = ("leader", "contender", "candidate", "unverified")
    e = entities.where("name <> ''").groupBy("name").agg(F.min_by(F.struct("band", "score_pct", "axes", "competitors"), "entity_id").alias("e")).select("name", "e.*")
    place = F.coalesce(*[F.when(F.lower("band") == n, k) for k, n in enumerate(names, 1)], F.lit(len(names)))
    e = e.select(place.alias("section"), "name", "score_pct", "axes", F.array_sort(F.map_keys("competitors")).alias("others"))
    row = lambda d, part, pos, line: d.select("section", "name", F.lit(part).alias("part"), pos.cast("int").alias("pos"), line.alias("line"))
    zero = F.lit(0)
    score = F.when(F.col("score_pct").isNotNull(), F.concat(F.lit(" (score "), F.col("score_pct").cast("string"), F.lit(")"))).otherwise("")
    out = row(e, 0, zero, F.concat(F.lit("- "), "name", score))
    axes = e.select("section", "name", F.posexplode("axes").alias("i", "x"))
    out = out.union(row(axes, 1, F.col("i"), F.concat(F.lit("  - "), "x.axis", F.lit(" = "), "x.classification")))
    out = out.union(row(e.where(F.size("others") > 0), 2, zero, F.concat(F.lit("  - competitors: "), F.array_join("others", ", "))))
    heads = spark.createDataFrame([(k, "", f"### {n.capitalize()}") for k, n in enumerate(names, 1)], "section int, name string, title string")
    out = out.union(row(heads, -1, zero, F.col("title")))
    out = out.union(row(heads.join(e.select("section").distinct(), "section", "left_anti"), 0, zero, F.lit("- (none)")))
    if findings is not None:
        f = findings.select(F.lit(5).alias("section"), F.coalesce(F.expr("nullif(tool, '')"), F.expr("nullif(entity, '')"), F.lit("?")).alias("name"), F.coalesce("quote", F.lit("")).alias("q"), F.coalesce("claim", F.lit("")).alias("c"))
        out = out.union(row(f, 0, zero, F.concat(F.lit("- "), "name", F.lit(': "'), "q", F.lit('"'), F.when(F.col("c") != "", F.concat(F.lit(" — "), "c")).otherwise(""))))
        out = out.union(row(f.limit(1).withColumn("name", F.lit("")), -1, zero, F.lit("## Third-party evidence")))
    c = coverage_rows.select(F.lit(6).alias("section"), F.col("stage").alias("name"), F.concat(F.lit("- Stage "), "stage", F.lit(": tokens_in="), "tokens_in", F.lit(", tokens_out="), "tokens_out").alias("title"))
    out = out.union(row(c, 0, zero, F.col("title")))
    return out.union(row(spark.createDataFrame([(6, "")], "section int, name string"), -1, zero, F.lit("## Coverage Summary")))


def render(lines: DataFrame) -> DataFrame:
    """One row with the report as text, ending in one line feed."""
    item = F.array_sort(F.collect_list(F.struct("section", "line_no", "line")))
    return lines.agg(F.concat(F.array_join(F.transform(item, lambda v: v["line"]), "\n"), F.lit("\n")).alias("report"))
