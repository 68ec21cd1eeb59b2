"""Runs published together: order of the report, replays, failures."""

import pytest
from pyspark.sql import functions as F

from tallymark.sources import artifacts
from tallymark.sources.store import BatchLog


def frames(spark, n):
    report = spark.range(n).select((F.col("id") % 3).alias("section"), F.col("id").alias("pos"), F.concat(F.lit("line "), "id").alias("line"))
    entities = spark.range(n).select(F.col("id").alias("entity_id"), F.lit("x").alias("name"), F.lit("odd").alias("dropped"))
    return report.repartition(6), entities, spark.createDataFrame([("e", "q")], "entity string, quote string")


def test_published_together_or_not_at_all(spark, tmp_path):
    log = BatchLog(spark, f"file://{tmp_path}/runs")
    report, entities, findings = frames(spark, 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the report has several files
    try:
        assert artifacts.publish(log, 1, report, entities, findings, run_meta=spark.createDataFrame([(1,)], "n int"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [f"line {k}" for s in range(3) for k in range(500) if k % 3 == s]
    lines = log.table("report_lines", latest=True)
    assert [(r.place, r.line) for r in lines.orderBy("place").collect()] == list(enumerate(want, 1))
    attempt = log.entries()[0]["attempt"]
    files = sorted((tmp_path / "runs" / "data" / attempt / "report").glob("part-*"))
    assert len(files) > 1 and "".join(f.read_text() for f in files).splitlines() == want
    got = log.table("entities", latest=True)
    assert got.columns == ["entity_id", "name", "band", "score_pct", "n_records", "competitors", "facet_titles"] and got.count() == 500
    assert not artifacts.publish(log, 1, report.limit(1), entities.limit(1), findings) and log.table("entities").count() == 500

    broken = findings.select("entity", F.raise_error(F.lit("task lost")).cast("string").alias("quote"))
    with pytest.raises(Exception, match="task lost"):
        artifacts.publish(log, 2, report, entities.limit(3), broken)
    assert log.table("entities", latest=True).count() == 500 and len(log.entries()) == 1
    assert log.sweep() == 1
    report, entities, findings = frames(spark, 4)
    assert artifacts.publish(log, 2, report, entities, findings.limit(0))
    assert log.table("entities", latest=True).count() == 4 and log.table("findings", latest=True).count() == 0
    assert [r.line for r in log.table("report_lines", latest=True).orderBy("place").collect()] == ["line 0", "line 3", "line 1", "line 2"]
    assert artifacts.publish(log, 3, report.limit(0), entities.limit(0), findings.limit(0)) and log.table("report", latest=True).count() == 0
