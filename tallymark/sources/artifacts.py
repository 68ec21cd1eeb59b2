"""Sinks with explicit schemas, and the domain registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running_sum
from .store import BatchLog

ENTITY = "entity_id string, name string, band string, score_pct double, n_records long, competitors map<string,bigint>, facet_titles array<string>"
FINDING = "entity string, tool string, claim string, quote string"
REGISTRY = "ord int, domain string, sources array<string>, seed_queries array<string>, synonyms array<string>"


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """df cast to a schema: columns that it lacks are null, others are dropped."""
    shape = df.sparkSession.createDataFrame([], schema).schema
    return df.selectExpr(*[f"cast({f.name if f.name in df.columns else 'null'} as {f.dataType.simpleString()}) as {f.name}" for f in shape])


def write_artifacts(out: str, entities: DataFrame, findings: DataFrame, mode: str = "overwrite") -> None:
    """entities and findings as JSON, both always written, cast to their schemas; other columns are dropped."""
    for name, df, schema in (("entities", entities, ENTITY), ("findings", findings, FINDING)):
        shaped(df, schema).write.mode(mode).json(f"{out}/{name}")


def publish(log: BatchLog, run: int | str, report: DataFrame, entities: DataFrame, findings: DataFrame, **tables: DataFrame) -> bool:
    """Publish a run: report, entities, findings and further tables become visible together; False if the log has the run.

    A run that fails on the way leaves nothing that a reader sees (log.sweep() removes its files), and the run before
    stays the one that log.table(name, latest=True) reads. The report's rows are in the order of their columns,
    `line` last: `report` is text whose files by name hold the lines in order, `report_lines` has (place, line) from 1.
    Tables are JSON; entities and findings are cast to their schemas.
    """
    if log.has(run):
        return False
    order = [c for c in report.columns if c != "line"] + ["line"]
    lines = running_sum(report, order, 1, "place").select("place", "line")
    text = lines.repartitionByRange("place").sortWithinPartitions("place").select(F.coalesce("line", F.lit("")).alias("value"))
    made = {"report": text, "report_lines": lines, "entities": shaped(entities, ENTITY), "findings": shaped(findings, FINDING), **tables}
    return log.commit(run, made, kinds={name: "text" if name == "report" else "json" for name in made})


def write_outputs(out: str, report: DataFrame, tables: dict[str, DataFrame], mode: str = "overwrite") -> None:
    """The report as text in the order of its rows' columns, and further tables (coverage_log, eval, evidence,
    snapshot_plan, run_meta, raw_hits) as JSON, a folder each."""
    order = [c for c in report.columns if c != "line"]
    report.orderBy(*order).select("line").write.mode(mode).text(f"{out}/report")
    for name, df in tables.items():
        df.write.mode(mode).json(f"{out}/{name}")


def load_registry(spark: SparkSession, rows: list[tuple] | None = None, path: str | None = None) -> DataFrame:
    """The registry from rows (domain, sources, seed queries, synonyms) or a JSON-lines file; empty if neither is given."""
    if path:
        return spark.read.schema(REGISTRY).json(path)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows or [])], REGISTRY)
