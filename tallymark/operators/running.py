"""Running sums over a whole table, without a window that has no partition; checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all executors share.

    Only where it names none and runs on this machine alone (tests) a temporary one is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back.

    For loops: unlike a checkpoint it hands no constraints of its columns on, which double with each round.
    """
    path = f"{shared_folder(df.sparkSession)}/tallymark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, by: list[str], amount: str | Column, name: str) -> DataFrame:
    """df with the sum of amount over all rows up to and with the own one in the order of by, which should be total.

    Rows are dealt into ranges by sampled splitters, so a range has about as many rows as any other
    whatever the values are; one sum per range is added to those of the ranges after it. The ranges are
    checkpointed, so that a range computed again after a loss has the same rows.
    """
    d = df.withColumn("_amount", F.lit(amount) if isinstance(amount, int) else F.col(amount) if isinstance(amount, str) else amount)
    d = checkpointed(d.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range
    before = d.groupBy("_range").agg(F.sum("_amount").alias("_m")).select("_range", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.sum("_amount").over(within)).drop("_range", "_before", "_amount")
