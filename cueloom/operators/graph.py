"""Connected components on DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """v, c: every node of edges(a, b) and the smallest node it reaches.

    Each round takes the smallest label among the neighbours and jumps to that label's label; the
    sum of labels tells when they have settled.
    """
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("c")))
    total = lambda t: t.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
    before = total(labels)
    for _ in range(max_rounds):
        if before is None:
            return labels
        near = both.join(labels, both["b"] == labels["v"]).select(F.col("a").alias("v"), "c")
        least = near.unionByName(labels).groupBy("v").agg(F.min("c").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("j"))
        labels = checkpoint(least.join(jump, "c", "left").select("v", F.least("c", "j").alias("c")))
        now = total(labels)
        if now == before:
            return labels
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
