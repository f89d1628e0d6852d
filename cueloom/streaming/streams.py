"""Structured Streaming forms: arriving files, live candidates, running totals, repeated queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evidence import upsert_runs
from ..operators.snapshots import SnapshotTable


def ingest_new(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet"):
    """Files that have arrived since the last call, through transform, appended to target."""
    arrived = spark.readStream.format(fmt).schema(schema).load(source)
    out = transform(arrived) if transform else arrived
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(arriving: DataFrame, target: SnapshotTable, checkpoint: str):
    """Run-level upsert of every micro-batch into a snapshot table, one version each (M2).

    A reader sees a batch as a whole or not at all. One that is run again after a failure is known by
    its number and left out.
    """

    def one(batch: DataFrame, n: int) -> None:
        target.upsert(batch, upsert_runs, writer=checkpoint, batch=n)

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_complete(totals: DataFrame, target: str, checkpoint: str):
    """All groups of a streaming aggregation as they stand after each micro-batch n, in target/n."""

    def one(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{n}")

    return totals.writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def speech_sessions(c: DataFrame, gap: str = "1500 milliseconds") -> DataFrame:
    """Stretches of speech by audio clock, apart by more than the gap (M3). c: audio_id, start_ms, end_ms.

    Every recording's clock starts at 0, so no watermark: it would drop recordings that arrive later.
    For complete output; the state keeps every stretch.
    """
    clock = c.withColumn("at", F.timestamp_millis("start_ms"))
    out = clock.groupBy("audio_id", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return out.drop("session_window")


def gap_alerts(c: DataFrame, least_ms: int = 1500) -> DataFrame:
    """audio_id, gap_start, gap_end: silences of least_ms or more, told as soon as speech goes on behind them (M3).

    The state is one number per recording, the end of its speech so far. Rows of a micro-batch are
    taken in time order; one that arrives late never takes an alert back. For append output.
    """
    schema = "audio_id long, gap_start long, gap_end long"

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        out = []
        for start, end in sorted(x for f in frames for x in zip(f["start_ms"], f["end_ms"])):
            if until is not None and start - until >= least_ms:
                out.append((key[0], until, start))
            until = int(end) if until is None else max(until, int(end))
        state.update((until,))
        yield pd.DataFrame(out, columns=["audio_id", "gap_start", "gap_end"])

    return c.select("audio_id", "start_ms", "end_ms").groupBy("audio_id").applyInPandasWithState(walk, schema, "until long", "append", GroupStateTimeout.NoTimeout)


def usage_totals(calls: DataFrame, every: str = "1 hour") -> DataFrame:
    """Token totals by stage and hour (M4). calls: ts, stage, prompt_tokens, completion_tokens.

    For complete output: late calls count, the last hours are given, and the state keeps every hour.
    """
    out = calls.groupBy(F.window("ts", every), "stage").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count(F.lit(1)).alias("calls"))
    return out.select(F.col("window.start").alias("hour"), "stage", "prompt_tokens", "completion_tokens", "calls")


def distinct_queries(queries: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of equal search queries within the watermark (M5). queries: ts, query."""
    key = F.md5(F.lower(F.trim(F.regexp_replace("query", r"\s+", " "))))
    return queries.withColumn("query_key", key).withWatermark("ts", late).dropDuplicatesWithinWatermark(["query_key"])
