"""Windowed streams against plain grouping over all rows."""

from collections import defaultdict

from pyspark.sql import functions as F

from cueloom.plans import catalog, more_queries as mq
from cueloom.plans.evidence_queries import cand
from cueloom.plans.fixtures import fx, table
from cueloom.streaming import streams


def sessions(rows, gap=1500):
    """(audio_id, n, start_ms, end_ms) of stretches whose starts are less than the gap apart."""
    out = []
    by_audio = defaultdict(list)
    for a, start, end in rows:
        by_audio[a].append((start, end))
    for a, spans in by_audio.items():
        last = None
        for start, end in sorted(spans):
            if last is not None and start - last < gap:
                n, s0, e0 = out[-1][1:]
                out[-1] = (a, n + 1, s0, max(e0, end))
            else:
                out.append((a, 1, start, end))
            last = start
    return sorted(out)


def test_every_session_comes(spark, sf):
    rows = [tuple(r) for r in cand(spark, sf).select("audio_id", "start_ms", "end_ms").collect()]
    got = catalog.QUERIES["m3_speech_sessions"](spark, sf).select("audio_id", "n", "start_ms", "end_ms").collect()
    assert sorted(map(tuple, got)) == sessions(rows)


def test_recordings_that_arrive_later_count(spark, tmp_path):
    """A long recording first, then one whose clock starts at 0 again, then more of the first."""
    parts = [[(1, 0, 900), (1, 600_000, 601_000)], [(2, 0, 500), (2, 1000, 1900), (2, 9000, 9100)], [(1, 601_000, 602_000)]]
    for part in parts:
        spark.createDataFrame(part, "audio_id long, start_ms long, end_ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("audio_id long, start_ms long, end_ms long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = mq._totals(spark, streams.speech_sessions(live)).select("audio_id", "n", "start_ms", "end_ms").collect()
    assert sorted(map(tuple, got)) == sessions([r for part in parts for r in part])


def test_every_hour_comes(spark, sf):
    calls = fx(spark, sf, "fx_usage").join(table(spark, sf, "events").select(F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts")), "call_id")
    sums = [F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"), F.count(F.lit(1)).alias("n")]
    want = calls.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "stage").agg(*sums).collect()
    got = catalog.QUERIES["m4_usage_totals"](spark, sf).select("hour", "stage", "prompt_tokens", "completion_tokens", "calls").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
