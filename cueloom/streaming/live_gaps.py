"""Silences on a live stream of speech, with corrections, timers and a state that ends."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "audio_id long, gap_start long, gap_end long, kind string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stretches(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Speech joined where the silence between is shorter than least, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start - out[-1][1] < least:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def silences(held: list[tuple[int, int]]) -> set[tuple[int, int]]:
    return {(a[1], b[0]) for a, b in zip(held, held[1:])}


class GapWatch(StatefulProcessor):
    """Per recording: its stretches of speech (a list), and a clock of (floor, deadline, whether it is told as silent).

    Stretches more than keep_ms of audio behind the last one are settled and leave the list; the floor is
    where the kept ones begin, and rows before it change nothing any more.
    """

    def __init__(self, least_ms: int, silence_ms: int, ended_ms: int, keep_ms: int):
        self.least, self.silence, self.ended, self.keep = least_ms, silence_ms, ended_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.speech = handle.getListState("speech", "start long, end long")
        self.clock = handle.getValueState("clock", "floor long, deadline long, silent boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = [(int(s), int(e)) for s, e in self.speech.get()]
        floor, deadline, _ = self.clock.get() if self.clock.exists() else (None, None, False)
        fresh, last = [], 0
        for frame in rows:
            fresh += zip(frame["start_ms"].tolist(), frame["end_ms"].tolist())
            last = max(last, int(frame["at_ms"].max()))
        if floor is not None:
            fresh = [(max(s, floor), e) for s, e in fresh if e > floor]
        after = stretches(before + fresh, self.least)
        old, new = silences(before), silences(after)
        changes = [(key[0], *g, "withdrawn") for g in sorted(old - new)] + [(key[0], *g, "gap") for g in sorted(new - old)]
        settled = 0
        while settled < len(after) - 1 and after[settled][1] < after[-1][1] - self.keep:
            settled += 1
        if settled:
            after, floor = after[settled:], after[settled][0]
        self.speech.put(after)
        wake = max(last + self.silence, deadline or 0)
        if wake != deadline:
            if deadline is not None:
                self.handle.deleteTimer(deadline)
            self.handle.registerTimer(wake)
        self.clock.update((floor, wake, False))
        yield self._rows(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        floor, _, silent = self.clock.get()
        if silent:
            self.speech.clear()
            self.clock.clear()
            yield self._rows([])
            return
        wake = int(expiredTimerInfo.getExpiryTimeInMs()) + self.ended
        self.handle.registerTimer(wake)
        self.clock.update((floor, wake, True))
        yield self._rows([(key[0], max(int(e) for _, e in self.speech.get()), None, "silent")])

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["audio_id", "gap_start", "gap_end", "kind"])
        return out.astype({"audio_id": "Int64", "gap_start": "Int64", "gap_end": "Int64"})


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that are started within keep their state in RocksDB, as timers and lists need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def live_gaps(c: DataFrame, *, least_ms: int = 1500, silence_ms: int = 30_000, ended_ms: int = 600_000, keep_ms: int = 600_000, delay: str = "10 seconds") -> DataFrame:
    """audio_id, gap_start, gap_end, kind: changes to the silences of least_ms or more (M3). c: at (when a row was heard, a timestamp), audio_id, start_ms, end_ms.

    kind: `gap` (a silence is known), `withdrawn` (a row that came later lies in it; what remains of it comes
    as gaps), `silent` (no row for silence_ms after the last one; gap_end is null). ended_ms later the
    recording leaves the state; should it go on, it begins anew. Only silences in the last keep_ms of
    a recording's audio are corrected. Rows later than the watermark's delay, or with a null, are left out.
    So a recording's gaps are its `gap` rows less its `withdrawn` ones. Start it within `rocksdb`.
    """
    sound = c.filter(F.col("at").isNotNull() & F.col("audio_id").isNotNull() & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    heard = sound.withWatermark("at", delay).select("audio_id", "start_ms", "end_ms", "at", F.unix_millis("at").alias("at_ms"))
    watch = GapWatch(least_ms, silence_ms, ended_ms, keep_ms)
    return heard.groupBy("audio_id").transformWithStateInPandas(watch, OUT, "append", "eventTime")


def gaps_now(changes: DataFrame) -> DataFrame:
    """audio_id, gap_start, gap_end of the silences that stand, from all changes so far."""
    sign = F.when(F.col("kind") == "gap", 1).when(F.col("kind") == "withdrawn", -1).otherwise(0)
    return changes.groupBy("audio_id", "gap_start", "gap_end").agg(F.sum(sign).alias("_n")).filter("_n > 0").drop("_n")
