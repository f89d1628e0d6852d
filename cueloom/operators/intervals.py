"""Interval operators on integer milliseconds.

Joins of intervals go by buckets of time: a row stands in every bucket that it touches, and a pair is
made in the first bucket that both touch, so (by, bucket) is an equi key for what would be a pure range
join, and a recording of any length spreads over its buckets. Rules that run along a recording go by
islands: maximal runs of rows no more than a gap apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scans

START, END = "start_ms", "end_ms"
#: Width of the time buckets of joins.
BUCKET_MS = 8_000


def _cols(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def with_islands(df: DataFrame, by: str | list[str], gap_ms: int = 0, *, strict: bool = False, name: str = "island", spread: bool = False) -> DataFrame:
    """Number the islands of each group: a row begins one when it starts after all earlier ends + gap.

    strict: touching rows are apart too. spread: by blocks, for groups that may hold a large part of
    all rows.
    """
    if spread:
        by, sorted_by = _cols(by), [START, END]
        rows = scans.running_max(scans.in_blocks(df, by, sorted_by), by, sorted_by, F.col(END), "_before")
        limit = F.col("_before") + gap_ms
        new = F.when(limit.isNull() | (F.col(START) >= limit if strict else F.col(START) > limit), 1).otherwise(0)
        return scans.running_sum(rows.withColumn("_new", new), by, sorted_by, F.col("_new"), name).select(*df.columns, name)
    order = Window.partitionBy(*_cols(by)).orderBy(START, END)
    before = F.max(END).over(order.rowsBetween(Window.unboundedPreceding, -1)) + gap_ms
    apart = F.col(START) >= before if strict else F.col(START) > before
    flagged = df.withColumn("_new", F.when(before.isNull() | apart, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_intervals(df: DataFrame, by: str | list[str], gap_ms: int = 0, reasons: str | None = None, *, spread: bool = False) -> DataFrame:
    """One row per island: bounds, members, and the union of an array column (F1)."""
    aggs = [F.min(START).alias(START), F.max(END).alias(END), F.count(F.lit(1)).alias("n")]
    if reasons:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(reasons)))).alias(reasons))
    return with_islands(df, by, gap_ms, spread=spread).groupBy(*_cols(by), "island").agg(*aggs)


def coverage_gaps(covered: DataFrame, durations: DataFrame, by: str = "audio_id", *, least_ms: int = 1500, pad_ms: int = 500, spread: bool = False) -> DataFrame:
    """Holes of the coverage, before, between and after, padded and clamped to the recording (F2)."""
    d = durations.select(by, "duration_ms")
    rows = covered.join(d, by).filter(F.col(END) > F.col(START)).select(
        by, "duration_ms", F.greatest(F.col(START), F.lit(0)).alias(START), F.least(F.col(END), F.col("duration_ms")).alias(END), F.lit(0).alias("tail")
    )
    rows = rows.unionByName(d.select(by, "duration_ms", F.col("duration_ms").alias(START), F.col("duration_ms").alias(END), F.lit(1).alias("tail")))
    sorted_by = [START, END, "tail"]
    if spread:
        rows = scans.running_max(scans.in_blocks(rows, [by], sorted_by), [by], sorted_by, F.col(END), "_before")
    else:
        rows = rows.withColumn("_before", F.max(END).over(Window.partitionBy(by).orderBy(*sorted_by).rowsBetween(Window.unboundedPreceding, -1)))
    holes = rows.withColumn("cursor", F.greatest(F.coalesce("_before", F.lit(0)), F.lit(0)).cast("long")).filter(F.col(START) - F.col("cursor") >= least_ms)
    right = F.when(F.col("tail") == 1, F.col("duration_ms")).otherwise(F.least(F.col("duration_ms"), F.col(START) + pad_ms))
    return holes.select(by, F.greatest(F.lit(0).cast("long"), F.col("cursor") - pad_ms).alias(START), right.alias(END))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of rows whose closed spans meet, each pair once. Columns besides `by` must differ."""
    at = lambda c: F.floor(F.col(c) / bucket_ms)
    in_buckets = lambda df, span: df.withColumn("_bucket", F.explode(F.sequence(at(span[0]), F.greatest(at(span[0]), at(span[1])))))
    (a0, a1), (b0, b1) = left_span, right_span
    met = in_buckets(left, left_span).join(in_buckets(right, right_span), [*by, "_bucket"])
    return met.filter((F.col("_bucket") == F.greatest(at(a0), at(b0))) & (F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1))).drop("_bucket")


def interval_pairs(df: DataFrame, *, by: str | list[str] = "audio_id", gap_ms: int = 800, distinct_on: str | None = "model_role", key: str = "event_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs (a, b) of different sources whose intervals meet within the gap, both ends inclusive."""
    keys = _cols(by)
    cols = list(dict.fromkeys([key, START, END, *([distinct_on] if distinct_on else []), *keep]))
    named = lambda s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in cols], (F.col(END) + gap_ms).alias(f"_until_{s}"))
    other = F.col(f"{key}_a") != F.col(f"{key}_b")
    if distinct_on:
        other = other & (F.col(f"{distinct_on}_a") != F.col(f"{distinct_on}_b"))
    return overlap_join(named("a"), named("b"), keys, (f"{START}_a", "_until_a"), (f"{START}_b", "_until_b")).filter(other).drop("_until_a", "_until_b")


def tile(df: DataFrame, window_ms: int, overlap_ms: int) -> DataFrame:
    """Windows of window_ms every window_ms - overlap_ms; the last is clipped and ends the span."""
    step = window_ms - overlap_ms
    last = F.greatest(F.col(START), F.col(END) - overlap_ms - 1)
    starts = F.when(F.col(END) - F.col(START) <= window_ms, F.array(START)).otherwise(F.sequence(F.col(START), last, F.lit(step).cast("long")))
    return (
        df.filter(F.col(END) > F.col(START)).withColumn("_s", F.explode(starts))
        .withColumn(END, F.least(F.col("_s") + window_ms, F.col(END))).withColumn(START, F.col("_s")).drop("_s")
    )


def assign_ids(df: DataFrame, prefix: str, by: str | list[str], order: list[str], name: str, *, spread: bool = False) -> DataFrame:
    """Sequence ids in canonical order within each group."""
    if spread:
        by = _cols(by)
        return scans.row_numbers(scans.in_blocks(df, by, order), by, order, "_n").withColumn(name, F.format_string(prefix + "%06d", "_n")).select(*df.columns, name)
    n = F.row_number().over(Window.partitionBy(*_cols(by)).orderBy(*order))
    return df.withColumn(name, F.format_string(prefix + "%06d", n))


def canonical_order(df: DataFrame, by: str = "audio_id", key: str = "event_id", *, spread: bool = False) -> DataFrame:
    """(start, end, id) within each group's partition (G1). spread: partitions are ranges, so a long group has several, one behind the other."""
    dealt = df.repartitionByRange(by, START, END, key) if spread else df.repartition(by)
    return dealt.sortWithinPartitions(by, START, END, key)


def dedup_overlapping(df: DataFrame, *, by: list[str], gap_ms: int = 400, score: str = "avg_logprob", key: str = "event_id", windows: str = "window_ids") -> DataFrame:
    """Equal texts within the gap become one row: outer bounds, all window ids, the rest from the best score, first on ties."""
    best = F.max_by(F.struct(key, score), F.struct(F.coalesce(score, F.lit(float("-inf"))), -F.col(START), -F.col(key)))
    return (
        with_islands(df, by, gap_ms).groupBy(*by, "island")
        .agg(F.min(START).alias(START), F.max(END).alias(END), F.array_sort(F.array_distinct(F.flatten(F.collect_list(windows)))).alias(windows), best.alias("best"), F.count(F.lit(1)).alias("n"))
        .select(*by, START, END, windows, F.col(f"best.{key}").alias(key), F.col(f"best.{score}").alias(score), "n")
    )


def overlap_warnings(cues: DataFrame, by: str = "audio_id", index: str = "cue_index", *, spread: bool = False) -> DataFrame:
    """Neighbours that overlap, and by how much (F8)."""
    if spread:
        sorted_by = [START, END, index]
        held = scans.in_blocks(cues.select(by, index, START, END), [by], sorted_by)
        rows = scans.neighbour(held, [by], sorted_by, F.struct(F.col(START).alias("s"), F.col(index).alias("i")), "_next")
        rows = rows.withColumns({"next_start": F.col("_next.s"), "next_index": F.col("_next.i")})
        return rows.filter(F.col(END) > F.col("next_start")).select(by, index, "next_index", (F.col(END) - F.col("next_start")).alias("overlap_ms"))
    order = Window.partitionBy(by).orderBy(START, END, index)
    rows = cues.select(by, index, START, END, F.lead(START).over(order).alias("next_start"), F.lead(index).over(order).alias("next_index"))
    return rows.filter(F.col(END) > F.col("next_start")).select(by, index, "next_index", (F.col(END) - F.col("next_start")).alias("overlap_ms"))


def reconcile_bounds(df: DataFrame, by: str | list[str] = "audio_id", key: str = "cue_index") -> DataFrame:
    """Overlapping neighbours meet at the floor of the mean; a group in which a row gets empty is rejected."""
    order = Window.partitionBy(*_cols(by)).orderBy(START, END, key)
    prev_end, next_start = F.lag(END).over(order), F.lead(START).over(order)
    left = F.when(prev_end > F.col(START), F.floor((prev_end + F.col(START)) / 2)).otherwise(F.col(START))
    right = F.when(F.col(END) > next_start, F.floor((F.col(END) + next_start) / 2)).otherwise(F.col(END))
    moved = df.withColumns({"new_start": left, "new_end": right})
    return moved.withColumn("ok", F.min((F.col("new_start") < F.col("new_end")).cast("int")).over(Window.partitionBy(*_cols(by))) == 1)


def spread_sample(df: DataFrame, k: int, by: str | list[str], order: list[str]) -> DataFrame:
    """k rows of each group spread over its whole span: places round(i (n-1)/(k-1)), half to even; for k = 1 the middle."""
    group = Window.partitionBy(*_cols(by))
    pos = F.row_number().over(group.orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(group)
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(max(1, k - 1)), 0).cast("int")) if k > 1 else F.array(F.floor(n / 2).cast("int"))
    return df.withColumns({"_pos": pos, "_n": n}).withColumn("_hit", (F.col("_n") <= k) | F.array_contains(places, F.col("_pos"))).filter("_hit").drop("_pos", "_n", "_hit")
