"""Which stretches of a recording to recognise again, within a budget, and what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import TEMPLATES, norm_text
from .graph import checkpoint
from .evidence import is_suspicious, match_templates, with_labels
from .intervals import END, START, assign_ids, coverage_gaps, dedup_overlapping, merge_intervals, tile

#: The order in which reasons are served.
PRIORITY = {
    "quarantined_candidate_region": 0,
    "main_channel_gap": 1,
    "uncertain_candidate": 2,
    "model_disagreement_or_single_model": 2,
    "abnormally_long_segment": 3,
}


def _padded(df: DataFrame, durations: DataFrame, pad_ms: int, reason: str) -> DataFrame:
    return df.join(durations.select("audio_id", "duration_ms"), "audio_id").select(
        "audio_id", F.greatest(F.lit(0).cast("long"), F.col(START) - pad_ms).alias(START), F.least(F.col("duration_ms"), F.col(END) + pad_ms).alias(END), F.lit(reason).alias("reason")
    )


def rescue_targets(c: DataFrame, decisions: DataFrame, windows: DataFrame, durations: DataFrame, *, gap_ms: int = 1500, pad_ms: int = 500, long_ms: int | None = 15_000) -> DataFrame:
    """Gaps, quarantined rows, suspicious uncertain rows, disagreeing windows and long rows of the main channel (H2).

    windows: audio_id, component, start_ms, end_ms, label and one row per member (event_id).
    """
    main = with_labels(c.filter(F.col("source_channel") == "main"), decisions)
    odd = is_suspicious(F.col("no_speech_prob"), F.col("avg_logprob"))
    gaps = coverage_gaps(main.filter("label <> 'hallucination'"), durations, least_ms=gap_ms, pad_ms=pad_ms).withColumn("reason", F.lit("main_channel_gap"))
    parts = [
        gaps.select("audio_id", START, END, "reason"),
        _padded(main.filter("label = 'hallucination'"), durations, pad_ms, "quarantined_candidate_region"),
        _padded(main.filter((F.col("label") == "uncertain") & odd), durations, pad_ms, "uncertain_candidate"),
    ]
    members = windows.filter("label = 'uncertain'").select("audio_id", "component", START, END, "event_id")
    doubtful = members.join(main.filter(odd).select("event_id"), "event_id", "left_semi").select("audio_id", "component", START, END).distinct()
    parts.append(_padded(doubtful, durations, pad_ms, "model_disagreement_or_single_model"))
    if long_ms is not None:
        parts.append(_padded(main.filter(F.col(END) - F.col(START) > long_ms), durations, pad_ms, "abnormally_long_segment"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_budget(windows: DataFrame, durations: DataFrame, *, window_ms: int = 12_000, max_windows: int = 24, max_total_ms: int = 180_000, ratio: float = 1.0) -> DataFrame:
    """Windows that fit the budget, by reason priority; in each class the largest spread sample that fits.

    windows: audio_id, start_ms, end_ms, reasons. For every class and every size k up to
    max_windows the sample's cost is computed; four steps then take what the classes before left.
    """
    priority = F.array_min(F.transform("reasons", lambda r: F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[r], F.lit(99))))
    group = Window.partitionBy("audio_id", "prio")
    rows = windows.withColumn("prio", priority).withColumns({"pos": F.row_number().over(group.orderBy(START, END)) - 1, "n": F.count(F.lit(1)).over(group)})
    k = F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(max_windows)).cast("int")))
    place = F.when(F.col("k") == 1, F.array(F.floor(F.col("n") / 2).cast("int"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.bround(i * (F.col("n") - 1) / (F.col("k") - 1), 0).cast("int"))
    )
    taken = rows.withColumn("k", k).filter((F.col("k") == F.col("n")) | F.array_contains(place, F.col("pos")))
    taken = checkpoint(taken)  # each level reads it, and what the levels before left
    cost = taken.groupBy("audio_id", "prio", "k").agg(F.sum(F.col(END) - F.col(START)).alias("cost"), F.count(F.lit(1)).alias("size"))
    allowed = F.least(F.lit(max_total_ms).cast("double"), F.greatest(F.least(F.col("duration_ms"), F.lit(window_ms)).cast("double"), F.col("duration_ms") * ratio))
    left = durations.select("audio_id", allowed.alias("room"), F.lit(max_windows).cast("long").alias("slots"))
    chosen: DataFrame | None = None
    for level in sorted({*PRIORITY.values(), 99}):
        fit = cost.filter(F.col("prio") == level).join(left, "audio_id").filter((F.col("cost") <= F.col("room")) & (F.col("size") <= F.col("slots")) & (F.col("room") > 0))
        best = fit.groupBy("audio_id").agg(F.max_by(F.struct("k", "cost", "size"), "k").alias("b")).select("audio_id", F.lit(level).alias("prio"), F.col("b.k").alias("k"), F.col("b.cost").alias("cost"), F.col("b.size").alias("size"))
        best = checkpoint(best)
        left = left.join(best.select("audio_id", "cost", "size"), "audio_id", "left").select(
            "audio_id", (F.col("room") - F.coalesce("cost", F.lit(0))).alias("room"), (F.col("slots") - F.coalesce("size", F.lit(0))).alias("slots")
        )
        chosen = best if chosen is None else chosen.unionByName(best)
    picked = taken.join(chosen.select("audio_id", "prio", "k"), ["audio_id", "prio", "k"], "left_semi")
    return assign_ids(picked.select("audio_id", START, END, "reasons"), "R", "audio_id", [START, END], "window_id")


def plan_rescue(c: DataFrame, decisions: DataFrame, windows: DataFrame, durations: DataFrame, *, window_ms: int = 12_000, overlap_ms: int = 2_000, **budget) -> DataFrame:
    """Targets, merged, tiled and cut to the budget (L3)."""
    targets = rescue_targets(c, decisions, windows, durations).withColumn("reasons", F.array("reason"))
    tiles = tile(merge_intervals(targets, "audio_id", reasons="reasons"), window_ms, overlap_ms)
    return apply_budget(tiles.select("audio_id", START, END, "reasons"), durations, window_ms=window_ms, **budget)


def distant_repeats(c: DataFrame, *, least_n: int = 2, spread_ms: int = 20_000, no_speech: float = 0.6) -> DataFrame:
    """Texts repeated far apart, always where hardly anyone speaks."""
    rows = c.withColumn("norm", norm_text(F.col("text"))).filter("norm <> ''")
    return (
        rows.groupBy("audio_id", "norm")
        .agg(F.count(F.lit(1)).alias("n"), (F.max(START) - F.min(START)).alias("spread_ms"), F.min("no_speech_prob").alias("low"), F.count("no_speech_prob").alias("known"))
        .filter((F.col("n") >= least_n) & (F.col("spread_ms") >= spread_ms) & (F.col("known") == F.col("n")) & (F.col("low") >= no_speech))
        .select("audio_id", "norm", "n", "spread_ms")
    )


def credible_hits(v3: DataFrame, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """v3 rows with suppressed: high no-speech rows that are templates or distant repeats."""
    rows = v3.withColumn("norm", norm_text(F.col("text")))
    bad = match_templates(v3, templates).select("event_id", F.lit(True).alias("t"))
    far = distant_repeats(v3).select("audio_id", "norm", F.lit(True).alias("r"))
    joined = rows.join(bad, "event_id", "left").join(far, ["audio_id", "norm"], "left")
    quiet = F.coalesce(F.col("no_speech_prob") >= 0.6, F.lit(False))
    return joined.withColumn("suppressed", quiet & (F.coalesce("t", F.lit(False)) | F.coalesce("r", F.lit(False)))).drop("t", "r", "norm")


def plan_targets(v3: DataFrame, durations: DataFrame, *, pad_ms: int = 750, window_ms: int = 8_000, max_windows: int = 24, max_total_ms: int = 120_000, ratio: float = 0.35, near_full: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(windows, guard): narrow windows around credible hits; a recording over its limits gets none (L4, E5)."""
    hits = credible_hits(v3).filter("not suppressed")
    spans = _padded(hits, durations, pad_ms, "credible_v3_candidate").filter(F.col(END) > F.col(START))
    merged = merge_intervals(spans, "audio_id")
    tiles = tile(merged.select("audio_id", START, END), window_ms, min(500, window_ms // 4))
    size = F.sum(F.col(END) - F.col(START))
    guard = (
        durations.select("audio_id", "duration_ms")
        .join(tiles.groupBy("audio_id").agg(F.count(F.lit(1)).alias("windows"), size.alias("inference_ms")), "audio_id", "left")
        .join(merged.groupBy("audio_id").agg(size.alias("unique_ms")), "audio_id", "left").na.fill(0)
        .withColumn("allowed_ms", F.least(F.lit(max_total_ms).cast("double"), F.col("duration_ms") * ratio))
    )
    guard = guard.withColumn("reasons", F.array_compact(F.array(
        F.when(F.col("windows") > max_windows, F.lit("window_count_limit")),
        F.when(F.col("inference_ms") > F.col("allowed_ms"), F.lit("coverage_duration_limit")),
        F.when(F.col("unique_ms") / F.col("duration_ms") >= near_full, F.lit("near_full_audio_coverage")),
    )))
    fine = guard.filter(F.size("reasons") == 0).select("audio_id")
    return assign_ids(tiles.join(fine, "audio_id", "left_semi"), "T", "audio_id", [START, END], "window_id"), guard


def offset_candidates(local: DataFrame, windows: DataFrame) -> DataFrame:
    """Window-local times moved by the window's start."""
    w = windows.select("audio_id", "window_id", F.col(START).alias("w_start"))
    return local.join(w, ["audio_id", "window_id"]).withColumns({START: F.col(START) + F.col("w_start"), END: F.col(END) + F.col("w_start")}).drop("w_start")


def consolidate_rescue(local: DataFrame, windows: DataFrame) -> DataFrame:
    """Offset, deduplicated by text and numbered anew."""
    rows = offset_candidates(local, windows).withColumn("norm", norm_text(F.col("text"))).withColumn("window_ids", F.array("window_id"))
    return assign_ids(dedup_overlapping(rows, by=["audio_id", "norm"]), "rescue:", "audio_id", [START, END, "event_id"], "evidence_id")
