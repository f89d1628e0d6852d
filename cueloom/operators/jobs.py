"""Whole jobs: the audit of a corpus' evidence and a text stage from stale inputs to rendered files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.subtitles import render_srt
from . import batches, evidence, rescue, timeline
from .graph import checkpoint
from .intervals import END, START


class Audit(NamedTuple):
    """What one snapshot of evidence gives, all rows under their recording's generation id."""

    labels: DataFrame
    windows: DataFrame
    timeline: DataFrame
    rescue_plan: DataFrame
    manifest: DataFrame


def generations(c: DataFrame) -> DataFrame:
    """audio_id, generation: a fingerprint of a recording's candidates, whatever their order."""
    row = F.xxhash64("event_id", "run_key", START, END, "text", "avg_logprob", "no_speech_prob")
    parts = c.groupBy("audio_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s"))
    return parts.select("audio_id", "n_candidates", F.sha2(F.concat_ws("|", "n_candidates", "x", "s"), 256).alias("generation"))


def evidence_audit(c: DataFrame, runs: DataFrame, durations: DataFrame, *, support=None, timeline_support=timeline.python_support, **budget) -> Audit:
    """Align, classify, build the timeline and plan the rescue of every recording, from one snapshot.

    runs: audio_id, run_key, source_relation. A recording with a run whose source isn't "matched" is
    refused as a whole: it stands in the manifest and nowhere else.
    """
    refused = runs.filter(~F.col("source_relation").eqNullSafe("matched")).select("audio_id").distinct()
    made = checkpoint(generations(c))
    mine = checkpoint(c.join(refused, "audio_id", "left_anti"))
    labels = checkpoint(evidence.classify(mine, support))
    aligned = checkpoint(evidence.align_candidates(mine))
    keys = ["audio_id", "component", START, END]
    told = checkpoint(evidence.label_windows(aligned, labels))
    items = checkpoint(timeline.build_timeline(mine, labels, timeline_support))
    lengths = durations.join(refused, "audio_id", "left_anti").join(made, "audio_id", "left_semi")
    plan = checkpoint(rescue.plan_rescue(mine, labels, aligned.join(told.select(*keys, "label"), keys), lengths, **budget))
    manifest = made.join(refused.withColumn("refused", F.lit(True)), "audio_id", "left")
    for table, name in ((told, "n_windows"), (items, "n_items"), (plan, "n_rescue")):
        manifest = manifest.join(table.groupBy("audio_id").agg(F.count(F.lit(1)).alias(name)), "audio_id", "left")
    manifest = manifest.select("audio_id", "generation", F.when(F.col("refused"), "refused").otherwise("complete").alias("status"), "n_candidates", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_windows", "n_items", "n_rescue")])
    with_id = lambda df: df.join(made.select("audio_id", "generation"), "audio_id")
    return Audit(with_id(labels), with_id(told), with_id(items), with_id(plan), manifest)


def text_fingerprints(cues: DataFrame) -> DataFrame:
    """audio_id, sha: of a recording's cue texts in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("cue_index", "text"))), lambda x: x["text"])
    return cues.groupBy("audio_id").agg(F.sha2(F.array_join(texts, "\n"), 256).alias("sha"))


def run_stage(cues: DataFrame, stale: DataFrame, batched: DataFrame, replies: DataFrame, *, batch_size: int) -> DataFrame:
    """audio_id, srt and n_changed of the stale recordings: batches met with their replies, put back and rendered."""
    rows = batches.reconcile(batched, replies).join(stale, "audio_id", "left_semi").withColumn("pos", F.col("batch") * batch_size + F.col("place"))
    placed = cues.withColumn("pos", F.row_number().over(Window.partitionBy("audio_id").orderBy("cue_index")) - 1)
    after = placed.join(rows.select("audio_id", "pos", F.col("text").alias("new")), ["audio_id", "pos"])
    changed = after.groupBy("audio_id").agg(F.count_if(F.trim("text") != F.trim("new")).alias("n_changed"))
    return render_srt(after.withColumn("text", F.col("new"))).join(changed, "audio_id")
