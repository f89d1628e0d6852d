"""Candidates of several recognizers: filters, support, labels, alignment windows, run upserts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import TEMPLATES, char_histogram, norm_text, norms_support
from .graph import checkpoint, connected_components
from .intervals import END, START, interval_pairs, overlap_join, with_islands
from .walk import walk_groups

#: On normal forms (J1); None: containment, or similarity of 0.62 where histograms allow it.
Support = Callable[[Column, Column], Column] | None
CREDIBLE = 0.6


def is_suspicious(no_speech: Column, logprob: Column, t_no_speech: float = 0.5, t_logprob: float = -0.8) -> Column:
    """High no-speech or low log probability; null and non-finite values say nothing."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.coalesce(finite(no_speech) & (no_speech >= t_no_speech), F.lit(False)) | F.coalesce(finite(logprob) & (logprob <= t_logprob), F.lit(False))


def usable_candidates(c: DataFrame, quarantined: DataFrame, suppressed: DataFrame, key: str = "event_id") -> DataFrame:
    """Neither quarantined nor for review only, and of positive duration."""
    return c.filter(F.col(END) > F.col(START)).join(quarantined.select(key), key, "left_anti").join(suppressed.select(key), key, "left_anti")


def split_quarantined(c: DataFrame, decisions: DataFrame, role: str, channel: str = "main", key: str = "event_id") -> DataFrame:
    """The role's rows with removed, and whether their recording's text passes through unchanged."""
    mine = c.filter((F.col("model_role") == role) & (F.col("source_channel") == channel))
    bad = decisions.filter(F.col("label") == "hallucination").select(key, F.lit(True).alias("removed"))
    rows = mine.join(bad, key, "left").withColumn("removed", F.coalesce("removed", F.lit(False)))
    any_removed = rows.groupBy("audio_id").agg((~F.bool_or("removed")).alias("pass_through"))
    return rows.join(any_removed, "audio_id")


def match_templates(c: DataFrame, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """Rows whose normalised text is a known template (D3); the list is a constant of a few entries."""
    known = c.sparkSession.createDataFrame([(t,) for t in templates], "t string").select(norm_text(F.col("t")).alias("_norm")).distinct()
    return c.withColumn("_norm", norm_text(F.col("text"))).join(F.broadcast(known), "_norm", "left_semi").drop("_norm")


def supporting_pairs(c: DataFrame, support: Support = None, gap_ms: int = 800) -> DataFrame:
    """Interval pairs of different roles whose texts back one another. Normal forms and histograms are made once a candidate."""
    rows = c.withColumn("norm", norm_text(F.col("text")))
    if support is None:
        rows = rows.withColumn("hist", char_histogram(F.col("norm")))
        pairs = interval_pairs(rows, gap_ms=gap_ms, keep=("norm", "hist", "no_speech_prob"))
        return pairs.filter(norms_support(F.col("norm_a"), F.col("norm_b"), None, F.col("hist_a"), F.col("hist_b")))
    return interval_pairs(rows, gap_ms=gap_ms, keep=("norm", "no_speech_prob")).filter(support(F.col("norm_a"), F.col("norm_b")))


def supported_candidates(c: DataFrame, support: Support = None) -> DataFrame:
    """Candidates with a supporting partner."""
    ids = supporting_pairs(c, support).select(F.col("event_id_a").alias("event_id")).distinct()
    return c.join(ids, "event_id", "left_semi")


def unsupported_templates(c: DataFrame, support: Support = None, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """Turbo rows that are templates without a credible v3 row of supporting text beside them."""
    credible = supporting_pairs(c, support).filter(
        (F.col("model_role_a") == "turbo") & (F.col("model_role_b") == "v3") & (F.col("no_speech_prob_b").isNull() | (F.col("no_speech_prob_b") < CREDIBLE))
    )
    turbo = match_templates(c.filter(F.col("model_role") == "turbo"), templates)
    return turbo.join(credible.select(F.col("event_id_a").alias("event_id")).distinct(), "event_id", "left_anti")


def classify(c: DataFrame, support: Support = None, templates: tuple[str, ...] = TEMPLATES, *, quarantine_shared: bool = False) -> DataFrame:
    """event_id, label and reasons of every candidate (L2).

    In order: a shared template (only when asked for), an unsupported turbo template, supported,
    else uncertain with acoustic reasons.
    """
    pairs = supporting_pairs(c, support)
    facts = pairs.groupBy(F.col("event_id_a").alias("event_id")).agg(
        F.lit(True).alias("supported"),
        F.bool_or((F.col("model_role_b") == "v3") & (F.col("no_speech_prob_b").isNull() | (F.col("no_speech_prob_b") < CREDIBLE))).alias("credible"),
    )
    known = match_templates(c, templates).select("event_id", F.lit(True).alias("template"))
    rows = c.join(facts, "event_id", "left").join(known, "event_id", "left")
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    shared = yes("template") & F.lit(quarantine_shared)
    alone = yes("template") & (F.col("model_role") == "turbo") & ~yes("credible")
    label = F.when(shared | alone, "hallucination").when(yes("supported"), "supported").otherwise("uncertain")
    reasons = F.array_compact(F.array(
        F.when(shared, F.lit("shared_template")), F.when(~shared & alone, F.lit("unsupported_template")),
        F.when(label == "supported", F.lit("cross_model_support")),
        F.when((label == "uncertain") & (F.col("no_speech_prob") >= 0.75), F.lit("high_no_speech")),
        F.when((label == "uncertain") & (F.col("avg_logprob") <= -1.2), F.lit("low_logprob")),
        F.when((label == "uncertain") & F.col("legacy_srt"), F.lit("legacy_srt")),
    ))
    return rows.select("audio_id", "event_id", label.alias("label"), reasons.alias("reasons"))


def with_labels(c: DataFrame, decisions: DataFrame, key: str = "event_id") -> DataFrame:
    """Candidates with their label, uncertain where none was given."""
    return c.join(decisions.select(key, "label"), key, "left").withColumn("label", F.coalesce("label", F.lit("uncertain")))


def slice_components(members: DataFrame, max_ms: int = 15_000) -> DataFrame:
    """Slices of components (audio_id, component, start_ms, end_ms) at natural ends.

    A component within the limit is one slice, in plain SQL. Longer ones are cut one after another:
    at the latest member end within the limit, else at the limit.
    """
    bounds = members.groupBy("audio_id", "component").agg(F.min(START).alias(START), F.max(END).alias(END))
    short = bounds.filter(F.col(END) - F.col(START) <= max_ms).select("audio_id", "component", START, END, F.lit(False).alias("split"))
    long_ = bounds.filter(F.col(END) - F.col(START) > max_ms).select("audio_id", "component")

    def cut(key: tuple, rows: list[tuple]) -> list[tuple]:
        at, last = min(r[0] for r in rows), max(r[1] for r in rows)
        ends, out = sorted({r[1] for r in rows}), []
        while at < last:
            limit = min(at + max_ms, last)
            k = bisect_right(ends, limit) - 1
            to = ends[k] if k >= 0 and ends[k] > at else limit
            out.append((*key, at, to, True))
            at = to
        return out

    keys = ["audio_id", "component"]
    rows = members.join(long_, keys, "left_semi")
    return short.unionByName(walk_groups(rows, keys, [], [START, END], cut, short.schema))


def window_members(slices: DataFrame, members: DataFrame, key: str = "event_id") -> DataFrame:
    """Members that meet a slice, without those that only end where it starts."""
    keys = ["audio_id", "component"]
    m = members.select(*keys, key, "model_role", F.col(START).alias("m_start"), F.col(END).alias("m_end"))
    meets = (F.col("m_start") <= F.col(END)) & (F.col("m_end") >= F.col(START)) & ~((F.col("m_end") == F.col(START)) & (F.col("m_start") < F.col(START)))
    return overlap_join(slices, m, keys, (START, END), ("m_start", "m_end")).filter(meets)


def components(c: DataFrame, gap_ms: int = 800) -> DataFrame:
    """Candidates with their component: linked only through rows of another role (L1).

    A component never leaves its island, so islands are joined up one by one, each in one pass over
    its rows in time order. component_table() does the same from pairs for islands of any size.
    """
    slim = with_islands(c, "audio_id", gap_ms).select("audio_id", "island", "event_id", "model_role", START, END)

    def join_up(key: tuple, rows: list[tuple]) -> list[tuple]:
        up = {r[0]: r[0] for r in rows}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        live: list[tuple[int, str, int]] = []
        for e, role, start, end in rows:
            live = [x for x in live if start <= x[2] + gap_ms]
            for other, other_role, _ in live:
                if other_role != role:
                    a, b = top(e), top(other)
                    up[max(a, b)] = min(a, b)
            live.append((e, role, end))
        return [(e, top(e)) for e in up]

    found = walk_groups(slim, ["audio_id", "island"], [START, END, "event_id"], ["event_id", "model_role", START, END], join_up, "event_id long, component long")
    return c.join(found, "event_id")


def component_table(c: DataFrame, gap_ms: int = 800) -> DataFrame:
    """event_id, component by rounds over the pairs: for islands too large for one task."""
    edges = interval_pairs(c, gap_ms=gap_ms).select(F.col("event_id_a").alias("a"), F.col("event_id_b").alias("b")).filter("a < b")
    labels = connected_components(edges).select(F.col("v").alias("event_id"), F.col("c").alias("component"))
    return c.select("event_id").join(labels, "event_id", "left").withColumn("component", F.coalesce("component", "event_id"))


def align_candidates(c: DataFrame, gap_ms: int = 800, max_ms: int = 15_000) -> DataFrame:
    """Windows with members: audio_id, component, start_ms, end_ms, split, event_id, model_role (L1)."""
    members = checkpoint(components(c, gap_ms))
    return window_members(slice_components(members, max_ms), members)


def window_table(aligned: DataFrame) -> DataFrame:
    """One row per window: sorted evidence ids and roles, numbered in time order."""
    from .intervals import assign_ids

    rows = aligned.groupBy("audio_id", "component", START, END, "split").agg(
        F.array_sort(F.collect_list("event_id")).alias("evidence_ids"), F.array_sort(F.collect_set("model_role")).alias("model_roles")
    )
    first = rows.withColumn("group_start", F.min(START).over(_window("audio_id", "component")))
    return assign_ids(first, "W", "audio_id", ["group_start", "component", START], "window_id").drop("group_start")


def _window(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def label_windows(aligned: DataFrame, decisions: DataFrame) -> DataFrame:
    """supported if any member is, hallucination if all are, else uncertain."""
    rows = with_labels(aligned, decisions)
    label = F.when(F.bool_or(F.col("label") == "supported"), "supported").when(F.bool_and(F.col("label") == "hallucination"), "hallucination").otherwise("uncertain")
    return rows.groupBy("audio_id", "component", START, END).agg(label.alias("label"), F.array_sort(F.collect_set("model_role")).alias("model_roles"), F.count(F.lit(1)).alias("n"))


def run_counts(c: DataFrame) -> DataFrame:
    return c.groupBy("audio_id", "run_key").agg(F.count(F.lit(1)).alias("candidate_count"))


def check_run_counts(c: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs whose recorded count differs, or that stand on one side only."""
    seen = run_counts(c).withColumnRenamed("candidate_count", "seen")
    both = runs.select("audio_id", "run_key", "candidate_count").join(seen, ["audio_id", "run_key"], "full_outer")
    kind = F.when(F.col("candidate_count").isNull(), "unknown_run").when(F.col("seen").isNull(), "empty_run").otherwise("count_mismatch")
    return both.filter(~F.col("candidate_count").eqNullSafe(F.col("seen"))).withColumn("violation", kind)


def run_record(c: DataFrame) -> DataFrame:
    """One row per run: counts, legacy flag and a fingerprint of its identity."""
    return c.groupBy("audio_id", "run_key", "model_role", "source_channel").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.bool_or("legacy_srt").alias("legacy_srt")
    ).withColumn("config_fingerprint", F.sha2(F.concat_ws("|", "run_key", "model_role", "source_channel"), 256))


def upsert_runs(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming runs replace runs of the same key; a main run replaces every main run of its role (H1)."""
    keys = incoming.select("audio_id", "run_key").distinct()
    main = incoming.filter(F.col("source_channel") == "main").select("audio_id", "source_channel", "model_role").distinct()
    kept = current.join(keys, ["audio_id", "run_key"], "left_anti").join(main, ["audio_id", "source_channel", "model_role"], "left_anti")
    return kept.select(*current.columns).unionByName(incoming.select(*current.columns))


def check_evidence(c: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows that break the evidence contract, with the rules they break (K1)."""
    rules = F.array_compact(F.array(
        F.when(F.col("event_id").isNull(), F.lit("missing_id")),
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.lit("empty_text")),
        F.when(F.col(START).isNull() | F.col(END).isNull(), F.lit("missing_time")),
        F.when(F.col(START) < 0, F.lit("negative_start")),
        F.when(F.col(END) < F.col(START), F.lit("unordered_time")),
        F.when(~F.col("source_channel").isin("main", "rescue"), F.lit("bad_channel")),
        F.when(~F.col("model_role").isin("v3", "turbo", "gal"), F.lit("bad_role")),
    ))
    twice = c.groupBy("audio_id", "event_id").count().filter("count > 1").select("audio_id", "event_id", F.lit("duplicate_id").alias("rule"))
    counts = check_run_counts(c, runs).select("audio_id", F.lit(None).cast("long").alias("event_id"), F.col("violation").alias("rule"))
    return c.select("audio_id", "event_id", F.explode(rules).alias("rule")).unionByName(twice).unionByName(counts)


def excluded_evidence(quarantined: DataFrame, suppressed: DataFrame, key: str = "event_id") -> DataFrame:
    """Quarantined rows, then suppressed ones that are not quarantined, with the reason (H4)."""
    q = quarantined.select(key).distinct()
    s = suppressed.select(key).distinct().exceptAll(q)
    return q.withColumn("reason", F.lit("quarantined_hallucination")).unionByName(s.withColumn("reason", F.lit("review_only_rescue_suppression")))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only (H5); no rows means equal sets."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    return ka.exceptAll(kb).withColumn("side", F.lit("left_only")).unionByName(kb.exceptAll(ka).withColumn("side", F.lit("right_only")))
