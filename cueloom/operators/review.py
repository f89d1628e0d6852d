"""Human review: matching cues to the timeline, the work-list, decisions and what they make of the cues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import norm_text, text_violations
from ..functions.timecode import iou
from . import scans
from .intervals import END, START

#: The reason that says no more than that an alignment is to be looked at, and those about time.
ALIGNMENT_REASON = "script_alignment_review"
TIMING_REASONS = ("timeline_requires_review", "shared_timeline_window", "group_level_timing_only")


def match_cues(cues: DataFrame, items: DataFrame, bucket_ms: int = 15_000) -> DataFrame:
    """cue -> timeline item: the only exact one (2 ms at both ends), else the unique best IoU of 0.8 or more, else by place.

    Candidates meet through shared time buckets, an equi join.
    By place: when a recording's cues and items are as many and no match contradicts it.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - 2) / bucket_ms), F.floor((F.col(b) + 2) / bucket_ms)))
    c = cues.select("audio_id", "cue_index", START, END).withColumn("bucket", buckets(START, END))
    t = items.select("audio_id", "timeline_id", F.col(START).alias("t_start"), F.col(END).alias("t_end")).withColumn("bucket", buckets("t_start", "t_end"))
    exact = (F.abs(F.col("t_start") - F.col(START)) <= 2) & (F.abs(F.col("t_end") - F.col(END)) <= 2)
    pairs = c.join(t, ["audio_id", "bucket"]).drop("bucket").distinct().withColumns({"exact": exact, "score": iou(F.col(START), F.col(END), F.col("t_start"), F.col("t_end"))})
    w = Window.partitionBy("audio_id", "cue_index")
    best = w.orderBy(F.desc("score"), "timeline_id")
    ranked = pairs.withColumns({"n_exact": F.count_if("exact").over(w), "rn": F.row_number().over(best), "runner": F.lead("score").over(best)})
    chosen = ranked.groupBy("audio_id", "cue_index").agg(
        F.max(F.when((F.col("n_exact") == 1) & F.col("exact"), F.col("timeline_id"))).alias("by_exact"),
        F.max(F.when((F.col("rn") == 1) & (F.col("score") >= 0.8) & (F.col("runner").isNull() | (F.col("score") > F.col("runner"))), F.col("timeline_id"))).alias("by_iou"),
    )
    matched = cues.select("audio_id", "cue_index").join(chosen, ["audio_id", "cue_index"], "left").withColumn("timeline_id", F.coalesce("by_exact", "by_iou"))
    counts = items.groupBy("audio_id").agg(F.count(F.lit(1)).alias("n_items"))
    a = Window.partitionBy("audio_id")
    placed = matched.join(counts, "audio_id", "left").withColumn("by_place", F.format_string("TL%06d", "cue_index"))
    fits = (F.count(F.lit(1)).over(a) == F.col("n_items")) & (F.max("cue_index").over(a) == F.col("n_items")) & (F.min((F.col("timeline_id").isNull() | (F.col("timeline_id") == F.col("by_place"))).cast("int")).over(a) == 1)
    return placed.withColumn("timeline_id", F.coalesce("timeline_id", F.when(fits, F.col("by_place")))).select("audio_id", "cue_index", "timeline_id")


def match_long_cues(cues: DataFrame, proposals: DataFrame) -> DataFrame:
    """Cues with their proposal by exact bounds: applied ones by the new bounds, others by the original."""
    p = proposals.select("audio_id", F.when(F.col("applied"), F.col("new_start")).otherwise(F.col("old_start")).alias(START), F.when(F.col("applied"), F.col("new_end")).otherwise(F.col("old_end")).alias(END), "source_index", "status")
    unique = p.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("audio_id", START, END))).filter("n = 1").drop("n")
    return cues.select("audio_id", "cue_index", START, END).join(unique, ["audio_id", START, END], "left")


def with_versions(cues: DataFrame, fused: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Earlier text versions beside the current one, which stands in where one is missing."""
    keys = ["audio_id", "cue_index"]
    out = cues.join(fused.select(*keys, F.col("text").alias("fused")), keys, "left").join(reviewed.select(*keys, F.col("text").alias("reviewed")), keys, "left")
    return out.withColumns({"fused": F.coalesce("fused", "text"), "reviewed": F.coalesce("reviewed", "text")})


def script_reasons(matches: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Reasons per timeline item from matches and unmatched rows, both with timeline_ids and reasons arrays."""
    flat = lambda df: df.select("audio_id", F.explode("timeline_ids").alias("timeline_id"), "reasons").select("audio_id", "timeline_id", F.explode("reasons").alias("reason"))
    return flat(matches).unionByName(flat(unmatched)).groupBy("audio_id", "timeline_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def candidate_public(c: DataFrame, romanize=None) -> DataFrame:
    """What a reviewer sees of a candidate (C4)."""
    shown = c.select("audio_id", "event_id", START, END, F.col("text").alias("text_ja"), "model_role", F.struct("avg_logprob", "no_speech_prob").alias("confidence"), "legacy_srt")
    return shown.withColumn("romanized", romanize(F.col("text_ja"))) if romanize else shown


def overlap_review(items: DataFrame) -> DataFrame:
    """Partitioned items beside a small gap, whose boundary moved far (F6). items: shift_ms, timing_kind."""
    w = Window.partitionBy("audio_id").orderBy(START, END, "timeline_id")
    small = lambda gap: F.coalesce((gap > 0) & (gap <= 1000), F.lit(False))
    before, after = F.col(START) - F.lag(END).over(w), F.lead(START).over(w) - F.col(END)
    return items.withColumn("needs_review", F.col("timing_kind").contains("overlap") & (small(before) | small(after)) & (F.col("shift_ms") >= 500))


def with_context(items: DataFrame, *, spread: bool = False) -> DataFrame:
    """Ids of the previous and next subtitle row, other kinds skipped (F7). spread: by blocks, for recordings with a large part of all rows."""
    is_sub = F.col("kind") == "subtitle"
    if spread:
        by, order = ["audio_id"], [START, "id"]
        rows = scans.in_blocks(items, by, order)
        rows = scans.neighbour(rows, by, order, F.col("id"), "prev_id", ahead=False, only=is_sub)
        return scans.neighbour(rows, by, order, F.col("id"), "next_id", only=is_sub).select(*items.columns, "prev_id", "next_id")
    sub = F.when(is_sub, F.col("id"))
    w = Window.partitionBy("audio_id").orderBy(START, "id")
    return items.withColumns({
        "prev_id": F.last(sub, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "next_id": F.first(sub, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })


def review_items(cues: DataFrame, items: DataFrame, c: DataFrame, support, timing, reasons: DataFrame | None = None) -> DataFrame:
    """The work-list: cues with their timeline item and its text, timing and informational flags.

    cues: text_ja, text_zh. items: timeline_id, classification, review_required, timing_kind, evidence_ids.
    support, timing: (Column, Column) -> Column on the normal forms (J1) of cue and candidate text. reasons: what a script's
    alignment says of items (script_reasons). Given them, they alone ask for review besides doubtful
    evidence: an item's own request, settled disagreements and overlaps without a reason about time
    are left out (the script filter).
    """
    keys = ["audio_id", "cue_index"]
    placed = cues.join(match_cues(cues, items), keys, "left").join(items.select("audio_id", "timeline_id", "classification", "review_required", "timing_kind", "evidence_ids"), ["audio_id", "timeline_id"], "left")
    rows = placed.select(*keys, START, END, norm_text(F.col("text_ja")).alias("norm"), F.explode("evidence_ids").alias("event_id")).join(
        c.select("event_id", norm_text(F.col("text")).alias("c_norm"), F.col(START).alias("c_start"), F.col(END).alias("c_end")), "event_id"
    )
    fits = timing(F.col("c_norm"), F.col("norm"))
    facts = rows.withColumns({"backs": support(F.col("norm"), F.col("c_norm")), "fits": fits}).groupBy(*keys).agg(
        F.bool_or("backs").alias("backed"), F.size(F.array_remove(F.collect_set("c_norm"), "")).alias("n_texts"), F.bool_or("fits").alias("any_fit"),
        F.min(F.when(F.col("fits"), F.col("c_start"))).alias("s0"), F.max(F.when(F.col("fits"), F.col("c_start"))).alias("s1"),
        F.min(F.when(F.col("fits"), F.col("c_end"))).alias("e0"), F.max(F.when(F.col("fits"), F.col("c_end"))).alias("e1"),
    )
    full = placed.join(facts, keys, "left")
    backed = F.coalesce("backed", F.lit(False))
    has = F.col("timeline_id").isNotNull()
    spread = F.coalesce("any_fit", F.lit(False)) & (
        (F.greatest("s1", START) - F.least("s0", START) > 1500) | (F.greatest("e1", END) - F.least("e0", END) > 1500)
    )
    low = F.concat("text_ja", "text_zh").rlike("〔認識不良〕|（低信頼度）|\\(低信頼度\\)")
    doubt = has & (F.col("classification") != "supported") & ~backed
    if reasons is not None:
        full = full.join(reasons.select("audio_id", "timeline_id", "reasons"), ["audio_id", "timeline_id"], "left")
    else:
        full = full.withColumn("reasons", F.lit(None).cast("array<string>"))
    filtered = reasons is not None
    given = F.when(has, F.filter(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: r != ALIGNMENT_REASON)).otherwise(F.array().cast("array<string>"))
    about_time = F.filter(given, lambda r: r.isin(*TIMING_REASONS))
    wanted = has & F.col("review_required") & ~backed & F.lit(not filtered)
    first = F.concat(F.array_compact(F.array(F.when(doubt, F.lit("uncertain")), F.when(doubt, F.lit("uncertain_asr_evidence")), F.when(wanted, F.lit("uncertain")))), F.filter(given, lambda r: ~r.isin(*TIMING_REASONS)))
    differ = (F.col("n_texts") > 1) & ((F.size(first) > 0) if filtered else ~backed)
    flags = F.array_distinct(F.concat(first, F.array_compact(F.array(F.when(differ, F.lit("model_disagreement")), F.when(low, F.lit("low_confidence"))))))
    overlap = has & F.col("timing_kind").contains("overlap")
    times = F.array_compact(F.array(F.when(overlap & (F.size(about_time) > 0), F.lit("overlap")), F.when(has & spread, F.lit("boundary_disagreement"))))
    info = F.array_compact(F.array(F.when(overlap, F.lit("overlap_partitioned")), F.when((F.col("n_texts") > 1) & backed, F.lit("model_disagreement_resolved"))))
    told = F.array().cast("array<string>") if filtered else info
    return full.select(*keys, "timeline_id", START, END, "text_ja", "text_zh", flags.alias("text_flags"), F.array_distinct(F.concat(about_time, times)).alias("timing_flags"), told.alias("informational_flags"))


def join_decisions(items: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ("audio_id", "cue_index")) -> DataFrame:
    """Items without a decision, decisions without an item."""
    both = items.select(*keys, F.lit(True).alias("i")).join(decisions.select(*keys, F.lit(True).alias("d")), list(keys), "full_outer")
    return both.filter("i IS NULL OR d IS NULL").select(*keys, F.when(F.col("d").isNull(), "missing_decision").otherwise("unknown_item").alias("rule"))


#: Texts of the halves of a split cue.
SPLIT_TEXTS = ("split_ja_before", "split_ja_after", "split_zh_before", "split_zh_after")


def with_split_texts(decisions: DataFrame) -> DataFrame:
    """decisions with all of SPLIT_TEXTS, null where it lacks them."""
    return decisions.withColumns({c: F.lit(None).cast("string") for c in SPLIT_TEXTS if c not in decisions.columns})


def check_review(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that break the submission contract (K6)."""
    keys = ["audio_id", "cue_index"]
    decisions = with_split_texts(decisions)
    halves = [F.trim(F.coalesce(c, F.lit(""))) for c in SPLIT_TEXTS]
    unsafe = [F.size(F.filter(text_violations(F.col(c)), lambda v: ~v.isin("empty", *(() if c.startswith("split_ja") else ("newline",))))) > 0 for c in SPLIT_TEXTS]
    w = Window.partitionBy("audio_id").orderBy("cue_index")
    rows = items.select(*keys, START, END).join(decisions, keys).withColumns({"next_action": F.lead("action").over(w), "next_structure": F.lead("structure").over(w), "next_end": F.lead(F.coalesce("edited_end", END)).over(w)})
    start, end = F.coalesce("edited_start", START), F.coalesce("edited_end", END)
    merge = F.col("structure") == "merge_next"
    rules = F.array_compact(F.array(
        F.when(~F.col("action").isin("keep", "edit", "accept", "reject"), F.lit("bad_action")),
        F.when(F.col("action").isin("edit", "accept") & (F.size(text_violations(F.col("edited_zh"))) > 0), F.lit("unsafe_text")),
        F.when(end <= start, F.lit("no_duration")),
        F.when((F.col("structure") == "split") & ~((F.col("split_at") > start) & (F.col("split_at") < end)), F.lit("split_outside")),
        F.when((F.col("structure") == "split") & reduce(lambda a, b: a | b, [h == "" for h in halves]), F.lit("split_text_missing")),
        F.when((F.col("structure") == "split") & reduce(lambda a, b: a | b, unsafe), F.lit("unsafe_split_text")),
        F.when(merge & F.col("next_action").isNull(), F.lit("merge_last")),
        F.when(merge & (F.col("next_action") == "reject"), F.lit("merge_rejected")),
        F.when(merge & (F.col("next_structure") != "keep"), F.lit("merge_structured")),
        F.when(merge & (F.col("next_end") <= start), F.lit("merge_no_duration")),
    ))
    return rows.select(*keys, F.explode(rules).alias("rule")).unionByName(join_decisions(items, decisions))


def apply_review(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cues after decisions: rejected ones go, edits apply, splits give two, merge_next takes the next one's end and text.

    decisions: action, structure (keep, split, merge_next), edited_ja, edited_zh, edited_start, edited_end,
    split_at, and split_ja_before, split_ja_after, split_zh_before, split_zh_after, the texts of a
    split's halves. check_review refuses splits without them; here their halves have null texts.
    """
    decisions = with_split_texts(decisions)
    keys = ["audio_id", "cue_index"]
    rows = items.join(decisions, keys).withColumn("edits", F.col("action").isin("edit", "accept"))
    rows = rows.withColumns({
        START: F.coalesce("edited_start", START), END: F.coalesce("edited_end", END),
        "text_ja": F.when(F.col("edits"), F.coalesce("edited_ja", "text_ja")).otherwise(F.col("text_ja")),
        "text_zh": F.when(F.col("edits"), F.coalesce("edited_zh", "text_zh")).otherwise(F.col("text_zh")),
    })
    w = Window.partitionBy("audio_id").orderBy("cue_index")
    nxt = F.lead(F.struct(END, "text_ja", "text_zh")).over(w)
    rows = rows.withColumns({"nxt": nxt, "consumed": F.coalesce((F.lag("structure").over(w) == "merge_next") & (F.lag("action").over(w) != "reject"), F.lit(False))})
    live = rows.filter((F.col("action") != "reject") & ~F.col("consumed"))
    cue = lambda s, e, i, ja, zh: F.struct(s.alias(START), e.alias(END), i.alias("id"), ja.alias("text_ja"), zh.alias("text_zh"))
    s, e, ja, zh, i = F.col(START), F.col(END), F.col("text_ja"), F.col("text_zh"), F.col("cue_index").cast("string")
    cut = F.col("split_at")
    out = (
        F.when(F.col("structure") == "split", F.array(cue(s, cut, F.concat(i, F.lit("-A")), F.col("split_ja_before"), F.col("split_zh_before")), cue(cut, e, F.concat(i, F.lit("-B")), F.col("split_ja_after"), F.col("split_zh_after"))))
        .when((F.col("structure") == "merge_next") & F.col("nxt").isNotNull(), F.array(cue(s, F.col(f"nxt.{END}"), F.concat(i, F.lit("+"), (F.col("cue_index") + 1).cast("string")), F.concat(ja, F.col("nxt.text_ja")), F.concat(zh, F.col("nxt.text_zh")))))
        .otherwise(F.array(cue(s, e, i, ja, zh)))
    )
    cues = live.select("audio_id", F.explode(out).alias("c")).select("audio_id", "c.*")
    return cues.withColumn("cue_index", F.row_number().over(Window.partitionBy("audio_id").orderBy(START, END, "id")).cast("long"))
