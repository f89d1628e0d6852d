"""Queries over the fused timeline and the review of cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import evidence as ev, intervals as iv, jobs, review as rv, timeline as tl
from .cue_queries import CUE, cue
from .evidence_queries import C, LABELS, cand, contains_only, joined, labels
from .fixtures import fx
from .registry import query

WORDS = """wd AS (SELECT event_id, audio_id, start_ms, end_ms, text, legacy_srt, string_split(text, ' ') AS p FROM fx_candidate),
words AS (SELECT event_id, unnest(range(len(p))) AS i, unnest(p) AS t, len(p) AS n, start_ms, end_ms FROM wd WHERE NOT legacy_srt),
wt AS (SELECT event_id, t, CAST(floor(start_ms + (end_ms - start_ms) * i / n) AS BIGINT) AS s, CAST(floor(start_ms + (end_ms - start_ms) * (i + 1) / n) AS BIGINT) AS e FROM words)"""
RANK = """CASE WHEN source_channel = 'rescue' AND model_role = 'v3' AND NOT legacy_srt THEN 0 WHEN source_channel = 'main' AND model_role = 'v3' AND NOT legacy_srt THEN 1
WHEN source_channel = 'main' AND model_role = 'turbo' AND NOT legacy_srt THEN 2 WHEN source_channel = 'rescue' AND model_role = 'turbo' THEN 3
WHEN source_channel = 'main' AND model_role = 'v3' THEN 4 WHEN source_channel = 'main' AND model_role = 'turbo' THEN 5 ELSE 6 END"""


@query("f4_anchor", f"""g AS (SELECT *, CAST(floor(event_id / 5) AS BIGINT) AS grp, {RANK} AS rank FROM fx_candidate)
SELECT audio_id, grp, event_id, rank FROM g QUALIFY row_number() OVER (PARTITION BY audio_id, grp ORDER BY rank, coalesce(avg_logprob, -100) DESC, event_id) = 1""", C)
def _(s, d):
    c = tl.with_words(cand(s, d)).withColumn("grp", F.floor(F.col("event_id") / 5))
    return tl.pick_anchor(c, ["audio_id", "grp"]).select("audio_id", "grp", "event_id", "rank")


@query("i4_fragments", WORDS + """, sl AS (SELECT event_id, start_ms + 100 AS a, CAST(floor((start_ms + end_ms) / 2) AS BIGINT) + 1 AS b, start_ms, end_ms, text, legacy_srt FROM fx_candidate),
fr AS (SELECT sl.event_id, string_agg(t, '' ORDER BY s, wt.rowid_) AS fragment, min(s) AS evidence_start, max(e) AS evidence_end FROM sl JOIN (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s, e) AS rowid_ FROM wt) wt USING (event_id) WHERE s + e >= 2 * a AND s + e < 2 * b GROUP BY sl.event_id)
SELECT event_id, trim(fragment) AS fragment, evidence_start, evidence_end FROM fr UNION ALL
SELECT event_id, text, start_ms, end_ms FROM sl WHERE legacy_srt AND start_ms + end_ms >= 2 * a AND start_ms + end_ms < 2 * b""", C)
def _(s, d):
    c = tl.with_words(cand(s, d)).withColumn("k", F.col("event_id"))
    sl = cand(s, d).select(F.col("event_id").alias("k"), (F.col("start_ms") + 100).alias("start_ms"), (F.floor((F.col("start_ms") + F.col("end_ms")) / 2) + 1).alias("end_ms"))
    return tl.fragments(c, sl, ["k"]).select("event_id", "fragment", "evidence_start", "evidence_end")


def timeline(s, d) -> DataFrame:
    return tl.build_timeline(cand(s, d), labels(s, d), tl.contains_support)


@query("l6_fusion_timeline")
def _(s, d):
    return timeline(s, d).select("audio_id", "timeline_id", "start_ms", "end_ms", "classification", "review_required", "timing_kind", "anchor_id", joined("evidence_ids").alias("evidence_ids"), "too_long")


@query("l6_greedy_groups")
def _(s, d):
    return tl.group_candidates(cand(s, d), tl.contains_support)


def fours(c: DataFrame) -> DataFrame:
    """event_id, grp: four candidates in a row."""
    return c.select("event_id", F.floor(F.col("event_id") / 4).alias("grp"))


@query("i3_word_slices", WORDS + """,
g AS (SELECT audio_id, CAST(floor(event_id / 4) AS BIGINT) AS grp, min(start_ms) AS gs, max(end_ms) AS ge FROM fx_candidate GROUP BY ALL),
ed AS (SELECT DISTINCT audio_id, CAST(floor(event_id / 4) AS BIGINT) AS grp, unnest([s, e]) AS x FROM wt JOIN fx_candidate USING (event_id)),
cuts(audio_id, grp, a, b, e, cut) AS (
  SELECT audio_id, grp, gs, CASE WHEN ge - gs <= 5000 THEN ge ELSE coalesce((SELECT max(x) FROM ed WHERE ed.audio_id = g.audio_id AND ed.grp = g.grp AND x > gs + 50 AND x <= gs + 5000), gs + 5000) END, ge, ge - gs > 5000 FROM g
  UNION ALL
  SELECT audio_id, grp, b, CASE WHEN e - b <= 5000 THEN e ELSE coalesce((SELECT max(x) FROM ed WHERE ed.audio_id = cuts.audio_id AND ed.grp = cuts.grp AND x > b + 50 AND x <= b + 5000), b + 5000) END, e, cut FROM cuts WHERE b < e)
SELECT audio_id, grp, a AS start_ms, b AS end_ms, cut FROM cuts""", C)
def _(s, d):
    c = tl.with_words(cand(s, d))
    return tl.slice_groups(c.join(fours(c), "event_id"), 5_000)


@query("i3_slices_of_groups")
def _(s, d):
    """The same over greedy groups."""
    c = tl.with_words(cand(s, d))
    return tl.slice_groups(c.join(tl.group_candidates(c, tl.contains_support), "event_id"), 5_000)


ITEMS = """items AS (SELECT audio_id, cue_index AS grp, start_ms, end_ms + CASE WHEN cue_index % 4 = 0 THEN 3000 WHEN cue_index % 7 = 0 THEN 40000 ELSE 0 END AS end_ms FROM fx_cue),
anch AS (SELECT *, start_ms + CASE WHEN grp % 7 = 0 THEN 20000 ELSE 0 END AS anchor_start, end_ms - CASE WHEN grp % 4 = 0 THEN 3000 ELSE 0 END AS anchor_end FROM items),
o0 AS (SELECT *, anchor_start + anchor_end AS mid2, max(end_ms) OVER (PARTITION BY audio_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM anch),
o1 AS (SELECT *, sum(CASE WHEN before IS NULL OR start_ms >= before THEN 1 ELSE 0 END) OVER (PARTITION BY audio_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS cluster FROM o0),
o2 AS (SELECT *, count(*) OVER (PARTITION BY audio_id, cluster) AS n, greatest(start_ms, coalesce((lag(mid2) OVER w + mid2) / 4, start_ms)) AS s, least(end_ms, coalesce((mid2 + lead(mid2) OVER w) / 4, end_ms)) AS e, row_number() OVER w AS place FROM o1 WINDOW w AS (PARTITION BY audio_id, cluster ORDER BY mid2, start_ms, end_ms, grp)),
o3 AS (SELECT *, bool_and(s < e AND s <= mid2 / 2 AND mid2 / 2 <= e) OVER (PARTITION BY audio_id, cluster) AS whole FROM o2)"""


@query("f5_overlap_partition", ITEMS + """ SELECT audio_id, CAST(s AS DOUBLE) AS start_ms, CAST(e AS DOUBLE) AS end_ms, grp AS anchor_id, CASE WHEN n > 1 THEN 'overlap_partition' ELSE 'candidate_bounds' END AS timing_kind FROM o3 WHERE whole OR n = 1
UNION ALL SELECT audio_id, min(start_ms), max(end_ms), arg_min(grp, place), 'unresolved_overlap_cluster' FROM o3 WHERE n > 1 AND NOT whole GROUP BY audio_id, cluster""", CUE)
def _(s, d):
    i = F.col("cue_index")
    end = F.col("end_ms") + F.when(i % 4 == 0, 3000).when(i % 7 == 0, 40000).otherwise(0)
    items = cue(s, d).select(
        "audio_id", i.alias("grp"), "start_ms", end.alias("end_ms"), (F.col("start_ms") + F.when(i % 7 == 0, 20000).otherwise(0)).alias("anchor_start"), (end - F.when(i % 4 == 0, 3000).otherwise(0)).alias("anchor_end"),
        F.lit("supported").alias("classification"), F.lit(False).alias("review_required"), F.lit("candidate_bounds").alias("timing_kind"), i.alias("anchor_id"), F.array(i).alias("evidence_ids"),
    )
    return tl.partition_overlaps(items, 10**9).select("audio_id", "start_ms", "end_ms", "anchor_id", "timing_kind")


@query("f9_timeline_check", """n AS (SELECT *, lag(end_ms) OVER (PARTITION BY audio_id ORDER BY start_ms, end_ms, cue_index) AS before FROM fx_cue)
SELECT audio_id, cue_index AS timeline_id, 'overlap' AS rule FROM n WHERE before > start_ms UNION ALL SELECT audio_id, cue_index, 'too_long' FROM n WHERE end_ms - start_ms > 15000
UNION ALL SELECT audio_id, cue_index, 'anchor_outside' FROM n WHERE cue_index % 3 = 0""", CUE)
def _(s, d):
    t = cue(s, d).withColumns({"timeline_id": F.col("cue_index"), "anchor_mid": F.when(F.col("cue_index") % 3 == 0, F.col("end_ms") + 1).otherwise(F.col("start_ms"))})
    return tl.check_timeline(t)


def loose_items(s, d) -> DataFrame:
    """Items of four candidates in a row, whole, numbered in time order."""
    c = tl.with_words(ev.with_labels(cand(s, d), labels(s, d)))
    return iv.assign_ids(tl.build_items(c, fours(c), 10**9), "TL", "audio_id", ["start_ms", "end_ms", "anchor_id"], "timeline_id")


LOOSE = LABELS.strip() + f""",
li AS (SELECT c.*, label, CAST(floor(event_id / 4) AS BIGINT) AS grp, {RANK} AS rank, row_number() OVER (PARTITION BY audio_id, floor(event_id / 4) ORDER BY {RANK}, coalesce(avg_logprob, -100) DESC, event_id) AS place FROM fx_candidate c JOIN (SELECT event_id, label FROM labels) USING (event_id)),
it AS (SELECT audio_id, grp, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CASE WHEN bool_or(label = 'supported') THEN 'supported' ELSE 'uncertain' END AS classification, min(event_id) FILTER (place = 1) AS anchor_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY place) AS evidence_ids FROM li GROUP BY audio_id, grp),
nu AS (SELECT *, printf('TL%06d', row_number() OVER (PARTITION BY audio_id ORDER BY start_ms, end_ms, anchor_id)) AS timeline_id FROM it)"""


@query("e12_item_evidence", LOOSE + " SELECT audio_id, grp, timeline_id, start_ms, end_ms, classification, anchor_id, evidence_ids FROM nu", C)
def _(s, d):
    return loose_items(s, d).select("audio_id", "grp", "timeline_id", "start_ms", "end_ms", "classification", "anchor_id", joined("evidence_ids").alias("evidence_ids"))


@query("c5_fusion_payload", LOOSE + """ SELECT audio_id, timeline_id, '{"timeline_id":"' || timeline_id || '","classification":"' || classification || '","evidence_ids":[' || evidence_ids || ']}' AS payload FROM nu""", C)
def _(s, d):
    return tl.fusion_payload(loose_items(s, d))


@query("d14_hydrated_candidates", LOOSE + " SELECT audio_id, timeline_id, place - 1 AS place, event_id, text FROM li JOIN (SELECT audio_id, grp, timeline_id FROM nu) USING (audio_id, grp)", C)
def _(s, d):
    return tl.hydrate(loose_items(s, d), cand(s, d))[0].select("audio_id", "timeline_id", "place", "event_id", "text")


@query("e12_timeline_evidence")
def _(s, d):
    return timeline(s, d).groupBy("audio_id").agg(F.sum(F.size("evidence_ids")).alias("n_evidence"), F.count(F.lit(1)).alias("n_items"))


@query("l17_evidence_audit")
def _(s, d):
    """Even recordings' sources match; the others are refused."""
    runs = cand(s, d).select("audio_id", "run_key").distinct().withColumn("source_relation", F.when(F.col("audio_id") % 2 == 0, "matched").otherwise("moved"))
    return jobs.evidence_audit(cand(s, d), runs, fx(s, d, "fx_duration"), support=contains_only, timeline_support=tl.contains_support).manifest.drop("generation")


@query("d22_selection_check", """SELECT audio_id, printf('TL%06d', cue_index) AS timeline_id, 'missing_item' AS rule FROM fx_cue WHERE cue_index % 4 = 0
UNION ALL SELECT audio_id, printf('TL%06d', cue_index), 'foreign_evidence' FROM fx_cue WHERE cue_index % 4 = 1 UNION ALL SELECT audio_id, printf('TL9%05d', cue_index), 'unknown_item' FROM fx_cue WHERE cue_index % 4 = 2""", CUE)
def _(s, d):
    i = F.col("cue_index")
    t = cue(s, d).select("audio_id", F.format_string("TL%06d", i).alias("timeline_id"), F.array(i, i + 1).alias("evidence_ids"), i)
    pick = t.filter("cue_index % 4 <> 0").select("audio_id", "timeline_id", F.when(i % 4 == 1, F.array(i + 7)).otherwise(F.array(i)).alias("chosen"))
    odd = t.filter("cue_index % 4 = 2").select("audio_id", F.format_string("TL9%05d", i).alias("timeline_id"), F.array(i).alias("chosen"))
    return tl.validate_selections(pick.unionByName(odd), t.drop("cue_index"))


# ---- review ----
TLI = """tli AS (SELECT audio_id, printf('TL%06d', cue_index) AS timeline_id, start_ms + CASE WHEN cue_index % 3 = 1 THEN 1 WHEN cue_index % 3 = 2 THEN 150 ELSE 5000 END AS s, end_ms + CASE WHEN cue_index % 3 = 2 THEN 100 WHEN cue_index % 3 = 0 THEN 5000 ELSE 0 END AS e FROM fx_cue WHERE audio_id % 5 <> 0 OR cue_index % 4 <> 3),
pr AS (SELECT c.audio_id, c.cue_index, t.timeline_id, abs(s - start_ms) <= 2 AND abs(e - end_ms) <= 2 AS exact, greatest(least(end_ms, e) - greatest(start_ms, s), 0) / (greatest(end_ms, e) - least(start_ms, s)) AS iou FROM fx_cue c JOIN tli t ON t.audio_id = c.audio_id AND s <= end_ms + 2 AND e >= start_ms - 2),
rk AS (SELECT *, count(*) FILTER (exact) OVER (PARTITION BY audio_id, cue_index) AS ne, row_number() OVER w AS rn, lead(iou) OVER w AS nxt FROM pr WINDOW w AS (PARTITION BY audio_id, cue_index ORDER BY iou DESC, timeline_id)),
ch AS (SELECT audio_id, cue_index, coalesce(max(CASE WHEN ne = 1 AND exact THEN timeline_id END), max(CASE WHEN rn = 1 AND iou >= 0.8 AND (nxt IS NULL OR iou > nxt) THEN timeline_id END)) AS timeline_id FROM rk GROUP BY audio_id, cue_index),
mt AS (SELECT c.audio_id, c.cue_index, ch.timeline_id, printf('TL%06d', c.cue_index) AS bp, (SELECT count(*) FROM tli WHERE tli.audio_id = c.audio_id) AS ni FROM fx_cue c LEFT JOIN ch USING (audio_id, cue_index)),
ft AS (SELECT *, count(*) OVER a = ni AND max(cue_index) OVER a = ni AND bool_and(timeline_id IS NULL OR timeline_id = bp) OVER a AS fits FROM mt WINDOW a AS (PARTITION BY audio_id))"""


def items_of_cues(s, d) -> DataFrame:
    i = F.col("cue_index")
    c = cue(s, d).filter("audio_id % 5 <> 0 OR cue_index % 4 <> 3")
    return c.select("audio_id", F.format_string("TL%06d", i).alias("timeline_id"), (F.col("start_ms") + F.when(i % 3 == 1, 1).when(i % 3 == 2, 150).otherwise(5000)).alias("start_ms"),
                    (F.col("end_ms") + F.when(i % 3 == 2, 100).when(i % 3 == 0, 5000).otherwise(0)).alias("end_ms"), i)


@query("d7_cue_timeline_match", TLI + " SELECT audio_id, cue_index, coalesce(timeline_id, CASE WHEN fits THEN bp END) AS timeline_id FROM ft", CUE)
def _(s, d):
    return rv.match_cues(cue(s, d), items_of_cues(s, d).drop("cue_index"))


@query("d8_long_cue_bounds", """SELECT audio_id, cue_index, CASE WHEN cue_index % 3 = 0 THEN cue_index WHEN cue_index % 3 = 1 AND cue_index % 2 = 0 THEN cue_index END AS source_index FROM fx_cue""", CUE)
def _(s, d):
    i = F.col("cue_index")
    p = cue(s, d).filter("cue_index % 3 = 0 OR cue_index % 3 = 1 AND cue_index % 2 = 0").select(
        "audio_id", (i % 3 == 0).alias("applied"), F.col("start_ms").alias("new_start"), F.col("end_ms").alias("new_end"), F.when(i % 3 == 0, F.lit(-1)).otherwise(F.col("start_ms")).alias("old_start"), F.when(i % 3 == 0, F.lit(-1)).otherwise(F.col("end_ms")).alias("old_end"), i.alias("source_index"), F.lit("aligned").alias("status"))
    return rv.match_long_cues(cue(s, d), p).select("audio_id", "cue_index", "source_index")


@query("d23_text_versions", "SELECT audio_id, cue_index, CASE WHEN cue_index % 2 = 0 THEN 'fused' ELSE text_zh END AS fused, CASE WHEN cue_index % 3 = 0 THEN 'reviewed' ELSE text_zh END AS reviewed FROM fx_cue", CUE)
def _(s, d):
    c = cue(s, d).select("audio_id", "cue_index", F.col("text_zh").alias("text"))
    return rv.with_versions(c, c.filter("cue_index % 2 = 0").withColumn("text", F.lit("fused")), c.filter("cue_index % 3 = 0").withColumn("text", F.lit("reviewed"))).drop("text")


@query("d21_script_reasons", "SELECT audio_id, printf('TL%06d', cue_index) AS timeline_id, CASE WHEN cue_index % 2 = 0 THEN 'ambiguous,late' ELSE 'late' END AS reasons FROM fx_cue", CUE)
def _(s, d):
    tid = F.array(F.format_string("TL%06d", "cue_index"))
    c = cue(s, d)
    m = c.select("audio_id", tid.alias("timeline_ids"), F.array(F.lit("late")).alias("reasons"))
    u = c.filter("cue_index % 2 = 0").select("audio_id", tid.alias("timeline_ids"), F.array(F.lit("late"), F.lit("ambiguous")).alias("reasons"))
    return rv.script_reasons(m, u).withColumn("reasons", F.array_join("reasons", ","))


@query("c4_candidate_public", "SELECT event_id, start_ms, end_ms, text AS text_ja, avg_logprob, no_speech_prob FROM fx_candidate", C)
def _(s, d):
    return rv.candidate_public(cand(s, d)).select("event_id", "start_ms", "end_ms", "text_ja", F.col("confidence.avg_logprob").alias("avg_logprob"), F.col("confidence.no_speech_prob").alias("no_speech_prob"))


@query("f6_overlap_review", """n AS (SELECT *, start_ms - lag(end_ms) OVER w AS g0, lead(start_ms) OVER w - end_ms AS g1 FROM fx_cue WINDOW w AS (PARTITION BY audio_id ORDER BY start_ms, end_ms, cue_index))
SELECT audio_id, cue_index, cue_index % 2 = 0 AND (coalesce(g0 > 0 AND g0 <= 1000, FALSE) OR coalesce(g1 > 0 AND g1 <= 1000, FALSE)) AND cue_index * 100 >= 500 AS needs_review FROM n""", CUE)
def _(s, d):
    c = cue(s, d).withColumns({"timeline_id": F.col("cue_index"), "shift_ms": F.col("cue_index") * 100, "timing_kind": F.when(F.col("cue_index") % 2 == 0, "overlap_partition").otherwise("word_candidate")})
    return rv.overlap_review(c).select("audio_id", "cue_index", "needs_review")


@query("f7_neighbour_context", """k AS (SELECT audio_id, cue_index AS id, start_ms, CASE WHEN cue_index % 3 = 0 THEN NULL ELSE cue_index END AS sub FROM fx_cue)
SELECT audio_id, id, last_value(sub IGNORE NULLS) OVER (PARTITION BY audio_id ORDER BY start_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_id,
first_value(sub IGNORE NULLS) OVER (PARTITION BY audio_id ORDER BY start_ms, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM k""", CUE)
def _(s, d):
    c = cue(s, d).select("audio_id", F.col("cue_index").alias("id"), "start_ms", F.when(F.col("cue_index") % 3 == 0, "excluded").otherwise("subtitle").alias("kind"))
    return rv.with_context(c, spread=True).select("audio_id", "id", "prev_id", "next_id")


@query("l11_review_items")
def _(s, d):
    c = cue(s, d)
    items = items_of_cues(s, d).withColumns({
        "classification": F.when(F.col("cue_index") % 2 == 0, "supported").otherwise("uncertain"), "review_required": F.col("cue_index") % 3 == 0,
        "timing_kind": F.when(F.col("cue_index") % 4 == 0, "overlap_partition").otherwise("word_candidate"), "evidence_ids": F.array(F.col("cue_index"), F.col("cue_index") + 40),
    })
    out = rv.review_items(c, items, cand(s, d), contains_only, contains_only)
    return out.select("audio_id", "cue_index", "timeline_id", *[F.array_join(f, ",").alias(f) for f in ("text_flags", "timing_flags", "informational_flags")])


@query("d18_decision_coverage", "SELECT audio_id, cue_index, 'missing_decision' AS rule FROM fx_cue WHERE cue_index % 6 = 5 UNION ALL SELECT audio_id, cue_index + 500, 'unknown_item' FROM fx_cue WHERE cue_index % 6 = 4", CUE)
def _(s, d):
    c = cue(s, d).select("audio_id", "cue_index")
    dec = c.filter("cue_index % 6 <> 5").unionByName(c.filter("cue_index % 6 = 4").withColumn("cue_index", F.col("cue_index") + 500))
    return rv.join_decisions(c, dec)


def decisions(s, d, last_ok: bool = True) -> DataFrame:
    """By cue_index % 6: edit, reject, time edit, split, merge_next, keep; the last cue of a recording keeps."""
    i = F.col("cue_index") % 6
    last = F.max("cue_index").over(Window.partitionBy("audio_id")) == F.col("cue_index")
    merge = (i == 4) & ~last if last_ok else i == 4
    return cue(s, d).select(
        "audio_id", "cue_index", F.when(i == 0, "edit").when(i == 1, "reject").otherwise("keep").alias("action"), F.when(i == 3, "split").when(merge, "merge_next").otherwise("keep").alias("structure"),
        F.when(i == 0, F.lit("JA")).alias("edited_ja"), F.when(i == 0, F.lit("ZH")).alias("edited_zh"), F.when(i == 2, F.col("start_ms") + 50).alias("edited_start"), F.when(i == 2, F.col("end_ms") - 50).alias("edited_end"),
        F.when(i == 3, F.floor((F.col("start_ms") + F.col("end_ms")) / 2)).alias("split_at"),
        *[F.when((i == 3) & (F.col("cue_index") % 4 != 1 if not last_ok else F.lit(True)), half(F.col(f"text_{lang}"))).alias(f"split_{lang}_{side}") for lang in ("ja", "zh") for side, half in (("before", lambda t: F.concat(F.lit("A:"), F.left(t, F.floor(F.length(t) / 2).cast("int")))), ("after", lambda t: F.concat(F.lit("B:"), F.substring(t, F.floor(F.length(t) / 2).cast("int") + 1, F.length(t)))))],
    )


REVIEW = """m AS (SELECT *, cue_index % 6 AS i, max(cue_index) OVER (PARTITION BY audio_id) = cue_index AS last_ FROM fx_cue),
e AS (SELECT audio_id, cue_index, i, last_, CASE WHEN i = 2 THEN start_ms + 50 ELSE start_ms END AS s, CASE WHEN i = 2 THEN end_ms - 50 ELSE end_ms END AS en, CASE WHEN i = 0 THEN 'JA' ELSE text_ja END AS ja, CASE WHEN i = 0 THEN 'ZH' ELSE text_zh END AS zh FROM m),
x AS (SELECT *, lead(en) OVER w AS ne, lead(ja) OVER w AS nja, lead(zh) OVER w AS nzh, lag(i) OVER w = 4 AS eaten FROM e WINDOW w AS (PARTITION BY audio_id ORDER BY cue_index)),
y AS (SELECT audio_id, s, CAST(floor((s + en) / 2) AS BIGINT) AS en, cue_index || '-A' AS id, 'A:' || substr(ja, 1, length(ja) // 2) AS ja, 'A:' || substr(zh, 1, length(zh) // 2) AS zh FROM x WHERE i = 3 UNION ALL SELECT audio_id, CAST(floor((s + en) / 2) AS BIGINT), en, cue_index || '-B', 'B:' || substr(ja, length(ja) // 2 + 1), 'B:' || substr(zh, length(zh) // 2 + 1) FROM x WHERE i = 3
  UNION ALL SELECT audio_id, s, ne, cue_index || '+' || cue_index + 1, ja || nja, zh || nzh FROM x WHERE i = 4 AND NOT last_
  UNION ALL SELECT audio_id, s, en, CAST(cue_index AS VARCHAR), ja, zh FROM x WHERE (i IN (0, 2, 5) OR (i = 4 AND last_)) AND NOT coalesce(eaten, FALSE))"""


@query("l12_apply_review", REVIEW + " SELECT audio_id, row_number() OVER (PARTITION BY audio_id ORDER BY s, en, id) AS cue_index, s AS start_ms, en AS end_ms, id, ja AS text_ja, zh AS text_zh FROM y", CUE)
def _(s, d):
    return rv.apply_review(cue(s, d).select("audio_id", "cue_index", "start_ms", "end_ms", "text_ja", "text_zh"), decisions(s, d))


@query("f11_merge_next", REVIEW + " SELECT audio_id, s AS start_ms, en AS end_ms, id FROM y WHERE contains(id, '+')", CUE)
def _(s, d):
    return rv.apply_review(cue(s, d).select("audio_id", "cue_index", "start_ms", "end_ms", "text_ja", "text_zh"), decisions(s, d)).filter(F.col("id").contains("+")).select("audio_id", "start_ms", "end_ms", "id")


@query("k6_review_contract", "SELECT audio_id, max(cue_index) AS cue_index, 'merge_last' AS rule FROM fx_cue GROUP BY audio_id HAVING max(cue_index) % 6 = 4 UNION ALL SELECT audio_id, cue_index, 'split_text_missing' FROM fx_cue WHERE cue_index % 6 = 3 AND cue_index % 4 = 1 UNION ALL SELECT audio_id, cue_index, 'unsafe_split_text' FROM fx_cue WHERE cue_index % 6 = 3 AND cue_index % 4 <> 1 AND regexp_matches(text_ja, '[\\r\\n]')", CUE)
def _(s, d):
    return rv.check_review(cue(s, d).select("audio_id", "cue_index", "start_ms", "end_ms"), decisions(s, d, last_ok=False))
