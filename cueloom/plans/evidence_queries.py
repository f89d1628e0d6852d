"""Queries over recognizer candidates: intervals, support, labels, windows, rescue plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import norm_text
from ..operators import evidence as ev, intervals as iv, rescue as rs, scans
from ..operators.graph import checkpoint
from .fixtures import fx
from .registry import query

NORM = r"lower(regexp_replace({}, '[\s　、。！？!?…・,.\-~～「」『』（）()\[\]]+', '', 'g'))"

# ---- CTEs of the oracles ----
ISLANDS = """
isl0 AS (SELECT *, max(end_ms) OVER (PARTITION BY audio_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fx_candidate),
isl AS (SELECT *, sum(CASE WHEN before IS NULL OR start_ms > before + 800 THEN 1 ELSE 0 END) OVER (PARTITION BY audio_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM isl0)"""
PAIRS = """
pairs AS (
  SELECT a.audio_id, a.event_id AS event_id_a, b.event_id AS event_id_b, a.model_role AS role_a, b.model_role AS role_b, a.text AS text_a, b.text AS text_b, b.no_speech_prob AS nsp_b
  FROM fx_candidate a JOIN fx_candidate b ON a.audio_id = b.audio_id AND a.model_role <> b.model_role AND a.start_ms <= b.end_ms + 800 AND b.start_ms <= a.end_ms + 800)"""
SUPPORT = PAIRS + f""",
normed AS (SELECT *, {NORM.format("text_a")} AS na, {NORM.format("text_b")} AS nb FROM pairs),
support AS (SELECT * FROM normed WHERE least(length(na), length(nb)) >= 2 AND (contains(na, nb) OR contains(nb, na)))"""
LABELS = SUPPORT + f""",
facts AS (SELECT event_id_a AS event_id, bool_or(role_b = 'v3' AND (nsp_b IS NULL OR nsp_b < 0.6)) AS credible FROM support GROUP BY event_id_a),
known AS (SELECT event_id, {NORM.format("text")} IN ('ご視聴ありがとうございました', 'ご清聴ありがとうございました', 'チャンネル登録よろしくお願いします', 'チャンネル登録をお願いします') AS template FROM fx_candidate),
labels AS (
  SELECT c.audio_id, c.event_id, CASE WHEN k.template AND c.model_role = 'turbo' AND NOT coalesce(f.credible, FALSE) THEN 'hallucination'
    WHEN f.event_id IS NOT NULL THEN 'supported' ELSE 'uncertain' END AS label
  FROM fx_candidate c JOIN known k USING (event_id) LEFT JOIN facts f USING (event_id))"""
COMPONENTS = PAIRS + """,
walk(event_id, c) AS (
  SELECT event_id, event_id AS c FROM fx_candidate
  UNION
  SELECT p.event_id_b, w.c FROM walk w JOIN pairs p ON p.event_id_a = w.event_id WHERE w.c < p.event_id_b),
comp AS (SELECT event_id, min(c) AS component FROM walk GROUP BY event_id)"""


def contains_only(na, nb):
    """The SQL-expressible part of the support test on normal forms: no similarity beyond containment."""
    return (F.least(F.length(na), F.length(nb)) >= 2) & (na.contains(nb) | nb.contains(na))


def cand(spark, d) -> DataFrame:
    return fx(spark, d, "fx_candidate")


def labels(spark, d) -> DataFrame:
    return ev.classify(cand(spark, d), contains_only)


def joined(col):
    return F.array_join(F.transform(F.col(col), lambda x: x.cast("string")), ",")


C = ("fx_candidate",)
CD = ("fx_candidate", "fx_duration")


@query("c2_acoustic_suspicion", """SELECT event_id, coalesce(no_speech_prob >= 0.5, FALSE) OR coalesce(avg_logprob <= -0.8, FALSE) AS suspicious FROM fx_candidate""", C)
def _(s, d):
    return cand(s, d).select("event_id", ev.is_suspicious(F.col("no_speech_prob"), F.col("avg_logprob")).alias("suspicious"))


@query("f1_merge_intervals", ISLANDS.strip() + " SELECT audio_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM isl GROUP BY audio_id, island", C)
def _(s, d):
    return iv.merge_intervals(cand(s, d), "audio_id", 800, spread=True).drop("island")


GAPS = """
rows_ AS (
  SELECT c.audio_id, duration_ms, greatest(start_ms, 0) AS s, least(end_ms, duration_ms) AS e, 0 AS tail FROM fx_candidate c JOIN fx_duration USING (audio_id) WHERE end_ms > start_ms
  UNION ALL SELECT audio_id, duration_ms, duration_ms, duration_ms, 1 FROM fx_duration),
cur AS (SELECT *, coalesce(max(e) OVER (PARTITION BY audio_id ORDER BY s, e, tail ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM rows_)
SELECT audio_id, CAST(greatest(0, c - 500) AS BIGINT) AS start_ms, CAST(CASE WHEN tail = 1 THEN duration_ms ELSE least(duration_ms, s + 500) END AS BIGINT) AS end_ms FROM cur WHERE s - c >= 1500"""


@query("f2_coverage_gaps", GAPS, CD)
def _(s, d):
    return iv.coverage_gaps(cand(s, d), fx(s, d, "fx_duration"), spread=True)


@query("f3_sequence_ids", "SELECT event_id, printf('W%06d', row_number() OVER (PARTITION BY audio_id ORDER BY start_ms, end_ms, event_id)) AS wid FROM fx_candidate", C)
def _(s, d):
    return iv.assign_ids(cand(s, d), "W", "audio_id", ["start_ms", "end_ms", "event_id"], "wid", spread=True).select("event_id", "wid")


#: Half of all candidates in recording 0, one behind the other; the rest as they are.
HOT = "hot AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE audio_id END AS audio_id, CASE WHEN event_id % 2 = 0 THEN start_ms + audio_id * 10000000 ELSE start_ms END AS start_ms, CASE WHEN event_id % 2 = 0 THEN end_ms + audio_id * 10000000 ELSE end_ms END AS end_ms FROM fx_candidate)"


def hot(s, d) -> DataFrame:
    half, far = F.col("event_id") % 2 == 0, F.col("audio_id") * 10_000_000
    moved = {c: F.when(half, F.col(c) + far).otherwise(F.col(c)) for c in ("start_ms", "end_ms")}
    return cand(s, d).select("event_id", F.when(half, 0).otherwise(F.col("audio_id")).alias("audio_id"), *[v.alias(k) for k, v in moved.items()])


@query("f1_hot_recording", HOT + ", " + ISLANDS.strip().replace("fx_candidate", "hot") + " SELECT audio_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM isl GROUP BY audio_id, island", C)
def _(s, d):
    return iv.merge_intervals(hot(s, d), "audio_id", 800, spread=True).drop("island")


@query("f2_hot_recording", HOT + ", fx_duration2 AS (SELECT audio_id, max(end_ms) + 5000 AS duration_ms FROM hot GROUP BY audio_id)," + GAPS.replace("fx_candidate", "hot").replace("fx_duration", "fx_duration2"), C)
def _(s, d):
    lengths = hot(s, d).groupBy("audio_id").agg((F.max("end_ms") + 5000).alias("duration_ms"))
    return iv.coverage_gaps(hot(s, d), lengths, spread=True)


@query("f3_hot_recording", HOT + " SELECT event_id, printf('W%06d', row_number() OVER (PARTITION BY audio_id ORDER BY start_ms, end_ms, event_id)) AS wid FROM hot", C)
def _(s, d):
    return iv.assign_ids(hot(s, d), "W", "audio_id", ["start_ms", "end_ms", "event_id"], "wid", spread=True).select("event_id", "wid")


@query("g1_canonical_order", "SELECT audio_id, event_id, row_number() OVER (PARTITION BY audio_id ORDER BY start_ms, end_ms, event_id) AS place FROM fx_candidate", C)
def _(s, d):
    order = ["start_ms", "end_ms", "event_id"]
    rows = scans.row_numbers(scans.in_blocks(cand(s, d), ["audio_id"], order), ["audio_id"], order, "place")
    return iv.canonical_order(rows, spread=True).select("audio_id", "event_id", F.col("place").cast("long").alias("place"))


@query("d1_interval_pairs", PAIRS.strip() + " SELECT audio_id, event_id_a, event_id_b FROM pairs", C)
def _(s, d):
    return iv.interval_pairs(cand(s, d)).select("audio_id", "event_id_a", "event_id_b")


@query("d2_supported_candidates", SUPPORT.strip() + " SELECT DISTINCT audio_id, event_id_a AS event_id FROM support", C)
def _(s, d):
    return ev.supported_candidates(cand(s, d), contains_only).select("audio_id", "event_id")


@query("d3_template_match", f"SELECT event_id FROM fx_candidate WHERE {NORM.format('text')} IN ('ご視聴ありがとうございました', 'ご清聴ありがとうございました')", C)
def _(s, d):
    return ev.match_templates(cand(s, d)).select("event_id")


@query("d4_unsupported_templates", LABELS.strip() + " SELECT event_id FROM labels WHERE label = 'hallucination'", C)
def _(s, d):
    return ev.unsupported_templates(cand(s, d), contains_only).select("event_id")


@query("l2_classify_candidates", LABELS.strip() + """,
why AS (SELECT l.*, CASE WHEN label = 'hallucination' THEN 'unsupported_template' WHEN label = 'supported' THEN 'cross_model_support' ELSE
  concat_ws(',', CASE WHEN no_speech_prob >= 0.75 THEN 'high_no_speech' END, CASE WHEN avg_logprob <= -1.2 THEN 'low_logprob' END, CASE WHEN legacy_srt THEN 'legacy_srt' END) END AS reasons
  FROM labels l JOIN fx_candidate USING (event_id))
SELECT audio_id, event_id, label, reasons FROM why""", C)
def _(s, d):
    return labels(s, d).withColumn("reasons", joined("reasons"))


@query("l2_label_counts", LABELS.strip() + " SELECT audio_id, label, count(*) AS n FROM labels GROUP BY audio_id, label", C)
def _(s, d):
    return labels(s, d).groupBy("audio_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("l2_classify_full_similarity")
def _(s, d):
    return ev.classify(cand(s, d)).withColumn("reasons", joined("reasons"))


@query("c1_usable_candidates", LABELS.strip() + " SELECT event_id FROM fx_candidate JOIN labels USING (event_id) WHERE label <> 'hallucination' AND event_id % 41 <> 0 AND end_ms > start_ms", C)
def _(s, d):
    c = cand(s, d)
    return ev.usable_candidates(c, labels(s, d).filter("label = 'hallucination'"), c.filter("event_id % 41 = 0")).select("event_id")


@query("c3_split_quarantined", LABELS.strip() + """,
mine AS (SELECT c.audio_id, c.event_id, label = 'hallucination' AS removed FROM fx_candidate c JOIN labels USING (event_id) WHERE c.model_role = 'turbo' AND c.source_channel = 'main')
SELECT audio_id, event_id, removed, NOT bool_or(removed) OVER (PARTITION BY audio_id) AS pass_through FROM mine""", C)
def _(s, d):
    return ev.split_quarantined(cand(s, d), labels(s, d), "turbo").select("audio_id", "event_id", "removed", "pass_through")


@query("d6_decision_default", LABELS.strip() + " SELECT c.event_id, coalesce(l.label, 'uncertain') AS label FROM fx_candidate c LEFT JOIN (SELECT * FROM labels WHERE event_id % 3 <> 0) l USING (event_id)", C)
def _(s, d):
    return ev.with_labels(cand(s, d), labels(s, d).filter("event_id % 3 <> 0")).select("event_id", "label")


@query("h4_excluded_evidence", LABELS.strip() + """
SELECT event_id, 'quarantined_hallucination' AS reason FROM labels WHERE label = 'hallucination' UNION ALL
SELECT event_id, 'review_only_rescue_suppression' FROM labels WHERE event_id % 41 = 0 AND label <> 'hallucination'""", C)
def _(s, d):
    return ev.excluded_evidence(labels(s, d).filter("label = 'hallucination'"), cand(s, d).filter("event_id % 41 = 0"))


@query("e1_run_counts", "SELECT audio_id, run_key, count(*) AS candidate_count FROM fx_candidate GROUP BY audio_id, run_key", C)
def _(s, d):
    return ev.run_counts(cand(s, d))


@query("e1_run_count_check", """SELECT audio_id, run_key, r.candidate_count, n AS seen, 'count_mismatch' AS violation
FROM fx_run r JOIN (SELECT audio_id, run_key, count(*) AS n FROM fx_candidate GROUP BY audio_id, run_key) USING (audio_id, run_key) WHERE r.candidate_count <> n""", ("fx_run",))
def _(s, d):
    return ev.check_run_counts(cand(s, d), fx(s, d, "fx_run"))


@query("k1_evidence_contract", """SELECT audio_id, CAST(NULL AS BIGINT) AS event_id, 'count_mismatch' AS rule FROM fx_run WHERE audio_id % 5 = 0
UNION ALL SELECT audio_id, event_id, 'empty_text' FROM fx_candidate WHERE trim(text) = ''""", ("fx_run",))
def _(s, d):
    return ev.check_evidence(cand(s, d), fx(s, d, "fx_run"))


@query("c10_run_record", """SELECT audio_id, run_key, model_role, source_channel, count(*) AS candidate_count, bool_or(legacy_srt) AS legacy_srt,
sha256(concat_ws('|', run_key, model_role, source_channel)) AS config_fingerprint FROM fx_candidate GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY audio_id, run_key, model_role, source_channel"), C)
def _(s, d):
    return ev.run_record(cand(s, d))


@query("h1_upsert_runs", """incoming AS (SELECT *, 'new' AS version FROM fx_candidate WHERE audio_id % 2 = 0 AND model_role = 'v3' AND source_channel = 'main'),
cur AS (SELECT *, 'old' AS version FROM fx_candidate)
SELECT audio_id, event_id, version FROM cur c WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.audio_id = c.audio_id AND i.model_role = c.model_role AND i.source_channel = c.source_channel)
UNION ALL SELECT audio_id, event_id, version FROM incoming""", C)
def _(s, d):
    c = cand(s, d)
    new = c.filter("audio_id % 2 = 0 AND model_role = 'v3' AND source_channel = 'main'")
    return ev.upsert_runs(c.withColumn("version", F.lit("old")), new.withColumn("version", F.lit("new"))).select("audio_id", "event_id", "version")


@query("h5_key_set_equality", """SELECT event_id, 'left_only' AS side FROM fx_candidate WHERE event_id % 3 = 0 AND event_id % 5 <> 0
UNION ALL SELECT event_id, 'right_only' FROM fx_candidate WHERE event_id % 5 = 0 AND event_id % 3 <> 0""", C)
def _(s, d):
    c = cand(s, d)
    return ev.same_keys(c.filter("event_id % 3 = 0"), c.filter("event_id % 5 = 0"), "event_id")


@query("l1_components", COMPONENTS.strip() + " SELECT event_id, component FROM comp", C)
def _(s, d):
    return ev.components(cand(s, d)).select("event_id", "component")


@query("l1_components_by_rounds", COMPONENTS.strip() + " SELECT event_id, component FROM comp", C)
def _(s, d):
    return ev.component_table(cand(s, d))


SLICES = COMPONENTS + """,
mem AS (SELECT c.*, component FROM fx_candidate c JOIN comp USING (event_id)),
bounds AS (SELECT audio_id, component, min(start_ms) AS s, max(end_ms) AS e FROM mem GROUP BY audio_id, component),
cuts(audio_id, component, a, b, e) AS (
  SELECT audio_id, component, s, CASE WHEN e - s <= 15000 THEN e ELSE coalesce((SELECT max(end_ms) FROM mem m WHERE m.component = bounds.component AND m.end_ms > s AND m.end_ms <= s + 15000), s + 15000) END, e FROM bounds
  UNION ALL
  SELECT audio_id, component, b, CASE WHEN coalesce((SELECT max(end_ms) FROM mem m WHERE m.component = cuts.component AND m.end_ms > b AND m.end_ms <= least(b + 15000, e)), 0) > 0
    THEN (SELECT max(end_ms) FROM mem m WHERE m.component = cuts.component AND m.end_ms > b AND m.end_ms <= least(b + 15000, e)) ELSE least(b + 15000, e) END, e FROM cuts WHERE b < e),
slices AS (SELECT cuts.audio_id, cuts.component, a AS start_ms, b AS end_ms, bounds.e - bounds.s > 15000 AS split FROM cuts JOIN bounds USING (audio_id, component)),
wins AS (SELECT sl.*, m.event_id, m.model_role FROM slices sl JOIN mem m ON m.component = sl.component AND m.start_ms <= sl.end_ms AND m.end_ms >= sl.start_ms AND NOT (m.end_ms = sl.start_ms AND m.start_ms < sl.start_ms))"""


def recursive(text: str) -> str:
    return text.strip()


@query("i2_component_slices", recursive(SLICES) + " SELECT audio_id, component, start_ms, end_ms, split FROM slices", C)
def _(s, d):
    return ev.slice_components(ev.components(cand(s, d)))


@query("d5_window_members", recursive(SLICES) + " SELECT audio_id, component, start_ms, event_id FROM wins", C)
def _(s, d):
    return ev.align_candidates(cand(s, d)).select("audio_id", "component", "start_ms", "event_id")


@query("l1_align_candidates", recursive(SLICES) + """,
agg AS (SELECT audio_id, component, start_ms, end_ms, split, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS evidence_ids, min(start_ms) OVER (PARTITION BY component) AS gs FROM wins GROUP BY audio_id, component, start_ms, end_ms, split)
SELECT audio_id, printf('W%06d', row_number() OVER (PARTITION BY audio_id ORDER BY gs, component, start_ms)) AS window_id, start_ms, end_ms, split, evidence_ids FROM agg""", C)
def _(s, d):
    return ev.window_table(ev.align_candidates(cand(s, d))).select("audio_id", "window_id", "start_ms", "end_ms", "split", joined("evidence_ids").alias("evidence_ids"))


@query("c9_window_roles", recursive(SLICES) + """
SELECT audio_id, component, start_ms, string_agg(DISTINCT model_role, ',' ORDER BY model_role) AS model_roles FROM wins GROUP BY audio_id, component, start_ms, end_ms, split""", C)
def _(s, d):
    return ev.window_table(ev.align_candidates(cand(s, d))).select("audio_id", "component", "start_ms", F.array_join("model_roles", ",").alias("model_roles"))


ALL = COMPONENTS + "," + (SLICES + LABELS).replace(COMPONENTS, "", 1).replace(PAIRS, "").lstrip(", \n")


@query("e2_window_labels", ALL.strip() + """
SELECT audio_id, component, start_ms, end_ms, CASE WHEN bool_or(label = 'supported') THEN 'supported' WHEN bool_and(label = 'hallucination') THEN 'hallucination' ELSE 'uncertain' END AS label, count(*) AS n
FROM wins JOIN (SELECT event_id, label FROM labels) USING (event_id) GROUP BY audio_id, component, start_ms, end_ms""", C)
def _(s, d):
    return ev.label_windows(ev.align_candidates(cand(s, d)), labels(s, d)).drop("model_roles")


@query("i1_tiling", ISLANDS.strip() + """,
m AS (SELECT audio_id, min(start_ms) AS s, max(end_ms) AS e FROM isl GROUP BY audio_id, island),
t AS (SELECT audio_id, e, unnest(CASE WHEN e - s <= 12000 THEN [s] ELSE range(s, greatest(s, e - 2001) + 1, 10000) END) AS s FROM m WHERE e > s)
SELECT audio_id, s AS start_ms, least(s + 12000, e) AS end_ms FROM t""", C)
def _(s, d):
    return iv.tile(iv.merge_intervals(cand(s, d), "audio_id", 800), 12_000, 2_000).select("audio_id", "start_ms", "end_ms")


@query("g2_spread_sample", """p AS (SELECT audio_id, event_id, row_number() OVER (PARTITION BY audio_id ORDER BY start_ms, end_ms, event_id) - 1 AS pos, count(*) OVER (PARTITION BY audio_id) AS n FROM fx_candidate)
SELECT audio_id, event_id FROM p WHERE n <= 7 OR pos IN (SELECT CAST(round_even(i * (n - 1) / 6, 0) AS BIGINT) FROM range(7) r(i))""", C)
def _(s, d):
    return iv.spread_sample(cand(s, d), 7, "audio_id", ["start_ms", "end_ms", "event_id"]).select("audio_id", "event_id")


@query("e3_distant_repeats", f"""n AS (SELECT *, {NORM.format('text')} AS norm FROM fx_candidate)
SELECT audio_id, norm, count(*) AS n, max(start_ms) - min(start_ms) AS spread_ms FROM n WHERE norm <> '' GROUP BY audio_id, norm
HAVING count(*) >= 2 AND max(start_ms) - min(start_ms) >= 20000 AND count(no_speech_prob) = count(*) AND min(no_speech_prob) >= 0.05""", C)
def _(s, d):
    return rs.distant_repeats(cand(s, d), no_speech=0.05)


CREDIBLE = f"""n AS (SELECT *, {NORM.format('text')} AS norm FROM fx_candidate WHERE model_role = 'v3'),
far AS (SELECT audio_id, norm FROM n WHERE norm <> '' GROUP BY audio_id, norm HAVING count(*) >= 2 AND max(start_ms) - min(start_ms) >= 20000 AND count(no_speech_prob) = count(*) AND min(no_speech_prob) >= 0.6),
hits AS (SELECT n.*, coalesce(no_speech_prob >= 0.6, FALSE) AND (n.norm IN ('ご視聴ありがとうございました', 'ご清聴ありがとうございました') OR far.norm IS NOT NULL) AS suppressed FROM n LEFT JOIN far USING (audio_id, norm))"""


@query("e4_credible_hits", CREDIBLE + " SELECT event_id, suppressed FROM hits", C)
def _(s, d):
    return rs.credible_hits(cand(s, d).filter("model_role = 'v3'")).select("event_id", "suppressed")


PLAN = CREDIBLE + """,
pad AS (SELECT h.audio_id, greatest(0, start_ms - 750) AS s, least(duration_ms, end_ms + 750) AS e FROM hits h JOIN fx_duration USING (audio_id) WHERE NOT suppressed),
p0 AS (SELECT *, max(e) OVER (PARTITION BY audio_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pad WHERE e > s),
p1 AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY audio_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM p0),
mg AS (SELECT audio_id, min(s) AS s, max(e) AS e FROM p1 GROUP BY audio_id, island),
t0 AS (SELECT audio_id, e, unnest(CASE WHEN e - s <= 8000 THEN [s] ELSE range(s, greatest(s, e - 501) + 1, 7500) END) AS s FROM mg),
tiles AS (SELECT audio_id, s, least(s + 8000, e) AS e FROM t0),
guard AS (SELECT d.audio_id, d.duration_ms, coalesce(w, 0) AS windows, coalesce(i, 0) AS inference_ms, coalesce(u, 0) AS unique_ms, least(120000, duration_ms * 0.35) AS allowed
  FROM fx_duration d LEFT JOIN (SELECT audio_id, count(*) AS w, sum(e - s) AS i FROM tiles GROUP BY audio_id) USING (audio_id) LEFT JOIN (SELECT audio_id, sum(e - s) AS u FROM mg GROUP BY audio_id) USING (audio_id)),
guarded AS (SELECT *, concat_ws(',', CASE WHEN windows > 24 THEN 'window_count_limit' END, CASE WHEN inference_ms > allowed THEN 'coverage_duration_limit' END, CASE WHEN unique_ms / duration_ms >= 0.9 THEN 'near_full_audio_coverage' END) AS reasons FROM guard)"""


def narrow(s, d):
    return rs.plan_targets(cand(s, d).filter("model_role = 'v3'"), fx(s, d, "fx_duration"))


@query("e5_coverage_guard", PLAN + " SELECT audio_id, CAST(windows AS BIGINT) AS windows, CAST(inference_ms AS BIGINT) AS inference_ms, CAST(unique_ms AS BIGINT) AS unique_ms, reasons FROM guarded", CD)
def _(s, d):
    return narrow(s, d)[1].select("audio_id", "windows", "inference_ms", "unique_ms", F.array_join("reasons", ",").alias("reasons"))


@query("l4_narrow_plan", PLAN + " SELECT audio_id, printf('T%06d', row_number() OVER (PARTITION BY audio_id ORDER BY s, e)) AS window_id, CAST(s AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms FROM tiles", CD)
def _(s, d):
    """With limits wide enough for dense speech."""
    c = cand(s, d).filter("model_role = 'v3'")
    return rs.plan_targets(c, fx(s, d, "fx_duration"), max_windows=10**6, max_total_ms=10**9, ratio=10.0, near_full=2.0)[0].select("audio_id", "window_id", "start_ms", "end_ms")


def judged(s, d) -> tuple[DataFrame, DataFrame]:
    """Labels, and windows with their members and label; both written once."""
    lab, al = checkpoint(labels(s, d)), checkpoint(ev.align_candidates(cand(s, d)))
    keys = ["audio_id", "component", "start_ms", "end_ms"]
    return lab, al.join(ev.label_windows(al, lab).select(*keys, "label"), keys)


BUDGET = """k AS (SELECT g.*, kk.k FROM g JOIN range(1, 25) kk(k) ON kk.k <= g.n WHERE kk.k = g.n OR (kk.k = 1 AND pos = floor(n / 2)) OR (kk.k > 1 AND list_contains([CAST(round_even(i * (n - 1) / (kk.k - 1), 0) AS BIGINT) for i in range(kk.k)], pos))),
cost AS (SELECT audio_id, prio, k, sum(e - s) AS cost, count(*) AS size FROM k GROUP BY audio_id, prio, k),
st(audio_id, lvl, room, slots, k) AS (
  SELECT audio_id, -1, least(180000, greatest(least(duration_ms, 12000), duration_ms * 1.0)), 24, 0 FROM fx_duration
  UNION ALL
  SELECT st.audio_id, st.lvl + 1, st.room - coalesce(b.cost, 0), st.slots - coalesce(b.size, 0), coalesce(b.k, 0) FROM st LEFT JOIN LATERAL (SELECT c.k, c.cost, c.size FROM cost c WHERE c.audio_id = st.audio_id AND c.prio = st.lvl + 1 AND c.cost <= st.room AND c.size <= st.slots ORDER BY c.k DESC LIMIT 1) b ON TRUE WHERE st.lvl < 3)"""

TARGETS = ALL.strip() + """,
main_ AS (SELECT c.*, label, coalesce(no_speech_prob >= 0.5, FALSE) OR coalesce(avg_logprob <= -0.8, FALSE) AS odd FROM fx_candidate c JOIN (SELECT event_id, label FROM labels) USING (event_id) WHERE source_channel = 'main'),
wl AS (SELECT audio_id, component, start_ms, end_ms FROM wins JOIN (SELECT event_id, label FROM labels) USING (event_id) GROUP BY audio_id, component, start_ms, end_ms HAVING NOT bool_or(label = 'supported') AND NOT bool_and(label = 'hallucination')),
gr AS (SELECT c.audio_id, duration_ms, start_ms AS s, least(end_ms, duration_ms) AS e, 0 AS tail FROM main_ c JOIN fx_duration USING (audio_id) WHERE label <> 'hallucination' AND end_ms > start_ms
  UNION ALL SELECT audio_id, duration_ms, duration_ms, duration_ms, 1 FROM fx_duration),
gc AS (SELECT *, coalesce(max(e) OVER (PARTITION BY audio_id ORDER BY s, e, tail ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM gr),
raw_t AS (
  SELECT audio_id, greatest(0, c - 500) AS s, CASE WHEN tail = 1 THEN duration_ms ELSE least(duration_ms, s + 500) END AS e, 'main_channel_gap' AS reason FROM gc WHERE s - c >= 1500
  UNION ALL SELECT audio_id, greatest(0, start_ms - 500), least(duration_ms, end_ms + 500), 'quarantined_candidate_region' FROM main_ JOIN fx_duration USING (audio_id) WHERE label = 'hallucination'
  UNION ALL SELECT audio_id, greatest(0, start_ms - 500), least(duration_ms, end_ms + 500), 'uncertain_candidate' FROM main_ JOIN fx_duration USING (audio_id) WHERE label = 'uncertain' AND odd
  UNION ALL SELECT audio_id, greatest(0, start_ms - 500), least(duration_ms, end_ms + 500), 'abnormally_long_segment' FROM main_ JOIN fx_duration USING (audio_id) WHERE end_ms - start_ms > 15000
  UNION ALL SELECT audio_id, greatest(0, start_ms - 500), least(duration_ms, end_ms + 500), 'model_disagreement_or_single_model' FROM (
    SELECT DISTINCT wl.audio_id, wl.component, wl.start_ms, wl.end_ms FROM wl JOIN wins w ON w.component = wl.component AND w.start_ms = wl.start_ms AND w.end_ms = wl.end_ms JOIN main_ m ON m.event_id = w.event_id WHERE m.odd) JOIN fx_duration USING (audio_id))"""


@query("h2_rescue_targets", TARGETS + " SELECT audio_id, CAST(s AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms, reason FROM raw_t", CD)
def _(s, d):
    return rs.rescue_targets(cand(s, d), *judged(s, d), fx(s, d, "fx_duration"))


PLANNED = TARGETS + """,
pt0 AS (SELECT audio_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, reason, CASE reason WHEN 'quarantined_candidate_region' THEN 0 WHEN 'main_channel_gap' THEN 1 WHEN 'abnormally_long_segment' THEN 3 ELSE 2 END AS p FROM raw_t),
pt1 AS (SELECT *, max(e) OVER (PARTITION BY audio_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf FROM pt0),
pt2 AS (SELECT *, sum(CASE WHEN bf IS NULL OR s > bf THEN 1 ELSE 0 END) OVER (PARTITION BY audio_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM pt1),
pt3 AS (SELECT audio_id, min(s) AS s, max(e) AS e, min(p) AS prio, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM pt2 GROUP BY audio_id, island),
pt4 AS (SELECT audio_id, e, prio, reasons, unnest(CASE WHEN e - s <= 12000 THEN [s] ELSE range(s, greatest(s, e - 2001) + 1, 10000) END) AS s FROM pt3 WHERE e > s),
g AS (SELECT audio_id, s, least(s + 12000, e) AS e, prio, reasons, row_number() OVER (PARTITION BY audio_id, prio ORDER BY s, least(s + 12000, e)) - 1 AS pos, count(*) OVER (PARTITION BY audio_id, prio) AS n FROM pt4),
""" + BUDGET + " SELECT k.audio_id, printf('R%06d', row_number() OVER (PARTITION BY k.audio_id ORDER BY k.s, k.e)) AS window_id, k.s AS start_ms, k.e AS end_ms, k.reasons FROM k JOIN st ON st.audio_id = k.audio_id AND st.lvl = k.prio AND st.k = k.k"


@query("l3_rescue_plan", PLANNED, CD)
def _(s, d):
    return rs.plan_rescue(cand(s, d), *judged(s, d), fx(s, d, "fx_duration")).select("audio_id", "window_id", "start_ms", "end_ms", F.array_join("reasons", ",").alias("reasons"))


@query("g3_budget", """w AS (SELECT audio_id, event_id, start_ms AS s, start_ms + 7000 AS e, event_id % 4 AS prio FROM fx_candidate),
g AS (SELECT *, row_number() OVER (PARTITION BY audio_id, prio ORDER BY s, e) - 1 AS pos, count(*) OVER (PARTITION BY audio_id, prio) AS n FROM w),
""" + BUDGET + """
SELECT k.audio_id, k.s AS start_ms, k.e AS end_ms FROM k JOIN st ON st.audio_id = k.audio_id AND st.lvl = k.prio AND st.k = k.k""", CD)
def _(s, d):
    names = F.element_at(F.array(F.lit("quarantined_candidate_region"), F.lit("main_channel_gap"), F.lit("uncertain_candidate"), F.lit("abnormally_long_segment")), (F.col("event_id") % 4 + 1).cast("int"))
    w = cand(s, d).select("audio_id", "start_ms", (F.col("start_ms") + 7000).alias("end_ms"), F.array(names).alias("reasons"))
    return rs.apply_budget(w, fx(s, d, "fx_duration")).select("audio_id", "start_ms", "end_ms")


LOCAL = f"""loc AS (SELECT audio_id, event_id, CAST(floor(start_ms / 9000) AS BIGINT) AS w, start_ms - 9000 * CAST(floor(start_ms / 9000) AS BIGINT) AS ls, end_ms - 9000 * CAST(floor(start_ms / 9000) AS BIGINT) AS le, {NORM.format('text')} AS norm, avg_logprob FROM fx_candidate),
off AS (SELECT audio_id, event_id, w, ls + 9000 * w AS start_ms, le + 9000 * w AS end_ms, norm, avg_logprob FROM loc)"""


def local(s, d):
    w = F.floor(F.col("start_ms") / 9000)
    c = cand(s, d).withColumn("window_id", w.cast("string")).withColumns({"start_ms": F.col("start_ms") - 9000 * w, "end_ms": F.col("end_ms") - 9000 * w})
    win = cand(s, d).select("audio_id", w.alias("w")).distinct().select("audio_id", F.col("w").cast("string").alias("window_id"), (F.col("w") * 9000).alias("start_ms"))
    return c, win


@query("d20_window_offset", LOCAL + " SELECT event_id, start_ms, end_ms FROM off", C)
def _(s, d):
    return rs.offset_candidates(*local(s, d)).select("event_id", "start_ms", "end_ms")


DEDUP = LOCAL + """,
b0 AS (SELECT *, max(end_ms) OVER (PARTITION BY audio_id, norm ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM off),
b1 AS (SELECT *, sum(CASE WHEN before IS NULL OR start_ms > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY audio_id, norm ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM b0),
dd AS (SELECT audio_id, norm, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n, arg_max(event_id, struct_pack(a := coalesce(avg_logprob, CAST('-inf' AS DOUBLE)), b := -start_ms, c := -event_id)) AS event_id FROM b1 GROUP BY audio_id, norm, island)"""


@query("f12_overlap_dedup", DEDUP + " SELECT audio_id, norm, start_ms, end_ms, n, event_id FROM dd", C)
def _(s, d):
    rows = rs.offset_candidates(*local(s, d)).withColumn("norm", norm_text(F.col("text"))).withColumn("window_ids", F.array("window_id"))
    return iv.dedup_overlapping(rows, by=["audio_id", "norm"]).select("audio_id", "norm", "start_ms", "end_ms", "n", "event_id")


@query("l5_consolidate_rescue", DEDUP + " SELECT audio_id, printf('rescue:%06d', row_number() OVER (PARTITION BY audio_id ORDER BY start_ms, end_ms, event_id)) AS evidence_id, event_id FROM dd", C)
def _(s, d):
    return rs.consolidate_rescue(*local(s, d)).select("audio_id", "evidence_id", "event_id")
