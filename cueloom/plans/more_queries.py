"""Queries over long cues, script alignment, nested sources, stage jobs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import bigram_dice
from ..operators import batches as bt, graph, jobs, long_cues as lc, manifests as mf, script_alignment as sa, snapshots
from ..sources import evidence as sv, subtitles as st
from ..streaming import live_gaps, streams
from .cue_queries import CUE, cue, dice
from .evidence_queries import C, cand
from .fixtures import fx, table
from .registry import query
from .script_queries import batched, replies, sides


def long_cues(s, d) -> DataFrame:
    return cue(s, d).select("audio_id", "cue_index", "start_ms", "end_ms", F.replace(F.replace("text_zh", F.lit("\n"), F.lit(" ")), F.lit(". "), F.lit("。")).alias("text"))


def cue_words(s, d) -> DataFrame:
    """Words of long cues in equal shares, every ninth mis-heard."""
    c = long_cues(s, d).filter("end_ms - start_ms > 15000")
    parts = F.split(F.replace("text", F.lit("。"), F.lit("。 ")), " ")
    rows = c.withColumn("n", F.size(parts)).select("*", F.posexplode(parts).alias("p", "w"))
    at = lambda k: F.floor(F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * k / F.col("n"))
    return rows.select("audio_id", "cue_index", F.when(F.col("p") % 9 == 8, F.lit("zz")).otherwise(F.col("w")).alias("text"), at(F.col("p")).alias("start_ms"), at(F.col("p") + 1).alias("end_ms"), (0.4 + F.col("p") % 5 / 10).alias("probability"), F.col("p").alias("pos"))


SPAN = """w AS (SELECT item_id AS cue, unnest(range(len(p))) AS pos, unnest(p) AS t FROM (SELECT item_id, string_split(text, ' ') AS p FROM benchmark)),
n AS (SELECT cue, pos, lower(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) AS norm FROM w),
u AS (SELECT *, sum(length(norm)) OVER (PARTITION BY cue ORDER BY pos) AS upto FROM n WHERE norm <> ''),
sp AS (SELECT a.cue, a.pos AS first_word, b.pos AS last_word, b.upto - a.upto + length(a.norm) AS chars FROM u a JOIN u b ON a.cue = b.cue AND b.pos >= a.pos AND b.upto - a.upto + length(a.norm) <= 28)"""


def bench_words(s, d) -> DataFrame:
    b = table(s, d, "benchmark").select(F.col("item_id").alias("cue"), F.posexplode(F.split("text", " ")).alias("pos", "t"))
    return b.select("cue", "pos", F.lower(F.regexp_replace("t", "[^A-Za-z0-9]", "")).alias("norm"), F.lit(0).alias("start_ms"), F.lit(1).alias("end_ms"), (F.col("pos") % 4 / 4).alias("probability"), F.lit(12).alias("target_chars"))


@query("i7_word_spans", SPAN + " SELECT cue, first_word, last_word FROM sp")
def _(s, d):
    return lc.word_spans(bench_words(s, d)).select("cue", "first_word", "last_word")


@query("e13_span_scores", SPAN + " SELECT sp.cue, first_word, last_word, avg(u.pos % 4 / 4) AS average_probability, max(chars)::BIGINT AS chars FROM sp JOIN u ON u.cue = sp.cue AND u.pos BETWEEN first_word AND last_word GROUP BY sp.cue, first_word, last_word")
def _(s, d):
    w = bench_words(s, d).filter("norm <> ''")
    return lc.span_scores(lc.word_spans(w), w)


@query("l7_long_cue_alignment")
def _(s, d):
    return lc.align_long_cues(long_cues(s, d), cue_words(s, d))


@query("g4_best_word_span")
def _(s, d):
    return lc.align_long_cues(long_cues(s, d), cue_words(s, d)).filter("status <> 'unresolved'").select("audio_id", "cue_index", "ord", "similarity", "coverage", "probability")


TRIES = """a AS (SELECT audio_id, cue_index, 0 AS attempt, 0 AS ord, start_ms AS s, end_ms AS e FROM fx_cue),
b AS (SELECT audio_id, cue_index, 1, 0, start_ms + cue_index * 10, end_ms - CASE WHEN cue_index % 5 = 0 THEN end_ms ELSE 20 END FROM fx_cue
  UNION ALL SELECT audio_id, cue_index, 1, 1, end_ms - 10, end_ms FROM fx_cue WHERE cue_index % 7 = 3),
tr(audio_id, cue_index, attempt, ord, s, e) AS (SELECT * FROM a UNION ALL SELECT * FROM b),
sz AS (SELECT audio_id, cue_index, count(*) FILTER (attempt = 0) = count(*) FILTER (attempt = 1) AS same_n FROM tr GROUP BY audio_id, cue_index),
od AS (SELECT audio_id, cue_index, ord, max(s) AS s, min(e) AS e, count(*) = 2 AND max(s) < min(e) AS fits, greatest(max(s) - min(s), max(e) - min(e)) AS shift FROM tr GROUP BY audio_id, cue_index, ord),
co AS (SELECT audio_id, cue_index, ord, s, e, bool_and(fits AND same_n) OVER w AS agreed, CASE WHEN same_n THEN max(shift) OVER w ELSE 15001 END AS cue_shift_ms FROM od JOIN sz USING (audio_id, cue_index) WINDOW w AS (PARTITION BY audio_id, cue_index))"""


def attempts(s, d) -> DataFrame:
    """Two attempts at every cue; some of the second have another end, some another number of parts."""
    i = F.col("cue_index")
    one = cue(s, d).select("audio_id", "cue_index", F.lit(0).alias("attempt"), F.lit(0).alias("ord"), "start_ms", "end_ms", F.lit("t").alias("text"))
    two = one.withColumns({"attempt": F.lit(1), "start_ms": F.col("start_ms") + i * 10, "end_ms": F.col("end_ms") - F.when(i % 5 == 0, F.col("end_ms")).otherwise(20)})
    more = one.filter(i % 7 == 3).withColumns({"attempt": F.lit(1), "ord": F.lit(1), "start_ms": F.col("end_ms") - 10})
    return one.unionByName(two).unionByName(more)


@query("f14_attempt_consensus", TRIES + " SELECT audio_id, cue_index, ord, s AS start_ms, e AS end_ms, agreed, cue_shift_ms FROM co", CUE)
def _(s, d):
    return lc.consensus(attempts(s, d)).select("audio_id", "cue_index", "ord", "start_ms", "end_ms", "agreed", "cue_shift_ms")


@query("f14_attempt_choice", TRIES + """,
sc AS (SELECT audio_id, cue_index, attempt, min(0.55 * ((cue_index + ord) % 10) / 10 + 0.35 * ((cue_index * 3 + attempt) % 10) / 10 + 0.1 * least(1.0, (cue_index + attempt) % 3 / 2)) AS score FROM tr WHERE NOT (attempt = 1 AND cue_index % 4 = 1) AND cue_index % 11 <> 5 GROUP BY audio_id, cue_index, attempt),
al AS (SELECT audio_id, cue_index, attempt, cue_index * (attempt + 1) % 13 AS n_words, CASE WHEN cue_index % 11 = 5 OR attempt = 1 AND cue_index % 4 = 1 THEN 'unresolved' WHEN cue_index % 6 = 0 THEN 'split' ELSE 'aligned' END AS status FROM (SELECT DISTINCT audio_id, cue_index, attempt FROM tr)),
rk AS (SELECT al.*, score, row_number() OVER (PARTITION BY audio_id, cue_index ORDER BY score IS NULL, coalesce(score, n_words) DESC, attempt) AS rn, count(score) OVER (PARTITION BY audio_id, cue_index) AS resolved FROM al LEFT JOIN sc USING (audio_id, cue_index, attempt)),
c1 AS (SELECT audio_id, cue_index, max(cue_shift_ms) AS shift, bool_and(agreed) AS agreed FROM co GROUP BY audio_id, cue_index)
SELECT audio_id, cue_index, attempt, status, CASE WHEN resolved > 1 THEN shift END AS shift_ms, resolved > 1 AND agreed AS bounds_agreed, status = 'split' OR resolved < 2 OR coalesce(CASE WHEN resolved > 1 THEN shift END, 0) > 1500 AS review_required
FROM rk JOIN c1 USING (audio_id, cue_index) WHERE rn = 1""", CUE)
def _(s, d):
    i, k = F.col("cue_index"), F.col("attempt")
    lost = (i % 11 == 5) | ((k == 1) & (i % 4 == 1))
    parts = attempts(s, d).withColumns({"similarity": (i + F.col("ord")) % 10 / 10, "coverage": (i * 3 + k) % 10 / 10, "probability": (i + k) % 3 / 2})
    tries = parts.select("audio_id", "cue_index", "attempt").distinct().withColumns({
        "status": F.when(lost, "unresolved").when(i % 6 == 0, "split").otherwise("aligned"), "n_words": i * (k + 1) % 13,
    })
    return lc.choose_attempts(parts.filter(~lost), tries)


@query("l8_apply_proposals", """p AS (SELECT audio_id, cue_index AS si, start_ms AS s, end_ms AS e, text_zh AS t FROM fx_cue WHERE cue_index % 3 <> 0 OR length(text_zh) < 4
UNION ALL SELECT audio_id, cue_index, start_ms, CAST(floor((start_ms + end_ms) / 2) AS BIGINT), substr(text_zh, 1, 3) FROM fx_cue WHERE cue_index % 3 = 0 AND length(text_zh) >= 4
UNION ALL SELECT audio_id, cue_index, CAST(floor((start_ms + end_ms) / 2) AS BIGINT), end_ms, substr(text_zh, 4) FROM fx_cue WHERE cue_index % 3 = 0 AND length(text_zh) >= 4)
SELECT audio_id, row_number() OVER (PARTITION BY audio_id ORDER BY s, e, si) AS cue_index, s AS start_ms, e AS end_ms, t AS text FROM p""", CUE)
def _(s, d):
    c = cue(s, d).select("audio_id", "cue_index", "start_ms", "end_ms", F.col("text_zh").alias("text"))
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    cut = c.filter("cue_index % 3 = 0 AND length(text) >= 4")
    one = cut.select("audio_id", "cue_index", F.lit("split").alias("status"), F.lit(0).alias("ord"), "start_ms", mid.alias("end_ms"), F.left("text", F.lit(3)).alias("text"))
    two = cut.select("audio_id", "cue_index", F.lit("split").alias("status"), F.lit(1).alias("ord"), mid.alias("start_ms"), "end_ms", F.expr("substring(text, 4)").alias("text"))
    unsafe = c.filter("cue_index % 3 = 1").select("audio_id", "cue_index", F.lit("aligned").alias("status"), F.lit(0).alias("ord"), "start_ms", "end_ms", F.lit("other").alias("text"))
    return lc.apply_proposals(c, one.unionByName(two).unionByName(unsafe)).drop("source_index")


def aligned(s, d) -> DataFrame:
    return sa.align_scripts(*sides(s, d))


@query("l9_script_alignment")
def _(s, d):
    return aligned(s, d)


@query("l9_alignment_summary")
def _(s, d):
    """L9's matches counted by relation and band."""
    return aligned(s, d).groupBy("audio_id", "relation", "band").agg(F.count(F.lit(1)).alias("n"))


@query("g5_best_variants", f"""g AS (SELECT audio_id, cue_index AS grp, text_zh AS want FROM fx_cue),
op AS (SELECT audio_id, cue_index AS grp, 0 AS place, 'main' AS provenance, printf('b%05d', cue_index) AS id, text_zh AS norm FROM fx_cue
  UNION ALL SELECT audio_id, cue_index, 0, 'main', printf('a%05d', cue_index), substr(text_zh, 3) FROM fx_cue UNION ALL SELECT audio_id, cue_index, 0, 'main', printf('c%05d', cue_index), text_zh FROM fx_cue
  UNION ALL SELECT audio_id, cue_index, 0, 'rescue', printf('r%05d', cue_index), substr(text_zh, 2) FROM fx_cue
  UNION ALL SELECT audio_id, cue_index - 1, 1, 'main', printf('d%05d', cue_index), substr(text_zh, 1, 4) FROM fx_cue WHERE cue_index % 2 = 1
  UNION ALL SELECT audio_id, cue_index - 1, 1, CASE WHEN cue_index % 3 = 0 THEN 'main' ELSE 'rescue' END, printf('e%05d', cue_index), text_zh FROM fx_cue WHERE cue_index % 2 = 1),
du AS (SELECT audio_id, grp, place, provenance, norm, min(id) AS id FROM op WHERE norm <> '' GROUP BY audio_id, grp, place, provenance, norm),
np AS (SELECT audio_id, grp, max(place) AS last FROM op GROUP BY audio_id, grp),
va AS (SELECT audio_id, grp, norm AS b, id AS ids FROM du JOIN np USING (audio_id, grp) WHERE last = 0
  UNION ALL SELECT x.audio_id, x.grp, x.norm || y.norm, x.id || ',' || y.id FROM du x JOIN du y ON x.audio_id = y.audio_id AND x.grp = y.grp AND x.provenance = y.provenance AND x.place = 0 AND y.place = 1),
vs AS (SELECT g.audio_id, g.grp, want AS a, b, ids FROM g JOIN va USING (audio_id, grp)),
sc AS (SELECT audio_id, grp, b, ids, abs(length(a) - length(b)) AS away, CASE WHEN a = b THEN 1.0 WHEN least(length(a), length(b)) <= 2 THEN 0.0 ELSE 0.85 * {dice('a', 'b')} + 0.15 * (least(length(a), length(b)) / greatest(length(a), length(b))) END AS score FROM vs)
SELECT audio_id, grp, ids, b AS norm, score FROM (SELECT *, row_number() OVER (PARTITION BY audio_id, grp ORDER BY score DESC, away, ids, b) AS rn FROM sc) WHERE rn = 1""", CUE)
def _(s, d):
    """Every cue's text against candidates of one or two items, of two provenances, with repeats."""
    c, i = cue(s, d).filter("text_zh is not null"), F.col("cue_index")
    one = lambda p, tag, text, place=0, at=i: (F.lit(place).alias("place"), F.struct(F.lit(p).alias("provenance") if isinstance(p, str) else p.alias("provenance"), F.format_string(tag + "%05d", i).alias("evidence_id"), text.alias("norm")).alias("o"), at.alias("grp"))
    t, odd = F.col("text_zh"), c.filter(i % 2 == 1)
    options = c.select("audio_id", *one("main", "b", t))
    for rows, cols in (
        (c, one("main", "a", F.expr("substring(text_zh, 3)"))), (c, one("main", "c", t)), (c, one("rescue", "r", F.expr("substring(text_zh, 2)"))),
        (odd, one("main", "d", F.substring(t, 1, 4), 1, i - 1)), (odd, one(F.when(i % 3 == 0, "main").otherwise("rescue"), "e", t, 1, i - 1)),
    ):
        options = options.unionByName(rows.select("audio_id", *cols))
    groups = c.select("audio_id", i.alias("grp"), F.col("text_zh").alias("want"))
    best = sa.best_variants(groups, options.select("audio_id", "grp", "place", "o.*"), sim=bigram_dice)
    return best.select("audio_id", "grp", F.array_join("evidence_ids", ",").alias("ids"), "norm", "score")


@query("k5_alignment_contract", """SELECT conv_id AS audio_id, turn AS first_unit, 'bad_band' AS rule FROM conversations WHERE turn % 3 = 1
UNION ALL SELECT conv_id, turn, 'unit_overlap' FROM conversations WHERE turn > 0 AND turn % 4 = 2 AND turn - 1 >= 0""")
def _(s, d):
    t = table(s, d, "conversations").select(F.col("conv_id").alias("audio_id"), F.col("turn").alias("first_unit"), F.when(F.col("turn") % 4 == 1, 2).otherwise(1).alias("n_units"), F.col("turn").alias("first_item"), F.lit(1).alias("n_items"), F.lit(0.9).alias("score"), F.when(F.col("turn") % 3 == 1, "low").otherwise("high").alias("band"))
    return sa.check_alignment(t)


@query("k5_alignment_inputs", """b AS (SELECT conv_id AS audio_id, turn AS pos, turn % 9 AS k FROM conversations)
SELECT audio_id, 'match' AS side, pos, CASE k WHEN 1 THEN 'score_mismatch' WHEN 2 THEN 'bad_band' WHEN 3 THEN 'bad_relation' WHEN 4 THEN 'foreign_evidence' WHEN 5 THEN 'bad_review_flag' ELSE 'bad_margin' END AS rule FROM b WHERE k BETWEEN 1 AND 6
UNION ALL SELECT audio_id, side, pos, side || '_uncovered' FROM b, (VALUES ('unit'), ('item')) v(side) WHERE k = 7
UNION ALL SELECT audio_id, 'item', pos, 'no_reason' FROM b WHERE k = 8""")
def _(s, d):
    """Every turn as unit and item, matched one to one; by its number one rule is broken."""
    k, none = F.col("pos") % 9, F.lit(None)
    text = F.concat(F.lit("t"), F.col("turn").cast("string"), F.lit(" "), F.coalesce(F.lower("text"), F.lit("")))
    u = table(s, d, "conversations").select(F.col("conv_id").alias("audio_id"), F.col("turn").alias("pos"), text.alias("norm"))
    way = lambda p, i, n: F.struct(F.lit(p).alias("provenance"), F.lit(i).alias("evidence_id"), n.alias("norm"))
    t = u.withColumn("options", F.array(way("main", "a", F.col("norm")), way("other", "b", F.lit("else"))))
    m = u.filter(k < 7).select(
        "audio_id", F.col("pos").alias("first_unit"), F.lit(1).alias("n_units"), F.col("pos").alias("first_item"), F.lit(1).alias("n_items"), F.when(k == 1, 0.9).otherwise(1.0).alias("score"),
        F.when(k == 2, "low").otherwise("high").alias("band"), F.when(k == 3, "many_to_many").otherwise("one_to_one").alias("relation"), F.array(F.when(k == 4, "zz").otherwise("a")).alias("evidence_ids"),
        (k >= 5).alias("review_required"), F.when(k == 6, -1.0).alias("margin"), none.cast("string").alias("reason"))
    side = F.explode(F.array(F.lit("unit"), F.lit("item")))
    out = u.filter(k == 8).select("audio_id", side.alias("side"), "pos").withColumn("reasons", F.when(F.col("side") == "unit", F.array(F.lit("no_match"))).otherwise(F.array().cast("array<string>")))
    return sa.check_alignment_inputs(m, u, t, out)


# ---- nested sources ----
@query("a8_segment_ingest", """SELECT audio_id, printf('main:v3:raw:%06d', row_number() OVER (PARTITION BY audio_id ORDER BY event_id)) AS evidence_id, start_ms, end_ms, trim(text) AS text, CASE WHEN event_id % 5 = 0 THEN NULL ELSE avg_logprob END AS avg_logprob FROM fx_candidate QUALIFY event_id % 7 <> 0""", C)
def _(s, d):
    c = cand(s, d)
    seg = F.struct("event_id", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.when(F.col("event_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "text")).alias("text"),
                   F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("avg_logprob")).alias("avg_logprob"), "no_speech_prob", F.lit(None).cast("array<struct<start:double,end:double,word:string,probability:double>>").alias("words"))
    docs = c.groupBy("audio_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"))
    return sv.segments_to_candidates(docs).select("audio_id", "evidence_id", "start_ms", "end_ms", "text", "avg_logprob")


@query("a9_evidence_documents", "SELECT CAST(audio_id AS VARCHAR) AS audio_id, run_key, count(*) AS n FROM fx_candidate GROUP BY audio_id, run_key", C)
def _(s, d):
    c = cand(s, d)
    one = F.struct(F.col("event_id").cast("string").alias("evidence_id"), "run_key", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", "avg_logprob", "no_speech_prob")
    docs = c.groupBy("audio_id").agg(F.to_json(F.struct(F.struct(F.first("audio_id").cast("string").alias("audio_id")).alias("source"), F.collect_list(one).alias("candidates"))).alias("j"))
    return sv.split_evidence(docs.select(F.from_json("j", sv.EVIDENCE).alias("e")).select("e.*"))[1].groupBy("audio_id", "run_key").agg(F.count(F.lit(1)).alias("n"))


@query("a10_script_decoding", "SELECT CAST(doc_id AS VARCHAR) AS script_id, text, 'utf-8' AS encoding FROM documents")
def _(s, d):
    t = table(s, d, "documents")
    return sv.decode_scripts(t.select(F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")))


# ---- jobs and streams ----
@query("l19_stage_job")
def _(s, d):
    """Stale recordings, batched, reconciled, rendered, with change counts."""
    c = cue(s, d).select("audio_id", "cue_index", "start_ms", "end_ms", F.replace("text_ja", F.lit("\n"), F.lit(" ")).alias("text"))
    inputs = jobs.text_fingerprints(c)
    done = inputs.filter("audio_id % 3 = 0").select("audio_id", F.lit("complete").alias("status"), F.col("sha").alias("input_sha"), F.col("sha").alias("output_sha"))
    stale = mf.stale_keys(done, inputs, inputs.filter("audio_id % 3 = 0"), "audio_id")
    return jobs.run_stage(c, stale, batched(s, d), replies(s, d), batch_size=4)


@query("b3_versioned_write", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'input_changed' ELSE 'written' END AS outcome FROM fx_manifest", ("fx_manifest",))
def _(s, d):
    m = fx(s, d, "fx_manifest")
    held = snapshots.SnapshotTable(s, f"{_shared(s)}/versions", "doc_id")
    left = snapshots.write_bound(held, m.select("doc_id", "output_name"), m.select("doc_id", F.col("recorded_sha").alias("sha")), m.select("doc_id", F.col("current_sha").alias("sha")))
    return left.withColumn("outcome", F.lit("input_changed")).unionByName(held.read().select("doc_id", F.lit("written").alias("outcome")))


@query("b5_superseded_versions", """w AS (SELECT doc_id, 1 + (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT AS writes, CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS last FROM documents)
SELECT doc_id, (writes - 1)::BIGINT AS superseded, last AS current_version FROM w""")
def _(s, d):
    """All keys, then every second, then every third."""
    m = fx(s, d, "fx_manifest").select("doc_id", F.col("current_sha").alias("sha"))
    held = snapshots.SnapshotTable(s, f"{_shared(s)}/history", "doc_id")
    for k in (1, 2, 3):
        snapshots.write_bound(held, m.filter(F.col("doc_id") % k == 0), m, m)
    return held.history().groupBy("doc_id").agg((F.count(F.lit(1)) - 1).alias("superseded"), F.max("written_in").alias("current_version"))


def _shared(s) -> str:
    import uuid

    return f"{graph.shared_dir(s)}/cueloom/{uuid.uuid4().hex}"


def _drained(s, df: DataFrame, mode: str) -> DataFrame:
    """A stream run over all there is, into a table in the shared folder."""
    base = _shared(s)
    df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(df.schema).parquet(f"{base}/out")


def _totals(s, df: DataFrame) -> DataFrame:
    """All groups of a streaming aggregation after a run over all there is."""
    base = _shared(s)
    run = streams.write_complete(df, f"{base}/out", f"{base}/state")
    run.awaitTermination()
    if run.lastProgress is None:
        return s.createDataFrame([], df.schema)
    return s.read.schema(df.schema).parquet(f"{base}/out/{run.lastProgress['batchId']}")


def _as_stream(s, rows: DataFrame) -> DataFrame:
    base = _shared(s)
    rows.write.parquet(base)
    return s.readStream.schema(rows.schema).parquet(base)


@query("m1_ingest_new_files", "SELECT audio_id, event_id FROM fx_candidate WHERE end_ms > start_ms", C)
def _(s, d):
    src, base = _shared(s), _shared(s)
    rows = cand(s, d).select("audio_id", "event_id", "start_ms", "end_ms")
    for part in (0, 1):  # two arrivals, each seen once
        rows.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(src)
        streams.ingest_new(s, src, rows.schema, f"{base}/out", f"{base}/state", lambda df: df.filter("end_ms > start_ms")).awaitTermination()
    return s.read.schema(rows.schema).parquet(f"{base}/out").select("audio_id", "event_id")


@query("m2_upsert_stream", "SELECT run_key, count(*) AS n, count(*) FILTER (audio_id % 2 = 0) AS n_second FROM fx_candidate GROUP BY run_key", C)
def _(s, d):
    """All runs, then those of every second recording again: they replace the first."""
    rows, held = cand(s, d).withColumn("arrival", F.lit(1)), snapshots.SnapshotTable(s, f"{_shared(s)}/runs", "audio_id")
    for part in (rows, rows.filter("audio_id % 2 = 0").withColumn("arrival", F.lit(2))):
        streams.upsert_stream(_as_stream(s, part), held, _shared(s)).awaitTermination()
    return held.read().groupBy("run_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("arrival") == 2).alias("n_second"))


SESSIONS = """x AS (SELECT *, lag(start_ms) OVER (PARTITION BY audio_id ORDER BY start_ms) AS last FROM fx_candidate),
y AS (SELECT *, sum(CASE WHEN last IS NULL OR start_ms - last >= 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY audio_id ORDER BY start_ms) AS stretch FROM x),
ss AS (SELECT audio_id, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM y GROUP BY audio_id, stretch)"""


def sessions(s, d) -> DataFrame:
    return _totals(s, streams.speech_sessions(_as_stream(s, cand(s, d).select("audio_id", "start_ms", "end_ms"))))


@query("m3_speech_sessions", SESSIONS + " SELECT audio_id, n, start_ms, end_ms FROM ss", C)
def _(s, d):
    return sessions(s, d)


GAPS = SESSIONS + """, g AS (SELECT audio_id, start_ms, max(end_ms) OVER (PARTITION BY audio_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ss)
SELECT audio_id, before AS gap_start, start_ms AS gap_end FROM g WHERE start_ms - before >= 1500"""


@query("m3_gap_alerts", GAPS, C)
def _(s, d):
    rows = cand(s, d).select("audio_id", "start_ms", "end_ms")
    return _drained(s, streams.gap_alerts(_as_stream(s, rows)), "append").select("audio_id", "gap_start", "gap_end")


@query("m3_live_gaps", GAPS, C)
def _(s, d):
    """Every second candidate first, then the others, which correct what was told."""
    rows, src, base = cand(s, d).select("event_id", "audio_id", "start_ms", "end_ms"), _shared(s), _shared(s)
    schema = "audio_id long, start_ms long, end_ms long, at timestamp"
    for part in (0, 1):
        rows.filter(F.pmod("event_id", F.lit(2)) == part).select(*[F.col(c).cast("long").alias(c) for c in ("audio_id", "start_ms", "end_ms")], F.timestamp_seconds(F.lit(1_000_000 + part)).alias("at")).write.mode("append").parquet(src)
        changes = live_gaps.live_gaps(s.readStream.schema(schema).parquet(src), keep_ms=1 << 62)
        with live_gaps.rocksdb(s):
            run = changes.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return live_gaps.gaps_now(s.read.schema(live_gaps.OUT).parquet(f"{base}/out"))


@query("m4_usage_totals", "SELECT strftime(date_trunc('hour', ts::TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS hour, stage, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, count(*) AS calls FROM fx_usage JOIN events ON event_id = call_id GROUP BY 1, 2", ("fx_usage",))
def _(s, d):
    calls = fx(s, d, "fx_usage").join(table(s, d, "events").select(F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts")), "call_id")
    return _totals(s, streams.usage_totals(_as_stream(s, calls))).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query("m5_distinct_queries", "SELECT event_type || ' ' || user_id % 7 AS query FROM events GROUP BY 1")
def _(s, d):
    q = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", F.lit(" "), (F.col("user_id") % 7).cast("string")).alias("query"))
    return _drained(s, streams.distinct_queries(_as_stream(s, q), "3650 days"), "append").select("query")
