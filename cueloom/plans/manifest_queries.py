"""Queries over artifacts, manifests, usage and search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import fingerprint
from ..operators import graph, manifests as mf
from .cue_queries import CUE, cue
from .fixtures import fx, table
from .registry import query

M = ("fx_manifest",)


def man(s, d) -> DataFrame:
    return fx(s, d, "fx_manifest")


@query("a3_artifact_catalog", """n AS (SELECT p_partkey, 'base ' || p_partkey AS base, CASE p_partkey % 5 WHEN 0 THEN 'zh.srt' WHEN 1 THEN 'script_fusion_manifest.json' WHEN 2 THEN 'human_reviewed.srt' WHEN 3 THEN 'v3.srt' ELSE 'unknown.bin' END AS kind FROM part)
SELECT base, kind, CASE WHEN kind = 'v3.srt' THEN 'asr' ELSE 'review' END AS stage FROM n WHERE kind <> 'unknown.bin' AND p_partkey % 2 = 0""")
def _(s, d):
    i = F.col("p_partkey") % 5
    base = F.concat(F.lit("base "), F.col("p_partkey").cast("string"))
    kind = F.when(i == 0, "zh.srt").when(i == 1, "script_fusion_manifest.json").when(i == 2, "human_reviewed.srt").when(i == 3, "v3.srt").otherwise("unknown.bin")
    p = table(s, d, "part").select("p_partkey", base.alias("base"), F.concat(base, F.lit("_"), kind).alias("name"))
    return mf.artifact_catalog(p.select("name"), p.filter("p_partkey % 2 = 0").select("base")).select("base", "kind", "stage")


def sides(s, d):
    m = man(s, d)
    manifests = m.select("doc_id", "status", F.col("recorded_sha").alias("input_sha"), F.when(F.col("status") == "complete", F.sha2(F.col("output_name"), 256)).alias("output_sha"), F.lit("g1").alias("generation"))
    inputs = m.select("doc_id", F.col("current_sha").alias("sha"))
    outputs = m.filter("doc_id % 11 <> 0").select("doc_id", F.sha2(F.col("output_name"), 256).alias("sha"))
    return manifests, inputs, outputs


@query("d17_stale_keys", "SELECT doc_id FROM fx_manifest WHERE status <> 'complete' OR recorded_sha <> current_sha OR doc_id % 11 = 0", M)
def _(s, d):
    return mf.stale_keys(*sides(s, d), "doc_id", "g1")


@query("l16_incremental", "SELECT doc_id, 'redone' AS state FROM fx_manifest WHERE status <> 'complete' OR recorded_sha <> current_sha OR doc_id % 11 = 0", M)
def _(s, d):
    m, i, o = sides(s, d)
    return mf.incremental(i, m, o, "doc_id", lambda df: df.select("doc_id", F.lit("redone").alias("state")), "g1")


@query("b4_export_changed", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'copied' WHEN recorded_sha = current_sha THEN 'skipped' ELSE 'backed_up' END AS outcome FROM fx_manifest", M)
def _(s, d):
    m = man(s, d)
    return mf.export_changed(m.select("doc_id", F.col("current_sha").alias("sha")), m.filter("doc_id % 7 <> 0").select("doc_id", F.col("recorded_sha").alias("sha")), "doc_id")


@query("k7_manifest_contract", "SELECT doc_id, 'pending_with_output' AS rule FROM fx_manifest WHERE status = 'pending' UNION ALL SELECT doc_id, 'complete_without_output' FROM fx_manifest WHERE status = 'complete' AND doc_id % 3 = 0", M)
def _(s, d):
    out = F.when((F.col("status") == "pending") | (F.col("doc_id") % 3 != 0), F.col("recorded_sha"))
    return mf.check_manifest(man(s, d).withColumn("output_sha", out))


@query("e14_fingerprint", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') AS fp FROM documents WHERE lang IS NOT NULL""")
def _(s, d):
    return table(s, d, "documents").filter("lang IS NOT NULL").select("doc_id", fingerprint("doc_id", "lang", "n_chars").alias("fp"))


@query("e8_usage_report", """SELECT stage, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(cached_tokens)::BIGINT AS cached_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
coalesce(sum(cached_tokens) / nullif(sum(prompt_tokens), 0), 0) AS hit_rate FROM fx_usage GROUP BY stage""", ("fx_usage",))
def _(s, d):
    return mf.usage_report(fx(s, d, "fx_usage"))


@query("e15_search_merge", """f AS (SELECT * FROM fx_search QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY provider, page_id) = 1)
SELECT query_id, substr(string_agg(url || chr(10) || snippet, chr(10) || chr(10) ORDER BY provider, page_id), 1, 900) AS merged FROM f GROUP BY query_id""", ("fx_search",))
def _(s, d):
    return mf.merge_results(fx(s, d, "fx_search").withColumn("rank", F.col("page_id")), 900)


@query("e16_cache_stats", """q AS (SELECT event_id, md5(lower('Find ' || event_type || ' ' || user_id % 7)) AS key, event_id % 3 <> 0 AS ok FROM events),
h AS (SELECT *, coalesce(bool_or(ok) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS hit FROM q)
SELECT key, count(*) AS calls, count(*) FILTER (hit) AS hits FROM h GROUP BY key""")
def _(s, d):
    q = F.concat(F.lit("  Find  "), "event_type", F.lit(" "), (F.col("user_id") % 7).cast("string"))
    return mf.cache_stats(table(s, d, "events").select(F.col("event_id").alias("call_id"), q.alias("query"), (F.col("event_id") % 3 != 0).alias("ok")))


@query("e6_report_summary", """SELECT audio_id, count(*) FILTER (cue_index % 4 = 0) AS detected, count(*) FILTER (cue_index % 4 = 1) AS aligned, count(*) FILTER (cue_index % 4 = 2) AS split, count(*) FILTER (cue_index % 4 = 3) AS unresolved FROM fx_cue GROUP BY audio_id""", CUE)
def _(s, d):
    names = F.array(*map(F.lit, ("detected", "aligned", "split", "unresolved")))
    return mf.summarize(cue(s, d).withColumn("status", F.element_at(names, (F.col("cue_index") % 4 + 1).cast("int"))), "status")


def _folder(s) -> str:
    import uuid

    return f"{graph.shared_dir(s)}/cueloom/{uuid.uuid4().hex}"


@query("a1_media_assets", "SELECT sum(strlen(p_name) + 1)::BIGINT AS size_bytes FROM part")
def _(s, d):
    """A folder with files of two suffixes; those of one are listed."""
    where, names = _folder(s), table(s, d, "part").select("p_name")
    names.write.text(where)
    names.write.mode("append").parquet(where)
    return mf.list_assets(s, where, ("txt", "mp3")).agg(F.sum("size_bytes").alias("size_bytes"))


@query("a11_script_files", "SELECT sum(strlen(text) + 1)::BIGINT AS size_bytes FROM benchmark")
def _(s, d):
    where = _folder(s)
    table(s, d, "benchmark").select("text").write.text(where)
    return mf.list_scripts(s, where).agg(F.sum("size_bytes").alias("size_bytes"))
