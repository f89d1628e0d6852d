"""Artifacts, manifests and incremental work; usage and search reports."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Artifact suffixes and their stage.
ARTIFACTS = {
    "source_audio.flac": "input", "source_manifest.json": "input", "preprocessed.wav": "asr", "preprocessed_manifest.json": "asr",
    "v3.srt": "asr", "v3_manifest.json": "asr", "turbo.srt": "asr", "turbo_manifest.json": "asr",
    "asr_candidates.json": "evidence", "asr_alignment.json": "evidence", "asr_windows.json": "evidence", "asr_decisions.json": "evidence",
    "asr_rescue_windows.json": "evidence", "asr_manifest.json": "evidence",
    "ensemble.srt": "review", "fusion_manifest.json": "review", "script_fusion_manifest.json": "review", "fusion_timeline.json": "review",
    "long_cue_alignment.json": "review", "reviewed.srt": "review", "reviewed_manifest.json": "review", "zh.srt": "review", "zh_manifest.json": "review",
    "human_reviewed.srt": "review", "human_review.json": "review", "raw.txt": "review",
    "script_units.json": "script", "script_alignment.json": "script", "final.srt": "final", "final_manifest.json": "final", "cn_only.srt": "final",
}
AUDIO_SUFFIXES = ("mp3", "wav", "m4a", "flac", "ogg", "aac")


def list_assets(spark: SparkSession, path: str, suffixes: tuple[str, ...] = AUDIO_SUFFIXES) -> DataFrame:
    """Files by suffix with their stem as key; contents are not read."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return rows.filter(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*suffixes)).select(F.regexp_replace(name, r"\.[^.]+$", "").alias("audio_id"), "path", "size_bytes", "mtime")


def list_scripts(spark: SparkSession, path: str) -> DataFrame:
    """Script files of a folder by name."""
    return list_assets(spark, path, ("txt",)).withColumnRenamed("audio_id", "script_id")


def artifact_catalog(names: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """base, kind and stage of names <base>_<suffix>; the longest suffix wins (A3)."""
    known = names.sparkSession.createDataFrame(list(ARTIFACTS.items()), "kind string, stage string")
    hits = names.join(F.broadcast(known), F.col("name").endswith(F.concat(F.lit("_"), F.col("kind"))))  # a constant of 31 rows
    best = hits.groupBy("name").agg(F.max_by(F.struct("kind", "stage"), F.length("kind")).alias("b"))
    out = best.select("name", F.expr("left(name, length(name) - length(b.kind) - 1)").alias("base"), F.col("b.kind").alias("kind"), F.col("b.stage").alias("stage"))
    return out.join(active.select("base"), "base", "left_semi") if active is not None else out


def stale_keys(manifests: DataFrame, inputs: DataFrame, outputs: DataFrame, key: str, generation: str | None = None) -> DataFrame:
    """Keys of inputs whose output isn't current: any of status, input, output or generation differs."""
    rows = inputs.select(key, F.col("sha").alias("in_sha")).join(manifests, key, "left").join(outputs.select(key, F.col("sha").alias("out_sha")), key, "left")
    same = F.col("status").eqNullSafe("complete") & F.col("input_sha").eqNullSafe(F.col("in_sha")) & F.col("output_sha").eqNullSafe(F.col("out_sha")) & F.col("out_sha").isNotNull()
    if generation is not None:
        same = same & F.col("generation").eqNullSafe(generation)
    return rows.filter(~same).select(key)


def incremental(inputs: DataFrame, manifests: DataFrame, outputs: DataFrame, key: str, job, generation: str | None = None) -> DataFrame:
    """job over the stale inputs only."""
    return job(inputs.join(stale_keys(manifests, inputs, outputs, key, generation), key, "left_semi"))


def export_changed(src: DataFrame, dst: DataFrame, key: str) -> DataFrame:
    """What an export does with each key: copied, skipped or backed_up."""
    both = src.select(key, "sha").join(dst.select(key, F.col("sha").alias("old")), key, "left")
    return both.select(key, F.when(F.col("old").isNull(), "copied").when(F.col("old") == F.col("sha"), "skipped").otherwise("backed_up").alias("outcome"))


def check_manifest(m: DataFrame) -> DataFrame:
    """Manifests whose status and output disagree (K7)."""
    rules = F.array_compact(F.array(
        F.when(~F.col("status").isin("pending", "complete"), F.lit("bad_status")),
        F.when((F.col("status") == "pending") & F.col("output_sha").isNotNull(), F.lit("pending_with_output")),
        F.when((F.col("status") == "complete") & F.col("output_sha").isNull(), F.lit("complete_without_output")),
    ))
    return m.select("doc_id", F.explode(rules).alias("rule"))


def usage_report(calls: DataFrame, by: str = "stage") -> DataFrame:
    """Token totals and the cache's share of prompts."""
    s = lambda c: F.sum(c).alias(c)
    return calls.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), s("prompt_tokens"), s("cached_tokens"), s("completion_tokens")).withColumn("hit_rate", F.coalesce(F.try_divide("cached_tokens", "prompt_tokens"), F.lit(0.0)))


def merge_results(results: DataFrame, most: int = 3500) -> DataFrame:
    """One text per query from all providers, the first of each url, cut (E15). results: query_id, provider, rank, url, snippet."""
    first = F.row_number().over(Window.partitionBy("query_id", "url").orderBy("provider", "rank"))
    rows = results.withColumn("n", first).filter("n = 1").select("query_id", F.struct("provider", "rank", F.concat_ws("\n", "url", F.left("snippet", F.lit(400))).alias("t")).alias("b"))
    return rows.groupBy("query_id").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["t"]), "\n\n"), F.lit(most)).alias("merged"))


def cache_stats(queries: DataFrame) -> DataFrame:
    """Hits: repeats of a normalised query that succeeded before (E16). queries: call_id, query, ok."""
    key = F.md5(F.lower(F.trim(F.regexp_replace("query", r"\s+", " "))))
    w = Window.partitionBy("key").orderBy("call_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = queries.withColumn("key", key).withColumn("hit", F.coalesce(F.max(F.col("ok").cast("int")).over(w) == 1, F.lit(False)))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("calls"), F.count_if("hit").alias("hits"))


def summarize(df: DataFrame, status: str, by: str = "audio_id") -> DataFrame:
    """Rows by status, one column each."""
    values = ("detected", "aligned", "split", "unresolved")
    return df.groupBy(by).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])
