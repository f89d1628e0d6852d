"""Recognizer output and scripts: nested documents, segments, files in old encodings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

SEGMENTS = "audio_id string, segments array<struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,words:array<struct<start:double,end:double,word:string,probability:double>>>>"
EVIDENCE = (
    "source struct<audio_id:string,sha256:string>, runs map<string,struct<model_role:string,source_channel:string,candidate_count:long>>, "
    "candidates array<struct<evidence_id:string,run_key:string,start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double>>"
)
#: Encodings tried for a whole file, then for single lines.
WHOLE, PER_LINE = ("utf-8-sig", "utf-8", "cp932", "euc-jp", "utf-16"), ("utf-8", "cp932", "euc-jp")


def segments_to_candidates(docs: DataFrame, run_key: str = "main:v3:raw") -> DataFrame:
    """Segments as candidates: trimmed, empty ones dropped though they count, 6 decimals, non-finite as null."""
    clean = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.bround(c, 6))
    rows = docs.select("audio_id", F.posexplode("segments").alias("p", "s"))
    words = F.transform(F.coalesce(F.col("s.words"), F.array().cast("array<struct<start:double,end:double,word:string,probability:double>>")), lambda w: F.struct(clean(w["start"]).alias("start"), clean(w["end"]).alias("end"), w["word"].alias("text"), clean(w["probability"]).alias("probability")))
    out = rows.select(
        "audio_id", F.format_string("%s:%06d", F.lit(run_key), F.col("p") + 1).alias("evidence_id"), F.lit(run_key).alias("run_key"),
        F.bround(clean(F.col("s.start")) * 1000, 0).cast("long").alias("start_ms"), F.bround(clean(F.col("s.end")) * 1000, 0).cast("long").alias("end_ms"),
        F.trim("s.text").alias("text"), clean(F.col("s.avg_logprob")).alias("avg_logprob"), clean(F.col("s.no_speech_prob")).alias("no_speech_prob"), words.alias("words"), F.lit(False).alias("legacy_srt"),
    )
    return out.filter("text <> ''")


def read_segments(spark: SparkSession, path: str, run_key: str = "main:v3:raw") -> DataFrame:
    return segments_to_candidates(spark.read.schema(SEGMENTS).json(path), run_key)


def split_evidence(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, candidates) of nested evidence documents."""
    runs = docs.select(F.col("source.audio_id").alias("audio_id"), F.explode("runs").alias("run_key", "r")).select("audio_id", "run_key", "r.*")
    return runs, docs.select(F.col("source.audio_id").alias("audio_id"), F.explode("candidates").alias("c")).select("audio_id", "c.*")


def read_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return split_evidence(spark.read.schema(EVIDENCE).option("multiLine", True).json(path))


def decode_exact(raw: bytes) -> tuple[str | None, str]:
    """(text, how): the first encoding that gives the same bytes back; else line by line with as few changes as can be.

    A line that several encodings read differently follows its neighbours; one that none reads fails the file.
    """
    for enc in WHOLE:
        try:
            text = raw.decode(enc)
            if text.encode(enc) == raw:
                return text, enc
        except UnicodeError:
            pass
    costs: dict[str, tuple[int, list[str]]] = {e: (0, []) for e in PER_LINE}
    for line in raw.splitlines(keepends=True):
        fits = {}
        for enc in PER_LINE:
            try:
                text = line.decode(enc)
                if text.encode(enc) == line:
                    fits[enc] = text
            except UnicodeError:
                pass
        if not fits:
            return None, "undecodable"
        costs = {e: min(((n + (p != e and bool(got)), [*got, t]) for p, (n, got) in costs.items()), key=lambda x: x[0]) for e, t in fits.items()}
    best = min(n for n, _ in costs.values())
    texts = {"".join(got) for n, got in costs.values() if n == best}
    return (texts.pop(), "mixed") if len(texts) == 1 else (None, "ambiguous")


def decode_scripts(files: DataFrame) -> DataFrame:
    """script_id, text, encoding of files (path, content); Spark's decode knows no cp932 or euc-jp (A10)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [decode_exact(bytes(x)) for x in b["content"]]
            yield pd.DataFrame({"script_id": b["script_id"], "text": [t for t, _ in got], "encoding": [e for _, e in got]})

    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("script_id"), "content").mapInPandas(run, "script_id string, text string, encoding string")


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    return decode_scripts(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path))


def list_scripts(spark: SparkSession, path: str) -> DataFrame:
    """Script files by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size_bytes")).orderBy("name")
