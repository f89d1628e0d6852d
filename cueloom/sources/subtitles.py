"""SRT text as tables of cues, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.timecode import TIMECODE, ms_to_tc, tc_to_ms
from ..operators import scans
from .srt_source import SPLIT_BYTES, read_blocks

ARROW = TIMECODE.replace("(", "").replace(")", "")
SPAN = f"({ARROW})" + r"\s*-->\s*" + f"({ARROW})"


def read_files(spark: SparkSession, path: str, glob: str = "*.srt") -> DataFrame:
    """name, body: one row per file."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("audio_id"), F.col("value").alias("body"))


def blocks(files: DataFrame, by: str = "audio_id") -> DataFrame:
    """by, ord, lines: the blocks of each body, numbered from 1. files: whole (by, body), or by blocks (by, pos, lines) as the srt source gives them."""
    if "lines" in files.columns:
        return _numbered(files, by)
    body = F.regexp_replace(F.regexp_replace("body", "\r\n?", "\n"), "^﻿", "")
    parts = F.split(F.regexp_replace(F.regexp_replace(body, r"^\s+", ""), r"\s+$", ""), "\n\n+")
    rows = files.select(by, F.posexplode(parts).alias("p", "block"))
    return rows.select(by, (F.col("p") + 1).alias("ord"), F.split(F.regexp_replace(F.regexp_replace("block", r"^\s+", ""), r"\s+$", ""), "\n").alias("lines"))


def _numbered(found: DataFrame, by: str) -> DataFrame:
    """by, ord, lines of found(by, pos, lines); blank blocks count only between others, or as all that a file has.

    A long file's blocks are numbered by ranges, so it is never one task.
    """
    real = F.when(F.col("lines") != F.array(F.lit("")), F.col("pos"))
    held = scans.in_blocks(found.select(by, "pos", "lines"), [by], ["pos"])
    edges = held.groupBy(F.col(by).alias("_of")).agg(F.coalesce(F.min(real), F.min("pos")).alias("_first"), F.coalesce(F.max(real), F.min("pos")).alias("_last"))
    within = held.join(edges, held[by] == edges["_of"]).filter(F.col("pos").between(F.col("_first"), F.col("_last"))).select(*held.columns)
    return scans.row_numbers(within, [by], ["pos"], "ord").select(by, F.col("ord").cast("int").alias("ord"), "lines")


def parse_cues(files: DataFrame, by: str = "audio_id") -> DataFrame:
    """Lenient reader: the index line is optional, text lines are joined by a space, bad blocks are dropped (A4)."""
    rows = blocks(files, by)
    first, second = F.get("lines", F.lit(0)), F.get("lines", F.lit(1))
    has_index = first.rlike(r"^\s*\d+\s*$") & F.coalesce(second.rlike(SPAN), F.lit(False))
    at = F.when(has_index, 2).otherwise(1)
    span = F.when(has_index, second).otherwise(first)
    text = F.array_join(F.slice("lines", at + 1, F.size("lines")), " ")
    cues = rows.withColumns({"span": span, "text": F.trim(text), "cue_index": F.when(has_index, F.trim(first).cast("long")).otherwise(F.col("ord").cast("long"))})
    return _timed(cues).filter(F.col("start_ms").isNotNull() & (F.col("text") != "")).select(by, "cue_index", "ord", "start_ms", "end_ms", "text")


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"start_ms": tc_to_ms(F.regexp_extract("span", SPAN, 1)), "end_ms": tc_to_ms(F.regexp_extract("span", SPAN, 2))})


def parse_bilingual(files: DataFrame, by: str = "audio_id") -> DataFrame:
    """Four-line blocks: index, times, Japanese, the rest Chinese; a block without a numeric index is skipped (A5)."""
    rows = blocks(files, by).filter((F.size("lines") >= 4) & F.get("lines", F.lit(0)).rlike(r"^\s*\d+\s*$"))
    cues = rows.select(
        by, F.trim(F.get("lines", F.lit(0))).cast("long").alias("cue_index"), F.get("lines", F.lit(1)).alias("span"), F.get("lines", F.lit(2)).alias("text_ja"),
        F.trim(F.array_join(F.slice("lines", 4, F.size("lines")), "\n")).alias("text_zh"),
    )
    return _timed(cues).drop("span")


def check_blocks(files: DataFrame, by: str = "audio_id", most: int = 20_000) -> DataFrame:
    """Strict reader: every block with the reasons that forbid its file."""
    rows = blocks(files, by)
    index, span = F.get("lines", F.lit(0)), F.get("lines", F.lit(1))
    text = F.array_join(F.slice("lines", 3, F.size("lines")), "\n")
    strict = r"^\d{2}:[0-5]\d:[0-5]\d,\d{3}\s*-->\s*\d{2}:[0-5]\d:[0-5]\d,\d{3}$"
    rows = _timed(rows.withColumns({"index_text": index, "span": F.coalesce(span, F.lit("")), "text": text}))
    number = F.when(F.col("index_text").rlike(r"^\d{1,9}$"), F.col("index_text").cast("long"))
    rows = rows.withColumn("cue_index", number).withColumn("same", F.count("cue_index").over(Window.partitionBy(by, "cue_index")))
    reasons = F.array_compact(F.array(
        F.when(F.size("lines") < 3, F.lit("short_block")),
        F.when(F.col("cue_index").isNull() | (F.col("cue_index") <= 0), F.lit("bad_index")),
        F.when(F.col("cue_index").isNotNull() & (F.col("same") > 1), F.lit("duplicate_index")),
        F.when(~F.col("span").rlike(strict), F.lit("bad_timecode")),
        F.when(F.col("end_ms") <= F.col("start_ms"), F.lit("no_duration")),
        F.when(F.trim("text") == "", F.lit("empty_text")),
        F.when(F.col("text").contains("-->"), F.lit("arrow_in_text")),
        F.when(F.col("text").rlike(r"[\p{Cc}&&[^\n]]"), F.lit("control_character")),
        F.when(F.length("text") > most, F.lit("too_long")),
    ))
    return rows.select(by, "ord", "cue_index", "start_ms", "end_ms", "text", reasons.alias("reasons"))


def read_cues(spark: SparkSession, path: str, mode: str = "PERMISSIVE", *, ranges: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame | tuple[DataFrame, DataFrame]:
    """PERMISSIVE: lenient cues. FAILFAST: strict, an error for any bad block. QUARANTINE: (good files' cues, bad blocks).

    ranges: long files are read by byte ranges through the srt source, else each is one row.
    """
    files = read_blocks(spark, path, split_bytes=split_bytes) if ranges else read_files(spark, path)
    if mode == "PERMISSIVE":
        return parse_cues(files)
    checked = check_blocks(files)
    if mode == "FAILFAST":
        sound = F.when(F.size("reasons") == 0, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("bad block in "), "audio_id", F.lit(": "), F.array_join("reasons", ","))))
        return checked.withColumn("text", sound).drop("reasons")
    bad = checked.filter(F.size("reasons") > 0)
    return checked.join(bad.select("audio_id").distinct(), "audio_id", "left_anti").drop("reasons"), bad


def cues_to_candidates(cues: DataFrame, model_role: str, channel: str = "main", by: str = "audio_id") -> DataFrame:
    """Cues as candidates without scores or words; the ordinal counts dropped blocks too."""
    key = f"{channel}:{model_role}:legacy_srt"
    return cues.select(
        by, F.format_string("%s:%06d", F.lit(key), F.col("ord")).alias("evidence_id"), F.lit(key).alias("run_key"), "start_ms", "end_ms", "text",
        F.lit(None).cast("double").alias("avg_logprob"), F.lit(None).cast("double").alias("no_speech_prob"), F.lit(True).alias("legacy_srt"),
    )


def extract_srt(text: Column) -> Column:
    """SRT inside free text: a closed fence, an open one, from the line before the first time, or all of it."""
    closed = F.regexp_extract(text, r"(?s)```[a-z]*\n(.*?)```", 1)
    opened = F.regexp_extract(text, r"(?s)```[a-z]*\n(.*)$", 1)
    bare = F.regexp_extract(text, r"(?s)((?:^|(?<=\n))[^\n]*\n" + ARROW + r"\s*-->.*)$", 1)
    trim = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    use = lambda c: F.when(c.contains("-->"), trim(c))
    return F.coalesce(use(closed), use(opened), F.when(bare != "", trim(bare)), trim(text))


def reindex(cues: DataFrame, by: str = "audio_id", order: tuple[str, ...] = ("start_ms", "end_ms", "cue_index")) -> DataFrame:
    """Numbers 1..n in order (B2)."""
    return cues.withColumn("cue_index", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def render_srt(cues: DataFrame, text: str = "text", by: str = "audio_id") -> DataFrame:
    """One SRT text per recording, renumbered in order (B1)."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("start_ms", "end_ms", "cue_index"))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), ms_to_tc(F.col("start_ms")), F.lit(" --> "), ms_to_tc(F.col("end_ms")), F.lit("\n"), F.col(text), F.lit("\n"))
    rows = cues.withColumn("n", n).select(by, F.struct("n", block.alias("block")).alias("b"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n").alias("srt"))
