"""Cue tables: language views, residue rules, contracts, counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import text_violations

#: Phrases of a service's refusals, omission marks, low-confidence marks, punctuation.
SERVICE_PHRASES = (
    "申し訳ありません", "字幕が不完全です", "続きのテキストをいただけますか", "校正をお引き受けできません",
    "安全で適切な内容に限られます", "可协助的内容仅限于", "恕难提供校对服务", "如有其他文档需要帮助",
    "他の文書でお手伝いが必要でしたら", "搜索不可用", "未配置 TAVILY_API_KEY", "search is not available",
)
OMISSIONS = ("中略", "省略")
LOW_CONFIDENCE = ("認識不良", "认识不良", "低信頼度", "低信赖度")
PUNCTUATION = "!！?？.。…,，、:：;；\"「」『』''（）()[]［］{}｛｝·・♪♯#*＊&＆^＾%％$＄@＠~～‐-/／\\＼|｜_＿=＝+＋<＜>＞`｀¨"
NOTE = r"[※（(][^)）]*(?:文脈|修正|検討|注|注意)[^)）]*[）)]"
CRITICAL = ("empty", "bare_index", "service_phrase", "omission", "missing_ja", "leftover_note")


def strip_language(cues: DataFrame, keep: str = "zh", by: str = "audio_id") -> DataFrame:
    """One language's text; cues without any go, the rest is renumbered."""
    rows = cues.withColumn("text", F.trim(f"text_{keep}")).filter("text <> ''")
    n = F.row_number().over(Window.partitionBy(by).orderBy("start_ms", "end_ms", "cue_index")).cast("long")
    return rows.withColumn("new_index", n).select(by, F.col("new_index").alias("cue_index"), "start_ms", "end_ms", "text")


def stripped_to_nothing(cues: DataFrame, stripped: DataFrame, by: str = "audio_id") -> DataFrame:
    """Recordings that lost all cues."""
    return cues.select(by).distinct().join(stripped.select(by), by, "left_anti")


def corpus_view(cues: DataFrame, by: str = "audio_id") -> DataFrame:
    """One text per document: [i], the original and the translation of every cue."""
    line = F.concat(F.lit("["), F.col("cue_index").cast("string"), F.lit("]\n日："), "text_ja", F.lit("\n中："), "text_zh")
    rows = cues.select(by, F.struct("cue_index", line.alias("line")).alias("b"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["line"]), "\n").alias("view"))


def residue_issues(cues: DataFrame, by: str = "audio_id") -> DataFrame:
    """Issues of translated cues with tag and severity.

    Empty, bare index and punctuation end the check of a cue; omission marks hide low-confidence ones.
    """
    zh, ja = F.trim(F.coalesce("text_zh", F.lit(""))), F.trim(F.coalesce("text_ja", F.lit("")))
    any_of = lambda c, words: c.rlike("|".join(re.escape(w) for w in words))
    omitted = any_of(zh, OMISSIONS) | any_of(ja, OMISSIONS)
    doubtful = any_of(zh, LOW_CONFIDENCE) | any_of(ja, LOW_CONFIDENCE)
    punct = zh.rlike("^[\\s" + "".join("\\" + c if c in "\\[]^-&" else c for c in PUNCTUATION) + "]+$")
    more = F.array_compact(F.array(
        F.when(any_of(zh, SERVICE_PHRASES), F.lit("service_phrase")),
        F.when(omitted, F.lit("omission")).when(doubtful, F.lit("low_confidence")),
        F.when(ja == "", F.lit("missing_ja")),
        F.when(ja.rlike(NOTE), F.lit("leftover_note")),
    ))
    tags = F.when(zh == "", F.array(F.lit("empty"))).when(zh.rlike(r"^\[\d+\]$"), F.array(F.lit("bare_index"))).when(punct, F.array(F.lit("punctuation"))).otherwise(more)
    rows = cues.select(by, "cue_index", F.left(zh, F.lit(80)).alias("text"), F.explode(tags).alias("tag"))
    return rows.withColumn("severity", F.when(F.col("tag").isin(*CRITICAL), "critical").otherwise("warning"))


def issue_summary(issues: DataFrame, by: str = "audio_id") -> DataFrame:
    """Issues by recording and severity, with corpus totals where the recording is null."""
    return issues.rollup(by).agg(
        F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"), F.count(F.lit(1)).alias("total")
    ).withColumn("blocked", F.col("critical") > 0)


def cue_count(cues: DataFrame, by: str = "audio_id") -> DataFrame:
    return cues.groupBy(by).agg(F.count(F.lit(1)).alias("n_cues"))


def changed_count(before: DataFrame, after: DataFrame, by: str = "audio_id") -> DataFrame:
    """Cues whose trimmed text changed (E9). Both: by, cue_index, text."""
    both = before.select(by, "cue_index", F.trim("text").alias("old")).join(after.select(by, "cue_index", F.trim("text").alias("new")), [by, "cue_index"])
    return both.groupBy(by).agg(F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("n_changed"))


def check_final(before: DataFrame, after: DataFrame, by: str = "audio_id") -> DataFrame:
    """Cues in which only the translation may have changed: the rules they break (K2)."""
    named = lambda t, s: t.select(by, "cue_index", *[F.col(c).alias(f"{c}_{s}") for c in ("start_ms", "end_ms", "text_ja", "text_zh")], F.lit(True).alias(s))
    both = named(before, "b").join(named(after, "a"), [by, "cue_index"], "full_outer")
    same = lambda c: F.col(f"{c}_b").eqNullSafe(F.col(f"{c}_a"))
    present = F.col("a").isNotNull() & F.col("b").isNotNull()
    rules = F.array_compact(F.array(
        F.when(F.col("a").isNull(), F.lit("missing_cue")), F.when(F.col("b").isNull(), F.lit("extra_cue")),
        F.when(present & ~(same("start_ms") & same("end_ms")), F.lit("time_changed")),
        F.when(present & ~same("text_ja"), F.lit("original_changed")),
        F.when(present & (F.size(text_violations(F.col("text_zh_a"))) > 0), F.lit("unsafe_text")),
    ))
    return both.select(by, "cue_index", F.explode(rules).alias("rule"))


def split_overlong(cues: DataFrame, most_ms: int = 15_000) -> DataFrame:
    return cues.filter(F.col("end_ms") - F.col("start_ms") > most_ms)
