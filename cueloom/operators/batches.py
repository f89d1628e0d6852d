"""Exchange with a text service in batches: building them, reading replies, merging results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .walk import walk_groups

SEPARATOR = "---SPLIT---"


def batch_rows(df: DataFrame, size: int, overlap: int = 0, by: str = "audio_id", order: str = "cue_index") -> DataFrame:
    """Rows with their batches of `size`, each starting size - overlap after the one before (I8).

    A row's batches follow from its place alone, so no batch table and no range join is needed.
    """
    step = size - overlap
    pos = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / step) + 1).cast("int")
    last = F.floor(F.col("pos") / step).cast("int")
    return df.withColumn("pos", pos).withColumn("batch", F.explode(F.sequence(first, last))).withColumn("place", F.col("pos") - F.col("batch") * step)


def pack_lines(lines: DataFrame, max_lines: int = 250, max_chars: int = 24_000, by: str = "script_id", order: str = "pos", chars: str = "n_chars") -> DataFrame:
    """Greedy batches by lines and characters; an oversize line is alone and flagged.

    Where a batch ends depends on where it began, so the fold runs over one script's lengths, which
    come sorted in one stream: a script has no frame of its own.
    """

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        out, batch, n, total = [], -1, max_lines, 0
        for at, size in rows:
            if n >= max_lines or total >= max_chars or total + size > max_chars:
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + size
            out.append((*key, at, batch, size > max_chars))
        return out

    kinds = dict(lines.dtypes)
    return walk_groups(lines, [by], [order], [order, chars], fold, f"{by} {kinds[by]}, {order} {kinds[order]}, batch long, oversized boolean")


def rebase_batches(rows: DataFrame, starts: DataFrame, by: str = "script_id") -> DataFrame:
    """Batch-local line numbers as positions in the whole script; oversize batches are one unknown row."""
    moved = rows.join(starts.filter("not oversized"), [by, "batch"]).select(
        by, (F.col("first_line") + F.col("start")).alias("first_line"), (F.col("last_line") + F.col("start")).alias("last_line"), "kind", "confidence"
    )
    big = starts.filter("oversized").select(by, F.col("start").alias("first_line"), F.col("start").alias("last_line"), F.lit("unknown").alias("kind"), F.lit(0.0).alias("confidence"))
    return moved.unionByName(big)


def reply_parts(reply: Column) -> Column:
    """Parts of a reply, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(reply, SEPARATOR), lambda p: F.regexp_replace(F.regexp_replace(p, r"(?U)^\s+", ""), r"(?U)\s+$", "")), lambda p: p != "")


def recovered_lines(reply: Column, n: Column) -> Column:
    """Lines numbered [k] in a free reply, 1..n; null when under half are found, the last of equal numbers wins."""
    line = r"(?m)^[\[（(](\d+)[\]）)][^\S\n]*(.+?)$"
    number = F.regexp_extract_all(reply, F.lit(line), F.lit(1))
    clean = lambda t: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, r"[（(][^)）]*[)）]\s*$", "")), "（[^）]*）", "")), r"^\[\d+\]\s*", ""))
    text = F.transform(F.regexp_extract_all(reply, F.lit(line), F.lit(2)), clean)
    pairs = F.filter(F.arrays_zip(number.alias("k"), text.alias("t")), lambda p: p["t"] != "")
    at = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"].cast("long") == k), -1)["t"]
    found = F.size(F.array_distinct(F.transform(pairs, lambda p: p["k"].cast("long"))))
    lines = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: F.when(F.exists(pairs, lambda p: p["k"].cast("long") == k), at(k)).otherwise(F.lit("")))
    return F.when(F.size(pairs) > 0, F.when(found >= 0.5 * n, lines))


def reconcile(batches: DataFrame, replies: DataFrame, retries: DataFrame | None = None, by: tuple[str, ...] = ("audio_id", "batch")) -> DataFrame:
    """One row per batch line with the text that stands and the tier that gave it.

    1: as many parts as lines. 2: numbered lines recovered. 3: retried line by line. 0: the original.
    batches: by, place, text. replies: by, reply. retries: by, place, retry.
    """
    keys = list(by)
    sized = batches.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    parts = replies.select(*keys, "reply", reply_parts(F.col("reply")).alias("parts"))
    rows = sized.join(parts, keys, "left").withColumn("lines", recovered_lines(F.col("reply"), F.col("n")))
    place = F.col("place").cast("int")
    tier = F.when(F.col("reply").isNull(), 0).when(F.size("parts") == F.col("n"), 1).when(F.col("lines").isNotNull(), 2).otherwise(3 if retries is not None else 0)
    rows = rows.withColumn("tier", tier)
    if retries is not None:
        rows = rows.join(retries.select(*keys, "place", "retry"), [*keys, "place"], "left")
    given = F.when(F.col("tier") == 1, F.get("parts", place)).when(F.col("tier") == 2, F.nullif(F.get("lines", place), F.lit("")))
    if retries is not None:
        given = given.when(F.col("tier") == 3, F.nullif(F.trim("retry"), F.lit("")))
    return rows.select(*keys, "place", "tier", F.coalesce(given, F.col("text")).alias("text"))


def translate_first_pass(batches: DataFrame, replies: DataFrame, by: tuple[str, ...] = ("audio_id", "batch")) -> DataFrame:
    """First translation: blanks count as parts, a blank gives the source text, a wrong count empty lines."""
    keys = list(by)
    rows = batches.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).join(replies.select(*keys, F.transform(F.split("reply", SEPARATOR), lambda p: F.trim(p)).alias("parts")), keys, "left")
    part = F.get("parts", F.col("place").cast("int"))
    fits = F.coalesce(F.size("parts") == F.col("n"), F.lit(False))
    return rows.select(*keys, "place", F.when(fits, F.when(part != "", part).otherwise(F.col("text"))).otherwise("").alias("text"))


def merge_batches(results: DataFrame, source: DataFrame, policy: str = "first", by: str = "audio_id", key: str = "pos") -> DataFrame:
    """One text per row of overlapping batches: of the lowest batch, or the highest; gaps keep the source."""
    pick = F.min_by if policy == "first" else F.max_by
    best = results.groupBy(by, key).agg(pick("text", "batch").alias("given"))
    return source.select(by, key, "text").join(best, [by, key], "left").select(by, key, F.coalesce("given", "text").alias("text"))


def parse_corrections(replies: DataFrame, by: str = "audio_id") -> DataFrame:
    """Corrections in a reply: JSON {"corrections": [{index, issue, fix}]}, or the plain-text grammar."""
    schema = "corrections array<struct<index:long,issue:string,fix:string>>"
    grammar = r"(?s)索引[：:]\s*(\d+)[^\n]*\n[^\n]*?问题[：:]\s*([^\n]*)\n[^\n]*?修正[：:]\s*(.*?)(?=\n---|\n索引|\z)"
    group = lambda k: F.regexp_extract_all("reply", F.lit(grammar), F.lit(k))
    plain = F.transform(F.arrays_zip(group(1).alias("i"), group(2).alias("p"), group(3).alias("f")), lambda x: F.struct(x["i"].cast("long").alias("index"), F.trim(x["p"]).alias("issue"), F.trim(x["f"]).alias("fix")))
    parsed = F.coalesce(F.from_json("reply", schema)["corrections"], plain)
    return replies.select(by, F.explode(parsed).alias("c")).select(by, F.col("c.index").alias("cue_index"), F.col("c.issue").alias("issue"), F.col("c.fix").alias("fix"))


def apply_corrections(cues: DataFrame, corrections: DataFrame, by: str = "audio_id", text: str = "text_zh") -> DataFrame:
    """Cues with the fix of their index in place of the text."""
    fix = corrections.select(by, "cue_index", "fix").dropDuplicates([by, "cue_index"])
    return cues.join(fix, [by, "cue_index"], "left").withColumn(text, F.coalesce(F.trim("fix"), F.col(text))).drop("fix")


def bad_corrections(cues: DataFrame, corrections: DataFrame, by: str = "audio_id") -> DataFrame:
    """Corrections of unknown or repeated indexes, or with unsafe text."""
    from ..functions.text import text_violations

    n = F.count(F.lit(1)).over(Window.partitionBy(by, "cue_index"))
    known = cues.select(by, "cue_index", F.lit(True).alias("known"))
    rows = corrections.withColumn("n", n).join(known, [by, "cue_index"], "left")
    why = F.array_compact(F.array(F.when(F.col("known").isNull(), F.lit("unknown_index")), F.when(F.col("n") > 1, F.lit("duplicate_index")), F.when(F.size(text_violations(F.col("fix"))) > 0, F.lit("unsafe_fix"))))
    return rows.select(by, "cue_index", F.explode(why).alias("rule"))


def final_pass(cues: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues with sound corrections applied, violations)."""
    from .cues import check_final

    corrections = parse_corrections(replies)
    bad = bad_corrections(cues, corrections)
    sound = corrections.join(bad.select("audio_id").distinct(), "audio_id", "left_anti")
    after = apply_corrections(cues, sound)
    changed = cues.join(sound, ["audio_id", "cue_index"], "left_semi")
    broken = check_final(changed, after.join(changed.select("audio_id", "cue_index"), ["audio_id", "cue_index"], "left_semi"))
    return after, bad.unionByName(broken)


def select_mismatched(df: DataFrame, mismatched: DataFrame, by: str = "audio_id") -> DataFrame:
    """Rows of mismatched documents; all rows while the list is empty."""
    any_ = mismatched.agg((F.count(F.lit(1)) == 0).alias("all"))
    marked = df.join(mismatched.select(by).distinct().withColumn("_hit", F.lit(True)), by, "left")
    return marked.withColumn("_all", F.lit(any_.first()["all"])).filter("_all OR _hit").drop("_hit", "_all")


def merge_mismatches(previous: DataFrame, active: DataFrame, matched: DataFrame, mismatched: DataFrame, by: str = "audio_id") -> DataFrame:
    """((previous and active) without matched) with (mismatched and active) (H3)."""
    a = active.select(by).distinct()
    carried = previous.select(by).distinct().join(a, by, "left_semi").join(matched.select(by), by, "left_anti")
    return carried.union(mismatched.select(by).join(a, by, "left_semi")).distinct()


def prefer_current(raw: DataFrame, reviewed: DataFrame, current: DataFrame, by: str = "audio_id") -> DataFrame:
    """The reviewed text where its manifest is current, else the raw one, and whether it fell back."""
    good = reviewed.join(current.select(by), by, "left_semi").select(by, F.col("text").alias("reviewed"))
    return raw.join(good, by, "left").select(by, F.coalesce("reviewed", "text").alias("text"), F.col("reviewed").isNull().alias("fallback"))


def route_fusion(replies: DataFrame, most: int = 100_000, by: str = "audio_id") -> DataFrame:
    """Where a recording goes after its fusion reply: oversize, stale, failed, script_mismatch or matched."""
    status = F.get_json_object("reply", "$.script_match")
    route = (
        F.when(F.length("payload") > most, "oversize").when(~F.col("current"), "stale").when(F.col("reply").isNull() | status.isNull(), "failed")
        .when(status == "mismatch", "script_mismatch").otherwise("matched")
    )
    return replies.select(by, route.alias("route"))
