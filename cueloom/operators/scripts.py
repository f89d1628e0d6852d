"""Scripts without times: line catalogues, units, and their linkage to recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import keyword, track_id
from .graph import checkpoint

#: Every line end that splits a script.
LINE_ENDS = r"(?<=\r\n)|(?<=\r)(?!\n)|(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85  ])"
#: Titles that begin a segment of a merged script.
TITLES = r"(?m)(Track\s*\d+|第\s*\d+\s*[話章]|^【[^】]+】|^\d+[\.、]\s|^■\s*.+?$)"
#: Characters of a keyword by which scripts are looked up.
GRAM = 8


def line_catalog(scripts: DataFrame, by: str = "script_id", text: str = "text") -> DataFrame:
    """Lines with their ends: number, position, offsets and sha256; offsets cover the script."""
    lines = scripts.select(by, F.posexplode(F.filter(F.split(text, LINE_ENDS, -1), lambda x: x != "")).alias("pos", "line"))
    end = F.sum(F.length("line")).over(Window.partitionBy(by).orderBy("pos"))
    return lines.select(
        by, F.format_string("L%06d", F.col("pos") + 1).alias("line_id"), "pos", (end - F.length("line")).alias("start_offset"), end.alias("end_offset"), F.sha2("line", 256).alias("line_sha"), "line"
    )


def units_from_ranges(ranges: DataFrame, lines: DataFrame, by: str = "script_id") -> DataFrame:
    """Units of ranges (first_line, last_line, kind, confidence); dialogue gives one unit per line."""
    per_line = F.when(F.col("kind") == "dialogue", F.sequence("first_line", "last_line")).otherwise(F.array("first_line"))
    rows = ranges.withColumn("unit_start", F.explode(per_line)).withColumn("unit_end", F.when(F.col("kind") == "dialogue", F.col("unit_start")).otherwise(F.col("last_line")))
    # each unit names its positions, so the lines join by (script, position) and not by a range
    named = rows.withColumn("pos", F.explode(F.sequence("unit_start", "unit_end")))
    joined = named.join(lines.select(by, "pos", "start_offset", "end_offset"), [by, "pos"])
    units = joined.groupBy(by, "unit_start", "unit_end", "kind", "confidence").agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.count(F.lit(1)).alias("n_lines"))
    number = F.row_number().over(Window.partitionBy(by).orderBy("unit_start"))
    return units.withColumn("unit_id", F.format_string("SU%06d", number))


def check_units(ranges: DataFrame, lines: DataFrame, by: str = "script_id") -> DataFrame:
    """Ranges that overlap, are reversed or leave lines uncovered, and confidences out of bounds (K4)."""
    bad = ranges.select(by, F.explode(F.array_compact(F.array(
        F.when(F.col("last_line") < F.col("first_line"), F.lit("reversed")), F.when(~F.col("confidence").between(0, 1), F.lit("confidence_out_of_range"))
    ))).alias("rule"))
    covered = ranges.filter("last_line >= first_line").select(by, F.explode(F.sequence("first_line", "last_line")).alias("pos")).groupBy(by, "pos").count()
    twice = covered.filter("count > 1").select(by, F.lit("overlap").alias("rule"))
    missing = lines.select(by, "pos").join(covered, [by, "pos"], "left_anti").select(by, F.lit("gap").alias("rule"))
    unknown = covered.join(lines.select(by, "pos"), [by, "pos"], "left_anti").select(by, F.lit("unknown_line").alias("rule"))
    return bad.unionByName(twice).unionByName(missing).unionByName(unknown).groupBy(by, "rule").agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """Pairs (first seen, later) of names whose key collides (A2)."""
    order = Window.partitionBy(key).orderBy(name)
    rows = df.select(key, F.first(name).over(order).alias("first_name"), F.col(name).alias("later_name"), F.row_number().over(order).alias("_n"))
    return rows.filter("_n > 1").drop("_n")


def match_same_name(audio: DataFrame, scripts: DataFrame) -> DataFrame:
    """audio_base and the script of the same name."""
    return audio.join(scripts, audio["audio_base"] == scripts["script_base"]).select("asset_key", "script_base")


def match_track_id(audio: DataFrame, scripts: DataFrame) -> DataFrame:
    """The first script in name order with the recording's leading track id."""
    a = audio.withColumn("track", track_id(F.col("audio_base"))).filter("track IS NOT NULL")
    s = scripts.withColumn("track", track_id(F.col("script_base"))).filter("track IS NOT NULL").groupBy("track").agg(F.min("script_base").alias("script_base"))
    return a.join(s, "track").select("asset_key", "script_base")


#: So many beginnings of titles, or fewer, are broadcast to the contents; more of them meet the contents' grams by a shuffle.
FEW_GRAMS = 100_000


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def grams(text: Column, chars: Column, lengths: list[int]) -> Column:
    """Distinct substrings of the lengths given; chars are the text's characters. Length 0 gives the empty string."""
    of = lambda n: F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.array(F.lit("")) if n == 0 else F.when(F.length(text) >= n, of(n)).otherwise(none) for n in lengths]))


def match_keyword(audio: DataFrame, scripts: DataFrame) -> DataFrame:
    """The first script in name order whose content holds the recording's title words.

    Whoever holds the keyword holds its inner words as whole words, so it is looked up by the longest
    of them. A keyword without one is looked up by its first GRAM characters: up to that length the
    look-up is the answer, and each text's first script is known before the join. Other candidates
    get the content once per pair. All joins are equi joins, and go by different keywords and
    different contents: recordings that share a keyword, and scripts that share a content, never
    meet one by one.
    """
    a = audio.select("asset_key", keyword(F.col("audio_base")).alias("kw")).filter("kw IS NOT NULL")
    parts = F.split(F.lower("kw"), r"[^\p{L}\p{N}]+")
    inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != "")
    longest = F.when(F.size(inner) > 0, F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    keyed = checkpoint(a.select("kw").distinct().withColumn("word", longest))
    # contents of one hash are told apart by looking into each of them
    s = scripts.filter("content IS NOT NULL AND script_base IS NOT NULL").groupBy("content").agg(F.min("script_base").alias("script_base"))
    s = checkpoint(s.withColumn("_c", F.xxhash64("content")))
    by_word = keyed.filter("word IS NOT NULL").join(s.select("_c", F.explode(words(F.col("content"))).alias("word")), "word").select("kw", "_c")

    plain = keyed.filter("word IS NULL").select("kw", F.left("kw", F.lit(GRAM)).alias("gram"))
    lengths = sorted(r[0] for r in plain.select(F.length("gram")).distinct().collect())  # GRAM + 1 values at most
    if not lengths:
        found = by_word
        short = None
    else:
        wanted = plain.select("gram").distinct()
        held = s.withColumn("chars", F.split("content", "", -1)).select("_c", "script_base", F.explode(grams(F.col("content"), F.col("chars"), lengths)).alias("gram"))
        if wanted.count() <= FEW_GRAMS:  # the others' grams never leave their task
            held = held.join(F.broadcast(wanted), "gram", "left_semi")
        short = plain.filter(F.col("kw") == F.col("gram")).join(held.groupBy("gram").agg(F.min("script_base").alias("script_base")), "gram").select("kw", "script_base")
        found = by_word.unionByName(plain.filter(F.col("kw") != F.col("gram")).join(held, "gram").select("kw", "_c"))
    both = found.join(s, "_c").filter(F.col("content").contains(F.col("kw"))).select("kw", "script_base")
    first = (both if short is None else both.unionByName(short)).groupBy("kw").agg(F.min("script_base").alias("script_base"))
    # a row per recording, so that a repeated asset_key has one script
    return a.join(first, "kw").groupBy("asset_key").agg(F.min("script_base").alias("script_base"))


def build_mapping(audio: DataFrame, scripts: DataFrame, external: DataFrame | None = None, *, fallback_full: bool = True) -> DataFrame:
    """Script of every recording by the first way that gives one.

    Same name, track id, keyword, an outside decision (asset_key, script_base), then - when no
    script but one is left unused - that script for the rest, else none.
    """
    ways = [("same_name", match_same_name(audio, scripts)), ("track_id", match_track_id(audio, scripts)), ("keyword", match_keyword(audio, scripts))]
    if external is not None:
        ways.append(("external", external.select("asset_key", "script_base")))
    out = audio.select("asset_key", "audio_base")
    for name, found in ways:
        out = out.join(found.withColumnRenamed("script_base", name), "asset_key", "left")
    source = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n, _ in ways])
    out = out.select("asset_key", "audio_base", F.coalesce(*[n for n, _ in ways]).alias("script_base"), source.alias("match_source"))
    if fallback_full:
        unused = scripts.select("script_base").distinct().join(out.select("script_base").filter("script_base IS NOT NULL"), "script_base", "left_anti")
        only = unused.agg(F.min("script_base").alias("only"), F.count(F.lit(1)).alias("n")).first()  # one row
        if only["n"] == 1:
            out = out.withColumns({"match_source": F.coalesce("match_source", F.lit("full_script")), "script_base": F.coalesce("script_base", F.lit(only["only"]))})
    return out.withColumn("match_source", F.coalesce("match_source", F.lit("none")))


def detect_merged(mapping: DataFrame) -> DataFrame:
    """Scripts that several recordings reach otherwise than by name: pending a split."""
    other = mapping.filter("match_source NOT IN ('same_name', 'none')")
    n = F.count(F.lit(1)).over(Window.partitionBy("script_base"))
    return other.withColumn("pending_split", n >= 2)


def split_scripts(merged: DataFrame, by: str = "script_id", text: str = "text") -> DataFrame:
    """Segments of merged scripts from a title to the next; fewer than two titles give none."""
    found, between = F.regexp_extract_all(text, F.lit(TITLES), F.lit(0)), F.split(text, TITLES, -1)
    rows = merged.select(by, found.alias("titles"), between.alias("between")).filter(F.size("titles") >= 2)
    zipped = F.arrays_zip(F.col("titles").alias("title"), F.slice("between", F.lit(2), F.size("titles")).alias("body"))
    return rows.select(by, F.posexplode(zipped).alias("seg", "s")).select(by, "seg", F.trim("s.title").alias("title"), F.trim(F.concat("s.title", "s.body")).alias("segment"))


def pair_segments(segments: DataFrame, names: DataFrame, by: str = "script_id") -> DataFrame:
    """Names (by, ord, audio_base) with their segment: in order when the counts agree, else by keyword, all or none."""
    counted = lambda df: df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    s, a = counted(segments), counted(names)
    in_order = a.join(s, [by, "n"]).filter(F.col("ord") == F.col("seg")).select(by, "audio_base", "seg", "segment")
    unequal = a.withColumnRenamed("n", "n_names").join(s.withColumnRenamed("n", "n_segments"), by).filter("n_names <> n_segments")
    kw = keyword(F.col("audio_base"))
    hit = unequal.filter(F.col("title").contains(kw) | F.left("segment", F.lit(200)).contains(kw))
    best = hit.groupBy(by, "audio_base", "n_names").agg(F.min_by(F.struct("seg", "segment"), "seg").alias("b"))
    whole = best.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(by))).filter("k = n_names")
    return in_order.unionByName(whole.select(by, "audio_base", F.col("b.seg").alias("seg"), F.col("b.segment").alias("segment")))


def verify_mapping(mapping: DataFrame, audio: DataFrame, scripts: DataFrame) -> DataFrame:
    """Why a mapping no longer holds: other recordings, or a changed script (K8). Both sides carry sha."""
    a = mapping.select("asset_key", "script_base", "script_sha", F.lit(True).alias("m")).join(audio.select("asset_key", F.lit(True).alias("a")), "asset_key", "full_outer")
    now = scripts.select("script_base", F.col("sha").alias("now"))
    rows = a.join(now, "script_base", "left")
    rule = F.when(F.col("m").isNull(), "unmapped_audio").when(F.col("a").isNull(), "unknown_audio").when(F.col("script_base").isNotNull() & ~F.col("now").eqNullSafe(F.col("script_sha")), "script_changed")
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL").select("asset_key", "rule")


def unique_anchors(units: DataFrame, items: DataFrame, least: int = 4, by: str = "audio_id") -> DataFrame:
    """Texts that stand once on either side, kept only where all pairs run in order."""
    once = lambda df, pos: df.filter(F.length("norm") >= least).groupBy(by, "norm").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias(pos)).filter("n = 1").drop("n")
    pairs = once(units, "unit_pos").join(once(items, "item_pos"), [by, "norm"])
    order = Window.partitionBy(by).orderBy("unit_pos")
    rising = F.coalesce(F.col("item_pos") > F.lag("item_pos").over(order), F.lit(True))
    return pairs.withColumn("_up", rising).withColumn("_all", F.min(F.col("_up").cast("int")).over(Window.partitionBy(by))).filter("_all = 1").drop("_up", "_all")


def flag_repeats(units: DataFrame, by: str = "audio_id") -> DataFrame:
    """Repeated texts of which one at least is unmatched: all their rows are ambiguous."""
    w = Window.partitionBy(by, "norm")
    return units.withColumn("ambiguous", (F.count(F.lit(1)).over(w) > 1) & (F.max((~F.col("matched")).cast("int")).over(w) == 1))
