"""Queries over batches, replies, scripts and their linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import batches as bt, scripts as sc, services as sv
from ..operators.graph import checkpoint
from .cue_queries import CUE, cue
from .fixtures import fx, table
from .registry import query

BATCH = """placed AS (SELECT audio_id, cue_index, row_number() OVER (PARTITION BY audio_id ORDER BY cue_index) - 1 AS pos, replace(text_ja, chr(10), ' ') AS text FROM fx_cue),
bat AS (SELECT audio_id, pos, text, CAST(floor(pos / 4) AS BIGINT) AS batch, pos % 4 AS place FROM placed),
rep AS (SELECT audio_id, batch, count(*) AS n, CASE WHEN (audio_id + batch) % 13 = 0 THEN NULL
  WHEN (audio_id + batch) % 11 = 0 THEN string_agg('[' || place + 1 || '] R' || pos, chr(10) ORDER BY place)
  WHEN (audio_id + batch) % 7 = 0 THEN string_agg('R' || pos, '---SPLIT---' ORDER BY place) || '---SPLIT---x' ELSE string_agg('R' || pos, '---SPLIT---' ORDER BY place) END AS reply FROM bat GROUP BY audio_id, batch),
tiers AS (SELECT audio_id, batch, CASE WHEN reply IS NULL THEN 0 WHEN (audio_id + batch) % 11 = 0 THEN CASE WHEN n = 1 THEN 1 ELSE 2 END WHEN (audio_id + batch) % 7 = 0 THEN -1 ELSE 1 END AS tier, n FROM rep)"""


def batched(s, d) -> DataFrame:
    c = cue(s, d).select("audio_id", "cue_index", F.replace("text_ja", F.lit("\n"), F.lit(" ")).alias("text"))
    return bt.batch_rows(c, 4)


def replies(s, d) -> DataFrame:
    b, k = batched(s, d), F.col("audio_id") + F.col("batch")
    parts = b.groupBy("audio_id", "batch").agg(F.array_sort(F.collect_list(F.struct("place", "pos"))).alias("p"))
    plain = F.array_join(F.transform("p", lambda x: F.concat(F.lit("R"), x["pos"].cast("string"))), bt.SEPARATOR)
    listed = F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), (x["place"] + 1).cast("string"), F.lit("] R"), x["pos"].cast("string"))), "\n")
    reply = F.when(k % 13 == 0, F.lit(None)).when(k % 11 == 0, listed).when(k % 7 == 0, F.concat(plain, F.lit(bt.SEPARATOR + "x"))).otherwise(plain)
    return parts.select("audio_id", "batch", reply.alias("reply"))


def retries(s, d) -> DataFrame:
    return batched(s, d).select("audio_id", "batch", "place", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("again "), F.col("pos").cast("string"))).alias("retry"))


@query("i8_fixed_batches", """p AS (SELECT audio_id, cue_index, row_number() OVER (PARTITION BY audio_id ORDER BY cue_index) - 1 AS pos FROM fx_cue)
SELECT audio_id, cue_index, b.batch, pos - b.batch * 3 AS place FROM p JOIN range(0, 1000) b(batch) ON pos >= b.batch * 3 AND pos < b.batch * 3 + 5""", CUE)
def _(s, d):
    return bt.batch_rows(cue(s, d), 5, 2).select("audio_id", "cue_index", "batch", "place")


@query("l13_reconcile", BATCH + """ SELECT b.audio_id, b.batch, b.place, CASE WHEN t.tier = -1 THEN 3 ELSE t.tier END AS tier,
CASE WHEN t.tier = 1 AND (b.audio_id + b.batch) % 11 = 0 THEN '[1] R' || pos WHEN t.tier IN (1, 2) THEN 'R' || pos WHEN t.tier = -1 AND pos % 2 = 0 THEN 'again ' || pos ELSE text END AS text FROM bat b JOIN tiers t USING (audio_id, batch)""", CUE)
def _(s, d):
    return bt.reconcile(batched(s, d), replies(s, d), retries(s, d)).select("audio_id", "batch", "place", "tier", "text")


@query("l13_translate_first_pass", BATCH + """ SELECT b.audio_id, b.batch, b.place, CASE WHEN t.tier = 1 THEN CASE WHEN (b.audio_id + b.batch) % 11 = 0 THEN '[1] R' || pos ELSE 'R' || pos END ELSE '' END AS text FROM bat b JOIN tiers t USING (audio_id, batch)""", CUE)
def _(s, d):
    return bt.translate_first_pass(batched(s, d), replies(s, d)).select("audio_id", "batch", "place", "text")


@query("j18_recovered_lines", BATCH + """ SELECT audio_id, batch, array_to_string(['R' || (batch * 4 + i - 1) for i in range(1, CAST(n AS BIGINT) + 1)], '|') AS lines FROM rep WHERE reply IS NOT NULL AND (audio_id + batch) % 11 = 0""", CUE)
def _(s, d):
    n = batched(s, d).groupBy("audio_id", "batch").agg(F.count(F.lit(1)).alias("n"))
    rows = replies(s, d).join(n, ["audio_id", "batch"]).withColumn("lines", bt.recovered_lines(F.col("reply"), F.col("n")))
    return rows.filter("lines IS NOT NULL").select("audio_id", "batch", F.array_join("lines", "|").alias("lines"))


OVER = """p AS (SELECT audio_id, row_number() OVER (PARTITION BY audio_id ORDER BY cue_index) - 1 AS pos FROM fx_cue),
o AS (SELECT audio_id, pos, b.batch FROM p JOIN range(0, 1000) b(batch) ON pos >= b.batch * 3 AND pos < b.batch * 3 + 5 WHERE (pos + b.batch) % 4 <> 0)"""


def merged(s, d, policy):
    b = bt.batch_rows(cue(s, d), 5, 2)
    res = b.filter("(pos + batch) % 4 <> 0").select("audio_id", "pos", "batch", F.concat(F.lit("B"), F.col("batch").cast("string")).alias("text"))
    src = bt.batch_rows(cue(s, d), 1).select("audio_id", "pos", F.lit("src").alias("text"))
    return bt.merge_batches(res, src, policy)


@query("l14_merge_first", OVER + " SELECT p.audio_id, p.pos, coalesce('B' || min(o.batch), 'src') AS text FROM p LEFT JOIN o ON o.audio_id = p.audio_id AND o.pos = p.pos GROUP BY p.audio_id, p.pos", CUE)
def _(s, d):
    return merged(s, d, "first")


@query("l14_merge_last", OVER + " SELECT p.audio_id, p.pos, coalesce('B' || max(o.batch), 'src') AS text FROM p LEFT JOIN o ON o.audio_id = p.audio_id AND o.pos = p.pos GROUP BY p.audio_id, p.pos", CUE)
def _(s, d):
    return merged(s, d, "last")


def correction_replies(s, d) -> DataFrame:
    c = cue(s, d).filter("cue_index % 4 = 0 OR audio_id % 9 = 0")
    one = F.struct(F.col("cue_index").alias("index"), F.lit("why").alias("issue"), F.concat(F.lit("FIX "), F.col("cue_index").cast("string")).alias("fix"))
    rows = c.groupBy("audio_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    plain = F.array_join(F.transform("c", lambda x: F.concat(F.lit("索引："), x["index"].cast("string"), F.lit("\n问题：why\n修正："), x["fix"])), "\n---\n")
    return rows.select("audio_id", F.when(F.col("audio_id") % 2 == 0, F.to_json(F.struct(F.col("c").alias("corrections")))).otherwise(plain).alias("reply"))


@query("j17_parse_corrections", "SELECT audio_id, cue_index, 'why' AS issue, 'FIX ' || cue_index AS fix FROM fx_cue WHERE cue_index % 4 = 0 OR audio_id % 9 = 0", CUE)
def _(s, d):
    return bt.parse_corrections(correction_replies(s, d))


@query("d19_apply_corrections", "SELECT audio_id, cue_index, CASE WHEN cue_index % 4 = 0 OR audio_id % 9 = 0 THEN 'FIX ' || cue_index ELSE text_zh END AS text_zh FROM fx_cue", CUE)
def _(s, d):
    return bt.apply_corrections(cue(s, d), bt.parse_corrections(correction_replies(s, d))).select("audio_id", "cue_index", "text_zh")


@query("d19_bad_corrections", """SELECT audio_id, cue_index + 1000 AS cue_index, 'unknown_index' AS rule FROM fx_cue WHERE cue_index % 4 = 0
UNION ALL SELECT audio_id, cue_index, 'duplicate_index' FROM fx_cue CROSS JOIN range(2) WHERE cue_index % 5 = 0 UNION ALL SELECT audio_id, cue_index, 'unsafe_fix' FROM fx_cue WHERE cue_index % 7 = 0 AND cue_index % 5 <> 0""", CUE)
def _(s, d):
    c = cue(s, d).select("audio_id", "cue_index", F.lit("ok").alias("fix"))
    extra = c.filter("cue_index % 4 = 0").withColumn("cue_index", F.col("cue_index") + 1000)
    twice = c.filter("cue_index % 5 = 0")
    unsafe = c.filter("cue_index % 7 = 0 AND cue_index % 5 <> 0").withColumn("fix", F.lit("a --> b"))
    return bt.bad_corrections(cue(s, d), extra.unionByName(twice).unionByName(twice).unionByName(unsafe))


@query("l15_final_pass", "SELECT audio_id, cue_index, CASE WHEN cue_index % 4 = 0 OR audio_id % 9 = 0 THEN 'FIX ' || cue_index ELSE text_zh END AS text_zh FROM fx_cue", CUE)
def _(s, d):
    return bt.final_pass(cue(s, d), correction_replies(s, d))[0].select("audio_id", "cue_index", "text_zh")


@query("c8_selective_set", "SELECT audio_id, cue_index FROM fx_cue WHERE audio_id % 5 = 0", CUE)
def _(s, d):
    c = cue(s, d)
    return bt.select_mismatched(c, c.filter("audio_id % 5 = 0")).select("audio_id", "cue_index")


@query("h3_merge_mismatches", "SELECT DISTINCT audio_id FROM fx_cue WHERE audio_id % 2 = 0 AND ((audio_id % 3 = 0 AND audio_id % 5 <> 0) OR audio_id % 7 = 0)", CUE)
def _(s, d):
    c = cue(s, d)
    return bt.merge_mismatches(c.filter("audio_id % 3 = 0"), c.filter("audio_id % 2 = 0"), c.filter("audio_id % 5 = 0"), c.filter("audio_id % 7 = 0"))


@query("d13_preferred_input", "SELECT audio_id, CASE WHEN audio_id % 2 = 0 AND audio_id % 3 = 0 THEN 'reviewed' ELSE 'raw' END AS text, NOT (audio_id % 2 = 0 AND audio_id % 3 = 0) AS fallback FROM (SELECT DISTINCT audio_id FROM fx_cue)", CUE)
def _(s, d):
    ids = cue(s, d).select("audio_id").distinct()
    return bt.prefer_current(ids.withColumn("text", F.lit("raw")), ids.filter("audio_id % 2 = 0").withColumn("text", F.lit("reviewed")), ids.filter("audio_id % 3 = 0"))


@query("l18_fusion_routing", "SELECT audio_id, CASE WHEN audio_id % 7 = 0 THEN 'oversize' WHEN audio_id % 5 = 0 THEN 'stale' WHEN audio_id % 3 = 0 THEN 'failed' WHEN audio_id % 2 = 0 THEN 'script_mismatch' ELSE 'matched' END AS route FROM (SELECT DISTINCT audio_id FROM fx_cue)", CUE)
def _(s, d):
    ids, a = cue(s, d).select("audio_id").distinct(), F.col("audio_id")
    reply = F.when(a % 3 == 0, F.when(a % 2 == 0, F.lit("no json"))).otherwise(F.concat(F.lit('{"script_match": "'), F.when(a % 2 == 0, F.lit("mismatch")).otherwise(F.lit("ok")), F.lit('"}')))
    return bt.route_fusion(ids.withColumns({"payload": F.when(a % 7 == 0, F.repeat(F.lit("x"), 40)).otherwise(F.lit("x")), "current": a % 5 != 0, "reply": reply}), most=30)


# ---- scripts ----
LINES = """l0 AS (SELECT doc_id AS script_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
l1 AS (SELECT script_id, pos, CASE WHEN pos < n - 1 THEN line || chr(10) ELSE line END AS line FROM l0 WHERE pos < n - 1 OR line <> ''),
lines AS (SELECT *, sum(length(line)) OVER (PARTITION BY script_id ORDER BY pos) AS e FROM l1),
ranges AS (SELECT script_id, CAST(floor(pos / 3) AS BIGINT) AS block, min(pos) AS a, max(pos) AS b FROM lines GROUP BY 1, 2)"""


def scripts(s, d) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("script_id"), "text")


def lines(s, d) -> DataFrame:
    return sc.line_catalog(scripts(s, d))


def ranges(s, d) -> DataFrame:
    block = F.floor(F.col("pos") / 3)
    r = lines(s, d).groupBy("script_id", block.alias("block")).agg(F.min("pos").alias("first_line"), F.max("pos").alias("last_line"))
    kinds = F.array(*map(F.lit, ("dialogue", "action", "psychology", "separator", "unknown")))
    return r.withColumns({"kind": F.element_at(kinds, (F.col("block") % 5 + 1).cast("int")), "confidence": F.col("block") % 10 / 10})


@query("a12_line_catalog", LINES + " SELECT script_id, printf('L%06d', pos + 1) AS line_id, CAST(e - length(line) AS BIGINT) AS start_offset, CAST(e AS BIGINT) AS end_offset, sha256(line) AS line_sha FROM lines")
def _(s, d):
    return lines(s, d).select("script_id", "line_id", "start_offset", "end_offset", "line_sha")


UNITS = LINES + """, us AS (SELECT script_id, block % 5 AS k, unnest(CASE WHEN block % 5 = 0 THEN range(a, b + 1) ELSE [a] END) AS us, b FROM ranges),
units AS (SELECT script_id, us AS unit_start, CASE WHEN k = 0 THEN us ELSE b END AS unit_end FROM us)"""


@query("d15_units_from_ranges", UNITS + """ SELECT u.script_id, printf('SU%06d', row_number() OVER (PARTITION BY u.script_id ORDER BY unit_start)) AS unit_id, CAST(x.e - length(x.line) AS BIGINT) AS start_offset, CAST(y.e AS BIGINT) AS end_offset
FROM units u JOIN lines x ON x.script_id = u.script_id AND x.pos = unit_start JOIN lines y ON y.script_id = u.script_id AND y.pos = unit_end""")
def _(s, d):
    return sc.units_from_ranges(ranges(s, d), lines(s, d)).select("script_id", "unit_id", "start_offset", "end_offset")


@query("i5_dialogue_explosion", UNITS + " SELECT script_id, count(*) AS n_units FROM units GROUP BY script_id")
def _(s, d):
    return sc.units_from_ranges(ranges(s, d), lines(s, d)).groupBy("script_id").agg(F.count(F.lit(1)).alias("n_units"))


@query("k4_unit_contract", LINES + """ SELECT script_id, 'gap' AS rule, sum(b - a + 1)::BIGINT AS n FROM ranges WHERE block = 1 GROUP BY script_id UNION ALL SELECT script_id, 'confidence_out_of_range', count(*) FROM ranges WHERE block = 0 GROUP BY script_id""")
def _(s, d):
    r = ranges(s, d).filter("block <> 1").withColumn("confidence", F.when(F.col("block") == 0, 1.5).otherwise(F.col("confidence")))
    return sc.check_units(r, lines(s, d))


@query("i6_pack_lines", LINES + """, num AS (SELECT script_id, pos, length(line) AS c, row_number() OVER (PARTITION BY script_id ORDER BY pos) AS r FROM lines),
f(script_id, r, pos, batch, n, total) AS (
  SELECT script_id, r, pos, 0, 1, c FROM num WHERE r = 1
  UNION ALL SELECT num.script_id, num.r, num.pos, CASE WHEN f.n >= 5 OR f.total >= 900 OR f.total + num.c > 900 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN f.n >= 5 OR f.total >= 900 OR f.total + num.c > 900 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 5 OR f.total >= 900 OR f.total + num.c > 900 THEN num.c ELSE f.total + num.c END
  FROM f JOIN num ON num.script_id = f.script_id AND num.r = f.r + 1)
SELECT script_id, pos, batch FROM f""")
def _(s, d):
    return bt.pack_lines(lines(s, d).select("script_id", "pos", F.length("line").alias("n_chars")), 5, 900).select("script_id", "pos", "batch")


@query("i10_rebase_batches", LINES + """, st AS (SELECT script_id, block, min(a) AS start, block % 4 = 3 AS oversized FROM ranges GROUP BY script_id, block)
SELECT script_id, start AS first_line, CASE WHEN oversized THEN start ELSE start + 1 END AS last_line, CASE WHEN oversized THEN 'unknown' ELSE 'dialogue' END AS kind FROM st""")
def _(s, d):
    st = ranges(s, d).select("script_id", F.col("block").alias("batch"), F.col("first_line").alias("start"), (F.col("block") % 4 == 3).alias("oversized"))
    local = st.select("script_id", "batch", F.lit(0).alias("first_line"), F.lit(1).alias("last_line"), F.lit("dialogue").alias("kind"), F.lit(0.9).alias("confidence"))
    return bt.rebase_batches(local, st).drop("confidence")


AS = ("fx_asset", "fx_script")
TRACK = "upper(regexp_extract({0}, '^(?i:track)?\\s*0*([0-9]+[A-Za-z]?)', 1))"
WAYS = f"""same AS (SELECT a.asset_key, s.script_base FROM fx_asset a JOIN fx_script s ON s.script_base = a.audio_base),
trk AS (SELECT a.asset_key, min(s.script_base) AS script_base FROM fx_asset a JOIN fx_script s ON {TRACK.format('s.script_base')} = {TRACK.format('a.audio_base')} AND {TRACK.format('a.audio_base')} <> '' GROUP BY a.asset_key),
kwd AS (SELECT a.asset_key, min(s.script_base) AS script_base FROM (SELECT asset_key, trim(regexp_replace(audio_base, '^track\\s*[0-9]+[\\s._-]*', '')) AS kw FROM fx_asset) a JOIN fx_script s ON contains(s.content, a.kw) GROUP BY a.asset_key),
mapped AS (SELECT a.asset_key, coalesce(same.script_base, trk.script_base, kwd.script_base) AS script_base, CASE WHEN same.script_base IS NOT NULL THEN 'same_name' WHEN trk.script_base IS NOT NULL THEN 'track_id' WHEN kwd.script_base IS NOT NULL THEN 'keyword' ELSE 'none' END AS match_source
  FROM fx_asset a LEFT JOIN same USING (asset_key) LEFT JOIN trk USING (asset_key) LEFT JOIN kwd USING (asset_key))"""


def assets(s, d):
    return fx(s, d, "fx_asset"), fx(s, d, "fx_script")


@query("d9_same_name", WAYS + " SELECT * FROM same", AS)
def _(s, d):
    return sc.match_same_name(*assets(s, d))


@query("d10_track_id", WAYS + " SELECT * FROM trk", AS)
def _(s, d):
    return sc.match_track_id(*assets(s, d))


@query("d11_keyword", WAYS + " SELECT * FROM kwd", AS)
def _(s, d):
    return sc.match_keyword(*assets(s, d))


@query("d12_mapping_chain", WAYS + " SELECT * FROM mapped", AS)
def _(s, d):
    return sc.build_mapping(*assets(s, d), fallback_full=False).drop("audio_base")


@query("l10_script_mapping", WAYS + " SELECT asset_key, script_base, match_source, count(*) OVER (PARTITION BY script_base) >= 2 AS pending_split FROM mapped WHERE match_source IN ('track_id', 'keyword')", AS)
def _(s, d):
    return sc.detect_merged(sc.build_mapping(*assets(s, d), fallback_full=False)).drop("audio_base")


@query("e10_merged_scripts", WAYS + " SELECT script_base, count(*) AS n FROM mapped WHERE match_source IN ('track_id', 'keyword') GROUP BY script_base HAVING count(*) >= 2", AS)
def _(s, d):
    return sc.detect_merged(sc.build_mapping(*assets(s, d), fallback_full=False)).filter("pending_split").groupBy("script_base").agg(F.count(F.lit(1)).alias("n"))


@query("a2_duplicate_keys", "SELECT p_name, min(k) OVER (PARTITION BY p_name) AS first_name, k AS later_name FROM (SELECT p_name, printf('%09d', p_partkey) AS k FROM part) QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY k) > 1")
def _(s, d):
    p = table(s, d, "part").select("p_name", F.format_string("%09d", "p_partkey").alias("k"))
    return sc.duplicate_keys(p, "p_name", "k")


@query("k8_mapping_verification", WAYS + """ SELECT asset_key, CASE WHEN asset_key % 10 = 0 THEN 'unmapped_audio' WHEN asset_key % 7 = 0 THEN 'unknown_audio' ELSE 'script_changed' END AS rule FROM mapped
WHERE asset_key % 10 = 0 AND asset_key % 7 <> 0 OR (asset_key % 10 <> 0 AND (asset_key % 7 = 0 OR (asset_key % 9 = 0 AND script_base IS NOT NULL)))""", AS)
def _(s, d):
    a, scr = assets(s, d)
    sha = scr.select("script_base", F.sha2("content", 256).alias("sha"))
    m = sc.build_mapping(a, scr, fallback_full=False).join(sha, "script_base", "left").filter("asset_key % 10 <> 0")
    m = m.select("asset_key", "script_base", F.when(F.col("asset_key") % 9 == 0, F.lit("old")).otherwise(F.col("sha")).alias("script_sha"))
    return sc.verify_mapping(m, a.filter("asset_key % 7 <> 0"), sha)


SEG = """m AS (SELECT p_size AS script_id, string_agg('Track ' || p_partkey || chr(10) || p_name || chr(10), '' ORDER BY p_partkey) AS text, count(*) AS n FROM part GROUP BY p_size)
"""


def merged_scripts(s, d):
    one = F.concat(F.lit("Track "), F.col("p_partkey").cast("string"), F.lit("\n"), "p_name", F.lit("\n"))
    return table(s, d, "part").groupBy(F.col("p_size").alias("script_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("t")))), lambda x: x["t"]), "").alias("text"))


@query("f13_title_segments", "SELECT p_size AS script_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS seg, 'Track ' || p_partkey AS title, 'Track ' || p_partkey || chr(10) || p_name || CASE WHEN lead(p_partkey) OVER (PARTITION BY p_size ORDER BY p_partkey) IS NULL THEN chr(10) ELSE chr(10) END AS segment FROM part QUALIFY count(*) OVER (PARTITION BY p_size) >= 2")
def _(s, d):
    return sc.split_scripts(merged_scripts(s, d))


@query("f13_pair_segments", "SELECT p_size AS script_id, p_name AS audio_base, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS seg FROM part QUALIFY count(*) OVER (PARTITION BY p_size) >= 2")
def _(s, d):
    from pyspark.sql import Window

    names = table(s, d, "part").select(F.col("p_size").alias("script_id"), F.col("p_name").alias("audio_base"), (F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1).alias("ord"))
    return sc.pair_segments(sc.split_scripts(merged_scripts(s, d)), names).select("script_id", "audio_base", "seg")


SIDES = """u AS (SELECT conv_id AS audio_id, turn AS pos, lower(text) AS norm FROM conversations),
i AS (SELECT audio_id, CASE WHEN audio_id % 4 = 0 THEN 100 - pos ELSE pos END AS pos, norm FROM u WHERE pos % 3 <> 2),
uu AS (SELECT audio_id, norm, min(pos) AS unit_pos FROM u WHERE length(norm) >= 4 GROUP BY audio_id, norm HAVING count(*) = 1),
ii AS (SELECT audio_id, norm, min(pos) AS item_pos FROM i WHERE length(norm) >= 4 GROUP BY audio_id, norm HAVING count(*) = 1),
pr AS (SELECT *, item_pos > lag(item_pos) OVER (PARTITION BY audio_id ORDER BY unit_pos) AS up FROM uu JOIN ii USING (audio_id, norm))"""


def sides(s, d):
    """Turns as units and two of three as items, with their whole texts."""
    u = table(s, d, "conversations").select(F.col("conv_id").alias("audio_id"), F.col("turn").alias("pos"), F.lower("text").alias("norm"))
    return u, u.filter("pos % 3 <> 2").withColumn("pos", F.when(F.col("audio_id") % 4 == 0, 100 - F.col("pos")).otherwise(F.col("pos")))


@query("d16_unique_anchors", SIDES + " SELECT audio_id, norm, unit_pos, item_pos FROM pr QUALIFY bool_and(coalesce(up, TRUE)) OVER (PARTITION BY audio_id)")
def _(s, d):
    return sc.unique_anchors(*sides(s, d))


@query("e11_repeat_ambiguity", "u AS (SELECT conv_id AS audio_id, turn AS pos, lower(text) AS norm, turn % 2 = 0 AS matched FROM conversations) SELECT audio_id, pos, count(*) OVER w > 1 AND bool_or(NOT matched) OVER w AS ambiguous FROM u WINDOW w AS (PARTITION BY audio_id, norm)")
def _(s, d):
    u = table(s, d, "conversations").select(F.col("conv_id").alias("audio_id"), F.col("turn").alias("pos"), F.lower("text").alias("norm"), (F.col("turn") % 2 == 0).alias("matched"))
    return sc.flag_repeats(u).select("audio_id", "pos", "ambiguous")


def make_echo():
    """A stand-in for a service: marks lines; by a payload's length it fails once, answers in structure, or loses a line."""
    failed = set()

    def client(payload: str):
        parts, n = payload.split(bt.SEPARATOR), len(payload)
        if n % 5 == 0 and payload not in failed:
            failed.add(payload)
            raise TimeoutError("busy")
        lines = [f"R:{p}" for p in parts]
        if n % 7 == 0:
            return {"lines": lines}
        return bt.SEPARATOR.join(lines[:-1] if n % 3 == 0 and len(lines) > 1 else lines)

    return client


@query("n4_service_replies", """p AS (SELECT audio_id, cue_index, replace(text_ja, chr(10), ' ') AS text, row_number() OVER (PARTITION BY audio_id ORDER BY cue_index) - 1 AS pos FROM fx_cue),
b AS (SELECT audio_id, CAST(floor(pos / 4) AS BIGINT) AS batch, pos % 4 AS place, text FROM p),
z AS (SELECT audio_id, batch, sum(length(text)) + 11 * (count(*) - 1) AS n, count(*) AS k FROM b GROUP BY audio_id, batch)
SELECT audio_id, batch, place, CASE WHEN n % 7 <> 0 AND n % 3 = 0 AND k > 1 THEN 3 ELSE 1 END AS tier, trim('R:' || text) AS text FROM b JOIN z USING (audio_id, batch)""", CUE)
def _(s, d):
    """Batches asked as a whole; those with a wrong number of lines again line by line."""
    b = batched(s, d)
    first = checkpoint(sv.ask(sv.batch_payloads(b), make_echo))
    wrong = bt.reconcile(b, first, b.filter("false").select("audio_id", "batch", "place", F.lit("").alias("retry"))).filter("tier = 3").select("audio_id", "batch").distinct()
    return bt.reconcile(b, first, sv.ask_lines(b, wrong, make_echo, tries=3)).select("audio_id", "batch", "place", "tier", "text")
