"""Groups stay whole whatever plan leads to them, and equal keywords or contents never meet one by one."""

from pyspark.sql import functions as F

from cueloom.operators import batches as bt, long_cues as lc, script_alignment as sa, scripts as sc
from cueloom.operators.walk import walk_groups


def test_groups_stay_whole_after_a_join_by_their_key(spark):
    """The join turns into a broadcast while it runs, so that its rows stay where they lie."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
        few = spark.range(0, 4000, 1, 4).groupBy((F.col("id") % 50).alias("k")).count().filter("k < 40").select("k")
        got = walk_groups(rows.join(few, "k", "left_semi"), ["k"], ["v"], ["v"], lambda key, held: [(*key, len(held), held[0][0])], "k long, n long, first long")
        assert sorted(map(tuple, got.collect())) == [(k, 80, k) for k in range(40)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _most_rows(node) -> int:
    """Rows that any operator of the executed plan made at most."""
    plan, most = [node], 0
    while plan:
        p = plan.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            plan.append(p.plan())
            continue
        held = p.metrics().get("numOutputRows")
        most = max(most, held.get().value() if held.isDefined() else 0)
        kids = p.children()
        plan += [kids.apply(i) for i in range(kids.size())]
    return most


def test_equal_keywords_and_contents_meet_once(spark):
    n = 600
    audio = spark.range(n).select("id", F.col("id").alias("asset_key"), F.concat(F.lit("track"), F.col("id").cast("string"), F.lit("_lavender misty")).alias("audio_base"))
    scripts = spark.range(n).select(F.format_string("s%05d", "id").alias("script_base"), F.lit("a lavender misty field").alias("content"))
    found = sc.match_keyword(audio, scripts)
    assert {(r["asset_key"], r["script_base"]) for r in found.collect()} == {(k, "s00000") for k in range(n)}
    assert _most_rows(found._jdf.queryExecution().executedPlan()) <= 4 * n


def test_lines_are_packed_without_a_frame_per_script(spark):
    lines = spark.range(0, 900, 1, 6).select((F.col("id") % 7).alias("script_id"), F.col("id").alias("pos"), (F.col("id") * 37 % 311).cast("int").alias("n_chars"))
    got = bt.pack_lines(lines, 5, 300)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    want = []
    for script in range(7):
        batch, n, total = -1, 5, 0
        for pos in range(script, 900, 7):
            size = pos * 37 % 311
            if n == 5 or total >= 300 or total + size > 300:
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + size
            want.append((script, pos, batch, size > 300))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_long_cues_are_aligned_without_a_frame_per_cue(spark):
    cues = spark.range(40).select(F.lit(1).cast("long").alias("audio_id"), F.col("id").alias("cue_index"), F.lit(0).cast("long").alias("start_ms"), F.lit(20_000).cast("long").alias("end_ms"), F.lit("moon river").alias("text"))
    at = F.col("p").cast("long") * 1000
    words = cues.filter("cue_index < 30").select("audio_id", "cue_index", F.posexplode(F.array(F.lit("moon"), F.lit("river"))).alias("p", "text")).select("audio_id", "cue_index", "text", at.alias("start_ms"), (at + 500).alias("end_ms"), F.lit(0.9).alias("probability"))
    got = lc.align_long_cues(cues, words)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    assert sorted((r["cue_index"], r["status"], r["reason"], r["end_ms"]) for r in got.collect()) == [(k, "aligned", "whole_text", 1750) if k < 30 else (k, "unresolved", "no_words", None) for k in range(40)]


def test_regions_are_aligned_without_a_frame_per_region(spark):
    units = spark.range(30).select((F.col("id") % 3).alias("audio_id"), F.floor(F.col("id") / 3).alias("pos"), F.concat(F.lit("line number "), F.col("id").cast("string")).alias("norm"))
    got = sa.align_scripts(units, units.filter("pos <> 4"))
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().toString()
    assert sorted((r["audio_id"], r["first_unit"]) for r in got.filter("score = 1").collect()) == [(a, p) for a in range(3) for p in range(10) if p != 4]
