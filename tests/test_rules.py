"""Edge rows, each for one rule, and properties of whole results."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as tx, timecode as tc
from cueloom.operators import evidence as ev, intervals as iv, long_cues as lc, review as rv, script_alignment as sa, scripts as sc, timeline as tl
from cueloom.sources import evidence as sv, subtitles as st

CAND = "audio_id long, event_id long, model_role string, source_channel string, run_key string, start_ms long, end_ms long, text string, avg_logprob double, no_speech_prob double, legacy_srt boolean"


def cands(spark, rows):
    full = [(1, i, role, "main", f"main:{role}:raw", s, e, text, -0.5, 0.1, False) for i, (role, s, e, text) in enumerate(rows)]
    return spark.createDataFrame(full, CAND)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_block_without_index_line(spark):
    files = spark.createDataFrame([("a", "00:00:01,000 --> 00:00:02,000\nhello\nthere\n\n7\n00:00:03,000 --> 00:00:04,500\nx\n\nbad")], "audio_id string, body string")
    assert [(r["cue_index"], r["start_ms"], r["end_ms"], r["text"]) for r in st.parse_cues(files).orderBy("ord").collect()] == [(1, 1000, 2000, "hello there"), (7, 3000, 4500, "x")]


def test_render_and_parse_round_trip(spark):
    cues = spark.createDataFrame([("a", 5, 10, 3_723_004, "one"), ("a", 9, 3_723_004, 3_800_000, "two")], "audio_id string, cue_index long, start_ms long, end_ms long, text string")
    srt = st.render_srt(cues)
    assert srt.first()["srt"].startswith("1\n00:00:00,010 --> 01:02:03,004\none\n\n2\n")
    back = st.parse_cues(srt.withColumnRenamed("srt", "body")).orderBy("cue_index").collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in back] == [(10, 3_723_004, "one"), (3_723_004, 3_800_000, "two")]


def test_failfast_and_quarantine(spark, tmp_path):
    (tmp_path / "good.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n")
    (tmp_path / "bad.srt").write_text("1\n00:00:02,000 --> 00:00:02,000\nx\n")
    good, bad = st.read_cues(spark, str(tmp_path), "QUARANTINE")
    assert [r["audio_id"] for r in good.collect()] == ["good"] and bad.first()["reasons"] == ["no_duration"]
    with pytest.raises(Exception, match="no_duration"):
        st.read_cues(spark, str(tmp_path), "FAILFAST").collect()


def test_same_role_rows_never_link(spark):
    c = cands(spark, [("v3", 0, 1000, "a"), ("v3", 1100, 2000, "b")])
    assert ev.window_table(ev.align_candidates(c)).count() == 2


def test_candidate_ending_at_a_slice_start_is_no_member(spark):
    c = cands(spark, [("v3", 0, 15_000, "a"), ("turbo", 100, 20_000, "b")])
    rows = {(r["start_ms"], r["event_id"]) for r in ev.align_candidates(c).collect()}
    assert rows == {(0, 0), (0, 1), (15_000, 1)}


def test_empty_interval_is_one_window_but_no_item(spark):
    c = cands(spark, [("v3", 500, 500, "a")])
    assert ev.align_candidates(c).count() == 1
    assert tl.build_timeline(c, ev.classify(c)).count() == 0


def test_one_character_texts_do_not_support(spark):
    assert one(spark, tx.texts_support(F.lit("あ"), F.lit("あ。"))) is True  # equal texts are alike, though containment needs two characters
    assert one(spark, tx.texts_support(F.lit("a"), F.lit("ab"))) is True
    assert one(spark, tx.texts_support(F.lit("。"), F.lit("。"))) is False


def test_template_from_v3_only(spark):
    c = cands(spark, [("v3", 0, 900, "ご視聴ありがとうございました。"), ("turbo", 60_000, 61_000, "ご視聴ありがとうございました")])
    label = lambda **k: [r["label"] for r in ev.classify(c, **k).orderBy("event_id").collect()]
    assert label() == ["uncertain", "hallucination"]
    assert label(quarantine_shared=True) == ["hallucination", "hallucination"]


def test_target_as_long_as_the_window_is_one_tile(spark):
    df = spark.createDataFrame([(1, 0, 12_000), (2, 0, 12_001)], "audio_id long, start_ms long, end_ms long")
    got = {(r["audio_id"], r["start_ms"], r["end_ms"]) for r in iv.tile(df, 12_000, 2_000).collect()}
    assert got == {(1, 0, 12_000), (2, 0, 12_000), (2, 10_000, 12_001)}


def test_crossing_anchors_are_dropped(spark):
    side = lambda rows: spark.createDataFrame([(1, p, t) for p, t in rows], "audio_id long, pos long, norm string")
    u = side([(0, "first line"), (1, "second line")])
    assert sa.unique_anchors(u, side([(0, "second line"), (1, "first line")])).count() == 0
    assert sa.unique_anchors(u, side([(0, "first line"), (1, "second line")])).count() == 2


def test_alignment_groups_and_skips():
    steps, _ = sa.align_region(["good morning to you", "how are you today"], ["good morning", " to you", "noise xx", "how are you today"])
    assert [(i, a, j, b) for i, a, j, b, *_ in steps] == [(0, 1, 0, 2), (1, 1, 3, 1)]
    assert sa.align_region(["abc def"], [])[0] == []


def test_merge_next_on_the_last_cue(spark):
    items = spark.createDataFrame([(1, 1, 0, 1000, "a", "b")], "audio_id long, cue_index long, start_ms long, end_ms long, text_ja string, text_zh string")
    dec = spark.createDataFrame([(1, 1, "keep", "merge_next", None, None, None, None, None)], "audio_id long, cue_index long, action string, structure string, edited_ja string, edited_zh string, edited_start long, edited_end long, split_at long")
    assert [r["rule"] for r in rv.check_review(items, dec).collect()] == ["merge_last"]


def test_decoding():
    assert sv.decode_exact("日本語".encode("cp932")) == ("日本語", "cp932")
    assert sv.decode_exact("日本語\n".encode() + "テスト".encode("cp932"))[1] in {"mixed", "ambiguous", "euc-jp"}
    assert sv.decode_exact(b"plain")[0] == "plain"


def test_timecodes(spark):
    ms = lambda t, strict=False: one(spark, tc.tc_to_ms(F.lit(t), strict))
    assert ms("01:02:03,004") == 3_723_004 and ms("1:02:03,004") is None
    assert ms("00:61:00,000") == 3_660_000 and ms("00:61:00,000", True) is None
    assert one(spark, tc.seconds_to_tc(F.lit(-3.0))) == "00:00:00,000"
    assert one(spark, tc.seconds_to_tc(F.lit(0.0005))) == "00:00:00,000"  # half to even
    assert one(spark, tc.seconds_to_tc(F.lit(1.9999), "trunc")) == "00:00:01,999"


def test_best_word_span_is_the_true_best():
    from difflib import SequenceMatcher

    rng = random.Random(4)
    for _ in range(30):
        words = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), k * 10, k * 10 + 9, rng.random()) for k in range(10)]
        target = "".join(w[0] for w in words[3:6])
        got, best = lc.best_span(target, words), None
        cap = max(2 * len(target) + 4, len(target) + 12)
        for i in range(10):
            for j in range(i, 10):
                seen = "".join(w[0] for w in words[i : j + 1])
                if len(seen) > cap:
                    break
                m = SequenceMatcher(None, target, seen)
                prob = sum(w[3] for w in words[i : j + 1]) / (j - i + 1)
                key = (round(0.65 * m.ratio() + 0.30 * sum(b.size for b in m.get_matching_blocks()) / len(target) + 0.05 * prob, 6), i - j, -i)
                best = max(best, key) if best else key
        if got:
            assert got["key"] == best


def test_islands_group_like_the_whole_recording(spark):
    """Grouping by island gives what one pass over the recording gives."""
    rng = random.Random(9)
    rows = [(rng.choice(["v3", "turbo"]), s := rng.randint(0, 60_000), s + rng.randint(1, 3_000), rng.choice(["hello there", "good bye", "something else"])) for _ in range(120)]
    c = cands(spark, rows)
    got = {r["event_id"]: r["grp"] for r in tl.group_candidates(c, tl.contains_support).collect()}
    groups = []
    for i, (role, s, e, text) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[1][2], x[0])):
        home = None
        for g in reversed(groups):
            if s > g["end"] + 800:
                break
            if role not in g["roles"] and ((s < g["end"] and e > g["start"]) or text in g["texts"]):
                home = g
                break
        if home is None:
            home = {"id": i, "start": s, "end": e, "roles": set(), "texts": set(), "members": []}
            groups.append(home)
        home["start"], home["end"] = min(home["start"], s), max(home["end"], e)
        home["roles"].add(role), home["texts"].add(text), home["members"].append(i)
    assert got == {m: g["id"] for g in groups for m in g["members"]}


def test_timeline_never_overlaps(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["v3", "turbo"]), s := rng.randint(0, 90_000), s + rng.randint(1, 4_000), f"text number {k % 17}") for k in range(150)]
    c = cands(spark, rows)
    t = tl.build_timeline(c, ev.classify(c), tl.contains_support)
    assert tl.check_timeline(t).filter("rule IN ('overlap', 'empty')").count() == 0


def test_normal_forms(spark):
    assert one(spark, tx.norm_align(F.lit("カタカナ、ＡＢＣ！"))) == "かたかなabc"
    assert one(spark, tx.norm_alnum(F.lit("Ｆｕｌｌ-width １２"))) == "Fullwidth12"
    assert one(spark, tx.ratio()(F.lit("abcd"), F.lit("bcde"))) == 0.75
    with pytest.raises(Exception, match="bad run identity"):
        one(spark, tx.run_key(F.lit("side"), F.lit("v3"), F.lit("raw")))


def test_keyword_match_against_brute_force(spark):
    names = ["track01_moon", "02 a long evening walk", "lavender misty", "雨の夜", "03_é😀b", "", None, "x", "track4-evenings and", "Moon light", "nothing here at all"]
    texts = ["", None, "the moon over a long evening walk", "a lavender misty field", "今日は雨の夜です", "it said é😀b and x", "some evenings and Moon lights", "é😀", "lavender mist", "x", "a long  evening walk"]
    audio = spark.createDataFrame([(f"a{i}", n) for i, n in enumerate(names)] * 2, "asset_key string, audio_base string")
    scripts = spark.createDataFrame([(f"s{(i * 7) % 10}", t) for i, t in enumerate(texts)], "script_base string, content string")
    found = sc.match_keyword(audio, scripts)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    kws = audio.select("asset_key", tx.keyword(F.col("audio_base")).alias("kw")).distinct().collect()
    held = scripts.filter("content IS NOT NULL").collect()
    want = {r["asset_key"]: min(m) for r in kws if r["kw"] is not None and (m := [x["script_base"] for x in held if r["kw"] in x["content"]])}
    assert len(want) > 6
    assert {r["asset_key"]: r["script_base"] for r in found.collect()} == want
    assert sc.match_keyword(audio.limit(0), scripts).count() == 0 and sc.match_keyword(audio, scripts.limit(0)).count() == 0
