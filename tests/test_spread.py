"""Running values by blocks against plain windows, and candidates' similarity against all pairs."""

import random
from difflib import SequenceMatcher
from statistics import median

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.operators import evidence as ev, intervals as iv, review as rv, scans


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows in one recording; equal rows, nested and touching spans, a null recording."""
    rng, out = random.Random(7), []
    for k in range(3000):
        audio = 0 if k % 2 else rng.choice([1, 2, 3, 4, 5, None])
        start = rng.randrange(0, 400_000 if audio == 0 else 60_000)
        out.append((audio, k, start, start + rng.choice([0, 100, 500, 9000]), "subtitle" if rng.random() < 0.6 else "excluded"))
    out += [(7, 5000, 10, 20, "excluded")] + [(8, 5001 + k, 5, 5, "subtitle") for k in range(30)]
    return spark.createDataFrame(out, "audio_id int, event_id long, start_ms long, end_ms long, kind string").repartition(5).cache()


def same(a, b):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_blocks_give_what_windows_give(rows):
    for strict in (False, True):
        a, b = (iv.with_islands(rows, "audio_id", 300, strict=strict, spread=x) for x in (False, True))
        same(a, b)
    same(iv.merge_intervals(rows, "audio_id", 300), iv.merge_intervals(rows, "audio_id", 300, spread=True))
    lengths = rows.filter("audio_id IS NOT NULL").groupBy("audio_id").agg((F.max("end_ms") + 4000).alias("duration_ms"))
    same(iv.coverage_gaps(rows, lengths, least_ms=200), iv.coverage_gaps(rows, lengths, least_ms=200, spread=True))
    order = ["start_ms", "end_ms", "event_id"]
    same(iv.assign_ids(rows, "W", "audio_id", order, "wid"), iv.assign_ids(rows, "W", "audio_id", order, "wid", spread=True))
    same(iv.overlap_warnings(rows, index="event_id"), iv.overlap_warnings(rows, index="event_id", spread=True))
    named = rows.withColumnRenamed("event_id", "id")
    same(rv.with_context(named), rv.with_context(named, spread=True))


def test_a_hot_recording_spreads(rows):
    sizes = [r["n"] for r in scans.in_blocks(rows, ["audio_id"], ["start_ms", "end_ms"], 16).groupBy("_block", "audio_id").agg(F.count(F.lit(1)).alias("n")).groupBy("_block").agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) <= 5 * median(sizes)
    by_key = [r["count"] for r in rows.groupBy("audio_id").count().collect()]
    assert max(by_key) > 5 * median(by_key)


def test_nothing_in_blocks(rows):
    none = rows.filter("false")
    assert iv.merge_intervals(none, "audio_id", 300, spread=True).count() == 0
    assert iv.assign_ids(none, "W", "audio_id", ["start_ms"], "wid", spread=True).count() == 0


def test_canonical_order_by_ranges(rows):
    places = iv.canonical_order(rows.filter("audio_id IS NOT NULL"), spread=True).select("audio_id", "start_ms", "end_ms", "event_id").collect()
    assert [tuple(r) for r in places] == sorted(map(tuple, places))


def test_histograms_never_exclude_a_similar_pair(spark):
    rng, pairs = random.Random(4), []
    for k in range(400):
        a = "".join(rng.choice("abcdeあいうえ漢字😀" if k % 2 else "ab") for _ in range(rng.randrange(1, 60)))
        b = "".join(c if rng.random() < 0.7 else rng.choice("abxyzあ") for c in a)[rng.randrange(0, 3) :] + "q" * rng.randrange(0, 4)
        pairs.append((k, a, b))
    df = spark.createDataFrame(pairs, "k int, a string, b string").withColumns({"ha": tx.char_histogram(F.col("a")), "hb": tx.char_histogram(F.col("b"))})
    got = {r["k"]: (r["may"], r["yes"]) for r in df.select("k", tx.may_be_alike(F.col("a"), F.col("b"), F.col("ha"), F.col("hb"), 0.62).alias("may"), tx.norms_support(F.col("a"), F.col("b"), None, F.col("ha"), F.col("hb")).alias("yes")).collect()}
    for k, a, b in pairs:
        alike = bool(b) and SequenceMatcher(None, a, b).ratio() >= 0.62
        assert got[k][0] or not alike
        assert got[k][1] == (alike or (min(len(a), len(b)) >= 2 and (a in b or b in a)))


def test_the_kernel_sees_few_pairs(spark, sf):
    """Labels by full similarity equal those of all pairs compared one by one; most pairs are decided before."""
    from cueloom.plans.evidence_queries import cand

    c = cand(spark, sf).withColumn("norm", tx.norm_text(F.col("text"))).withColumn("hist", tx.char_histogram(F.col("norm"))).cache()
    pairs = iv.interval_pairs(c, keep=("norm", "hist")).cache()
    open_ = pairs.filter(tx.undecided(F.col("norm_a"), F.col("norm_b"), F.col("hist_a"), F.col("hist_b")))
    assert open_.count() < pairs.count() / 2
    want = {(r["event_id_a"], r["event_id_b"]) for r in pairs.collect() if (a := r["norm_a"]) and (b := r["norm_b"]) and ((min(len(a), len(b)) >= 2 and (a in b or b in a)) or SequenceMatcher(None, a, b).ratio() >= 0.62)}
    assert {(r["event_id_a"], r["event_id_b"]) for r in ev.supporting_pairs(cand(spark, sf)).collect()} == want


def test_split_texts(spark):
    items = spark.createDataFrame([(1, 1, 0, 1000, "ab", "xy"), (1, 2, 2000, 3000, "c", "z")], "audio_id long, cue_index long, start_ms long, end_ms long, text_ja string, text_zh string")
    cols = "audio_id long, cue_index long, action string, structure string, edited_ja string, edited_zh string, edited_start long, edited_end long, split_at long, split_ja_before string, split_ja_after string, split_zh_before string, split_zh_after string"
    rest = (None, None, None, None)
    good = spark.createDataFrame([(1, 1, "keep", "split", *rest, 400, "a", "b", "x\nx", "y"), (1, 2, "keep", "keep", *rest, None, *rest)], cols)
    assert rv.check_review(items, good).count() == 0
    got = rv.apply_review(items, good).orderBy("cue_index").collect()
    assert [(r["start_ms"], r["end_ms"], r["id"], r["text_ja"], r["text_zh"]) for r in got] == [(0, 400, "1-A", "a", "x\nx"), (400, 1000, "1-B", "b", "y"), (2000, 3000, "2", "c", "z")]
    bad = spark.createDataFrame([(1, 1, "keep", "split", *rest, 400, "a\na", "b", "x", " "), (1, 2, "keep", "keep", *rest, None, *rest)], cols)
    assert sorted(r["rule"] for r in rv.check_review(items, bad).collect()) == ["split_text_missing", "unsafe_split_text"]
