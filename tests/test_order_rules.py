"""Ordered walks, interval joins, variants, budgets, attempts, alerts, services and jobs against plain re-statements."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from cueloom.functions.text import bigram_dice
from cueloom.operators import intervals as iv, jobs, long_cues as lc, review as rv, script_alignment as sa, services as sv, timeline as tl
from cueloom.operators.walk import walk_groups
from cueloom.plans import more_queries as mq
from cueloom.plans.evidence_queries import cand
from cueloom.plans.fixtures import fx
from cueloom.streaming import streams


def test_groups_are_walked_whole_and_in_order(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(1)
        rows = [(k % 5, f"k{k % 3}", rng.randint(0, 999)) for k in range(400)]
        df = spark.createDataFrame(rows, "a long, b string, x long").repartition(6)
        out = walk_groups(df, ["a", "b"], ["x"], ["x"], lambda key, held: [(*key, [x for (x,) in held])], "a long, b string, xs array<long>").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for a, b, x in rows:
        want.setdefault((a, b), []).append(x)
    assert {(r["a"], r["b"]): r["xs"] for r in out} == {k: sorted(v) for k, v in want.items()} and len(out) == len(want)
    assert walk_groups(df.filter("false"), ["a", "b"], ["x"], ["x"], lambda key, held: [], "a long").count() == 0


def test_interval_pairs_across_buckets(spark):
    rng = random.Random(2)
    rows = []
    for k in range(150):
        start = rng.choice([rng.randint(0, 60_000), 8_000 * rng.randint(0, 7)])
        rows.append((k % 2, k, "ab"[k % 3 % 2], start, start + rng.choice([0, 5, 800, 4000, 30_000])))
    df = spark.createDataFrame(rows, "audio_id long, event_id long, model_role string, start_ms long, end_ms long")
    got = sorted((r["event_id_a"], r["event_id_b"]) for r in iv.interval_pairs(df, gap_ms=800).collect())
    assert got == sorted((x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] != y[1] and x[2] != y[2] and x[3] <= y[4] + 800 and y[3] <= x[4] + 800)


def test_variants_follow_their_provenance():
    one = sa.Item([("main", "b", "abc"), ("main", "a", "abc"), ("rescue", "r", "abd"), ("main", "", "zzz"), ("main", "x", "")])
    two = sa.Item([("main", "d", "defg"), ("rescue", "e", "def"), ("rescue", "f", "de")])
    assert one.options == {"main": [("a", "abc")], "rescue": [("r", "abd")]}
    got = sa.variants([one, two])
    assert sorted(got) == [(("a", "d"), "abcdefg"), (("r", "e"), "abddef"), (("r", "f"), "abdde")]
    assert sa.best_variant("abddef", got) == (1.0, ("r", "e"))
    assert sa.variants([one, sa.Item([("legacy", "q", "x")])]) == []
    assert sa.best_variant("abc", []) == (0.0, ())
    many = sa.Item([("main", f"{k}", f"text {k}") for k in range(17)])
    assert sa.variants([many] * 3) is None and len(sa.variants([many] * 2)) == 289


def test_best_variants_table_equals_the_kernel(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(0, 6)))
    groups, options = [], []
    for g in range(40):
        n = rng.randint(1, 3)
        groups.append((1, g, text() + text()))
        for place in range(n):
            options += [(1, g, place, rng.choice(["main", "rescue"]), rng.choice(["", f"e{k}"]) if k == 3 else f"e{k}", text()) for k in range(rng.randint(1, 4))]
    got = {r["grp"]: (r["score"], tuple(r["evidence_ids"])) for r in sa.best_variants(spark.createDataFrame(groups, "audio_id long, grp long, want string"), spark.createDataFrame(options, "audio_id long, grp long, place int, provenance string, evidence_id string, norm string")).collect()}
    for _, g, want in groups:
        places = sorted({o[2] for o in options if o[1] == g})
        texts = sa.variants([sa.Item([o[3:] for o in options if o[1] == g and o[2] == p]) for p in places])
        if not texts:
            assert g not in got
            continue
        s, ids = sa.best_variant(want, texts)
        assert abs(got[g][0] - s) < 1e-9 and got[g][1] == ids, g


def test_alignment_takes_the_best_variant(spark):
    units = spark.createDataFrame([(1, 0, "hello there my friend"), (1, 1, "goodbye")], "audio_id long, pos long, norm string")
    opts = [[("main", "m0", "yellow hair"), ("rescue", "r0", "hello there")], [("main", "m1", "my fiend"), ("rescue", "r1", "my friend")], [("main", "m2", "goodbye")]]
    items = spark.createDataFrame([(1, k, o[0][2], o) for k, o in enumerate(opts)], "audio_id long, pos long, norm string, options array<struct<provenance:string,evidence_id:string,norm:string>>")
    got = {r["first_unit"]: (r["n_items"], r["evidence_ids"], r["anchored"]) for r in sa.align_scripts(units, items).collect()}
    assert got[0][:2] == (2, ["r0", "r1"])
    assert got[1][2]


def test_budgets_of_regions_and_recordings(spark):
    text = lambda k: f"line {k * 7919 % 1000:03d} of some script"
    rows = [(a, p, text(p)) for a in (1, 2) for p in range(12)]
    units = spark.createDataFrame(rows, "audio_id long, pos long, norm string")
    items = spark.createDataFrame([(a, p, t if p % 4 == 3 else t + " x") for a, p, t in rows], "audio_id long, pos long, norm string")
    reasons = lambda **b: {r["region"]: r["reason"] for r in sa.budget_regions(*sa.with_regions(units, items), **b).filter("audio_id = 1").collect()}
    free = reasons()
    assert len(free) >= 3 and not any(free.values())
    assert set(filter(None, reasons(cells=2).values())) == {"region_too_large"}
    spent = reasons(total_cells=20)
    assert [r for r in sorted(spent) if spent[r]] == [r for r in sorted(free) if r > 1 and spent[r]] and "total_budget_exceeded" in spent.values() and spent[0] is None
    us, ts = ["abc", "de"], [sa.Item("abcd"), sa.Item([("m", "1", "x"), ("m", "2", "yy")])]
    want = sum(len("".join(u)) * sum(i.longest for i in t) * len(list(product(*[[o for v in i.options.values() for o in v] for i in t]))) for a in range(2) for u in [us[a : a + b] for b in (1, 2) if a + b <= 2] for j in range(2) for t in [ts[j : j + b] for b in (1, 2) if j + b <= 2] if len({frozenset(i.options) for i in t}) == 1)
    assert sa.region_work(us, ts) == want
    assert set(filter(None, reasons(total_work=10).values())) == {"work_budget_exceeded"}
    out = sa.align_scripts(units, items, cells=2).filter("reason is not null").collect()
    assert out and all(r["review_required"] and r["n_units"] == 0 for r in out)


def test_attempts_of_different_counts_do_not_agree(spark):
    rows = [(1, 0, 0, 0, 100, 900, "a"), (1, 0, 1, 0, 150, 850, "a"), (1, 1, 0, 0, 0, 400, "a"), (1, 1, 0, 1, 400, 900, "b"), (1, 1, 1, 0, 0, 900, "a"), (1, 2, 0, 0, 0, 9, "a")]
    df = spark.createDataFrame(rows, "audio_id long, cue_index long, attempt int, ord int, start_ms long, end_ms long, text string")
    got = {(r["cue_index"], r["ord"]): (r["start_ms"], r["end_ms"], r["agreed"], r["cue_shift_ms"]) for r in lc.consensus(df).collect()}
    assert got[0, 0] == (150, 850, True, 50)
    assert got[1, 0][2:] == got[1, 1][2:] == (False, 15_001)
    assert got[2, 0][2] is False


def test_gap_alerts_over_several_batches(spark, tmp_path):
    parts = [[(1, 0, 900), (1, 5000, 6000)], [(2, 0, 500), (1, 6500, 9000), (1, 8000, 8100)], [(1, 10_500, 10_600), (2, 1999, 2000)], [(1, 9100, 9200)]]
    for part in parts:
        spark.createDataFrame(part, "audio_id long, start_ms long, end_ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("audio_id long, start_ms long, end_ms long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted(tuple(r) for r in mq._drained(spark, streams.gap_alerts(live), "append").collect())
    assert got == [(1, 900, 5000), (1, 9000, 10_500)]


def test_a_failing_service_stops_nothing(spark):
    def make():
        def client(payload):
            if payload == "bad":
                raise ValueError("no")
            return {"lines": []} if payload == "empty" else {"lines": [payload, 2]} if payload == "dict" else payload.upper()

        return client

    df = spark.createDataFrame([(k, 0, p) for k, p in enumerate(["bad", "empty", "dict", "x"])], "audio_id long, batch long, payload string")
    got = {r["audio_id"]: (r["reply"], r["tries"], r["error"]) for r in sv.ask(df, make, tries=2).collect()}
    assert got == {0: (None, 2, "ValueError: no"), 1: (None, 2, "no usable reply"), 2: ("dict---SPLIT---2", 1, None), 3: ("X", 1, None)}
    assert sv.ask(df.filter("false"), make).count() == 0


def test_audit_refuses_recordings_of_unmatched_runs(spark, sf):
    c = cand(spark, sf).filter("audio_id < 3")
    runs = c.select("audio_id", "run_key").distinct().withColumn("source_relation", F.when((F.col("audio_id") == 1) & F.col("run_key").startswith("rescue"), None).otherwise("matched"))
    audit = jobs.evidence_audit(c, runs, fx(spark, sf, "fx_duration"), support=bigram_dice_support, timeline_support=tl.contains_support)
    rows = {r["audio_id"]: r for r in audit.manifest.collect()}
    assert {a: r["status"] for a, r in rows.items()} == {0: "complete", 1: "refused", 2: "complete"}
    assert rows[1]["n_items"] == 0 and rows[0]["n_windows"] > 0 and rows[0]["n_items"] > 0
    for t in audit[:4]:
        assert {(r["audio_id"], r["generation"]) for r in t.select("audio_id", "generation").distinct().collect()} <= {(a, rows[a]["generation"]) for a in (0, 2)}
    again = {r["audio_id"]: r["generation"] for r in jobs.generations(c.repartition(5)).collect()}
    assert again == {a: r["generation"] for a, r in rows.items()}
    moved = {r["audio_id"]: r["generation"] for r in jobs.generations(c.withColumn("text", F.when(F.col("audio_id") == 2, F.upper(F.concat("text", F.lit("x")))).otherwise(F.col("text")))).collect()}
    assert moved[0] == again[0] and moved[2] != again[2]


def bigram_dice_support(a, b):
    return bigram_dice(a, b) >= 0.62


@pytest.mark.parametrize("filtered", [False, True])
def test_review_flags_with_and_without_a_script(spark, filtered):
    """Every mix of classification, own request, overlap, support, differing texts and reasons, against the rule in plain steps."""
    cues, items, cands, given, want = [], [], [], [], {}
    mixes = list(product(["supported", "uncertain"], [True, False], ["overlap_partition", "word_candidate"], [True, False], [True, False], [[], ["script_alignment_review"], ["script_alignment_unmatched", "shared_timeline_window"]]))
    for k, (kind, asked, timing, backed, differ, reasons) in enumerate(mixes):
        start, end = 10_000 * k, 10_000 * k + 2000
        cues.append((1, k, start, end, f"text {k} of the cue", "zh （低信頼度）" if k % 5 == 0 else "zh"))
        texts = [f"text {k} of the cue" if backed else "something else", "a third one"][: 1 + differ]
        cands += [(1, 10 * k + j, start, end, t) for j, t in enumerate(texts)]
        items.append((1, f"TL{k:06d}", start, end, kind, asked, timing, [10 * k + j for j in range(len(texts))]))
        if reasons:
            given.append((1, f"TL{k:06d}", reasons))
        text, when, info = [], [], []
        if kind != "supported" and not backed:
            text += ["uncertain", "uncertain_asr_evidence"]
        if filtered and reasons:
            for r in reasons:
                if r != "script_alignment_review":
                    (when if r == "shared_timeline_window" else text).append(r)
        elif not filtered and asked and not backed:
            text.append("uncertain")
        if "overlap" in timing:
            if filtered and when:
                when.append("overlap")
            elif not filtered:
                info.append("overlap_partitioned")
        if differ:
            if backed and not filtered:
                info.append("model_disagreement_resolved")
            elif not filtered or text:
                text.append("model_disagreement")
        if k % 5 == 0:
            text.append("low_confidence")
        want[k] = tuple(list(dict.fromkeys(x)) for x in (text, when, info))
    table = spark.createDataFrame
    out = rv.review_items(
        table(cues, "audio_id long, cue_index long, start_ms long, end_ms long, text_ja string, text_zh string"),
        table(items, "audio_id long, timeline_id string, start_ms long, end_ms long, classification string, review_required boolean, timing_kind string, evidence_ids array<long>"),
        table(cands, "audio_id long, event_id long, start_ms long, end_ms long, text string"),
        lambda a, b: a == b, lambda a, b: a == b, table(given, "audio_id long, timeline_id string, reasons array<string>") if filtered else None,
    )
    assert {r["cue_index"]: (r["text_flags"], r["timing_flags"], r["informational_flags"]) for r in out.collect()} == want


@pytest.mark.parametrize("n", [0, 1, 40])
def test_word_spans_in_stretches(spark, n):
    rng = random.Random(n)
    words = ["".join("ab"[rng.randint(0, 1)] for _ in range(rng.choice([0, 1, 3, 9, 30]))) for _ in range(n)]
    df = spark.createDataFrame([(1, k, w, k, k + 1, 0.5, 12) for k, w in enumerate(words)], "cue long, pos int, norm string, start_ms long, end_ms long, probability double, target_chars int")
    got = sorted((r["first_word"], r["last_word"]) for r in lc.word_spans(df).collect())
    assert got == [(i, j) for i in range(n) for j in range(i, n) if words[i] and words[j] and len("".join(words[i : j + 1])) <= 28]
