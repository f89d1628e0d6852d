"""The alignment contract: every rule has a match that breaks it, and the aligner's own matches break none."""

from pyspark.sql import functions as F

from cueloom.operators import script_alignment as sa

UNIT = "audio_id long, pos long, norm string"
ITEM = UNIT + ", options array<struct<provenance:string,evidence_id:string,norm:string>>"
MATCH = "audio_id long, first_unit long, n_units int, first_item long, n_items int, score double, band string, relation string, evidence_ids array<string>, margin double, review_required boolean, reason string"
LEFT = "audio_id long, side string, pos long, reasons array<string>"
TEXTS = ["alpha beta", "gamma delta", "epsilon zeta", "eta theta", "iota kappa"]


def tables(spark, audio, matches, left=()):
    units = spark.createDataFrame([(audio, 10 * k, t) for k, t in enumerate(TEXTS)], UNIT)
    items = spark.createDataFrame([(audio, 10 * k, t, [("main", f"m{k}", t), ("other", f"o{k}", t)]) for k, t in enumerate(TEXTS)], ITEM)
    return spark.createDataFrame(matches, MATCH), units, items, spark.createDataFrame(list(left), LEFT)


def found(*args):
    return sorted((r["side"], r["pos"], r["rule"]) for r in sa.check_alignment_inputs(*args).collect())


def good(unit, n, ids=(), **change):
    kind = "one_to_one" if n == 1 else "many_to_many"
    row = dict(audio_id=1, first_unit=unit, n_units=n, first_item=unit, n_items=n, score=1.0, band="high", relation=kind, evidence_ids=list(ids), margin=None, review_required=False, reason=None)
    return tuple((row | change).values())


def test_a_whole_alignment_is_right(spark):
    left = [(1, s, 40, ["no_match"]) for s in ("unit", "item")]
    assert found(*tables(spark, 1, [good(0, 1), good(10, 2, ["m1", "m2"]), good(30, 1, ["o3"], margin=0.01, review_required=True)], left)) == []


def test_matches_that_overlap_cross_mix_or_name_nothing(spark):
    got = found(*tables(spark, 1, [good(0, 2, ["m0", "o1"]), good(10, 1), good(30, 3), good(77, 1)], [(1, "unit", 20, ["x"]), (1, "item", 20, None), (1, "item", 99, ["x"])]))
    assert got == sorted([
        ("match", 0, "mixed_provenance"), ("match", 10, "unit_overlap"), ("match", 10, "item_overlap"), ("match", 30, "unknown_unit"), ("match", 30, "unknown_item"),
        ("match", 77, "unknown_unit"), ("match", 77, "unknown_item"), ("unit", 10, "unit_twice"), ("item", 10, "item_twice"), ("item", 20, "no_reason"), ("item", 99, "unknown_item"),
    ])


def test_scores_are_computed_again(spark):
    units, items = [(1, 0, "the quick brown fox")], [(1, 0, "the quick brawn fax", None)]
    s = sa.score(units[0][2], items[0][2])
    for score, band, want in ((s, "high", []), (s + 0.01, "high", [("match", 0, "score_mismatch")]), (s, "medium", [("match", 0, "bad_band")])):
        m = spark.createDataFrame([good(0, 1, score=score, band=band)], MATCH)
        assert found(m, spark.createDataFrame(units, UNIT), spark.createDataFrame(items, ITEM), spark.createDataFrame([], LEFT)) == want


def test_the_aligner_keeps_its_contract(spark):
    words = "one two three four five six seven eight nine ten".split()
    units = spark.createDataFrame([(a, k, f"{words[k]} {words[(k + a) % 10]} said") for a in range(3) for k in range(8)], UNIT)
    items = units.filter("pos <> 3").withColumn("norm", F.when(F.col("pos") == 5, F.concat("norm", F.lit("x"))).otherwise(F.col("norm")))
    m = sa.align_scripts(units, items)
    rules = sa.check_alignment_inputs(m, units, items, spark.createDataFrame([], LEFT)).collect()
    assert m.count() >= 18 and {r["rule"] for r in rules} <= {"unit_uncovered", "item_uncovered"}
