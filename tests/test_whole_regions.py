"""Script alignment leaves no region, pair or variant out for its size, and its fast scores are difflib's."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cueloom.functions import blocks
from cueloom.operators import script_alignment as sa
from cueloom.plans import catalog
from cueloom.plans.fixtures import table

SIDE = "audio_id long, pos long, norm string"


def _words(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "ing", "er", "re", "sh", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_long_texts_are_aligned(spark):
    """Texts of thousands of characters, one letter off, so that no anchor cuts their region: each finds its partner."""
    rng = random.Random(4)
    texts = [_words(rng, 250) for _ in range(6)]
    units = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], SIDE)
    items = spark.createDataFrame([(1, k, t + "x") for k, t in enumerate(texts)], SIDE)
    got = sa.align_scripts(units, items).collect()
    assert sorted((r["first_unit"], r["n_units"], r["first_item"], r["n_items"], r["reason"], r["band"]) for r in got) == [(k, 1, k, 1, None, "high") for k in range(6)]


def test_a_region_of_many_cells_is_aligned(spark):
    """175 x 175 rows without text, but for one on either side."""
    rows = lambda at, text: spark.createDataFrame([(1, k, text if k == at else "") for k in range(175)], SIDE)
    got = sa.align_scripts(rows(90, "hello there my friend"), rows(80, "hello there my fiend")).collect()
    assert [(r["first_unit"], r["n_units"], r["reason"], r["band"]) for r in got] == [(90, 1, None, "high")]


def test_items_of_more_variants_than_a_list_takes():
    rng = random.Random(6)
    items = [sa.Item([("main", f"{k}-{n:02d}", _words(rng, 3)) for n in range(17)]) for k in range(3)]
    pick = ("0-16", "1-09", "2-16")
    want = "".join(dict(i.options["main"])[e] for i, e in zip(items, pick))
    assert 17**3 > sa.MAX_VARIANTS
    assert sa.align_region([want], items)[0] == [(0, 1, 0, 3, 1.0, pick)]


def test_no_region_of_the_query_is_left_out(spark, sf):
    rows = catalog.QUERIES["l9_script_alignment"](spark, sf).collect()
    assert rows and not [r for r in rows if r["reason"] is not None or r["n_units"] == 0]


def test_the_summary_counts_what_budgets_would_leave_out(spark, sf):
    """Recordings whose items run backwards have no anchors: each is one region, here those over the budget of work."""
    turns: dict[int, list[str]] = {}
    for r in table(spark, sf, "conversations").filter("conv_id % 4 = 0").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append(r["text"].lower())
    want, relation = Counter(), lambda a, b: f"{'one' if a == 1 else 'many'}_to_{'one' if b == 1 else 'many'}"
    for audio, us in turns.items():
        ts = [t for k, t in enumerate(us) if k % 3 != 2][::-1]
        if len(ts) > 1 and len(set(us)) == len(us) and sa.region_work(us, [sa.Item(t) for t in ts]) > sa.REGION_WORK:
            want.update((audio, relation(a, b)) for _, a, _, b, _, _ in sa.align_region(us, ts)[0])
    got = Counter()
    for r in catalog.QUERIES["l9_alignment_summary"](spark, sf).filter(F.col("audio_id").isin([a for a, _ in want])).collect():
        got[r["audio_id"], r["relation"]] += r["n"]
    assert want and got == want


def test_matches_are_those_of_difflib():
    rng = random.Random(7)
    for _ in range(400):
        letters = rng.choice(["ab", "abcde", "the and of ", "あいうえおabc", "a😀b"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([3, 20, 90, 200])))) for _ in range(2))
        if rng.random() < 0.4:
            b = b[: len(b) // 2] + a[rng.randrange(len(a)) :] + b[len(b) // 2 :]
        m = SequenceMatcher(None, a, b, autojunk=False)
        x = m.find_longest_match(0, len(a), 0, len(b))
        want = (x.a, x.b, x.size) if x.size else (0, 0, 0)
        assert blocks._by_bits(a, b) == blocks._by_ranks(a, b) == want
        assert blocks._by_seeds(a, b) in ([want] if want[2] >= 8 else [want, None])
        assert blocks.Matches().count(a, b) == sum(k.size for k in m.get_matching_blocks())
    scorer, texts = sa.Scorer(), [_words(rng, 80) for _ in range(4)]
    for a in texts:
        for b in [*texts, texts[0] + texts[1], texts[2][:300]]:
            r = SequenceMatcher(None, a, b, autojunk=False).ratio()
            grams = lambda t: sorted(t[k : k + 2] for k in range(len(t) - 1))
            ga, gb = grams(a), grams(b)
            dice = 2 * sum(min(ga.count(g), gb.count(g)) for g in set(ga)) / (len(ga) + len(gb))
            want = 1.0 if a == b else 0.55 * r + 0.30 * dice + 0.15 * min(len(a), len(b)) / max(len(a), len(b))
            assert scorer.score(a, b) == pytest.approx(want, abs=1e-12)
            assert scorer.score(a, b, 0.6) == scorer.score(a, b) or want < 0.6
