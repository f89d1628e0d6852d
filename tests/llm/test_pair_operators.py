"""Near duplicates, top-k search and the pipeline against brute force."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cueloom.llm import neardup, topk

fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    """component of every doc_id."""
    nodes = sorted({d for d, _ in texts})
    up = {d: d for d in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(d, shingles(t)) for d, t in texts]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: find(d) for d in nodes}


def test_near_duplicates(docs, texts):
    want = brute(texts)
    got = neardup.duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in texts)
    by_text = {(d, len(shingles(t))) for d, t in texts}
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
        assert (r["doc_id"], r["n_shingles"]) in by_text
    assert len(set(want.values())) < len(want)


def test_components_of_a_whole_table(spark, sf):
    """All links of 1,000 documents, natural and planted, against every pair of sets."""
    larger = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")
    if not os.path.isdir(larger):
        pytest.skip("no test data")
    df = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in df.collect()])
    got = {r["doc_id"]: r["component_id"] for r in neardup.duplicates(df).collect()}
    assert got == want and len(set(want.values())) < 0.95 * len(want)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n, m in ((3, 3), (200, 150), (3000, 2900)):
        a = rng.integers(0, 2**63, n, np.uint64)
        b = np.concatenate([a[: m - m // 5], rng.integers(0, 2**63, m // 5, np.uint64)])
        bits = sum(int(x ^ y).bit_count() for x, y in zip(neardup.parities(a).view(np.uint64).tolist(), neardup.parities(b).view(np.uint64).tolist()))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and (n > 300 or bits > 0 or m < 5)


def test_chains_of_near_copies(spark):
    """Neighbours are alike and the ends aren't: one component all the same; and a hub below its spokes' similarity."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 80])) for k in range(12)]
    hub = [f"h{k}" for k in range(60)]
    rows.append((500, " ".join(hub)))
    for k in range(40):
        v = list(hub)
        v[(7 * k) % 60] = f"x{k}"
        rows.append((100 + k, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.duplicates(df).collect()}
    assert got == brute(rows)


def test_estimate_is_close():
    make = neardup.Sketcher()
    a = " ".join(f"a{k}" for k in range(500))
    b = " ".join(f"a{k}" if k < 450 else f"b{k}" for k in range(500))
    x, y = shingles(a), shingles(b)
    sa, sb = (make.signature(make.minima(make.shingles(t))) for t in (a, b))
    lanes = 64 // neardup.BITS
    unequal = sum(((int(p) & (2**64 - 1)) >> (neardup.BITS * k) & 3) != ((int(q) & (2**64 - 1)) >> (neardup.BITS * k) & 3) for p, q in zip(sa, sb) for k in range(lanes))
    est = (1 - unequal / neardup.MINIMA - 0.25) / 0.75
    assert abs(est - len(x & y) / len(x | y)) < 0.12


def test_signatures_lose_less_than_the_bands(spark):
    """Pairs just at the threshold with unluckily many unequal lanes (72 and 73) are links all the same."""
    rows = []
    for seed in (1946, 14986, 15802):
        rng = random.Random(seed)
        words = ["%x" % rng.getrandbits(40) for _ in range(52)]
        rows += [(2 * seed, " ".join(words)), (2 * seed + 1, " ".join(words[:40]))]
    want = brute(rows)
    assert len(set(want.values())) == 3
    got = {r["doc_id"]: r["component_id"] for r in neardup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    bands = (1 - 0.75**neardup.BAND_ROWS) ** neardup.BANDS
    assert neardup.filter_miss(0.75, neardup.lanes_allowed(75)) < bands / 4


def test_empty_and_repeated(spark, empty):
    assert neardup.duplicates(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(map(tuple, neardup.duplicates(df).collect()), key=repr)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(size=16)], k % 3) for k in range(700)]
    rows += [(700, None, 0), (800, [1.0, None], 0), (900, [float("nan")] * 16, 0), (901, [float("inf")] * 16, 0), (902, rows[3][1], 1), (903, rows[3][1], 1), (904, [0.5] * 8, 1), (905, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    v = topk.quantized(df)
    good = {r["vec_id"]: np.array(r["v"] + [0] * (16 - len(r["v"])), np.int64) for r in v.collect()}
    assert set(good) == {*range(700), 902, 903, 904, 905}
    for block, shard in ((4096, 8192), (3, 50)):
        out = topk.search(v, v.filter(F.col("vec_id") % 100 == 0), k=10, query_block=block, shard_rows=shard).collect()
        got = {}
        for r in sorted(out, key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        for q in range(0, 700, 100):
            want = sorted(((-int(good[q] @ x), i) for i, x in good.items() if i != q))[:10]
            assert got[q] == [(i, -s) for s, i in want]
    few = v.filter("vec_id < 3")
    assert topk.search(few, few, k=10).count() == 6
    assert topk.search(v.filter("false"), v.filter("false"), k=10).count() == 0


def test_pipeline_stages(spark, sf, docs, texts):
    """Each stage on the one before it: decisions take effect and columns stay."""
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, sf).cache()
        assert kept.columns == docs.columns
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            comp = brute(rows)
            assert {r["doc_id"] for r in kept.collect()} == {d for d, c in comp.items() if d == c}
        if name == "secret_scan":
            assert kept.count() == before.count() and kept.filter(F.col("text").contains("0123456789abcdef")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_pipeline_on_an_empty_table(spark, sf, empty):
    kept = empty
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf)
    assert kept.count() == 0
