"""N-gram join, tokenizer alignment and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cueloom.llm import lexical, ngram_join, token_alignment

fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def components(texts):
    up = {d: d for d, _ in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(d, grams(t)) for d, t in texts]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: find(d) for d in up}


def test_join(docs, texts):
    want = components(texts)
    got = ngram_join.join_components(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in texts)
    sizes = {(d, len(grams(t))) for d, t in texts}
    assert all(r["component_id"] == want[r["doc_id"]] and (r["doc_id"], r["n_shingles"]) in sizes for r in got)
    assert len(set(want.values())) < len(want)


def test_join_chains_hubs_and_shared_passages(spark):
    """Chains whose ends are apart, a hub, sets just at and just under the threshold, and texts that share only a passage."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 80])) for k in range(12)]
    hub = [f"h{k}" for k in range(120)]
    rows.append((900, " ".join(hub)))
    for k in range(30):
        v = list(hub)
        v[(11 * k) % 120] = f"x{k}"
        rows.append((100 + k, " ".join(v)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(200 + k, passage + " " + " ".join(f"q{rng.random()}" for _ in range(9 + k % 3))) for k in range(40)]
    for n, size in enumerate((17, 18, 20, 23, 37, 43)):  # n of m shingles in common, around the threshold
        rows += [(300 + 10 * n, " ".join(f"t{n}_{k}" for k in range(size))), *[(300 + 10 * n + j, " ".join(f"t{n}_{k}" for k in range(size + j))) for j in range(1, 7)]]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == components(rows)


def test_prefixes_of_linked_sets_meet_under_every_order():
    rng = np.random.default_rng(2)
    common = np.sort(rng.choice(np.arange(1, 5000, dtype=np.uint64), 800, replace=False))
    first = ngram_join.FirstOrder(common, rng.permutation(800) + 1)
    for _ in range(300):
        n = int(rng.integers(6, 200))
        x = np.sort(rng.choice(np.arange(1, 5000, dtype=np.uint64), n, replace=False))
        y = np.unique(np.append(x[rng.random(n) > 0.07], rng.integers(1, 5000, int(rng.integers(0, max(1, n // 14) + 1)), np.uint64)))
        if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)) and len(np.setxor1d(x, y)):
            p, q = ngram_join.prefix_size(len(x), 85), ngram_join.prefix_size(len(y), 85)
            assert np.intersect1d(first.prefix(x, p), first.prefix(y, q)).size
            assert all(np.intersect1d(ngram_join.hashed_prefix(x, k, p), ngram_join.hashed_prefix(y, k, q)).size for k in (2, 3))


def test_join_of_nothing_and_repeated_rows(spark, empty):
    assert ngram_join.join_components(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "A b c d e f"), (None, "z")], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join_components(df).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3), (None, 3, 1), (None, 1, None)], key=repr)


def aligned(t, text):
    """n_a, n_b, groups_sha256 and linked pairs by walking both token lists."""
    raw = (" " + text).encode()
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    if not text or b"".join(t.a_bytes[i] for i in a) != raw or b"".join(t.b_bytes[i] for i in b) != raw:
        return 0, 0, "", []
    ends_a, ends_b = np.cumsum([len(t.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(t.b_bytes[i]) for i in b]).tolist()
    groups, pairs, i, j = [], [], 0, 0
    for c in sorted(set(ends_a) & set(ends_b)):
        m, n = ends_a.index(c, i) + 1, ends_b.index(c, j) + 1
        groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
        pairs.append((a[m - 1], b[n - 1]))
        i, j = m, n
    return len(a), len(b), hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs


ODD_TEXTS = [
    "", " ", "  ", "\n", "a", "a  b", "  a b  ", " \n\n x", "x \n y", "▁", "a▁ b", "▁▁ x", "a <s> </s> <|endoftext|> <unk> <0x41>", "don't 'S x,. ﬁ ÿ. é́   y　z", "日本語のテキスト、です。" * 40,
    "é" * 3000, "ab" * 20000, "a\x1c b \x1f c\x85 d", "😀 👩‍👩‍👧 x", "tab\t x\t y", " ' s ' t", "x\x00y z", "﻿bom a", "ﷺ ① ½", "a" + " " * 100 + "b",
]


@pytest.mark.parametrize("work", (5, 64, token_alignment.WORK))
def test_alignment_of_odd_texts(work):
    m = token_alignment.Aligner(A, B, work)
    for batch in (ODD_TEXTS, ODD_TEXTS[::-1], ["one text"], []):
        if batch:
            n_a, n_b, n_groups, sha, pairs, times = m.align(batch)
            for k, text in enumerate(batch):
                want = aligned(m.t, text)
                links = Counter(a * m.width + b for a, b in want[3])
                assert (n_a[k], n_b[k], sha[k], n_groups[k]) == (*want[:3], len(want[3]))
                assert dict(zip(pairs[k].tolist(), times[k].tolist())) == links


def test_merge_path_pieces_are_of_equal_work():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, int(rng.integers(1, 200)))) for _ in range(2))
        for work in (1, 3, 16, 1000):
            at_a, at_b = token_alignment.merge_path(a, b, work)
            steps = np.diff(at_a + at_b)
            assert (steps[:-1] == work).all() and (at_a[-1], at_b[-1]) == (len(a), len(b)) and (np.diff(at_a) >= 0).all() and (np.diff(at_b) >= 0).all()
            i, j = token_alignment.common_ends(a, b, work)
            assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def test_alignment(docs, texts, spark, empty):
    t = token_alignment.tokenizers_of(A, B)
    each = [(d, aligned(t, x or "")) for d, x in texts]
    counts = Counter(p for _, x in each for p in x[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    want = sorted((d, x[0], x[1], len(x[3]), len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[2]) for d, x in each)
    for sent in (token_alignment.PAIRS_SENT, 0):
        assert sorted(map(tuple, token_alignment.align(docs, A, B, pairs_sent=sent).collect())) == want
    assert token_alignment.align(empty, A, B).count() == 0


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(t or ""))


def ranked(texts, items, k):
    held = [(d, Counter(terms(t))) for d, t in texts if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shape", ((64, 1 << 15, 1 << 21), (2, 7, 1 << 21), (3, 1 << 15, 300)))
def test_search(docs, texts, spark, monkeypatch, shape):
    for name, x in zip(("BLOCK", "SHARD_DOCS", "SHARD_TERMS"), shape):
        monkeypatch.setattr(lexical, name, x)
    items = [(k, t) for k, t in texts[:40] if t] + [(900, "The THE the license"), (901, None), (902, "zzzz"), (903, ""), (904, "日本語 é under"), (None, "of the and")]
    index = lexical.build_index(docs.repartition(5))
    asked = spark.createDataFrame(items, "item_id long, text string")
    for block in (4096, 7):
        got = sorted(map(tuple, lexical.search(index, asked, k=5, query_block=block).collect()), key=repr)
        assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in ranked(texts, items, 5)]
        assert got == ranked(texts, items, 5)


def test_search_of_nothing(docs, spark, empty):
    index, none = lexical.build_index(docs), spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(index, none).count() == 0
    some = spark.createDataFrame([(1, "the"), (1, "the"), (2, None)], "item_id long, text string")
    assert lexical.search(lexical.build_index(empty), some).count() == 0
    assert lexical.search(index, some.filter("item_id = 2")).count() == 0
    assert lexical.search(index, some).count() == lexical.search(index, some.limit(1)).count() > 0
    ties = spark.createDataFrame([(3, "a b"), (1, "a b"), (None, "a b"), (2, "A, b"), (7, None), (8, "c d e"), (9, "f"), (10, "g")], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("shard", F.lit(2))
    got = lexical.search(lexical.build_index(ties), some.select("item_id", F.lit("b a").alias("text")).limit(1))
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == [1, 2, 3, None]


def test_join_rows_with_equal_neighbours():
    """Rows alone in the order go, those at the ends of a part stay, whatever the batches."""
    rng = random.Random(5)
    for _ in range(200):
        keys = sorted(rng.randrange(30) for _ in range(rng.randrange(40)))
        cuts = [0, *sorted(rng.randrange(len(keys) + 1) for _ in range(3)), len(keys)]
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array(range(i, j), pa.int64())], names=["key", "at"]) for i, j in zip(cuts, cuts[1:])]
        got = [x for b in ngram_join.not_alone(iter(batches)) for x in b.column(1).to_pylist()]
        assert got == [k for k in range(len(keys)) if k in (0, len(keys) - 1) or keys[k] in (keys[k - 1], keys[k + 1])]
