"""Operators on single texts against plain re-statements of their contracts."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cueloom.llm import bpe, langid, licenses, linededup, packing, quality_rules, secrets, site_quality, textstats

fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def by_id(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in cols))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def expected(texts, one):
    out = {}
    for d, t in texts:
        out.setdefault(d, []).append(one(d, t or ""))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def base_spans(t):
    kw = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    sp = [(m.start(), 0, m.end(), "assign") for m in kw.finditer(t) if len(m[2]) >= 6]
    sp += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    sp += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(sp)


def test_secret_base_spans(docs, texts):
    got = by_id(secrets.scan(docs).select("doc_id", secrets.span_text(F.col("base")).alias("s")), "s")
    assert got == expected(texts, lambda d, t: (",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(t)),))


def test_weak_parts_need_each_other(docs):
    spans = {k: v[0][0] for k, v in by_id(secrets.scan(docs).select("doc_id", secrets.span_text(F.col("spans")).alias("s")), "s").items()}
    assert "account:0:16" in spans[307] and "endpoint:" in spans[307]  # an account, a secret and an endpoint together
    assert "account" not in spans[308]  # too far from the secret
    assert "opaque" not in spans[303]


def test_redact_replaces_spans_only(docs, texts):
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    got = by_id(out, "text", "base", "rid")
    want = [("[SECRET]" in t[0], t[1], t[2]) for t in got[306]]
    assert want == [(True, "b", "r")]
    assert got[306][0][0] == "[SECRET]\" secret=ab [SECRET] é [SECRET]" or got[306][0][0].count("[SECRET]") == 3
    plain = {d for d, t in texts if t is not None and not base_spans(t) and d not in (307,)}
    for d, t in texts:
        if d in plain:
            assert (t, "b", "r") in got[d]
    assert got[300] == [(None, "b", "r")]


def test_license_base_and_templates(docs, texts):
    phrases = [(p.split(), label) for p, label in licenses.PHRASES]

    def one(d, t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
        places = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))

    out = licenses.scan(docs)
    assert by_id(out, "n_words", "n_base", "first_word", "last_word", "base_labels") == expected(texts, one)
    labels = {k: v[0] for k, v in by_id(out, "labels", "score").items()}
    assert labels[309][0].split(",") == ["apache", "apache-2.0", "cc-by", "mit", "mit-release"]
    assert labels[311] == ("mit-grant", 1.0)
    assert labels[300] == ("", 0.0)


def test_line_dedup(docs, texts):
    key = lambda x: fold(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(d)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= 3}

    def one(d, t):
        lines = t.split("\n")
        kept = [x for x in lines if not (key(x) in hot and d < hot[key(x)])]
        return len(lines), len(lines) - len(kept), "\n".join(kept)

    out = linededup.dedup_lines(docs, batches=3, fanout=2)
    assert by_id(out, "n_lines", "n_dropped", "kept_text") == expected(texts, one)
    assert hot


def test_line_dedup_counts_rows_without_doc_id(spark):
    line = "a line of well over twenty characters"
    rows = [(k, f"{k} is a line of its own, once only") for k in range(6)] + [(2, line), (4, line), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 3):
        out = linededup.dedup_lines(docs, batches=batches).filter(F.col("text") == line).collect()
        assert {r["doc_id"]: r["n_dropped"] for r in out} == {2: 1, 4: 0, None: 0}, batches


def test_bpe_round_trip(docs, texts):
    import tiktoken

    f = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def one(d, t):
        ids = enc.encode_ordinary(t)
        return len(ids), sha(",".join(map(str, ids))), sha(t)

    assert by_id(bpe.round_trip_digest(docs, f, P.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256") == expected(texts, one)
    back = bpe.decode(bpe.encode(docs, f, P.PATTERN), f, P.PATTERN)
    assert by_id(back, "bytes") == expected(texts, lambda d, t: (t.encode(),))


@pytest.mark.parametrize("text", ["a b  c 'S x's " * 30, "don't 12 ab!'s  \n x " * 30, "é è 12a ' s" * 40, "x" * 500, "\x1c a \x85 b  c" * 30])
def test_safe_pieces_encode_like_the_whole(text):
    enc, _ = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for size in (1, 5, 17, 100):
        parts = list(bpe.safe_pieces(text, size))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_packing_deals_one_doc_id_over_all_shards(spark):
    same = spark.range(0, 4000, numPartitions=3).select(F.lit(7).alias("doc_id"), F.lit(0).alias("piece"))
    sizes = [r["count"] for r in packing.deal(same, 10, 0).groupBy("shard").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 520
    one = same.select("doc_id", "piece", F.lit(0).alias("start"), F.lit(700).alias("length"), F.lit(1).alias("ids_crc32"))
    assert packing.pack(one, shard_pieces=500).select("sequence_id").distinct().count() <= 2010  # two to a sequence; 2000 at best


def test_packing_pieces_and_sequences(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    want = {}
    for d, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            want.setdefault(d, []).append((k, s, min(2048, len(ids) - s), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())))
    for shard in (20_000, 16):
        out = packing.pack_documents(docs, P.path("word_bpe_49k.json"), shard_pieces=shard).cache()
        assert by_id(out, "piece", "start", "length", "ids_crc32") == {k: sorted(v, key=repr) for k, v in want.items()}
        seqs = {}
        for r in out.collect():
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for rows in seqs.values():
            at = 0
            for offset, n in sorted(rows):
                assert offset == at
                at += n
            assert at <= 2048
        least = -(-sum(n for v in want.values() for _, _, n, _ in v) // 2048)
        assert len(seqs) == least if shard == 20_000 else len(seqs) <= least + 3


def test_local_search_empties_bins():
    bad = [[0], [1], [2], [3], [4], [5]]  # a poor start: moves and swaps must empty bins
    assert len(packing.local_search([6, 6, 5, 5, 4, 4], bad, 10)) == 3
    rng = np.random.default_rng(8)
    gained = 0
    for lengths in (rng.integers(1, 2048, 3000), rng.integers(500, 900, 3000), rng.integers(200, 1500, 3000), np.full(500, 1100), np.concatenate([rng.integers(1000, 1100, 400), rng.integers(900, 1000, 400)])):
        lengths = lengths.tolist()
        starts = [packing.in_order(lengths, 2048), packing.falling(lengths, 2048)]
        better = packing.best_packing(lengths, 2048)
        assert sorted(i for b in better for i in b) == list(range(len(lengths)))
        assert all(0 < sum(lengths[i] for i in b) <= 2048 for b in better)
        assert -(-sum(lengths) // 2048) <= len(better) <= min(map(len, starts))
        gained += min(map(len, starts)) - len(better)
        for start in starts:
            squares = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
            assert squares(packing.local_search(lengths, start, 2048)) >= squares(start)
    assert gained > 50  # bins that neither start could spare


def test_search_gives_fewer_sequences(spark):
    lengths = np.random.default_rng(9).integers(200, 1500, 6000).tolist()
    cut = spark.createDataFrame([(i, 0, 0, n, 1) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").coalesce(2)
    plain, searched = (packing.pack(cut, shard_pieces=1500, search=s).select("sequence_id").distinct().count() for s in (False, True))
    least = -(-sum(lengths) // 2048)
    assert searched < plain and searched <= least + 5, (plain, searched, least)


def test_language_contract(docs, texts):
    out = by_id(langid.identify_held_out(docs), "held_out", "lang_pred", "score")
    for d, t in texts:
        for held, lang, score in out[d]:
            assert held == (zlib.crc32(str(d).encode()) % 3 == 1)
            assert 0 <= score <= 1
            if not t or not any(c.isalpha() for c in t):
                assert (lang, score) == ("und", 0.0)
            else:
                assert lang in {"en", "de", "fr", "ja"}


def test_cross_parse_counts_greedy_phrases():
    sample = (("a", "abcabcabd xyz"), ("b", "zzz yyy xxx"))
    p = langid.Parser(sample)
    text = "abcabd xyzz qabq"

    def greedy(ref, s):
        n = i = 0
        while i < len(s):
            j = i
            while j < len(s) and s[i : j + 1] in ref:
                j += 1
            i, n = max(j, i + 1), n + 1
        return n

    counts, _, _ = p.phrases([text, "", "ab"])
    assert counts[0].tolist() == [greedy("abcabcabd xyz", text), greedy("zzz yyy xxx", text)]
    assert counts[1].tolist() == [0, 0] and counts[2].tolist() == [1, 2]


def test_languages_have_their_own_letters(spark):
    """Two languages in a script of 2,000 letters each with a shared half, 70 more languages, and short texts."""
    rng = np.random.default_rng(4)
    rows = []
    for lang, first in (("x1", 0x4E00), ("x2", 0x4E00 + 1000)):
        words = ["".join(chr(first + int(k)) for k in rng.integers(0, 2000, 2)) for _ in range(900)]
        rows += [(lang, "".join(rng.choice(words, 120))) for _ in range(40)]
    rows += [(f"l{k}", "".join(chr(97 + k % 23 + int(j)) for j in rng.integers(0, 4, 60))) for k in range(70) for _ in range(4)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    sample = langid.training_sample(docs)
    assert len({lang for lang, _ in sample}) == 72
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_held_out(docs).filter("held_out").collect()}
    assert all(got[i] == lang for i, (lang, _) in enumerate(rows) if i in got and lang in ("x1", "x2"))
    more = docs.unionByName(spark.createDataFrame([(9000, rows[0][1][:1], None), (9001, rows[41][1][3:6], None)], docs.schema))
    assert langid.keep_identified(more).count() == len(rows) + 2


def test_sparse_and_dense_tables_agree():
    sample = (("a", "abcabcabd xyz abd"), ("b", "zzz yyy xxx"))
    texts = ["abcabd xyzz qabq", "", "ab", "q", "zzzyyx abd"]
    assert (langid.Parser(sample).phrases(texts)[0] == langid.Parser(sample, 0).phrases(texts)[0]).all()


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify_held_out(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    n, good = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert good / n > 0.95


def test_keep_identified_keeps_columns(docs):
    out = langid.keep_identified(docs)
    assert out.columns == docs.columns
    ids = {r["doc_id"] for r in out.collect()}
    assert {300, 301, 302, 305}.isdisjoint(ids) and {0, 303, 312} <= ids


def test_rule_statistics(docs, texts):
    def one(d, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        c, hit = Counter(win), set()
        for i, x in enumerate(win):
            if c[x] > 1:
                hit.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    assert by_id(quality_rules.statistics(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == expected(texts, one)
    assert textstats.repeated_words(np.array([1, 2, 3, 4, 5, 6, 7, 8] * 2)) == 16


def test_quality_without_labels(docs, spark, texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = by_id(quality_rules.judge(docs, none), "base_failed", "kept")
    assert all(failed != kept for v in out.values() for failed, kept in v)
    assert by_id(site_quality.classify(docs, none), "kept") == expected(texts, lambda d, t: (True,))


def test_quality_finds_poor_and_keeps_good(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for out in (quality_rules.judge(docs, labels), site_quality.classify(docs, labels)):
        rows = out.join(labels, "doc_id").select("quality", "kept", *(["base_failed"] if "base_failed" in out.columns else [F.lit(False).alias("base_failed")])).collect()
        good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
        poor = [r["kept"] for r in rows if r["quality"] == 0]
        assert sum(good) >= 0.97 * len(good) and sum(poor) <= 0.5 * len(poor)


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    f, w = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
    for out in (secrets.scan(empty), secrets.redact(empty), licenses.scan(empty), linededup.dedup_lines(empty), langid.identify_held_out(empty), langid.keep_identified(empty), packing.pack_documents(empty, w), quality_rules.judge(empty, labels), bpe.round_trip_digest(empty, f, P.PATTERN), site_quality.classify(empty, labels)):
        assert out.count() == 0
