"""Shingle sets of many texts are made at once, without a call or a look-up per word."""

import re

import numpy as np
import pytest

from cueloom.llm import ngram_join as nj

WORDS = ["a", "B", "b\u0000", "eightchr", "ninechars", "sixteen_letters_", "seventeen_letters", "日本語の長い単語がここに", "x" * 63, "x" * 64, "x" * 65, "Y" * 400, " "]


def _sets(texts):
    """Tuples of words, by the contract's words and windows."""
    out = []
    for t in texts:
        words = re.split(rb"[\x20\x09-\x0D]+", t.encode().translate(nj.FOLD).strip(b" \t\n\v\f\r"))
        words = [w for w in words if w]
        n = min(nj.WIDTH, len(words))
        out.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set())
    return out


def _texts(n=300):
    rng = np.random.default_rng(5)
    seps = [" ", "\n", "\t ", "\r\n", "\v", "\f", "  "]
    text = lambda k: "".join(str(rng.choice(WORDS)) + str(rng.choice(seps)) for _ in range(k))
    texts = [text(int(k)) for k in rng.integers(0, 30, n)]
    return ["", " ", "\n\n", "one", " one two three ", "one two three four", *texts, *texts[:5], "lasté"]


def test_sets_of_many_texts_are_those_of_each():
    texts = _texts()
    want, got = _sets(texts), nj.Shingler().sets(texts)
    assert list(map(len, got)) == list(map(len, want))
    for t, x in zip(texts, got):
        assert (x[1:] > x[:-1]).all() and np.array_equal(x, nj.Shingler().shingles(t))
    named = {}
    for x, w in zip(got, want):
        assert named.setdefault(frozenset(w), x.tobytes()) == x.tobytes()
    assert len(set(named.values())) == len(named)
    known = {}  # a hash stands for one shingle, wherever it is
    for x, w in zip(got, want):
        if len(w) == 1:
            assert known.setdefault(int(x[0]), w) == w


def test_words_are_hashed_together(monkeypatch):
    """Words up to LONG bytes take no call of their own."""
    xxhash = pytest.importorskip("xxhash")
    calls = []

    class Counted:
        def __getattr__(self, name):
            return getattr(xxhash, name)

        @staticmethod
        def xxh3_64_intdigest(x):
            calls.append(bytes(x))
            return xxhash.xxh3_64_intdigest(x)

    monkeypatch.setitem(__import__("sys").modules, "xxhash", Counted())
    make = nj.Shingler()
    for k in range(20):
        make.shingles(" ".join(f"word{k}_{i}" for i in range(200)) + " " + "z" * 400)
    assert len(calls) == 20 and set(calls) == {b"z" * 400}


def test_prefix_looks_at_the_beginning_first(monkeypatch):
    """The prefix is that of the whole order, however many common shingles stand first."""
    rng = np.random.default_rng(6)
    for share in (0.0, 0.1, 0.6, 1.0):
        x = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
        common = x[rng.random(len(x)) < share]
        order = nj.FirstOrder(common, rng.permutation(len(common)) + 1)
        rank = dict(zip(common.tolist(), order.rank.tolist()))
        whole = sorted(x.tolist(), key=lambda h: (rank.get(h, 0), h))
        for size in (0, 1, 61, len(x)):
            assert order.prefix(x, size).tolist() == whole[:size]
