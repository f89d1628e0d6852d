"""Parities of long sets spare pairs that aren't alike the reading of their texts, and lose no link."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import ngram_join as nj


def test_long_texts_that_share_a_passage_are_not_read(spark, monkeypatch):
    """12 texts share 800 of 4,000 words, which 1,024 bits can't tell from alike; two copies, one across a doubling, are linked."""
    run = lambda tag, n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit(tag), i))
    own = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), F.col("id"), F.lit("x"), i))
    apart = spark.range(0, 12, 1, 12)
    row = lambda where, more, *words: apart.filter(where).select((F.col("id") + more).alias("doc_id"), F.array_join(F.concat(*words), " ").alias("text"))
    docs = row("true", 0, run("p", 800), own(3200)).unionByName(row("id = 3", 100, run("p", 800), own(3200), run("n", 40)))
    docs = docs.unionByName(row("id = 5", 200, own(2040))).unionByName(row("id = 5", 300, own(2040), run("m", 60)))
    read = []
    verified = nj.verified

    def counted(docs, pairs, *args, **kwargs):
        read.extend(map(tuple, pairs.collect()))
        return verified(docs, pairs, *args, **kwargs)

    monkeypatch.setattr(nj, "verified", counted)
    got = nj.join_components(docs)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {**{k: k for k in range(12)}, 103: 3, 205: 205, 305: 205}
    assert len({frozenset(p) for p in read}) == 2


@pytest.mark.parametrize("n, m", [(1500, 1500), (2040, 2100), (900, 1030)])
def test_wide_parities_differ_in_no_more_places_than_the_sets(spark, n, m):
    rng = np.random.default_rng(n)
    every = rng.integers(0, 1 << 63, m, np.uint64)
    x, y = every[:n], np.append(every[: m - 50], rng.integers(0, 1 << 63, 50, np.uint64))
    rows = [[None if p is None else p.tolist() for p in map(nj.wide_parities, (x, y))]]
    held = spark.createDataFrame(rows, "x array<long>, y array<long>")
    least = len(np.setxor1d(x, y))
    # with a threshold of 0 and sizes that equal the difference a pair passes while its bits are no more than that
    assert held.filter(nj.may_reach_wide(F.col("x"), F.col("y"), F.lit(least), 0)).count() == 1
    if n > nj.PARITY:
        other = rng.integers(0, 1 << 63, m, np.uint64)
        far = spark.createDataFrame([[nj.wide_parities(x).tolist(), nj.wide_parities(other).tolist()]], "x array<long>, y array<long>")
        assert far.filter(nj.may_reach_wide(F.col("x"), F.col("y"), F.lit(n + m), nj.THRESHOLD)).count() == 0
