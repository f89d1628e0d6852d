"""Models and thresholds come from all labelled rows, however many they are."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import quality_rules, site_quality
from cueloom.llm.textstats import STATS, features


@pytest.fixture(scope="module")
def marked(spark):
    """40,000 labelled rows, more than any sample the fits once took."""
    near = lambda base, spread, k: F.lit(base) + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(spread))
    rows = spark.range(0, 40_000, 1, 6).select(F.col("id").alias("doc_id"))
    poor = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(10)) == 0
    cols = [F.when(poor & F.lit(k in (2, 3)), near(40, 60, k)).otherwise(near(10 * (k == 0) + 1, 50, k)).cast("long").alias(c) for k, c in enumerate(STATS)]
    return rows.select("doc_id", F.when(poor & (F.col("doc_id") % 5 > 0), 0).otherwise(1).alias("quality"), *cols).localCheckpoint()


@pytest.mark.parametrize("n,kinds", [(40_000, 997), (40_000, 10**9), (7, 3)])
def test_threshold_over_all_rows(spark, n, kinds):
    value = F.pmod(F.xxhash64("id"), F.lit(kinds)) / F.lit(float(kinds))
    rows = spark.range(0, n, 1, 5).select(value.alias("score"), F.when(F.rand(3) < value * value, 0).otherwise(1).alias("quality"))
    held = [(r["score"], r["quality"]) for r in rows.collect()]
    want = quality_rules.best_threshold(np.array([s for s, _ in held]), np.array([q == 0 for _, q in held]), 0.7)
    assert quality_rules.threshold_over(rows, 0.7) == pytest.approx(want, abs=1e-15)


def test_threshold_sees_a_single_row(spark):
    """One poor row above 40,000 others."""
    rows = spark.range(0, 40_001, 1, 5).select((F.col("id") / 40_000).alias("score"), F.when(F.col("id") == 40_000, 0).otherwise(1).alias("quality"))
    assert quality_rules.threshold_over(rows) == pytest.approx((40_000 + 39_999) / 80_000)
    assert quality_rules.threshold_over(rows.filter("quality = 1")) == math.inf


def test_forest_counts_all_rows(marked):
    forest = quality_rules.grow(marked.drop("quality"), marked)
    rows = marked.toPandas()
    x = features({c: rows[c].to_numpy() for c in STATS})
    good = rows["quality"].to_numpy() == 1
    want = quality_rules.Forest(x[good], x)
    assert np.allclose(forest.score(x[:500]), want.score(x[:500]))
    cuts = quality_rules.Cuts(x.min(axis=0), x.max(axis=0))
    assert cuts.count(x[good]).sum() == good.sum() * quality_rules.TREES


def test_logistic_fit_over_all_rows(marked):
    rows = marked.toPandas()
    x, y = features({c: rows[c].to_numpy() for c in STATS}), rows["quality"].to_numpy()
    mean, scale, w = site_quality.fit_logistic(marked, len(y))
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(scale, np.maximum(x.std(axis=0), 1e-9))
    z = np.column_stack([np.clip((x - mean) / scale, -6, 6), np.ones(len(x))])
    p = 1 / (1 + np.exp(-(z @ w)))
    assert np.abs(z.T @ (y - p) - 1e-4 * len(y) * w).max() < 1e-3 * len(y) ** 0.5
