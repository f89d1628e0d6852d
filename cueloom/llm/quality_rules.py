"""Quality rules judged by an isolation forest.

The rule statistics of every whole text are gathered once. A forest of random splits is drawn from the
box of all labelled rows, and every good row is counted in every tree; documents that few splits set
apart have short paths and are anomalous. The threshold comes from all labelled rows: the score that
best parts poor from good ones, a lost good document weighing LOSS_WEIGHT times a missed poor one.

Defined results: a null text has no words and fails the base rules. Repeated rows are judged each
on their own. Without labelled rows nothing but the base rules rejects. With fewer than TREE_ROWS good
rows all rows are counted instead. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize
from .textstats import STATS, features, measure

#: Trees, and the rows that one tree stands for: a node holds its share of all counted rows, as if so many had been dealt to the tree.
TREES, TREE_ROWS = 256, 256
#: Levels of a tree beyond log2 of its rows, since cuts may fall where no row is.
EXTRA_DEPTH = 4
LOSS_WEIGHT = 20.0
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the rule statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[c] for r in rows], pa.int64()) for c in STATS)], names=["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def sum_over(rows: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums, where not 0, of the arrays that add() gives for batches of all rows. The driver gets one array's length at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = add(b) if total is None else total + add(b)
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.float64))], names=["k", "v"])

    got = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    return got.column("k").to_numpy(), got.column("v").to_numpy()


def batch_features(b: pa.RecordBatch) -> np.ndarray:
    return features({c: b.column(b.schema.get_field_index(c)).to_numpy() for c in STATS})


def _average_path(n):
    """Mean depth of an unsuccessful search in a random binary tree of n rows, between whole numbers too."""
    n = np.asarray(n, np.float64)
    of = lambda m: 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    return np.where(n >= 3, of(np.maximum(n, 3)), np.interp(n, [1, 2, 3], [0, 1, of(3.0)]))


class Cuts:
    """Random cuts of full binary trees, level by level: they hang on the box only, so that any number of rows can be counted.

    Cuts are drawn from the node's box, not from between its rows: the root's box spans rows of every
    kind, so a statistic that is the same in all ordinary rows still sets others apart.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, *, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7):
        rng, free = np.random.default_rng(seed), np.flatnonzero(high > low)
        self.deep = (max(1, math.ceil(math.log2(max(2, rows)))) + EXTRA_DEPTH) if len(free) else 0
        self.trees = [self._draw(low[None], high[None], free, rng) for _ in range(trees)]

    def _draw(self, low: np.ndarray, high: np.ndarray, free: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
        feature, cut = [np.empty(0, np.int8)], [np.empty(0)]
        for _ in range(self.deep):
            each, f = np.arange(len(low)), rng.choice(free, len(low))
            at = rng.uniform(low[each, f], high[each, f])
            feature.append(f.astype(np.int8)), cut.append(at)
            low, high = low.repeat(2, axis=0), high.repeat(2, axis=0)
            high[::2][each, f] = low[1::2][each, f] = at
        return np.concatenate(feature), np.concatenate(cut)

    def count(self, x: np.ndarray) -> np.ndarray:
        """Rows by tree and leaf, the leaves of a tree behind those of the tree before."""
        leaves, each, out = 2**self.deep, np.arange(len(x)), []
        for feature, cut in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.deep):
                at = 2 * at + 1 + (x[each, feature[at]] > cut[at])
            out.append(np.bincount(at - (leaves - 1), minlength=leaves))
        return np.concatenate(out)


class Forest:
    """Isolation trees in flat arrays, so that a whole batch walks down together. A node whose share is one row of `rows` or less is a leaf."""

    def __init__(self, x: np.ndarray, among: np.ndarray | None = None, *, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7):
        among = x if among is None else among
        cuts = Cuts(among.min(axis=0), among.max(axis=0), trees=trees, rows=min(rows, len(x)), seed=seed)
        self._settle(cuts, cuts.count(x), len(x), rows)

    @classmethod
    def counted(cls, cuts: Cuts, counts: np.ndarray, n: int, rows: int = TREE_ROWS) -> Forest:
        """The forest of cuts in which n rows have been counted."""
        made = cls.__new__(cls)
        made._settle(cuts, counts, n, rows)
        return made

    def _settle(self, cuts: Cuts, counts: np.ndarray, n: int, rows: int) -> None:
        self.rows, self.deep = min(rows, n), cuts.deep
        share = counts.reshape(len(cuts.trees), -1) * (self.rows / n)
        self.trees = [self._prune(f, c, m) for (f, c), m in zip(cuts.trees, share)]

    def _prune(self, feature: np.ndarray, cut: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, ...]:
        levels = [share]
        while len(levels[0]) > 1:
            levels.insert(0, levels[0].reshape(-1, 2).sum(axis=1))
        out, at, first = [], np.zeros(1, np.int64), 0
        for depth, level in enumerate(levels):
            held, me = level[at], first + np.arange(len(at))
            go = np.flatnonzero(held > 1 + 1e-9) if depth < self.deep else np.empty(0, np.int64)
            f, c, kids = np.zeros(len(at), np.int64), np.full(len(at), np.inf), np.column_stack([me, me])
            node = 2**depth - 1 + at[go]
            first += len(at)
            f[go], c[go] = feature[node], cut[node]
            kids[go] = first + np.arange(2 * len(go)).reshape(-1, 2)
            out.append((f, c, kids, depth + _average_path(held)))
            at = (2 * at[go][:, None] + [0, 1]).ravel()
        return tuple(np.concatenate(p) for p in zip(*out))

    def score(self, x: np.ndarray) -> np.ndarray:
        """1: set apart at once; about 0.5 and less: ordinary."""
        total, each = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, kids, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.deep):
                at = kids[at, (x[each, feature[at]] > cut[at]).astype(np.int64)]
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(_average_path(self.rows), 1e-9))


def _best_prefix(scores: np.ndarray, poor: np.ndarray, good: np.ndarray, per_poor: float, per_good: float) -> int:
    """Falling different scores with their rows: the first place up to which rejected rows gain most."""
    return int(np.argmax(np.cumsum(poor) * per_poor - np.cumsum(good) * per_good))


def best_threshold(scores: np.ndarray, poor: np.ndarray, weight: float = LOSS_WEIGHT) -> float:
    """The score above which poor rows outweigh good ones most (inf: nowhere), halfway to the next lower score."""
    each, of = np.unique(-np.asarray(scores, np.float64), return_inverse=True)
    if not len(each):
        return math.inf
    n_poor, n_good = np.bincount(of, poor), np.bincount(of, ~poor)
    per_poor, per_good = 1 / max(1, n_poor.sum()), weight / max(1, n_good.sum())
    k = _best_prefix(-each, n_poor, n_good, per_poor, per_good)
    gain = n_poor[: k + 1].sum() * per_poor - n_good[: k + 1].sum() * per_good
    return _between(-each[k], -each[k + 1] if k + 1 < len(each) else None) if gain > 0 else math.inf


def _between(score: float, lower: float | None) -> float:
    return float(np.nextafter(score, -np.inf)) if lower is None else float((score + lower) / 2)


def threshold_over(rows: DataFrame, weight: float = LOSS_WEIGHT) -> float:
    """best_threshold() of all rows(score, quality), which are dealt by ranges of scores.

    The best place within a range is the same whatever stands above it, so a range gives one row:
    its ends, its counts, and its best place.
    """
    n = rows.agg(F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("quality") == 1).alias("good")).first()
    if not n["poor"] or not n["good"]:
        return math.inf
    per_poor, per_good = 1 / n["poor"], weight / n["good"]
    fall = rows.groupBy((-F.col("score")).alias("fall")).agg(F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("quality") == 1).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = best = after = None
        poor = good = best_poor = best_good = 0
        for b in batches:
            if not b.num_rows:
                continue
            s, p, g = (b.column(k).to_numpy() for k in range(3))
            first, after = s[0] if first is None else first, s[0] if best is not None and best == last else after
            k = _best_prefix(s, p, g, per_poor, per_good)
            at_poor, at_good = poor + int(p[: k + 1].sum()), good + int(g[: k + 1].sum())
            if best is None or at_poor * per_poor - at_good * per_good > best_poor * per_poor - best_good * per_good:
                best, after, best_poor, best_good = s[k], s[k + 1] if k + 1 < len(s) else None, at_poor, at_good
            last, poor, good = s[-1], poor + int(p.sum()), good + int(g.sum())
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"first": first, "best": best, "after": after, "poor": poor, "good": good, "best_poor": best_poor, "best_good": best_good}], schema=target)

    target = pa.schema([(c, pa.float64()) for c in ("first", "best", "after")] + [(c, pa.int64()) for c in ("poor", "good", "best_poor", "best_good")])
    parts = fall.repartitionByRange("fall").sortWithinPartitions("fall").mapInArrow(run, "first double, best double, after double, poor long, good long, best_poor long, best_good long")
    most, threshold, poor, good = 0.0, math.inf, 0, 0
    ranges = sorted(parts.collect(), key=lambda r: r["first"])  # a row per range
    for r, below in zip(ranges, [*ranges[1:], None]):
        gain = (poor + r["best_poor"]) * per_poor - (good + r["best_good"]) * per_good
        if gain > most:
            after = r["after"] if r["after"] is not None else below["first"] if below else None
            most, threshold = gain, _between(-r["best"], None if after is None else -after)
        poor, good = poor + r["poor"], good + r["good"]
    return threshold


def grow(stats: DataFrame, marked: DataFrame) -> Forest | None:
    """The forest over all good rows of marked(quality, statistics), or over all of stats where they are few."""
    n = marked.agg(F.count(F.lit(1)).alias("held"), F.count_if(F.col("quality") == 1).alias("good")).first()
    base, size = (marked.filter("quality = 1"), n["good"]) if n["good"] >= TREE_ROWS else (stats, stats.count())
    if not size:
        return None

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = batch_features(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], names=["f", "low", "high"])

    box = (marked if n["held"] else base).select(*STATS).mapInArrow(ends, "f long, low double, high double").groupBy("f").agg(F.min("low"), F.max("high"))
    _, low, high = zip(*sorted(box.collect()))  # a row per feature
    cuts = Cuts(np.array(low), np.array(high), rows=min(TREE_ROWS, size))
    sent = stats.sparkSession.sparkContext.broadcast(cuts)
    at, counted = sum_over(base.select(*STATS), lambda b: sent.value.count(batch_features(b)))
    counts = np.zeros(len(cuts.trees) * 2**cuts.deep)
    counts[at] = counted
    return Forest.counted(cuts, counts, size)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly."""
    stats = materialize(statistics(docs), "rule_stats")
    known = labels.filter("quality in (0, 1)").select("doc_id", "quality")
    forest = grow(stats, materialize(stats.join(known, "doc_id"), "marked"))
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = sent.value
        for b in batches:
            scores = grown.score(batch_features(b)) if grown is not None and b.num_rows else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(scores)], names=["doc_id", *STATS[:5], "anomaly"])

    scored = materialize(stats.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, anomaly double"), "scored")
    threshold = threshold_over(scored.join(known, "doc_id").select(F.col("anomaly").alias("score"), "quality"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select("doc_id", *STATS[:5], failed.alias("base_failed"), (~failed & ~(F.col("anomaly") > F.lit(threshold))).alias("kept"), "anomaly")
