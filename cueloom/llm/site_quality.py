"""Quality classifier: document evidence shrunk by its site, as hierarchical empirical Bayes.

A logistic classifier on rule statistics, fitted on all labelled rows, gives every
document a probability of being good. Grouped aggregation sums votes by host and by path (here:
source, and source with language); a labelled document votes by its label, any other by its
probability. A path's share is shrunk towards its host's, a host's towards the global share, each
with a prior strength estimated from how much sites differ from what stands above them, so a sparse
site says little. A document
sees its site without its own vote. Its verdict adds its evidence and its path's shift from the global
share, in log odds; the threshold is calibrated on all labelled rows.

Defined results: null texts have no words and are judged from zeros; a null source or language is a
site of its own. Without labelled rows of both kinds all documents get the global share 0.5 and are
kept. Several labels of one doc_id count by their mean. Repeated rows are judged each on their own.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize
from .quality_rules import batch_features, sum_over, threshold_over
from .textstats import STATS, features, measure

#: Log odds of document evidence and of a site's shift are held within these bounds.
MAX_EVIDENCE, MAX_SHIFT = 8.0, 2.0
LOSS_WEIGHT = 50.0


def fit_logistic(rows: DataFrame, n: int, *, ridge: float = 1e-2, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the last is the intercept) over all n rows(quality, statistics), by Newton steps.

    Every step is one pass of sums; its gradient and Hessian are all that the driver gets.
    """
    total = lambda size, add: _dense(size, *sum_over(rows.select("quality", *STATS), add))
    terms = len(features({c: np.zeros(1) for c in STATS})[0])
    mean = total(terms, lambda b: batch_features(b).sum(axis=0)) / n
    scale = np.maximum(np.sqrt(total(terms, lambda b: ((batch_features(b) - mean) ** 2).sum(axis=0)) / n), 1e-9)
    w = np.zeros(terms + 1)
    for _ in range(steps):

        def slope(b: pa.RecordBatch, w: np.ndarray = w.copy()) -> np.ndarray:
            x = batch_features(b)
            z = np.column_stack([np.clip((x - mean) / scale, -6, 6), np.ones(len(x))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.concatenate([z.T @ (b.column(0).to_numpy() - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        held = total(len(w) + len(w) ** 2, slope)
        hess = held[len(w) :].reshape(len(w), -1) + ridge * n / 100 * np.eye(len(w))
        step = np.linalg.solve(hess, held[: len(w)] - ridge * n / 100 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _dense(size: int, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros(size)
    out[at] = v
    return out


def _evidence(stats: DataFrame, model) -> DataFrame:
    """stats with evidence: the classifier's log odds."""
    mean, scale, w = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.clip((batch_features(b) - mean) / scale, -6, 6) @ w[:-1] + w[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.clip(z, -MAX_EVIDENCE, MAX_EVIDENCE))], names=["doc_id", "host", "path", "evidence"])

    return stats.select("doc_id", "host", "path", *STATS).mapInArrow(run, "doc_id long, host string, path string, evidence double")


def _strength(sites: DataFrame) -> float:
    """Pseudo-counts of the prior, by moments: the less sites differ beyond chance from what stands above them, the stronger.

    sites: above (what they belong to), prior (the share there), n, good. Differences between the
    groups above are not the sites' own and don't count.
    """
    each = sites.filter("n > 0").groupBy("above", "prior").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), 2)).alias("ss"), (F.count(F.lit(1)) - 1).alias("free"), F.sum(F.col("n") * F.col("n")).alias("nn")
    )
    within = F.col("prior") * (1 - F.col("prior"))
    r = each.agg(F.sum("free").alias("free"), F.sum(F.col("ss") - F.col("free") * within).alias("excess"), F.sum(F.col("n") - F.col("nn") / F.col("n")).alias("spread"), (F.sum(F.col("n") * within) / F.sum("n")).alias("within")).first()
    if not r["free"]:
        return 100.0
    between = max(1e-6, r["excess"] / max(1e-9, r["spread"]))
    return min(1e6, max(1.0, r["within"] / between - 1))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence, site_share, score (0 to 1) and kept for every row of docs(doc_id, text, source, lang)."""
    site = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("path"), "text")
    stats = materialize(_site_statistics(site), "site_stats")
    known = labels.filter("quality in (0, 1)").select("doc_id", "quality")
    held = materialize(stats.join(known, "doc_id").select("quality", *STATS), "marked")
    n = held.agg(F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("quality") == 1).alias("good")).first()
    if not n["poor"] or not n["good"]:
        return stats.select("doc_id", F.lit(0.0).alias("evidence"), F.lit(0.5).alias("site_share"), F.lit(0.5).alias("score"), F.lit(True).alias("kept"))
    judged = materialize(_evidence(stats, fit_logistic(held, n["poor"] + n["good"])), "evidence")

    labelled = known.groupBy("doc_id").agg(F.avg("quality").alias("label"))
    votes = materialize(judged.join(labelled, "doc_id", "left").select("doc_id", "host", "path", "evidence", F.coalesce("label", 1 / (1 + F.exp(-F.col("evidence")))).alias("vote")), "votes")
    paths = materialize(votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("vote").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    share = whole["good"] / whole["n"]
    m_host = _strength(hosts.select(F.lit(0).alias("above"), F.lit(share).alias("prior"), F.col("host_n").alias("n"), F.col("host_good").alias("good")))
    sites = paths.join(hosts, "host")
    m_path = _strength(sites.select(F.col("host").alias("above"), ((F.col("host_good") + m_host * share) / (F.col("host_n") + m_host)).alias("prior"), "n", "good"))
    of_host = (F.col("host_good") - F.col("vote") + m_host * share) / (F.col("host_n") - 1 + m_host)
    of_path = (F.col("good") - F.col("vote") + m_path * of_host) / (F.col("n") - 1 + m_path)
    shift = F.greatest(F.least(_logit(F.col("site_share")) - math.log(share / (1 - share)), F.lit(MAX_SHIFT)), F.lit(-MAX_SHIFT))
    seen = votes.join(sites, ["host", "path"]).select("doc_id", "evidence", of_path.alias("site_share"))
    scored = materialize(seen.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + shift)))), "scored")
    threshold = threshold_over(scored.join(known, "doc_id").select((-F.col("score")).alias("score"), "quality"), LOSS_WEIGHT)
    return scored.withColumn("kept", ~(-F.col("score") > F.lit(threshold)))


def _site_statistics(site: DataFrame) -> DataFrame:
    """host, path and the rule statistics of every text, gathered in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py() or "") for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array([r[c] for r in rows], pa.int64()) for c in STATS)], names=["doc_id", "host", "path", *STATS])

    schema = "doc_id long, host string, path string, " + ", ".join(f"{c} long" for c in STATS)
    return site.select(F.col("doc_id").cast("long").alias("doc_id"), "host", "path", "text").mapInArrow(run, schema)
