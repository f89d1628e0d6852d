"""Exact top-k inner products with MaxScore pruning.

A vector's dimensions play the part of terms: a component is a posting with an integer impact, and
a shard (a block of candidate rows) knows for every term the least and the largest contribution it
can make to a query. Terms are ordered by the distance of the two. The last ones, by which a row
at its least in all others can't reach the threshold (a score that k rows have), are non-essential. The
essential terms are traversed for all rows of the shard; the others are probed, a few at a time,
only for rows that are still competitive, and each probe may raise the threshold.

Distribution: blocks of queries meet shards of candidates as groups of bounded size, dealt by hash,
so neither side passes through the driver or a broadcast. The first shard is searched alone; the
k-th best score that a query reaches there is the threshold it brings to all other shards. The
shards' lists are merged by a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

#: Queries in a block; candidate rows in a shard.
QUERY_BLOCK = 8192
SHARD_ROWS = 16384
#: Terms probed between two prunings.
PROBE = 4
#: Bound of absolute scores, below which no sum overflows.
MAX_SCORE = 2.0**62


def quantized(vectors: DataFrame, *, scale: int = 1024) -> DataFrame:
    """vec_id and its components as floor(scale * x); vectors with null or non-finite parts are left out, and rows without a vec_id."""
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of integers; shorter vectors have zeros in the dimensions they lack."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = max(int(sizes.max(initial=0)), width or 0)
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide)[None, :] < sizes[:, None]] = flat
    return out


def essential_terms(spread: np.ndarray, least: int, threshold: int | None) -> int:
    """How many of the terms, in falling order of spread, are essential: a row that is at its least in all of them can't reach the threshold."""
    if threshold is None:
        return len(spread)
    reach = least + np.append(np.cumsum(spread[::-1])[::-1], 0)  # of a row at its least in the first j terms
    return int(np.argmax(reach < threshold)) if reach[-1] < threshold else len(spread)


def maxscore(query: np.ndarray, own: int, ids: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a shard for one query, ties to the smaller id.

    columns: [dimension, row]; low and high: each dimension's extremes in the shard. floor: a score
    that k rows of other shards already have; rows below it may be left out.
    """
    others = ids != own
    if not others.any():
        return ids[:0], ids[:0]
    least, most = np.minimum(query * low, query * high), np.maximum(query * low, query * high)
    terms = np.argsort(least - most, kind="stable")
    terms = terms[query[terms] != 0]
    threshold = floor
    if threshold is None and len(terms) and int(others.sum()) > 4 * k:  # from the rows at the head of the first posting
        heads = np.argpartition(np.where(others, -query[terms[0]] * columns[terms[0]], np.iinfo(np.int64).max), 4 * k)[: 4 * k]
        threshold = int(np.partition(query @ columns[:, heads], 3 * k)[3 * k])
    n = essential_terms((most - least)[terms], int(least[terms].sum()), threshold)
    score = query[terms[:n]] @ columns[terms[:n]] if n else np.zeros(len(ids), np.int64)
    alive = np.flatnonzero(others)
    score = score[alive]
    while True:
        rest = terms[n:]
        if len(alive) > k:
            sure = int(np.partition(score, len(score) - k)[-k]) + int(least[rest].sum())  # k rows get at least this
            threshold = sure if threshold is None else max(threshold, sure)
        if threshold is not None:
            stay = score + int(most[rest].sum()) >= threshold
            if not stay.all():
                alive, score = alive[stay], score[stay]
        if not len(rest) or not len(alive):
            break
        probed = rest[:PROBE]
        score = score + query[probed] @ columns[np.ix_(probed, alive)]
        n += len(probed)
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][order], score[order]


def _search_group(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    names = ["query_id", "query_hash", "vec_id", "score"]
    if not queries.num_rows or not candidates.num_rows:
        return pa.Table.from_arrays([pa.array([], pa.int64())] * 4, names=names)
    column = lambda t, name: t.column(name).combine_chunks()
    ids, m = column(candidates, "vec_id").to_numpy(), _matrix(column(candidates, "v"))
    columns, low, high = np.ascontiguousarray(m.T), m.min(axis=0), m.max(axis=0)
    q = _matrix(column(queries, "query"))
    width = min(q.shape[1], m.shape[1])  # dimensions that one side lacks are zeros
    reach = (np.abs(q[:, :width].astype(np.float64)) @ np.maximum(np.abs(low[:width].astype(np.float64)), np.abs(high[:width].astype(np.float64)))).max(initial=0)
    if reach >= MAX_SCORE:
        raise OverflowError(f"inner products may reach {reach:.3g}, beyond 64-bit integers: use a smaller scale")
    out: list[list[np.ndarray]] = [[], [], [], []]
    keys = zip(column(queries, "query_id").to_pylist(), column(queries, "query_hash").to_pylist(), column(queries, "floor").to_pylist())
    for vector, (own, tag, floor) in zip(q, keys):
        got_ids, got = maxscore(vector[:width], own, ids, columns[:width], low[:width], high[:width], k, floor)
        for held, x in zip(out, (np.full(len(got), own), np.full(len(got), tag), got_ids, got)):
            held.append(x)
    return pa.Table.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=names)


def _search_shards(candidates: DataFrame, queries: DataFrame, shards: Column, blocks: int, k: int) -> DataFrame:
    """query_id, query_hash, vec_id, score: each shard's lists. candidates have their shard, queries their block; shards: those to search."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        return _search_group(q, c, k)

    left = queries.select(F.col("vec_id").alias("query_id"), "query_hash", F.col("v").alias("query"), "floor", "block", F.explode(shards).alias("shard"))
    right = candidates.select("vec_id", "v", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(run, "query_id long, query_hash long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _few_copies(candidates: DataFrame, k: int) -> DataFrame:
    """candidates with at most k copies of a row (one vec_id and vector): no list can show more, and copies land in one shard."""
    tagged = candidates.withColumn("tag", F.xxhash64("v"))
    many = tagged.groupBy("vec_id", "tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k).select("vec_id", "tag")
    one = tagged.join(many, ["vec_id", "tag"], "left_semi").groupBy("vec_id", "tag").agg(F.any_value("v").alias("v"))
    copies = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return tagged.join(many, ["vec_id", "tag"], "left_anti").select("vec_id", "v").unionByName(copies.select("vec_id", "v"))


def search(candidates: DataFrame, queries: DataFrame, *, k: int = 10, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k best candidates of every query: query_id, rank, vec_id, score. Both inputs: vec_id, v (integers).

    A query never finds rows of its own vec_id; rows that repeat another vec_id each count. Queries
    equal in id and vector are one; those of one id and different vectors get a list each, under the
    same id. An empty side gives an empty result; with fewer candidates a query returns them all.
    Rows without a vec_id take no part. Components so large that a score could pass 2^62 raise an
    OverflowError; none is ever wrapped.
    """
    queries, candidates = queries.filter(F.col("vec_id").isNotNull()), candidates.filter(F.col("vec_id").isNotNull())
    queries = queries.select("vec_id", "v", F.xxhash64("v").alias("query_hash")).dropDuplicates(["vec_id", "query_hash"])
    blocks = max(1, -(-queries.count() // query_block))
    shards = max(1, -(-candidates.count() // shard_rows))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    queries = queries.withColumn("block", deal(blocks))
    candidates = _few_copies(candidates.select("vec_id", "v"), k).select("vec_id", "v", deal(shards).alias("shard"))
    first = _search_shards(candidates.filter("shard = 0"), queries.withColumn("floor", F.lit(None).cast("long")), F.array(F.lit(0)), blocks, k)
    if shards == 1:
        return _best(first, k).select("query_id", "rank", "vec_id", "score")
    first = materialize(_best(first, k), "first_shard")
    reached = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "query_hash", F.col("score").alias("floor"))
    rest = _search_shards(candidates.filter("shard > 0"), queries.join(reached, ["vec_id", "query_hash"], "left"), F.sequence(F.lit(1), F.lit(shards - 1)), blocks, k)
    return _best(first.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
