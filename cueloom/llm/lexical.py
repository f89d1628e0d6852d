"""Ranked lexical search by Block-Max MaxScore over an inverted index of document shards.

build_index: one pass over the whole texts. A shard is a run of documents of one partition, bounded
in documents and terms. For every term it holds one posting list, cut into blocks of BLOCK postings;
a block is packed bytes (document steps and frequencies in as many bytes as its largest needs), its
first document, and its front: the (frequency, length) pairs that no other of the block beats in
both. Since a score rises with the frequency and falls with the length, the front gives the block's
exact maximum under any corpus statistics, before the block is unpacked.

search: a term's weight comes from its document frequency over all shards. Per query and shard:

1. Lists are ordered by their bound (weight times the largest block maximum). Those first ones whose
   bounds sum to less than the threshold are non-essential: a document in them alone can't reach it.
2. Essential lists are traversed and give the candidates; as the threshold rises, lists leave them.
3. For each candidate the maxima of the blocks that may hold it, of all non-essential lists, are
   added up; who can't reach the threshold is rejected before any of these blocks is unpacked. The
   others are looked up list by list and dropped as soon as their bound falls short.

Distribution: blocks of queries meet groups of shards, dealt by hash, as groups of bounded size. One
group is searched first; a query's k-th best score there is the threshold that it brings to all
others. Each group keeps a query's k best; a window merges them.

Defined results: a null text, and one without terms, is in no list and counts in no statistic.
Every row is a document of its own, also when it repeats a doc_id; rows without a doc_id are found
and come last among equal scores. Queries equal in id and text are one; those of one id and different
texts get a list each under that id. A query without terms finds nothing, and so does any query on
an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize

#: Postings in a block; documents and terms at which a shard is full (one text may hold more terms).
BLOCK = 64
SHARD_DOCS, SHARD_TERMS = 1 << 15, 1 << 21
#: Bytes of postings in a group of shards; queries in a block.
GROUP_BYTES, QUERY_BLOCK = 64 << 20, 4096

#: Term bytes are digits, ASCII letters (lower-cased) and all of non-ASCII characters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = np.iinfo(np.int64).max

INDEX = (
    "shard long, term string, df int, first array<int>, at array<int>, step_bytes array<tinyint>, tf_bytes array<tinyint>, "
    "front_at array<int>, front_tf array<int>, front_n array<int>, body binary, doc_ids array<long>, lengths array<int>"
)


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def _bytes_needed(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4)).astype(np.int8)


class Shard:
    """Documents gathered until the shard is full."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        known = self.vocabulary
        for w in set(words):
            if w not in known:
                known[w] = len(known)
        terms, tfs = np.unique(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), return_counts=True)
        self.ids.append(doc_id), self.lengths.append(len(words)), self.terms.append(terms), self.tfs.append(tfs)
        self.size += len(words)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.size >= SHARD_TERMS

    def batch(self, shard: int, schema: pa.Schema) -> pa.RecordBatch:
        """A row for each term, and one with the documents' ids and lengths."""
        lengths = np.array(self.lengths, np.int64)
        doc = np.repeat(np.arange(len(lengths)), [len(x) for x in self.terms])
        term, tf = np.concatenate(self.terms), np.concatenate(self.tfs)
        order = np.argsort(term, kind="stable")  # documents stay in order
        term, doc, tf = term[order], doc[order], tf[order]
        total = len(term)
        df = np.bincount(term)
        begins = np.append(0, np.cumsum(df))
        within = np.arange(total) - begins[term]
        heads = np.flatnonzero(within % BLOCK == 0)  # where blocks begin
        block = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, total)))
        blocks_of = -(-df // BLOCK)
        step = np.diff(doc, prepend=0)
        step[heads] = 0
        step_bytes, tf_bytes = _bytes_needed(np.maximum.reduceat(step, heads)), _bytes_needed(np.maximum.reduceat(tf, heads))
        wide, narrow = tf_bytes[block].astype(np.int64), step_bytes[block].astype(np.int64)
        ends = np.cumsum(wide + narrow)
        starts = ends - wide - narrow
        body = np.zeros(int(ends[-1]), np.uint8)
        for values, offset, size in ((step, starts, narrow), (tf, starts + narrow, wide)):
            for k in range(4):
                has = size > k
                body[offset[has] + k] = (values[has] >> (8 * k)) & 255
        byte_begins = np.append(starts, ends[-1])[begins]
        at = starts[heads] - byte_begins[term[heads]]
        # fronts: by length, then falling frequency, those with a higher frequency than all before
        n = lengths[doc]
        by_length = np.lexsort((-tf, n, block))
        high = tf[by_length] + block[by_length] * (int(tf.max()) + 1)
        before = np.append(-1, np.maximum.accumulate(high)[:-1])
        new_block = np.diff(block[by_length], prepend=-1) != 0
        on_front = new_block | (high > before)
        front = by_length[on_front]
        front_sizes = np.bincount(block[front], minlength=len(heads))
        front_ends = np.cumsum(front_sizes)
        block_begins = np.append(0, np.cumsum(blocks_of))
        front_begins = np.append(0, front_ends)
        own = np.repeat(np.arange(len(df)), blocks_of)
        front_at = front_begins[:-1] - front_begins[block_begins[own]]

        def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
            offsets = pa.array(np.append(bounds, bounds[-1]).astype(np.int32))
            return pa.ListArray.from_arrays(offsets, pa.array(values, kind))

        per_front = front_begins[block_begins]
        raw = pa.Array.from_buffers(pa.binary(), len(df) + 1, [None, pa.py_buffer(np.append(byte_begins, byte_begins[-1]).astype(np.int32)), pa.py_buffer(body)])
        only_last = lambda x, kind: pa.ListArray.from_arrays(pa.array([0] * (len(df) + 1) + [len(x)], pa.int32()), pa.array(x, kind))
        columns = [
            pa.array(np.full(len(df) + 1, shard)), pa.array([w.decode("utf-8", "replace") for w in self.vocabulary] + [None], pa.string()), pa.array(np.append(df, 0).astype(np.int32)),
            lists(doc[heads], block_begins, pa.int32()), lists(at, block_begins, pa.int32()), lists(step_bytes, block_begins, pa.int8()), lists(tf_bytes, block_begins, pa.int8()),
            lists(front_at, block_begins, pa.int32()), lists(tf[front], per_front, pa.int32()), lists(n[front], per_front, pa.int32()), raw,
            only_last(self.ids, pa.int64()), only_last(lengths, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def build_index(docs: DataFrame) -> DataFrame:
    """The shards of docs(doc_id, text), as a written table. A shard's row without a term holds its documents."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, part, made, shard = to_arrow_schema(schema), TaskContext.get().partitionId(), 0, Shard()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if words := terms_of(text.as_py() or ""):
                    shard.add(doc_id, words)
                    if shard.full():
                        yield shard.batch((part << 24) + made, target)
                        made, shard = made + 1, Shard()
        if shard.ids:
            yield shard.batch((part << 24) + made, target)

    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), "lexical_index")


class Lists:
    """Posting lists of one shard, unpacked block by block when they are needed."""

    def __init__(self, rows: dict, ids: np.ndarray, no_id: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.no_id, self.k = ids, no_id, lengths * 0
        self.norm = 20 * (50 + (50 * lengths * n_docs) // n_terms)
        self.rows, self.open = rows, {}
        self.n_docs, self.n_terms = n_docs, n_terms

    def impact(self, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + norm)

    def list(self, term: str) -> dict | None:
        """first, block maxima (unweighted), and room for what gets unpacked."""
        if term not in self.open:
            row = self.rows.get(term)
            if row is None:
                return None
            n = row["front_n"].astype(np.int64)
            top = self.impact(row["front_tf"].astype(np.int64), 20 * (50 + (50 * n * self.n_docs) // self.n_terms))
            blocks, df = len(row["first"]), row["df"]
            self.open[term] = {
                "df": df, "first": row["first"], "most": np.maximum.reduceat(top, row["front_at"]), "known": np.zeros(blocks, bool),
                "docs": np.full(df, -1, np.int32), "impacts": np.zeros(df, np.int64), "raw": np.frombuffer(row["body"], np.uint8), "row": row,
            }
        return self.open[term]

    def unpack(self, x: dict, blocks: np.ndarray) -> None:
        """Fill in the documents and impacts of these blocks."""
        blocks = blocks[~x["known"][blocks]]
        if not len(blocks):
            return
        row, df = x["row"], x["df"]
        sizes = np.minimum(BLOCK, df - blocks * BLOCK)
        own = np.repeat(np.arange(len(blocks)), sizes)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        narrow, wide = row["step_bytes"][blocks].astype(np.int64)[own], row["tf_bytes"][blocks].astype(np.int64)[own]
        begin = row["at"][blocks].astype(np.int64)[own] + inner * (narrow + wide)
        step, tf = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for values, offset, size in ((step, begin, narrow), (tf, begin + narrow, wide)):
            for k in range(4):
                has = size > k
                if not has.any():
                    break
                values[has] |= x["raw"][offset[has] + k].astype(np.int64) << (8 * k)
        run = np.cumsum(step)
        heads = np.cumsum(sizes) - sizes
        docs = run - (run[heads] - x["first"][blocks])[own]
        at = blocks[own] * BLOCK + inner
        x["docs"][at], x["impacts"][at] = docs, self.impact(tf, self.norm[docs])
        x["known"][blocks] = True

    def whole(self, x: dict) -> tuple[np.ndarray, np.ndarray]:
        if not x["known"].all():
            self.unpack(x, np.flatnonzero(~x["known"]))
        return x["docs"], x["impacts"]


def _kth(score: np.ndarray, k: int) -> int:
    return int(np.partition(score, len(score) - k)[-k]) if len(score) >= k else 0


def block_max_maxscore(shard: Lists, query: list[tuple[str, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard (places) and scores of at least `floor`, among them its k best that reach it."""
    held = [(x, w) for t, w in query if w > 0 and (x := shard.list(t)) is not None]
    none = np.zeros(0, np.int64)
    if not held:
        return none, none
    bound = np.array([w * int(x["most"].max()) for x, w in held])
    order = np.argsort(bound, kind="stable")
    held, upto = [held[i] for i in order], np.cumsum(bound[order])
    least = max(1, floor)
    acc = np.zeros(len(shard.ids), np.int64)
    at = len(held)  # lists from here on are traversed
    while at and upto[at - 1] >= least:
        at -= 1
        x, w = held[at]
        docs, impacts = shard.whole(x)
        acc[docs] += w * impacts
        if floor <= 1 and at and len(acc) >= k:  # partial scores of k documents are a threshold
            least = max(least, _kth(acc, k))
    if floor > 1 and at and len(acc) >= k:
        least = max(least, _kth(acc, k))
    docs = np.flatnonzero(acc if not at else acc + upto[at - 1] >= least) if acc.any() else none
    docs = docs[acc[docs] > 0]
    score = acc[docs]
    rest = held[:at]
    # maxima of the blocks that may hold a candidate, of all lists not traversed
    where, most = [], np.zeros(len(docs), np.int64)
    for x, w in rest:
        b = np.searchsorted(x["first"], docs, "right") - 1
        where.append(b)
        most += np.where(b >= 0, w * x["most"][np.maximum(b, 0)], 0)
    stay = score + most >= least
    for n in range(at - 1, -1, -1):
        docs, score, most, where = docs[stay], score[stay], most[stay], [b[stay] for b in where[: n + 1]]
        if not len(docs):
            return none, none
        x, w = rest[n]
        b = where[n]
        may = b >= 0
        most = most - np.where(may, w * x["most"][np.maximum(b, 0)], 0)
        shard.unpack(x, np.unique(b[may]))
        lo = np.maximum(b, 0) * BLOCK
        hi = np.minimum(lo + BLOCK, x["df"])
        for _ in range(BLOCK.bit_length()):  # the last document of the block that is not beyond the candidate
            mid = (lo + hi) >> 1
            right = (hi - lo > 1) & (x["docs"][mid] <= docs)
            lo, hi = np.where(right, mid, lo), np.where(right | (hi - lo <= 1), hi, mid)
        found = may & (x["docs"][lo] == docs)
        score = score + np.where(found, w * x["impacts"][lo], 0)
        if len(score) > k:
            least = max(least, _kth(score, k))
        stay = score + most >= least
    keep = stay & (score >= max(1, floor))
    return docs[keep], score[keep]


def _shards(rows: pa.Table, n_docs: int, n_terms: int) -> Iterator[Lists]:
    """The group's shards one by one."""
    rows = rows.sort_by("shard").combine_chunks()
    shard = rows.column("shard").to_numpy()
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(shard))):
        part = rows.slice(lo, hi - lo)
        terms = part.column("term").to_pylist()
        cells = {c: part.column(c) for c in part.column_names if c not in ("shard", "term", "group", "block")}
        head = terms.index(None)
        values = cells["doc_ids"][head].values
        ids = values.fill_null(LAST).to_numpy(zero_copy_only=False)
        one = {c: cells[c] for c in ("first", "at", "step_bytes", "tf_bytes", "front_at", "front_tf", "front_n")}
        held = {t: {"df": cells["df"][k].as_py(), "body": cells["body"][k].as_buffer()} | {c: v[k].values.to_numpy() for c, v in one.items()} for k, t in enumerate(terms) if t is not None}
        yield Lists(held, ids, values.is_null().to_numpy(zero_copy_only=False), cells["lengths"][head].values.to_numpy().astype(np.int64), n_docs, n_terms)


FOUND = "item_id long, tag long, doc_id long, score long"


def _search_groups(queries: DataFrame, rows: DataFrame, groups: int, first: int, blocks: int, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """Every query's k best of each group from `first` on. queries: item_id, tag, terms, weights, floor, block; rows: of the index, with their group."""

    def run(q: pa.Table, rows: pa.Table) -> pa.Table:
        best: list[list] = [[], [], [], [], []]
        if q.num_rows and rows.num_rows:
            asked = list(zip(*[q.column(c).to_pylist() for c in ("item_id", "tag", "terms", "weights", "floor")]))
            kept = [[np.zeros(0, np.int64)] * 3 for _ in asked]  # score, id, whether there is none
            for shard in _shards(rows, n_docs, n_terms):
                for n, (_, _, terms, weights, floor) in enumerate(asked):
                    score, ids, no_id = kept[n]
                    docs, got = block_max_maxscore(shard, list(zip(terms, weights)), k, max(floor or 1, int(score[-1]) if len(score) == k else 1))
                    if len(docs):
                        score, ids, no_id = np.append(score, got), np.append(ids, shard.ids[docs]), np.append(no_id, shard.no_id[docs])
                        order = np.lexsort((ids, no_id, -score))[:k]
                        kept[n] = [score[order], ids[order], no_id[order]]
            for (item, tag, *_), (score, ids, no_id) in zip(asked, kept):
                for held, x in zip(best, ([item] * len(score), [tag] * len(score), ids.tolist(), score.tolist(), no_id.tolist())):
                    held += x
        ids = [None if gone else i for i, gone in zip(best[2], best[4])]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (best[0], best[1], ids, best[3])], names=["item_id", "tag", "doc_id", "score"])

    left = queries.withColumn("group", F.explode(F.sequence(F.lit(first), F.lit(max(first, groups - 1)))))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id", "tag").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, tag (hash of the text), terms: the distinct terms of each different query."""
    text = F.translate(F.col("text"), UPPER, LOWER)
    terms = F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("tag"), terms.alias("terms")).filter("size(terms) > 0").dropDuplicates(["item_id", "tag"])


def search(index: DataFrame, items: DataFrame, *, k: int = 50, group_bytes: int = GROUP_BYTES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of index for every row of items(item_id, text)."""
    spark = index.sparkSession
    asked = materialize(query_terms(items), "lexical_queries")
    totals = index.filter("term is null").agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)))
    n_docs, n_terms = map(int, totals.first())
    n_items = asked.count()
    if not n_docs or not n_items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    flat = materialize(asked.select("item_id", "tag", F.explode("terms").alias("term")), "lexical_terms")
    wanted = materialize(index.join(flat.select("term").distinct(), "term", "left_semi").unionByName(index.filter("term is null")), "lexical_lists")
    ratio = F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weights = wanted.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df")).select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("w"))
    blocks = max(1, -(-n_items // query_block))
    weighed = flat.join(weights, "term").groupBy("item_id", "tag").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights"))
    weighed = materialize(weighed.withColumn("block", F.pmod(F.xxhash64("item_id", "tag"), F.lit(blocks)).cast("int")), "lexical_weights")
    size = int(wanted.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0])
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // group_bytes))
    rows = wanted.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"))
    args = dict(blocks=blocks, k=k, n_docs=n_docs, n_terms=n_terms)
    seeds = _search_groups(weighed.withColumn("floor", F.lit(None).cast("long")), rows.filter("group = 0"), 1, 0, **args)
    seeds = materialize(_ranked(seeds, k), "lexical_seeds")
    reached = seeds.filter(F.col("rank") == k).select("item_id", "tag", F.col("score").alias("floor"))
    same = weighed["item_id"].eqNullSafe(reached["item_id"]) & (weighed["tag"] == reached["tag"])
    floored = weighed.join(reached, same, "left").select(*[weighed[c] for c in weighed.columns], "floor")
    rest = _search_groups(floored, rows.filter("group > 0"), groups, 1, **args)
    return _ranked(seeds.drop("rank").unionByName(rest), k).select("item_id", "rank", "doc_id", "score")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents
), counted AS (SELECT row, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM counted),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
), postings AS (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM counted) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term, n_docs
), scored AS (
  SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
