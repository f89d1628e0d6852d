"""Jaccard join of word n-gram sets by prefixes under several global orders.

Sets with an intersection of t of their union share a token among the first n - ceil(t n) + 1 of each,
under any one order of all tokens; so a pair must do so under every order.

1. A first pass finds shingles that many texts hold: each batch counts those that stand in two of
   its different sets or more, and the counts are added up. COMMON of them at most, a table of
   bounded size, go to all workers. It only decides the first order, which takes all others first
   (by hash) and then these, rarest first. Every order is as right as any other; this one keeps the
   buckets small that passages of many texts would fill.
2. The second pass gives each text's set size, digest, and its prefix under the first order. Rows of
   equal sets are one class, a node; copies are never paired.
3. Prefix tokens that two nodes or more share are buckets. Two rows of a bucket are worth a look if
   their sizes allow the threshold and so do their places: a first shared token at places i and j
   leaves at most min(n - i, m - j) in common.
4. Rounds: in every bucket with nodes of different components each member meets a few centres of
   other components; the last round takes all pairs left. A pair is taken once. Parities of the sets
   (1,024 bits, which differ in at most as many places as the sets do) spare pairs that are alike,
   but not enough; these say nothing about sets of some 3,000 shingles and more, so that larger sets
   have as many bits as shingles too, which the pairs left are tested by. The nodes of the pairs left then have their texts fetched and made into full sets where
   they meet. A pair must share a prefix token under each of ORDERS - 1 further orders too; then its
   full sets are compared. Links join components.

No pair of sets at the threshold is lost, but for equal 64-bit hashes of different shingles. Bounds
on growth: a bucket of many texts that are alike in size and place and yet all apart takes time
quadratic in the bucket in the last round (comparing parities) and makes rows only for pairs left.

Defined results: a null text, and one without words, has an empty set, is linked with nothing and is
its own component. With fewer than WIDTH words the whole sequence is one shingle. Every row is a
document of its own; rows that repeat a doc_id with different texts may be in different components.
A null doc_id is no candidate for a component's smallest id; a component of such rows alone has a
null id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.graph import connected_components
from .common import materialize
from .neardup import FOLD, ODD, PARITY, SALT, parities

WIDTH = 4
THRESHOLD = 85  # per cent
ORDERS = 3
#: Shingles that the first order puts last, at most (8 bytes each, and as many for their ranks).
COMMON = 1 << 17
#: Centres of a bucket in each round but the last, which takes all pairs left.
CENTRES = (1, 8)
#: Slots by which texts that aren't wanted are left out before those that are get fetched.
SLOTS = 1 << 19
#: Bytes of a word that are hashed together with other words'.
LONG = 64
#: Characters and texts that a worker holds at once (one text may hold more).
BATCH_CHARS, BATCH_TEXTS = 1 << 22, 2048

_P = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first bytes of eight; which bytes are white space.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sets of n-gram hashes, made for many texts at once."""

    def __init__(self, width: int = WIDTH):
        self.width = width

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's shingles."""
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b" " + b" ".join(coded).translate(FOLD) + b" "
        white = WHITE[np.frombuffer(data, np.uint8)]
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        h = word_hashes(data, start, end - start)
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in coded]))  # words up to each text's end
        whole = self._hashed(h, self.width) if len(h) >= self.width else h
        return [self._distinct(h, whole, a, b) for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def shingles(self, text: str) -> np.ndarray:
        return self.sets([text])[0]

    @staticmethod
    def _hashed(h: np.ndarray, size: int) -> np.ndarray:
        x = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            x = x * _P + h[k : len(h) - size + 1 + k]
        return mix(x)

    def _distinct(self, h: np.ndarray, whole: np.ndarray, a: int, b: int) -> np.ndarray:
        """The set of the words from a to b; whole: shingles from each word on."""
        if b - a < self.width:
            return self._hashed(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)
        x = np.sort(whole[a : b - self.width + 1])
        new = x[1:] != x[:-1]
        return x if new.all() else x[np.append(True, new)]


def word_hashes(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word, eight bytes at a time for all words; the few longer than LONG bytes by a call each."""
    import xxhash

    held = data + bytes(8)
    eight = np.ndarray(len(data), "<u8", held, strides=(1,))  # the eight bytes from each place on
    left = np.minimum(size, 8)
    h = mix((eight[start] & _BYTES[left]) ^ (size.astype(np.uint64) * _P))
    more = np.flatnonzero((size > 8) & (size <= LONG))
    for at in range(8, LONG, 8):
        if not len(more):
            break
        left = np.minimum(size[more] - at, 8)
        h[more] = mix((h[more] + _P) ^ (eight[start[more] + at] & _BYTES[left]))
        more = more[size[more] > at + 8]
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]])
    return h


def prefix_size(n: int, threshold: int) -> int:
    """How many first tokens of a set of n must hold one of each partner's; 0 if no other set can reach the threshold."""
    return n - -(-threshold * n // 100) + 1 if 100 * n >= threshold * (n + 1) else 0


def wide_parities(shingles: np.ndarray) -> np.ndarray | None:
    """Parities of as many places as shingles, rounded up to a power of two; none where PARITY places are as many."""
    return parities(shingles, 1 << (len(shingles) - 1).bit_length()) if len(shingles) > PARITY else None


class FirstOrder:
    """Common shingles last, rarest first; all others before them, by hash."""

    def __init__(self, common: np.ndarray, rank: np.ndarray):
        self.common, self.rank = common, rank

    def ranks(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
        return np.where(self.common[at] == shingles, self.rank[at], 0)

    def prefix(self, shingles: np.ndarray, size: int) -> np.ndarray:
        for part in (shingles[: 2 * size], shingles):  # most sets have rare ones enough near their beginning
            rank = self.ranks(part)
            rare = np.flatnonzero(rank == 0)
            if len(rare) >= size:  # sorted by hash already
                return part[rare[:size]]
        held = np.flatnonzero(rank)
        return shingles[np.append(rare, held[np.argsort(rank[held], kind="stable")])[:size]]


def hashed_prefix(shingles: np.ndarray, order: int, size: int) -> np.ndarray:
    """The first tokens under the order-th order by hash."""
    key = mix(shingles ^ np.uint64(order * int(_P) & (1 << 64) - 1))
    least = np.argpartition(key, size - 1)[:size] if 0 < size < len(key) else np.arange(len(key))[:size]
    return shingles[least]


def _texts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with their texts, bounded in characters."""
    for b in batches:
        begin, chars, held = 0, 0, []
        for k, t in enumerate(b.column(text)):
            held.append(t.as_py() or "")
            chars += len(held[-1])
            if chars >= BATCH_CHARS or len(held) >= BATCH_TEXTS or k + 1 == b.num_rows:
                yield b.slice(begin, len(held)), held
                begin, chars, held = k + 1, 0, []


def _longs(rows: list[np.ndarray | None]) -> pa.Array:
    return pa.array([x if x is None else x.view(np.int64) for x in rows], pa.list_(pa.int64()))


def common_shingles(docs: DataFrame, *, width: int = WIDTH, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """At most so many shingles that many texts hold, sorted, and their ranks from 1 by rising count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(width)
        for _, texts in _texts(batches, 0):
            sets = {x.tobytes(): x for x in make.sets(texts)}
            shingle, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], names=["shingle", "times"])

    counted = docs.select("text").mapInArrow(run, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    counted = materialize(counted.withColumn("size", F.floor(4 * F.log2("times")).cast("int")), "common_shingles")
    left, least = most, None
    for size, n in sorted(map(tuple, counted.groupBy("size").count().collect()), reverse=True):  # a few hundred rows at most
        if n > left:
            break
        left, least = left - n, size
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held = counted.filter(F.col("size") >= least).select("shingle", "times").toArrow()
    shingle, times = held.column("shingle").to_numpy().view(np.uint64), held.column("times").to_numpy()
    rank = np.empty(len(shingle), np.int64)
    rank[np.lexsort((shingle, times))] = np.arange(1, len(shingle) + 1)
    order = np.argsort(shingle)
    return shingle[order], rank[order]


def _text_hash() -> Column:
    return F.xxhash64("text")


def prefixed(docs: DataFrame, order: FirstOrder, *, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """row, doc_id, th (hash of the text), n_shingles, d1, d2 (digest of the set), odd and wide (parities), prefix under the first order."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        make, first, row = Shingler(width), sent.value, TaskContext.get().partitionId() << 33
        for part, texts in _texts(batches, 2):
            sets = make.sets(texts)
            digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), ">i8") for x in sets], np.int64)
            prefixes = [first.prefix(x, prefix_size(len(x), threshold)) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(sets))), part.column(0), part.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), _longs(list(map(parities, sets))), _longs(list(map(wide_parities, sets))), _longs(prefixes)],
                names=["row", "doc_id", "th", "n_shingles", "d1", "d2", "odd", "wide", "prefix"],
            )
            row += len(sets)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("th"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, th long, n_shingles long, d1 long, d2 long, odd array<long>, wide array<long>, prefix array<long>")


def set_classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set: node, doc_id and th (of its row of smallest doc_id), d1, d2, n, odd."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "row")).alias("r")
    one = rows.filter("n_shingles > 0").groupBy("d1", "d2").agg(first, F.first("n_shingles").alias("n"), F.first("odd").alias("odd"))
    return one.select(F.col("r.row").alias("node"), "r.doc_id", "r.th", "d1", "d2", "n", "odd")


def may_join(threshold: int) -> Column:
    """Rows x and y of a bucket (n, rest: tokens from the shared one on) whose sizes and places allow the threshold."""
    rest = F.least("x.rest", "y.rest")
    sizes = 100 * F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")
    return sizes & ((100 + threshold) * rest >= threshold * (F.col("x.n") + F.col("y.n")))


def may_reach(x: Column, y: Column, sizes: Column, threshold: int) -> Column:
    """Whether parities allow the threshold t: sets of J >= t differ in at most (n + m)(1 - t)/(1 + t) shingles."""
    bits = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(len(ODD))), F.lit(0))
    return (100 + threshold) * bits <= (100 - threshold) * sizes


def may_reach_wide(x: Column, y: Column, sizes: Column, threshold: int) -> Column:
    """The same by wide parities, where both have them; the longer ones are folded to the places of the others."""
    words, most = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    folded = lambda p: F.when(F.size(p) > words, F.zip_with(F.slice(p, F.lit(1), words), F.slice(p, words + 1, words), lambda a, b: a.bitwiseXOR(b))).otherwise(p)
    bits = F.aggregate(F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
    known = x.isNotNull() & y.isNotNull() & (most <= 2 * words)
    return F.when(known, (100 + threshold) * bits <= (100 - threshold) * sizes).otherwise(F.lit(True))


def not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their first column, those with an equal neighbour, and the first and the last, whose neighbours may be elsewhere."""
    held, equal = None, True
    for b in batches:
        if not b.num_rows:
            continue
        part = b if held is None else pa.concat_batches([held, b])
        key = part.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.append(equal, same)
        keep[:-1] |= same
        held, equal = part.slice(part.num_rows - 1), keep[-1]
        yield part.slice(0, part.num_rows - 1).filter(pa.array(keep[:-1]))
    if held is not None:
        yield held


def buckets(rows: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """key, node, n, rest of the prefix tokens that nodes share with one they may join.

    Tokens move once, dealt by ranges of (key, node), so that a key of many nodes takes several
    tasks. There those that stand alone, nearly all, go; the others are few enough to be joined.
    """
    held = rows.filter("size(prefix) > 0").join(classes.select("node"), F.col("row") == F.col("node"))
    tokens = held.select("node", F.posexplode("prefix").alias("pos", "key"), F.col("n_shingles").cast("int").alias("n"))
    tokens = tokens.select("key", "node", "n", (F.col("n") - F.col("pos")).alias("rest"))
    ordered = tokens.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    sized = materialize(ordered.mapInArrow(not_alone, "key long, node long, n int, rest int"), "prefix_buckets")
    x, y = sized.alias("x"), sized.alias("y")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & may_join(threshold), "left_semi")


def texts_where_needed(docs: DataFrame, needs: DataFrame) -> DataFrame:
    """b, salt, node, text for each row of needs(b, salt, node, doc_id, th)."""
    slot = lambda: F.pmod(F.xxhash64("doc_id", "th"), F.lit(SLOTS)).cast("int").alias("slot")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("th"), "text")
    texts = texts.withColumn("slot", slot()).join(F.broadcast(needs.select(slot()).distinct()), "slot", "left_semi").alias("t")
    named = texts.join(needs.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.th") == F.col("w.th")))
    return named.select("b", "salt", "node", "text")


def alike(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sets share a prefix token under each of the further orders, and then whether they reach the threshold."""
    p, q = prefix_size(len(x), threshold), prefix_size(len(y), threshold)
    if not all(np.intersect1d(hashed_prefix(x, k, p), hashed_prefix(y, k, q)).size for k in range(2, ORDERS + 1)):
        return False
    both = np.intersect1d(x, y, assume_unique=True).size
    return 100 * both >= threshold * (len(x) + len(y) - both)


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, *, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of nodes that share a prefix token under all orders and whose full sets reach the threshold.

    Texts, which compress better than sets of hashes, are sent to where their sets are compared: b's for
    each of SALT parts of its partners, a's for each pair. There the rows of (b, salt) come in order,
    b's text first, and only b's set is held.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALT)).cast("int").alias("salt"))
    needs = dealt.select("b", "salt", F.col("a").alias("node")).unionByName(dealt.select("b", "salt", F.col("b").alias("node")).distinct())
    needs = materialize(needs.join(classes.select("node", "doc_id", "th"), "node").select("b", "salt", "node", "doc_id", "th"), "set_needs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held, centre = Shingler(width), None, None
        for part, texts in _texts(batches, 3):
            found: tuple[list, list] = ([], [])
            for b, salt, node, x in zip(*(part.column(k).to_pylist() for k in range(3)), make.sets(texts)):
                if node == b:
                    if held != (b, salt):
                        held, centre = (b, salt), x
                elif held == (b, salt) and alike(x, centre, threshold):
                    found[0].append(node), found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    texts = texts_where_needed(docs, needs).repartition("b", "salt").sortWithinPartitions("b", "salt", (F.col("node") != F.col("b")), "node")
    return texts.select("b", "salt", "node", "text").mapInArrow(run, "a long, b long").distinct()


def worth_reading(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that wide parities leave."""
    of = lambda s: classes.filter("wide IS NOT NULL").select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("wide").alias(f"wide_{s}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(may_reach_wide(F.col("wide_a"), F.col("wide_b"), F.col("n_a") + F.col("n_b"), threshold)).select("a", "b")


def linked(docs: DataFrame, members: DataFrame, classes: DataFrame, *, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame | None:
    """v, c: the smallest node that every linked node reaches. members, a written table: as buckets gives them; classes: of their nodes at least, with wide."""
    labels = links = tried = None
    of = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("odd").alias(f"odd_{s}"))
    for centres in (*CENTRES, None):
        owned = members.withColumn("c", F.col("node"))
        if labels is not None:
            owned = members.join(labels, members["node"] == labels["v"], "left").select(*members.columns, F.coalesce("c", "node").alias("c"))
        near = may_join(threshold)
        if tried is not None:
            mixed = owned.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
            owned = owned.join(mixed, "key", "left_semi")
            if centres is None:  # all pairs of a bucket: parities are tested before rows are made
                owned = owned.join(classes.select("node", "odd"), "node")
                near = near & may_reach(F.col("x.odd"), F.col("y.odd"), F.col("x.n") + F.col("y.n"), threshold)
            owned = materialize(owned, "prefix_open")
            members = owned.select(*members.columns)  # a bucket of one component stays one
        if owned.isEmpty():
            break
        x, y, apart = owned.alias("x"), owned.alias("y"), F.col("x.c") < F.col("y.c")
        if centres:
            order = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")  # the same for all buckets, so that a group meets few centres
            y, apart = owned.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= centres).alias("y"), F.col("x.c") != F.col("y.c")
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        if centres:
            met = met.join(of("b"), "b").join(of("a"), "a").withColumn("may", may_reach(F.col("odd_a"), F.col("odd_b"), F.col("n_a") + F.col("n_b"), threshold)).select("a", "b", "may")
        else:
            met = met.withColumn("may", F.lit(True))
        met = materialize(met, "prefix_pairs")
        pairs = materialize(worth_reading(met.filter("may").select("a", "b"), classes, threshold), "prefix_alike")
        found = materialize(verified(docs, pairs, classes, width=width, threshold=threshold), "prefix_links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = connected_components(links)
        both = met.select("a", "b").unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = both if tried is None else tried.unionByName(both)
    return labels


def join_components(docs: DataFrame, *, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    order = FirstOrder(*common_shingles(docs, width=width))
    rows = materialize(prefixed(docs, order, width=width, threshold=threshold), "prefixed")
    classes = materialize(set_classes(rows), "set_classes")
    members = materialize(buckets(rows, classes, threshold), "prefix_members")
    wide = rows.filter("wide IS NOT NULL").select(F.col("row").alias("node"), "wide")
    met = materialize(classes.join(members.select("node").distinct(), "node", "left_semi").join(wide, "node", "left"), "met_classes")
    labels = linked(docs, members, met, width=width, threshold=threshold)

    component = classes.select("node", "d1", "d2", F.col("doc_id").alias("component_id"))
    if labels is not None:
        least = component.join(labels, component["node"] == labels["v"]).groupBy("c").agg(F.min("component_id").alias("least"))
        named = labels.join(least, "c").select("v", "least")
        component = component.join(named, component["node"] == named["v"], "left").select("d1", "d2", F.coalesce("least", "component_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(component.select("d1", "d2", "component_id"), ["d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
