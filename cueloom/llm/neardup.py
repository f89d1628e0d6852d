"""Near-duplicate documents by b-bit MinHash.

1. Every whole text becomes the set of its distinct WIDTH-word shingles (64-bit hashes), a 128-bit
   digest of that set, MINIMA minimum hashes, their low BITS bits packed into words (the
   signature), and BANDS band keys of BAND_ROWS minima each.
2. Rows of equal sets (exact copies and the like) are one class, a node; groups of copies are never
   paired.
3. Nodes that share a band bucket with another whose signature may belong to a pair over the
   threshold (unequal lanes, counted bit-parallel) stay. Only their texts are fetched, once, by id,
   as full shingle sets; no set ever stands beside a band key.
4. Rounds: in every bucket that holds nodes of different components, each member meets a few centres
   of other components (the members that share buckets with most others). Every pair is taken once,
   tested by signature and then on both full sets; links join components. The last round takes all
   pairs across components that no round has tested. From the second round on pairs are tested before
   by parity too: each set's shingles are counted by hash in PARITY bits, modulo 2. Two sets differ in
   at least as many shingles as bits, so this test never loses a pair; it spares the groups of texts
   that are alike, but not enough, a row for each of their pairs.

A pair of similarity s is missed by the bands with probability (1 - s^BAND_ROWS)^BANDS, 2.3e-6 at
0.75, and by the signatures, whose lanes differ with probability (1 - s)(1 - 2^-BITS) each, with at
most FILTER_MISS: 2.6e-7 at 0.75 (81 lanes may differ). Both together: 2.5e-6 at 0.75, 8.5e-7 at 0.76.

Defined results: a null text, and one without words, has an empty set, is linked with nothing and
is kept. With fewer than WIDTH words the whole sequence is one shingle. Every row is a document of
its own: rows that repeat a doc_id with different texts may be in different components, equal rows
are in the same one and all kept or all not. A null doc_id is no candidate for a component's smallest
id; a component of such rows alone has a null id and keeps them. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.graph import connected_components
from .common import materialize

WIDTH = 5
THRESHOLD = 75  # per cent
MINIMA, BANDS, BAND_ROWS, BITS = 256, 48, 5, 2
FILTER_MISS = 5e-7
WORD_MEMORY = 150_000
#: Centres of a bucket in each round but the last, which takes all pairs left.
CENTRES = (1, 8)
#: Ways in which the pairs of one centre are dealt out.
SALT = 64
#: Bits of a set's parities.
PARITY = 1024

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Sketcher:
    """Shingle hashes and signatures; remembers the hashes of words it has met."""

    def __init__(self):
        rng = np.random.default_rng(2024)
        self.mul = rng.integers(0, 1 << 31, MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 1 << 32, MINIMA, np.uint64).astype(np.uint32)
        self.band = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _P)
        self.words: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        import xxhash

        words = words_of(text)
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        memory = self.words
        if len(memory) > WORD_MEMORY:
            memory.clear()
        for w in set(words):
            if w not in memory:
                memory[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memory.__getitem__, words), np.uint64, n)
        if n < WIDTH:
            x = np.uint64(n)
            with np.errstate(over="ignore"):
                for k in range(n):
                    x = x * _P + h[k]
            return _mix(np.array([x], np.uint64))
        x = h[: n - WIDTH + 1].copy()
        for k in range(1, WIDTH):
            x *= _P
            x += h[k : n - WIDTH + 1 + k]
        return np.unique(_mix(x))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
        small = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(small), 1024):
            part = small[None, at : at + 1024]
            for k in range(0, MINIMA, 32):
                np.minimum(out[k : k + 32], (part * self.mul[k : k + 32, None] + self.add[k : k + 32, None]).min(axis=1), out=out[k : k + 32])
        return out

    def signature(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of the (mixed) minima, 64 / BITS lanes to a word."""
        lanes = 64 // BITS
        low = (_mix(minima.astype(np.uint64) * _P) & np.uint64((1 << BITS) - 1)).reshape(-1, lanes)
        return np.bitwise_or.reduce(low << (np.arange(lanes, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)

    def bands(self, minima: np.ndarray) -> np.ndarray:
        key = self.band.copy()
        for m in minima[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
            key = _mix((key ^ m) * _P)
        return key.view(np.int64)


def _text_hash() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("text")


def parities(shingles: np.ndarray, places: int = PARITY) -> np.ndarray:
    """How many shingles fall on each of so many places (a power of two), modulo 2, 64 places to a word."""
    odd = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, d1, d2 (digest of the set), sig array<long>, bands array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        make = Sketcher()
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                n, d1, d2, sig, bands = [], [], [], [], []
                for text in b.column(2):
                    s = make.shingles(text.as_py() or "")
                    n.append(len(s))
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8")
                    d1.append(int(digest[0])), d2.append(int(digest[1]))
                    m = make.minima(s) if len(s) else None
                    sig.append(make.signature(m) if m is not None else None)
                    bands.append(make.bands(m) if m is not None else None)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, longs), pa.array(bands, longs)],
                    names=["doc_id", "th", "n_shingles", "d1", "d2", "sig", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("th"), "text").mapInArrow(
        run, "doc_id long, th long, n_shingles long, d1 long, d2 long, sig array<long>, bands array<long>"
    )


SIGNATURE = [f"s{k}" for k in range(MINIMA * BITS // 64)]
ODD = [f"o{k}" for k in range(PARITY // 64)]


def unequal_lanes(a: list[Column], b: list[Column]) -> Column:
    """How many lanes of two signatures (their words) differ."""
    unequal = F.lit(0)
    low = F.lit(sum(1 << k for k in range(0, 64, BITS)))
    for p, q in zip(a, b):
        x = p.bitwiseXOR(q)
        x = reduce(lambda acc, s: acc.bitwiseOR(F.shiftrightunsigned(x, s)), range(1, BITS), x)
        unequal = unequal + F.bit_count(x.bitwiseAND(low))
    return unequal


def filter_miss(similarity: float, lanes: int) -> float:
    """Probability that more than so many lanes differ."""
    p = (1 - similarity) * (1 - 1 / (1 << BITS))
    return sum(comb(MINIMA, k) * p**k * (1 - p) ** (MINIMA - k) for k in range(lanes + 1, MINIMA + 1))


def lanes_allowed(threshold: int) -> int:
    """The fewest lanes that may differ so that a pair at the threshold is missed with FILTER_MISS at most."""
    return next(n for n in range(MINIMA + 1) if filter_miss(threshold / 100, n) <= FILTER_MISS)


def _side(name: str, words: list[str]) -> list[Column]:
    return [F.col(f"{name}.{w}") for w in words]


def _close(threshold: int) -> Column:
    """Rows x and y (n, SIGNATURE) worth confirming: sizes that allow the threshold, and signatures too."""
    alike = unequal_lanes(_side("x", SIGNATURE), _side("y", SIGNATURE)) <= lanes_allowed(threshold)
    return (100 * F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")) & alike


def _may_reach(threshold: int) -> Column:
    """Rows x and y (n, ODD) whose parities allow the threshold t: sets of J >= t differ in at most (n + n)(1 - t)/(1 + t) shingles."""
    bits = sum((F.bit_count(p.bitwiseXOR(q)) for p, q in zip(_side("x", ODD), _side("y", ODD))), F.lit(0))
    return (100 + threshold) * bits <= (100 - threshold) * (F.col("x.n") + F.col("y.n"))


def set_classes(sketch: DataFrame) -> DataFrame:
    """One row per distinct set: node, doc_id and th (of its row of smallest doc_id), d1, d2, n, sig, bands."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r")
    one = sketch.filter("n_shingles > 0").groupBy("d1", "d2").agg(first, F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    return one.select(F.monotonically_increasing_id().alias("node"), "r.doc_id", "r.th", "d1", "d2", "n", "sig", "bands")


def close_members(classes: DataFrame, threshold: int) -> DataFrame:
    """key, node, fame, n and SIGNATURE of the nodes with a partner in the bucket that the signatures allow."""
    banded = classes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = materialize(banded.join(shared, "key"), "sized")
    fame = sized.groupBy("node").agg(F.sum("size").alias("fame"))
    rows = sized.select("key", "node").join(fame, "node").join(classes.select("node", "n", *[F.col("sig")[k].alias(w) for k, w in enumerate(SIGNATURE)]), "node")
    rows = materialize(rows.select("key", "node", "fame", "n", *SIGNATURE), "buckets")
    x, y = rows.alias("x"), rows.alias("y")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & _close(threshold), "left_semi")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles (the full set of shingle hashes) and odd (its parities) of the rows that wanted(node, doc_id, th) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Sketcher()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                sets = [make.shingles(t.as_py() or "") for t in b.column(1)]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([x.view(np.int64) for x in sets], longs), pa.array(list(map(parities, sets)), longs)], names=["node", "shingles", "odd"]
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("th"), "text").alias("t")
    named = texts.join(wanted.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.th") == F.col("w.th")))
    return named.select("node", "text").mapInArrow(run, "node long, shingles array<long>, odd array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold. b may stand in very many pairs."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALT)).alias("salt"))
    of_b = dealt.select("b", "salt").distinct().join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = dealt.join(of_b, ["b", "salt"]).join(of_a, "a").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return met.filter(100 * F.col("both") >= threshold * (F.col("sizes") - F.col("both"))).select("a", "b").distinct()


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """v, c after further links between nodes: the components of components."""
    if labels is None:
        return connected_components(links)
    name = lambda x: links.join(labels, links[x] == labels["v"], "left").select(*links.columns, F.coalesce("c", x).alias(f"c_{x}"))
    ca = name("a")
    both = ca.join(labels, ca["b"] == labels["v"], "left").select(F.col("c_a").alias("a"), F.coalesce("c", "b").alias("b"))
    moved = connected_components(both).select(F.col("v").alias("old"), F.col("c").alias("new"))
    known = labels.join(moved, labels["c"] == moved["old"], "left").select("v", F.coalesce("new", "c").alias("c"))
    fresh = moved.join(labels, moved["old"] == labels["v"], "left_anti").select(F.col("old").alias("v"), F.col("new").alias("c"))
    return materialize(known.unionByName(fresh), "labels")


def linked(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame | None:
    """v, c: the smallest node that every linked node reaches. members, a written table: as close_members gives them."""
    labels = tried = None
    for centres in (*CENTRES, None):
        owned = members.withColumn("c", F.col("node"))
        if labels is not None:
            owned = members.join(labels, members["node"] == labels["v"], "left").select(*members.columns, F.coalesce("c", "node").alias("c"))
            mixed = owned.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
            owned = owned.join(mixed, "key", "left_semi").join(sets.select("node", *[F.col("odd")[k].alias(w) for k, w in enumerate(ODD)]), "node")
        owned = materialize(owned, "open")
        if owned.isEmpty():
            break
        near = _close(threshold) if labels is None else _close(threshold) & _may_reach(threshold)
        x, y, apart = owned.alias("x"), owned.alias("y"), F.col("x.c") < F.col("y.c")
        if centres:
            order = Window.partitionBy("key").orderBy(F.desc("fame"), "node")
            y = owned.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= centres).alias("y")
            apart = F.col("x.c") != F.col("y.c")
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        met = materialize(met, "pairs")
        links = materialize(confirm(met, sets, threshold), "links")
        if not links.isEmpty():
            labels = _joined(labels, links)
        both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = both if tried is None else tried.unionByName(both)
    return labels


def judged(docs: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    sketch = materialize(sketches(docs), "sketches")
    classes = materialize(set_classes(sketch), "classes")
    members = materialize(close_members(classes, threshold), "members")
    wanted = classes.select("node", "doc_id", "th").join(members.select("node").distinct(), "node")
    labels = linked(members, materialize(shingle_sets(docs, wanted), "sets"), threshold)

    component = classes.select("node", "d1", "d2", F.col("doc_id").alias("component_id"))
    if labels is not None:
        least = component.join(labels, component["node"] == labels["v"]).groupBy("c").agg(F.min("component_id").alias("least"))
        named = labels.join(least, "c").select("v", "least")
        component = component.join(named, component["node"] == named["v"], "left").select("d1", "d2", F.coalesce("least", "component_id").alias("component_id"))
    out = sketch.select("doc_id", "th", "n_shingles", "d1", "d2").join(component.select("d1", "d2", "component_id"), ["d1", "d2"], "left")
    return out.select(
        "doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def duplicates(docs: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    return judged(docs.select("doc_id", "text"), threshold=threshold).drop("th")


def keep_one(docs: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Rows equal in doc_id and text stay together."""
    gone = judged(docs.select("doc_id", "text"), threshold=threshold).filter("not kept").select("doc_id", "th").distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["th"]), "left_anti")
