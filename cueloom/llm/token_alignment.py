"""Alignment of two tokenizers' tokens by their byte ends, with merge-path partitioning.

A is a byte-level BPE file (tokenizers library), B a SentencePiece model; both see a space before the
text, which B adds by itself. The ends of A's and B's tokens, in bytes, are two rising sequences
for a whole batch of texts laid end to end, whatever the length of each text. Merging them is a path
through a grid; its diagonals at every WORK steps are searched by bisection, all at once, and cut the
merge into independent pieces of equal work. A piece emits the pairs of equal ends (overlaps) that
lie in it; where the path is cut between two equal ends, the two boundary pieces each hold one, and
are stitched. Between equal ends lie the groups.

Encoding: a text is cut before a single space between two characters that are not white space, where
no match of A's pattern and no piece of B goes across; the piece test is made when the model is
loaded. Each different chunk is encoded once per worker, as long as it is remembered.

Id pairs are counted over the whole corpus. The second pass looks every text's pairs up in the
counts: as sorted arrays sent to all workers if there are no more than PAIRS_SENT pairs, else by a
join.

Defined results: texts that are null, empty or not given back by the tokens (joined bytes of A or B
differ from space+text) have no tokens: zeros and an empty groups_sha256. Every row counts for itself,
also when it repeats another; a null doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize

#: Steps of the merge in a piece.
WORK = 1 << 15
#: Characters of texts that a worker holds at once (one text may hold more), and of remembered chunks.
BATCH_CHARS, MEMORY_CHARS = 1 << 21, 1 << 23
#: Chunks of more characters are not remembered.
LONG_CHUNK = 1 << 12
#: Up to so many pairs of ids (17 bytes each) are sent to the workers; beyond, they are joined.
PAIRS_SENT = 4_000_000

CUT = re.compile(r"(?<=\S)(?= \S)")
SPACE_MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both encoders, and the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = byte_letters()
        self.a_bytes = [bytes(letters[c] for c in t) if (t := self.a.id_to_token(i)) and all(c in letters for c in t) else (t or "").encode() for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces):
            raise ValueError(f"{b_file} has pieces that go across spaces")
        raw = [re.fullmatch(r"<0x([0-9A-F]{2})>", p) for p in pieces]
        self.b_bytes = [bytes([int(m[1], 16)]) if m else p.replace(SPACE_MARK, " ").encode() for m, p in zip(raw, pieces)]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))

    def encode(self, chunks: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of A and of B for chunks that begin with a space, and whether both give the chunk back."""
        a = [x.ids for x in self.a.encode_batch(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        return [(x, y, b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y))) for x, y, r in zip(a, b, raw)]


@lru_cache(maxsize=2)
def tokenizers_of(a_file: str, b_file: str) -> Tokenizers:
    return Tokenizers(a_file, b_file)


class Ragged:
    """Rows of ids in one flat array."""

    def __init__(self):
        self.flat, self.begins = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def extend(self, flat: np.ndarray, ends: np.ndarray) -> None:
        """Rows that end at these places of flat."""
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.begins = np.concatenate([self.begins, self.begins[-1] + ends])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows one after another, and how many each has."""
        size = self.begins[rows + 1] - self.begins[rows]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.begins[rows] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


class Encoder:
    """Chunks that have been met, by number, with their ids."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.a, self.b, self.ok, self.chars, self.longest = Ragged(), Ragged(), np.zeros(0, bool), 0, 0

    def _add(self, chunks: list[str], a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, ok: list[bool]) -> None:
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.a.extend(a, ends_a), self.b.extend(b, ends_b)
        self.ok = np.append(self.ok, ok)

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks. Those that begin with one space and end without are encoded joined up, and cut again by their bytes."""
        t, plain, other = self.tokenizers, [], []
        for c in chunks:
            (other if c[-1].isspace() or c[1].isspace() or SPACE_MARK in c else plain).append(c)
        if plain:
            ids_a, ids_b, ok = t.encode(["".join(plain)])[0]
            if ok:
                a, b = np.array(ids_a, np.int32), np.array(ids_b, np.int32)
                ends = np.cumsum(np.fromiter((len(c.encode("utf-8", "surrogatepass")) for c in plain), np.int64, len(plain)))
                at_a, at_b = (np.searchsorted(np.cumsum(size[ids]), ends) + 1 for size, ids in ((t.a_len, a), (t.b_len, b)))
                self._add(plain, a, at_a, b, at_b, [True] * len(plain))
            else:
                other += plain
        if other:
            ids_a, ids_b, ok = zip(*t.encode(other))
            joined = lambda ids: (np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum(list(map(len, ids))))
            self._add(other, *joined(ids_a), *joined(ids_b), list(ok))
        sizes = list(map(len, chunks))
        self.chars, self.longest = self.chars + sum(sizes), max(self.longest, *sizes, 0)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of all texts one after another, as numbers, and how many each text has."""
        if self.chars > MEMORY_CHARS:
            self.forget()
        cut = [CUT.split(" " + t) if t else [] for t in texts]
        if new := list(dict.fromkeys(c for x in cut for c in x if c not in self.known)):
            self.learn(new)
        sizes = np.array(list(map(len, cut)), np.int64)
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum())), sizes

    def drop_long(self) -> None:
        """Forget everything once long chunks have come in: a worker holds those of one batch at most."""
        if self.longest > LONG_CHUNK:
            self.forget()


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Where the path that merges a and b (a first on ties) meets the diagonals at every `work` steps: places in a and in b."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work), total)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (lo < hi).any():  # the least i so that a[i] goes behind b[d - i - 1]
        mid = (lo + hi) >> 1
        before = (lo < hi) & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - mid - 1, 0, len(b) - 1)])
        lo, hi = np.where(before, mid + 1, lo), np.where(before | (lo >= hi), hi, mid)
    return lo, d - lo


def common_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of equal ends a[i] == b[j]: each piece of the merge path by itself, then boundary pieces stitched."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at_a, at_b = merge_path(a, b, work)
    found_a, found_b = [], []
    for i0, i1, j0, j1 in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]):
        if i0 and j1 > j0 and a[i0 - 1] == b[j0]:  # its partner is the last end of a piece before
            found_a.append([i0 - 1]), found_b.append([j0])
        if i1 > i0 and j1 > j0:
            place = np.searchsorted(b[j0:j1], a[i0:i1])
            same = np.flatnonzero(b[j0 + np.minimum(place, j1 - j0 - 1)] == a[i0:i1])
            found_a.append(i0 + same), found_b.append(j0 + place[same])
    return (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (found_a, found_b))


class Strings:
    """Ids in decimal behind each of the three separators."""

    def __init__(self, n: int):
        self.n = n
        self.table = [sep + str(i).encode() for sep in (b",", b";", b"|") for i in range(n)]

    def digests(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, ends: np.ndarray, text_ends: np.ndarray) -> list[str]:
        """sha256 of `a1,a2|b1;a3|b2` for each text. at: last tokens of groups; ends: a and b tokens up to each text's end; text_ends: groups up to it."""
        code = np.empty(len(a) + len(b), np.int64)
        first_a, first_b = np.append(0, at_a[:-1] + 1), np.append(0, at_b[:-1] + 1)
        kind_a, kind_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        kind_a[first_a], kind_b[first_b] = 1, 2
        code[np.arange(len(a)) + np.repeat(first_b, at_a - first_a + 1)] = kind_a * self.n + a
        code[np.arange(len(b)) + np.repeat(at_a + 1, at_b - first_b + 1)] = kind_b * self.n + b
        out, begin, get = [], 0, self.table.__getitem__
        for end in ends:
            h = hashlib.sha256()
            for k in range(begin, end, 1 << 16):
                part = b"".join(map(get, code[k : min(end, k + (1 << 16))].tolist()))
                h.update(part[1:] if k == begin else part)
            out.append(h.hexdigest() if end > begin else "")
            begin = end
        return out


class Aligner:
    def __init__(self, a_file: str, b_file: str, work: int = WORK):
        self.t = tokenizers_of(a_file, b_file)
        self.encoder, self.work = Encoder(self.t), work
        self.width = len(self.t.b_bytes)
        self.strings = Strings(max(len(self.t.a_bytes), len(self.t.b_bytes)))

    def align(self, texts: list[str]) -> tuple[list, list, list, list, list, list]:
        """For each text: n_a, n_b, n_groups, sha256, distinct linked pairs (a * width + b), and how often each stands in it."""
        chunks, per_text = self.encoder.numbers(texts)
        owner = np.repeat(np.arange(len(texts)), per_text)
        bad = np.bincount(owner, ~self.encoder.ok[chunks], len(texts)) > 0
        chunks, owner = chunks[~bad[owner]], owner[~bad[owner]]
        a, a_size = self.encoder.a.take(chunks)
        b, b_size = self.encoder.b.take(chunks)
        n_a, n_b = (np.bincount(owner, size, len(texts)).astype(np.int64) for size in (a_size, b_size))
        at_a, at_b = common_ends(np.cumsum(self.t.a_len[a]), np.cumsum(self.t.b_len[b]), self.work)
        upto_a = np.cumsum(n_a)
        groups_upto = np.searchsorted(at_a, upto_a)  # every text's last tokens end together
        n_groups = np.diff(groups_upto, prepend=0)
        sha = self.strings.digests(a, b, at_a, at_b, upto_a + np.cumsum(n_b), groups_upto) if len(a) else [""] * len(texts)
        linked = a[at_a].astype(np.int64) * self.width + b[at_b]
        pairs, times, begin = [], [], 0
        for end in groups_upto:
            p, n = np.unique(linked[begin:end], return_counts=True)
            pairs.append(p), times.append(n)
            begin = end
        self.encoder.drop_long()
        return n_a.tolist(), n_b.tolist(), n_groups.tolist(), sha, pairs, times


@lru_cache(maxsize=1)
def aligner_of(a_file: str, b_file: str) -> Aligner:
    """A worker's aligner; what it remembers serves its later tasks too."""
    return Aligner(a_file, b_file)


def linked_pairs(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times for every row of docs(doc_id, text): the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner_of(a_file, b_file)
        for b in batches:
            held: list[str] = []
            ids, chars, begin = b.column(0), 0, 0
            for k, text in enumerate(b.column(1)):
                held.append(text.as_py() or "")
                chars += len(held[-1])
                if chars >= BATCH_CHARS or k + 1 == b.num_rows:
                    n_a, n_b, n_groups, sha, pairs, times = made.align(held)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(begin, len(held)), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(sha, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                        names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
                    )
                    held, chars, begin = [], 0, k + 1

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pair_counts(linked: DataFrame, width: int) -> DataFrame:
    """pair, n (links of the corpus that hold it), best (no pair of its B id has more)."""
    each = linked.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum(F.col("times").cast("long")).alias("n"))
    of_b = Window.partitionBy(F.col("pair") % width)
    return each.withColumn("best", F.col("n") == F.max("n").over(of_b))


def _scored_by_arrays(linked: DataFrame, counts: DataFrame) -> DataFrame:
    held = counts.toArrow().sort_by("pair")
    sent = linked.sparkSession.sparkContext.broadcast(tuple(np.ascontiguousarray(held.column(c).to_numpy()) for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times")
            bounds = pairs.offsets.to_numpy()
            flat, often = pairs.values.to_numpy()[bounds[0] : bounds[-1]], times.values.to_numpy()[times.offsets[0].as_py() : times.offsets[-1].as_py()].astype(np.int64)
            at = np.searchsorted(pair, flat)
            best_upto, sum_upto = (np.append(0, np.cumsum(x)) for x in (often * best[at], often * n[at]))
            over = bounds - bounds[0]
            cells = [b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(np.diff(best_upto[over]), pa.int64()), pa.array(np.diff(sum_upto[over]), pa.int64())], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum"])

    return linked.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")


def _scored_by_join(linked: DataFrame, counts: DataFrame) -> DataFrame:
    rows = materialize(linked.withColumn("row", F.monotonically_increasing_id()), "linked_rows")
    each = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).join(counts, F.col("pairs") == F.col("pair"))
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, "row", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}).drop("row")


def align(docs: DataFrame, a_file: str, b_file: str, *, pairs_sent: int = PAIRS_SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs(doc_id, text)."""
    linked = materialize(linked_pairs(docs, a_file, b_file), "linked_pairs")
    counts = materialize(pair_counts(linked, len(tokenizers_of(a_file, b_file).b_bytes)), "pair_counts")
    scored = _scored_by_arrays(linked, counts) if counts.count() <= pairs_sent else _scored_by_join(linked, counts)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
