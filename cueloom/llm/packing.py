"""Packing of token sequences by swap-based local search.

Each document becomes its token ids and an end id; only documents longer than a sequence are cut,
into full pieces and a remainder. Packing moves piece lengths, never texts.

A shard starts from two cheap packings, in order of arrival and by falling length (each piece into the
tightest open bin). From each, local search goes over the underfull bins, the fullest first: a bin takes
a piece from another one, exchanges one for one, one for two or two for one, the step that fills it
most, always so that the fuller bin gains, which raises the sum of squared fills, until no step helps
and emptied bins are gone. The better of the two results stands.

Distribution: pieces are dealt by a hash of their place in the (written) table into shards of bounded
size, so rows that repeat one doc_id spread as all others do. Every underfull bin of a shard is
searched; then its full bins are placed, and of the others the emptiest, with at most one piece in
PASS_ON of the shard's, go to the next round, whose shards are fewer by that factor, until one shard
holds all that is left. No task and no driver holds more than a shard, whatever the input.

Defined results: null and empty texts give one piece of length 1 (the end id). Rows that repeat a
doc_id are packed each on their own and are not distinguished in the output. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize

SEQUENCE = 2048
SHARD_PIECES = 20_000
#: Words kept in a worker's memory; a full memory is emptied.
WORD_MEMORY = 500_000
#: A shard passes on one piece in so many, at most.
PASS_ON = 8


#: Words of these letters alone are single pieces already in normal form.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_chars() -> str:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


class WordIds:
    """Ids of texts, word by word.

    The tokenizer's pieces never span ASCII white space and none of its steps looks across it, so a
    word between white space is encoded once and remembered. A full stop or comma behind a plain
    word is a piece of its own; a plain word goes to the merges directly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = self.tokenizer.model
        self.chars = _byte_chars()
        self.words: dict[bytes, bytes] = {}
        self.plain: dict[bytes, bytes] = {}
        self.marks = {m: self._whole(m) for m in (b".", b",")}

    def _whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace").lower()
        mark = b""
        if text[-1] in ".,":
            text, mark = text[:-1], self.marks[text[-1].encode()]
        if not PLAIN.fullmatch(text):
            return self._whole(word)
        key = text.encode()
        got = self.plain.get(key)
        if got is None:
            got = self.plain[key] = array("I", [t.id for t in self.merges.tokenize(codecs.charmap_decode(key, "strict", self.chars)[0])]).tobytes()
        return got + mark

    def of(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(self.words) > WORD_MEMORY:
            self.words.clear()
        if len(self.plain) > WORD_MEMORY:
            self.plain.clear()
        words, memory = text.encode("utf-8", "surrogatepass").split(), self.words
        got = list(map(memory.get, words))
        if None in got:
            for k, ids in enumerate(got):
                if ids is None:
                    w = words[k]
                    ids = memory.get(w)
                    if ids is None:
                        ids = memory[w] = self._word(w)
                    got[k] = ids
        return b"".join(got)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_file: str, *, sequence: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_file).of
        for whole in batches:
            out: list[tuple] = []
            for doc, text in zip(whole.column(0).to_pylist(), whole.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for k, s in enumerate(range(0, n, sequence)):
                    e = min(n, s + sequence)
                    out.append((doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def in_order(lengths: list[int], size: int) -> list[list[int]]:
    """Each piece, as it comes, into the tightest open bin that holds it: bins as lists of positions in lengths.

    The room left in open bins is a bit set, so the tightest bin that fits is its lowest bit from
    the piece's length on.
    """
    bins: list[list[int]] = []
    with_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0
    for i, n in enumerate(lengths):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            if not with_room[room - n]:
                rooms |= 1 << (room - n)
            with_room[room - n].append(b)
    return bins


class _Underfull:
    """Bins with room left, and their pieces by length: which lengths there are (as bits) and who holds them."""

    def __init__(self, lengths: list[int], bins: list[list[int]], size: int):
        self.lengths, self.size = lengths, size
        self.bins = {b: sorted(members, key=lengths.__getitem__) for b, members in enumerate(bins)}
        self.fill = {b: sum(map(lengths.__getitem__, members)) for b, members in self.bins.items()}
        self.owner: dict[int, int] = {}
        self.held: dict[int, set[int]] = defaultdict(set)
        self.present = 0
        self.full: dict[int, list[int]] = {}
        for b in list(self.bins):
            for i in self.bins[b]:
                self._enter(i, b)
            self._settle(b)

    def _enter(self, i: int, b: int) -> None:
        self.owner[i] = b
        self.held[self.lengths[i]].add(i)
        self.present |= 1 << self.lengths[i]

    def _leave(self, i: int) -> None:
        n = self.lengths[i]
        self.held[n].discard(i)
        if not self.held[n]:
            self.present &= ~(1 << n)

    def _settle(self, b: int) -> None:
        """A full bin is done, an empty one gone."""
        if self.fill[b] == self.size:
            self.full[b] = self.bins[b]
            for i in self.bins[b]:
                self._leave(i)
        if self.fill[b] in (0, self.size):
            del self.bins[b], self.fill[b]

    def exchange(self, b: int, out: list[int], other: int, into: list[int]) -> None:
        """Pieces `out` of b go to the other bin, `into` come from there."""
        for i in out:
            self.bins[b].remove(i)
        for i in into:
            self.bins[other].remove(i)
        for here, pieces in ((b, into), (other, out)):
            for i in pieces:
                insort(self.bins[here], i, key=self.lengths.__getitem__)
                self.owner[i] = here
        gain = sum(map(self.lengths.__getitem__, into)) - sum(map(self.lengths.__getitem__, out))
        self.fill[b] += gain
        self.fill[other] -= gain
        self._settle(b), self._settle(other)

    def _partner(self, b: int, most: int, least: int, more_than: int) -> tuple[int, int] | None:
        """The longest piece of at most `most` and more than `more_than` tokens that another bin can give, from the emptiest bin.

        b gains what the piece is longer than `least`, and must end up fuller than the giver.
        """
        lengths = self.present & ((1 << (most + 1)) - 1)
        while lengths:
            n = lengths.bit_length() - 1
            if n <= more_than:
                return None
            i = min(self.held[n], key=lambda k: (self.owner[k] == b, self.fill[self.owner[k]], k))
            if self.owner[i] != b and self.fill[b] + n - least > self.fill[self.owner[i]]:
                return n, i
            lengths ^= 1 << n
        return None

    def best_step(self, b: int, donor: int) -> tuple[int, list[int], int, list[int]] | None:
        """gain, pieces that leave b, the other bin, pieces that come: a move, one for one, one for two, or two of the donor's for one."""
        room = self.size - self.fill[b]
        mine = self.bins[b]
        best: tuple[int, list[int], int, list[int]] | None = None
        gain = 0
        for out in ([], *([i] for i in mine), *([i, k] for at, i in enumerate(mine) for k in mine[at + 1 :])):
            least = sum(map(self.lengths.__getitem__, out))
            got = self._partner(b, min(least + room, self.size), least, least + gain)
            if got:
                gain, best = got[0] - least, (got[0] - least, out, self.owner[got[1]], [got[1]])
                if gain == room:
                    return best
        theirs = self.bins[donor] if donor != b else []
        for i in mine:
            n, lo, hi = self.lengths[i], 0, len(theirs) - 1
            while lo < hi:
                both = self.lengths[theirs[lo]] + self.lengths[theirs[hi]] - n
                if both > room:
                    hi -= 1
                    continue
                if both > gain and self.fill[b] + both > self.fill[donor]:
                    gain, best = both, (both, [i], donor, [theirs[lo], theirs[hi]])
                lo += 1
        return best


    def refine(self) -> bool:
        """Underfull bins exchange pieces for two of the same length together from full bins; fills stay, pieces get smaller."""
        pairs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        wanted = {self.lengths[i] for members in self.bins.values() for i in members}
        for b, members in self.full.items():
            for at, i in enumerate(members):
                for k in members[at + 1 :]:
                    n = self.lengths[i] + self.lengths[k]
                    if n in wanted:
                        pairs[n].append((b, i, k))
        touched: set[int] = set()
        for b, members in self.bins.items():
            for i in list(members):
                options = pairs[self.lengths[i]]
                while options and options[-1][0] in touched:
                    options.pop()
                if options:
                    other, *two = options.pop()
                    touched.add(other)
                    self.full[other] = [k for k in self.full[other] if k not in two] + [i]
                    members.remove(i)
                    self._leave(i)
                    for k in two:
                        insort(members, k, key=self.lengths.__getitem__)
                        self._enter(k, b)
        return bool(touched)

    def improve(self) -> None:
        """Passes over all bins, the fullest first, as long as one changes anything."""
        changed = True
        while changed and len(self.bins) > 1:
            changed = False
            order = sorted(self.bins, key=lambda b: (-self.fill[b], b))
            donors = order[:]
            for b in order:
                while b in self.bins:
                    while donors[-1] not in self.bins:
                        donors.pop()
                    step = self.best_step(b, donors[-1])
                    if step is None:
                        break
                    self.exchange(b, *step[1:])
                    changed = True


def local_search(lengths: list[int], bins: list[list[int]], size: int) -> list[list[int]]:
    """Move and exchange pieces between underfull bins, each step raising the sum of squared fills, until none helps.

    The fullest bins are filled first, from the emptiest that have a fitting piece. When no step is
    left and the bins are more than the lower bound, pieces are exchanged for smaller ones from full
    bins and the search goes on. That ends: between two steps that raise the sum, each exchange adds a
    piece to the underfull bins.
    """
    least = -(-sum(lengths) // size)
    state = _Underfull(lengths, bins, size)
    state.improve()
    while len(state.full) + len(state.bins) > least and state.refine():
        state.improve()
    return [*state.full.values(), *state.bins.values()]


def falling(lengths: list[int], size: int) -> list[list[int]]:
    """As in_order, the longest pieces first (best fit decreasing)."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    return [[order[k] for k in b] for b in in_order([lengths[i] for i in order], size)]


def best_packing(lengths: list[int], size: int) -> list[list[int]]:
    """The search from both starts; the fewer bins count."""
    return min((local_search(lengths, start(lengths, size), size) for start in (in_order, falling)), key=len)


def _pack_shard(pdf: pd.DataFrame, size: int, final: bool, search: bool = True) -> pd.DataFrame:
    lengths = [int(n) for n in pdf["length"]]
    bins = best_packing(lengths, size) if search else in_order(lengths, size)
    fills = [sum(lengths[i] for i in b) for b in bins]
    number, offset, sealed = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64"), np.ones(len(lengths), bool)
    for b, members in enumerate(bins):
        at = 0
        for i in members:
            number[i], offset[i] = b, at
            at += lengths[i]
    left = 0 if final else len(lengths) // PASS_ON
    for b in sorted(range(len(bins)), key=fills.__getitem__):
        left -= len(bins[b])
        if left < 0 or fills[b] == size:
            break
        sealed[bins[b]] = False
    return pdf.assign(bin=number, offset=offset, sealed=sealed)


def _packer(size: int, final: bool, search: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard_order", "doc_id", "piece", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        return _pack_shard(pdf, size, final, search)

    return run


def deal(pieces: DataFrame, shards: int, level: int) -> DataFrame:
    """pieces with their shard, whatever keys they share, and their order in it. Rows of a written table get the same ones on every read."""
    mixed = F.xxhash64(F.monotonically_increasing_id(), F.lit(level))
    return pieces.withColumns({"shard": F.pmod(mixed, F.lit(shards)).cast("long"), "shard_order": mixed})


def pack(pieces: DataFrame, *, size: int = SEQUENCE, shard_pieces: int = SHARD_PIECES, search: bool = True) -> DataFrame:
    """Assign every piece a sequence_id and an offset. pieces, a written table: doc_id, piece, start, length, ids_crc32.

    Full-length pieces are placed at once. search=False leaves every shard as it is packed in order of
    arrival, to compare.
    """
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = F.col("length") >= size
    whole = pieces.filter(alone).select(*cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(~alone).select(*cols)
    placed = [whole]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, shard long, shard_order long, bin long, offset long, sealed boolean"
    base, n = 0, rest.count()
    level = 0
    while n or not level:
        shards = max(1, -(-n // shard_pieces))
        final = shards == 1
        packed = deal(rest, shards, level).groupBy("shard").applyInPandas(_packer(size, final, search), schema)
        if not final:
            packed = materialize(packed, f"packed{level}")
        number = F.lit(base).cast("long") + F.col("shard") * F.lit(shard_pieces * 4).cast("long") + F.col("bin")
        placed.append(packed.filter("sealed").select(*cols, number.alias("sequence_id"), "offset"))
        if final:
            break
        base += shards * shard_pieces * 4
        rest = packed.filter("not sealed").select(*cols)
        n, level = rest.count(), level + 1
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(docs: DataFrame, tokenizer_file: str, *, sequence: int = SEQUENCE, end_id: int = 0, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Tokenise, cut and pack every document of docs(doc_id, text)."""
    cut = materialize(pieces(docs, tokenizer_file, sequence=sequence, end_id=end_id), "pieces")
    return pack(cut, size=sequence, shard_pieces=shard_pieces)
