"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of labelled text. A document
is cut greedily into the longest phrases that occur in that sample; the language that needs the
fewest phrases per character wins.

The automata are small tables (their sample is bounded), rebuilt once in each Python worker. All
documents of a batch are parsed side by side: a step of the parse is one table look-up for a whole
column of characters, so no Python code runs per character. Long texts are parsed in lanes of LANE
characters; what the open phrase at the end of a lane changes in the next one is parsed again until
both parses are in the same state, so that the count is that of one parse of the whole text. Every language tells apart all letters of its own
sample, and there may be any number of languages: tables are dense while they fit in DENSE_ENTRIES,
and sorted keys of the transitions there are beyond that.

Defined results: a null text, an empty one and one without a letter get `und` and score 0, and so
does every row when there is no labelled row. Ties go to the language first in order. Repeated
rows are judged each on their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Bounds of the training sample: characters of each language, characters of one text.
CHARS_PER_LANGUAGE = 24_000
MAX_TEXT_CHARS = 4_000
#: Entries of all dense look-up tables of a parser.
DENSE_ENTRIES = 1 << 25
LANE = 512
CHUNK_CHARS = 1 << 19
#: Rows of a batch that keep_identified filters at a time.
SLICE = 512
#: So many lanes or fewer are carried on symbol by symbol.
FEW = 24

SEPARATOR, UNKNOWN, PAD, FIRST = 0, 1, 2, 3


def training_sample(labelled: DataFrame, *, chars: int = CHARS_PER_LANGUAGE, max_text: int = MAX_TEXT_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, text) pairs from labelled(doc_id, text, lang), at most `chars` characters a language.

    Texts are taken in the order of a hash of doc_id; one text gives at most max_text characters.
    Only the bounded sample reaches the driver.
    """
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return ()
    want = max(8, 8 * chars // max_text)  # enough even where most texts are short
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * want / r["count"]))])
    order = F.xxhash64(F.lit(17), "doc_id")
    uniform = F.pmod(order, F.lit(1 << 40)) / float(1 << 40)
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("o", "text").rowsBetween(Window.unboundedPreceding, -1))
    rows = (
        labelled.withColumn("share", share[F.col("lang")]).filter(uniform < F.col("share"))
        .select("lang", order.alias("o"), F.substring("text", 1, max_text).alias("text"))
        .filter(F.length("text") > 0)
        .withColumn("left", chars - F.coalesce(before, F.lit(0))).filter("left > 0").collect()
    )
    return tuple(sorted((r["lang"], r["text"][: r["left"]]) for r in rows))


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence: for every state the next one by symbol."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """By code point the code point of its lower case, 0 where it is no letter."""
    out = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class Table:
    """Look-up table of one language over its own letters.

    At state*alphabet + symbol stands next_state*alphabet << 2 | phrases counted (0 to 2). A symbol that
    can't continue the open phrase ends it and opens the next; one that the sample lacks altogether is
    a phrase by itself.
    """

    def __init__(self, symbols: np.ndarray, shared: int):
        own = np.unique(symbols[symbols >= FIRST])
        self.alphabet = FIRST + len(own)
        self.local = np.full(shared, UNKNOWN, np.uint8 if self.alphabet <= 256 else np.int32)
        self.local[SEPARATOR] = SEPARATOR
        self.local[own] = np.arange(FIRST, self.alphabet)
        self.steps = suffix_automaton(self.local[symbols])
        self.entries = len(self.steps) * self.alphabet

    def build(self, dense: bool) -> None:
        root = np.full(self.alphabet, -1, np.int64)
        root[list(self.steps[0])] = list(self.steps[0].values())
        #: What a symbol that can't continue leads to; from an open phrase one more is counted.
        self.miss = (np.maximum(root, 0) * self.alphabet << 2) + (root < 0)
        sizes = [len(s) for s in self.steps]
        keys = np.repeat(np.arange(len(sizes)) * self.alphabet, sizes) + np.fromiter((c for s in self.steps for c in s), np.int64, sum(sizes))
        nexts = np.fromiter((n for s in self.steps for n in s.values()), np.int64, sum(sizes)) * self.alphabet << 2
        if dense:
            kind = np.int32 if self.entries < 1 << 29 else np.int64
            flat = np.tile(self.miss.astype(kind), len(sizes))
            flat[self.alphabet :] += 1  # at the root no phrase is open
            flat[keys] = nexts
            self.flat, self.view, self.keys = flat, memoryview(flat), None
        else:
            by_key = np.argsort(keys)
            self.keys = np.append(keys[by_key], np.iinfo(np.int64).max)
            self.nexts = np.append(nexts[by_key], 0)
        del self.steps

    def one(self, state: int, symbol: int) -> int:
        """step() of a single state."""
        if self.keys is None:
            return self.view[state + symbol]
        at = int(np.searchsorted(self.keys, state + symbol))
        return int(self.nexts[at]) if self.keys[at] == state + symbol else int(self.miss[symbol]) + (state > 0)

    def kind(self) -> np.dtype:
        """Type of states."""
        return self.flat.dtype if self.keys is None else np.dtype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.keys is None:
            return self.flat[state + symbol]
        key = state + symbol
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.nexts[at], self.miss[symbol] + (state > 0))


class Parser:
    """Cross-parsing tables of all languages of one sample."""

    def __init__(self, sample: tuple[tuple[str, str], ...], dense_entries: int = DENSE_ENTRIES):
        self.languages = sorted({lang for lang, _ in sample})
        letters = np.unique(folded()[code_points([t for _, t in sample])])
        letters = letters[letters > 0]
        self.place = np.full(0x110000, UNKNOWN, np.int32)
        self.place[0] = SEPARATOR
        self.place[letters] = np.arange(FIRST, FIRST + len(letters))
        texts: dict[str, list[str]] = {}
        for lang, t in sample:
            texts.setdefault(lang, []).append(t)
        self.tables = []
        for one in self.languages:
            table = Table(self.symbols(texts[one])[0], FIRST + len(letters))
            dense = table.entries <= dense_entries
            dense_entries -= table.entries if dense else 0
            table.build(dense)
            self.tables.append(table)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in one array, runs of separators as one, and the texts' lengths in it."""
        lens = np.array([len(t) for t in texts], np.int64)
        kinds = self.place[folded()[code_points(texts)]]
        begins = np.zeros(len(kinds) + 1, bool)
        begins[np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)] = True
        keep = kinds != SEPARATOR
        keep[1:] |= kinds[:-1] != SEPARATOR
        keep |= begins[:-1]
        upto = np.concatenate([[0], np.cumsum(keep)])
        ends = np.cumsum(lens)
        return kinds[keep], upto[ends] - upto[ends - lens]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of every text under every language [text, language], symbols and letters of every text."""
        symbols, lens = self.symbols(texts)
        first = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
        n_lanes = -(-lens // LANE)
        owner = np.repeat(np.arange(len(texts)), n_lanes)
        ordinal = np.arange(len(owner)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
        at = first[owner] + ordinal * LANE
        size = np.minimum(LANE, lens[owner] - ordinal * LANE)
        last = ordinal + 1 == n_lanes[owner]
        by_size = np.argsort(-size, kind="stable")
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        if len(at):
            active = np.searchsorted(-size[by_size], -np.arange(LANE), side="left")  # lanes longer than t
            for k, table in enumerate(self.tables):
                own = table.local[symbols]
                state, ended, begins = np.zeros(len(at), table.kind()), np.zeros(len(at), np.int64), at[by_size]
                for t in range(int(size.max())):
                    m = int(active[t])
                    got = table.step(state[:m], own[begins[:m] + t])
                    ended[:m] += got & 3
                    state[:m] = got >> 2
                in_order = np.empty_like(by_size)
                in_order[by_size] = np.arange(len(by_size))
                ended, state = self._carried(table, own, at, size, last, ended[in_order], state[in_order])
                counts[:, k] = np.bincount(owner, ended + (last & (state > 0)), len(texts)).astype(np.int64)
        is_letter = np.concatenate([[0], np.cumsum(symbols != SEPARATOR)])
        return counts, lens, is_letter[first + lens] - is_letter[first]

    @staticmethod
    def _carried(table: Table, own: np.ndarray, at: np.ndarray, size: np.ndarray, last: np.ndarray, ended: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ended in each lane and the state behind it, when lanes go on from the lane before instead of a new phrase."""
        alone, final, more = state, state.copy(), np.zeros(len(at), np.int64)
        lanes = np.flatnonzero(~last & (final > 0)) + 1
        while len(lanes):
            true, fresh, gain = final[lanes - 1], np.zeros(len(lanes), state.dtype), np.zeros(len(lanes), np.int64)
            new = alone[lanes].copy()
            live, t = np.flatnonzero(true != fresh), 0
            while len(live) > FEW:
                symbol = own[at[lanes[live]] + t]
                one, two = table.step(true[live], symbol), table.step(fresh[live], symbol)
                gain[live] += (one & 3).astype(np.int64) - (two & 3)
                true[live], fresh[live] = one >> 2, two >> 2
                t += 1
                apart = live[true[live] != fresh[live]]
                over = size[lanes[apart]] == t
                new[apart[over]] = true[apart[over]]
                live = apart[~over]
            for k in live.tolist():  # the last ones symbol by symbol
                begin, end = at[lanes[k]] + t, at[lanes[k]] + size[lanes[k]]
                a, b, g = int(true[k]), int(fresh[k]), 0
                for symbol in own[begin:end].tolist():
                    x, y = table.one(a, symbol), table.one(b, symbol)
                    g += (x & 3) - (y & 3)
                    a, b = x >> 2, y >> 2
                    if a == b:
                        break
                else:
                    new[k] = a
                gain[k] += g
            more[lanes] = gain
            changed = lanes[(new != final[lanes]) & ~last[lanes]]
            final[lanes] = new
            lanes = changed + 1
        return ended + more, final

    def judge(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (how far the runner-up needs more phrases, 0 to 1) and phrases per symbol."""
        return self.judge_lengths(texts)[:3]

    def judge_lengths(self, texts: list[str]) -> tuple[list[str], list[float], list[float], list[int]]:
        """As judge, and the symbols of every text."""
        counts, lens, letters = self.phrases(texts)
        langs, scores, rates = [], [], []
        for row, n, some in zip(counts, lens.tolist(), letters.tolist()):
            if not some or not self.languages:
                langs.append("und"), scores.append(0.0), rates.append(1.0)
                continue
            order = np.argsort(row, kind="stable")
            best = int(row[order[0]])
            other = int(row[order[1]]) if len(row) > 1 else n
            langs.append(self.languages[order[0]])
            scores.append(max(0.0, 1 - best / other) if other else 0.0)
            rates.append(best / n)
        return langs, scores, rates, lens.tolist()


@lru_cache(maxsize=2)
def parser(sample: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(sample)


def judged(known: Parser, texts: pa.Array) -> tuple[list[str], list[float], list[float], list[int]]:
    """judge_lengths of all texts, some CHUNK_CHARS characters in Python's hands at a time."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    held: list[str] = []
    chars = 0
    for k, t in enumerate(texts):
        held.append(t.as_py() or "")
        chars += len(held[-1])
        if chars >= CHUNK_CHARS or k + 1 == len(texts):
            for all_, got in zip(out, known.judge_lengths(held)):
                all_ += got
            held, chars = [], 0
    return out


def identify(docs: DataFrame, sample: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, lang_pred, score, phrase_rate for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = parser(sample)
        for b in batches:
            langs, scores, rates, _ = judged(known, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=["doc_id", "lang_pred", "score", "phrase_rate"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, phrase_rate double")


def in_fold(held_out: bool = True):
    """crc32 of doc_id as text, modulo 3, is 1."""
    one = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return one if held_out else ~one


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out third and judge every row."""
    sample = training_sample(docs.filter(in_fold(False)).select("doc_id", "text", "lang"))
    return identify(docs, sample).withColumn("held_out", F.coalesce(in_fold(), F.lit(False)))


#: A rate that always stays: fewer phrases than one for every other character.
REJECT_RATE = 0.5


def halves(texts: list[str]) -> list[list[str]]:
    return [texts[::2], texts[1::2]] if len(texts) > 1 else [[t[: len(t) // 2], t[len(t) // 2 :]][k : k + 1] for t in texts for k in (0, 1)]


def rate_limits(sample: tuple[tuple[str, str], ...], floor: float = REJECT_RATE) -> dict[str, list[float]]:
    """For every language the most phrases per symbol that its own labelled text needs, by log2 of the symbols.

    One half of the language's sample is parsed by the other and the other way round, in pieces of
    every length. No limit is under the floor or under that of longer texts; lengths beyond the
    sample's have the limit of its longest pieces.
    """
    texts: dict[str, list[str]] = {}
    for lang, t in sample:
        texts.setdefault(lang, []).append(t)
    out = {}
    for lang, own in texts.items():
        most: dict[int, float] = {}
        one, two = halves(own)
        for learn, judge in ((one, two), (two, one)):
            if not any(learn) or not any(judge):
                continue
            known = Parser(tuple((lang, t) for t in learn if t))
            for k in range(MAX_TEXT_CHARS.bit_length()):
                pieces = [t[at : at + (1 << k)] for t in judge for at in range(0, len(t), 1 << k)]
                counts, lens, letters = known.phrases(pieces)
                for n, size, some in zip(counts[:, 0].tolist(), lens.tolist(), letters.tolist()):
                    if some:
                        b = size.bit_length() - 1
                        most[b] = max(most.get(b, floor), n / size)
        limits = [most.get(b, floor) for b in range(max(most, default=0) + 1)] if most else [1.0]
        for b in range(len(limits) - 2, -1, -1):
            limits[b] = max(limits[b], limits[b + 1])
        out[lang] = limits
    return out


def keep_identified(docs: DataFrame, *, reject_rate: float = REJECT_RATE) -> DataFrame:
    """Rows of docs whose language was told, with lang set to it where it was null.

    A text stays if it needs no more phrases per symbol than the labelled texts of its language do at
    its length (rate_limits), and in any case up to reject_rate.

    The decision is made from the text inside the same pass, so rows that repeat a doc_id each get
    their own and no join is needed.
    """
    sample = training_sample(docs.filter(in_fold(False)).select("doc_id", "text", "lang"))
    limits = rate_limits(sample, reject_rate)
    at = docs.columns.index("text")

    def stay(lang: str, rate: float, size: int) -> bool:
        if lang == "und":
            return False
        own = limits[lang]
        return rate <= own[min(size.bit_length(), len(own)) - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = parser(sample)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                langs, _, rates, sizes = judged(known, b.column(at))
                stays = pa.array(list(map(stay, langs, rates, sizes)), pa.bool_())
                held = list(b.columns)
                if "lang" in b.schema.names:
                    k = b.schema.names.index("lang")
                    held[k] = pa.array([old if old is not None else new for old, new in zip(b.column(k).to_pylist(), langs)], pa.string())
                yield pa.RecordBatch.from_arrays(held, names=b.schema.names).filter(stays)

    return docs.mapInArrow(run, docs.schema)
