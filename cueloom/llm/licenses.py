"""Licence scan with a generalised suffix automaton of licence words.

The automaton holds the words of all templates. A text is streamed through it once: at every word
it knows the longest run of words, ending there, that stands in some template (the matching
statistics). Runs that reach a phrase's length give the base labels. For every template the long runs,
at all places where they stand in it, are anchors; the best chain of anchors that follow one another
in text and template alike covers a span, and a template that is covered far enough gives its label.

Rows: one output row per input row; a null text has no words. Words are whole: the text is never
cut. Repeated rows and other columns do no harm.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .licence_texts import SENTENCES, WHOLE

#: Phrase and label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Wordings of licences, whole and by sentence, and the label each adds when it is covered.
TEMPLATES = WHOLE + SENTENCES

#: A run counts towards a template from this many words on; a template is found when this share of it is covered.
MIN_RUN = 3
MIN_COVER = 0.8
#: Runs of one template may be this many words further apart in the text than in the template.
MAX_GAP = 8

#: Bytes to bytes: A-Z in lower case, other bytes under 0x80 that are no word character to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over word ids; states know where their runs end in which template."""

    def __init__(self, texts: tuple[str, ...]):
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, text in enumerate(texts):
            last = 0
            for pos, w in enumerate(words_of(text)):
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                self.ends[last].append((k, pos + 1))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:  # what ends here also ends the shorter runs behind the link
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length), self.link.append(link), self.step.append(step), self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = twin
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:  # an earlier template already has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def state_of(self, text: str) -> int:
        s = 0
        for w in words_of(text):
            s = self.step[s][self.ids[w]]
        return s

    def chain(self, s: int) -> Iterator[int]:
        while s > 0:
            yield s
            s = self.link[s]


class Scanner:
    def __init__(self, phrases, templates):
        self.templates = templates
        self.sizes = [len(words_of(t)) for t, _ in templates]
        self.sam = Automaton((*(t for t, _ in templates), *(p for p, _ in phrases)))
        owner: dict[int, list[tuple[int, str]]] = {}
        for phrase, label in phrases:
            owner.setdefault(self.sam.state_of(phrase), []).append((len(phrase.split()), label))
        #: Phrases that end wherever a run of this state ends, if the run is long enough.
        self.phrases = [[x for t in self.sam.chain(s) for x in owner.get(t, [])] for s in range(len(self.sam.length))]

    def scan(self, text: str):
        """n_words, base places (start, label), covered template spans (label, first word, end word, share)."""
        words = words_of(text)
        sam, known = self.sam, self.sam.ids
        step, link, length, phrases = sam.step, sam.link, sam.length, self.phrases
        base: list[tuple[int, str]] = []
        runs: list[tuple[int, int, int]] = []  # (end, run, state), where a run could not be continued
        s = run = 0
        for at, c in enumerate(map(known.get, words)):
            if c is None:
                if run >= MIN_RUN:
                    runs.append((at, run, s))
                s = run = 0
                continue
            if c not in step[s]:
                if run >= MIN_RUN:
                    runs.append((at, run, s))
                while s > 0 and c not in step[s]:
                    s = link[s]
                run = length[s]
            s = step[s].get(c, 0)
            run = run + 1 if s else 0
            if phrases[s]:
                base += [(at + 1 - n, label) for n, label in phrases[s] if n <= run]
        if run >= MIN_RUN:
            runs.append((len(words), run, s))
        return len(words), base, self._chains(runs)

    def _chains(self, runs):
        """Covered spans (first word, end word, label, share) of all templates, from the runs in text order."""
        anchors: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, run, s in runs:
            for k, pos in self.sam.ends[s]:
                if k < len(self.templates):
                    anchors.setdefault(k, []).append((end - run, end, pos - run, pos))
        found = []
        for k, held in anchors.items():
            if sum(a[1] - a[0] for a in held) >= MIN_COVER * self.sizes[k]:
                found += [(first, end, self.templates[k][1], share) for first, end, share in best_chains(held, self.sizes[k])]
        return sorted(found)


def best_chains(anchors: list[tuple[int, int, int, int]], size: int) -> list[tuple[int, int, float]]:
    """The best chains of anchors (start and end in the text, start and end in a template of so many words) that don't overlap in the text.

    A chain covers as many words as its anchors have in text and template alike; the text may hold
    MAX_GAP words more between two anchors than the template. An anchor looks back over as much text
    as the template and such a gap are long, so time grows with the text. (first word, end word,
    share) of the chains that cover MIN_COVER.
    """
    best: list[tuple[int, int]] = []  # of the chains that end with each anchor: words covered, minus the first word
    whole = []
    for i, (s, e, p, q) in enumerate(anchors):
        top = (e - s, -s)
        for j in range(i - 1, -1, -1):
            _, e0, _, q0 = anchors[j]
            if s - e0 > size + MAX_GAP:
                break
            if q0 < q and e0 < e and s - e0 <= MAX_GAP + max(0, p - q0):
                covered, first = best[j]
                top = max(top, (covered + min(e - max(s, e0), q - max(p, q0)), first))
        best.append(top)
        if top[0] >= MIN_COVER * size:
            whole.append((-top[0], e, -top[1]))
    out: list[tuple[int, int, float]] = []
    for covered, e, s in sorted(whole):
        at = bisect_left(out, (s, e, 0.0))
        if (not at or out[at - 1][1] <= s) and (at == len(out) or e <= out[at][0]):
            out.insert(at, (s, e, min(1.0, -covered / size)))
    return out


@lru_cache(maxsize=2)
def scanner(phrases=PHRASES, templates=TEMPLATES) -> Scanner:
    return Scanner(phrases, templates)


def scan(docs: DataFrame, *, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score: 1 for a base place or a whole template, else the largest covered share. spans: the
    covered spans as label:first word:end word, comma-joined in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan_text = scanner(phrases, templates).scan
        for b in batches:
            rows = []
            for text in b.column(1):
                n, base, spans = scan_text(text.as_py() or "")
                starts = [s for s, _ in base]
                base_labels = sorted({x for _, x in base})
                rows.append((
                    n, len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels),
                    ",".join(sorted({*base_labels, *(x for _, _, x, _ in spans)})),
                    1.0 if base else max((share for *_, share in spans), default=0.0),
                    ",".join(f"{x}:{s}:{e}" for s, e, x, _ in spans),
                ))
            cols = list(zip(*rows)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    )
