"""Cues that are too long: spans of recognised words that carry their text, or their sentences."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import norm_alnum
from .intervals import END, START
from .walk import walk_groups

MAX_MS = 15_000
MIN_SIMILARITY, SHORT_SIMILARITY, MIN_COVERAGE, MIN_PROBABILITY = 0.65, 0.80, 0.70, 0.35
PAD_START, PAD_END = 150, 250
#: Characters of a stretch of text in the join of words.
STRETCH = 64
#: Attempts at a cue further apart than this need review.
REVIEW_SHIFT_MS = 1_500
SENTENCE, FINE = "。！？!?", "。！？!?、，,；;"


def word_spans(words: DataFrame, target_chars: str = "target_chars", by: tuple[str, ...] = ("cue",)) -> DataFrame:
    """All spans [first, last] of a cue's words up to max(2n+4, n+12) characters.

    words: by, pos, norm, start_ms, end_ms, probability, and the target's length. A word meets only
    the words that end in the stretches of text that the cap behind it touches.
    """
    keys = list(by)
    cap = F.greatest(2 * F.col(target_chars) + 4, F.col(target_chars) + 12)
    total = F.sum(F.length("norm")).over(Window.partitionBy(*keys).orderBy("pos"))
    rows = words.filter("norm <> ''").withColumns({"upto": total, "cap": cap})
    first = rows.select(*keys, F.col("pos").alias("first_word"), (F.col("upto") - F.length("norm")).alias("before"), F.col(START).alias("span_start"), "cap")
    last = rows.select(*keys, F.col("pos").alias("last_word"), "upto", F.col(END).alias("span_end"))
    first = first.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("before") / STRETCH), F.floor((F.col("before") + F.col("cap")) / STRETCH))))
    met = first.join(last.withColumn("stretch", F.floor(F.col("upto") / STRETCH)), [*keys, "stretch"])
    return met.filter((F.col("last_word") >= F.col("first_word")) & (F.col("upto") - F.col("before") <= F.col("cap"))).drop("stretch")


def span_scores(spans: DataFrame, words: DataFrame, by: tuple[str, ...] = ("cue",)) -> DataFrame:
    """Mean probability and character count of every span."""
    keys = list(by)
    inner = spans.withColumn("pos", F.explode(F.sequence("first_word", "last_word"))).join(words.select(*keys, "pos", "norm", "probability"), [*keys, "pos"], "left")
    return inner.groupBy(*keys, "first_word", "last_word").agg(F.coalesce(F.avg("probability"), F.lit(1.0)).alias("average_probability"), F.sum(F.length("norm")).alias("chars"))


def _norm(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text) if c.isalnum())


def best_span(target: str, words: list[tuple[str, int, int, float | None]], first: int = 0) -> dict | None:
    """The span of best score, the shorter on ties, if it is good enough."""
    want, best = _norm(target), None
    if not want:
        return None
    cap = max(2 * len(want) + 4, len(want) + 12)
    full, spans = (1 << len(want)) - 1, []
    where: dict[str, int] = {}
    for k, c in enumerate(want):
        where[c] = where.get(c, 0) | 1 << k
    for i in range(first, len(words)):
        seen, probs, open_ = "", [], full
        for j in range(i, len(words)):
            seen += words[j][0]
            if len(seen) > cap:
                break
            for c in words[j][0]:  # zeros of open_ count the longest common subsequence
                hit = open_ & where.get(c, 0)
                open_ = ((open_ + hit) | (open_ - hit)) & full
            common = len(want) - open_.bit_count()
            if words[j][3] is not None:
                probs.append(words[j][3])
            prob = sum(probs) / len(probs) if probs else 1.0
            most = 0.65 * 2 * common / (len(want) + len(seen)) + 0.30 * common / len(want) + 0.05 * min(prob, 1.0)
            spans.append((most, i, j, seen, prob))
    # Matching blocks are a common subsequence, so spans are tried by what they can reach at most.
    for most, i, j, seen, prob in sorted(spans, key=lambda x: (-x[0], x[1], x[2])):
        if best is not None and most < best["key"][0] - 1e-6:
            break
        m = SequenceMatcher(None, want, seen)
        sim, cover = m.ratio(), sum(b.size for b in m.get_matching_blocks()) / len(want)
        key = (round(0.65 * sim + 0.30 * cover + 0.05 * min(prob, 1.0), 6), i - j, -i)
        if best is None or key > best["key"]:
            best = {"key": key, "first": i, "last": j, "similarity": sim, "coverage": cover, "probability": prob}
    if best is None:
        return None
    heard = best["probability"] >= MIN_PROBABILITY or (min(best["similarity"], best["coverage"]) >= 0.85 and best["probability"] >= 0.25)
    floor = SHORT_SIMILARITY if len(want) <= 3 else MIN_SIMILARITY
    return best if best["similarity"] >= floor and best["coverage"] >= MIN_COVERAGE and heard else None


def _units(text: str, marks: str) -> list[str]:
    out, at = [], 0
    for k, c in enumerate(text):
        if c in marks and (k + 1 == len(text) or text[k + 1] not in marks):
            out.append(text[at : k + 1])
            at = k + 1
    return out + [text[at:]] if at < len(text) else out


def _place(cue: tuple[int, int], units: list[str], words: list) -> list[dict] | None:
    placed, at = [], 0
    for u in units:
        span = best_span(u, words, at)
        if span is None:
            return None
        placed.append({"text": u, "start": max(cue[0], words[span["first"]][1] - PAD_START), "end": min(cue[1], words[span["last"]][2] + PAD_END), **{k: span[k] for k in ("similarity", "coverage", "probability")}})
        at = span["last"] + 1
    for a, b in zip(placed, placed[1:]):
        if a["end"] > b["start"]:
            a["end"] = b["start"] = (a["end"] + b["start"]) // 2
    return placed if all(p["start"] < p["end"] for p in placed) else None


PROPOSAL = "audio_id long, cue_index long, status string, reason string, ord int, start_ms long, end_ms long, text string, similarity double, coverage double, probability double"


def align_long_cues(cues: DataFrame, words: DataFrame, max_ms: int = MAX_MS) -> DataFrame:
    """Proposals for long cues: the whole text on one span, else its sentences, else finer parts.

    cues: audio_id, cue_index, start_ms, end_ms, text. words: audio_id, cue_index, text, start_ms,
    end_ms, probability. The order of units matters, so a cue is one kernel call in a sorted stream;
    only long cues get there. An unresolved cue gives one row without a text.
    """
    long_ = cues.filter(F.col(END) - F.col(START) > max_ms).select("audio_id", "cue_index", F.col(START).alias("c0"), F.col(END).alias("c1"), F.col("text").alias("cue_text"))
    usable = words.withColumn("norm", norm_alnum(F.col("text"))).filter((F.col("norm") != "") & (F.col(START) >= 0) & (F.col(START) < F.col(END)))
    rows = long_.join(usable.select("audio_id", "cue_index", "norm", START, END, "probability"), ["audio_id", "cue_index"], "left")

    def propose(key: tuple, held: list[tuple]) -> list[tuple]:
        (a, i), (c0, c1, text) = key, held[0][:3]
        cue = (c0, c1)
        ws = [r[3:] for r in held if r[3] is not None]
        status, reason, placed = "unresolved", "insufficient_alignment" if ws else "no_words", None
        if ws:
            for name, units, done in (("whole_text", [text], "aligned"), ("sentences", _units(text, SENTENCE), "split"), ("punctuation", _units(text, FINE), "split")):
                if name != "whole_text" and len(units) < 2:
                    continue
                got = _place(cue, units, ws)
                if got and all(p["end"] - p["start"] <= max_ms for p in got):
                    status, reason, placed = done, name, got
                    break
        out = [(a, i, status, reason, k, p["start"], p["end"], p["text"], p["similarity"], p["coverage"], p["probability"]) for k, p in enumerate(placed or [])]
        return out or [(a, i, status, reason, 0, None, None, None, None, None, None)]

    order = [F.asc_nulls_last(c) for c in (START, END, "norm", "probability")]
    return walk_groups(rows, ["audio_id", "cue_index"], order, ["c0", "c1", "cue_text", "norm", START, END, "probability"], propose, PROPOSAL)


def consensus(attempts: DataFrame, max_ms: int = MAX_MS) -> DataFrame:
    """Bounds on which two attempts agree: the later start, the earlier end, and how far they differ.

    attempts: audio_id, cue_index, attempt, ord, start_ms, end_ms, text. Attempts that give a cue
    different numbers of parts don't agree, and count as one more than a cue's limit apart.
    """
    keys = ["audio_id", "cue_index"]
    sizes = attempts.groupBy(*keys, "attempt").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg((F.min("n") == F.max("n")).alias("same_n"), F.count(F.lit(1)).alias("tried"))
    rows = attempts.groupBy(*keys, "ord").agg(
        F.max(START).alias(START), F.min(END).alias(END), F.count_distinct("text").alias("texts"), F.count(F.lit(1)).alias("attempts"),
        F.greatest(F.max(START) - F.min(START), F.max(END) - F.min(END)).alias("shift_ms"),
    ).join(sizes, keys)
    w = Window.partitionBy(*keys)
    fits = F.col("same_n") & (F.col("tried") == 2) & (F.col("attempts") == 2) & (F.col("texts") == 1) & (F.col(START) < F.col(END))
    agreed = F.min(fits.cast("int")).over(w) == 1
    shift = F.when(F.col("same_n"), F.max("shift_ms").over(w)).otherwise(F.lit(max_ms + 1).cast("long"))
    return rows.withColumns({"agreed": agreed, "cue_shift_ms": shift}).drop("texts", "same_n", "tried")


def choose_attempts(parts: DataFrame, tries: DataFrame, max_ms: int = MAX_MS) -> DataFrame:
    """The attempt that stands for each cue, how far the attempts lie apart and whether a person must look.

    parts: the parts of resolved attempts (audio_id, cue_index, attempt, ord, start_ms, end_ms, text,
    similarity, coverage, probability). tries: every attempt (audio_id, cue_index, attempt, status,
    n_words). Of resolved attempts the one whose worst part scores best is chosen, else the one with
    most words; the first on ties. bounds_agreed: the chosen parts take the bounds of consensus().
    """
    keys = ["audio_id", "cue_index"]
    worst = parts.groupBy(*keys, "attempt").agg(
        F.min(0.55 * F.col("similarity") + 0.35 * F.col("coverage") + 0.10 * F.least("probability", F.lit(1.0))).alias("score"), F.count_if(F.lit(True)).alias("n_parts")
    )
    best = F.max_by(F.struct("attempt", "status"), F.struct(F.col("score").isNotNull().alias("r"), F.coalesce("score", F.col("n_words").cast("double")).alias("s"), (-F.col("attempt")).alias("a")))
    chosen = tries.join(worst, [*keys, "attempt"], "left").groupBy(*keys).agg(best.alias("b"), F.count("score").alias("resolved"), F.count(F.lit(1)).alias("tried"))
    pairs = consensus(parts, max_ms).groupBy(*keys).agg(F.max("cue_shift_ms").alias("shift"), F.bool_and("agreed").alias("agreed"))
    out = chosen.join(pairs, keys, "left")
    shift = F.when(F.col("resolved") > 1, F.col("shift"))
    review = (F.col("b.status") == "split") | (F.col("resolved") < F.col("tried")) | (F.coalesce(shift, F.lit(0)) > REVIEW_SHIFT_MS)
    return out.select(*keys, F.col("b.attempt").alias("attempt"), F.col("b.status").alias("status"), shift.alias("shift_ms"), ((F.col("resolved") > 1) & F.coalesce("agreed", F.lit(False))).alias("bounds_agreed"), review.alias("review_required"))


def apply_proposals(cues: DataFrame, proposals: DataFrame, mode: str = "apply") -> DataFrame:
    """Cues with aligned and split ones replaced, renumbered (L8). Unsafe proposals leave their cue; shadow mode all."""
    keys = ["audio_id", "cue_index"]
    used = proposals.filter("status IN ('aligned', 'split')")
    w = Window.partitionBy(*keys).orderBy("ord")
    checked = used.join(cues.select(*keys, F.col(START).alias("c0"), F.col(END).alias("c1"), F.col("text").alias("cue_text")), keys).withColumn("before", F.coalesce(F.lag(END).over(w), F.col("c0")))
    safe = checked.groupBy(*keys).agg(
        F.min(((F.col(START) >= F.col("before")) & (F.col(START) < F.col(END)) & (F.col(END) <= F.col("c1"))).cast("int")).alias("inside"),
        (F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "") == F.first("cue_text")).alias("same_text"),
    ).filter("inside = 1 AND same_text").select(*keys)
    if mode == "shadow":
        safe = safe.limit(0)
    kept = cues.join(safe, keys, "left_anti").select("audio_id", START, END, "text", F.col("cue_index").alias("source_index"))
    new = used.join(safe, keys, "left_semi").select("audio_id", START, END, "text", F.col("cue_index").alias("source_index"))
    rows = kept.unionByName(new)
    return rows.withColumn("cue_index", F.row_number().over(Window.partitionBy("audio_id").orderBy(START, END, "source_index")).cast("long"))
