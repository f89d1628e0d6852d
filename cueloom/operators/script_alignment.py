"""Scripts on the timeline: anchors cut both sides into regions, a small alignment runs in each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product
from math import prod

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.blocks import HELD_CHARS, Matches, codes_of
from ..functions.text import ratio, text_score
from ..functions.timecode import band, relation
from . import scans
from .graph import checkpoint
from .scripts import unique_anchors
from .walk import walk_groups

#: Group sizes, costs, gain, margins and budgets.
MAX_UNITS, MAX_ITEMS = 3, 6
MIN_SCORE, SKIP_UNIT, SKIP_ITEM, GAIN, GROUP_PENALTY, EXACT_BONUS = 0.38, 0.55, 0.45, 2.2, 0.06, 0.5
AMBIGUOUS = 0.08
MAX_VARIANTS = 4_096
REGION_CELLS, TOTAL_CELLS = 30_000, 120_000
PAIR_WORK, REGION_WORK, TOTAL_WORK = 1_000_000, 50_000_000, 200_000_000


class Scorer:
    """Composite similarity of normalised texts, for many pairs of a region: bigrams are counted once a text, pieces matched once."""

    def __init__(self):
        self.matches, self.grams, self.chars = Matches(), {}, 0

    def bigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if text not in self.grams:
            if self.chars > HELD_CHARS:
                self.grams, self.chars = {}, 0
            codes = codes_of(text).astype(np.int64)
            self.grams[text] = np.unique(codes[:-1] << 32 | codes[1:], return_counts=True)
            self.chars += len(text)
        return self.grams[text]

    def dice(self, a: str, b: str) -> float:
        if len(a) < 2 or len(b) < 2:
            return float(a == b)
        (ga, na), (gb, nb) = self.bigrams(a), self.bigrams(b)
        at = np.minimum(np.searchsorted(gb, ga), len(gb) - 1)
        common = int(np.minimum(na, nb[at])[gb[at] == ga].sum())
        return 2 * common / (len(a) + len(b) - 2)

    def score(self, a: str, b: str, least: float = 0.0) -> float:
        """Where it is below least, what is returned may be any number below it."""
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        short, long = sorted((len(a), len(b)))
        if short <= 2:
            return 0.0
        most = 0.55 * (2.0 * short / (short + long)) + 0.15 * short / long
        if most + 0.30 * min(1.0, 2 * (short - 1) / (short + long - 2)) + 1e-9 < least:
            return 0.0
        dice = self.dice(a, b)
        if most + 0.30 * dice + 1e-9 < least:
            return 0.0
        return 0.55 * (2.0 * self.matches.count(a, b) / len(a + b)) + 0.30 * dice + 0.15 * short / long


def score(a: str, b: str) -> float:
    """Composite similarity of normalised texts."""
    return Scorer().score(a, b)


def with_regions(units: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with region (how many anchors lie before) and whether the row is an anchor. Rows: audio_id, pos, norm."""
    anchors = unique_anchors(units, items).select("audio_id", "unit_pos", "item_pos")

    def mark(df: DataFrame, col: str) -> DataFrame:
        hit = anchors.select("audio_id", F.col(col).alias("pos"), F.lit(1).alias("anchor"))
        w = Window.partitionBy("audio_id").orderBy("pos")
        rows = df.join(hit, ["audio_id", "pos"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(0)))
        return rows.withColumn("region", F.sum("anchor").over(w) - F.col("anchor"))

    return mark(units, "unit_pos"), mark(items, "item_pos")


def best_variants(groups: DataFrame, options: DataFrame, *, by: tuple[str, ...] = ("audio_id", "grp"), sim=None) -> DataFrame:
    """For each group the best text of its items in a row: by, evidence_ids, norm, score.

    groups: by, want. options: by, place (of the item in the group), provenance, evidence_id, norm. A
    variant takes one candidate of every item, all of one provenance; equal texts of a provenance
    count once, under the smallest id. Best is the highest score, then the nearest length, then ids,
    then text. Groups with an item without candidates, or with more than MAX_VARIANTS variants of a
    provenance, have none.
    """
    keys = list(by)
    items = options.groupBy(*keys).agg(F.count_distinct("place").alias("n_items"))
    once = options.filter("norm <> '' AND evidence_id <> ''").groupBy(*keys, "place", "provenance", "norm").agg(F.min("evidence_id").alias("evidence_id"))
    of_item = once.groupBy(*keys, "provenance", "place").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "norm"))).alias("texts"))
    rows = of_item.groupBy(*keys, "provenance").agg(F.array_sort(F.collect_list(F.struct("place", "texts"))).alias("items")).join(items, keys).filter(F.size("items") == F.col("n_items"))
    many = F.aggregate("items", F.lit(1.0), lambda n, x: n * F.size(x["texts"]))
    rows = rows.withColumn("most", F.max(many).over(Window.partitionBy(*keys))).filter(F.col("most") <= MAX_VARIANTS)
    start = F.array(F.struct(F.array().cast("array<string>").alias("ids"), F.lit("").alias("norm")))
    longer = lambda v, o: F.struct(F.array_append(v["ids"], o["evidence_id"]).alias("ids"), F.concat(v["norm"], o["norm"]).alias("norm"))
    all_ = F.aggregate("items", start, lambda acc, x: F.flatten(F.transform(acc, lambda v: F.transform(x["texts"], lambda o: longer(v, o)))))
    scored = rows.select(*keys, F.explode(all_).alias("v")).join(groups.select(*keys, "want"), keys).select(
        *keys, F.col("v.ids").alias("evidence_ids"), F.col("v.norm").alias("norm"), text_score(F.col("want"), F.col("v.norm"), sim).alias("score"), F.abs(F.length("want") - F.length("v.norm")).alias("away")
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "away", "evidence_ids", "norm")
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*keys, "evidence_ids", "norm", "score")


class Item:
    """A timeline item's candidate texts by provenance; plain text is one candidate."""

    def __init__(self, candidates: str | list[tuple[str, str, str]]):
        held: dict[str, dict[str, str]] = {}
        for provenance, evidence, norm in [("", "", candidates)] if isinstance(candidates, str) else candidates:
            if norm and (evidence or isinstance(candidates, str)):
                texts = held.setdefault(provenance, {})
                texts[norm] = min(evidence, texts.get(norm, evidence))
        self.options = {p: sorted((e, t) for t, e in texts.items()) for p, texts in held.items()}
        self.longest = max((len(t) for o in self.options.values() for _, t in o), default=0)


def every_variant(items: list[Item]) -> Iterator[tuple[tuple[str, ...], str]]:
    """All (evidence ids, text) of items in a row by G5's rule, one after another."""
    for provenance in set.intersection(*(set(i.options) for i in items)):
        for pick in product(*[i.options[provenance] for i in items]):
            yield tuple(e for e, _ in pick), "".join(t for _, t in pick)


def variants(items: list[Item]) -> list[tuple[tuple[str, ...], str]] | None:
    """The same as a list; None where a provenance has too many for one."""
    if any(prod(len(i.options[p]) for i in items) > MAX_VARIANTS for p in set.intersection(*(set(i.options) for i in items))):
        return None
    return list(every_variant(items))


def best_variant(want: str, texts: Iterable[tuple[tuple[str, ...], str]], scorer: Scorer | None = None, least: float = 0.0) -> tuple[float, tuple[str, ...]]:
    """Score and evidence ids of the best of variants; no more than a lower score is said of those below least."""
    scorer, best = scorer or Scorer(), None
    for ids, t in texts:
        this = (-scorer.score(want, t, max(least, -best[0] if best else 0.0)), abs(len(want) - len(t)), ids, t)
        best = this if best is None else min(best, this)
    return (-best[0], best[2]) if best else (0.0, ())


def region_work(us: list[str], ts: list[Item]) -> int:
    """What an alignment may cost: products of lengths over all groups, once per variant; REGION_WORK + 1 where one group is too much."""
    work = 0
    for j in range(len(ts)):
        for b in range(1, min(MAX_ITEMS, len(ts) - j) + 1):
            group = ts[j : j + b]
            ways = sum(prod(len(i.options[p]) for i in group) for p in set.intersection(*(set(i.options) for i in group)))
            length = max(1, sum(i.longest for i in group))
            for k in range(len(us)):
                size = 0
                for u in us[k : k + MAX_UNITS]:
                    size += len(u)
                    pair = max(1, size) * length
                    if ways > MAX_VARIANTS or pair > PAIR_WORK:
                        return REGION_WORK + 1
                    work += ways * pair
            if work > REGION_WORK:
                return work
    return work


def align_region(us: list[str], ts: list) -> tuple[list[tuple], float | None]:
    """Best monotone grouping of two lists of texts (of items: their candidates), and its lead over the next best end.

    Steps skip a unit or an item, or match up to MAX_UNITS with up to MAX_ITEMS of them, which take
    their best variant. Each cell keeps its two best ways; ties go to more matched characters, then
    fewer skips. Steps: first unit, units, first item, items, score, evidence ids.
    """
    items = [t if isinstance(t, Item) else Item(t) for t in ts]
    n, m = len(us), len(items)
    scorer = Scorer()
    texts: dict[tuple[int, int], list | None] = {}
    cells: dict[tuple[int, int], list[tuple]] = {(0, 0): [((0.0, 0, 0), ())]}

    def put(at: tuple[int, int], key: tuple, path: tuple) -> None:
        held = cells.setdefault(at, [])
        if all(p != path for _, p in held):
            held.append((key, path))
            held.sort(key=lambda x: (-x[0][0], -x[0][1], x[0][2], x[1]))
            del held[2:]

    def match(left: str, j: int, b: int) -> tuple[float, tuple[str, ...]]:
        if (j, b) not in texts:
            texts[j, b] = variants(items[j : j + b])
        ways = texts[j, b]
        return best_variant(left, every_variant(items[j : j + b]) if ways is None else ways, scorer, MIN_SCORE)

    for i in range(n + 1):
        for j in range(m + 1):
            matches = []
            for a in range(1, min(MAX_UNITS, n - i) + 1):
                left = "".join(us[i : i + a])
                for b in range(1, min(MAX_ITEMS, m - j) + 1):
                    s, ids = match(left, j, b)
                    if s >= MIN_SCORE:
                        gain = GAIN * (s - MIN_SCORE) - a * SKIP_UNIT - b * SKIP_ITEM - GROUP_PENALTY * (a - 1) + (EXACT_BONUS if s >= 1 - 1e-12 and len(left) >= 4 else 0)
                        matches.append((a, b, gain, len(left), (i, a, j, b, s, ids)))
            for (total, chars, skips), path in cells[i, j] if (i, j) == (n, m) else cells.pop((i, j)):
                if i < n:
                    put((i + 1, j), (round(total - SKIP_UNIT, 12), chars, skips + 1), path)
                if j < m:
                    put((i, j + 1), (round(total - SKIP_ITEM, 12), chars, skips + 1), path)
                for a, b, gain, length, step in matches:
                    put((i + a, j + b), (round(total + gain, 12), chars + length, skips), (*path, step))
    ends = cells[n, m]
    return list(ends[0][1]), (ends[0][0][0] - ends[1][0][0] if len(ends) > 1 else None)


MATCH = "audio_id long, region long, first_unit long, n_units int, first_item long, n_items int, score double, evidence_ids array<string>, margin double, anchored boolean, reason string"


def _texts(side: list[tuple]) -> list:
    """A region's texts between anchors: norms, or items with their options. Rows: pos, anchor, norm, reason, options."""
    out = []
    for _, anchor, norm, _, options in side:
        if anchor == 0:
            out.append((norm or "") if options is None else Item([(o["provenance"], o["evidence_id"], o["norm"]) for o in options]))
    return out


def _walk_regions(units: DataFrame, items: DataFrame, walk, schema: str) -> DataFrame:
    """What walk(key, units, items) returns for every region; both sides come sorted in one stream."""
    none = {"norm": "string", "reason": "string", "options": "array<struct<provenance:string,evidence_id:string,norm:string>>"}

    def one(df: DataFrame, side: int) -> DataFrame:
        cols = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in none.items()]
        return df.select("audio_id", "region", F.lit(side).alias("side"), F.col("pos").cast("long").alias("pos"), "anchor", *cols)

    def both(key: tuple, rows: list[tuple]) -> list[tuple]:
        return walk(key, [r[1:] for r in rows if r[0] == 0], [r[1:] for r in rows if r[0] == 1])

    return walk_groups(one(units, 0).unionByName(one(items, 1)), ["audio_id", "region"], ["side", "pos"], ["side", "pos", "anchor", *none], both, schema)


def budget_regions(units: DataFrame, items: DataFrame, *, cells: int = REGION_CELLS, total_cells: int = TOTAL_CELLS, total_work: int = TOTAL_WORK) -> DataFrame:
    """audio_id, region, reason (null: to be aligned). units and items: as with_regions gives them.

    A region over its own budget of cells or work stays out, and so does one that finds too little
    left of the recording's budgets, which regions use up in order.
    """

    def cost(key: tuple, left: list[tuple], right: list[tuple]) -> list[tuple]:
        us, ts = _texts(left), [x if isinstance(x, Item) else Item(x) for x in _texts(right)]
        n = len(us) * len(ts)
        return [(*key, n, region_work(us, ts) if n <= cells else 0)]

    def spend(key: tuple, rows: list[tuple]) -> list[tuple]:
        room, work, out = total_cells, total_work, []
        for region, n, cost in rows:
            reason = None
            if n > room:
                reason = "total_budget_exceeded"
            else:
                room -= n
                if n > cells:
                    reason = "region_too_large"
                elif cost > min(REGION_WORK, work):
                    reason = "work_budget_exceeded"
                else:
                    work -= cost
            out.append((*key, region, reason))
        return out

    costs = _walk_regions(units, items, cost, "audio_id long, region long, cells long, work long")
    return walk_groups(costs, ["audio_id"], ["region"], ["region", "cells", "work"], spend, "audio_id long, region long, reason string")


def align_scripts(units: DataFrame, items: DataFrame, **budgets: int) -> DataFrame:
    """Matches of script units to timeline items with band, relation and review flag.

    Regions between anchors align on their own, one kernel call each, whatever their size. Only a
    caller that names budgets (of budget_regions) has regions over them left unmatched, which then say
    so. units, items: audio_id, pos, norm; items may have options (an array of provenance,
    evidence_id, norm), of which matches take the best variant (G5).
    """
    u, t = with_regions(units, items)
    t = t.select(*[F.col(c).alias(c) for c in t.columns])  # both sides may come from one table
    if budgets:
        u = u.join(checkpoint(budget_regions(u, t, **budgets)), ["audio_id", "region"], "left")

    def run(key: tuple, left: list[tuple], right: list[tuple]) -> list[tuple]:
        lu, lt = ([r[0] for r in side if r[1] == 0] for side in (left, right))
        us, ts = _texts(left), _texts(right)
        why = next((r[3] for r in left if r[3] is not None), None)
        out = []
        if us and ts and why:
            out.append((*key, lu[0], 0, lt[0], 0, 0.0, None, None, False, why))
        elif us and ts:
            steps, margin = align_region(us, ts)
            for i, a, j, b, s, ids in steps:
                out.append((*key, lu[i], a, lt[j], b, s, list(filter(None, ids)), margin, False, None))
        for x, y in zip([r[0] for r in left if r[1] == 1], [r[0] for r in right if r[1] == 1]):
            out.append((*key, x, 1, y, 1, 1.0, [], None, True, None))
        return out

    rows = _walk_regions(u, t, run, MATCH)
    unsure = F.coalesce(F.col("margin") <= AMBIGUOUS, F.lit(False))
    return rows.withColumns({"band": band(F.col("score")), "relation": relation(F.col("n_units"), F.col("n_items")), "review_required": unsure | (F.col("score") < 0.58) | F.col("reason").isNotNull()})


def check_alignment(matches: DataFrame) -> DataFrame:
    """Matches that overlap, cross or have a wrong band (K5)."""
    w = Window.partitionBy("audio_id").orderBy("first_unit")
    real = matches.filter("n_units > 0")
    rows = real.withColumns({"pu": F.lag(F.col("first_unit") + F.col("n_units")).over(w), "pt": F.lag(F.col("first_item") + F.col("n_items")).over(w)})
    rules = F.array_compact(F.array(
        F.when(F.col("pu") > F.col("first_unit"), F.lit("unit_overlap")), F.when(F.col("pt") > F.col("first_item"), F.lit("item_overlap")),
        F.when(F.col("band") != band(F.col("score")), F.lit("bad_band")), F.when((F.col("score") < 0) | (F.col("score") > 1 + 1e-9), F.lit("bad_score")),
    ))
    return rows.select("audio_id", "first_unit", F.explode(rules).alias("rule"))


def _members(matches: DataFrame, rows: DataFrame, first: str, count: str) -> DataFrame:
    """audio_id, match, at and the fields of each row that a match names; null fields where there is no such row."""
    begin = rows.select("audio_id", F.col("pos").alias(first), F.col("nth").alias("_begin"))
    named = matches.select("audio_id", "match", first, count, "evidence_ids").join(begin, ["audio_id", first], "left")
    span = F.sequence(F.lit(0), F.greatest(F.col(count), F.lit(1)) - 1)
    each = named.select("audio_id", "match", "_begin", "evidence_ids", F.explode(span).alias("at")).withColumn("nth", F.col("_begin") + F.col("at"))
    return each.join(rows, ["audio_id", "nth"], "left")


def check_alignment_inputs(matches: DataFrame, units: DataFrame, items: DataFrame, unmatched: DataFrame) -> DataFrame:
    """audio_id, side (match, unit or item), pos and rule of all that is wrong with an alignment of these inputs (K5).

    matches: L9's columns. units: audio_id, pos, norm. items: the same, and options (provenance,
    evidence_id, norm) if matches choose among them. unmatched: audio_id, side, pos, reasons.
    Positions of a match are those from its first row on, in order, so it is contiguous if it is
    known. Scores and bands are computed again from the texts chosen; where these are unknown,
    only that is told. A side's rows must each be in one match or unmatched with a reason. Matches
    of no units (regions over budget) name no rows: theirs count as unmatched.
    """
    if "options" not in items.columns:
        items = items.withColumn("options", F.lit(None).cast("array<struct<provenance:string,evidence_id:string,norm:string>>"))
    nth = lambda df: scans.row_numbers(scans.in_blocks(df, ["audio_id"], ["pos"]), ["audio_id"], ["pos"], "nth").drop(scans.BLOCK)
    u, t = nth(units.select("audio_id", "pos", "norm")), nth(items.select("audio_id", "pos", "norm", "options"))
    order = ["first_unit", "first_item", "n_units", "n_items", "score"]
    m = scans.in_blocks(matches.filter("n_units > 0"), ["audio_id"], order)
    m = scans.row_numbers(m, ["audio_id"], order, "match").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))
    of_units, of_items = checkpoint(_members(m, u, "first_unit", "n_units")), checkpoint(_members(m, t, "first_item", "n_items"))

    own = F.get(F.filter("options", lambda o: o["evidence_id"] == F.get("evidence_ids", F.col("at"))), F.lit(0))
    free = F.size("evidence_ids") == 0
    chosen = of_items.withColumn("own", own).withColumns({"text": F.when(free, F.col("norm")).otherwise(F.col("own.norm")), "foreign": ~free & F.col("pos").isNotNull() & F.col("own").isNull(), "provenance": F.col("own.provenance")})
    joined = lambda text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text))), lambda x: x[text]), "")
    left = of_units.groupBy("audio_id", "match").agg(joined("norm").alias("left"), F.bool_or(F.col("pos").isNull()).alias("no_unit"), F.min("_begin").alias("u0"))
    right = chosen.groupBy("audio_id", "match").agg(
        joined("text").alias("right"), F.bool_or(F.col("pos").isNull()).alias("no_item"), F.min("_begin").alias("t0"),
        F.bool_or(F.col("foreign")).alias("foreign"), F.size(F.collect_set("provenance")).alias("ways"),
    )
    rows = m.join(left, ["audio_id", "match"]).join(right, ["audio_id", "match"])
    known = ~F.col("no_unit") & ~F.col("no_item") & ~F.col("foreign") & ((F.size("evidence_ids") == 0) | (F.size("evidence_ids") == F.col("n_items")))
    kernel = lambda a, b: F.coalesce(ratio(False)(F.when(known & (a != b), a), b), F.lit(0.0))
    rows = rows.withColumn("again", text_score(F.col("left"), F.col("right"), kernel))
    for name, start, count in (("u_before", "u0", "n_units"), ("t_before", "t0", "n_items")):
        rows = scans.running_max(rows, ["audio_id"], order, F.col(start) + F.col(count), name)
    unsure = F.coalesce(F.col("margin") <= AMBIGUOUS, F.lit(False)) | (F.col("score") < 0.58) | F.col("reason").isNotNull()
    rules = F.array_compact(F.array(
        F.when(F.col("no_unit"), F.lit("unknown_unit")), F.when(F.col("no_item"), F.lit("unknown_item")),
        F.when(F.col("u_before") > F.col("u0"), F.lit("unit_overlap")), F.when(F.col("t_before") > F.col("t0"), F.lit("item_overlap")),
        F.when(~F.col("relation").eqNullSafe(relation(F.col("n_units"), F.col("n_items"))), F.lit("bad_relation")),
        F.when(F.col("foreign") | ((F.size("evidence_ids") > 0) & (F.size("evidence_ids") != F.col("n_items"))), F.lit("foreign_evidence")),
        F.when(F.col("ways") > 1, F.lit("mixed_provenance")),
        F.when(known & ~F.coalesce(F.abs(F.col("again") - F.col("score")) < 1e-6, F.lit(False)), F.lit("score_mismatch")),
        F.when(known & ~F.col("band").eqNullSafe(band(F.col("again"))), F.lit("bad_band")),
        F.when(F.isnan("margin") | (F.col("margin") < 0) | (F.col("margin") == float("inf")), F.lit("bad_margin")),
        F.when(~F.col("review_required").eqNullSafe(unsure), F.lit("bad_review_flag")),
    ))
    wrong = rows.select("audio_id", F.lit("match").alias("side"), F.col("first_unit").cast("long").alias("pos"), F.explode(rules).alias("rule"))

    def cover(side: str, every: DataFrame, members: DataFrame) -> DataFrame:
        in_match = members.filter("pos IS NOT NULL").select("audio_id", "pos", F.lit(True).alias("matched"), F.lit(True).alias("told"))
        left_out = unmatched.filter(F.col("side") == side).select("audio_id", "pos", F.lit(False).alias("matched"), (F.coalesce(F.size("reasons"), F.lit(0)) > 0).alias("told"))
        said = in_match.unionByName(left_out).groupBy("audio_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.bool_and("told").alias("told"))
        both = every.select("audio_id", "pos", F.lit(True).alias("real")).join(said, ["audio_id", "pos"], "full")
        rule = F.when(F.col("real").isNull(), f"unknown_{side}").when(F.col("n").isNull(), f"{side}_uncovered").when(F.col("n") > 1, f"{side}_twice").when(~F.col("told"), "no_reason")
        return both.select("audio_id", F.lit(side).alias("side"), F.col("pos").cast("long").alias("pos"), rule.alias("rule")).filter("rule IS NOT NULL")

    return wrong.unionByName(cover("unit", u, of_units)).unionByName(cover("item", t, of_items))
