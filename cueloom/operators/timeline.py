"""The fused timeline: groups of candidates cut into slices, one item each, without overlaps."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import SUPPORT_RATIO, norm_text
from .graph import checkpoint
from .intervals import END, START, assign_ids, overlap_join, with_islands
from .walk import walk_groups


def with_words(c: DataFrame) -> DataFrame:
    """Candidates with their words in equal shares of the duration; legacy rows have none."""
    parts = F.split("text", " ")
    n = F.size(parts)
    at = lambda i: F.floor(F.col(START) + (F.col(END) - F.col(START)) * i / n)
    word = F.transform(parts, lambda w, i: F.struct(at(i).alias("s"), at(i + 1).alias("e"), w.alias("t")))
    return c.withColumn("words", F.when(F.col("legacy_srt"), F.filter(word, lambda w: F.lit(False))).otherwise(word))


def priority() -> Column:
    """Rank of a candidate as an anchor: channel, role, native, words."""
    ch, role, native, words = F.col("source_channel"), F.col("model_role"), ~F.col("legacy_srt"), F.size("words") > 0
    return (
        F.when((ch == "rescue") & (role == "v3") & words, 0).when((ch == "main") & (role == "v3") & native, 1)
        .when((ch == "main") & (role == "turbo") & native, 2).when((ch == "rescue") & (role == "turbo"), 3)
        .when((ch == "main") & (role == "v3"), 4).when((ch == "main") & (role == "turbo"), 5).otherwise(6)
    )


def pick_anchor(c: DataFrame, by: list[str]) -> DataFrame:
    """The first candidate of each group by rank, log probability and id."""
    order = Window.partitionBy(*by).orderBy("rank", F.desc(F.coalesce("avg_logprob", F.lit(-100.0))), "event_id")
    return c.withColumn("rank", priority()).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def python_support(a: str, b: str) -> bool:
    """The support test on normalised texts."""
    if not a or not b:
        return False
    if min(len(a), len(b)) >= 2 and (a in b or b in a):
        return True
    return SequenceMatcher(None, a, b).ratio() >= SUPPORT_RATIO


def contains_support(a: str, b: str) -> bool:
    return min(len(a), len(b)) >= 2 and (a in b or b in a)


def group_candidates(c: DataFrame, support: Callable[[str, str], bool] = python_support, slack_ms: int = 800) -> DataFrame:
    """event_id with its group (the group's first event_id).

    A candidate joins the newest group without its run that it overlaps, or whose text it backs
    within the slack; looking back ends at a group over for longer than the slack. The rule depends
    on order, so it runs per island, and islands never hold more than what is chained in time.
    """
    rows = with_islands(c, "audio_id", slack_ms).withColumn("norm", norm_text(F.col("text")))

    def walk(key: tuple, held: list[tuple]) -> list[tuple]:
        groups: list[dict] = []
        owner: dict[int, int] = {}
        for event, start, end, run_key, norm in held:
            home = None
            for g in reversed(groups):
                if start > g["end"] + slack_ms:
                    break
                if run_key in g["runs"]:
                    continue
                if (start < g["end"] and end > g["start"]) or any(support(norm, t) for t in g["texts"]):
                    home = g
                    break
            if home is None:
                home = {"id": event, "start": start, "end": end, "runs": set(), "texts": []}
                groups.append(home)
            home["start"], home["end"] = min(home["start"], start), max(home["end"], end)
            home["runs"].add(run_key)
            home["texts"].append(norm)
            owner[event] = home["id"]
        return list(owner.items())

    cols = ["event_id", START, END, "run_key", "norm"]
    return walk_groups(rows.select("audio_id", "island", *cols), ["audio_id", "island"], [START, END, "event_id"], cols, walk, "event_id long, grp long")


def slice_groups(members: DataFrame, max_ms: int = 15_000) -> DataFrame:
    """Slices of groups at word boundaries; groups within the limit stay whole in plain SQL."""
    bounds = members.groupBy("audio_id", "grp").agg(F.min(START).alias("g_start"), F.max(END).alias("g_end"))
    fits = F.col("g_end") - F.col("g_start") <= max_ms
    short = bounds.filter(fits).select("audio_id", "grp", F.col("g_start").alias(START), F.col("g_end").alias(END), F.lit(False).alias("cut"))
    rows = members.join(bounds.filter(~fits), ["audio_id", "grp"]).select("audio_id", "grp", "g_start", "g_end", F.flatten(F.transform("words", lambda w: F.array(w["s"], w["e"]))).alias("edges"))

    def cut(key: tuple, held: list[tuple]) -> list[tuple]:
        at, last, out = held[0][0], held[0][1], []
        edges = sorted({x for r in held for x in r[2] if at < x < last})
        while last - at > max_ms:
            k = bisect_right(edges, at + max_ms) - 1
            to = edges[k] if k >= 0 and edges[k] > at + 50 else at + max_ms
            out.append((*key, at, to, True))
            at = to
        if last > at:
            out.append((*key, at, last, True))
        return out

    return short.unionByName(walk_groups(rows, ["audio_id", "grp"], [], ["g_start", "g_end", "edges"], cut, short.schema))


def fragments(c: DataFrame, slices: DataFrame, by: list[str]) -> DataFrame:
    """What of each candidate belongs to a slice: words with their middle inside, or the whole of one without words (I4)."""
    s = slices.withColumnsRenamed({START: "s_start", END: "s_end"})
    rows = overlap_join(c, s, by, (START, END), ("s_start", "s_end"))
    inside = F.filter("words", lambda w: (w["s"] + w["e"] >= 2 * F.col("s_start")) & (w["s"] + w["e"] < 2 * F.col("s_end")))
    rows = rows.withColumn("mine", inside).withColumn("worded", F.size("words") > 0)
    whole = ~F.col("worded") & (F.col(START) + F.col(END) >= 2 * F.col("s_start")) & (F.col(START) + F.col(END) < 2 * F.col("s_end"))
    rows = rows.filter((F.col("worded") & (F.size("mine") > 0)) | whole)
    return rows.withColumns({
        "fragment": F.when(F.col("worded"), F.trim(F.array_join(F.transform("mine", lambda w: w["t"]), ""))).otherwise(F.col("text")),
        "evidence_start": F.when(F.col("worded"), F.array_min(F.transform("mine", lambda w: w["s"]))).otherwise(F.col(START)),
        "evidence_end": F.when(F.col("worded"), F.array_max(F.transform("mine", lambda w: w["e"]))).otherwise(F.col(END)),
    }).drop("mine", "worded")


def build_items(c: DataFrame, groups: DataFrame, max_ms: int = 15_000) -> DataFrame:
    """Timeline items before overlaps are settled (L6, E12): one per slice with candidates. c has label and words."""
    members = c.join(groups, "event_id")
    frag = fragments(members, slice_groups(members, max_ms), ["audio_id", "grp"]).withColumn("rank", priority())
    order = F.struct("rank", (-F.coalesce("avg_logprob", F.lit(-100.0))).alias("lp"), "event_id")
    items = frag.groupBy("audio_id", "grp", "s_start", "s_end", "cut").agg(
        F.min(F.struct(order.alias("o"), "evidence_start", "evidence_end", F.size("words").alias("w"))).alias("a"),
        F.bool_or(F.col("label") == "supported").alias("supported"),
        F.array_size(F.array_remove(F.collect_set(norm_text(F.col("fragment"))), "")).alias("n_texts"),
        F.bool_or((F.size("words") == 0) & (F.col(END) - F.col(START) > max_ms)).alias("unsplit"),
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["event_id"]).alias("evidence_ids"),
    )
    return items.select(
        "audio_id", "grp", F.col("s_start").alias(START), F.col("s_end").alias(END),
        F.when(F.col("supported"), "supported").otherwise("uncertain").alias("classification"),
        (~F.col("supported") | (F.col("n_texts") > 1) | (F.col("cut") & F.col("unsplit"))).alias("review_required"),
        F.when(F.col("cut"), "bounded_split").when(F.col("a.w") > 0, "word_candidate").otherwise("candidate_bounds").alias("timing_kind"),
        F.col("a.o.event_id").alias("anchor_id"), F.col("a.evidence_start").alias("anchor_start"), F.col("a.evidence_end").alias("anchor_end"), "evidence_ids",
    )


def partition_overlaps(items: DataFrame, max_ms: int = 15_000) -> DataFrame:
    """Overlapping items meet halfway between their anchors' middles, or merge.

    Clusters are strict islands. If a cut would leave any item without its own middle the cluster
    becomes one item; a merged item over the limit is flagged in `too_long`. Times are doubled
    where halves occur, so all tests are exact.
    """
    rows = with_islands(items, "audio_id", strict=True, name="cluster").withColumn("mid2", F.col("anchor_start") + F.col("anchor_end"))
    cluster = Window.partitionBy("audio_id", "cluster")
    order = cluster.orderBy("mid2", START, END, "grp")
    left4, right4 = F.lag("mid2").over(order) + F.col("mid2"), F.col("mid2") + F.lead("mid2").over(order)
    cut = rows.withColumns({
        "n": F.count(F.lit(1)).over(cluster), "place": F.row_number().over(order),
        "start4": F.greatest(4 * F.col(START), F.coalesce(left4, 4 * F.col(START))), "end4": F.least(4 * F.col(END), F.coalesce(right4, 4 * F.col(END))),
    })
    valid = (F.col("start4") < F.col("end4")) & (F.col("start4") <= 2 * F.col("mid2")) & (2 * F.col("mid2") <= F.col("end4"))
    cut = cut.withColumn("whole", F.min(valid.cast("int")).over(cluster) == 1)
    parted = cut.filter("whole OR n = 1").select(
        "audio_id", (F.col("start4") / 4).alias("start"), (F.col("end4") / 4).alias("end"), "classification", (F.col("review_required") | (F.col("n") > 1)).alias("review_required"),
        F.when(F.col("n") > 1, "overlap_partition").otherwise(F.col("timing_kind")).alias("timing_kind"), "anchor_id", (F.col("mid2") / 2).alias("anchor_mid"), "evidence_ids", F.lit(False).alias("too_long"),
    )
    first = F.min_by(F.struct("anchor_id", "mid2"), "place")
    merged = cut.filter("n > 1 AND NOT whole").groupBy("audio_id", "cluster").agg(
        F.min(START).cast("double").alias("start"), F.max(END).cast("double").alias("end"), F.when(F.bool_or(F.col("classification") == "supported"), "supported").otherwise("uncertain").alias("classification"),
        first.alias("f"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_ids"))), lambda x: x["evidence_ids"]))).alias("evidence_ids"),
    ).select(
        "audio_id", "start", "end", "classification", F.lit(True).alias("review_required"), F.lit("unresolved_overlap_cluster").alias("timing_kind"), F.col("f.anchor_id").alias("anchor_id"),
        (F.col("f.mid2") / 2).alias("anchor_mid"), "evidence_ids", (F.col("end") - F.col("start") > max_ms).alias("too_long"),
    )
    out = parted.unionByName(merged).withColumnsRenamed({"start": START, "end": END})
    return assign_ids(out, "TL", "audio_id", [START, END, "anchor_id"], "timeline_id")


def build_timeline(c: DataFrame, decisions: DataFrame, support: Callable[[str, str], bool] = python_support, max_ms: int = 15_000) -> DataFrame:
    """The fused timeline of usable candidates."""
    from .evidence import with_labels

    labelled = with_labels(c, decisions).filter((F.col("label") != "hallucination") & (F.col(END) > F.col(START)))
    worded = checkpoint(with_words(labelled))
    groups = checkpoint(group_candidates(worded, support))
    return partition_overlaps(checkpoint(build_items(worded, groups, max_ms)), max_ms)


def check_timeline(t: DataFrame, max_ms: int = 15_000) -> DataFrame:
    """Items that overlap, are empty, too long, or lost their anchor's middle."""
    order = Window.partitionBy("audio_id").orderBy(START, END, "timeline_id")
    rows = t.withColumn("before", F.lag(END).over(order))
    rules = F.array_compact(F.array(
        F.when(F.col("before") > F.col(START), F.lit("overlap")), F.when(F.col(END) <= F.col(START), F.lit("empty")),
        F.when(F.col(END) - F.col(START) > max_ms, F.lit("too_long")), F.when(~F.col("anchor_mid").between(F.col(START), F.col(END)), F.lit("anchor_outside")),
    ))
    return rows.select("audio_id", "timeline_id", F.explode(rules).alias("rule"))


def fusion_payload(t: DataFrame) -> DataFrame:
    """What an adjudicator gets of each item, as JSON."""
    return t.select("audio_id", "timeline_id", F.to_json(F.struct("timeline_id", "classification", "evidence_ids")).alias("payload"))


def validate_selections(selections: DataFrame, t: DataFrame) -> DataFrame:
    """Choices (audio_id, timeline_id, chosen) that miss an item, name an unknown one, twice, or foreign evidence."""
    n = F.count(F.lit(1)).over(Window.partitionBy("audio_id", "timeline_id"))
    both = selections.withColumn("n", n).join(t.select("audio_id", "timeline_id", "evidence_ids"), ["audio_id", "timeline_id"], "full_outer")
    rules = F.array_compact(F.array(
        F.when(F.col("chosen").isNull(), F.lit("missing_item")), F.when(F.col("evidence_ids").isNull(), F.lit("unknown_item")), F.when(F.col("n") > 1, F.lit("duplicate_item")),
        F.when(F.size(F.array_except("chosen", "evidence_ids")) > 0, F.lit("foreign_evidence")),
    ))
    return both.select("audio_id", "timeline_id", F.explode(rules).alias("rule")).distinct()


def hydrate(items: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with a row per candidate in order, ids the evidence does not know)."""
    rows = items.select("audio_id", "timeline_id", F.posexplode("evidence_ids").alias("place", "event_id"))
    return rows.join(c.drop("audio_id"), "event_id"), rows.join(c.select("event_id"), "event_id", "left_anti")
