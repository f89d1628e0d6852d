"""Times: text form and integer milliseconds, interval measures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TIMECODE = r"(\d{2}):(\d{2}):(\d{2}),(\d{3})"


def tc_to_ms(tc: Column, strict: bool = False) -> Column:
    """HH:MM:SS,mmm as milliseconds, null when malformed; strict: minutes and seconds under 60."""
    part = lambda k: F.regexp_extract(tc, "^" + TIMECODE + "$", k).cast("long")
    ms = ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)
    good = tc.rlike("^" + TIMECODE + "$")
    if strict:
        good = good & tc.rlike(r"^\d{2}:[0-5]\d:[0-5]\d,")
    return F.when(good, ms)


def ms_to_tc(ms: Column) -> Column:
    hour, minute = F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000)
    return F.format_string("%02d:%02d:%02d,%03d", hour, minute, F.floor(ms % 60_000 / 1000), ms % 1000)


def seconds_to_tc(seconds: Column, rounding: str = "round") -> Column:
    """From seconds: to the nearest millisecond, half to even, or truncated; negative times are 0."""
    ms = F.bround(seconds * 1000, 0) if rounding == "round" else F.floor(seconds * 1000)
    return ms_to_tc(F.greatest(ms.cast("long"), F.lit(0).cast("long")))


def overlap_ms(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0).cast("long"))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap by union of two intervals."""
    return overlap_ms(a0, a1, b0, b1) / (F.greatest(a1, b1) - F.least(a0, b0))


def relation(n_left: Column, n_right: Column) -> Column:
    """How many rows of either side a match joins."""
    one_l, one_r = n_left == 1, n_right == 1
    return F.when(one_l & one_r, "one_to_one").when(one_l, "one_to_many").when(one_r, "many_to_one").otherwise("many_to_many")


def band(score: Column) -> Column:
    """Confidence of a script match."""
    return F.when(score >= 0.78, "high").when(score >= 0.58, "medium").otherwise("low")
