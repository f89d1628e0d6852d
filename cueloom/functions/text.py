"""Column functions on text: normal forms, similarity, checks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType

#: Characters dropped before texts are compared.
EVIDENCE_DROP = r"[\s　、。！？!?…・,.\-~～「」『』（）()\[\]]+"
ALIGNMENT_DROP = r"[\s　、。！？!?…・,.;:：\-~～「」『』（）()\[\]【】]+"

#: Texts that recognizers make up where nobody speaks.
TEMPLATES = (
    "ご視聴ありがとうございました",
    "ご清聴ありがとうございました",
    "チャンネル登録よろしくお願いします",
    "チャンネル登録をお願いします",
)

#: Recognizer names and their short roles; allowed channels and roles.
ROLES = {"large-v3": "v3", "large-v3-turbo": "turbo"}
CHANNELS, ALLOWED_ROLES = ("main", "rescue"), ("v3", "turbo", "gal")

SUPPORT_RATIO, TIMING_RATIO = 0.62, 0.7
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))


def norm_text(text: Column) -> Column:
    """Without white space and punctuation, in lower case."""
    return F.lower(F.regexp_replace(text, "(?U)" + EVIDENCE_DROP, ""))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Spark has no NFKC; pure ASCII is its own normal form and skips the change."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, text).otherwise(_nfkc(F.when(~ascii_only, text)))  # a UDF gets every row; null costs it nothing


def norm_align(text: Column, compat: Callable[[Column], Column] = nfkc) -> Column:
    """NFKC, lower case, katakana as hiragana, without punctuation."""
    return F.regexp_replace(F.translate(F.lower(compat(text)), KATAKANA, HIRAGANA), "(?U)" + ALIGNMENT_DROP, "")


def norm_alnum(text: Column, compat: Callable[[Column], Column] = nfkc) -> Column:
    """NFKC, letters and digits only, case kept."""
    return F.regexp_replace(compat(text), r"[^\p{L}\p{N}]", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def model_role(model: Column) -> Column:
    """Short role of a recognizer."""
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(known[model], slug(model))


def run_key(channel: Column, role: Column, view: Column) -> Column:
    """channel:role:view; an unknown channel or role, or an empty view, is an error."""
    key = F.concat_ws(":", channel, role, slug(view))
    good = channel.isin(*CHANNELS) & role.isin(*ALLOWED_ROLES) & (slug(view) != "")
    return F.when(good, key).otherwise(F.raise_error(F.concat(F.lit("bad run identity: "), key)))


def ratio(autojunk: bool = True):
    """Ratcliff-Obershelp similarity (J7); the arguments' order matters."""

    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        memory: dict[tuple[str, str], float] = {}

        def one(x, y):
            if x is None or y is None:
                return None
            if (x, y) not in memory:
                memory[x, y] = SequenceMatcher(None, x, y, autojunk=autojunk).ratio()
            return memory[x, y]

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return score


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def bigram_dice(a: Column, b: Column) -> Column:
    """Twice the common bigrams, counted as often as both have them, by all bigrams."""
    ga, gb = bigrams(a), bigrams(b)
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    common = F.aggregate(F.array_distinct(ga), F.lit(0), lambda acc, x: acc + F.least(count(ga, x), count(gb, x)))
    short = (F.length(a) < 2) | (F.length(b) < 2)
    return F.when(short, (a == b).cast("double")).otherwise(F.try_divide(2 * common, F.size(ga) + F.size(gb)))


#: Classes of characters in a histogram, and how many of each have a bit of their own.
CHAR_CLASSES, CLASS_BITS = 16, 16


def char_histogram(norm: Column) -> Column:
    """How many characters of each class a text has, in unary: bits (CHAR_CLASSES x CLASS_BITS, in longs), and over, the number beyond."""
    classes = F.transform(F.split(norm, ""), lambda c: F.pmod(F.ascii(c), F.lit(CHAR_CLASSES)))
    count = lambda k: F.size(F.filter(classes, lambda c: c == k))
    per_long = 64 // CLASS_BITS
    held = [F.least(count(k), F.lit(CLASS_BITS)) for k in range(CHAR_CLASSES)]
    unary = F.array(*[F.lit((1 << k) - 1) for k in range(CLASS_BITS + 1)])
    field = lambda k: F.shiftleft(F.element_at(unary, held[k] + 1).cast("long"), CLASS_BITS * (k % per_long))
    words = [reduce(lambda a, b: a.bitwiseOR(b), [field(k) for k in range(i, i + per_long)]) for i in range(0, CHAR_CLASSES, per_long)]
    return F.struct(F.array(*words).alias("bits"), (F.length(norm) - reduce(lambda a, b: a + b, held)).alias("over"))


def may_be_alike(na: Column, nb: Column, ha: Column, hb: Column, ratio: float) -> Column:
    """Whether the histograms allow a Ratcliff-Obershelp similarity: matched characters are common characters."""
    words = range(CHAR_CLASSES * CLASS_BITS // 64)
    common = reduce(lambda a, b: a + b, [F.bit_count(ha["bits"][k].bitwiseAND(hb["bits"][k])) for k in words]) + F.least(ha["over"], hb["over"])
    return 2 * common >= ratio * (F.length(na) + F.length(nb))


def undecided(na: Column, nb: Column, ha: Column | None = None, hb: Column | None = None) -> Column:
    """Normal forms whose support only their similarity can tell: neither holds the other, and lengths and histograms allow the ratio."""
    shorter = F.least(F.length(na), F.length(nb))
    open_ = (shorter > 0) & ~((shorter >= 2) & (na.contains(nb) | nb.contains(na))) & (2 * shorter >= SUPPORT_RATIO * (F.length(na) + F.length(nb)))
    return open_ if ha is None else open_ & may_be_alike(na, nb, ha, hb, SUPPORT_RATIO)


def norms_support(na: Column, nb: Column, sim: Callable[[Column, Column], Column] | None = None, ha: Column | None = None, hb: Column | None = None) -> Column:
    """Normal forms back one another: one holds the other (2 characters or more), or they are alike.

    The kernel gets every row, as UDFs do, but nulls where the cheap tests have decided. A sim of the
    caller's, a Column expression, is evaluated behind these tests.
    """
    shorter = F.least(F.length(na), F.length(nb))
    holds = (shorter >= 2) & (na.contains(nb) | nb.contains(na))
    open_ = undecided(na, nb, ha, hb)
    score = sim(na, nb) if sim else ratio()(F.when(open_, na), F.when(open_, nb))
    return F.coalesce(holds | (open_ & F.coalesce(score >= SUPPORT_RATIO, F.lit(False))), F.lit(False))


def texts_support(a: Column, b: Column, sim: Callable[[Column, Column], Column] | None = None) -> Column:
    """norms_support of texts as they are. For pairs, make the normal forms before the join."""
    return norms_support(norm_text(a), norm_text(b), sim)


def norms_timing_support(na: Column, nb: Column, sim: Callable[[Column, Column], Column] | None = None) -> Column:
    """Length ratio of 0.7, and containment or similarity of 0.7 (J9), of normal forms."""
    fits = (F.length(na) > 0) & (F.length(nb) > 0) & (F.least(F.length(na), F.length(nb)) / F.greatest(F.length(na), F.length(nb)) >= TIMING_RATIO)
    holds = na.contains(nb) | nb.contains(na)
    score = sim(na, nb) if sim else ratio()(F.when(fits & ~holds, na), F.when(fits & ~holds, nb))
    return F.coalesce(fits & (holds | F.coalesce(score >= TIMING_RATIO, F.lit(False))), F.lit(False))


def timing_support(candidate: Column, current: Column, sim: Callable[[Column, Column], Column] | None = None) -> Column:
    """norms_timing_support of texts as they are."""
    return norms_timing_support(norm_text(candidate), norm_text(current), sim)


def text_score(a: Column, b: Column, sim: Callable[[Column, Column], Column] | None = None) -> Column:
    """0.55 edit, 0.30 bigrams, 0.15 length, of normalised texts; unequal texts of 2 characters or less score 0."""
    na, nb = F.length(a), F.length(b)
    length = F.least(na, nb) / F.greatest(na, nb)
    total = 0.55 * (sim or ratio(False))(a, b) + 0.30 * bigram_dice(a, b) + 0.15 * length
    return F.when((na == 0) | (nb == 0), 0.0).when(a == b, 1.0).when(F.least(na, nb) <= 2, 0.0).otherwise(total)


def phonetic(text: Column, reading: Callable[[Column], Column] | None = None) -> Column:
    """Reading of a text by the caller's function; the text itself without one."""
    return reading(text) if reading else text


def keyword(base: Column) -> Column:
    """Title words of an audio's name: no track prefix, leading digits or bonus suffix."""
    kw = F.regexp_replace(base, r"(?iU)^track\s*\d+[\s._-]*", "")
    kw = F.regexp_replace(kw, r"(?U)^\d+[\s._-]*", "")
    kw = F.trim(F.regexp_replace(kw, r"(?iU)[\s._-]*(本編|おまけ|bonus|extra).*$", ""))
    return F.when(kw == "", base).otherwise(kw)


def track_id(name: Column) -> Column:
    """Leading number with a letter, upper case, without zeros in front; null without one."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(name, r"(?i)^track\s*0*(\d+[A-Za-z]?)", 1), F.lit("")),
        F.nullif(F.regexp_extract(name, r"^0*(\d+[A-Za-z]?)", 1), F.lit("")),
    )
    return F.upper(found)


def text_violations(text: Column, most: int = 20_000) -> Column:
    """What makes a line unsafe for a cue."""
    return F.array_compact(F.array(
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("empty")),
        F.when(text.rlike("[\r\n]"), F.lit("newline")),
        F.when(text.contains("-->"), F.lit("arrow")),
        F.when(text.rlike(r"[\p{Cc}&&[^\r\n]]"), F.lit("control")),
        F.when(F.length(text) > most, F.lit("too_long")),
    ))


def single_line(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def valid_key(name: Column) -> Column:
    """Names that a file may bear on any system."""
    reserved = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
    return ~(name.rlike(reserved) | name.rlike(r'[<>:"/\\|?*\x00-\x1f]') | name.rlike(r"[. ]$") | (name == "") | name.isin(".", ".."))


def split_keep(text: Column, boundary: str = "。！？!?") -> Column:
    """Sentences with their closing marks; concatenation gives the text."""
    return F.regexp_extract_all(text, F.lit(f"[^{boundary}]*[{boundary}]+|[^{boundary}]+$"), F.lit(0))


def cap_text(text: Column, most: int) -> Column:
    return F.left(text, F.lit(most))


def distinct_keep_order(arr: Column) -> Column:
    """First occurrences, nulls out (H6)."""
    return F.array_distinct(F.array_compact(arr))


def fingerprint(*cols: Column | str) -> Column:
    """sha256 of a row's JSON, keys in order."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)
