"""Counts of a text's words, symbols and repeats, shared by the quality operators."""

from __future__ import annotations

import numpy as np

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in runs of `window` (a power of two) words that occur twice or more. Exact: windows are
    told apart by ranks of their halves, doubled until the length is reached."""
    if len(ids) <= window:
        return 0
    rank, size = ids.astype(np.int64), 1
    while size < window:
        pair = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        values, rank, n = np.unique(pair, return_inverse=True, return_counts=True)
        if len(values) == len(pair):
            return 0
        size *= 2
    twice = n[rank] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> dict[str, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(ids),
        "n_lines": len(lines),
        "n_distinct": len(seen),
        "n_same_next": int((ids[1:] == ids[:-1]).sum()),
        "n_upper": sum(1 for w in words if w[:2].isupper() and len(w) > 1),
        "n_exclaim": text.count("!"),
    }


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_same_next", "n_upper", "n_exclaim")


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """[row, feature] of float ratios; a text without words has zeros."""
    s = {k: np.asarray(stats[k], np.float64) for k in STATS}
    words = np.maximum(s["n_words"], 1)
    cols = (
        s["word_chars"] / words,
        s["n_symbols"] / words,
        s["n_exclaim"] / words,
        s["n_upper"] / words,
        s["n_repeat_words"] / words,
        s["n_same_next"] / words,
        s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_distinct"] / words ** 0.9,
        np.log1p(s["n_words"]),
        words / np.maximum(s["n_lines"], 1) / 100,
    )
    return np.column_stack(cols)
