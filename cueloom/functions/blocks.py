"""Ratcliff-Obershelp matches of long texts: difflib's numbers by seeds, bit matrices and ranks, pieces matched once."""

from __future__ import annotations

import numpy as np

#: Cells from which a pair of texts is searched from equal substrings on, how long these are, and how many pairs of places may have them.
SEED_CELLS, SEEDS, SEED_PAIRS = 120_000, (6, 4), 500_000
#: Cells above which a pair that seeds don't settle is searched by ranks of its substrings and not as a matrix of bits.
MATRIX_CELLS = 4_000_000
#: Characters of texts that a memory holds before it is emptied.
HELD_CHARS = 20_000_000


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _by_bits(x: str, y: str) -> tuple[int, int, int]:
    """Bit (i, j) says that x[i] is y[j]; shifted along the diagonals, what stays are starts of longer runs."""
    size = len(y) // 8 + 1  # bytes a row; its last bit is free, so diagonals end with their rows
    if len(y) > 48:
        kinds = sorted(set(x) & set(y))
        bits = np.packbits(codes_of(y) == codes_of("".join(kinds))[:, None], axis=1, bitorder="little")
        rows = {c: b.tobytes().ljust(size, b"\0") for c, b in zip(kinds, bits)}
    else:
        masks: dict[str, int] = {}
        for j, c in enumerate(y):
            masks[c] = masks.get(c, 0) | 1 << j
        rows = {c: mask.to_bytes(size, "little") for c, mask in masks.items()}
    for c in set(x).difference(rows):
        rows[c] = bytes(size)
    runs = [int.from_bytes(b"".join(map(rows.__getitem__, x)), "little")]
    if not runs[0]:
        return 0, 0, 0
    step, length = 8 * size + 1, 1
    while longer := runs[-1] & (runs[-1] >> step * length):
        runs.append(longer)
        length *= 2
    found = runs.pop()
    while runs:
        more = 1 << len(runs) - 1
        if longer := found & (runs.pop() >> step * length):
            found, length = longer, length + more
    return *divmod((found & -found).bit_length() - 1, 8 * size), length


def _by_seeds(x: str, y: str) -> tuple[int, int, int] | None:
    """Runs of equal substrings along the diagonals; None where no seed stands in both texts, or too many pairs of places have one."""
    n, m = len(x), len(y)
    if x.isascii() and y.isascii():
        text, width = np.frombuffer((x + y).encode(), np.uint8), 7
    else:
        kinds, text = np.unique(codes_of(x + y), return_inverse=True)
        width = max(1, (len(kinds) - 1).bit_length())
    for want in SEEDS:
        q = min(want, 62 // width)
        if q > min(n, m):
            continue
        grams = np.zeros(n + m - q + 1, np.int64)
        for k in range(q):
            grams = grams << width | text[k : n + m - q + 1 + k]
        gx, gy = grams[: n - q + 1], grams[n:]
        order = np.argsort(gy)
        held = gy[order]
        low = np.searchsorted(held, gx)
        at = np.flatnonzero(held[np.minimum(low, len(held) - 1)] == gx)
        if not len(at):
            continue
        low = low[at]
        times = np.searchsorted(held, gx[at], "right") - low
        ends = np.cumsum(times)
        pairs = int(ends[-1])
        if pairs > SEED_PAIRS:
            return None
        i = np.repeat(at, times)
        j = order[np.repeat(low - ends + times, times) + np.arange(pairs)]
        place = np.sort((j - i + n) * (n + 1) + i)  # by diagonal, then place; no run leaves its diagonal
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1] + 1)))
        runs = np.concatenate((first[1:], [pairs])) - first
        longest = int(runs.max())
        diagonal, i = np.divmod(place[first[runs == longest]], n + 1)
        best = np.argmin(i * (n + m + 1) + diagonal)
        return int(i[best]), int(i[best] + diagonal[best] - n), longest + q - 1
    return None


def _by_ranks(x: str, y: str) -> tuple[int, int, int]:
    """Substrings of 1, 2, 4, ... characters get equal numbers if they are equal; two of them cover any length."""
    n, m = len(x), len(y)
    ranks = [np.unique(codes_of(x + y), return_inverse=True)[1].astype(np.int64)]

    def at(k: int) -> tuple[int, int, int] | None:
        rank = ranks[k.bit_length() - 1]
        key = rank[: n + m - k + 1] * (n + m) + rank[k - (1 << k.bit_length() - 1) :][: n + m - k + 1]
        kx, ky = key[: n - k + 1], key[n:]
        hit = np.isin(kx, ky)
        i = int(hit.argmax())
        return (i, int((ky == kx[i]).argmax()), k) if hit[i] else None

    best, k = (0, 0, 0), 1
    while k <= min(n, m) and (here := at(k)):
        best = here
        ranks.append(np.unique(ranks[-1][: n + m - 2 * k + 1] * (n + m) + ranks[-1][k:][: n + m - 2 * k + 1], return_inverse=True)[1].astype(np.int64))
        k *= 2
    more = k // 4
    while best[2] and more:
        if best[2] + more <= min(n, m) and (here := at(best[2] + more)):
            best = here
        more //= 2
    return best


def longest_match(x: str, y: str) -> tuple[int, int, int]:
    """i, j, k: the longest x[i : i + k] == y[j : j + k], the first in x, then in y; k is 0 if they share nothing."""
    cells = len(x) * (len(y) + 8)
    if cells >= SEED_CELLS and (found := _by_seeds(x, y)):
        return found
    return _by_bits(x, y) if cells <= MATRIX_CELLS else _by_ranks(x, y)


class Matches:
    """Characters in the matching blocks of difflib's SequenceMatcher(None, a, b, autojunk=False), for many pairs of texts.

    Pairs of pieces are remembered, since texts that begin or end alike share them; of up to HELD_CHARS characters in all.
    """

    def __init__(self):
        self.memory: dict[tuple[str, str], int] = {}
        self.chars = 0

    def count(self, a: str, b: str) -> int:
        if self.chars > HELD_CHARS:
            self.memory.clear()
            self.chars = 0
        memory, stack = self.memory, [(a, b)]
        parts: dict[tuple[str, str], tuple[int, list[tuple[str, str]]]] = {}
        while stack:
            pair = stack[-1]
            if pair in memory:
                stack.pop()
                continue
            x, y = pair
            if pair in parts:
                k, pieces = parts.pop(pair)
                memory[pair] = k + sum(memory[p] for p in pieces)
            elif x in y or y in x:
                memory[pair] = min(len(x), len(y))
            else:
                i, j, k = longest_match(x, y)
                pieces = [p for p in ((x[:i], y[:j]), (x[i + k :], y[j + k :])) if k and p[0] and p[1]]
                parts[pair] = (k, pieces)
                stack += pieces
                continue
            self.chars += len(x) + len(y)
        return memory[a, b]
