"""Windows of characters: a batch of texts is one array of code points, and each window is a place in it.

Folds and lambdas over arrays are interpreted symbol by symbol; these functions take a few operations on arrays for a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

#: Characters that are worked on at once (a longer text alone).
CHARACTERS = 1 << 20


def by_text(texts: pd.Series, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> pd.Series:
    """``of(code points, start of each text, its length)`` of all texts, a portion at a time; null stays null."""
    known = texts.notna().to_numpy()
    values = texts[known].tolist()
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    out, a, ends = np.full(len(texts), np.nan), 0, np.cumsum(sizes)
    found = np.zeros(len(values))
    while a < len(values):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + CHARACTERS, side="right")))
        points = np.frombuffer("".join(values[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
        found[a:b] = of(points, ends[a:b] - sizes[a:b] - (ends[a] - sizes[a]), sizes[a:b])
        a = b
    out[known] = found
    return pd.Series([x if k else None for x, k in zip(out.tolist(), known.tolist())], dtype=object) if not known.all() else pd.Series(out)


def among(points: np.ndarray, chars: str) -> np.ndarray:
    """Whether each code point is in ``chars``."""
    return np.isin(points, np.array([ord(c) for c in chars], np.uint32))


def sums(values: np.ndarray, size: int) -> np.ndarray:
    """The sum of the ``size`` values from each place on (zeros behind the end), added in order."""
    out = np.zeros(len(values), np.float64 if values.dtype.kind == "f" else np.int64)
    for j in range(min(size, len(values))):
        out[: len(values) - j] += values[j:]
    return out


def whole(points: np.ndarray, at: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """Whether a window of ``size`` from each place on stays in its text."""
    end = np.repeat(at + sizes, sizes)
    return np.arange(len(points)) + size <= end


def greatest(values: np.ndarray, at: np.ndarray, sizes: np.ndarray, none: float) -> np.ndarray:
    """The greatest value of each text; ``none`` for empty texts."""
    out = np.full(len(at), none, np.float64)
    some = sizes > 0
    if some.any():
        out[some] = np.maximum.reduceat(values, at[some])
    return out


def greedy(marked: np.ndarray, at: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """How many marked windows of ``size`` each text has if each is taken that starts behind the last one taken."""
    places = np.append(np.flatnonzero(marked), len(marked) + size)
    n, pos, live = np.zeros(len(at), np.int64), at.copy(), np.arange(len(at))
    while len(live):
        first = places[np.searchsorted(places, pos[live])]
        ok = first < at[live] + sizes[live]
        live = live[ok]
        n[live] += 1
        pos[live] = first[ok] + size
    return n


def low_complexity(points: np.ndarray, at: np.ndarray, sizes: np.ndarray, size: int, symbols: int, bits: float) -> np.ndarray:
    """The share of each text's windows with at most ``symbols`` different characters or an entropy of at most ``bits``. A text shorter
    than a window counts 1 if it has at most a third as many characters as its length (one at least), else 0."""
    total = len(points)
    equal = {d: points[: total - d] == points[d:] for d in range(1, min(size, total))}
    # how often the character at place j of a window stands in it
    kinds, information = np.zeros(total), np.zeros(total)
    share = np.arange(size + 1) / size
    with np.errstate(divide="ignore"):
        bit, one = -np.log2(share) / size, 1 / np.arange(size + 1)
    for j in range(size):
        n = np.ones(total, np.uint8)
        for i in range(size):
            if i != j and abs(i - j) in equal:
                same, first = equal[abs(i - j)], min(i, j)
                n[: max(len(same) - first, 0)] += same[first:]
        kinds += one[n]
        information += bit[n]
    low = ((np.round(kinds) <= symbols) | (information <= bits)) & whole(points, at, sizes, size)
    count = np.add.reduceat(np.append(low, False).astype(np.int64), at) if len(at) else np.zeros(0)
    out = np.where(sizes >= size, count, 0) / np.maximum(sizes - size + 1, 1)
    for k in np.flatnonzero(sizes < size):
        own = points[at[k] : at[k] + sizes[k]]
        out[k] = len(np.unique(own)) <= max(1, sizes[k] // 3)
    return out
