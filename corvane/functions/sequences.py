"""Features of symbol sequences and sketches. The alphabets, window sizes, weights and hash constants are fixed values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import windows
from corvane.functions.scalar import best_window, charset_share, col, dense_windows, length_bin, longest_run, stable_bucket

# Fixed values of the definition.
HYDROPHOBIC = "AILMFWVYC"
CHARGED = "KRDE"
POSITIVE = "KRH"
DISORDER = "RNDQEKGPSAT"
COILED = "LEAIQKV"
SMALL = "ASTGV"
ALPHABET = "ACDEFGHIKLMNPQRSTVWYBXZJUO*"
SKETCH_HASHES = (
    (11400714819323198485, 1),
    (14029467366897019727, 7046029254386353131),
    (1609587929392839161, 9650029242287828579),
)


def head_score(s: Column | str) -> Column:
    """Signal of the first 30 symbols: best window of 8 in the first 25, a positive symbol in the first 5, small symbols at 16 to 23."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        def of(points, at, sizes):
            place = np.arange(len(points)) - np.repeat(at, sizes)
            inside = place + 8 <= np.repeat(np.minimum(sizes, 25), sizes)
            share = windows.sums(windows.among(points, HYDROPHOBIC), 8) / 8
            peak = np.maximum(windows.greatest(np.where(inside, share, 0.0), at, sizes, 0.0), 0.0)
            bonus = windows.greatest(windows.among(points, POSITIVE) & (place < 5), at, sizes, 0.0)
            small = windows.greatest(np.where(place == 15, windows.sums(windows.among(points, SMALL), 8) / 8, 0.0), at, sizes, 0.0)
            total = 0.55 * peak + 0.25 * bonus + 0.20 * np.where(sizes >= 23, np.minimum(1.0, small), 0.0)
            return np.where(sizes < 12, 0.0, np.maximum(0.0, np.minimum(1.0, total)))

        return windows.by_text(texts, of)

    return F.coalesce(score(col(s)), F.lit(0.0))


def coil_score(s: Column | str) -> Column:
    """Best window of 21 by 0.7 enriched + 0.3 charged - 0.8 P, between 0 and 1; 0 for shorter text."""
    weights = {c: (0.7 * (c in COILED) + 0.3 * (c in CHARGED) - 0.8 * (c == "P")) / 21 for c in sorted(set(COILED + CHARGED + "P"))}
    return F.when(F.length(col(s)) < 21, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), best_window(s, weights, 21))))


def disorder_score(s: Column | str) -> Column:
    score = charset_share(s, DISORDER) * 0.6 + charset_share(s, "PG") * 0.25 + (1 - charset_share(s, HYDROPHOBIC)) * 0.15
    return F.when(F.length(col(s)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def low_complexity(s: Column | str, size: int = 12) -> Column:
    """Share of windows with at most four different symbols or an entropy of at most 1.8 bits. Text shorter than a window
    counts 1 if it has at most a third as many symbols as characters (one at least), else 0."""

    @F.pandas_udf("double")
    def low(texts: pd.Series) -> pd.Series:
        return windows.by_text(texts, lambda points, at, sizes: windows.low_complexity(points, at, sizes, size, 4, 1.8))

    return low(col(s))


def bundle(s: Column | str) -> Column:
    """All features of a sequence, upper-cased and trimmed first, as one struct."""
    s = F.upper(F.trim(col(s)))
    return F.struct(
        dense_windows(s, HYDROPHOBIC, 19, 0.68).cast("double").alias("helix_count"),
        F.log1p(longest_run(s, HYDROPHOBIC).cast("double")).alias("longest_run"),
        head_score(s).alias("head"),
        coil_score(s).alias("coil"),
        disorder_score(s).alias("disorder"),
        low_complexity(s).alias("low_complexity"),
    )


def _minima(k: int):
    """Three minima over the hashes of all k-mers of each text, as their top 12 bits in hex; null for shorter text. Each text is
    one pass of vector arithmetic modulo 2 ** 64."""
    symbols = np.full(128, ALPHABET.index("X") + 1, np.uint64)
    for i, c in enumerate(ALPHABET):
        symbols[ord(c)] = i + 1

    @F.pandas_udf("string")
    def minima(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            at = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
            if len(at) < k:
                out.append(None)
                continue
            own = symbols[np.where(at < 128, at, ord("X"))]
            with np.errstate(over="ignore"):
                code = own[: len(own) - k + 1].copy()
                for j in range(1, k):
                    code = code * np.uint64(len(ALPHABET) + 1) + own[j : len(own) - k + 1 + j]
                out.append("-".join(f"{int((code * np.uint64(a) + np.uint64(b)).min()) >> 52:03x}" for a, b in SKETCH_HASHES))
        return pd.Series(out, dtype=object)

    return minima


def sketch_key(s: Column | str, k: int = 4) -> Column:
    """Length bin and the top 12 bits of three minima over the codes of all k-mers; shorter text falls into a bucket.

    The code of a k-mer is its number in base 28 over ``ALPHABET`` (1 to 27, foreign symbols as X); a hash is ``a * code + b`` modulo
    2 ** 64. Folds over arrays are interpreted symbol by symbol, so the minima are taken in numpy, a batch at a time.
    """
    s = F.upper(F.trim(col(s)))
    n = F.length(s)
    short = F.concat(F.lit("short:"), n.cast("string"), F.lit(":"), F.lpad(stable_bucket(F.concat(F.lit("short|"), s)).cast("string"), 4, "0"))
    return F.when(n < k, short).otherwise(F.concat(length_bin(n), F.lit(":"), _minima(k)(s)))
