"""Row-level expressions: lenient parsing, stable hashing, text normalising, binning. All stay in generated code, but
for sums over windows of characters, which take a batch of texts at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import windows

NULL_WORDS = ("", "nan", "none", "null", "-1")
TRUE_WORDS = ("1", "1.0", "true", "t", "yes", "y", "positive", "pos")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def blank_words(c: Column | str) -> Column:
    """As ``blank``; also null for the usual spellings of a missing value."""
    return F.when(~F.lower(F.trim(col(c))).isin(*NULL_WORDS), F.trim(col(c)))


def first_present(*cs: Column | str) -> Column:
    return F.coalesce(*(blank(c) for c in cs))


def to_int(c: Column | str, default: int = 0) -> Column:
    return F.coalesce(col(c).try_cast("int"), F.lit(default))


def to_double(c: Column | str) -> Column:
    """Null for what is no number, and for NaN."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_bool(c: Column | str) -> Column:
    return F.lower(F.trim(col(c))).isin(*TRUE_WORDS)


def stable_bucket(key: Column | str, n: int = 10000) -> Column:
    """First eight hex digits of the key's MD5, modulo ``n``."""
    return F.conv(F.substring(F.md5(col(key).cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def stable_fraction(key: Column | str) -> Column:
    return F.conv(F.substring(F.md5(col(key).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def group_split(seed: int, scheme: str, key: Column | str, train: float = 0.8, val: float = 0.1) -> Column:
    """train, val or test by the hash of (seed, scheme, key): a pure projection, equal for equal keys."""
    b = stable_bucket(F.concat_ws("|", F.lit(str(seed)), F.lit(scheme), col(key).cast("string")), 10000)
    return F.when(b < int(train * 10000), "train").when(b < int((train + val) * 10000), "val").otherwise("test")


def evidence_text(*cs: str) -> Column:
    """Present values joined by `` | ``."""
    return F.concat_ws(" | ", *(blank(c) for c in cs))


def join_text(*cs: str) -> Column:
    return F.lower(F.concat_ws(" ", *(blank(c) for c in cs)))


def rule_labels(text: Column | str, rules: dict[str, list[str]]) -> Column:
    """Labels whose rule has a pattern that occurs in the text, in rule order."""
    return F.array_compact(F.array(*(F.when(col(text).rlike("|".join(p)), name) for name, p in rules.items())))


def json_list(c: Column | str) -> Column:
    """A JSON list of strings without blanks; anything else is empty."""
    kept = F.filter(F.transform(F.from_json(col(c), "array<string>"), lambda x: F.nullif(F.trim(x), F.lit(""))), lambda x: x.isNotNull())
    return F.coalesce(kept, F.array().cast("array<string>"))


def token_list(c: Column | str) -> Column:
    """Sorted distinct tokens of a JSON list, or of text separated by ``;``, ``,``, bars or blanks."""
    parsed = F.when(F.trim(col(c)).startswith("["), F.from_json(col(c), "array<string>"))
    plain = F.split(F.coalesce(col(c), F.lit("")), r"[;,|\s]+")
    both = F.filter(F.transform(F.coalesce(parsed, plain), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_sort(F.array_distinct(both))


def weighted_share(counts: Column | str, keys: list[str]) -> Column:
    """Share of a count map's total that stands at ``keys``."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total(F.map_filter(col(counts), lambda k, _: k.isin(*keys))), total(col(counts))), F.lit(0.0))


def plain(c: Column | str) -> Column:
    """Lower case, runs of other than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def agrees(text: Column | str, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(plain(text), F.lit(t)) for t in terms), F.lit(False))


def length_bin(n: Column | str) -> Column:
    """Power-of-two bin of a length."""
    k = F.length(F.bin(col(n))) - 1
    return F.when(col(n) <= 0, "len_0").otherwise(F.concat(F.lit("len2^"), k, F.lit("-"), k + 1))


def bins(x: Column | str, cuts: list[float], missing: str = "missing") -> Column:
    """Name of the left-closed, right-open bin."""
    out = F.when(col(x).isNull(), missing).when(col(x) < cuts[0], f"lt_{cuts[0]:g}")
    for a, b in zip(cuts, cuts[1:]):
        out = out.when(col(x) < b, f"{a:g}_{b:g}")
    return out.otherwise(f"ge_{cuts[-1]:g}")


def marker_class(text: Column | str, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """First rule with a marker in the text."""
    low = F.lower(col(text))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, marks in rules:
        out = out.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in marks)), name)
    return out.otherwise(default)


def lineage(c: Column | str) -> Column:
    """``a; b; c.`` as an array of its terms."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ";"), lambda x: F.regexp_replace(F.trim(x), r"\.$", "")), lambda x: x != "")


def deepest(terms: Column, suffixes: list[str], general: str) -> tuple[Column, Column]:
    """(family, where it came from): the deepest term with a suffix, else with the general one, else the last term."""
    back = F.reverse(terms)
    a = F.try_element_at(F.filter(back, lambda x: reduce(lambda p, q: p | q, (x.endswith(s) for s in suffixes))), F.lit(1))
    b = F.try_element_at(F.filter(back, lambda x: x.endswith(general)), F.lit(1))
    c = F.try_element_at(back, F.lit(1))
    source = F.when(a.isNotNull(), "family").when(b.isNotNull(), "general").when(c.isNotNull(), "last").otherwise("unknown")
    return F.coalesce(a, b, c, F.lit("unknown")), source


def windows_of(length: Column | str, size: int, overlap: int) -> Column:
    """Starts of fixed windows; the last one touches the end."""
    n = col(length)
    return F.when(n <= size, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0), n - size, F.lit(size - overlap)), F.array(n - size)))
    )


def head_tail(s: Column | str, most: int) -> Column:
    head = most // 2
    return F.when(F.length(col(s)) <= most, col(s)).otherwise(F.concat(F.left(col(s), F.lit(head)), F.right(col(s), F.lit(most - head))))


def sigmoid(z: Column | str, t: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), col(z) / t))))


def blend(a: Column | str, b: Column | str, w: float = 0.5) -> Column:
    return (1 - w) * col(a) + w * col(b)


def gain(a: Column | str, b: Column | str) -> Column:
    return col(a) - col(b)


def charset_share(s: Column | str, chars: str) -> Column:
    n = F.length(col(s))
    return F.coalesce(F.try_divide(n - F.length(F.translate(col(s), chars, "")), n), F.lit(0.0))


def longest_run(s: Column | str, chars: str) -> Column:
    """Length of the longest run of characters of a set."""
    return F.coalesce(F.array_max(F.transform(F.split(col(s), f"[^{chars}]+"), F.length)), F.lit(0))


def best_window(s: Column | str, weights: dict[str, float], size: int) -> Column:
    """Best sum of character weights over windows of ``size``; shorter text is one window."""

    @F.pandas_udf("double")
    def best(texts: pd.Series) -> pd.Series:
        def of(points, at, sizes):
            values = np.zeros(len(points))
            for c, w in weights.items():
                values[points == ord(c)] = w
            inside = np.where(windows.whole(points, at, sizes, size), windows.sums(values, size), -np.inf)
            short = np.where(sizes < size, np.add.reduceat(np.append(values, 0.0), at), -np.inf)
            return np.where(sizes > 0, np.maximum(windows.greatest(inside, at, sizes, 0.0), short), 0.0)

        return windows.by_text(texts, of)

    return best(col(s))


def dense_windows(s: Column | str, chars: str, size: int, share: float) -> Column:
    """Greedy count of non-overlapping windows whose share of set characters reaches the threshold."""

    @F.pandas_udf("double")
    def dense(texts: pd.Series) -> pd.Series:
        def of(points, at, sizes):
            enough = windows.sums(windows.among(points, chars), size) >= share * size
            return windows.greedy(enough & windows.whole(points, at, sizes, size), at, sizes, size)

        return windows.by_text(texts, of)

    return dense(col(s)).cast("int")


def four_places(x: Column) -> Column:
    """A number rounded to four places as text. 0 and 1, the commonest, are constants; a decimal becomes text several times as fast as a formatted
    double; what has none (NaN, infinite, huge or null) is formatted."""
    x = x.cast("double")
    return F.when(x == 0, "0.0000").when(x == 1, "1.0000").otherwise(F.coalesce(x.try_cast("decimal(20,4)").cast("string"), F.format_string("%.4f", F.round(x, 4))))
