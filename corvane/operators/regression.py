"""Least squares on sums of products: one aggregate over the rows, and a small system of equations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def student_p(t: float, freedom: float) -> float:
    """Two-sided p of Student's t."""
    return _beta_tail(freedom / 2, 0.5, freedom / (freedom + t * t))


def least_squares(df: DataFrame, y: str, numbers: list[str], classes: list[str] = ()) -> DataFrame:
    """``(term, coefficient, error, t, p, r2)`` of an ordinary fit on standardised columns.

    A class column gives one 0/1 column for each value but its first; constant columns are dropped, as are columns that
    others determine. Rows with a null are left out; fewer rows than five give no terms. The number of classes is the
    size of the system and must be small.
    """
    df = df.select(y, *numbers, *classes).dropna()
    columns = {c: F.col(c).cast("double") for c in numbers}
    for c in classes:
        levels = sorted(r[0] for r in df.select(c).distinct().collect())  # a column of the system for each
        columns |= {f"{c}={v}": (F.col(c) == v).cast("double") for v in levels[1:]}
    target = F.col(y).cast("double")
    stats = df.agg(F.count("*").alias("n"), F.avg(target).alias("m"), F.var_pop(target).alias("v"), *(f(x).alias(f"{n}{i}") for i, x in enumerate(columns.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    n = stats["n"]
    terms = [(name, x, stats[f"m{i}"], stats[f"s{i}"]) for i, (name, x) in enumerate(columns.items()) if n and stats[f"s{i}"] > 1e-12]
    rows = []
    if n >= 5:
        x = [F.lit(1.0), *((c - m) / s for _, c, m, s in terms)]
        sums = df.agg(*(F.sum(a * b).alias(f"p{i}_{j}") for i, a in enumerate(x) for j, b in enumerate([*x, target - stats["m"]]) if j >= i)).first()
        k = len(x)
        gram = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        right = np.array([sums[f"p{i}_{k}"] for i in range(k)])
        kept = [0]
        for i in range(1, k):  # a column that the kept ones determine adds no rank
            part = gram[np.ix_([*kept, i], [*kept, i])] / n
            if np.linalg.eigvalsh(part)[0] > 1e-9:
                kept.append(i)
        inverse = np.linalg.inv(gram[np.ix_(kept, kept)])
        beta = inverse @ right[kept]
        freedom, total = n - len(kept), stats["v"] * n
        left = max(total - beta @ right[kept], 0.0)
        r2 = 1 - left / total if total > 0 else 0.0
        beta[0] += stats["m"]
        for place, i in enumerate(kept):
            error = math.sqrt(left / freedom * inverse[place, place]) if freedom > 0 else None
            t = float(beta[place] / error) if error else None
            rows.append(("intercept" if i == 0 else terms[i - 1][0], float(beta[place]), error, t, student_p(t, freedom) if t is not None else None, float(r2)))
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, error double, t double, p double, r2 double")
