"""Ranking and threshold metrics over long tables ``(keys..., score, y)``.

Equal scores are merged first, which is exact for tie-grouped curves and bounds the later windows by the number of
distinct scores. Cumulative sums over a whole group run in two passes: sums of score ranges, then inside each range, so
no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.scalar import sigmoid
from corvane.operators.ranking import following, ranked, running
from corvane.session import materialise

#: Ranges that the first look at the scores asks for, rows of a range, most ranges.
RANGES, RANGE_ROWS, MOST_RANGES = 64, 100_000, 4096


def curve(scored: DataFrame, keys: list[str], score: str = "score", y: str = "y", weight: str | None = None) -> DataFrame:
    """``(keys, score, n, tp, cum_n, cum_tp)``: one row for each distinct score, cumulative from the highest."""
    w = F.col(weight) if weight else F.lit(1)
    point = scored.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.sum(w).alias("n"), F.sum(F.col(y) * w).alias("tp"))
    return cumulated(point, keys, cuts(scored, score))


def cuts(scored: DataFrame, score: str = "score") -> list[float]:
    """Quantiles of the scores, where ranges are cut; numbers, since both passes over the ranges must see the same ones. There is
    a range for each ``RANGE_ROWS`` rows, ``MOST_RANGES`` at most, and no cut if one range is enough."""

    def quantiles(n: int):
        return F.percentile_approx(score, F.array(*(F.lit(k / n) for k in range(1, n))), 10 * n)

    rows, found = scored.agg(F.count("*"), quantiles(RANGES)).first()
    ranges = min(MOST_RANGES, -(-rows // RANGE_ROWS))
    if ranges <= 1:
        return []
    if ranges > RANGES:
        found = scored.agg(quantiles(ranges)).first()[0]
    return sorted(set(found or []))


def ranged(point: DataFrame, at: list[float]) -> DataFrame:
    """Adds ``_range``, the number of the cuts below the score."""
    cut = F.array(*map(F.lit, at)) if len(at) <= RANGES else F.transform(F.split(F.lit(",".join(map(repr, at))), ","), lambda c: c.cast("double"))
    return point.withColumn("_range", F.size(F.filter(cut, lambda c: c < F.col("score"))) if at else F.lit(0))


def cumulated(point: DataFrame, keys: list[str], at: list[float], always: bool = False) -> DataFrame:
    """Adds ``cum_n`` and ``cum_tp`` from the highest score down to points (keys, score, n, tp) of distinct scores, by the
    ranges between ``at``. These follow the scores, so that skewed ones do not fall into one range. Without cuts a group is
    summed in one window, unless ``always`` says that there may be many rows all the same."""
    if not at and not always:
        down = W.partitionBy(*keys).orderBy(F.desc("score"))
        return point.select("*", F.sum("n").over(down).alias("cum_n"), F.sum("tp").over(down).alias("cum_tp"))
    point = ranged(point, at)
    part = point.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"), F.sum("tp").alias("_tp"))
    above = W.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    part = part.select(*keys, "_range", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_an"), F.coalesce(F.sum("_tp").over(above), F.lit(0)).alias("_atp"))
    inside = W.partitionBy(*keys, "_range").orderBy(F.desc("score"))
    out = point.withColumn("_in", F.sum("n").over(inside)).withColumn("_itp", F.sum("tp").over(inside))
    part = part.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_range"])), "_an", "_atp")
    same = F.lit(True)
    for i, k in enumerate([*keys, "_range"]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = out.join(part, same)
    return out.select(*(c for c in point.columns if c != "_range"), (F.col("_an") + F.col("_in")).alias("cum_n"), (F.col("_atp") + F.col("_itp")).alias("cum_tp"))


def average_precision(scored: DataFrame, keys: list[str], score: str = "score", y: str = "y", weight: str | None = None) -> DataFrame:
    """``(keys, positives, ap)`` with ties grouped; null without positives."""
    c = curve(scored, keys, score, y, weight)
    return c.groupBy(*keys).agg(F.sum("tp").alias("positives"), F.try_divide(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")), F.sum("tp")).alias("ap"))


def average_precision_by_row(scored: DataFrame, keys: list[str], order: list[Column], score: str = "score", y: str = "y", weight: str | None = None) -> DataFrame:
    """As ``average_precision`` with ties in the order of ``order``, and weights."""
    w = F.col(weight) if weight else F.lit(1.0)
    step = running(scored.withColumn("_w", w * F.col(y)), keys, [F.desc(score), *order], {"_tp": w * F.col(y), "_n": w})
    return step.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_w") * F.try_divide(F.col("_tp"), F.col("_n"))), F.sum("_w")).alias("ap"))


def confusion(scored: DataFrame, keys: list[str], score: str = "score", y: str = "y", threshold: Column | float = 0.5) -> DataFrame:
    """``(keys, tp, fp, fn)``: the sufficient statistic of every F1."""
    hit = F.col(score) >= threshold
    return scored.groupBy(*keys).agg(F.count_if(hit & (F.col(y) == 1)).alias("tp"), F.count_if(hit & (F.col(y) == 0)).alias("fp"), F.count_if(~hit & (F.col(y) == 1)).alias("fn"))


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    """Null where nothing is predicted or true."""
    return F.try_divide(2.0 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))


def merged(scored: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """``(keys, score, n, tp, pos, neg)``: rows of equal scores as one, written, so that every measure reads points and not the rows."""
    true, false = F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    return materialise(scored.groupBy(*keys, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(y).alias("tp"), true, false), "points")


def _four(point: DataFrame, keys: list[str], threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Macro AP, micro AP and both F1 of points (keys, label_id, score, n, tp, pos, neg)."""

    def ap(own: DataFrame, names: list[str]) -> DataFrame:
        return cumulated(own, names, at).groupBy(*names).agg(F.try_divide(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")), F.sum("tp")).alias("ap"))

    at = cuts(point)
    ranked_ = point.where("score is not null")
    macro = ap(ranked_.select(*keys, "label_id", "score", "n", "tp"), [*keys, "label_id"]).groupBy(*keys).agg(F.avg("ap").alias("macro_ap"))
    micro = ap(ranked_.groupBy(*keys, "score").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp")), keys).select(*keys, F.col("ap").alias("micro_ap"))
    hit, none = F.col("score") >= threshold, F.lit(0)
    count = point.groupBy(*keys, "label_id").agg(*(F.sum(F.when(h, F.col(c)).otherwise(none)).alias(n) for n, h, c in (("tp", hit, "pos"), ("fp", hit, "neg"), ("fn", ~hit, "pos"))))
    pooled = F.try_divide(2.0 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))
    return macro, micro, count.groupBy(*keys).agg(F.avg(F.coalesce(f1(), F.lit(0.0))).alias("macro_f1"), pooled.alias("micro_f1"))


def macro_micro(scored: DataFrame, score: str = "score", y: str = "y", threshold: float = 0.5) -> DataFrame:
    """One row: macro and micro AP (labels with positives) and macro and micro F1 (undefined labels count 0)."""
    macro, micro, f = _four(merged(scored, ["label_id"], score, y), [], threshold)
    return macro.join(micro).join(f)


def four_metrics(scored: DataFrame, keys: list[str], score: str = "score", y: str = "y", threshold: float = 0.5) -> DataFrame:
    """``(keys, macro_ap, micro_ap, macro_f1, micro_f1)``: as ``macro_micro`` for each group."""
    macro, micro, f = _four(merged(scored, [*keys, "label_id"], score, y), keys, threshold)
    return macro.join(micro, keys).join(f, keys)


def fmax_on_quantiles(scored: DataFrame, keys: list[str], quantiles: int = 401, score: str = "score", y: str = "y") -> DataFrame:
    """``(keys, fmax, threshold)`` over evenly spaced quantiles of the scores (interpolated between neighbours), the lowest
    threshold that reaches it. Quantiles are read off the curve's cumulative counts: no task sorts a group's rows."""
    c = materialise(curve(scored, keys, score, y), "curve")
    total = c.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("tp").alias("_p"))
    j = c.join(total, keys) if keys else c.join(total)
    # ranks from the lowest score: a distinct score holds ranks first to last; quantile k stands at k * (n - 1) / (quantiles - 1)
    first, step = F.col("_n") - F.col("cum_n"), F.lit(quantiles - 1)
    j = j.withColumn("_first", first).withColumn("_last", first + F.col("n") - 1)
    up = following(j, keys, [F.col("score")], "score", "_next")
    # quantiles that fall on a score, and those between its last rank and the next score
    k = F.explode(F.filter(F.sequence(F.ceil(F.col("_first") * step / F.greatest(F.col("_n") - 1, F.lit(1))), F.least(step.cast("bigint"), F.floor((F.col("_last") + 1) * step / F.greatest(F.col("_n") - 1, F.lit(1))))), lambda x: x * (F.col("_n") - 1) < (F.col("_last") + 1) * step)).alias("_k")
    point = up.select("*", k)
    place = F.col("_k") * (F.col("_n") - 1) / step
    t = F.when(place <= F.col("_last"), F.col("score")).otherwise(F.col("score") + (place - F.col("_last")) * (F.col("_next") - F.col("score")))
    exact = place <= F.col("_last")
    n, tp = F.when(exact, F.col("cum_n")).otherwise(F.col("cum_n") - F.col("n")), F.when(exact, F.col("cum_tp")).otherwise(F.col("cum_tp") - F.col("tp"))
    point = point.select(*keys, t.alias("t"), F.round(F.try_divide(2.0 * tp, n + F.col("_p")), 9).alias("f"))
    return point.groupBy(*keys).agg(F.max("f").alias("fmax"), F.min_by("t", F.struct(-F.col("f"), "t")).alias("threshold"))


def coverage_table(scored: DataFrame, tops: DataFrame, shares: list[float], threshold: float = 0.5) -> DataFrame:
    """``(share, kept, top1_precision, precision, recall, f1)``: the best-scored share of the items (item_id, top, hit) is kept, ties by
    id, and predictions of other items count as absent. Items are ranked by ranges."""
    n = tops.count()
    place = ranked(tops, [], [F.desc("top"), F.col("item_id")], "_k").withColumn("x", F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.lit(max(1, round(s * n))).alias("most")) for s in shares))))
    g = place.select("item_id", "hit", F.col("x.share").alias("share"), (F.col("_k") <= F.col("x.most")).alias("in"))
    top1 = g.groupBy("share").agg(F.count_if("in").alias("kept"), F.avg(F.when(F.col("in"), F.col("hit"))).alias("top1_precision"))
    hit, y = F.col("in") & (F.col("score") >= threshold), F.col("y") == 1
    c = scored.select("item_id", "score", "y").join(g.select("item_id", "share", "in"), "item_id").groupBy("share").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return top1.join(c, "share").select("share", "kept", "top1_precision", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def fmax(scored: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """``(keys, fmax, threshold)``: best F1 over all distinct scores, at the highest threshold that reaches it."""
    c = curve(scored, keys, score, y)
    total = c.groupBy(*keys).agg(F.sum("tp").alias("_p"))
    j = c.join(total, keys) if keys else c.join(total)
    j = j.withColumn("f", F.try_divide(2.0 * F.col("cum_tp"), F.col("cum_n") + F.col("_p")))
    return j.groupBy(*keys).agg(F.max("f").alias("fmax"), F.max_by("score", F.struct("f", "score")).alias("threshold"))


def grid_threshold(scored: DataFrame, keys: list[str], grid: list[float], score: str = "score", y: str = "y", default: float = 0.5) -> DataFrame:
    """Best F1 over a fixed grid, the first best wins; ``default`` without positives."""
    counts = [F.struct(F.lit(t).alias("t"), F.count_if((F.col(score) >= t) & (F.col(y) == 1)).alias("tp"), F.count_if(F.col(score) >= t).alias("n")) for t in grid]
    out = scored.groupBy(*keys).agg(F.sum(y).alias("p"), F.array(*counts).alias("g"))
    best = F.array_max(F.transform("g", lambda g: F.struct(F.coalesce(F.try_divide(2.0 * g["tp"], g["n"] + F.col("p")), F.lit(0.0)).alias("f"), (-g["t"]).alias("t"))))
    return out.select(*keys, F.when(F.col("p") > 0, -best["t"]).otherwise(default).alias("threshold"), best["f"].alias("f1"))


def precision_threshold(scored: DataFrame, keys: list[str], target: float, score: str = "score", y: str = "y") -> DataFrame:
    """Lowest score whose cumulative precision reaches the target; 1.0 with precision 0 if none does."""
    c = curve(scored, keys, score, y).withColumn("p", F.col("cum_tp") / F.col("cum_n"))
    return c.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("p") >= target, F.col("score"))), F.lit(1.0)).alias("threshold"), F.coalesce(F.min_by("p", F.when(F.col("p") >= target, F.col("score"))), F.lit(0.0)).alias("precision"))


def coverage_curve(tops: DataFrame, shares: list[float], score: str = "score", y: str = "y") -> DataFrame:
    """``(share, kept, precision)`` of the best-scored share of the rows. Whole ties are cut in proportion, so no global row
    order is needed: a partly kept tie counts with its own precision."""
    c = curve(tops, [], score, y)
    total = c.agg(F.sum("n").alias("total"))
    grid = F.explode(F.array(*(F.lit(s) for s in shares))).alias("share")
    j = c.join(total).select("*", grid).withColumn("kept", F.bround(F.col("share") * F.col("total")).cast("bigint"))
    before = F.col("cum_n") - F.col("n")
    inside = F.greatest(F.lit(0), F.least(F.col("n"), F.col("kept") - before))
    return j.groupBy("share", "kept").agg(F.try_divide(F.sum(F.col("tp") * inside / F.col("n")), F.sum(inside)).alias("precision"))


def temperature(logits: DataFrame, coarse: int = 70, fine: int = 41) -> DataFrame:
    """One row (temperature, loss) of rows (y, z, n): the least cross-entropy over steps of five per cent from 0.25 on, then over steps of
    a quarter per cent around the best. Each grid is one aggregate."""

    def losses(grid: list[float]) -> tuple[float, float]:
        p = lambda t: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), sigmoid("z", t)))
        row = logits.agg(*(F.sum(-F.col("n") * F.when(F.col("y") == 1, F.log(p(t))).otherwise(F.log(1 - p(t)))) for t in grid)).first()
        return min((round(loss or 0.0, 9), t, loss) for loss, t in zip(row, grid))[1:]

    best, _ = losses([0.25 * 1.05**k for k in range(coarse)])
    best, loss = losses([best * 1.05 ** ((k - fine // 2) / 20) for k in range(fine)])
    return logits.sparkSession.createDataFrame([(best, loss)], "temperature double, loss double")
