"""Queries: bootstraps, permutation tests, exact tests and effect tables (INF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import resample
from corvane.plans.features import F1, K, counts, f1m, summed
from corvane.plans.fixtures import SCORES, scores
from corvane.plans.registry import query
from corvane.session import table

R = lambda c, n=6: F.round(c, n)
#: Draws of intervals, draws of tests and intervals inside groups, and draws of clusters.
ITER, DRAWS_IN_GROUP, CLUSTER_DRAWS = 1000, 200, 500
#: Rows of the least stratum of the atlas.
LEAST = 20
NAMES = ("macro_ap", "micro_ap", "macro_f1", "micro_f1")


def draws_sql(iterations: int = ITER, seeds: tuple[int, ...] = (42,), block: str = "family", rows: str = "scores") -> str:
    return f"""nb AS (SELECT {block}, row_number() OVER (ORDER BY {block}) - 1 AS place FROM (SELECT DISTINCT {block} FROM {rows})), kk AS (SELECT count(*) AS k FROM nb HAVING count(*) > 1),
dr AS (SELECT seed, iter, (('0x' || substr(md5(seed || '|' || iter || '|' || j), 1, 8))::UBIGINT % k)::BIGINT AS place FROM kk, (SELECT unnest({list(seeds)}) AS seed) s, (SELECT unnest(range({iterations})) AS iter) a, LATERAL (SELECT unnest(range(k)) AS j) b),
wt AS (SELECT seed, iter, {block}, count(*) AS w FROM dr JOIN nb USING (place) GROUP BY ALL)"""


INTERVAL = "round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.025), 6) AS low, round(quantile_cont({0}, 0.975), 6) AS high"


def interval_columns(df, keys):
    return df.select(*keys, *(R(c).alias(c) for c in ("mean", "low", "high")))


@query("inf0_block_weights", f"WITH {SCORES}, {draws_sql()} SELECT iter, family, w FROM wt")
def inf0(spark, sf):
    return resample.block_weights(scores(spark, sf), "family", ITER)


BOOT = """, mg AS (SELECT label_id, {c} AS score, family, count(*) AS n, sum(y) AS tp FROM scores GROUP BY ALL), pt AS (SELECT iter, label_id, score, sum(w * n) AS n, sum(w * tp) AS tp FROM mg JOIN wt USING (family) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER q AS cn, sum(tp) OVER q AS ct FROM pt WINDOW q AS (PARTITION BY iter, label_id ORDER BY score DESC)), it AS (SELECT iter, avg(ap) AS v FROM (SELECT iter, label_id, sum(tp * ct / cn) / nullif(sum(tp), 0) AS ap FROM c GROUP BY 1, 2) GROUP BY 1)"""


@query("inf1_block_bootstrap_ap", f"WITH {SCORES}, {draws_sql()}" + BOOT.format(c="context") + f" SELECT {INTERVAL.format('v')} FROM it")
def inf1(spark, sf):
    v = resample.bootstrap_ap(scores(spark, sf), [], "family", ITER, score="context")
    return interval_columns(resample.interval(v, [], "macro_ap"), [])


@query("inf4_weighted_cache_bootstrap", f"WITH {SCORES}, {draws_sql()}" + BOOT.format(c="base") + " SELECT iter, round(v, 6) AS macro_ap FROM it")
def inf4(spark, sf):
    return resample.weighted_cache_ap(scores(spark, sf), "family", ITER, score="base").select("iter", R("macro_ap").alias("macro_ap"))


def paired_sql(seeds: tuple[int, ...]) -> str:
    return f"""WITH {SCORES}, {draws_sql(seeds=seeds)}, u AS (SELECT 'base' AS m, label_id, y, base AS score, family FROM scores UNION ALL SELECT 'context', label_id, y, context, family FROM scores),
mg AS (SELECT m, label_id, score, family, count(*) AS n, sum(y) AS tp FROM u GROUP BY ALL), pt AS (SELECT seed, iter, m, label_id, score, sum(w * n) AS n, sum(w * tp) AS tp FROM mg JOIN wt USING (family) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER q AS cn, sum(tp) OVER q AS ct FROM pt WINDOW q AS (PARTITION BY seed, iter, m, label_id ORDER BY score DESC)),
ma AS (SELECT seed, iter, m, avg(ap) AS v FROM (SELECT seed, iter, m, label_id, sum(tp * ct / cn) / nullif(sum(tp), 0) AS ap FROM c GROUP BY ALL) GROUP BY ALL),
pm AS (SELECT seed, iter, m, score, sum(n) AS n, sum(tp) AS tp FROM pt GROUP BY ALL), cm AS (SELECT *, sum(n) OVER q AS cn, sum(tp) OVER q AS ct FROM pm WINDOW q AS (PARTITION BY seed, iter, m ORDER BY score DESC)),
mi AS (SELECT seed, iter, m, sum(tp * ct / cn) / nullif(sum(tp), 0) AS v FROM cm GROUP BY ALL),
kf AS (SELECT m, label_id, family, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn FROM u GROUP BY ALL),
fi AS (SELECT seed, iter, m, label_id, sum(w * tp) AS tp, sum(w * fp) AS fp, sum(w * fn) AS fn FROM kf JOIN wt USING (family) GROUP BY ALL),
ff AS (SELECT seed, iter, m, avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS a, 2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) AS b FROM fi GROUP BY ALL),
v AS (SELECT 'macro_ap' AS metric, * FROM ma UNION ALL SELECT 'micro_ap', * FROM mi UNION ALL SELECT 'macro_f1', seed, iter, m, a FROM ff UNION ALL SELECT 'micro_f1', seed, iter, m, b FROM ff),
d AS (SELECT metric, seed, iter, max(v) FILTER (m = 'context') - max(v) FILTER (m = 'base') AS d FROM v GROUP BY ALL), e AS (SELECT metric, iter, avg(d) AS d FROM d GROUP BY ALL)
SELECT metric, {INTERVAL.format('d')} FROM e GROUP BY 1"""


def paired_deltas(spark, sf, seeds):
    """(seed, iter, metric, d) of both models' scores under the same draws."""
    u = scores(spark, sf).unpivot(["label_id", "y", "family"], ["base", "context"], "m", "score")
    out = None
    for seed in seeds:
        v = resample.metric_draws(u, "m", "family", ITER, seed).unpivot(["m", "iter"], list(NAMES), "metric", "v")
        at = lambda m: F.max(F.when(F.col("m") == m, F.col("v")))
        d = v.groupBy("metric", "iter").agg((at("context") - at("base")).alias("d")).withColumn("seed", F.lit(seed))
        out = d if out is None else out.unionByName(d)
    return out


@query("inf2_paired_bootstrap", paired_sql((42,)))
def inf2(spark, sf):
    return interval_columns(resample.interval(paired_deltas(spark, sf, (42,)), ["metric"], "d"), ["metric"])


@query("inf3_seed_averaged_bootstrap", paired_sql((1, 2, 3)))
def inf3(spark, sf):
    mean = paired_deltas(spark, sf, (1, 2, 3)).groupBy("metric", "iter").agg(F.avg("d").alias("d"))
    return interval_columns(resample.interval(mean, ["metric"], "d"), ["metric"])


@query("inf5_delta_f1_bootstrap", K + f", {draws_sql(DRAWS_IN_GROUP)}, it AS (SELECT iter, label_id, {F1('b').replace('sum(', 'sum(w * ')} - {F1('a').replace('sum(', 'sum(w * ')} AS v FROM k JOIN wt USING (family) GROUP BY 1, 2) SELECT label_id, {INTERVAL.format('v')} FROM it GROUP BY 1")
def inf5(spark, sf):
    k = counts(spark, sf)
    drawn = k.join(resample.block_weights(k, "family", DRAWS_IN_GROUP), "family")
    s = drawn.groupBy("iter", "label_id").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in ("tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b")))
    return interval_columns(resample.interval(s.select("label_id", (f1m("b") - f1m("a")).alias("d")), ["label_id"], "d"), ["label_id"])


@query("inf6_block_swap_permutation", K + f", f AS (SELECT family, sum(tp_a) AS ta, sum(fp_a) AS pa, sum(fn_a) AS na, sum(tp_b) AS tb, sum(fp_b) AS pb, sum(fn_b) AS nb FROM k GROUP BY 1), s AS (SELECT iter, family, iter >= 0 AND ('0x' || substr(md5('42|' || iter || '|' || family), 1, 8))::UBIGINT % 2 = 1 AS sw, f.* EXCLUDE (family) FROM f, (SELECT unnest(range(-1, {DRAWS_IN_GROUP})) AS iter)), d AS (SELECT iter, 2.0 * sum(CASE WHEN sw THEN ta ELSE tb END) / sum(CASE WHEN sw THEN 2 * ta + pa + na ELSE 2 * tb + pb + nb END) - 2.0 * sum(CASE WHEN sw THEN tb ELSE ta END) / sum(CASE WHEN sw THEN 2 * tb + pb + nb ELSE 2 * ta + pa + na END) AS d FROM s GROUP BY 1) SELECT round(max(d) FILTER (iter = -1), 6) AS observed, count(*) FILTER (iter >= 0 AND abs(d) >= (SELECT abs(d) FROM d WHERE iter = -1) - 1e-12) / {DRAWS_IN_GROUP} AS p FROM d")
def inf6(spark, sf):
    t = resample.swap_test(summed(counts(spark, sf), "family"), "family", DRAWS_IN_GROUP)
    return t.select(R("observed").alias("observed"), "p")


ITEM_DRAWS = f"""pi AS (SELECT family, item_id, row_number() OVER (PARTITION BY family ORDER BY item_id) AS place, count(*) OVER (PARTITION BY family) AS k FROM (SELECT DISTINCT family, item_id FROM scores)),
di AS (SELECT family, iter, (('0x' || substr(md5('42|' || family || '|' || iter || '|' || place), 1, 8))::UBIGINT % k)::BIGINT + 1 AS place FROM pi, (SELECT unnest(range({DRAWS_IN_GROUP})) AS iter)),
wi AS (SELECT d.family, iter, item_id, count(*) AS w FROM di d JOIN pi p ON d.family = p.family AND d.place = p.place GROUP BY ALL),
ki AS (SELECT item_id, count(*) FILTER (base >= 0.5 AND y = 1) AS tp_a, count(*) FILTER (base >= 0.5 AND y = 0) AS fp_a, count(*) FILTER (base < 0.5 AND y = 1) AS fn_a, count(*) FILTER (context >= 0.5 AND y = 1) AS tp_b, count(*) FILTER (context >= 0.5 AND y = 0) AS fp_b, count(*) FILTER (context < 0.5 AND y = 1) AS fn_b FROM scores GROUP BY 1),
vi AS (SELECT family, iter, {F1('b').replace('sum(', 'sum(w * ')} - {F1('a').replace('sum(', 'sum(w * ')} AS v FROM wi JOIN ki USING (item_id) GROUP BY 1, 2)"""


def family_draws(spark, sf):
    """(family, iter, d): the micro F1 difference under draws of the family's items."""
    per_item = counts(spark, sf, ("family", "item_id"))
    s = resample.item_draws(per_item, "family", "item_id", ["tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b"], DRAWS_IN_GROUP)
    return s.select("family", (f1m("b") - f1m("a")).alias("d"))


@query("inf7_item_bootstrap_in_family", f"WITH {SCORES}, {ITEM_DRAWS} SELECT family, {INTERVAL.format('v')} FROM vi GROUP BY 1")
def inf7(spark, sf):
    return interval_columns(resample.interval(family_draws(spark, sf), ["family"], "d"), ["family"])


@query("inf18_family_effects", K + f", {ITEM_DRAWS}, e AS (SELECT family, {INTERVAL.format('v')} FROM vi GROUP BY 1), f AS (SELECT family, sum(n) AS n, sum(positives) AS positives, round({F1('b')} - {F1('a')}, 6) AS delta FROM k GROUP BY 1 HAVING sum(n) >= 50 AND sum(positives) >= 20) SELECT family, n, positives, delta, low, high FROM f JOIN e USING (family)")
def inf18(spark, sf):
    f = summed(counts(spark, sf), "family").where("n >= 50 and positives >= 20")
    e = interval_columns(resample.interval(family_draws(spark, sf).join(f.select("family"), "family", "left_semi"), ["family"], "d"), ["family"])
    return f.join(e, "family").select("family", "n", "positives", R(f1m("b") - f1m("a")).alias("delta"), "low", "high")


@query("inf8_bootstrap_of_label_deltas", K + f", d AS (SELECT label_id, family, {F1('b')} - {F1('a')} AS d FROM k GROUP BY 1, 2), {draws_sql(rows='d')}, x AS (SELECT label_id, iter, d FROM d JOIN wt USING (family), LATERAL (SELECT unnest(range(w)))), it AS (SELECT label_id, iter, avg(d) AS a, median(d) AS b FROM x GROUP BY ALL), o AS (SELECT label_id, round(avg(d), 6) AS mean, round(median(d), 6) AS median FROM d GROUP BY 1) SELECT label_id, any_value(mean) AS mean, round(list_sort(list(a))[26], 6) AS mean_low, round(list_sort(list(a))[975], 6) AS mean_high, any_value(median) AS median, round(list_sort(list(b))[26], 6) AS median_low, round(list_sort(list(b))[975], 6) AS median_high FROM it JOIN o USING (label_id) GROUP BY 1")
def inf8(spark, sf):
    d = summed(counts(spark, sf), "label_id", "family").select("label_id", "family", (f1m("b") - f1m("a")).alias("d"))
    it = d.join(resample.block_weights(d, "family", ITER), "family").groupBy("label_id", "iter")
    it = it.agg((F.sum(F.when(F.col("d").isNotNull(), F.col("w") * F.col("d"))) / F.sum(F.when(F.col("d").isNotNull(), F.col("w")))).alias("a"), F.percentile("d", F.lit(0.5), F.col("w")).alias("b"))
    s = it.groupBy("label_id").agg(F.array_sort(F.collect_list("a")).alias("a"), F.array_sort(F.collect_list("b")).alias("b"))  # one value an iteration
    o = d.groupBy("label_id").agg(R(F.avg("d")).alias("mean"), R(F.percentile("d", F.lit(0.5))).alias("median"))
    return s.join(o, "label_id").select("label_id", "mean", R(F.col("a")[25]).alias("mean_low"), R(F.col("a")[974]).alias("mean_high"), "median", R(F.col("b")[25]).alias("median_low"), R(F.col("b")[974]).alias("median_high"))


CLUSTERS = "m AS (SELECT p_partkey, p_brand AS cluster, split_part(p_type, ' ', 1) AS kind, p_size FROM part)"


@query("inf9_cluster_permutation_null", f"WITH {CLUSTERS}, c AS (SELECT cluster, row_number() OVER (ORDER BY p_partkey) AS k FROM m), s AS (SELECT iter, p_partkey, kind, p_size, row_number() OVER (PARTITION BY iter ORDER BY md5('42|' || iter || '|' || p_partkey), p_partkey) AS k FROM m, (SELECT unnest(range({CLUSTER_DRAWS})) AS iter)), a AS (SELECT -1 AS iter, cluster, kind, p_size FROM m UNION ALL SELECT iter, cluster, kind, p_size FROM s JOIN c USING (k)), g AS (SELECT iter, cluster, kind, count(*) AS n, count(*) FILTER (p_size > 25) AS large FROM a GROUP BY ALL), q AS (SELECT iter, cluster, sum(n) AS n, max(n) AS mode, sum(large) / sum(n) AS large FROM g GROUP BY ALL), v AS (SELECT iter, sum(mode) / sum(n)::DOUBLE AS consistency, stddev_pop(large) AS spread FROM q GROUP BY 1), u AS (SELECT 'consistency' AS metric, iter, round(consistency, 9) AS v FROM v UNION ALL SELECT 'spread', iter, round(spread, 9) FROM v) SELECT metric, round(max(v) FILTER (iter = -1), 6) AS observed, round(avg(v) FILTER (iter >= 0), 6) AS null_mean, round((count(*) FILTER (iter >= 0 AND v >= o.x) + 1) / (count(*) FILTER (iter >= 0) + 1), 6) AS p FROM u JOIN (SELECT metric, v AS x FROM u WHERE iter = -1) o USING (metric) GROUP BY metric")
def inf9(spark, sf):
    """Size-weighted share of the modal kind, and spread of the share of large parts, against clusters dealt anew."""
    m = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("cluster"), F.split("p_type", " ")[0].alias("kind"), (F.col("p_size") > 25).cast("int").alias("large"))
    dealt = resample.permuted_counts(m, "p_partkey", "cluster", ["kind", "large"], CLUSTER_DRAWS)
    g = dealt.groupBy("iter", "cluster", "kind").agg(F.sum("n").alias("n"), F.sum(F.col("large") * F.col("n")).alias("large"))
    q = g.groupBy("iter", "cluster").agg(F.sum("n").alias("n"), F.max("n").alias("mode"), (F.sum("large") / F.sum("n")).alias("large"))
    v = q.groupBy("iter").agg((F.sum("mode") / F.sum("n")).alias("consistency"), F.stddev_pop("large").alias("spread"))
    u = v.unpivot("iter", ["consistency", "spread"], "metric", "v").withColumn("v", R("v", 9))
    seen = u.where("iter = -1").select("metric", F.col("v").alias("observed"))  # one row for each metric
    null = F.col("iter") >= 0
    t = u.join(F.broadcast(seen), "metric").groupBy("metric", "observed")
    t = t.agg(F.avg(F.when(null, F.col("v"))).alias("null_mean"), ((F.count_if(null & (F.col("v") >= F.col("observed"))) + 1) / (F.count_if(null) + 1)).alias("p"))
    return t.select("metric", *(R(c).alias(c) for c in ("observed", "null_mean", "p")))


@query("inf10_sign_test", K + f", d AS (SELECT label_id, {F1('b')} - {F1('a')} AS d FROM k GROUP BY family, label_id), s AS (SELECT label_id, count(*) FILTER (d > 0) AS a, count(*) FILTER (d < 0) AS b FROM d GROUP BY 1) SELECT label_id, a, b, round(least(1, 2 * list_sum(list_transform(range(least(a, b) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))))), 6) AS p FROM s")
def inf10(spark, sf):
    d = counts(spark, sf).select("label_id", (f1m("b") - f1m("a")).alias("d"))
    s = d.groupBy("label_id").agg(F.count_if(F.col("d") > 0).alias("a"), F.count_if(F.col("d") < 0).alias("b"))
    return s.select("label_id", "a", "b", R(resample.sign_test(F.col("a"), F.col("b"))).alias("p"))


SIGNED = f"WITH {SCORES}, d AS (SELECT label_id, host, round(avg(context - base), 4) AS d FROM scores GROUP BY label_id, host, family), r AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY abs(d)) AS k, count(*) OVER (PARTITION BY label_id, abs(d)) AS t FROM d WHERE d <> 0), a AS (SELECT label_id, d, min(k) OVER (PARTITION BY label_id, abs(d)) + (t - 1) / 2.0 AS rank, t FROM r), w AS (SELECT label_id, coalesce(sum(rank) FILTER (d > 0), 0) AS plus, coalesce(sum(rank) FILTER (d < 0), 0) AS minus, count(*) AS n, sum(t * t - 1) AS ties FROM a GROUP BY 1), z AS (SELECT *, least(plus, minus) - n * (n + 1) / 4.0 AS dev, sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS sd FROM w)"
#: A rational approximation of the error function's complement (absolute error under 1.5e-7), fixed values.
ERFC = (0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))


@query("inf11_signed_rank", SIGNED + f", e AS (SELECT *, abs(dev / sd) / sqrt(2) AS x, 1 / (1 + {ERFC[0]} * abs(dev / sd) / sqrt(2)) AS q FROM z) SELECT label_id, round(least(plus, minus), 2) AS w, n, round(dev / sd, 5) AS z, round(q * ({ERFC[1][0]} + q * ({ERFC[1][1]} + q * ({ERFC[1][2]} + q * ({ERFC[1][3]} + q * {ERFC[1][4]})))) * exp(-x * x), 5) AS p FROM e")
def inf11(spark, sf):
    d = scores(spark, sf).groupBy("label_id", "host", "family").agg(F.round(F.avg(F.col("context") - F.col("base")), 4).alias("d")).where("d <> 0")
    return resample.signed_rank(d, "label_id", "d").select("label_id", R("w", 2).alias("w"), "n", R("z", 5).alias("z"), R("p", 5).alias("p"))


TWO = f"WITH {SCORES}, t AS (SELECT label_id, count(*) FILTER (base >= 0.5 AND host = 'en') AS a, count(*) FILTER (base < 0.5 AND host = 'en') AS b, count(*) FILTER (base >= 0.5 AND host <> 'en') AS c, count(*) FILTER (base < 0.5 AND host <> 'en') AS d FROM scores WHERE y = 0 GROUP BY 1)"


def two_by_two(spark, sf):
    s = scores(spark, sf).where("y = 0")
    at = lambda h, over: F.count_if(((F.col("base") >= 0.5) == F.lit(over)) & ((F.col("host") == "en") == F.lit(h)))
    return s.groupBy("label_id").agg(at(True, True).alias("a"), at(True, False).alias("b"), at(False, True).alias("c"), at(False, False).alias("d"))


LC = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
PX = lambda x: f"exp({LC('(a + b)', x)} + {LC('(c + d)', f'(a + c - {x})')} - {LC('(a + b + c + d)', '(a + c)')})"


@query("inf12_fisher_exact", TWO + f" SELECT label_id, round(least(1, list_sum(list_filter(list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda x: {PX('x')}), lambda p: p <= {PX('a')} * (1 + 1e-7)))), 6) AS p FROM t")
def inf12(spark, sf):
    return two_by_two(spark, sf).select("label_id", R(resample.fisher(*(F.col(c) for c in "abcd"))).alias("p"))


@query("inf13_mcnemar", f"WITH {SCORES}, t AS (SELECT host, label_id, count(*) FILTER (base >= 0.5 AND context < 0.5) AS a, count(*) FILTER (base < 0.5 AND context >= 0.5) AS b FROM scores WHERE y = 1 GROUP BY 1, 2) SELECT host, label_id, a, b, CASE WHEN a + b > 0 THEN round(least(1, 2 * list_sum(list_transform(range(least(a, b) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))))), 6) END AS p FROM t")
def inf13(spark, sf):
    s = scores(spark, sf).where("y = 1")
    t = s.groupBy("host", "label_id").agg(F.count_if((F.col("base") >= 0.5) & (F.col("context") < 0.5)).alias("a"), F.count_if((F.col("base") < 0.5) & (F.col("context") >= 0.5)).alias("b"))
    return t.select("host", "label_id", "a", "b", R(resample.sign_test(F.col("a"), F.col("b"))).alias("p"))


@query("inf14_enrichment", TWO + " SELECT label_id, round(a / (a + b) - c / (c + d), 6) AS difference, round((a / (a + b)) / (c / (c + d)), 6) AS ratio, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS haldane, round(exp(ln(a * d / (b * c)::DOUBLE) - 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS low, round(exp(ln(a * d / (b * c)::DOUBLE) + 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS high FROM t")
def inf14(spark, sf):
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    odds, se = F.log(F.try_divide(a * d, b * c)), F.sqrt(F.try_divide(F.lit(1), a) + F.try_divide(F.lit(1), b) + F.try_divide(F.lit(1), c) + F.try_divide(F.lit(1), d))
    return two_by_two(spark, sf).select("label_id", R(F.try_divide(a, a + b) - F.try_divide(c, c + d)).alias("difference"), R(F.try_divide(F.try_divide(a, a + b), F.try_divide(c, c + d))).alias("ratio"), R((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))).alias("haldane"), R(F.exp(odds - 1.96 * se)).alias("low"), R(F.exp(odds + 1.96 * se)).alias("high"))


@query("inf15_paired_contingency", f"WITH {SCORES} SELECT label_id, count(*) FILTER (base >= 0.5 AND context >= 0.5) AS both, count(*) FILTER (base >= 0.5 AND context < 0.5) AS only_a, count(*) FILTER (base < 0.5 AND context >= 0.5) AS only_b, count(*) FILTER (base < 0.5 AND context < 0.5) AS neither FROM scores GROUP BY 1")
def inf15(spark, sf):
    a, b = F.col("base") >= 0.5, F.col("context") >= 0.5
    return scores(spark, sf).groupBy("label_id").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


@query("inf17_leave_one_family_out", K + ", f AS (SELECT family, sum(tp_a) AS ta, sum(fp_a) AS pa, sum(fn_a) AS na, sum(tp_b) AS tb, sum(fp_b) AS pb, sum(fn_b) AS nb FROM k GROUP BY 1), t AS (SELECT sum(ta) AS ta, sum(pa) AS pa, sum(na) AS na, sum(tb) AS tb, sum(pb) AS pb, sum(nb) AS nb FROM f) SELECT family, round(2.0 * (t.tb - f.tb) / (2 * (t.tb - f.tb) + t.pb - f.pb + t.nb - f.nb) - 2.0 * (t.ta - f.ta) / (2 * (t.ta - f.ta) + t.pa - f.pa + t.na - f.na), 6) AS delta_without FROM f, t")
def inf17(spark, sf):
    f = summed(counts(spark, sf), "family")
    total = f.agg(*(F.sum(c).alias(f"t_{c}") for c in f.columns[1:]))
    rest = f.join(total).select("family", *((F.col(f"t_{c}") - F.col(c)).alias(c) for c in f.columns[1:]))
    return rest.select("family", R(f1m("b") - f1m("a")).alias("delta_without"))


STRATA = "st AS (SELECT 'host' AS stratum, host AS value, * FROM sx UNION ALL SELECT 'family', family, * FROM sx UNION ALL SELECT 'length', len, * FROM sx UNION ALL SELECT 'all', 'all', * FROM sx)"
SUMS = ", ".join(f"sum({{w}}{c}) AS {c}" for c in ("tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b"))
EACH = ", ".join(f"count(*) FILTER ({h}) AS {n}_{m}" for m, c in (("a", "base"), ("b", "context")) for n, h in (("tp", f"{c} >= 0.5 AND y = 1"), ("fp", f"{c} >= 0.5 AND y = 0"), ("fn", f"{c} < 0.5 AND y = 1")))
DELTA = "2.0 * tp_b / nullif(2 * tp_b + fp_b + fn_b, 0) - 2.0 * tp_a / nullif(2 * tp_a + fp_a + fn_a, 0)"
SWAP = ", ".join(f"sum(CASE WHEN sw THEN {n}_{o} ELSE {n}_{m} END) AS {n}_{m}" for m, o in (("a", "b"), ("b", "a")) for n in ("tp", "fp", "fn"))


ATLAS = f"""WITH {SCORES}, sx AS (SELECT s.*, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS len, (s.item_id % 50)::VARCHAR AS blk FROM scores s JOIN items USING (item_id)), {STRATA},
kb AS (SELECT stratum, value, label_id, blk, count(*) AS n, {EACH} FROM st GROUP BY ALL),
ob AS (SELECT stratum, value, label_id, n, {DELTA} AS delta FROM (SELECT stratum, value, label_id, sum(n) AS n, {SUMS.format(w='')} FROM kb GROUP BY ALL)),
{draws_sql(DRAWS_IN_GROUP, block='blk', rows='sx')},
bt AS (SELECT stratum, value, label_id, iter, {DELTA} AS d FROM (SELECT stratum, value, label_id, iter, {SUMS.format(w='w * ')} FROM kb JOIN wt USING (blk) GROUP BY ALL)),
ci AS (SELECT stratum, value, label_id, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM bt GROUP BY ALL),
sw AS (SELECT stratum, value, label_id, iter, {SWAP} FROM (SELECT *, ('0x' || substr(md5('42|' || iter || '|' || blk), 1, 8))::UBIGINT % 2 = 1 AS sw FROM kb, (SELECT unnest(range({DRAWS_IN_GROUP})) AS iter)) GROUP BY ALL),
pv AS (SELECT stratum, value, label_id, round((count(*) FILTER (abs(coalesce(d, 0)) >= abs(coalesce(delta, 0)) - 1e-12) + 1) / ({DRAWS_IN_GROUP} + 1), 6) AS p FROM (SELECT stratum, value, label_id, {DELTA} AS d FROM sw) JOIN ob USING (stratum, value, label_id) GROUP BY stratum, value, label_id)
SELECT stratum, value, label_id, n, round(delta, 6) AS delta, low, high, p FROM ob LEFT JOIN ci USING (stratum, value, label_id) LEFT JOIN pv USING (stratum, value, label_id) WHERE n >= {LEAST}"""


@query("inf19_stratified_atlas", ATLAS)
def inf19(spark, sf):
    """F1 difference of two models for each label in each stratum of at least ``LEAST`` rows, with interval and swap test."""
    from corvane.plans.fixtures import items

    s = scores(spark, sf).join(items(spark, sf).select("item_id", F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("len")), "item_id")
    s = s.withColumn("blk", (F.col("item_id") % 50).cast("string"))
    strata = F.array(*(F.struct(F.lit(n).alias("stratum"), F.lit("all").alias("value") if n == "all" else F.col(c).alias("value")) for n, c in (("host", "host"), ("family", "family"), ("length", "len"), ("all", None))))
    t = resample.stratified_effects(s.withColumn("x", F.explode(strata)).select("*", "x.*"), ["stratum", "value", "label_id"], "blk", DRAWS_IN_GROUP).where(F.col("n") >= LEAST)
    return t.select("stratum", "value", "label_id", "n", *(R(c).alias(c) for c in ("delta", "low", "high", "p")))


@query("inf16_linear_regression")
def inf16(spark, sf):
    """Standardised least squares of price on quantity, discount, tax, day and status, with errors, t, p and R2."""
    from corvane.operators.regression import least_squares

    li = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), "l_quantity", "l_discount", "l_tax", F.datediff("l_shipdate", F.lit("1990-01-01")).cast("double").alias("day"), F.lit(1.0).alias("constant"), F.col("l_returnflag").alias("flag"))
    return least_squares(li, "y", ["l_quantity", "l_discount", "l_tax", "day", "constant"], ["flag"]).select("term", R("coefficient", 4).alias("coefficient"), R("error", 4).alias("error"), R("t", 3).alias("t"), R("p").alias("p"), R("r2").alias("r2"))
