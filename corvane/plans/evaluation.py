"""Queries: submissions, metrics, thresholds and rankings (VAL, MET, WIN12-16, SET, JOB7, JOB8)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.scalar import group_split
from corvane.operators import metrics, validate
from corvane.plans.fixtures import ITEMS, SCORES, SPLIT_ITEMS, TRUTH, items, scores, split_sql, truth
from corvane.plans.registry import query

R = lambda c, n=6: F.round(c, n)
LONG = f"WITH {SCORES}, long AS (SELECT item_id, label_id, y, context AS score, family, host, base, context FROM scores)"
CURVE = """, pt AS (SELECT label_id, score, count(*) AS n, sum(y) AS tp FROM long GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct, sum(tp) OVER (PARTITION BY label_id) AS p FROM pt WINDOW w AS (PARTITION BY label_id ORDER BY score DESC))"""
FLAT = """, pt AS (SELECT score, count(*) AS n, sum(y) AS tp FROM long GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct, sum(tp) OVER () AS p FROM pt WINDOW w AS (ORDER BY score DESC))"""
COUNTS = ", k AS (SELECT label_id, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn FROM long GROUP BY 1)"


def long(spark, sf):
    return scores(spark, sf).withColumn("score", F.col("context"))


@query("met1_average_precision", LONG + CURVE + "SELECT label_id, max(p) AS positives, round(sum(tp * ct / cn) / max(p), 6) AS ap FROM c GROUP BY 1")
def met1(spark, sf):
    return metrics.average_precision(long(spark, sf), ["label_id"]).select("label_id", "positives", R("ap").alias("ap"))


@query("met2_average_precision_by_row", LONG + "SELECT label_id, round(sum(y * ct / cn) / sum(y), 6) AS ap FROM (SELECT label_id, y, sum(y) OVER w AS ct, row_number() OVER w AS cn FROM long WINDOW w AS (PARTITION BY label_id ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1")
def met2(spark, sf):
    return metrics.average_precision_by_row(long(spark, sf), ["label_id"], [F.col("item_id")]).select("label_id", R("ap").alias("ap"))


@query("met3_weighted_average_precision", LONG + "SELECT label_id, round(sum(w * y * ct / cn) / sum(w * y), 6) AS ap FROM (SELECT label_id, y, w, sum(w * y) OVER q AS ct, sum(w) OVER q AS cn FROM (SELECT *, 1 + item_id % 3 AS w FROM long) WINDOW q AS (PARTITION BY label_id ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1")
def met3(spark, sf):
    df = long(spark, sf).withColumn("w", 1.0 + F.col("item_id") % 3)
    return metrics.average_precision_by_row(df, ["label_id"], [F.col("item_id")], weight="w").select("label_id", R("ap").alias("ap"))


@query("met4_macro_micro_ap", LONG + CURVE.replace("pt AS", "lpt AS").replace("FROM pt", "FROM lpt").replace("c AS (", "lc AS (") + FLAT + "SELECT (SELECT round(avg(ap), 6) FROM (SELECT sum(tp * ct / cn) / nullif(max(p), 0) AS ap FROM lc GROUP BY label_id)) AS macro_ap, round(sum(tp * ct / cn) / max(p), 6) AS micro_ap FROM c")
def met4(spark, sf):
    return metrics.macro_micro(long(spark, sf)).select(R("macro_ap").alias("macro_ap"), R("micro_ap").alias("micro_ap"))


@query("met5_f1_at_threshold", LONG + COUNTS + "SELECT round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM k")
def met5(spark, sf):
    return metrics.macro_micro(long(spark, sf)).select(R("macro_f1").alias("macro_f1"), R("micro_f1").alias("micro_f1"))


@query("met6_per_label_metrics", LONG + CURVE + ", th AS (SELECT label_id, CASE label_id WHEN 'toxic' THEN 0.45 ELSE 0.6 END AS t FROM (SELECT DISTINCT label_id FROM long)), k AS (SELECT label_id, sum(y) AS support, count(*) FILTER (score >= t AND y = 1) AS tp, count(*) FILTER (score >= t) AS n FROM long JOIN th USING (label_id) GROUP BY 1), a AS (SELECT label_id, sum(tp * ct / cn) / max(p) AS ap FROM c GROUP BY 1) SELECT label_id, support, round(ap, 6) AS ap, round(2.0 * tp / (n + support), 6) AS f1, round(tp / n, 6) AS precision, round(tp / support, 6) AS recall FROM k JOIN a USING (label_id)")
def met6(spark, sf):
    df = long(spark, sf)
    t = F.when(F.col("label_id") == "toxic", 0.45).otherwise(0.6)
    k = df.groupBy("label_id").agg(F.sum("y").alias("support"), F.count_if((F.col("score") >= t) & (F.col("y") == 1)).alias("tp"), F.count_if(F.col("score") >= t).alias("n"))
    k = k.join(metrics.average_precision(df, ["label_id"]).select("label_id", "ap"), "label_id")
    return k.select("label_id", "support", R("ap").alias("ap"), R(2.0 * F.col("tp") / (F.col("n") + F.col("support"))).alias("f1"), R(F.col("tp") / F.col("n")).alias("precision"), R(F.col("tp") / F.col("support")).alias("recall"))


@query("met7_fmax", LONG + CURVE + "SELECT label_id, round(max(2.0 * ct / (cn + p)), 6) AS fmax, max_by(score, struct_pack(a := 2.0 * ct / (cn + p), b := score)) AS threshold FROM c GROUP BY 1")
def met7(spark, sf):
    return metrics.fmax(long(spark, sf), ["label_id"]).select("label_id", R("fmax").alias("fmax"), "threshold")


GRID = [0.1 + 0.05 * k for k in range(17)]


@query("met9_grid_threshold", LONG + ", g AS (SELECT label_id, t / 100.0 AS t, coalesce(2.0 * count(*) FILTER (score >= t / 100.0 AND y = 1) / nullif(count(*) FILTER (score >= t / 100.0) + sum(y), 0), 0) AS f FROM long CROSS JOIN (SELECT unnest(range(10, 91, 5)) AS t) GROUP BY ALL) SELECT label_id, min_by(t, struct_pack(a := -f, b := t)) AS threshold, round(max(f), 6) AS f1 FROM g GROUP BY 1")
def met9(spark, sf):
    return metrics.grid_threshold(long(spark, sf), ["label_id"], [round(t, 2) for t in GRID]).select("label_id", "threshold", R("f1").alias("f1"))


@query("met10_best_f1_threshold", LONG + FLAT + "SELECT round(max(2.0 * ct / (cn + p)), 6) AS f1, max_by(score, struct_pack(a := 2.0 * ct / (cn + p), b := score)) AS threshold FROM c")
def met10(spark, sf):
    return metrics.fmax(long(spark, sf), []).select(R("fmax").alias("f1"), "threshold")


@query("met11_precision_target", LONG + CURVE + "SELECT label_id, coalesce(min(score) FILTER (ct / cn >= 0.9), 1.0) AS threshold, round(coalesce(min_by(ct / cn, score) FILTER (ct / cn >= 0.9), 0.0), 6) AS precision FROM c GROUP BY 1")
def met11(spark, sf):
    return metrics.precision_threshold(long(spark, sf), ["label_id"], 0.9).select("label_id", "threshold", R("precision").alias("precision"))


TOPS = LONG + ", tops AS (SELECT item_id, max_by(label_id, struct_pack(a := score, b := label_id)) AS label_id, max(score) AS top, max_by(y, struct_pack(a := score, b := label_id)) AS y FROM long GROUP BY 1)"


def tops(spark, sf):
    best = F.struct("score", "label_id")
    return long(spark, sf).groupBy("item_id").agg(F.max_by("label_id", best).alias("label_id"), F.max("score").alias("top"), F.max_by("y", best).alias("y"))


@query("met13_gate", TOPS + ", l AS (SELECT item_id, list_sort(list(label_id) FILTER (score >= 0.6)) AS over FROM long GROUP BY 1) SELECT item_id, label_id AS top_label, top >= 0.7 AS passes, coalesce(array_to_string(over, ';'), '') AS over FROM tops JOIN l USING (item_id)")
def met13(spark, sf):
    over = long(spark, sf).groupBy("item_id").agg(F.concat_ws(";", F.array_sort(F.collect_list(F.when(F.col("score") >= 0.6, F.col("label_id"))))).alias("over"))
    return tops(spark, sf).join(over, "item_id").select("item_id", F.col("label_id").alias("top_label"), (F.col("top") >= 0.7).alias("passes"), "over")


AP2 = """, u AS (SELECT 'base' AS model, label_id, base AS score, y FROM scores UNION ALL SELECT 'context', label_id, context, y FROM scores),
pt AS (SELECT model, label_id, score, count(*) AS n, sum(y) AS tp FROM u GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct FROM pt WINDOW w AS (PARTITION BY model, label_id ORDER BY score DESC)),
ap AS (SELECT model, label_id, sum(tp * ct / cn) / sum(tp) AS ap FROM c GROUP BY 1, 2)"""


def both(spark, sf):
    return scores(spark, sf).unpivot(["item_id", "label_id", "y", "family", "host"], ["base", "context"], "model", "score")


@query("met24_scored_table_macro_ap", LONG + CURVE + "SELECT round(avg(ap), 6) AS macro_ap FROM (SELECT sum(tp * ct / cn) / nullif(sum(tp), 0) AS ap FROM c GROUP BY label_id)")
def met24(spark, sf):
    return metrics.average_precision(long(spark, sf), ["label_id"]).agg(R(F.avg("ap")).alias("macro_ap"))


@query("win12_ranked_curve", LONG + "SELECT label_id, rank, score, round(tp / rank, 6) AS precision, round(tp / p, 6) AS recall FROM (SELECT label_id, score, row_number() OVER w AS rank, sum(y) OVER w AS tp, sum(y) OVER (PARTITION BY label_id) AS p FROM long WINDOW w AS (PARTITION BY label_id ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING)) WHERE rank <= 1000 OR rank % 100 = 0")
def win12(spark, sf):
    w = W.partitionBy("label_id").orderBy(F.desc("score"), "item_id").rowsBetween(W.unboundedPreceding, 0)
    df = long(spark, sf).withColumn("rank", F.row_number().over(W.partitionBy("label_id").orderBy(F.desc("score"), "item_id"))).withColumn("tp", F.sum("y").over(w)).withColumn("p", F.sum("y").over(W.partitionBy("label_id")))
    return df.where("rank <= 1000 or rank % 100 = 0").select("label_id", "rank", "score", R(F.col("tp") / F.col("rank")).alias("precision"), R(F.col("tp") / F.col("p")).alias("recall"))


@query("win13_threshold_curve", LONG + CURVE + "SELECT label_id, score, round(ct / cn, 6) AS precision, round(ct / p, 6) AS recall FROM c")
def win13(spark, sf):
    c = metrics.curve(long(spark, sf), ["label_id"])
    p = c.groupBy("label_id").agg(F.sum("tp").alias("p"))
    return c.join(p, "label_id").select("label_id", "score", R(F.col("cum_tp") / F.col("cum_n")).alias("precision"), R(F.col("cum_tp") / F.col("p")).alias("recall"))


@query("win14_leaderboard", f"WITH {SCORES}" + AP2 + ", m AS (SELECT model, avg(ap) AS macro_ap FROM ap GROUP BY 1) SELECT model, round(macro_ap, 6) AS macro_ap, row_number() OVER (ORDER BY macro_ap DESC NULLS LAST, model) AS rank FROM m")
def win14(spark, sf):
    m = metrics.average_precision(both(spark, sf), ["model", "label_id"]).groupBy("model").agg(F.avg("ap").alias("macro_ap"))
    return m.select("model", R("macro_ap").alias("macro_ap"), F.row_number().over(W.orderBy(F.desc_nulls_last("macro_ap"), "model")).alias("rank"))


@query("job8_leaderboard_many", f"""WITH {SCORES}, u AS (SELECT s, host, {split_sql(42, 'family', 'family')} AS split, label_id, y, floor(100 * ((1 - s / 4.0) * base + s / 4.0 * context) + 0.001) / 100 AS score FROM scores CROSS JOIN (SELECT unnest(range(5)) AS s)),
pt AS (SELECT s, host, split, label_id, score, count(*) AS n, sum(y) AS tp FROM u GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct FROM pt WINDOW w AS (PARTITION BY s, host, split, label_id ORDER BY score DESC)),
ma AS (SELECT s, host, split, avg(ap) AS macro_ap FROM (SELECT s, host, split, label_id, sum(tp * ct / cn) / nullif(sum(tp), 0) AS ap FROM c GROUP BY ALL) GROUP BY ALL),
pm AS (SELECT s, host, split, score, sum(n) AS n, sum(tp) AS tp FROM pt GROUP BY ALL), cm AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct FROM pm WINDOW w AS (PARTITION BY s, host, split ORDER BY score DESC)), mi AS (SELECT s, host, split, sum(tp * ct / cn) / nullif(sum(tp), 0) AS micro_ap FROM cm GROUP BY ALL),
k AS (SELECT s, host, split, label_id, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn FROM u GROUP BY ALL),
f AS (SELECT s, host, split, avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro_f1, 2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) AS micro_f1 FROM k GROUP BY ALL)
SELECT s AS submission, host AS track, split, round(macro_ap, 6) AS macro_ap, round(micro_ap, 6) AS micro_ap, round(macro_f1, 6) AS macro_f1, round(micro_f1, 6) AS micro_f1, row_number() OVER (PARTITION BY host, split ORDER BY round(macro_ap, 9) DESC NULLS LAST, s) AS rank FROM ma JOIN mi USING (s, host, split) JOIN f USING (s, host, split)""")
def job8(spark, sf):
    """Five submissions with all metrics, ranked in each track and split."""
    s = F.col("submission")
    df = scores(spark, sf).withColumn("submission", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))).withColumn("split", group_split(42, "family", "family"))
    df = df.withColumn("score", F.floor(100 * ((1 - s / 4.0) * F.col("base") + s / 4.0 * F.col("context")) + 0.001) / 100)
    m = metrics.four_metrics(df, ["submission", "host", "split"])
    rank = F.row_number().over(W.partitionBy("host", "split").orderBy(F.desc_nulls_last(F.round("macro_ap", 9)), "submission"))
    return m.select("submission", F.col("host").alias("track"), "split", *(R(c).alias(c) for c in ("macro_ap", "micro_ap", "macro_f1", "micro_f1")), rank.alias("rank"))


@query("win16_top_two", LONG + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, label_id) AS k FROM long) SELECT item_id, max(label_id) FILTER (k = 1) AS first, coalesce(max(label_id) FILTER (k = 2), max(label_id) FILTER (k = 1)) AS second, round(max(score) FILTER (k = 1) - coalesce(max(score) FILTER (k = 2), max(score) FILTER (k = 1)), 6) AS margin FROM r GROUP BY 1")
def win16(spark, sf):
    k = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "label_id"))
    at = lambda c, n: F.max(F.when(F.col("k") == n, F.col(c)))
    r = long(spark, sf).withColumn("k", k).groupBy("item_id")
    return r.agg(at("label_id", 1).alias("first"), F.coalesce(at("label_id", 2), at("label_id", 1)).alias("second"), R(at("score", 1) - F.coalesce(at("score", 2), at("score", 1))).alias("margin"))


# a submission with every kind of bad row, made from the scores
SUBMISSION = f"""WITH {SCORES}, sub AS (SELECT CASE WHEN item_id % 97 = 3 THEN item_id + 10000000 ELSE item_id END AS item_id, CASE WHEN item_id % 89 = 4 THEN 'other' ELSE label_id END AS label_id,
CASE WHEN item_id % 83 = 5 THEN 'x' WHEN item_id % 79 = 6 THEN 'NaN' WHEN item_id % 73 = 7 THEN '1.01' ELSE context::VARCHAR END AS score, item_id AS row_order FROM scores
UNION ALL SELECT item_id, label_id, context::VARCHAR, 100000000 + item_id FROM scores WHERE item_id % 71 = 8),
st AS (SELECT s.*, CASE WHEN i.item_id IS NULL THEN 'unknown_item' WHEN s.label_id NOT IN ('quality', 'toxic') THEN 'unknown_label' WHEN try_cast(s.score AS DOUBLE) IS NULL THEN 'not_numeric' WHEN NOT isfinite(try_cast(s.score AS DOUBLE)) THEN 'not_finite' WHEN try_cast(s.score AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'out_of_range' END AS bad FROM sub s LEFT JOIN (SELECT DISTINCT item_id FROM truth) i USING (item_id)),
v AS (SELECT *, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY item_id, label_id, bad IS NULL ORDER BY row_order) > 1 THEN 'duplicate' ELSE 'ok' END) AS status FROM st)"""


def submission(spark, sf):
    i, s = F.col("item_id"), scores(spark, sf)
    main = s.select(
        F.when(i % 97 == 3, i + 10000000).otherwise(i).alias("item_id"),
        F.when(i % 89 == 4, "other").otherwise(F.col("label_id")).alias("label_id"),
        F.when(i % 83 == 5, "x").when(i % 79 == 6, "NaN").when(i % 73 == 7, "1.01").otherwise(F.col("context").cast("string")).alias("score"),
        i.alias("row_order"),
    )
    return main.union(s.where(i % 71 == 8).select("item_id", "label_id", F.col("context").cast("string"), i + 100000000))


def checked(spark, sf):
    t = truth(spark, sf)
    return validate.check_rows(submission(spark, sf), t, t)


@query("val2_row_checks", SUBMISSION + "SELECT status, count(*) AS n FROM v GROUP BY 1")
def val2(spark, sf):
    return checked(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("val3_missing_pairs", SUBMISSION + ", g AS (SELECT item_id, label_id, max(score::DOUBLE) AS score FROM v WHERE status = 'ok' GROUP BY ALL) SELECT item_id, label_id, coalesce(score, 0) AS score, score IS NULL AS missing FROM truth LEFT JOIN g USING (item_id, label_id)")
def val3(spark, sf):
    t = truth(spark, sf)
    return validate.complete_grid(checked(spark, sf), t, t)


@query("val5_split_filter", f"WITH {SPLIT_ITEMS} SELECT item_id, family FROM split_items WHERE lower(split) IN ('test', '2', 'heldout')")
def val5(spark, sf):
    from corvane.functions.scalar import group_split

    df = items(spark, sf).withColumn("split", group_split(42, "family", "family"))
    return df.where(F.lower("split").isin("test", "2", "heldout")).select("item_id", "family")


@query("val6_policy_check", "SELECT DISTINCT lower(lang) AS track, source AS feature, CASE WHEN source IN ('src0', 'src3', 'src5') THEN 'forbidden' ELSE 'unrecognised' END AS problem FROM documents WHERE source NOT IN ('src1', 'src2', 'src4', 'src6', 'src7', 'src8')")
def val6(spark, sf):
    used = items(spark, sf).select(F.lower("host").alias("track"), F.col("family").alias("feature")).distinct()
    rules = [(f"src{k}", "forbidden" if k in (0, 3, 5) else "allowed") for k in range(9)]
    policy = used.select("track").distinct().join(F.broadcast(spark.createDataFrame(rules, "feature string, rule string")))
    return validate.policy_conflicts(used, policy)


@query("val7_split_conflicts", "SELECT source AS family, count(DISTINCT lang) AS splits, count(*) FILTER (lang NOT IN ('en', 'fr')) AS foreign FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1 OR count(*) FILTER (lang NOT IN ('en', 'fr')) > 0")
def val7(spark, sf):
    return validate.split_conflicts(items(spark, sf), "family", "host", ("en", "fr"))


@query("jn10_dense_grid", f"WITH {ITEMS} SELECT host, l.label_id, count(*) AS n FROM items CROSS JOIN (SELECT unnest(['quality', 'toxic']) AS label_id) l GROUP BY ALL")
def jn10(spark, sf):
    labels = F.explode(F.array(F.lit("quality"), F.lit("toxic")))  # a fixed list: no join
    return items(spark, sf).select("host", labels.alias("label_id")).groupBy("host", "label_id").agg(F.count("*").alias("n"))


@query("set3_unknown_examples", SUBMISSION + "SELECT status, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id))[1:5], ',') AS examples FROM v WHERE status LIKE 'unknown%' GROUP BY 1")
def set3(spark, sf):
    bad = checked(spark, sf).where("status like 'unknown%'").select("status", "item_id").distinct()
    few = bad.withColumn("k", F.row_number().over(W.partitionBy("status").orderBy("item_id"))).groupBy("status")
    return few.agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("item_id"))))).alias("examples"))


@query("set5_label_sets", LONG + ", s AS (SELECT item_id, list(label_id) FILTER (y = 1) AS t, list(label_id) FILTER (score >= 0.5) AS p FROM long GROUP BY 1) SELECT item_id, len(list_intersect(coalesce(t, []), coalesce(p, []))) AS hit, len(list_filter(coalesce(p, []), lambda x: NOT list_contains(coalesce(t, []), x))) AS extra, len(list_filter(coalesce(t, []), lambda x: NOT list_contains(coalesce(p, []), x))) AS missed FROM s")
def set5(spark, sf):
    s = long(spark, sf).groupBy("item_id").agg(F.collect_list(F.when(F.col("y") == 1, F.col("label_id"))).alias("t"), F.collect_list(F.when(F.col("score") >= 0.5, F.col("label_id"))).alias("p"))
    return s.select("item_id", F.size(F.array_intersect("t", "p")).alias("hit"), F.size(F.array_except("p", "t")).alias("extra"), F.size(F.array_except("t", "p")).alias("missed"))


@query("top4_true_and_false_positives", LONG + "SELECT label_id, y, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label_id, y ORDER BY score DESC, item_id) AS k FROM long WHERE score >= 0.5) WHERE k <= 20")
def top4(spark, sf):
    k = F.row_number().over(W.partitionBy("label_id", "y").orderBy(F.desc("score"), "item_id"))
    return long(spark, sf).where("score >= 0.5").withColumn("k", k).where("k <= 20").select("label_id", "y", "item_id", "score")
