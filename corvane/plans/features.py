"""Queries: ordered neighbourhoods and counts (order(), AGG12-17)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.operators import metrics, neighbours
from corvane.plans.fixtures import SCORES, scores
from corvane.plans.registry import query
from corvane.session import table

R = lambda c, n=6: F.round(c, n)
# genes of an order: coordinates from running quantities; every seventh part has unknown coordinates
SEQ = """raw AS (SELECT l_orderkey AS seq, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q, l_returnflag AS strand, l_linestatus AS kind, l_orderkey * 1000000000000 + l_linenumber * 100000000000 + (l_partkey * 1000 + l_suppkey % 1000) * 100 + l_quantity::BIGINT AS row_order,
coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM lineitem),
seqs AS (SELECT seq, row_order, l_partkey, q, strand, kind, CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE before + 1 END AS start, CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE before + q + l_suppkey % 5 END AS end_ FROM raw)"""
ORD = "(PARTITION BY seq ORDER BY (start <= 0), start, CASE WHEN end_ > 0 THEN end_ ELSE 1000000000000 END, row_order)"


def sequences(spark, sf):
    li = table(spark, sf, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("l_quantity").over(w), F.lit(0)).cast("bigint")
    unknown, q = F.col("l_partkey") % 7 == 0, F.col("l_quantity").cast("bigint")
    return li.select(
        F.col("l_orderkey").alias("seq"),
        (F.col("l_orderkey") * 1000000000000 + F.col("l_linenumber") * 100000000000 + (F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000) * 100 + q).alias("row_order"),
        "l_partkey", q.alias("q"), F.col("l_returnflag").alias("strand"), F.col("l_linestatus").alias("kind"),
        F.when(unknown, 0).otherwise(before + 1).alias("start"), F.when(unknown, 0).otherwise(before + q + F.col("l_suppkey") % 5).alias("end"),
    )


order = neighbours.sequence_window  # made on use: it needs a session


@query("win1_sequence_order", f"WITH {SEQ} SELECT seq, row_order, row_number() OVER w AS pos FROM seqs WINDOW w AS {ORD}")
def win1(spark, sf):
    return sequences(spark, sf).select("seq", "row_order", F.row_number().over(order()).alias("pos"))


@query("win2_neighbour_attributes", f"WITH {SEQ} SELECT seq, row_order, coalesce(lag(kind) OVER w, '__START__') AS prev, coalesce(lead(kind) OVER w, '__END__') AS next FROM seqs WINDOW w AS {ORD}")
def win2(spark, sf):
    return sequences(spark, sf).select("seq", "row_order", F.coalesce(F.lag("kind").over(order()), F.lit("__START__")).alias("prev"), F.coalesce(F.lead("kind").over(order()), F.lit("__END__")).alias("next"))


@query("win3_same_strand", f"WITH {SEQ} SELECT seq, row_order, coalesce(lag(strand) OVER w = strand, false) AS same_prev, lead(strand) OVER w IS NOT NULL AS has_next FROM seqs WINDOW w AS {ORD}")
def win3(spark, sf):
    return sequences(spark, sf).select("seq", "row_order", F.coalesce(F.lag("strand").over(order()) == F.col("strand"), F.lit(False)).alias("same_prev"), F.lead("strand").over(order()).isNotNull().alias("has_next"))


@query("win4_gaps_overlaps", f"WITH {SEQ}, p AS (SELECT *, lag(end_) OVER w AS pe, lead(start) OVER w AS ns FROM seqs WINDOW w AS {ORD}) SELECT seq, row_order, CASE WHEN pe > 0 AND start > 0 THEN greatest(0, start - pe - 1) ELSE 0 END AS gap_prev, CASE WHEN pe > 0 AND start > 0 THEN greatest(0, pe - start + 1) ELSE 0 END AS overlap_prev, CASE WHEN end_ > 0 AND ns > 0 THEN greatest(0, ns - end_ - 1) ELSE 0 END AS gap_next, round(ln(1 + CASE WHEN end_ > 0 AND ns > 0 THEN greatest(0, end_ - ns + 1) ELSE 0 END), 6) AS log_overlap_next FROM p")
def win4(spark, sf):
    g = neighbours.gaps(sequences(spark, sf), order())
    return g.select("seq", "row_order", "gap_prev", "overlap_prev", "gap_next", R(F.log1p("overlap_next")).alias("log_overlap_next"))


@query("win5_relative_position", f"WITH {SEQ} SELECT seq, row_order, round(CASE WHEN count(*) OVER (PARTITION BY seq) = 1 THEN 0 ELSE (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY seq) - 1)::DOUBLE END, 6) AS pos FROM seqs WINDOW w AS {ORD}")
def win5(spark, sf):
    n = F.count("*").over(W.partitionBy("seq")) - 1
    return sequences(spark, sf).select("seq", "row_order", R(F.coalesce(F.try_divide(F.row_number().over(order()) - 1, n), F.lit(0.0))).alias("pos"))


@query("win6_local_counts", f"WITH {SEQ} SELECT seq, row_order, sum((kind = 'O')::INT) OVER (PARTITION BY seq ORDER BY (start <= 0), start, CASE WHEN end_ > 0 THEN end_ ELSE 1000000000000 END, row_order ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - (kind = 'O')::INT AS n FROM seqs")
def win6(spark, sf):
    return sequences(spark, sf).select("seq", "row_order", neighbours.local_count(F.col("kind") == "O", order(), 2).alias("n"))


@query("win7_leave_one_out", f"WITH {SEQ} SELECT seq, row_order, round(greatest(sum((kind = 'O')::INT) OVER s - (kind = 'O')::INT, 0) / greatest(count(*) OVER s - 1, 1)::DOUBLE, 6) AS f FROM seqs WINDOW s AS (PARTITION BY seq)")
def win7(spark, sf):
    return sequences(spark, sf).select("seq", "row_order", R(neighbours.leave_one_out(F.col("kind") == "O", "seq")).alias("f"))


@query("win11_neighbour_text", f"WITH {SEQ}, r AS (SELECT *, row_number() OVER w AS k FROM seqs WINDOW w AS {ORD}) SELECT c.row_order AS centre, string_agg((n.k - c.k) || ':' || n.kind, ' | ' ORDER BY n.k) AS text FROM r c JOIN r n ON c.seq = n.seq AND abs(c.k - n.k) <= 2 GROUP BY 1")
def win11(spark, sf):
    s = sequences(spark, sf)
    near = neighbours.within(s, s, order(), "seq", "row_order", 2)
    t = near.groupBy("centre").agg(F.array_sort(F.collect_list(F.struct("offset", "kind"))).alias("l"))  # at most five rows
    return t.select("centre", F.concat_ws(" | ", F.transform("l", lambda x: F.concat(x["offset"].cast("string"), F.lit(":"), x["kind"]))).alias("text"))


@query("jn18_rank_neighbours", f"WITH {SEQ}, r AS (SELECT *, row_number() OVER w AS k FROM seqs WINDOW w AS {ORD}) SELECT c.row_order AS centre, n.row_order, n.k - c.k AS off FROM r c JOIN r n ON c.seq = n.seq AND abs(c.k - n.k) <= 3")
def jn18(spark, sf):
    s = sequences(spark, sf)
    return neighbours.within(s, s, order(), "seq", "row_order", 3).select("centre", "row_order", F.col("offset").alias("off"))


@query("win15_ranked_hits", "SELECT l_orderkey, l_partkey, k FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS k FROM lineitem) WHERE k <= 2")
def win15(spark, sf):
    k = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", k.alias("k")).where("k <= 2")


@query("agg13_overlap_density", f"WITH {SEQ}, p AS (SELECT *, lag(end_) OVER w AS pe FROM seqs WINDOW w AS {ORD}) SELECT seq, round(count(*) FILTER (pe > 0 AND start > 0 AND pe >= start) / nullif(count(*) FILTER (pe > 0 AND start > 0), 0), 6) AS density, round(sum(end_ - start + 1) FILTER (start > 0) / nullif(max(end_) FILTER (start > 0) - min(start) FILTER (start > 0) + 1, 0), 6) AS compression FROM p GROUP BY 1")
def agg13(spark, sf):
    p = sequences(spark, sf).withColumn("pe", F.lag("end").over(order()))
    ok, known = (F.col("pe") > 0) & (F.col("start") > 0), F.col("start") > 0
    only = lambda c: F.when(known, c)
    return p.groupBy("seq").agg(R(F.try_divide(F.count_if(ok & (F.col("pe") >= F.col("start"))), F.count_if(ok))).alias("density"), R(F.try_divide(F.sum(only(F.col("end") - F.col("start") + 1)), F.max(only(F.col("end"))) - F.min(only(F.col("start"))) + 1)).alias("compression"))


# ---- counts

K = f"WITH {SCORES}, k AS (SELECT family, label_id, count(*) FILTER (base >= 0.5 AND y = 1) AS tp_a, count(*) FILTER (base >= 0.5 AND y = 0) AS fp_a, count(*) FILTER (base < 0.5 AND y = 1) AS fn_a, count(*) FILTER (context >= 0.5 AND y = 1) AS tp_b, count(*) FILTER (context >= 0.5 AND y = 0) AS fp_b, count(*) FILTER (context < 0.5 AND y = 1) AS fn_b, count(*) AS n, sum(y) AS positives FROM scores GROUP BY 1, 2)"
F1 = lambda m: f"2.0 * sum(tp_{m}) / nullif(2 * sum(tp_{m}) + sum(fp_{m}) + sum(fn_{m}), 0)"


def counts(spark, sf, keys=("family", "label_id")):
    s = scores(spark, sf)
    hit = {m: F.col(c) >= 0.5 for m, c in (("a", "base"), ("b", "context"))}
    y = F.col("y") == 1
    each = [F.count_if(x).alias(f"{n}_{m}") for m, h in hit.items() for n, x in (("tp", h & y), ("fp", h & ~y), ("fn", ~h & y))]
    return s.groupBy(*keys).agg(*each, F.count("*").alias("n"), F.sum("y").alias("positives"))


def summed(df, *keys):
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b", "n", "positives")))


def f1m(m):
    return metrics.f1(f"tp_{m}", f"fp_{m}", f"fn_{m}")


@query("agg15_confusion_counts", K + " SELECT family, label_id, tp_b AS tp, fp_b AS fp, fn_b AS fn FROM k")
def agg15(spark, sf):
    return metrics.confusion(scores(spark, sf), ["family", "label_id"], "context")


@query("agg16_f1_from_counts", K + f" SELECT family, label_id, round({F1('a').replace('sum(', '(')}, 6) AS f1 FROM k")
def agg16(spark, sf):
    return counts(spark, sf).select("family", "label_id", R(f1m("a")).alias("f1"))


@query("agg17_micro_macro_scope", K + f" SELECT round(avg(f), 6) AS macro, (SELECT round({F1('a')}, 6) FROM k) AS micro FROM (SELECT label_id, {F1('a')} AS f FROM k GROUP BY 1)")
def agg17(spark, sf):
    k = counts(spark, sf, ("label_id",))
    return k.agg(R(F.avg(f1m("a"))).alias("macro"), R(F.try_divide(2.0 * F.sum("tp_a"), 2 * F.sum("tp_a") + F.sum("fp_a") + F.sum("fn_a"))).alias("micro"))


@query("agg35_seed_mean_sd", f"WITH {SCORES} SELECT label_id, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM (SELECT label_id, item_id % 3 AS seed, avg(base) AS m FROM scores GROUP BY 1, 2) GROUP BY 1")
def agg35(spark, sf):
    m = scores(spark, sf).groupBy("label_id", (F.col("item_id") % 3).alias("seed")).agg(F.avg("base").alias("m"))
    return m.groupBy("label_id").agg(R(F.avg("m")).alias("mean"), R(F.stddev_samp("m")).alias("sd"))


@query("agg34_label_deep_dive", f"WITH {SCORES} SELECT label_id, sum(y) AS positives, count(DISTINCT family) FILTER (y = 1) AS families, count(*) FILTER (base >= 0.5) AS predicted, count(*) FILTER (base >= 0.5 AND y = 1) AS hit, count(*) FILTER (base >= 0.5 AND y = 0) AS wrong FROM scores GROUP BY 1")
def agg34(spark, sf):
    over, y = F.col("base") >= 0.5, F.col("y") == 1
    return scores(spark, sf).groupBy("label_id").agg(F.sum("y").alias("positives"), F.count_distinct(F.when(y, F.col("family"))).alias("families"), F.count_if(over).alias("predicted"), F.count_if(over & y).alias("hit"), F.count_if(over & ~y).alias("wrong"))
