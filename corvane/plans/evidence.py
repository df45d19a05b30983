"""Queries: hit tables, evidence fusion, regimes, modules, rankings (EV, TOP, MET17-21, AGG19-36, JN8-21)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions import scalar as S
from corvane.operators import metrics
from corvane.operators.evidence import top_hit
from corvane.plans.fixtures import SCORES, SPLIT_ITEMS, TRUTH, items, scores, truth
from corvane.plans.registry import query
from corvane.plans.tables import HITS, hits, split_items
from corvane.session import table

R = lambda c, n=6: F.round(c, n)
TOP = f"WITH {HITS}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, pident DESC NULLS LAST, row_order) AS k FROM hits) WHERE k = 1)"


def tops(spark, sf):
    return top_hit(hits(spark, sf))


@query("agg21_landscape", TOP + " SELECT CASE WHEN pident IS NULL THEN 'missing' WHEN pident < 30 THEN 'lt_30' WHEN pident < 60 THEN '30_60' ELSE 'ge_60' END AS identity, CASE WHEN bits < 20000 THEN 'lt_20000' WHEN bits < 40000 THEN '20000_40000' ELSE 'ge_40000' END AS strength, count(*) AS n, round(avg(qcov), 6) AS cover FROM top GROUP BY 1, 2")
def agg21(spark, sf):
    return tops(spark, sf).groupBy(S.bins("pident", [30, 60]).alias("identity"), S.bins("bits", [20000, 40000]).alias("strength")).agg(F.count("*").alias("n"), R(F.avg("qcov")).alias("cover"))


@query("agg24_cluster_rollup", "WITH s AS (SELECT source AS cluster, lang, count(*) AS n FROM documents GROUP BY 1, 2), a AS (SELECT source AS cluster, count(*) AS size, count(DISTINCT lang) AS kinds, avg(n_chars) AS mean FROM documents GROUP BY 1) SELECT cluster, size, kinds, round(mean, 4) AS mean, max_by(lang, struct_pack(a := n, b := lang)) AS signature, round(max(n) / max(size), 6) AS share FROM a JOIN s USING (cluster) GROUP BY cluster, size, kinds, mean")
def agg24(spark, sf):
    s = table(spark, sf, "documents").groupBy(F.col("source").alias("cluster"), "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    best = F.max_by("lang", F.struct("n", "lang")).alias("signature")
    return s.groupBy("cluster").agg(F.sum("n").alias("size"), F.count("*").alias("kinds"), R(F.sum("c") / F.sum("n"), 4).alias("mean"), best, R(F.max("n") / F.sum("n")).alias("share"))


@query("agg25_weighted_cluster_metrics", "WITH c AS (SELECT label, count(*) AS n, avg(embedding[1]::DOUBLE) AS m FROM embeddings WHERE label <> 0 GROUP BY 1) SELECT count(*) AS clusters, round(sum(n * m) / sum(n), 6) AS weighted FROM c")
def agg25(spark, sf):
    c = table(spark, sf, "embeddings").where("label <> 0").groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("embedding")[0].cast("double")).alias("m"))
    return c.agg(F.count("*").alias("clusters"), R(F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("weighted"))


@query("agg27_gate_precision", f"WITH {SCORES} SELECT label_id, count(*) FILTER (context >= 0.6) AS gated, round(avg(y) FILTER (context >= 0.6), 6) AS precision, CASE WHEN count(*) FILTER (context >= 0.6) >= 100 THEN 'high' ELSE 'low' END AS tier FROM scores GROUP BY 1")
def agg27(spark, sf):
    g = F.col("context") >= 0.6
    return scores(spark, sf).groupBy("label_id").agg(F.count_if(g).alias("gated"), R(F.avg(F.when(g, F.col("y")))).alias("precision"), F.when(F.count_if(g) >= 100, "high").otherwise("low").alias("tier"))


@query("agg30_best_representative", "SELECT p_brand, count(*) AS n, max_by(p_partkey, struct_pack(a := p_retailprice, b := -p_partkey)) AS best, count(*) FILTER (p_size >= 40) AS strong FROM part GROUP BY 1")
def agg30(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("best"), F.count_if(F.col("p_size") >= 40).alias("strong"))


@query("agg32_label_frequency_filter", f"WITH {TRUTH}, c AS (SELECT label_id, sum(y) AS n FROM truth GROUP BY 1) SELECT label_id, n FROM c WHERE n >= 100 OR (n > 0 AND NOT EXISTS (SELECT 1 FROM c WHERE n >= 100))")
def agg32(spark, sf):
    c = truth(spark, sf).groupBy("label_id").agg(F.sum("y").alias("n"))
    any_ = c.agg(F.bool_or(F.col("n") >= 100).alias("any"))
    return c.join(any_).where("n >= 100 or (n > 0 and not any)").select("label_id", "n")


VOTES = f"WITH {SPLIT_ITEMS}, {TRUTH}, x AS (SELECT t.item_id, label_id, y, item_split, md5(text) AS h, left(md5(left(text, 20)), 3) AS sk FROM truth t JOIN split_items USING (item_id)), a AS (SELECT h, label_id, avg(y) AS v FROM x WHERE item_split = 'train' GROUP BY 1, 2), b AS (SELECT sk, label_id, avg(y) AS v FROM x WHERE item_split = 'train' GROUP BY 1, 2), s AS (SELECT item_id, label_id, y, coalesce(a.v, b.v, 0) AS score, a.v IS NOT NULL AS exact FROM x LEFT JOIN a USING (h, label_id) LEFT JOIN b USING (sk, label_id) WHERE item_split = 'test')"


def votes(spark, sf):
    h = F.md5(F.col("text").cast("binary"))
    sk = F.left(F.md5(F.left("text", F.lit(20)).cast("binary")), F.lit(3))
    x = truth(spark, sf).join(split_items(spark, sf).select("item_id", "item_split", h.alias("h"), sk.alias("sk")), "item_id")
    tr = x.where("item_split = 'train'")
    a, b = (tr.groupBy(k, "label_id").agg(F.avg("y").alias(n)) for k, n in (("h", "va"), ("sk", "vb")))
    j = x.where("item_split = 'test'").join(a, ["h", "label_id"], "left").join(b, ["sk", "label_id"], "left")
    return j.select("item_id", "label_id", "y", F.coalesce("va", "vb", F.lit(0.0)).alias("score"), F.col("va").isNotNull().alias("exact"), (F.col("va").isNull() & F.col("vb").isNotNull()).alias("sketch"))


@query("jn8_vote_scores", VOTES + " SELECT item_id, label_id, round(score, 6) AS score FROM s")
def jn8(spark, sf):
    return votes(spark, sf).select("item_id", "label_id", R("score").alias("score"))


@query("met18_precision_at_identity", TOP + " SELECT cut, count(*) FILTER (pident >= cut) AS kept, round(avg((label = 'N')::INT) FILTER (pident >= cut), 6) AS precision FROM top, (SELECT unnest([30, 50, 70, 90, 100]) AS cut) GROUP BY 1")
def met18(spark, sf):
    x = tops(spark, sf).select("pident", "label", F.explode(F.array(*map(F.lit, (30, 50, 70, 90, 100)))).alias("cut"))
    over = F.col("pident") >= F.col("cut")
    return x.groupBy("cut").agg(F.count_if(over).alias("kept"), R(F.avg(F.when(over, (F.col("label") == "N").cast("int")))).alias("precision"))


@query("met21_definition_sensitivity", f"WITH {SCORES}, f AS (SELECT m AS model, label_id, y, CASE m WHEN 'base' THEN base ELSE context END AS score, regexp_matches(text, 'License') AS syn, n_chars < 400 AS amb FROM scores JOIN items USING (item_id), (SELECT unnest(['base', 'context']) AS m)), u AS (SELECT 'plain' AS c, * FROM f UNION ALL SELECT 'expanded', model, label_id, greatest(y, syn::INT), score, syn, amb FROM f UNION ALL SELECT 'no_synonyms', * FROM f WHERE NOT (y = 0 AND syn) UNION ALL SELECT 'no_ambiguous', * FROM f WHERE NOT (y = 0 AND amb)), pt AS (SELECT c, model, label_id, score, count(*) AS n, sum(y) AS tp FROM u GROUP BY ALL), k AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct FROM pt WINDOW w AS (PARTITION BY c, model, label_id ORDER BY score DESC)) SELECT c AS condition, model, label_id, sum(tp) AS positives, round(sum(tp * ct / cn) / nullif(sum(tp), 0), 6) AS ap FROM k GROUP BY 1, 2, 3")
def met21(spark, sf):
    f = scores(spark, sf).join(items(spark, sf).select("item_id", F.col("text").rlike("License").alias("syn"), (F.col("n_chars") < 400).alias("amb")), "item_id")
    keep = F.array_compact(F.array(F.lit("plain"), F.lit("expanded"), F.when(~((F.col("y") == 0) & F.col("syn")), "no_synonyms"), F.when(~((F.col("y") == 0) & F.col("amb")), "no_ambiguous")))
    u = f.select("label_id", "y", "syn", "base", "context", F.explode(keep).alias("condition")).unpivot(["label_id", "y", "syn", "condition"], ["base", "context"], "model", "score")
    u = u.withColumn("y", F.when(F.col("condition") == "expanded", F.greatest("y", F.col("syn").cast("int"))).otherwise(F.col("y")))
    return metrics.average_precision(u, ["condition", "model", "label_id"]).select("condition", "model", "label_id", "positives", R("ap").alias("ap"))


# ---- evidence


@query("ev1_exact_transfer_reasons", f"WITH {SPLIT_ITEMS}, t AS (SELECT md5(text) AS h, count(*) AS n, list(DISTINCT family) AS f, list(DISTINCT host) AS g FROM split_items WHERE item_split = 'train' GROUP BY 1), x AS (SELECT item_id, NOT list_contains(f, family) AS a, list_contains(g, host) AS b, regexp_matches(text, 'License') AS c, n > 1 AS d FROM split_items JOIN t ON md5(text) = h WHERE item_split = 'test') SELECT item_id, CASE WHEN a OR b OR c OR d THEN concat_ws(',', CASE WHEN a THEN 'cross_family' END, CASE WHEN b THEN 'same_host' END, CASE WHEN c THEN 'boilerplate' END, CASE WHEN d THEN 'duplicated' END) ELSE 'unclassified' END AS reasons FROM x")
def ev1(spark, sf):
    s = split_items(spark, sf).withColumn("h", F.md5(F.col("text").cast("binary")))
    t = s.where("item_split = 'train'").groupBy("h").agg(F.count("*").alias("n"), F.collect_set("family").alias("f"), F.collect_set("host").alias("g"))
    x = s.where("item_split = 'test'").join(t, "h")
    tags = F.array_compact(F.array(F.when(~F.array_contains("f", F.col("family")), "cross_family"), F.when(F.array_contains("g", F.col("host")), "same_host"), F.when(F.col("text").rlike("License"), "boilerplate"), F.when(F.col("n") > 1, "duplicated")))
    return x.select("item_id", F.when(F.size(tags) == 0, "unclassified").otherwise(F.concat_ws(",", tags)).alias("reasons"))


@query("ev2_sequence_status", TOP + " SELECT query, CASE WHEN pident IS NULL THEN 'no_hit' WHEN pident >= 90 THEN 'near_identical' WHEN pident >= 60 THEN 'close' WHEN pident >= 30 THEN 'remote' ELSE 'weak' END || CASE WHEN label = 'N' THEN '_agrees' ELSE '_differs' END AS status FROM top")
def ev2(spark, sf):
    p = F.col("pident")
    tier = F.when(p.isNull(), "no_hit").when(p >= 90, "near_identical").when(p >= 60, "close").when(p >= 30, "remote").otherwise("weak")
    return tops(spark, sf).select("query", F.concat(tier, F.when(F.col("label") == "N", "_agrees").otherwise("_differs")).alias("status"))


@query("ev3_structure_tier", "SELECT p_partkey, CASE WHEN p_size >= 40 AND p_retailprice >= 1500 THEN 'strong' WHEN p_size >= 40 THEN 'moderate' WHEN p_retailprice >= 1500 THEN 'weak' WHEN p_size < 5 THEN 'failed' ELSE 'none' END AS tier FROM part")
def ev3(spark, sf):
    big, dear = F.col("p_size") >= 40, F.col("p_retailprice") >= 1500
    return table(spark, sf, "part").select("p_partkey", F.when(big & dear, "strong").when(big, "moderate").when(dear, "weak").when(F.col("p_size") < 5, "failed").otherwise("none").alias("tier"))


REGIME = TOP + ", k AS (SELECT query, count(DISTINCT label) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) AS k FROM hits) WHERE k <= 3 GROUP BY 1), s AS (SELECT query, CASE WHEN labels > 2 THEN 'ambiguous' WHEN pident IS NULL THEN 'orphan' WHEN pident >= 60 THEN 'resolved' ELSE 'weak' END AS regime, bits FROM top JOIN k USING (query))"


def regimes(spark, sf):
    h = hits(spark, sf).withColumn("k", F.row_number().over(W.partitionBy("query").orderBy(F.desc("bits"), "target")))
    k = h.where("k <= 3").groupBy("query").agg(F.count_distinct("label").alias("labels"))
    regime = F.when(F.col("labels") > 2, "ambiguous").when(F.col("pident").isNull(), "orphan").when(F.col("pident") >= 60, "resolved").otherwise("weak")
    return tops(spark, sf).join(k, "query").select("query", regime.alias("regime"), "bits")


@query("ev5_sequence_regime", REGIME + " SELECT query, regime FROM s")
def ev5(spark, sf):
    return regimes(spark, sf).select("query", "regime")


@query("ev6_combined_regime", REGIME + " SELECT regime || CASE WHEN o_orderstatus = 'F' THEN '+closed' ELSE '+open' END AS regime, count(*) AS n, round(avg(bits), 2) AS bits FROM s JOIN orders ON query = o_orderkey GROUP BY 1")
def ev6(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"), F.when(F.col("o_orderstatus") == "F", "+closed").otherwise("+open").alias("o"))
    return regimes(spark, sf).join(o, "query").groupBy(F.concat("regime", "o").alias("regime")).agg(F.count("*").alias("n"), R(F.avg("bits"), 2).alias("bits"))


@query("ev8_snippets", "SELECT conv_id, bool_or(regexp_matches(lower(text), 'the')) AS any_hit, array_to_string(list(left(text, 40) ORDER BY turn)[1:3], '|') AS snippets FROM conversations GROUP BY 1")
def ev8(spark, sf):
    # three rows are kept before the lists are made
    c = table(spark, sf, "conversations").withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    s = F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("turn", F.left("text", F.lit(40)).alias("t")))))
    return c.groupBy("conv_id").agg(F.bool_or(F.lower("text").rlike("the")).alias("any_hit"), F.concat_ws("|", F.transform(s, lambda x: x["t"])).alias("snippets"))


@query("ev9_landscape_rows", f"WITH {SCORES}, g AS (SELECT item_id, max(context - base) AS gain FROM scores GROUP BY 1) SELECT item_id, n_chars < 1000 AS short, gain >= 0.2 AS high_gain, n_chars < 1000 AND gain >= 0.2 AS both FROM g JOIN items USING (item_id)")
def ev9(spark, sf):
    g = scores(spark, sf).groupBy("item_id").agg(F.max(F.col("context") - F.col("base")).alias("gain")).join(items(spark, sf), "item_id")
    a, b = F.col("n_chars") < 1000, F.col("gain") >= 0.2
    return g.select("item_id", a.alias("short"), b.alias("high_gain"), (a & b).alias("both"))


@query("ev10_integrated_evidence", f"WITH {SCORES}, s AS (SELECT item_id, max(context) AS p, max(context - base) AS gain FROM scores GROUP BY 1), q AS (SELECT doc_id AS item_id, quality FROM labels) SELECT i.item_id, p, round(gain, 6) AS gain, quality, CASE WHEN p >= 0.8 AND quality = 1 THEN 'promote' WHEN p >= 0.5 THEN 'review' ELSE 'hold' END AS class FROM items i LEFT JOIN s USING (item_id) LEFT JOIN q USING (item_id)")
def ev10(spark, sf):
    s = scores(spark, sf).groupBy("item_id").agg(F.max("context").alias("p"), F.max(F.col("context") - F.col("base")).alias("gain"))
    q = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    j = items(spark, sf).select("item_id").join(s, "item_id", "left").join(q, "item_id", "left")
    return j.select("item_id", "p", R("gain").alias("gain"), "quality", F.when((F.col("p") >= 0.8) & (F.col("quality") == 1), "promote").when(F.col("p") >= 0.5, "review").otherwise("hold").alias("class"))


@query("ev12_candidate_assignments", f"WITH {SCORES}, a AS (SELECT item_id, list(label_id ORDER BY label_id) FILTER (context >= 0.6) AS over, max_by(label_id, struct_pack(a := context, b := label_id)) AS top FROM scores GROUP BY 1), e AS (SELECT item_id, unnest(CASE WHEN over IS NULL THEN [top] ELSE over END) AS label_id FROM a) SELECT e.item_id, e.label_id, round(context - base, 6) AS gain FROM e JOIN scores USING (item_id, label_id)")
def ev12(spark, sf):
    s = scores(spark, sf)
    a = s.groupBy("item_id").agg(F.collect_list(F.when(F.col("context") >= 0.6, F.col("label_id"))).alias("over"), F.max_by("label_id", F.struct("context", "label_id")).alias("top"))
    e = a.select("item_id", F.explode(F.when(F.size("over") == 0, F.array("top")).otherwise(F.col("over"))).alias("label_id"))
    return e.join(s, ["item_id", "label_id"]).select("item_id", "label_id", R(F.col("context") - F.col("base")).alias("gain"))


@query("ev13_false_positive_audit", f"WITH {SCORES} SELECT CASE WHEN regexp_matches(text, 'License') THEN 'license' WHEN regexp_matches(text, '[|]') THEN 'table' ELSE 'other' END AS category, count(*) AS n FROM scores JOIN items USING (item_id) WHERE y = 0 AND context >= 0.4 GROUP BY 1")
def ev13(spark, sf):
    fp = scores(spark, sf).where("y = 0 and context >= 0.4").select("item_id").join(items(spark, sf), "item_id")
    return fp.groupBy(F.when(F.col("text").rlike("License"), "license").when(F.col("text").rlike("[|]"), "table").otherwise("other").alias("category")).agg(F.count("*").alias("n"))


@query("ev14_module_members", "WITH m AS (SELECT l_orderkey AS centre, l_partkey AS member, l_linenumber = 1 AS own FROM lineitem) SELECT member, min_by(centre, struct_pack(a := NOT own, b := centre)) AS centre FROM m GROUP BY 1")
def ev14(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("member")).agg(F.min_by("l_orderkey", F.struct(F.col("l_linenumber") != 1, "l_orderkey")).alias("centre"))


@query("ev22_cluster_examples", "SELECT p_brand AS cluster, count(*) AS n, array_to_string(list(p_partkey ORDER BY p_partkey)[1:5], ',') AS examples FROM part GROUP BY 1")
def ev22(spark, sf):
    k = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, sf, "part").withColumn("k", k).groupBy(F.col("p_brand").alias("cluster")).agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("p_partkey"))))).alias("examples"))


# ---- rankings


@query("top2_diverse_pick", f"WITH {SCORES}, r AS (SELECT item_id, label_id, host, context, row_number() OVER (PARTITION BY label_id, host ORDER BY context DESC, item_id) AS k FROM scores) SELECT item_id, label_id, host FROM r ORDER BY k > 1, context DESC, item_id, label_id LIMIT 40")
def top2(spark, sf):
    k = F.row_number().over(W.partitionBy("label_id", "host").orderBy(F.desc("context"), "item_id"))
    return scores(spark, sf).withColumn("k", k).orderBy(F.col("k") > 1, F.desc("context"), "item_id", "label_id").limit(40).select("item_id", "label_id", "host")


@query("top7_members_of_top_clusters", "WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS ck FROM part GROUP BY 1), r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, p_brand FROM r JOIN c USING (p_brand) WHERE k <= 5 AND ck <= 10")
def top7(spark, sf):
    p = table(spark, sf, "part")
    c = p.groupBy("p_brand").count().orderBy(F.desc("count"), "p_brand").limit(10).select("p_brand")
    k = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    return p.join(c, "p_brand", "left_semi").withColumn("k", k).where("k <= 5").select("p_partkey", "p_brand")


#: Orders above this price are candidates.
DEAR = 470000


@query("smp4_matched_controls")
def smp4(spark, sf):
    """Three controls for each of the dearest orders, by priority, low balance, clerk, month, price, balance and date."""
    from corvane.operators.matching import matched_controls

    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey", "c_mktsegment"), "o_custkey")
    o = o.select("o_orderkey", F.col("o_orderpriority").alias("label"), F.col("c_nationkey").alias("family"), F.col("c_mktsegment").alias("host"), F.col("o_totalprice").alias("value"), F.col("c_acctbal").alias("gain"), (-F.year("o_orderdate")).alias("p"))
    high = F.col("value") > DEAR
    c = o.where(high).select(F.col("o_orderkey").alias("candidate"), F.col("o_orderkey").alias("turn"), "label", "family", "host", "value")
    p = o.where(~high).select(F.col("o_orderkey").alias("control"), "label", (F.col("gain") <= 5000).alias("low"), "family", "host", "value", "gain", "p")
    return matched_controls(c, p, ["label", "family", "host"], ["gain", "p"], 3)


@query("jn15_evidence_joins", "SELECT p_partkey, coalesce(a.n, 0) AS orders, b.best AS supplier, coalesce(c.q, d.q, 0) AS quantity FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) a ON p_partkey = a.l_partkey LEFT JOIN (SELECT l_partkey, max_by(l_suppkey, struct_pack(a := l_quantity, b := -l_suppkey)) AS best FROM lineitem GROUP BY 1) b ON p_partkey = b.l_partkey LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c ON p_partkey = c.l_partkey LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) d ON p_partkey = d.l_partkey")
def jn15(spark, sf):
    q = lambda f: F.max(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    a = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_orderkey").alias("n"), F.max_by("l_suppkey", F.struct("l_quantity", -F.col("l_suppkey"))).alias("supplier"), q("R").alias("r"), q("A").alias("a"))
    return table(spark, sf, "part").join(a, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("orders"), "supplier", F.coalesce("r", "a", F.lit(0.0)).alias("quantity"))


@query("jn19_reference_variant", "WITH r AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) SELECT a.user_id, b.event_type, round(b.v - a.v, 6) AS delta FROM r a JOIN r b USING (user_id) WHERE a.event_type = 'view' AND b.event_type <> 'view'")
def jn19(spark, sf):
    r = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    a = r.where("event_type = 'view'").select("user_id", F.col("v").alias("ref"))
    return r.where("event_type <> 'view'").join(a, "user_id").select("user_id", "event_type", R(F.col("v") - F.col("ref")).alias("delta"))


@query("jn21_shared_kmers", "WITH w AS (SELECT 'b' AS side, item_id AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark UNION ALL SELECT 'd', doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') FROM documents), k AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS k FROM w), n AS (SELECT id, count(*) AS n FROM k WHERE side = 'b' GROUP BY 1), s AS (SELECT a.id AS query, b.id AS target, count(*) AS shared FROM k a JOIN k b USING (k) WHERE a.side = 'b' AND b.side = 'd' GROUP BY 1, 2) SELECT query, target, shared, round(shared / n, 6) AS identity FROM s JOIN n ON query = n.id")
def jn21(spark, sf):
    from corvane.operators.shared_kmers import shared_kmers

    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return shared_kmers(q, d).withColumn("identity", R("identity"))
