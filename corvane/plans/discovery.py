"""Queries: clusters, neighbours and discovery tables in full (EV3, EV7, EV15 to EV18, TOP1, TOP5, TOP6, AGG12, AGG19, AGG22, AGG23, AGG36, JN16, JN21, MET14, MET23)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions import scalar as S
from corvane.operators import metrics
from corvane.operators.discovery import cluster_metrics, cluster_null, cluster_rollup, module_clusters, module_windows
from corvane.operators.shared_kmers import nearest_by_kmers
from corvane.operators.similar import similarity_clusters
from corvane.operators.vectors import density_clusters, nearest_neighbours
from corvane.plans.features import F1, K, SEQ, counts, f1m, sequences, summed
from corvane.plans.fixtures import ITEMS, SCORES, items, scores, split_sql, truth
from corvane.plans.registry import query
from corvane.plans.tables import HITS, hits, split_items
from corvane.session import materialise, table

R = lambda c, n=6: F.round(c, n)


# ---- clusters and neighbours


@query("ev17_neighbour_edges", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.v, b.v) AS w FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS k FROM p) SELECT src, dst, round(greatest(0, w), 5) AS w FROM r WHERE k <= 15")
def ev17(spark, sf):
    return nearest_neighbours(table(spark, sf, "embeddings"), 15, "vec_id", "embedding").select("src", "dst", R("w", 5).alias("w"))


@query("ev16_density_clusters")
def ev16(spark, sf):
    """Density clusters of all vectors at a cosine distance of 0.15 with five neighbours; -1 is noise."""
    return density_clusters(table(spark, sf, "embeddings"), 0.85, 5, "vec_id", "embedding").select(F.col("id").alias("vec_id"), "cluster")


LEVELS = [0.3, 0.5, 0.7]
#: Clusters of documents at each level in SQL: sets of word runs, their shares, components by closure; then the split of each cluster.
CLUSTERED = f"""WITH RECURSIVE {ITEMS}, sw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM items),
sk AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS k FROM sw WHERE len(w) > 0), sn AS (SELECT item_id, count(*) AS n FROM sk GROUP BY 1),
sp AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS c FROM sk a JOIN sk b ON a.k = b.k AND a.item_id <> b.item_id GROUP BY 1, 2), sj AS (SELECT a, b, c / (x.n + y.n - c) AS s FROM sp JOIN sn x ON a = x.item_id JOIN sn y ON b = y.item_id),
lv AS (SELECT unnest({LEVELS}) AS level), reach(level, a, b) AS (SELECT level, item_id, item_id FROM items, lv UNION SELECT r.level, r.a, j.b FROM reach r JOIN sj j ON r.b = j.a AND j.s >= r.level),
cl AS (SELECT level, a AS item_id, min(b) AS c FROM reach GROUP BY 1, 2),
clustered AS (SELECT item_id AS id, {', '.join(f"max(c) FILTER (level = {x}) AS cluster_{round(x * 100)}" for x in LEVELS)} FROM cl GROUP BY 1),
sc AS (SELECT *, {', '.join(f"{split_sql(42, f'cluster_{round(x * 100)}', f'cluster_{round(x * 100)}')} AS split_{round(x * 100)}" for x in LEVELS)} FROM clustered)"""


def clustered(spark, sf):
    """Documents with their similarity clusters and the split of each cluster."""
    c = similarity_clusters(items(spark, sf), LEVELS, "item_id")
    names = [f"cluster_{round(x * 100)}" for x in LEVELS]
    return c.select("id", *names, *(S.group_split(42, n, n).alias(n.replace("cluster", "split")) for n in names))


@query("ev18_similarity_cluster_holdout", f"{CLUSTERED} SELECT * EXCLUDE (id), id AS doc_id FROM sc")
def ev18(spark, sf):
    """Splits that keep similar texts together, at shares of common word runs of 0.3, 0.5 and 0.7."""
    return clustered(spark, sf).withColumnRenamed("id", "doc_id")


def _side(key, name):
    return f"SELECT threshold, count(*) FILTER (a) AS train_{name}, count(*) FILTER (b) AS test_{name}, count(*) FILTER (a AND b) AS shared_{name} FROM (SELECT threshold, {key}, bool_or(s = 'train') AS a, bool_or(s = 'test') AS b FROM u GROUP BY ALL) GROUP BY 1"


@query("agg36_threshold_overlaps", f"""{CLUSTERED}, dd AS (SELECT sc.*, family, md5(coalesce(text, '')) AS h FROM sc JOIN items ON id = item_id),
u AS ({' UNION ALL '.join(f"SELECT {round(x * 100)} AS threshold, family, h, cluster_{round(x * 100)} AS c, split_{round(x * 100)} AS s FROM dd" for x in LEVELS)}),
xx AS (SELECT threshold, h, bool_or(s = 'train') AS a, count(*) FILTER (s = 'test') AS n FROM u GROUP BY 1, 2), rr AS (SELECT threshold, round(coalesce(sum(CASE WHEN a THEN n ELSE 0 END) / nullif(sum(n), 0), 0), 6) AS exact_rate FROM xx GROUP BY 1)
SELECT * FROM ({_side('c', 'clusters')}) JOIN ({_side('family', 'families')}) USING (threshold) JOIN rr USING (threshold)""")
def agg36(spark, sf):
    """For each level: clusters on either side, clusters and families on both, and the share of test texts equal to a training text."""
    h = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    d = materialise(clustered(spark, sf).join(items(spark, sf).select(F.col("item_id").alias("id"), "family", h.alias("h")), "id"), "clustered")
    u = d.select("id", "family", "h", F.explode(F.array(*(F.struct(F.lit(round(x * 100)).alias("threshold"), F.col(f"cluster_{round(x * 100)}").alias("c"), F.col(f"split_{round(x * 100)}").alias("s")) for x in LEVELS))).alias("x")).select("id", "family", "h", "x.*")
    side = lambda s: F.bool_or(F.col("s") == s)
    both = lambda key, name: u.groupBy("threshold", key).agg(side("train").alias("a"), side("test").alias("b")).groupBy("threshold").agg(F.count_if("a").alias(f"train_{name}"), F.count_if("b").alias(f"test_{name}"), F.count_if(F.col("a") & F.col("b")).alias(f"shared_{name}"))
    g = u.groupBy("threshold", "h").agg(side("train").alias("a"), F.count_if(F.col("s") == "test").alias("n"))
    rate = g.groupBy("threshold").agg(R(F.coalesce(F.try_divide(F.sum(F.when(F.col("a"), F.col("n")).otherwise(0)), F.sum("n")), F.lit(0.0))).alias("exact_rate"))
    return both("c", "clusters").join(both("family", "families"), "threshold").join(rate, "threshold")


# ---- the module chain: parts of a brand in the order of their keys, windows of three on either side

RADIUS, NEAR, LEAST = 3, 0.85, 3
MODULES = f"""WITH RECURSIVE pk AS (SELECT p_partkey AS centre, p_brand AS seq, p_type AS family, p_size, split_part(p_name, ' ', 1) AS label, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
wn AS (SELECT c.centre, c.family, n.centre AS member, n.k, n.kind, n.p_size, n.label FROM pk c JOIN pk n ON c.seq = n.seq AND abs(c.k - n.k) <= {RADIUS}),
wr AS (SELECT centre, any_value(family) AS family, string_agg(kind, '|' ORDER BY k) AS signature, avg((p_size < 10)::INT) AS unknown_ratio, avg((p_size > 40)::INT) AS vote_fraction, avg((label IN ('red', 'blue'))::INT) AS sensitive_fraction FROM wn GROUP BY 1),
vx AS (SELECT centre, pos, avg(x) AS x FROM (SELECT centre, unnest(list_transform(embedding, lambda y: y::DOUBLE)) AS x, generate_subscripts(embedding, 1) AS pos FROM wn JOIN embeddings ON vec_id = member) GROUP BY 1, 2), vm AS (SELECT centre, list(x ORDER BY pos) AS v FROM vx GROUP BY 1),
nr AS (SELECT a.centre AS a, b.centre AS b FROM vm a, vm b WHERE list_cosine_similarity(a.v, b.v) >= {NEAR}), co AS (SELECT a FROM nr GROUP BY 1 HAVING count(*) >= {LEAST}),
ed AS (SELECT a, b FROM nr WHERE a IN (FROM co) AND b IN (FROM co)), rc(a, b) AS (SELECT a, a FROM co UNION SELECT rc.a, ed.b FROM rc JOIN ed ON rc.b = ed.a), cc AS (SELECT a, min(b) AS c FROM rc GROUP BY 1),
mc AS (SELECT centre, coalesce(cc.c, x.c, -1) AS cluster FROM vm LEFT JOIN cc ON centre = cc.a LEFT JOIN (SELECT nr.a, min(cc.c) AS c FROM nr JOIN cc ON nr.b = cc.a GROUP BY 1) x ON centre = x.a),
md AS (SELECT * FROM wr JOIN mc USING (centre)), sg AS (SELECT cluster, signature, count(*) AS n FROM md WHERE cluster >= 0 GROUP BY 1, 2), tp AS (SELECT cluster, max(n) AS top, min_by(signature, struct_pack(a := -n, b := signature)) AS top_signature FROM sg GROUP BY 1),
ru AS (SELECT *, family_count + 2 * unknown_ratio + vote_fraction + consistency AS priority FROM (SELECT cluster, count(*) AS module_count, count(DISTINCT nullif(family, '')) AS family_count, avg(unknown_ratio) AS unknown_ratio, avg(vote_fraction) AS vote_fraction, avg(sensitive_fraction) AS sensitive_fraction, max(top) / count(*) AS consistency, max(top_signature) AS top_signature FROM md JOIN tp USING (cluster) GROUP BY 1))"""
SHARES = ("unknown_ratio", "vote_fraction", "sensitive_fraction")


def modules(spark, sf):
    """Windows of parts with the cluster of their mean vector."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("centre"), "embedding")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("centre"), F.col("p_brand").alias("seq"), F.col("p_type").alias("family"), "p_size", F.split("p_name", " ")[0].alias("label"), F.when(F.col("p_size") > 25, "large").otherwise("small").alias("kind"))
    rows = parts.join(vectors, "centre", "left")
    w = module_windows(rows, W.partitionBy("seq").orderBy("centre"), RADIUS, "centre", "kind", "embedding", F.col("p_size") < 10, F.col("p_size") > 40, "label", ["red", "blue"])
    w = materialise(w.select("centre", "family", "signature", *SHARES, "v"), "windows")
    return materialise(module_clusters(w, "centre", NEAR, LEAST), "modules")


@query("ev16_module_clusters", f"{MODULES} SELECT centre, family, signature, {', '.join(f'round({c}, 6) AS {c}' for c in SHARES)}, cluster FROM md")
def ev16_modules(spark, sf):
    """Module windows of all parts, clustered by their mean vectors; -1 is noise."""
    return modules(spark, sf).select("centre", "family", "signature", *(R(c).alias(c) for c in SHARES), "cluster")


@query("agg24_module_rollup", f"{MODULES} SELECT cluster, module_count, family_count, {', '.join(f'round({c}, 6) AS {c}' for c in (*SHARES, 'consistency', 'priority'))}, top_signature FROM ru")
def agg24_modules(spark, sf):
    """What each module cluster shows, with its priority."""
    return cluster_rollup(modules(spark, sf), "family").select("cluster", "module_count", "family_count", *(R(c).alias(c) for c in (*SHARES, "consistency", "priority")), "top_signature")


@query("agg25_module_metrics", f"{MODULES} SELECT count(*) AS cluster_count, coalesce(sum(module_count), 0) AS module_count, {', '.join(f'round(coalesce(sum({c} * module_count) / sum(module_count), 0), 6) AS weighted_{c}' for c in ('consistency', *SHARES))}, round(coalesce(avg(family_count), 0), 6) AS mean_family_count FROM ru")
def agg25_modules(spark, sf):
    """Measures over all module clusters, weighted by size; noise is left out."""
    m = cluster_metrics(cluster_rollup(modules(spark, sf), "family"))
    return m.select("cluster_count", "module_count", *(R(c).alias(c) for c in m.columns[2:]))


@query("inf9_module_null")
def inf9_modules(spark, sf):
    """The same measures against clusters of the same sizes dealt 500 times, drawn on tables of counts."""
    return cluster_null(modules(spark, sf), "family", 500).select("metric", *(R(c).alias(c) for c in ("observed", "null_mean", "null_low", "null_high", "p")))


KMERS = "w AS (SELECT 'b' AS side, item_id AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark UNION ALL SELECT 'd', doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') FROM documents), k AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS k FROM w), n AS (SELECT id, count(*) AS n FROM k WHERE side = 'b' GROUP BY 1), s AS (SELECT a.id AS query, b.id AS target, count(*) AS shared FROM k a JOIN k b USING (k) WHERE a.side = 'b' AND b.side = 'd' GROUP BY 1, 2)"


@query("jn21_nearest_by_kmers", f"WITH {KMERS}, t AS (SELECT query, max_by(target, struct_pack(a := shared, b := -target)) AS target, max(shared) AS shared FROM s GROUP BY 1) SELECT query, target, shared, round(shared / n, 6) AS identity FROM t JOIN n ON query = n.id")
def jn21_nearest(spark, sf):
    """The document that shares most word runs with each benchmark item."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return nearest_by_kmers(q, d).withColumn("identity", R("identity"))


# ---- evidence flags and status


@query("ev3_structure_status", "WITH s AS (SELECT p_partkey, p_size, p_retailprice AS p, p_partkey % 7 = 0 AS missing, contains(p_type, 'STEEL') AS agrees FROM part) SELECT p_partkey, CASE WHEN missing THEN 'not_searched' WHEN p_size < 5 THEN 'no_model' WHEN p < 950 THEN 'no_hit' WHEN p_size >= 40 AND agrees THEN 'supports' WHEN p_size >= 40 THEN 'conflicts' ELSE 'weak' END AS status, CASE WHEN missing OR p_size < 5 THEN 'none' WHEN p_size >= 40 AND p >= 1200 AND agrees THEN 'strong' WHEN p_size >= 40 AND agrees THEN 'moderate' WHEN p >= 1200 THEN 'weak' ELSE 'conflict' END AS tier FROM s")
def ev3_status(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice")
    missing, agrees = F.col("p_partkey") % 7 == 0, F.contains("p_type", F.lit("STEEL"))
    status = F.when(missing, "not_searched").when(size < 5, "no_model").when(price < 950, "no_hit").when((size >= 40) & agrees, "supports").when(size >= 40, "conflicts").otherwise("weak")
    tier = F.when(missing | (size < 5), "none").when((size >= 40) & (price >= 1200) & agrees, "strong").when((size >= 40) & agrees, "moderate").when(price >= 1200, "weak").otherwise("conflict")
    return table(spark, sf, "part").select("p_partkey", status.alias("status"), tier.alias("tier"))


#: Name -> (SQL, column) of the evidence flags of an item and label.
FLAGS = {
    "high_base": ("base >= 0.6", lambda: F.col("base") >= 0.6),
    "high_context": ("context >= 0.6", lambda: F.col("context") >= 0.6),
    "high_gain": ("context - base >= 0.2", lambda: F.col("context") - F.col("base") >= 0.2),
    "loss": ("context - base <= -0.1", lambda: F.col("context") - F.col("base") <= -0.1),
    "label_true": ("y = 1", lambda: F.col("y") == 1),
    "base_agrees": ("(y = 1) = (base >= 0.5)", lambda: (F.col("y") == 1) == (F.col("base") >= 0.5)),
    "context_agrees": ("(y = 1) = (context >= 0.5)", lambda: (F.col("y") == 1) == (F.col("context") >= 0.5)),
    "models_agree": ("(base >= 0.5) = (context >= 0.5)", lambda: (F.col("base") >= 0.5) == (F.col("context") >= 0.5)),
    "main_host": ("s.host = 'en'", lambda: F.col("host") == "en"),
    "short": ("i.n_chars < 500", lambda: F.col("n_chars") < 500),
    "long": ("i.n_chars >= 3000", lambda: F.col("n_chars") >= 3000),
    "licensed": ("contains(text, 'License')", lambda: F.contains("text", F.lit("License"))),
    "table": ("contains(text, '|')", lambda: F.contains("text", F.lit("|"))),
    "numbers": ("regexp_matches(text, '[0-9]{4}')", lambda: F.col("text").rlike("[0-9]{4}")),
    "copied": ("copies > 1", lambda: F.col("copies") > 1),
    "lone_family": ("family_copies = copies", lambda: F.col("family_copies") == F.col("copies")),
}
FLAGGED = f"WITH {SCORES}, cp AS (SELECT md5(text) AS h, count(*) AS copies FROM documents GROUP BY 1), cf AS (SELECT md5(text) AS h, source AS family, count(*) AS family_copies FROM documents GROUP BY 1, 2), fl AS (SELECT s.item_id, label_id, " + ", ".join(f"({c})::INT AS {n}" for n, (c, _) in FLAGS.items()) + " FROM scores s JOIN items i USING (item_id) JOIN cp ON md5(i.text) = cp.h JOIN cf ON md5(i.text) = cf.h AND cf.family = s.family)"


def flagged(spark, sf):
    """Scores with the sixteen evidence flags."""
    h = F.md5(F.col("text").cast("binary"))
    d = items(spark, sf).select("item_id", "text", "n_chars", F.col("family").alias("source"), h.alias("h"))
    family = d.groupBy("h", "source").agg(F.count("*").alias("family_copies"))
    copies = family.groupBy("h").agg(F.sum("family_copies").alias("copies"))
    j = scores(spark, sf).join(d, "item_id").join(copies, "h").join(family, ["h", "source"])
    return j.select("item_id", "label_id", *(c().cast("int").alias(n) for n, (_, c) in FLAGS.items()))


@query("ev7_flag_rows", FLAGGED + " SELECT * FROM fl")
def ev7(spark, sf):
    return flagged(spark, sf)


TRIAGE = ("high_context", "high_gain", "label_true", "context_agrees", "main_host", "long", "numbers", "licensed", "lone_family")


@query("ev15_triage", FLAGGED + f" SELECT item_id, label_id, {' + '.join(TRIAGE)} AS triage FROM fl")
def ev15(spark, sf):
    """Nine flags of evidence for each case, summed: 0 to 9."""
    return flagged(spark, sf).select("item_id", "label_id", sum((F.col(c) for c in TRIAGE[1:]), F.col(TRIAGE[0])).alias("triage"))


# ---- rankings


@query("top1_candidate_score", f"WITH {SCORES}, a AS (SELECT s.item_id, max(context) AS p, max(context) - min(context) AS margin, max(context - base) AS gain, any_value(s.host) AS host, any_value(n_chars) AS n FROM scores s JOIN items USING (item_id) GROUP BY 1), b AS (SELECT item_id, p, round(0.45 * p + 0.15 * margin + 0.20 * greatest(gain, 0) + 0.15 * (host = 'en')::INT + 0.05 * least(1, n / 5000.0), 6) AS score, margin, CASE WHEN p >= 0.85 AND margin >= 0.1 THEN 'confident' WHEN p >= 0.6 THEN 'possible' ELSE 'weak' END AS bucket FROM a) SELECT item_id, p, score, bucket FROM b ORDER BY score DESC, p DESC, margin DESC, item_id LIMIT 100")
def top1(spark, sf):
    s = scores(spark, sf).join(items(spark, sf).select("item_id", "n_chars"), "item_id")
    a = s.groupBy("item_id").agg(F.max("context").alias("p"), (F.max("context") - F.min("context")).alias("margin"), F.max(F.col("context") - F.col("base")).alias("gain"), F.max("host").alias("host"), F.max("n_chars").alias("n"))
    score = 0.45 * F.col("p") + 0.15 * F.col("margin") + 0.20 * F.greatest("gain", F.lit(0.0)) + 0.15 * (F.col("host") == "en").cast("int") + 0.05 * F.least(F.lit(1.0), F.col("n") / 5000.0)
    b = a.select("item_id", "p", "margin", R(score).alias("score"), F.when((F.col("p") >= 0.85) & (F.col("margin") >= 0.1), "confident").when(F.col("p") >= 0.6, "possible").otherwise("weak").alias("bucket"))
    return b.orderBy(F.desc("score"), F.desc("p"), F.desc("margin"), "item_id").limit(100).drop("margin")


THEMES = [("metal", ["steel", "tin", "copper"]), ("soft", ["brass"]), ("plated", ["plated"])]


@query("top5_shortlist", "WITH m AS (SELECT *, split_part(p_type, ' ', 1) AS family, CASE WHEN regexp_matches(lower(p_type), 'steel|tin|copper') THEN 'metal' WHEN contains(lower(p_type), 'brass') THEN 'soft' WHEN contains(lower(p_type), 'plated') THEN 'plated' ELSE 'other' END AS theme FROM part), t AS (SELECT p_brand, theme, count(*) AS n FROM m GROUP BY 1, 2), c AS (SELECT p_brand, count(*) AS n, count(DISTINCT family) AS families, avg(p_retailprice) AS price, avg((p_size > 25)::INT) AS large FROM m GROUP BY 1), g AS (SELECT max(n) AS biggest FROM c), h AS (SELECT p_brand, max_by(theme, struct_pack(a := n, b := theme)) AS theme FROM t GROUP BY 1) SELECT p_brand, n, families, theme, round(0.5 * least(1, log10(n) / 3) + 0.3 * least(1, price / 2000) + 0.2 * large, 6) AS score FROM c JOIN h USING (p_brand), g WHERE families >= 2 AND NOT (n = biggest AND large < 0.45) ORDER BY score DESC, n DESC, p_brand LIMIT 20")
def top5(spark, sf):
    """Clusters by discovery score with their theme; small-family clusters and the large background cluster are left out."""
    m = table(spark, sf, "part").withColumn("family", F.split("p_type", " ")[0]).withColumn("theme", S.marker_class("p_type", THEMES, "other"))
    t = m.groupBy("p_brand", "theme").count().groupBy("p_brand").agg(F.max_by("theme", F.struct("count", "theme")).alias("theme"))
    c = m.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("family").alias("families"), F.avg("p_retailprice").alias("price"), F.avg((F.col("p_size") > 25).cast("int")).alias("large"))
    c = c.join(c.agg(F.max("n").alias("biggest")))  # one row
    kept = c.where("families >= 2 and not (n = biggest and large < 0.45)").join(t, "p_brand")
    score = R(0.5 * F.least(F.lit(1.0), F.log10("n") / 3) + 0.3 * F.least(F.lit(1.0), F.col("price") / 2000) + 0.2 * F.col("large"))
    return kept.select("p_brand", "n", "families", "theme", score.alias("score")).orderBy(F.desc("score"), F.desc("n"), "p_brand").limit(20)


@query("top6_representatives", "WITH m AS (SELECT *, split_part(p_type, ' ', 1) AS family, split_part(p_type, ' ', -1) AS label FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM m), b AS (SELECT p_brand, array_to_string(list(p_partkey ORDER BY k), ',') AS best FROM r WHERE k <= 8 GROUP BY 1), l AS (SELECT p_brand, label, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, label) AS k FROM m GROUP BY 1, 2), h AS (SELECT p_brand, string_agg(label || '=' || n, ',' ORDER BY k) AS labels, max(label) FILTER (k = 1) AS modal FROM l WHERE k <= 8 GROUP BY 1), c AS (SELECT p_brand, count(DISTINCT p_name) AS names, count(DISTINCT family) AS families FROM m GROUP BY 1) SELECT p_brand, best, names, families, modal, labels FROM b JOIN h USING (p_brand) JOIN c USING (p_brand)")
def top6(spark, sf):
    m = table(spark, sf, "part").withColumn("family", F.split("p_type", " ")[0]).withColumn("label", F.element_at(F.split("p_type", " "), -1))
    k = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    b = m.withColumn("k", k).where("k <= 8").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("k", "p_partkey"))).alias("b"))
    place = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("count"), "label"))
    top = m.groupBy("p_brand", "label").count().withColumn("k", place).where("k <= 8").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("k", "label", "count"))).alias("l"))
    c = m.groupBy("p_brand").agg(F.count_distinct("p_name").alias("names"), F.count_distinct("family").alias("families"))
    return b.join(top, "p_brand").join(c, "p_brand").select("p_brand", F.concat_ws(",", F.transform("b", lambda x: x["p_partkey"].cast("string"))).alias("best"), "names", "families", F.col("l")[0]["label"].alias("modal"), F.concat_ws(",", F.transform("l", lambda x: F.concat(x["label"], F.lit("="), x["count"].cast("string")))).alias("labels"))


# ---- aggregates


@query("agg12_sequence_organisation", f"WITH {SEQ}, a AS (SELECT seq, count(*) AS n, round(avg((strand = 'N')::INT), 6) AS unknown, count(DISTINCT kind) AS kinds, max(end_) - min(CASE WHEN start > 0 THEN start END) + 1 AS span, round(avg(q), 6) AS mean, round(stddev_pop(q) / avg(q), 6) AS cv FROM seqs GROUP BY 1) SELECT *, round(CASE WHEN span > 0 THEN n * 1000.0 / span ELSE 0 END, 6) AS per_kb FROM a")
def agg12(spark, sf):
    a = sequences(spark, sf).groupBy("seq").agg(F.count("*").alias("n"), R(F.avg((F.col("strand") == "N").cast("int"))).alias("unknown"), F.count_distinct("kind").alias("kinds"), (F.max("end") - F.min(F.when(F.col("start") > 0, F.col("start"))) + 1).alias("span"), R(F.avg("q")).alias("mean"), R(F.stddev_pop("q") / F.avg("q")).alias("cv"))
    return a.withColumn("per_kb", R(F.when(F.col("span") > 0, F.col("n") * 1000.0 / F.col("span")).otherwise(0.0)))


@query("agg19_hit_summary", f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, target, row_order) AS k FROM hits), t AS (SELECT *, max(bits) FILTER (k = 1) OVER (PARTITION BY query) AS best FROM r WHERE k <= 10), a AS (SELECT query, max(best) AS top, max(bits) FILTER (k = 2) AS second, max(pident) FILTER (k = 1) AS top_identity, max(pident) FILTER (k = 2) AS second_identity, count(*) FILTER (bits >= 0.9 * best) AS near_top, count(*) FILTER (bits >= 30000) AS strong, count(DISTINCT label) AS labels, count(*) AS n FROM t GROUP BY 1) SELECT query, top, second, round(top - second, 4) AS bit_margin, top_identity - second_identity AS identity_margin, near_top, strong, labels, round(0.45 * coalesce(second, 0) / top + 0.35 * (labels - 1) / 3 + 0.2 * (n - 1) / 10, 6) AS ambiguity FROM a")
def agg19(spark, sf):
    r = hits(spark, sf).withColumn("k", F.row_number().over(W.partitionBy("query").orderBy(F.desc("bits"), "target", "row_order"))).where("k <= 10")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    a = r.groupBy("query").agg(at("bits", 1).alias("top"), at("bits", 2).alias("second"), at("pident", 1).alias("i1"), at("pident", 2).alias("i2"), F.collect_list("bits").alias("all"), F.count_if(F.col("bits") >= 30000).alias("strong"), F.count_distinct("label").alias("labels"), F.count("*").alias("n"))  # ten at most
    ambiguity = 0.45 * F.coalesce("second", F.lit(0.0)) / F.col("top") + 0.35 * (F.col("labels") - 1) / 3 + 0.2 * (F.col("n") - 1) / 10
    near = F.size(F.filter("all", lambda b: b >= 0.9 * F.col("top")))
    return a.select("query", "top", "second", R(F.col("top") - F.col("second"), 4).alias("bit_margin"), (F.col("i1") - F.col("i2")).alias("identity_margin"), near.alias("near_top"), "strong", "labels", R(ambiguity).alias("ambiguity"))


GROUPS = {"quality": "good", "toxic": "bad"}


@query("agg22_group_deltas", K + f", u AS (SELECT 'base' AS model, label_id, base AS score, y FROM scores UNION ALL SELECT 'context', label_id, context, y FROM scores), p AS (SELECT model, label_id, score, count(*) AS n, sum(y) AS tp FROM u GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct FROM p WINDOW w AS (PARTITION BY model, label_id ORDER BY score DESC)), ap AS (SELECT label_id, sum(tp * ct / cn) FILTER (model = 'context') / sum(tp) FILTER (model = 'context') - sum(tp * ct / cn) FILTER (model = 'base') / sum(tp) FILTER (model = 'base') AS d FROM c GROUP BY 1), f AS (SELECT label_id, {F1('b')} - {F1('a')} AS d, sum(positives) AS positives FROM k GROUP BY 1) SELECT CASE label_id WHEN 'quality' THEN 'good' ELSE 'bad' END AS label_group, count(*) AS labels, round(avg(ap.d), 6) AS mean_delta_ap, round(avg(f.d), 6) AS mean_delta_f1, sum(positives) AS positives FROM f JOIN ap USING (label_id) GROUP BY 1")
def agg22(spark, sf):
    """Mean AP and F1 differences of the labels of each group."""
    u = scores(spark, sf).unpivot(["label_id", "y"], ["base", "context"], "model", "score")
    ap = metrics.average_precision(u, ["model", "label_id"])
    at = lambda m: F.max(F.when(F.col("model") == m, F.col("ap")))
    d = ap.groupBy("label_id").agg((at("context") - at("base")).alias("ap"))
    f = summed(counts(spark, sf), "label_id").select("label_id", (f1m("b") - f1m("a")).alias("f1"), "positives")
    groups = F.broadcast(spark.createDataFrame(list(GROUPS.items()), "label_id string, label_group string"))  # a fixed list
    return f.join(d, "label_id").join(groups, "label_id").groupBy("label_group").agg(F.count("*").alias("labels"), R(F.avg("ap")).alias("mean_delta_ap"), R(F.avg("f1")).alias("mean_delta_f1"), F.sum("positives").alias("positives"))


@query("agg23_stratified_summary", f"WITH {SCORES}, si AS (SELECT doc_id AS item_id, n_chars FROM documents), b AS (SELECT s.*, CASE WHEN n_chars < 500 THEN 'lt_500' WHEN n_chars < 3000 THEN '500_3000' ELSE 'ge_3000' END AS len, CASE WHEN base < 0.3 THEN 'lt_0.3' WHEN base < 0.6 THEN '0.3_0.6' ELSE 'ge_0.6' END AS band FROM scores s JOIN si USING (item_id)), u AS (SELECT 'host' AS stratum, host AS v, label_id, base, context FROM b UNION ALL SELECT 'family', family, label_id, base, context FROM b UNION ALL SELECT 'length', len, label_id, base, context FROM b UNION ALL SELECT 'band', band, label_id, base, context FROM b UNION ALL SELECT 'truth', y::VARCHAR, label_id, base, context FROM b) SELECT stratum, v, CASE label_id WHEN 'quality' THEN 'good' ELSE 'bad' END AS label_group, count(*) AS n, round(avg(context - base), 6) AS delta, round(avg(context - base) - 1.96 * stddev_samp(context - base) / sqrt(count(*)), 6) AS low, round(avg(context - base) + 1.96 * stddev_samp(context - base) / sqrt(count(*)), 6) AS high FROM u GROUP BY 1, 2, 3 HAVING count(*) >= 20")
def agg23(spark, sf):
    """Mean gain with its interval in every stratum of five kinds by label group, strata of at least 20 rows."""
    s = scores(spark, sf).join(items(spark, sf).select("item_id", "n_chars"), "item_id")
    kinds = {"host": F.col("host"), "family": F.col("family"), "length": S.bins("n_chars", [500, 3000]), "band": S.bins("base", [0.3, 0.6]), "truth": F.col("y").cast("string")}
    u = s.select("label_id", (F.col("context") - F.col("base")).alias("d"), F.explode(F.array(*(F.struct(F.lit(n).alias("stratum"), c.alias("v")) for n, c in kinds.items()))).alias("x"))
    group = F.when(F.col("label_id") == "quality", "good").otherwise("bad")
    g = u.groupBy("x.stratum", "x.v", group.alias("label_group")).agg(F.count("*").alias("n"), F.avg("d").alias("m"), (1.96 * F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("e")).where("n >= 20")
    return g.select("stratum", "v", "label_group", "n", R("m").alias("delta"), R(F.col("m") - F.col("e")).alias("low"), R(F.col("m") + F.col("e")).alias("high"))


@query("jn16_module_prioritisation", "WITH j AS (SELECT p_brand AS cluster, p_partkey, split_part(p_type, ' ', 1) AS label, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON p_partkey = l_partkey), l AS (SELECT cluster, label, count(*) AS c FROM j GROUP BY 1, 2), m AS (SELECT cluster, max_by(label, struct_pack(a := c, b := label)) AS modal FROM l GROUP BY 1) SELECT cluster, count(*) AS members, count(*) FILTER (n > 0) AS linked, sum(n) AS candidates, max_by(p_partkey, struct_pack(a := n, b := -p_partkey)) AS best, max_by(label, struct_pack(a := n, b := -p_partkey)) AS top_label, any_value(modal) AS modal_label FROM j JOIN m USING (cluster) GROUP BY 1")
def jn16(spark, sf):
    n = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    j = table(spark, sf, "part").join(n, "p_partkey", "left").select(F.col("p_brand").alias("cluster"), "p_partkey", F.split("p_type", " ")[0].alias("label"), F.coalesce("n", F.lit(0)).alias("n"))
    first = F.struct("n", -F.col("p_partkey"))
    g = j.groupBy("cluster").agg(F.count("*").alias("members"), F.count_if(F.col("n") > 0).alias("linked"), F.sum("n").alias("candidates"), F.max_by("p_partkey", first).alias("best"), F.max_by("label", first).alias("top_label"))
    modal = j.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("modal_label"))
    return g.join(modal, "cluster")


# ---- fitted


def loss_sql(t: str) -> str:
    p = f"greatest(1e-12, least(1 - 1e-12, 1 / (1 + exp(-greatest(-60, least(60, z / {t}))))))"
    return f"sum(-n * CASE WHEN y = 1 THEN ln({p}) ELSE ln(1 - {p}) END)"


@query("met14_temperature", f"WITH {SCORES}, z AS (SELECT y, ln((base + 0.005) / (1.005 - base)) AS z, count(*) AS n FROM scores GROUP BY ALL), g AS (SELECT 0.25 * pow(1.05, k) AS t FROM (SELECT unnest(range(70)) AS k)), a AS (SELECT t, {loss_sql('t')} AS l FROM z, g GROUP BY 1), b AS (SELECT min_by(t, struct_pack(a := round(l, 9), b := t)) AS t FROM a), f AS (SELECT b.t * pow(1.05, (k - 20) / 20.0) AS t FROM b, (SELECT unnest(range(41)) AS k)), c AS (SELECT t, {loss_sql('t')} AS l FROM z, f GROUP BY 1) SELECT round(min_by(t, struct_pack(a := round(l, 9), b := t)), 6) AS temperature, round(min(l), 4) AS loss FROM c")
def met14(spark, sf):
    """Temperature of least cross-entropy: 70 steps of five per cent, then 41 steps of a quarter per cent around the best."""
    z = scores(spark, sf).select("y", F.log((F.col("base") + 0.005) / (1.005 - F.col("base"))).alias("z")).groupBy("y", "z").agg(F.count("*").alias("n"))
    return metrics.temperature(materialise(z, "logits")).select(R("temperature").alias("temperature"), R("loss", 4).alias("loss"))


@query("met23_linear_probe")
def met23(spark, sf):
    """A logistic probe on text features for each label, with positives weighted, fitted on training items and scored on test items."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    f = split_items(spark, sf).select("item_id", "item_split", F.log1p("n_chars").alias("len"), S.charset_share("text", "|#$%&*").alias("signs"), S.charset_share("text", "aeiou").alias("vowels"))
    out = None
    for label in ("quality", "toxic"):
        t = truth(spark, sf).where(F.col("label_id") == label).join(f, "item_id")
        weight = t.where("item_split = 'train'").agg(F.greatest(F.lit(1.0), F.least(F.lit(50.0), F.count_if(F.col("y") == 0) / F.greatest(F.count_if(F.col("y") == 1), F.lit(1))))).first()[0]
        df = VectorAssembler(inputCols=["len", "signs", "vowels"], outputCol="x").transform(t.withColumn("weight", F.when(F.col("y") == 1, weight).otherwise(1.0)))
        m = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=20).fit(df.where("item_split = 'train'"))
        part = m.transform(df.where("item_split = 'test'")).select("label_id", "y", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.union(part)
    a = metrics.average_precision(out, ["label_id"]).join(metrics.confusion(out, ["label_id"]), "label_id")
    return a.select("label_id", "positives", R("ap", 3).alias("ap"), R(metrics.f1(), 3).alias("f1"))
