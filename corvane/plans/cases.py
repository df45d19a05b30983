"""Queries: evidence of all sources joined for each case, label groups of the atlas, and the whole quality suite (EV10, EV11, EV21, INF19, JOB9).

Cases are parts: neighbours are parts of the brand, labelled hits their rows of returnflag N, structure hits those of R.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.scalar import stable_bucket
from corvane.operators import evidence, metrics, neighbours, resample
from corvane.operators.discovery import cluster_rollup
from corvane.plans import registry
from corvane.plans.discovery import MODULES, modules
from corvane.plans.fixtures import SCORES, bucket_sql, items, scores
from corvane.plans.inference import DELTA, DRAWS_IN_GROUP, EACH, SUMS, SWAP, draws_sql
from corvane.plans.registry import query
from corvane.session import materialise, table

R = lambda c, n=6: F.round(c, n)
#: Gain and score from which a part is a candidate.
GAIN, SURE = 0.2, 0.5

TARGETS = f"""tg AS (SELECT p_partkey AS case_id, split_part(p_name, ' ', 1) AS label, p_brand AS host, p_type AS family, p_size, p_retailprice / 20 AS model, p_size < 10 AS unknown, (count(*) OVER (PARTITION BY p_name)) > 1 AS copied, p_size > 25 AS y,
{bucket_sql("'ctx|' || p_partkey")} / 10000.0 AS p_context, {bucket_sql("'gain|' || p_partkey")} / 10000.0 - 0.4 AS gain FROM part),
hm AS (SELECT l_partkey AS case_id, target, pident, bits, labelled FROM (SELECT l_partkey, l_suppkey AS target, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * 2 END AS pident, l_extendedprice AS bits, l_linestatus = 'F' AS labelled, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, CASE WHEN l_linenumber = 3 THEN -1 ELSE l_quantity * 2 END DESC, l_orderkey * 10 + l_linenumber) AS k FROM lineitem WHERE l_returnflag = 'N') WHERE k = 1),
sr AS (SELECT *, l_orderkey * 10 + l_linenumber AS o, l_quantity / 50 AS prob, l_discount * 10 AS score, l_tax * 12.5 AS cover FROM lineitem WHERE l_returnflag = 'R'),
st AS (SELECT l_partkey AS case_id, count(*) AS hits, count(*) FILTER (prob >= 0.9 OR score >= 0.4) AS strong, max_by(struct_pack(a := prob, b := score, c := cover, d := l_suppkey), struct_pack(e := l_extendedprice, f := prob, g := -o)) AS best FROM sr GROUP BY 1),
am AS (SELECT l_partkey AS case_id, 1 - max(n) / sum(n)::DOUBLE AS ambiguity FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM sr GROUP BY 1, 2) GROUP BY 1)"""


def targets(spark, sf):
    p = table(spark, sf, "part")
    copied = p.groupBy("p_name").agg((F.count("*") > 1).alias("copied"))
    bucket = lambda k: stable_bucket(F.concat(F.lit(k), F.col("p_partkey").cast("string"))) / 10000.0
    columns = [F.col("p_partkey").alias("case_id"), F.split("p_name", " ")[0].alias("label"), F.col("p_brand").alias("host"), F.col("p_type").alias("family"), "p_size", (F.col("p_retailprice") / 20).alias("model")]
    return p.join(copied, "p_name").select(*columns, (F.col("p_size") < 10).alias("unknown"), "copied", (F.col("p_size") > 25).alias("y"), bucket("ctx|").alias("p_context"), (bucket("gain|") - 0.4).alias("gain"))


def homologs(spark, sf):
    """The best labelled-side hit of each case."""
    n = F.col("l_linenumber")
    h = table(spark, sf, "lineitem").where("l_returnflag = 'N'").select(F.col("l_partkey").alias("case_id"), F.col("l_suppkey").alias("target"), F.when(n != 3, F.col("l_quantity") * 2).alias("pident"), F.col("l_extendedprice").alias("bits"), (F.col("l_linestatus") == "F").alias("labelled"), (F.col("l_orderkey") * 10 + n).alias("row_order"))
    return evidence.top_hit(h, "case_id").select("case_id", "target", "pident", "bits", "labelled")


def structures(spark, sf):
    """Structure hits of each case: how many, how many strong ones, the best one, and how evenly they spread over targets."""
    s = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("case_id"), "l_suppkey", F.col("l_extendedprice").alias("bits"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), (F.col("l_quantity") / 50).alias("prob"), (F.col("l_discount") * 10).alias("score"), (F.col("l_tax") * 12.5).alias("cover"))
    best = F.max(F.struct("bits", "prob", (-F.col("o")).alias("o"), "score", "cover", "l_suppkey"))
    g = s.groupBy("case_id", "l_suppkey").agg(F.count("*").alias("n"), F.count_if((F.col("prob") >= 0.9) | (F.col("score") >= 0.4)).alias("strong"), best.alias("best"))
    g = g.groupBy("case_id").agg(F.sum("n").alias("hits"), F.sum("strong").alias("strong"), F.max("best").alias("best"), (1 - F.max("n") / F.sum("n")).alias("ambiguity"))
    return g.select("case_id", "hits", "strong", "ambiguity", *(F.col(f"best.{c}").alias(c) for c in ("prob", "score", "cover")), F.col("best.l_suppkey").alias("structure_target"))


def module_of(spark, sf):
    """The module window around each case with its cluster, and what the cluster shows; noise has neither."""
    m = modules(spark, sf)
    c = cluster_rollup(m, "family").select("cluster", "module_count", "family_count", "priority")
    m = m.select(F.col("centre").alias("case_id"), "signature", F.when(F.col("cluster") >= 0, F.col("cluster")).alias("cluster"))
    return m.join(c, "cluster", "left")


def flagged(text: str) -> str:
    return f"CASE WHEN {text} THEN 1 ELSE 0 END"


STATUS = """CASE WHEN hm.case_id IS NULL THEN 'no_hit' ELSE CASE WHEN pident IS NULL THEN 'identity_missing' WHEN pident >= 90 THEN 'near_exact' WHEN pident >= 50 THEN 'high_identity' WHEN pident >= 30 THEN 'remote' ELSE 'weak' END || CASE WHEN labelled THEN '' ELSE '_unlabelled' END END"""
STRUCTURE = """CASE WHEN hits IS NULL THEN 'no_hit' WHEN model < 50 THEN CASE WHEN best.a >= 0.9 THEN 'hit_on_poor_model' ELSE 'poor_model' END
WHEN best.a >= 0.9 AND best.b >= 0.4 AND best.c >= 0.35 THEN CASE WHEN ambiguity >= 0.5 OR strong > 3 THEN 'consistent_but_ambiguous' ELSE 'consistent' END WHEN best.a >= 0.9 AND best.c >= 0.25 THEN 'locally_consistent' WHEN best.a >= 0.5 OR best.b >= 0.3 THEN 'ambiguous_or_weak' ELSE 'inconclusive' END"""
POINTS = "CASE structure_status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in evidence.STRUCTURE_POINTS.items()) + " ELSE 0 END"
INTEGRATED = f"""{MODULES}, {TARGETS}, mo AS (SELECT centre AS case_id, signature, CASE WHEN cluster >= 0 THEN cluster END AS cluster, module_count, family_count, ru.priority AS cluster_priority FROM md LEFT JOIN ru USING (cluster)),
ij AS (SELECT tg.*, hm.target AS homolog, pident, {STATUS} AS sequence_status, cluster, signature, module_count, family_count, cluster_priority, coalesce(hits, 0) AS structure_hits, best.d AS structure_target, {STRUCTURE} AS structure_status, tg.gain >= {GAIN} AND p_context >= {SURE} AS candidate
FROM tg LEFT JOIN hm USING (case_id) LEFT JOIN st USING (case_id) LEFT JOIN am USING (case_id) LEFT JOIN mo USING (case_id)),
ip AS (SELECT *, round(3.0 * greatest(0, least(1, gain)) + 0.6 * {flagged('p_context >= 0.8')} + CASE WHEN pident IS NULL OR pident < 30 THEN 1.0 WHEN pident < 50 THEN 0.5 ELSE 0 END + {POINTS} + 0.7 * {flagged('cluster IS NOT NULL')} + 0.4 * {flagged('unknown')} - 0.8 * {flagged('copied')}, 6)::DOUBLE AS case_priority FROM ij),
fr AS (SELECT max_by(case_id, struct_pack(a := case_priority, b := -case_id)) AS case_id FROM ip WHERE candidate AND label <> '' GROUP BY label),
rs AS (SELECT case_id FROM ip WHERE candidate ORDER BY (case_id IN (FROM fr)) DESC, case_priority DESC, case_id LIMIT 6)"""


def integrated(spark, sf):
    """Every target with its nearest sequence, module, module cluster, structure hits and priority."""
    t = targets(spark, sf).join(homologs(spark, sf), "case_id", "left").join(structures(spark, sf), "case_id", "left")
    t = t.join(module_of(spark, sf).withColumnRenamed("priority", "cluster_priority"), "case_id", "left")
    c = F.col
    t = t.withColumn("sequence_status", evidence.sequence_status(c("pident"), c("labelled"), c("target").isNotNull()))
    t = t.withColumn("structure_status", evidence.structure_status(*map(c, ("hits", "model", "prob", "score", "cover", "ambiguity", "strong"))))
    t = t.withColumn("case_priority", R(evidence.case_priority(c("gain"), c("p_context"), c("pident"), c("structure_status"), c("cluster").isNotNull(), c("unknown"), c("copied"))))
    return t.withColumn("candidate", (c("gain") >= GAIN) & (c("p_context") >= SURE)).withColumnRenamed("target", "homolog").withColumn("structure_hits", F.coalesce("hits", F.lit(0)))


WHOLE = ("case_id", "label", "homolog", "pident", "sequence_status", "cluster", "signature", "module_count", "family_count", "structure_hits", "structure_target", "structure_status", "case_priority")


@query("ev10_integrated_table", f"{INTEGRATED} SELECT {', '.join(WHOLE)}, round(cluster_priority, 6) AS cluster_priority, CASE WHEN NOT candidate THEN 'matched_control_reference' WHEN case_id IN (FROM rs) THEN 'case_study_panel' ELSE 'supporting_table' END AS recommendation FROM ip")
def ev10(spark, sf):
    """All five sources of evidence for each target, its priority and recommendation."""
    t = materialise(integrated(spark, sf).select(*WHOLE, R("cluster_priority").alias("cluster_priority"), "candidate"), "integrated")
    best = evidence.recommended(t.where("candidate"), "case_id", "label", "case_priority").withColumn("_best", F.lit(True))
    kind = F.when(~F.col("candidate"), "matched_control_reference").when(F.col("_best"), "case_study_panel").otherwise("supporting_table")
    return t.join(F.broadcast(best), "case_id", "left").select(*WHOLE, "cluster_priority", kind.alias("recommendation"))  # six rows at most


CASE = ("case_id", "label", "family", "host", "unknown", "copied", "cluster", "signature", "homolog", "pident", "structure_target", "structure_status")
NEIGHBOURS = "nb AS (SELECT c.centre AS case_id, n.centre AS member, n.k - c.k AS place, n.label AS member_label FROM pk c JOIN pk n ON c.seq = n.seq AND abs(c.k - n.k) <= 2)"


def around(spark, sf):
    """Parts within two places of each candidate in its brand."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("member"), F.col("p_brand").alias("seq"), F.split("p_name", " ")[0].alias("member_label"))
    t = targets(spark, sf).where((F.col("gain") >= GAIN) & (F.col("p_context") >= SURE)).select(F.col("case_id").alias("member"))
    near = neighbours.within(p, t, W.partitionBy("seq").orderBy("member"), "seq", "member", 2)
    return near.select(F.col("centre").alias("case_id"), "member", F.col("offset").cast("long").alias("place"), "member_label")


@query("ev11_case_neighbourhoods", f"{MODULES}, {TARGETS}, {NEIGHBOURS} SELECT nb.* FROM nb JOIN tg USING (case_id) WHERE tg.gain >= {GAIN} AND p_context >= {SURE}")
def ev11_neighbourhoods(spark, sf):
    """A row for each neighbour of a candidate, itself included."""
    return around(spark, sf)


@query("ev11_case_table", f"{INTEGRATED}, {NEIGHBOURS}, ns AS (SELECT case_id, string_agg(place || ':' || member_label, ' ' ORDER BY place) AS neighbours FROM nb GROUP BY 1) SELECT {', '.join(CASE)}, round(p_context - gain, 6) AS p_base, round(p_context, 6) AS p_context, round(gain, 6) AS gain, neighbours FROM ip LEFT JOIN ns USING (case_id) WHERE candidate")
def ev11(spark, sf):
    """Candidates with scores, split fields, module, nearest sequence, structure and their neighbourhood in words."""
    summary = F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", F.col("place").cast("string"), "member_label").alias("t"))))
    n = around(spark, sf).groupBy("case_id").agg(F.concat_ws(" ", F.transform(summary, lambda x: x["t"])).alias("neighbours"))  # five rows a case
    c = integrated(spark, sf).where("candidate").join(n, "case_id", "left")
    return c.select(*CASE, R(F.col("p_context") - F.col("gain")).alias("p_base"), R("p_context").alias("p_context"), R("gain").alias("gain"), "neighbours")


@query("ev21_candidate_table", f"{MODULES}, {TARGETS}, th AS (SELECT label, min(p_context) FILTER (y) AS threshold FROM tg GROUP BY 1) SELECT case_id, label, tg.family, host, round(p_context - gain, 6) AS p_base, round(p_context, 6) AS p_context, round(gain, 6) AS gain, round(threshold, 6) AS threshold, CASE WHEN cluster >= 0 THEN cluster END AS cluster, unknown, copied FROM tg LEFT JOIN th USING (label) LEFT JOIN md ON centre = case_id WHERE tg.gain >= {GAIN}")
def ev21(spark, sf):
    """High-gain candidates with their label's threshold, module cluster and exact-transfer flag."""
    t = targets(spark, sf)
    th = t.groupBy("label").agg(F.min(F.when(F.col("y"), F.col("p_context"))).alias("threshold"))
    m = modules(spark, sf).select(F.col("centre").alias("case_id"), F.when(F.col("cluster") >= 0, F.col("cluster")).alias("cluster"))
    c = t.where(F.col("gain") >= GAIN).join(th, "label", "left").join(m, "case_id", "left")
    return c.select("case_id", "label", "family", "host", R(F.col("p_context") - F.col("gain")).alias("p_base"), *(R(x).alias(x) for x in ("p_context", "gain", "threshold")), "cluster", "unknown", "copied")


# ---- INF19: label groups of the atlas

GROUPS = {"all": ("quality", "toxic"), "safety": ("toxic",)}
GROUPED = "gx AS (SELECT unnest(CASE WHEN label_id = 'toxic' THEN ['all', 'safety'] ELSE ['all'] END) AS grp, *, (item_id % 50)::VARCHAR AS blk FROM scores)"
AP = "SELECT label_id, sum(tp * ct / cn) / nullif(sum(tp), 0) AS ap FROM (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct FROM (SELECT label_id, {0} AS s, count(*) AS n, sum(y) AS tp FROM scores GROUP BY 1, 2) WINDOW w AS (PARTITION BY label_id ORDER BY s DESC)) GROUP BY 1"
GROUP_ATLAS = f"""WITH {SCORES}, {GROUPED}, kb AS (SELECT grp, blk, count(*) AS n, {EACH} FROM gx GROUP BY ALL), ob AS (SELECT grp, n, {DELTA} AS delta FROM (SELECT grp, sum(n) AS n, {SUMS.format(w='')} FROM kb GROUP BY ALL)),
{draws_sql(DRAWS_IN_GROUP, block='blk', rows='gx')}, bt AS (SELECT grp, iter, {DELTA} AS d FROM (SELECT grp, iter, {SUMS.format(w='w * ')} FROM kb JOIN wt USING (blk) GROUP BY ALL)),
ci AS (SELECT grp, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM bt GROUP BY ALL),
sw AS (SELECT grp, iter, {SWAP} FROM (SELECT *, ('0x' || substr(md5('42|' || iter || '|' || blk), 1, 8))::UBIGINT % 2 = 1 AS sw FROM kb, (SELECT unnest(range({DRAWS_IN_GROUP})) AS iter)) GROUP BY ALL),
pv AS (SELECT grp, (count(*) FILTER (abs(coalesce(d, 0)) >= abs(coalesce(delta, 0)) - 1e-12) + 1) / ({DRAWS_IN_GROUP} + 1) AS p FROM (SELECT grp, {DELTA} AS d FROM sw GROUP BY ALL) JOIN ob USING (grp) GROUP BY grp),
la AS (SELECT label_id, b.ap - a.ap AS d_ap, d_f1 FROM ({AP.format('base')}) a JOIN ({AP.format('context')}) b USING (label_id) JOIN (SELECT label_id, {DELTA} AS d_f1 FROM (SELECT label_id, {EACH} FROM scores GROUP BY 1)) USING (label_id)),
gl AS (SELECT grp, count(DISTINCT label_id) AS labels, sum(y) AS positives FROM gx GROUP BY 1), gm AS (SELECT grp, avg(d_ap) AS mean_delta_ap, avg(d_f1) AS mean_delta_f1 FROM (SELECT DISTINCT grp, label_id FROM gx) JOIN la USING (label_id) GROUP BY 1)
SELECT grp AS label_group, labels, positives, n, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean_delta_ap', 'mean_delta_f1', 'delta', 'low', 'high', 'p'))} FROM ob JOIN gl USING (grp) JOIN gm USING (grp) LEFT JOIN ci USING (grp) LEFT JOIN pv USING (grp)"""


@query("inf19_group_summary", GROUP_ATLAS)
def inf19(spark, sf):
    """For each group of labels: mean differences of AP and F1 over its labels, and that of the pooled F1 with interval and swap test."""
    s = scores(spark, sf).withColumn("blk", (F.col("item_id") % 50).cast("string"))
    groups = spark.createDataFrame([(g, x) for g, names in GROUPS.items() for x in names], "label_group string, label_id string")
    g = s.join(F.broadcast(groups), "label_id")  # a row for each label of a group
    pooled = resample.stratified_effects(g, ["label_group"], "blk", DRAWS_IN_GROUP)
    ap = metrics.average_precision(s.unpivot(["label_id", "y"], ["base", "context"], "model", "score"), ["model", "label_id"])
    at = lambda m: F.max(F.when(F.col("model") == m, F.col("ap")))
    ap = ap.groupBy("label_id").agg((at("context") - at("base")).alias("d_ap"))
    y, hit = F.col("y") == 1, {"a": F.col("base") >= 0.5, "b": F.col("context") >= 0.5}
    f1 = s.groupBy("label_id").agg(*(F.count_if(x).alias(f"{n}_{m}") for m, h in hit.items() for n, x in (("tp", h & y), ("fp", h & ~y), ("fn", ~h & y))), F.sum("y").alias("pos"))
    f1 = f1.select("label_id", "pos", (metrics.f1("tp_b", "fp_b", "fn_b") - metrics.f1("tp_a", "fp_a", "fn_a")).alias("d_f1"))
    mean = groups.join(f1, "label_id").join(ap, "label_id").groupBy("label_group").agg(F.count("*").alias("labels"), F.sum("pos").alias("positives"), F.avg("d_ap").alias("mean_delta_ap"), F.avg("d_f1").alias("mean_delta_f1"))
    return pooled.join(mean, "label_group").select("label_group", "labels", "positives", "n", *(R(c).alias(c) for c in ("mean_delta_ap", "mean_delta_f1", "delta", "low", "high", "p")))


# ---- JOB9: the whole suite in one long table

#: Check, its query, what names a row, and the numbers it gives: expressions that Spark and SQL share.
SUITE = (
    ("exact_transfer", "ev1_exact_transfer_reasons", "reasons", {"items": "count(*)"}),
    ("strict_zero", "met16_subset_metrics", "subset", {c: f"max({c})" for c in ("macro_ap", "micro_ap", "macro_f1", "micro_f1")}),
    ("interval", "inf2_paired_bootstrap", "metric", {c: f"max({c})" for c in ("mean", "low", "high")}),
    ("label", "agg34_label_deep_dive", "label_id", {c: f"max({c})" for c in ("positives", "families", "predicted", "hit", "wrong")}),
    ("top_cases", "top4_true_and_false_positives", "concat(label_id, '|', y)", {"items": "count(*)", "best": "max(score)", "least": "min(score)"}),
    ("curve", "win12_ranked_curve", "label_id", {"ranks": "max(rank)", "least_precision": "min(precision)", "recall": "max(recall)"}),
    ("candidates", "ev12_candidate_assignments", "label_id", {"assigned": "count(*)", "high_gain": f"sum(CASE WHEN gain >= {GAIN} THEN 1 ELSE 0 END)"}),
    ("breakdown", "agg26_breakdown", "'all'", {c: f"max({c})" for c in ("n", "orders", "parts", "discounted")}),
    ("module_null", "inf9_cluster_permutation_null", "metric", {c: f"max({c})" for c in ("observed", "null_mean", "p")}),
)


def _suite_sql() -> str:
    known = registry.oracle_sql()
    parts = []
    for check, name, item, numbers in SUITE:
        wide = f"SELECT '{check}' AS chk, {item} AS item, {', '.join(f'({e})::DOUBLE AS m_{c}' for c, e in numbers.items())} FROM ({known[name]}) GROUP BY 2"
        parts += [f"SELECT chk, item, replace(m, 'm_', '') AS measure, round(v, 6) AS v FROM (UNPIVOT ({wide}) ON {', '.join(f'm_{c}' for c in numbers)} INTO NAME m VALUE v)"]
    return " UNION ALL ".join(parts)


@query("job9_quality_suite", _suite_sql())
def job9(spark, sf):
    """All nine checks as (chk, item, measure, v)."""
    run, out = registry.queries(), None
    for check, name, item, numbers in SUITE:
        wide = run[name](spark, sf).groupBy(F.expr(item).alias("item")).agg(*(F.expr(f"cast({e} as double)").alias(f"{c}_") for c, e in numbers.items()))
        long = wide.unpivot("item", [f"{c}_" for c in numbers], "m", "v").where("v is not null")
        long = long.select(F.lit(check).alias("chk"), "item", F.rtrim(F.col("m"), F.lit("_")).alias("measure"), R("v").alias("v"))
        out = long if out is None else out.union(long)
    return out
