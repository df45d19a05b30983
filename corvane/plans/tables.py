"""Queries: conforming, weak labels, splits, audits, aggregates and joins (PRJ, FN, SMP, AGG, JN, SET)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions import scalar as S
from corvane.operators.ranking import running
from corvane.plans.fixtures import ITEMS, SCORES, SPLIT_ITEMS, TRUTH, bucket_sql, items, scores, split_sql, truth
from corvane.plans.registry import query
from corvane.session import materialise, table

R = lambda c, n=6: F.round(c, n)


def split_items(spark, sf):
    df = items(spark, sf)
    return df.withColumn("split", S.group_split(42, "family", "family")).withColumn("item_split", S.group_split(42, "item", "item_id"))


@query("prj1_first_present", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_brand END), ''), nullif(trim(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END), ''), nullif(trim(p_name), '')) AS v FROM part")
def prj1(spark, sf):
    p = table(spark, sf, "part")
    a = F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_brand"))
    b = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type"))
    return p.select("p_partkey", S.first_present(a, b, F.col("p_name")).alias("v"))


LINE = "CASE c_custkey % 4 WHEN 0 THEN 'Realm; Some' || c_mktsegment || 'idae; last.' WHEN 1 THEN 'A; b' || lower(c_mktsegment) || 'virus; c.' WHEN 2 THEN 'x; y;' ELSE '' END"


@query("prj2_family_of_lineage", f"WITH l AS (SELECT c_custkey, list_filter(list_transform(string_split({LINE}, ';'), lambda x: regexp_replace(trim(x), '\\.$', '')), lambda x: x <> '') AS t FROM customer), f AS (SELECT c_custkey, list_filter(t, lambda x: x LIKE '%idae')[-1] AS a, list_filter(t, lambda x: x LIKE '%virus')[-1] AS b, t[-1] AS c FROM l) SELECT c_custkey, coalesce(a, b, c, 'unknown') AS family, CASE WHEN a IS NOT NULL THEN 'family' WHEN b IS NOT NULL THEN 'general' WHEN c IS NOT NULL THEN 'last' ELSE 'unknown' END AS source FROM f")
def prj2(spark, sf):
    c = table(spark, sf, "customer")
    k, m = F.col("c_custkey") % 4, F.col("c_mktsegment")
    text = F.when(k == 0, F.concat(F.lit("Realm; Some"), m, F.lit("idae; last."))).when(k == 1, F.concat(F.lit("A; b"), F.lower(m), F.lit("virus; c."))).when(k == 2, "x; y;").otherwise("")
    family, source = S.deepest(S.lineage(text), ["idae", "inae"], "virus")
    return c.select("c_custkey", family.alias("family"), source.alias("source"))


@query("prj3_host_key", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::VARCHAR WHEN o_orderkey % 3 = 1 THEN 'source_host::' || lower(regexp_replace(trim(' A  ' || o_orderpriority), '\\s+', ' ', 'g')) ELSE 'unknown' END AS host_key FROM orders")
def prj3(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey") % 3
    ids = F.when(k == 0, F.array(F.col("o_custkey").cast("string"), F.lit("9"))).otherwise(F.array().cast("array<string>"))
    name = S.blank(F.when(k == 1, F.concat(F.lit(" A  "), F.col("o_orderpriority"))))
    key = F.coalesce(F.try_element_at(ids, F.lit(1)), F.concat(F.lit("source_host::"), F.lower(F.regexp_replace(name, r"\s+", " "))), F.lit("unknown"))
    return o.select("o_orderkey", key.alias("host_key"))


CLASSES = [("metal", ["steel", "tin", "copper"]), ("soft", ["brass"]), ("plated", ["plated"])]


@query("prj5_marker_class", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel|tin|copper') THEN 'metal' WHEN contains(lower(p_type), 'brass') THEN 'soft' WHEN contains(lower(p_type), 'plated') THEN 'plated' ELSE 'other' END AS class FROM part")
def prj5(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.marker_class("p_type", CLASSES, "other").alias("class"))


@query("prj4_token_supergroup", "SELECT p_partkey, CASE WHEN list_has_any(string_split(lower(p_name), ' '), ['widget', 'gear']) THEN 'machine' WHEN list_has_any(string_split(lower(p_name), ' '), ['bolt', 'nut']) THEN 'fastener' ELSE 'other' END AS supergroup FROM part")
def prj4(spark, sf):
    t = F.split(F.lower("p_name"), " ")
    has = lambda *w: F.arrays_overlap(t, F.array(*map(F.lit, w)))
    return table(spark, sf, "part").select("p_partkey", F.when(has("widget", "gear"), "machine").when(has("bolt", "nut"), "fastener").otherwise("other").alias("supergroup"))


@query("prj7_length_bin", "SELECT doc_id, CASE WHEN n_chars <= 0 THEN 'len_0' ELSE 'len2^' || (length(bin(n_chars)) - 1) || '-' || length(bin(n_chars)) END AS bin FROM documents")
def prj7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.length_bin("n_chars").alias("bin"))


@query("prj9_unknown_text", "SELECT doc_id, regexp_matches(lower(text), 'moron|trash|apache') AS flagged FROM documents")
def prj9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower("text").rlike("moron|trash|apache").alias("flagged"))


@query("prj10_bins", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount IS NULL THEN 'missing' WHEN l_discount < 0.02 THEN 'lt_0.02' WHEN l_discount < 0.05 THEN '0.02_0.05' WHEN l_discount < 0.08 THEN '0.05_0.08' ELSE 'ge_0.08' END AS bin FROM lineitem")
def prj10(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.bins("l_discount", [0.02, 0.05, 0.08]).alias("bin"))


@query("prj11_context_gain", f"WITH {SCORES} SELECT item_id, label_id, round(context - base, 6) AS gain, round(greatest(0, least(1, context - (context - base))), 6) AS back FROM scores")
def prj11(spark, sf):
    g = S.gain("context", "base")
    return scores(spark, sf).select("item_id", "label_id", R(g).alias("gain"), R(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("context") - g))).alias("back"))


@query("prj12_numeric_features", "SELECT p_partkey, round(ln(1 + greatest(p_size, 0)), 6) AS size, (p_brand = 'Brand#1')::INT AS first, round(ln(1 + greatest(p_retailprice, 0)), 6) AS price FROM part")
def prj12(spark, sf):
    log = lambda c: R(F.log1p(F.greatest(F.col(c), F.lit(0)).cast("double"))).alias
    return table(spark, sf, "part").select("p_partkey", log("p_size")("size"), (F.col("p_brand") == "Brand#1").cast("int").alias("first"), log("p_retailprice")("price"))


@query("prj13_category_codes", "WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) AS code FROM part GROUP BY 1) SELECT p_partkey, code FROM part JOIN c USING (p_brand)")
def prj13(spark, sf):
    p = table(spark, sf, "part")
    code = p.groupBy("p_brand").agg(F.min("p_partkey").alias("first")).select("p_brand", F.row_number().over(W.orderBy("first")).alias("code"))  # categories
    return p.join(code, "p_brand").select("p_partkey", "code")


MODES = {"minimal": ["p_partkey", "p_size"], "full": ["p_partkey", "p_size", "p_brand"]}


@query("prj14_mode_projection", "SELECT p_partkey, p_size FROM part")
def prj14(spark, sf):
    from corvane.operators.conform import project_mode

    return project_mode(table(spark, sf, "part"), MODES, "minimal", ["p_partkey", "p_size"])


HITS = "hits AS (SELECT l_orderkey AS query, l_suppkey AS target, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * 2 END AS pident, l_extendedprice AS bits, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS evalue, l_tax AS qcov, l_linenumber AS row_order, l_partkey, l_returnflag AS label FROM lineitem)"


def hits(spark, sf):
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("target"), F.when(n != 3, F.col("l_quantity") * 2).alias("pident"), F.col("l_extendedprice").alias("bits"), F.when(n != 2, F.col("l_discount")).alias("evalue"), F.col("l_tax").alias("qcov"), n.alias("row_order"), "l_partkey", F.col("l_returnflag").alias("label"))


@query("prj15_hit_filter", f"WITH {HITS} SELECT query, row_order FROM hits WHERE coalesce(pident >= 40, true) AND coalesce(bits >= 20000, true) AND coalesce(evalue <= 0.06, true) AND coalesce(qcov >= 0.02, true)")
def prj15(spark, sf):
    from corvane.operators.evidence import passing

    return passing(hits(spark, sf), {"pident": 40, "bits": 20000, "qcov": 0.02}, {"evalue": 0.06}).select("query", "row_order")


@query("prj16_baseline_hit_filter", f"WITH {HITS} SELECT query, row_order FROM hits WHERE coalesce(pident >= 40, true) AND coalesce(bits >= 20000, true) AND coalesce(evalue <= 0.06, false)")
def prj16(spark, sf):
    return hits(spark, sf).where(F.coalesce(F.col("pident") >= 40, F.lit(True)) & F.coalesce(F.col("bits") >= 20000, F.lit(True)) & F.coalesce(F.col("evalue") <= 0.06, F.lit(False))).select("query", "row_order")


@query("prj17_dependence", f"WITH {SCORES} SELECT item_id, label_id, round((context - base) / (1 - base + 1e-8), 6) AS d FROM scores")
def prj17(spark, sf):
    return scores(spark, sf).select("item_id", "label_id", R((F.col("context") - F.col("base")) / (1 - F.col("base") + 1e-8)).alias("d"))


@query("prj19_query_id", "SELECT page_id, regexp_extract(regexp_replace(url, '^.*/', ''), '^([^.| ]*)', 1) AS id FROM pages")
def prj19(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(F.regexp_replace("url", "^.*/", ""), "^([^.| ]*)", 1).alias("id"))


@query("prj20_windows", "WITH w AS (SELECT doc_id, n_chars, unnest(CASE WHEN n_chars <= 1022 THEN [0::BIGINT] ELSE list_distinct(list_concat(range(0, n_chars - 1022 + 1, 894), [n_chars - 1022])) END) AS start FROM documents) SELECT doc_id, start, length(substr(text, start + 1, 1022)) AS size FROM w JOIN documents USING (doc_id)")
def prj20(spark, sf):
    d = table(spark, sf, "documents").withColumn("start", F.explode(S.windows_of(F.col("n_chars").cast("int"), 1022, 128)))
    return d.select("doc_id", F.col("start").cast("bigint").alias("start"), F.length(F.substring("text", F.col("start") + 1, F.lit(1022))).cast("bigint").alias("size"))


@query("prj21_head_tail", "SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 250) || substr(text, length(text) - 249) END) AS h FROM documents")
def prj21(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.head_tail("text", 500).cast("binary")).alias("h"))


@query("fn1_join_text", "SELECT p_partkey, lower(concat_ws(' ', nullif(trim(p_name), ''), nullif(trim(p_type), ''))) AS t FROM part")
def fn1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.join_text("p_name", "p_type").alias("t"))


RULES = {"machine": ["widget", "gear"], "fastener": ["bolt", "nut\\b"], "small": ["^tiny", "ring"]}


@query("fn2_rule_labels", "SELECT p_partkey, concat_ws(';', CASE WHEN regexp_matches(lower(p_name), 'widget|gear') THEN 'machine' END, CASE WHEN regexp_matches(lower(p_name), 'bolt|nut\\b') THEN 'fastener' END, CASE WHEN regexp_matches(lower(p_name), '^tiny|ring') THEN 'small' END) AS labels FROM part")
def fn2(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(";", S.rule_labels(F.lower("p_name"), RULES)).alias("labels"))


@query("fn3_rule_table", "WITH r(label, pattern, skip) AS (VALUES ('machine', 'widget|gear', NULL), ('fastener', 'bolt|nut', 'gear')) SELECT p_partkey, label FROM part, r WHERE regexp_matches(p_name, pattern, 'i') AND NOT coalesce(regexp_matches(p_name, skip, 'i'), false)")
def fn3(spark, sf):
    from corvane.operators.conform import apply_rules

    rules = spark.createDataFrame([("machine", "widget|gear", None), ("fastener", "bolt|nut", "gear")], "label string, pattern string, exclude string")
    return apply_rules(table(spark, sf, "part"), "p_name", rules).select("p_partkey", "label")


@query("fn4_term_agreement", "SELECT doc_id, contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 'apache license') OR contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 'of the') AS agrees FROM documents")
def fn4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.agrees("text", ["apache license", "of the"]).alias("agrees"))


@query("fn5_json_list", "SELECT event_id, event_type || '|' || (event_id % 2) AS l FROM events")
def fn5(spark, sf):
    text = F.concat(F.lit('["'), F.col("event_type"), F.lit('", " ", "'), (F.col("event_id") % 2).cast("string"), F.lit('"]'))
    return table(spark, sf, "events").select("event_id", F.concat_ws("|", S.json_list(text)).alias("l"))


@query("fn6_token_list", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name) || '; ' || lower(p_brand), '[;,|\\s]+'), lambda x: x <> ''))), ',') AS t FROM part")
def fn6(spark, sf):
    text = F.concat(F.lower("p_name"), F.lit("; "), F.lower("p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(",", S.token_list(text)).alias("t"))


@query("fn7_weighted_share", "WITH m AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, round(coalesce(sum(n) FILTER (event_type IN ('click', 'view')), 0) / sum(n), 6) AS share FROM m GROUP BY 1")
def fn7(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", R(S.weighted_share("m", ["click", "view"])).alias("share"))


@query("fn8_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def fn8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("fn9_stable_bucket", f"SELECT doc_id, {bucket_sql('doc_id::VARCHAR')} AS b, {bucket_sql('source', 100)} AS c FROM documents")
def fn9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.stable_bucket(F.col("doc_id").cast("string")).alias("b"), S.stable_bucket("source", 100).alias("c"))


@query("fn10_stable_fraction", "SELECT doc_id, round(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT / 4294967295.0, 6) AS f FROM documents")
def fn10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R(S.stable_fraction(F.col("doc_id").cast("string"))).alias("f"))


@query("fn12_charset_share", "SELECT doc_id, round(coalesce((length(text) - length(translate(text, 'aeiou', ''))) / nullif(length(text), 0)::DOUBLE, 0), 6) AS f FROM documents")
def fn12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R(S.charset_share("text", "aeiou")).alias("f"))


@query("fn13_longest_run", "SELECT doc_id, coalesce(list_max(list_transform(regexp_split_to_array(text, '[^aeiou]+'), lambda x: length(x))), 0)::INT AS n FROM documents")
def fn13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.longest_run("text", "aeiou").alias("n"))


WEIGHTS = {"a": 1.0, "e": 0.5, "t": -0.25}


@query("fn16_best_window", "WITH c AS (SELECT p_partkey, list_transform(string_split(lower(p_name), ''), lambda x: CASE x WHEN 'a' THEN 1.0 WHEN 'e' THEN 0.5 WHEN 't' THEN -0.25 ELSE 0 END) AS w FROM part) SELECT p_partkey, list_max(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: list_sum(w[i:i + 4])))::DOUBLE AS best FROM c")
def fn16(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.best_window(F.lower("p_name"), WEIGHTS, 5).alias("best"))


@query("fn17_composition", "SELECT doc_id, round(0.6 * v - 0.3 * t + 0.1, 6) AS s FROM (SELECT doc_id, (length(text) - length(translate(text, 'aeiou', ''))) / greatest(length(text), 1)::DOUBLE AS v, (length(text) - length(translate(text, 'nrst', ''))) / greatest(length(text), 1)::DOUBLE AS t FROM documents)")
def fn17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R(0.6 * S.charset_share("text", "aeiou") - 0.3 * S.charset_share("text", "nrst") + 0.1).alias("s"))


@query("fn20_evidence_text", "SELECT p_partkey, concat_ws(' | ', nullif(trim(p_name), ''), nullif(trim(CASE WHEN p_size > 25 THEN ' ' ELSE p_brand END), ''), nullif(trim(p_type), '')) AS t FROM part")
def fn20(spark, sf):
    p = table(spark, sf, "part").withColumn("p_brand", F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_brand")))
    return p.select("p_partkey", S.evidence_text("p_name", "p_brand", "p_type").alias("t"))


@query("fn21_linear_ensemble", f"WITH {SCORES} SELECT item_id, label_id, round(0.5 * base + 0.5 * coalesce(context, 0), 6) AS s FROM scores")
def fn21(spark, sf):
    return scores(spark, sf).select("item_id", "label_id", R(S.blend("base", F.coalesce("context", F.lit(0.0)))).alias("s"))


@query("fn22_scaled_sigmoid", f"WITH {SCORES} SELECT item_id, label_id, round(1 / (1 + exp(-greatest(-60, least(60, (base - 0.5) * 200 / 1.5)))), 6) AS p FROM scores")
def fn22(spark, sf):
    return scores(spark, sf).select("item_id", "label_id", R(S.sigmoid((F.col("base") - 0.5) * 200, 1.5)).alias("p"))


# ---- splits and samples


@query("smp7_group_holdout", f"WITH {ITEMS} SELECT item_id, {split_sql(42, 'family', 'family')} AS family_split, {split_sql(42, 'host', 'host')} AS host_split, {split_sql(42, 'item', 'item_id')} AS item_split FROM items")
def smp7(spark, sf):
    return items(spark, sf).select("item_id", *(S.group_split(42, n, k).alias(f"{n}_split") for n, k in (("family", "family"), ("host", "host"), ("item", "item_id"))))


@query("smp8_hash_split", f"SELECT doc_id, CASE WHEN {bucket_sql('coalesce(source, doc_id::VARCHAR)', 100)} < 80 THEN 'train' WHEN {bucket_sql('coalesce(source, doc_id::VARCHAR)', 100)} < 90 THEN 'val' ELSE 'test' END AS split FROM documents")
def smp8(spark, sf):
    b = S.stable_bucket(F.coalesce("source", F.col("doc_id").cast("string")), 100)
    return table(spark, sf, "documents").select("doc_id", F.when(b < 80, "train").when(b < 90, "val").otherwise("test").alias("split"))


@query("smp6_calibration", f"WITH {SPLIT_ITEMS} SELECT item_id, CASE WHEN item_split = 'train' AND ('0x' || substr(md5(text), 1, 8))::UBIGINT / 4294967295.0 < 0.1 THEN 'calibration' ELSE item_split END AS split FROM split_items")
def smp6(spark, sf):
    return split_items(spark, sf).select("item_id", F.when((F.col("item_split") == "train") & (S.stable_fraction("text") < 0.1), "calibration").otherwise(F.col("item_split")).alias("split"))


@query("smp1_round_robin", f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY label_id, family ORDER BY base DESC, item_id) AS rn FROM scores WHERE y = 1), g AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY rn, family) AS k FROM r) SELECT label_id, item_id, k FROM g WHERE k <= 50")
def smp1(spark, sf):
    from corvane.operators.sampling import round_robin

    return round_robin(scores(spark, sf).where("y = 1"), "label_id", ["family"], [F.desc("base"), F.col("item_id")], 50).select("label_id", "item_id", "k")


@query("smp2_hard_negatives", f"""WITH {SCORES}, x AS (SELECT s.*, length(bin(n_chars)) AS bits, sum(y) OVER (PARTITION BY s.item_id) - y > 0 AS other FROM scores s JOIN items USING (item_id)), p AS (SELECT label_id, host, bits FROM x WHERE y = 1 AND base > 0.9),
n AS (SELECT label_id, item_id, (label_id, host) IN (SELECT (label_id, host) FROM p) AS same_host, (label_id, bits) IN (SELECT (label_id, bits) FROM p) AS same_length, other FROM x WHERE y = 0), k AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY same_host DESC, same_length DESC, other DESC, item_id DESC) AS k FROM n) SELECT label_id, item_id, same_host, same_length, other, k FROM k WHERE k <= 20""")
def smp2(spark, sf):
    """Negatives that are hard to tell: of a host and a length class of the label's sure positives, with another label, then by id."""
    x = scores(spark, sf).join(items(spark, sf).select("item_id", F.length(F.bin("n_chars")).alias("bits")), "item_id")
    other = x.groupBy("item_id").agg(F.sum("y").alias("labels"))
    sure = x.where("y = 1 and base > 0.9")
    hosts, sizes = (sure.select("label_id", c).distinct().withColumn(n, F.lit(True)) for c, n in (("host", "same_host"), ("bits", "same_length")))
    n = x.where("y = 0").join(other, "item_id").join(hosts, ["label_id", "host"], "left").join(sizes, ["label_id", "bits"], "left")
    n = n.select("label_id", "item_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("same_host", "same_length")), (F.col("labels") > 0).alias("other"))
    k = F.row_number().over(W.partitionBy("label_id").orderBy(F.desc("same_host"), F.desc("same_length"), F.desc("other"), F.desc("item_id")))
    return n.withColumn("k", k).where("k <= 20")


#: Markers of texts that say little, for the choice of known positives.
VAGUE = "unknown|license|lorem"


@query("smp3_known_positives", f"WITH {SCORES}, k AS (SELECT label_id, item_id, row_number() OVER (PARTITION BY label_id ORDER BY CASE WHEN {split_sql(42, 'item', 'item_id')} = 'test' THEN 0 ELSE 1 END, regexp_matches(lower(coalesce(text, '')), '{VAGUE}'), abs(n_chars - 300), item_id) AS k FROM scores JOIN items USING (item_id) WHERE y = 1) SELECT * FROM k WHERE k <= 15")
def smp3(spark, sf):
    """Known positives of each label: of the preferred split, not vague, near a length of 300, by id."""
    s = scores(spark, sf).where("y = 1").join(items(spark, sf).select("item_id", "n_chars", F.lower(F.coalesce("text", F.lit(""))).rlike(VAGUE).alias("vague")), "item_id")
    order = [F.when(S.group_split(42, "item", "item_id") == "test", 0).otherwise(1), F.col("vague"), F.abs(F.col("n_chars") - 300), F.col("item_id")]
    return s.withColumn("k", F.row_number().over(W.partitionBy("label_id").orderBy(*order))).where("k <= 15").select("label_id", "item_id", "k")


@query("smp5_capped_blind_ids", "WITH c AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS k FROM documents), d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('blind|' || doc_id)) AS n FROM c WHERE k <= 5) SELECT doc_id, 'B-' || lpad(n::VARCHAR, 5, '0') AS blind_id FROM d")
def smp5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    k = F.row_number().over(W.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))))
    few = d.withColumn("k", k).where("k <= 5")  # a panel: five of each group
    n = F.row_number().over(W.orderBy(F.md5(F.concat(F.lit("blind|"), F.col("doc_id").cast("string")).cast("binary"))))
    return few.select("doc_id", F.format_string("B-%05d", n).alias("blind_id"))


@query("smp13_canonical_run", "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value > 50) DESC, ts DESC, event_id) AS k FROM events) SELECT event_id, k = 1 AS canonical FROM r")
def smp13(spark, sf):
    k = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy(F.desc(F.col("value") > 50), F.desc("ts"), "event_id"))
    return table(spark, sf, "events").select("event_id", (k == 1).alias("canonical"))


# ---- aggregates


@query("agg1_multi_sets", "SELECT ps.p_brand, array_to_string(list_sort(list(DISTINCT nullif(trim(p_type), ''))), '|') AS types, count(*) AS n FROM part ps GROUP BY 1")
def agg1(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.concat_ws("|", F.array_sort(F.collect_set(S.blank("p_type")))).alias("types"), F.count("*").alias("n"))


@query("agg2_conditional_counts", "SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY 1")
def agg2(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@query("agg3_first_row", "SELECT l_orderkey, min_by(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def agg3(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("l_partkey"))


@query("agg4_group_top20", "SELECT * FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS k FROM documents GROUP BY 1, 2) WHERE k <= 20")
def agg4(spark, sf):
    g = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return g.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "source"))).where("k <= 20")


@query("agg5_top_hit", f"WITH {HITS} SELECT query, target, pident, bits FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, pident DESC NULLS LAST, row_order) AS k FROM hits) WHERE k = 1")
def agg5(spark, sf):
    from corvane.operators.evidence import top_hit

    return top_hit(hits(spark, sf)).select("query", "target", "pident", "bits")


@query("agg6_best_gain", f"WITH {SCORES} SELECT item_id, max(context - base) AS gain, max_by(label_id, struct_pack(a := context - base, b := label_id)) AS label_id, count(*) AS n, count(*) FILTER (context > base) AS positive FROM scores GROUP BY 1")
def agg6(spark, sf):
    g = F.col("context") - F.col("base")
    return scores(spark, sf).groupBy("item_id").agg(F.max(g).alias("gain"), F.max_by("label_id", F.struct(g, "label_id")).alias("label_id"), F.count("*").alias("n"), F.count_if(g > 0).alias("positive"))


@query("agg7_label_positives", f"WITH {SPLIT_ITEMS}, {TRUTH} SELECT label_id, coalesce(sum(y) FILTER (split = 'train'), 0) AS train, coalesce(sum(y) FILTER (split = 'val'), 0) AS val, coalesce(sum(y) FILTER (split = 'test'), 0) AS test, sum(y) >= 50 AS kept FROM truth JOIN split_items USING (item_id) GROUP BY 1")
def agg7(spark, sf):
    j = truth(spark, sf).join(split_items(spark, sf).select("item_id", "split"), "item_id")
    p = j.groupBy("label_id").pivot("split", ["train", "val", "test"]).agg(F.coalesce(F.sum("y"), F.lit(0))).na.fill(0)
    return p.withColumn("kept", F.col("train") + F.col("val") + F.col("test") >= 50)


@query("agg8_label_distribution", f"WITH {SPLIT_ITEMS}, {TRUTH} SELECT item_split AS split, label_id, sum(y) AS positives, count(*) AS size, round(sum(y) / count(*), 6) AS rate FROM truth JOIN split_items USING (item_id) GROUP BY 1, 2")
def agg8(spark, sf):
    j = truth(spark, sf).join(split_items(spark, sf).select("item_id", F.col("item_split").alias("split")), "item_id")
    return j.groupBy("split", "label_id").agg(F.sum("y").alias("positives"), F.count("*").alias("size"), R(F.sum("y") / F.count("*")).alias("rate"))


@query("agg9_split_summary", f"WITH {SPLIT_ITEMS} SELECT scheme, s AS split, count(*) AS item_count, count(DISTINCT family) AS families, count(DISTINCT host) AS hosts FROM (SELECT 'family' AS scheme, split AS s, * FROM split_items UNION ALL SELECT 'item', item_split, * FROM split_items) GROUP BY 1, 2")
def agg9(spark, sf):
    long = split_items(spark, sf).select("item_id", "family", "host", F.explode(F.create_map(F.lit("family"), "split", F.lit("item"), "item_split")).alias("scheme", "s"))
    return long.groupBy("scheme", F.col("s").alias("split")).agg(F.count("*").alias("item_count"), F.count_distinct("family").alias("families"), F.count_distinct("host").alias("hosts"))


@query("agg10_overlap_summary", f"WITH {SPLIT_ITEMS}, k AS (SELECT 'family' AS key, family AS v, item_split AS s FROM split_items UNION ALL SELECT 'host', host, item_split FROM split_items UNION ALL SELECT 'text', md5(text), item_split FROM split_items), g AS (SELECT key, v, bool_or(s = 'train') AS a, bool_or(s = 'test') AS b FROM k GROUP BY 1, 2) SELECT key, count(*) FILTER (a) AS train, count(*) FILTER (b) AS test, count(*) FILTER (a AND b) AS shared FROM g GROUP BY 1")
def agg10(spark, sf):
    from corvane.operators.audit import overlap_summary

    df = split_items(spark, sf).withColumn("text", F.md5(F.col("text").cast("binary")))
    return overlap_summary(df, ["family", "host", "text"], "item_split")


@query("agg11_vote_table", f"WITH {SPLIT_ITEMS}, {TRUTH} SELECT md5(text) AS h, label_id, round(avg(y), 6) AS vote, count(*) AS n FROM truth JOIN split_items USING (item_id) WHERE item_split = 'train' GROUP BY 1, 2")
def agg11(spark, sf):
    tr = split_items(spark, sf).where("item_split = 'train'").select("item_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return truth(spark, sf).join(tr, "item_id").groupBy("h", "label_id").agg(R(F.avg("y")).alias("vote"), F.count("*").alias("n"))


@query("agg14_any_text_flag", "SELECT source, bool_or(regexp_matches(text, 'Apache License')) AS found FROM documents GROUP BY 1")
def agg14(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.bool_or(F.col("text").rlike("Apache License")).alias("found"))


@query("agg18_family_features", "SELECT source, round(avg(n_chars), 6) AS mean, round(avg((n_chars > 2000)::INT), 6) AS high, max_by(lang, struct_pack(a := n, b := lang)) AS mode FROM documents JOIN (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) USING (source, lang) GROUP BY 1")
def agg18(spark, sf):
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"), F.count_if(F.col("n_chars") > 2000).alias("h"))
    return n.groupBy("source").agg(R(F.sum("s") / F.sum("n")).alias("mean"), R(F.sum("h") / F.sum("n")).alias("high"), F.max_by("lang", F.struct("n", "lang")).alias("mode"))


@query("agg20_upper_median", "SELECT l_returnflag, l_linestatus, count(*) AS n, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median_high, round(avg((l_quantity > 40)::INT), 6) AS high FROM lineitem GROUP BY 1, 2")
def agg20(spark, sf):
    # distinct values with counts: bounded by the value's domain, not by the rows
    c = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_quantity").agg(F.count("*").alias("c"))
    k = ["l_returnflag", "l_linestatus"]
    upto = F.sum("c").over(W.partitionBy(*k).orderBy("l_quantity"))
    c = c.withColumn("upto", upto).withColumn("total", F.sum("c").over(W.partitionBy(*k)))
    return c.groupBy(*k).agg(F.sum("c").alias("n"), F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2) + 1, F.col("l_quantity"))).alias("median_high"), R(F.sum(F.when(F.col("l_quantity") > 40, F.col("c")).otherwise(0)) / F.sum("c")).alias("high"))


@query("agg26_breakdown", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem")
def agg26(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("agg28_feature_qc", "WITH u AS (SELECT unnest(['quantity', 'price', 'tax']) AS feature, unnest([l_quantity, l_extendedprice, l_tax]) AS v FROM lineitem) SELECT feature, count(*) AS n, count(*) FILTER (v IS NULL) AS missing, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd, min(v) AS low, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, max(v) AS high, count(*) FILTER (v NOT BETWEEN 0 AND 50000) AS outside FROM u GROUP BY 1")
def agg28(spark, sf):
    u = table(spark, sf, "lineitem").select(F.explode(F.create_map(F.lit("quantity"), "l_quantity", F.lit("price"), "l_extendedprice", F.lit("tax"), "l_tax")).alias("feature", "v"))
    # equal values are merged first, ranks come from ranges of values, and only the values at a rank are joined
    c = materialise(u.groupBy("feature", "v").agg(F.count("*").alias("c")), "values")
    known = F.col("v").isNotNull()
    upto = materialise(running(c.where(known), ["feature"], [F.col("v")], {"upto": F.col("c")}), "ranks")
    total = upto.groupBy("feature").agg(F.sum("c").alias("total"))  # one row a feature
    at = {n: (F.col("total") - 1) * q for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))}
    placed = upto.join(F.broadcast(total), "feature")
    # the value at place k (from 0) is the least whose running count exceeds k
    value = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    q = placed.groupBy("feature").agg(*(x for n, k in at.items() for x in (value(F.floor(k)).alias(f"{n}_a"), value(F.ceil(k)).alias(f"{n}_b"))), F.first("total").alias("total"))
    q = q.select("feature", *(R(F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * (k - F.floor(k)), 4).alias(n) for n, k in at.items()))
    n, s = F.sum(F.when(known, F.col("c"))), F.sum(F.col("v").cast("double") * F.col("c"))
    m = c.groupBy("feature").agg((s / n).alias("mean"))
    d = c.join(F.broadcast(m), "feature").groupBy("feature").agg(
        F.sum("c").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("c"))), F.lit(0)).alias("missing"), F.first("mean").alias("mean"),
        F.sqrt(F.sum(F.col("c") * F.pow(F.col("v") - F.col("mean"), 2)) / n).alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.coalesce(F.sum(F.when(~F.col("v").between(0, 50000), F.col("c"))), F.lit(0)).alias("outside"),
    )
    return d.join(q, "feature", "left").select("feature", "n", "missing", R("mean", 4).alias("mean"), R("sd", 4).alias("sd"), "low", "p25", "p50", "p75", "high", "outside")


@query("agg29_effect_size", f"WITH {TRUTH} SELECT label_id, round(avg(n_chars) FILTER (y = 1) - avg(n_chars) FILTER (y = 0), 4) AS delta, round((avg(n_chars) FILTER (y = 1) - avg(n_chars) FILTER (y = 0)) / sqrt((var_pop(n_chars) FILTER (y = 1) + var_pop(n_chars) FILTER (y = 0)) / 2 + 1e-8), 6) AS d FROM truth JOIN documents ON item_id = doc_id GROUP BY 1")
def agg29(spark, sf):
    j = truth(spark, sf).join(items(spark, sf).select("item_id", "n_chars"), "item_id")
    at = lambda f, y: f(F.when(F.col("y") == y, F.col("n_chars")))
    delta = at(F.avg, 1) - at(F.avg, 0)
    return j.groupBy("label_id").agg(R(delta, 4).alias("delta"), R(delta / F.sqrt((at(F.var_pop, 1) + at(F.var_pop, 0)) / 2 + 1e-8)).alias("d"))


@query("agg31_positive_weight", f"WITH {TRUTH} SELECT label_id, round(greatest(1, least(10, count(*) FILTER (y = 0) / greatest(sum(y), 1))), 6) AS weight FROM truth GROUP BY 1")
def agg31(spark, sf):
    w = F.count_if(F.col("y") == 0) / F.greatest(F.sum("y"), F.lit(1))
    return truth(spark, sf).groupBy("label_id").agg(R(F.greatest(F.lit(1.0), F.least(F.lit(10.0), w))).alias("weight"))


@query("agg33_vector_mean", "WITH e AS (SELECT label, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, i, avg(v::DOUBLE) AS m FROM e GROUP BY 1, 2), n AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS u FROM m) SELECT label, i::INT AS i, round(u, 5) AS u FROM n")
def agg33(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    m = e.groupBy("label", "i").agg(F.avg("v").alias("m"))
    return m.select("label", "i", R(F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(W.partitionBy("label"))), 5).alias("u"))


@query("agg37_tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) GROUP BY 1")
def agg37(spark, sf):
    return table(spark, sf, "part").select(F.explode(F.split("p_type", " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


# ---- joins


@query("jn1_left_lookups", "SELECT l_orderkey, l_linenumber, p_brand, s_name, n_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey")
def jn1(spark, sf):
    p, s, n = (table(spark, sf, t) for t in ("part", "supplier", "nation"))
    j = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "p_brand", "s_name", "n_name")


@query("jn2_tiered_fallback", "WITH a AS (SELECT l_partkey, l_suppkey, min(l_tax) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2), b AS (SELECT l_partkey, min(l_tax) AS v FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1) SELECT l.l_orderkey, l.l_linenumber, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'pair' WHEN b.v IS NOT NULL THEN 'part' ELSE 'none' END AS strategy FROM lineitem l LEFT JOIN a USING (l_partkey, l_suppkey) LEFT JOIN b USING (l_partkey)")
def jn2(spark, sf):
    from corvane.operators.conform import tiered_join

    li = table(spark, sf, "lineitem")
    a = li.where("l_linenumber = 1").groupBy("l_partkey", "l_suppkey").agg(F.min("l_tax").alias("v"))
    b = li.where("l_linenumber <= 2").groupBy("l_partkey").agg(F.min("l_tax").alias("v"))
    return tiered_join(li, [("pair", a, ["l_partkey", "l_suppkey"]), ("part", b, ["l_partkey"])], "v").select("l_orderkey", "l_linenumber", "v", "strategy")


@query("jn3_preferred_row", f"WITH {HITS} SELECT query, target FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (label = 'A') DESC, row_order, target) AS k FROM hits) WHERE k = 1")
def jn3(spark, sf):
    return hits(spark, sf).groupBy("query").agg(F.min_by("target", F.struct(F.col("label") != "A", "row_order", "target")).alias("target"))


@query("jn4_aligned_predictions", f"WITH {SCORES} SELECT a.item_id, a.label_id, a.base, b.context FROM scores a JOIN scores b USING (item_id, label_id) WHERE a.item_id % 3 <> 0 AND b.item_id % 5 <> 0")
def jn4(spark, sf):
    from corvane.operators.audit import align

    s = scores(spark, sf)
    return align(s.where("item_id % 3 <> 0").select("item_id", "label_id", "base"), s.where("item_id % 5 <> 0").select("item_id", "label_id", "context"))


HASHED = f"WITH {SPLIT_ITEMS}, h AS (SELECT item_id, family, item_split, CASE WHEN item_id % 11 = 0 THEN NULL ELSE md5(text) END AS h FROM split_items)"


def hashed(spark, sf):
    h = F.when(F.col("item_id") % 11 != 0, F.md5(F.col("text").cast("binary")))
    return split_items(spark, sf).select("item_id", "family", "item_split", h.alias("h"))


@query("jn5_exact_overlap", HASHED + " SELECT item_id FROM h WHERE item_split = 'test' AND h IN (SELECT h FROM h WHERE item_split = 'train' AND h IS NOT NULL)")
def jn5(spark, sf):
    h = hashed(spark, sf)
    return h.where("item_split = 'test'").join(h.where("item_split = 'train'").select("h"), "h", "left_semi").select("item_id")


@query("jn6_strict_zero", HASHED + " SELECT item_id FROM h WHERE item_split = 'test' AND h IS NOT NULL AND h NOT IN (SELECT h FROM h WHERE item_split = 'train' AND h IS NOT NULL)")
def jn6(spark, sf):
    from corvane.operators.audit import strict_zero

    return strict_zero(hashed(spark, sf), "h", "item_split").select("item_id")


@query("jn7_exact_transfer", HASHED + ", t AS (SELECT h, count(*) AS n, list_sort(list(DISTINCT family)) AS f FROM h WHERE item_split = 'train' AND h IS NOT NULL GROUP BY 1) SELECT item_id, n, array_to_string(f, ',') AS families, CASE WHEN NOT list_contains(f, family) THEN 'cross_family' ELSE 'same_family' END AS reason FROM h JOIN t USING (h) WHERE item_split = 'test'")
def jn7(spark, sf):
    h = hashed(spark, sf)
    t = h.where("item_split = 'train' and h is not null").groupBy("h").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("family")).alias("f"))
    reason = F.when(~F.array_contains("f", F.col("family")), "cross_family").otherwise("same_family")
    return h.where("item_split = 'test'").join(t, "h").select("item_id", "n", F.concat_ws(",", "f").alias("families"), reason.alias("reason"))


@query("jn9_wanted_ids", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000)")
def jn9(spark, sf):
    want = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(want, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("jn11_key_chase", "WITH RECURSIVE m AS (SELECT n_nationkey AS old, (n_nationkey * 7 + 3) % 25 AS new FROM nation WHERE n_nationkey % 3 <> 0), c AS (SELECT old, new AS dest, 1 AS d FROM m UNION ALL SELECT c.old, m.new, d + 1 FROM c JOIN m ON c.dest = m.old WHERE d < 30) SELECT c.old, max_by(c.dest, d) AS new FROM c GROUP BY 1 HAVING max(d) < 30")
def jn11(spark, sf):
    from corvane.operators.hierarchy import chase

    m = table(spark, sf, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("old"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("new"))
    return chase(m).where("not cyclic").select("old", "new")


TREE = "tree AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent, c_mktsegment AS name FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root', r_name FROM region UNION ALL SELECT 'root', 'root', 'root')"


def tree(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    out = c.select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent"), F.col("c_mktsegment").alias("name"))
    out = out.union(n.select(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name")).union(r.select(key("r", "r_regionkey"), F.lit("root"), "r_name"))
    return out.union(spark.createDataFrame([("root", "root", "root")], out.schema))


@query("jn12_root_path", f"WITH RECURSIVE {TREE}, p AS (SELECT id, id AS at, parent AS up, name AS path, 0 AS d FROM tree UNION ALL SELECT p.id, t.id, t.parent, t.name || '>' || p.path, d + 1 FROM p JOIN tree t ON t.id = p.up WHERE p.at <> p.up) SELECT id, max_by(path, d) AS path, max(d)::INT AS depth FROM p GROUP BY 1")
def jn12(spark, sf):
    from corvane.operators.hierarchy import root_paths

    return root_paths(tree(spark, sf)).select("id", F.concat_ws(">", "names").alias("path"), F.col("depth"))


@query("jn13_closure", f"WITH RECURSIVE {TREE}, p AS (SELECT DISTINCT 'n' || c_nationkey AS id FROM customer WHERE c_acctbal > 9000 UNION SELECT t.parent FROM p JOIN tree t USING (id)) SELECT DISTINCT id FROM p")
def jn13(spark, sf):
    from corvane.operators.hierarchy import root_paths

    seen = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("id")).distinct()
    return root_paths(tree(spark, sf)).join(seen, "id", "left_semi").select(F.explode("ids").alias("id")).distinct()


@query("jn14_explode_link", "SELECT p_partkey, trim(unnest(string_split(replace(p_name, ' ', ';'), ';'))) AS id FROM part")
def jn14(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(F.filter(F.split(F.replace(F.col("p_name"), F.lit(" "), F.lit(";")), ";"), lambda x: F.trim(x) != "")).alias("id"))


@query("jn17_matched_deltas", "WITH a AS (SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS q1, max(l_quantity) FILTER (l_linenumber = 2) AS q2, max(l_tax) FILTER (l_linenumber = 1) AS t1, max(l_tax) FILTER (l_linenumber = 2) AS t2 FROM lineitem GROUP BY 1) SELECT l_orderkey, q1 - q2 AS dq, round(t1 - t2, 6) AS dt FROM a WHERE q1 IS NOT NULL AND q2 IS NOT NULL")
def jn17(spark, sf):
    li = table(spark, sf, "lineitem").where("l_linenumber <= 2").groupBy("l_orderkey")
    at = lambda c, k: F.max(F.when(F.col("l_linenumber") == k, F.col(c)))
    out = li.agg((at("l_quantity", 1) - at("l_quantity", 2)).alias("dq"), R(at("l_tax", 1) - at("l_tax", 2)).alias("dt"))
    return out.where("dq is not null")


@query("set1_union_ids", "SELECT DISTINCT id FROM (SELECT c_nationkey AS id FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def set1(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("id")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("set2_intersection_sizes", "SELECT (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS shared")
def set2(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey").intersect(table(spark, sf, "supplier").select("s_nationkey")).agg(F.count("*").alias("shared"))


@query("set4_outer_delta", "WITH a AS (SELECT p_brand AS k, avg(p_size) AS v FROM part WHERE p_size > 20 GROUP BY 1), b AS (SELECT p_brand AS k, avg(p_size) AS v FROM part WHERE p_size <= 48 AND p_partkey % 2 = 0 GROUP BY 1) SELECT k, round(a.v - b.v, 6) AS delta FROM a FULL JOIN b USING (k)")
def set4(spark, sf):
    p = table(spark, sf, "part")
    a = p.where("p_size > 20").groupBy(F.col("p_brand").alias("k")).agg(F.avg("p_size").alias("a"))
    b = p.where("p_size <= 48 and p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("k")).agg(F.avg("p_size").alias("b"))
    return a.join(b, "k", "full").select("k", R(F.col("a") - F.col("b")).alias("delta"))


@query("set6_stacked_rows", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def set6(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)
