"""Queries: whole jobs (JOB1 to JOB5, JOB10) and the sequence features and sketches that they use (FN11, FN14 to FN19)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions import scalar as S
from corvane.functions import sequences as Q
from corvane.operators import context
from corvane.operators.conform import tiered_join
from corvane.operators.hierarchy import chase, root_paths
from corvane.plans.features import SEQ, order, sequences
from corvane.plans.fixtures import SCORES, bucket_sql, items, scores, split_sql
from corvane.plans.registry import query
from corvane.plans.tables import LINE
from corvane.session import materialise, shuffle_width, table

R = lambda c, n=6: F.round(c, n)
BIN = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} <= 0 THEN 'len_0' ELSE 'len2^' || (length(bin({0})) - 1) || '-' || length(bin({0})) END"

# ---- sequence features: a sequence is a part's name, type and brand

TEXT = "s AS (SELECT p_partkey, upper(trim(p_name || p_type || p_brand || p_name)) AS s FROM part)"


def texts(spark, sf):
    """The sequences, dealt to as many tasks as a shuffle has: a small file of many rows would be one task."""
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand").repartition(shuffle_width(spark), "p_partkey").select("p_partkey", F.upper(F.trim(F.concat("p_name", "p_type", "p_brand", "p_name"))).alias("s"))


def share(s: str, chars: str, n: str) -> str:
    return f"(length({s}) - length(translate({s}, '{chars}', ''))) / {n}"


WINDOWS = lambda n: f"list_transform(range(1, length(s) - {n - 2}), lambda i: substr(s, i, {n}))"
DENSE = f"""f AS (SELECT p_partkey, list_filter(range(0, greatest(length(s) - 18, 0)), lambda i: {share('substr(s, i + 1, 19)', Q.HYDROPHOBIC, '19.0')} >= 0.68) AS flags FROM s),
g AS (SELECT p_partkey, flags, 0 AS n, 0::BIGINT AS pos FROM f UNION ALL SELECT p_partkey, flags, n + 1, list_filter(flags, lambda x: x >= pos)[1] + 19 FROM g WHERE len(list_filter(flags, lambda x: x >= pos)) > 0),
dense AS (SELECT p_partkey, max(n)::DOUBLE AS n FROM g GROUP BY 1)"""
HEAD = f"greatest(0, least(1, 0.55 * coalesce(list_max(list_transform(range(1, least(length(s), 25) - 6), lambda i: {share('substr(s, i, 8)', Q.HYDROPHOBIC, '8.0')})), 0) + 0.25 * (regexp_matches(left(s, 5), '[{Q.POSITIVE}]'))::INT + CASE WHEN length(s) >= 23 THEN 0.20 * {share('substr(s, 16, 8)', Q.SMALL, '8.0')} ELSE 0 END))"
COIL = f"list_max(list_transform({WINDOWS(21)}, lambda w: least(1, greatest(0, 0.7 * {share('w', Q.COILED, '21.0')} + 0.3 * {share('w', Q.CHARGED, '21.0')} - 0.8 * {share('w', 'P', '21.0')}))))"
DISORDER = f"greatest(0, least(1, 0.6 * {share('s', Q.DISORDER, 'length(s)::DOUBLE')} + 0.25 * {share('s', 'PG', 'length(s)::DOUBLE')} + 0.15 * (1 - {share('s', Q.HYDROPHOBIC, 'length(s)::DOUBLE')})))"
LOW = f"CASE WHEN length(s) < 12 THEN (len(list_distinct(string_split(s, ''))) <= greatest(1, length(s) // 3))::INT ELSE len(list_filter({WINDOWS(12)}, lambda w: len(list_distinct(string_split(w, ''))) <= 4 OR -list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: (12 - length(replace(w, c, ''))) / 12.0 * log2((12 - length(replace(w, c, ''))) / 12.0))) <= 1.8)) / (length(s) - 11.0) END"


@query("fn14_dense_windows", f"WITH RECURSIVE {TEXT}, {DENSE} SELECT p_partkey, n FROM dense")
def fn14(spark, sf):
    return texts(spark, sf).select("p_partkey", S.dense_windows("s", Q.HYDROPHOBIC, 19, 0.68).cast("double").alias("n"))


@query("fn15_head_score", f"WITH {TEXT} SELECT p_partkey, round({HEAD}, 6) AS score FROM s")
def fn15(spark, sf):
    return texts(spark, sf).select("p_partkey", R(Q.head_score("s")).alias("score"))


@query("fn18_low_complexity", f"WITH {TEXT} SELECT p_partkey, round({LOW}, 6) AS share FROM s")
def fn18(spark, sf):
    return texts(spark, sf).select("p_partkey", R(Q.low_complexity("s")).alias("share"))


@query("fn19_feature_bundle", f"WITH RECURSIVE {TEXT}, {DENSE} SELECT p_partkey, n AS helix_count, round(ln(1 + list_max(list_transform(regexp_split_to_array(s, '[^{Q.HYDROPHOBIC}]+'), lambda x: length(x)))), 8) AS longest_run, round({HEAD}, 8) AS head, round({COIL}, 8) AS coil, round({DISORDER}, 8) AS disorder, round({LOW}, 8) AS low_complexity FROM s JOIN dense USING (p_partkey)")
def fn19(spark, sf):
    b = texts(spark, sf).select("p_partkey", Q.bundle("s").alias("b"))
    return b.select("p_partkey", *(R(F.col(f"b.{c}"), 8).alias(c) for c in ("helix_count", "longest_run", "head", "coil", "disorder", "low_complexity")))


def sketch_sql(s: str, source: str, key: str) -> str:
    """CTE ``sk`` of (key, sketch) for the upper-cased text ``s`` of ``source``."""
    least = [f"lpad(lower(hex((list_min(list_transform(k, lambda x: (x::HUGEINT * {a}::HUGEINT + {b}::HUGEINT) % 18446744073709551616::HUGEINT)) // 4503599627370496::HUGEINT)::BIGINT)), 3, '0')" for a, b in Q.SKETCH_HASHES]
    return f"""sy AS (SELECT {key}, {s} AS s, list_transform(string_split({s}, ''), lambda c: CASE WHEN strpos('{Q.ALPHABET}', c) > 0 THEN strpos('{Q.ALPHABET}', c) ELSE {Q.ALPHABET.index('X') + 1} END)::BIGINT[] AS y FROM {source}),
sc AS (SELECT *, list_transform(range(1, length(s) - 2), lambda i: ((y[i] * 28 + y[i + 1]) * 28 + y[i + 2]) * 28 + y[i + 3]) AS k FROM sy),
sk AS (SELECT {key}, CASE WHEN length(s) < 4 THEN 'short:' || length(s) || ':' || lpad({bucket_sql("'short|' || s")}::VARCHAR, 4, '0') ELSE {BIN.format('length(s)')} || ':' || {" || '-' || ".join(least)} END AS sketch FROM sc)"""


SHORT = "sx AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN upper(left(p_name, 3)) ELSE upper(trim(p_name || p_type)) END AS s FROM part)"


@query("fn11_minhash_sketch", f"WITH {SHORT}, {sketch_sql('s', 'sx', 'p_partkey')} SELECT p_partkey, sketch FROM sk")
def fn11(spark, sf):
    s = F.when(F.col("p_partkey") % 10 == 0, F.left("p_name", F.lit(3))).otherwise(F.concat("p_name", "p_type"))
    return table(spark, sf, "part").select("p_partkey", Q.sketch_key(s).alias("sketch"))


# ---- JOB1: items with their feature row, their sequence and its host sets

HOSTS = """feat AS (SELECT l_partkey AS item, min_by(l_orderkey, struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey)) AS seq, min_by(l_linenumber, struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey)) AS place FROM lineitem GROUP BY 1),
by_seq AS (SELECT l_orderkey AS seq, array_to_string(list_sort(list(DISTINCT s_name)), '|') AS hosts, count(*) AS links FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY 1),
by_taxon AS (SELECT user_id AS taxon, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS hosts, count(*) AS links FROM events GROUP BY 1),
stat AS (SELECT o_custkey AS taxon, count(*) AS entries, count(*) FILTER (o_orderstatus = 'F') AS with_a, count(*) FILTER (o_totalprice > 200000) AS with_b, count(*) FILTER (o_orderpriority = '1-URGENT') AS with_c FROM orders GROUP BY 1)"""
PICK = "coalesce(a.hosts, b.hosts, '') AS hosts, coalesce(CASE WHEN a.seq IS NOT NULL THEN a.links ELSE b.links END, 0) AS links, CASE WHEN a.seq IS NOT NULL THEN 'sequence' WHEN b.taxon IS NOT NULL THEN 'taxon' ELSE 'none' END AS strategy"


def host_tables(spark, sf):
    li = table(spark, sf, "lineitem")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    sets = lambda c: F.struct(F.concat_ws("|", F.array_sort(F.collect_set(c))).alias("hosts"), F.count("*").alias("links")).alias("v")
    by_seq = li.where("l_returnflag = 'R'").join(s, "l_suppkey").groupBy(F.col("l_orderkey").alias("seq")).agg(sets("s_name"))
    by_taxon = table(spark, sf, "events").groupBy(F.col("user_id").alias("taxon")).agg(sets("event_type"))
    n = lambda c: F.count_if(c)
    stat = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("taxon")).agg(F.count("*").alias("entries"), n(F.col("o_orderstatus") == "F").alias("with_a"), n(F.col("o_totalprice") > 200000).alias("with_b"), n(F.col("o_orderpriority") == "1-URGENT").alias("with_c"))
    return by_seq, by_taxon, stat


def with_hosts(spark, sf, rows):
    """Rows (seq, taxon, ..) with their host sets, by sequence, else by taxon, and the counts of the taxon."""
    by_seq, by_taxon, stat = host_tables(spark, sf)
    j = tiered_join(rows, [("sequence", by_seq, ["seq"]), ("taxon", by_taxon, ["taxon"])], "v").join(stat, "taxon", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("entries", "with_a", "with_b", "with_c")]
    return j.select(*rows.columns, F.coalesce("v.hosts", F.lit("")).alias("hosts"), F.coalesce("v.links", F.lit(0)).alias("links"), "strategy", *counts)


COUNTED = "coalesce(entries, 0) AS entries, coalesce(with_a, 0) AS with_a, coalesce(with_b, 0) AS with_b, coalesce(with_c, 0) AS with_c"


@query("job1_item_index", f"WITH {HOSTS} SELECT p_partkey AS item, length(p_name) AS length, sha256(p_name) AS digest, f.seq, place, o_custkey AS taxon, o_orderstatus AS kind, {PICK}, {COUNTED} FROM part LEFT JOIN feat f ON p_partkey = f.item LEFT JOIN orders ON f.seq = o_orderkey LEFT JOIN by_seq a ON f.seq = a.seq LEFT JOIN by_taxon b ON o_custkey = b.taxon LEFT JOIN stat s ON o_custkey = s.taxon")
def job1_items(spark, sf):
    """Every item, with or without a feature row: its first feature, its sequence, host sets and the strategy that found them."""
    first = F.struct("l_orderkey", "l_linenumber", "l_suppkey")
    feat = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.min(first).alias("f")).select("item", F.col("f.l_orderkey").alias("seq"), F.col("f.l_linenumber").alias("place"))
    seqs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("taxon"), F.col("o_orderstatus").alias("kind"))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.length("p_name").alias("length"), F.sha2("p_name", 256).alias("digest"))
    return with_hosts(spark, sf, items.join(feat, "item", "left").join(seqs, "seq", "left"))


@query("job1_sequence_index", f"WITH {HOSTS}, n AS (SELECT l_orderkey AS seq, count(*) AS items, count(DISTINCT l_partkey) AS different FROM lineitem GROUP BY 1) SELECT o_orderkey AS seq, o_custkey AS taxon, o_orderstatus AS kind, coalesce(items, 0) AS items, coalesce(different, 0) AS different, {PICK}, {COUNTED} FROM orders LEFT JOIN n ON o_orderkey = n.seq LEFT JOIN by_seq a ON o_orderkey = a.seq LEFT JOIN by_taxon b ON o_custkey = b.taxon LEFT JOIN stat s ON o_custkey = s.taxon")
def job1_sequences(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.count("*").alias("items"), F.count_distinct("l_partkey").alias("different"))
    seqs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("taxon"), F.col("o_orderstatus").alias("kind"))
    j = seqs.join(n, "seq", "left").select("seq", "taxon", "kind", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "different")))
    return with_hosts(spark, sf, j)


# ---- JOB2: merged ids, observed nodes with all ancestors, links

NODES = "node AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root', r_name FROM region UNION ALL SELECT 'root', 'root', 'root')"


@query("job2_observed_taxonomy", f"WITH RECURSIVE {NODES}, seen AS (SELECT 'n' || CASE WHEN c_nationkey IN (3, 7) THEN c_nationkey + 1 ELSE c_nationkey END AS id, count(*) AS links FROM customer WHERE c_acctbal > 0 GROUP BY 1 UNION ALL SELECT 'n' || CASE WHEN s_nationkey IN (3, 7) THEN s_nationkey + 1 ELSE s_nationkey END, count(*) FROM supplier GROUP BY 1), obs AS (SELECT id, sum(links)::BIGINT AS links FROM seen GROUP BY 1), up AS (SELECT id AS leaf, id FROM obs UNION SELECT up.leaf, n.parent FROM up JOIN node n USING (id)), p AS (SELECT id, id AS at, parent AS up, name AS path, 1 AS depth FROM node UNION ALL SELECT p.id, t.id, t.parent, t.name || '>' || p.path, depth + 1 FROM p JOIN node t ON t.id = p.up WHERE p.at <> p.up), f AS (SELECT id, max_by(path, depth) AS path FROM p GROUP BY 1) SELECT id, path, coalesce(links, 0) AS links, (SELECT sum(o.links) FROM up u JOIN obs o ON u.leaf = o.id WHERE u.id = f.id)::BIGINT AS below FROM f LEFT JOIN obs USING (id) WHERE id IN (SELECT id FROM up)")
def job2_taxonomy(spark, sf):
    """Observed nodes of two tables after merged ids are followed, with every ancestor, its path and the links at and below it."""
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    tree = n.select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name")).union(r.select(key("r", "r_regionkey"), F.lit("root"), "r_name"))
    tree = tree.union(spark.createDataFrame([("root", "root", "root")], tree.schema))
    merged = chase(n.where("n_nationkey in (3, 7)").select(key("n", "n_nationkey").alias("old"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1).cast("string")).alias("new")))
    seen = table(spark, sf, "customer").where("c_acctbal > 0").select(key("n", "c_nationkey").alias("old")).union(table(spark, sf, "supplier").select(key("n", "s_nationkey")))
    seen = seen.groupBy("old").agg(F.count("*").alias("links")).join(merged.where("not cyclic").select("old", "new"), "old", "left")
    seen = seen.groupBy(F.coalesce("new", "old").alias("id")).agg(F.sum("links").alias("links"))
    paths = root_paths(tree)
    below = seen.join(paths, "id").select("links", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("links").alias("below"))
    return paths.join(below, "id").join(seen, "id", "left").select("id", F.concat_ws(">", "names").alias("path"), F.coalesce("links", F.lit(0)).alias("links"), "below")


# ---- JOB3: strict split manifest and report

SCHEMES = {"species_holdout": "taxon", "family_holdout": "family", "host_taxid_holdout": "host_key", "host_supergroup_holdout": "supergroup", "sequence_sketch_holdout": "sketch"}
MANIFEST = f"""base AS (SELECT c_custkey AS item, c_nationkey::VARCHAR AS taxon, upper(trim(c_name || c_mktsegment)) AS s, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::VARCHAR WHEN c_custkey % 3 = 1 THEN 'source_host::' || lower(c_mktsegment) ELSE 'unknown' END AS host_key, CASE c_mktsegment WHEN 'BUILDING' THEN 'Fixed' WHEN 'MACHINERY' THEN 'Moving' WHEN 'AUTOMOBILE' THEN 'Moving' ELSE 'other' END AS supergroup,
list_filter(list_transform(string_split({LINE}, ';'), lambda x: regexp_replace(trim(x), '\\.$', '')), lambda x: x <> '') AS t FROM customer),
fam AS (SELECT *, coalesce(list_filter(t, lambda x: x LIKE '%idae')[-1], list_filter(t, lambda x: x LIKE '%virus')[-1], t[-1], 'unknown') AS family FROM base), {sketch_sql('s', 'base', 'item')},
man AS (SELECT f.item, taxon, family, host_key, supergroup, sketch, {BIN.format('length(f.s)')} AS length_bin FROM fam f JOIN sk ON f.item = sk.item)"""


def manifest(spark, sf):
    c = table(spark, sf, "customer")
    k, m = F.col("c_custkey") % 4, F.col("c_mktsegment")
    text = F.when(k == 0, F.concat(F.lit("Realm; Some"), m, F.lit("idae; last."))).when(k == 1, F.concat(F.lit("A; b"), F.lower(m), F.lit("virus; c."))).when(k == 2, "x; y;").otherwise("")
    family, _ = S.deepest(S.lineage(text), ["idae", "inae"], "virus")
    host = F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("string")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("source_host::"), F.lower(m))).otherwise("unknown")
    group = S.marker_class(m, [("Fixed", ["building"]), ("Moving", ["machinery", "automobile"])], "other")
    s = F.upper(F.trim(F.concat("c_name", m)))
    return c.select(F.col("c_custkey").alias("item"), F.col("c_nationkey").cast("string").alias("taxon"), family.alias("family"), host.alias("host_key"), group.alias("supergroup"), Q.sketch_key(s).alias("sketch"), S.length_bin(F.length(s)).alias("length_bin"))


SPLITS = ", ".join(f"{split_sql(42, n, k)} AS {n}" for n, k in SCHEMES.items())


@query("job3_split_manifest", f"WITH {MANIFEST} SELECT *, {SPLITS} FROM man")
def job3_manifest(spark, sf):
    """One pass over the items: every split is a function of the row's keys."""
    return manifest(spark, sf).select("*", *(S.group_split(42, n, k).alias(n) for n, k in SCHEMES.items()))


LONG_SPLITS = " UNION ALL ".join(f"SELECT '{n}' AS scheme, {k} AS grp, {n} AS part FROM sp" for n, k in SCHEMES.items())


@query("job3_split_report", f"WITH {MANIFEST}, sp AS (SELECT *, {SPLITS} FROM man), u AS ({LONG_SPLITS}), g AS (SELECT scheme, grp, count(*) AS n FROM u GROUP BY 1, 2), top AS (SELECT scheme, string_agg(grp || '=' || n, ',' ORDER BY n DESC, grp) AS top FROM (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY n DESC, grp) AS k FROM g) WHERE k <= 20 GROUP BY 1) SELECT scheme, count(*) FILTER (part = 'train') AS train, count(*) FILTER (part = 'val') AS val, count(*) FILTER (part = 'test') AS test, count(DISTINCT grp) AS unique_groups, any_value(top) AS top FROM u JOIN top USING (scheme) GROUP BY 1")
def job3_report(spark, sf):
    m = job3_manifest(spark, sf)
    u = m.select(F.explode(F.array(*(F.struct(F.lit(n).alias("scheme"), F.col(k).alias("grp"), F.col(n).alias("part")) for n, k in SCHEMES.items()))).alias("x")).select("x.*")
    g = u.groupBy("scheme", "grp", "part").count().groupBy("scheme", "grp").agg(F.sum("count").alias("n"), *(F.sum(F.when(F.col("part") == p, F.col("count")).otherwise(0)).alias(p) for p in ("train", "val", "test")))
    k = F.row_number().over(W.partitionBy("scheme").orderBy(F.desc("n"), "grp"))
    top = g.withColumn("k", k).where("k <= 20").groupBy("scheme").agg(F.array_sort(F.collect_list(F.struct("k", F.concat("grp", F.lit("="), F.col("n").cast("string")).alias("v")))).alias("l"))
    total = g.groupBy("scheme").agg(*(F.sum(p).alias(p) for p in ("train", "val", "test")), F.count("*").alias("unique_groups"))
    return total.join(top, "scheme").select("scheme", "train", "val", "test", "unique_groups", F.concat_ws(",", F.transform("l", lambda x: x["v"])).alias("top"))


# ---- JOB4: context features, split-aware

CTX = f"WITH {SEQ}, t AS (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN '__UNSEGMENTED__' ELSE 'seg' || (l_partkey % 3) END AS segment, (row_order % 3 <> 0)::INT AS tr, (kind = 'O')::INT AS fa, (strand = 'R')::INT AS fb FROM seqs)"
SORT = "PARTITION BY seq ORDER BY (start <= 0), start, CASE WHEN end_ > 0 THEN end_ ELSE 1000000000000 END, row_order"
GAP = "CASE WHEN {a} > 0 AND {b} > 0 THEN greatest(0, {b} - {a} - 1) ELSE 0 END"
LAP = "CASE WHEN {a} > 0 AND {b} > 0 THEN greatest(0, {a} - {b} + 1) ELSE 0 END"
PRIOR = "round(greatest(sum({f} * tr) OVER s - {f} * tr, 0) / greatest(sum(tr) OVER s - (tr * greatest(fa, fb)), 1)::DOUBLE, 6)"


def context_rows(spark, sf):
    part = F.col("l_partkey")
    s = sequences(spark, sf).withColumn("segment", F.when(part % 5 == 0, "__UNSEGMENTED__").otherwise(F.concat(F.lit("seg"), (part % 3).cast("string"))))
    return s.withColumn("length", F.col("q")).withColumn("train", F.col("row_order") % 3 != 0)


@query("job4_context_features", f"""{CTX}, e AS (SELECT *, lag(end_) OVER w AS pe, lead(start) OVER w AS ns, lag(q) OVER w AS pq, lead(q) OVER w AS nq, lag(strand) OVER w AS pst, lead(strand) OVER w AS nst, coalesce(lag(kind) OVER w, '__START__') AS prev_kind, coalesce(lead(kind) OVER w, '__END__') AS next_kind, row_number() OVER w AS k, count(*) OVER s AS n,
greatest(0, coalesce(max(CASE WHEN end_ > 0 THEN end_ END) OVER s - min(CASE WHEN start > 0 THEN start END) OVER s + 1, 0)) AS span, greatest(1, count(DISTINCT CASE WHEN segment <> '__UNSEGMENTED__' THEN segment END) OVER s) AS segments, avg(q) OVER s AS mean, stddev_pop(q) OVER s AS sd,
{PRIOR.format(f='fa')} AS genome_a, sum(fa * tr) OVER r - fa * tr AS local_a, {PRIOR.format(f='fb')} AS genome_b, sum(fb * tr) OVER r - fb * tr AS local_b FROM t WINDOW w AS ({SORT}), s AS (PARTITION BY seq), r AS ({SORT} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT seq, row_order, coalesce({BIN.format('pq')}, '__START__') AS prev_length_bin, coalesce({BIN.format('nq')}, '__END__') AS next_length_bin, prev_kind, next_kind, round(ln(1 + n), 6) AS log_count, round(CASE WHEN n = 1 THEN 0 ELSE (k - 1) / (n - 1)::DOUBLE END, 6) AS position, segments, round(ln(1 + span), 6) AS log_span, round(CASE WHEN span > 0 THEN n * 1000.0 / span ELSE 0 END, 6) AS density_per_kb, round(mean, 6) AS mean_length, round(CASE WHEN mean > 0 THEN sd / mean ELSE 0 END, 6) AS length_cv, (k > 1)::INT AS has_prev, (k < n)::INT AS has_next,
round(ln(1 + {GAP.format(a='pe', b='start')}), 6) AS gap_prev, round(ln(1 + {GAP.format(a='end_', b='ns')}), 6) AS gap_next, round(ln(1 + {LAP.format(a='pe', b='start')}), 6) AS overlap_prev, round(ln(1 + {LAP.format(a='end_', b='ns')}), 6) AS overlap_next, coalesce(pst = strand, false)::INT AS same_strand_prev, coalesce(nst = strand, false)::INT AS same_strand_next, genome_a, local_a, genome_b, local_b FROM e""")
def job4(spark, sf):
    f = context.context_features(context_rows(spark, sf), order(), {"a": F.col("kind") == "O", "b": F.col("strand") == "R"})
    rounded = {"log_count", "position", "log_span", "density_per_kb", "mean_length", "length_cv", "gap_prev", "gap_next", "overlap_prev", "overlap_next", "genome_a", "genome_b"}
    return f.select(*(R(c).alias(c) if c in rounded else c for c in f.columns))


@query("win8_train_priors", f"{CTX} SELECT seq, row_order, {PRIOR.format(f='fa')} AS prior, sum(fa * tr) OVER r - fa * tr AS near FROM t WINDOW s AS (PARTITION BY seq), r AS ({SORT} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def win8(spark, sf):
    labelled = (F.col("kind") == "O") | (F.col("strand") == "R")
    prior, near = context.train_priors(F.col("kind") == "O", labelled, "seq", order(), 3, F.col("train"))
    return context_rows(spark, sf).select("seq", "row_order", R(prior).alias("prior"), near.alias("near"))


def slot_sql(k: int) -> str:
    f = f"{'lag' if k < 0 else 'lead'}({{0}}, {abs(k)}) OVER w"
    a, b = (f.format("end_"), "start") if k < 0 else ("end_", f.format("start"))
    there = f"{f.format('row_order')} IS NOT NULL"
    value = lambda x: f"CASE WHEN {there} THEN round({x}, 4) ELSE 0 END"
    return "[" + ", ".join([value(f"{k / 2}::DOUBLE"), value(f"ln(1 + {f.format('q')})"), value(f"ln(1 + greatest(0, {b} - {a} - 1))"), value(f"ln(1 + greatest(0, {a} - {b} + 1))"), value(f"coalesce({f.format('strand')} = strand, false)::INT"), f"({there})::INT"]) + "]"


@query("win9_slots", f"WITH {SEQ} SELECT seq, row_order, array_to_string(list_transform(flatten([{', '.join(slot_sql(k) for k in (-2, -1, 1, 2))}]), lambda x: printf('%.4f', x::DOUBLE)), ' ') AS slots FROM seqs WINDOW w AS ({SORT})")
def win9(spark, sf):
    s = context_rows(spark, sf).withColumn("slots", context.neighbour_slots(order(), 2))
    names = ("offset", "log_length", "log_gap", "log_overlap", "same_strand", "mask")
    return s.select("seq", "row_order", F.concat_ws(" ", F.flatten(F.transform("slots", lambda x: F.array(*(S.four_places(x[c]) for c in names))))).alias("slots"))


@query("win10_module_windows", f"WITH {SEQ} SELECT seq, row_order, array_to_string(list(l_partkey) OVER w, ',') AS members, array_to_string(list(kind) OVER w, '>') AS signature, round(avg((strand = 'N')::INT) OVER w, 6) AS unknown, array_to_string(list_filter([CASE WHEN count(*) FILTER (kind = 'F') OVER w > 0 THEN 'F=' || count(*) FILTER (kind = 'F') OVER w END, CASE WHEN count(*) FILTER (kind = 'O') OVER w > 0 THEN 'O=' || count(*) FILTER (kind = 'O') OVER w END], lambda x: x IS NOT NULL), ',') AS histogram, round(avg((q > 25)::INT) OVER w, 6) AS vote, round(avg(q) OVER w, 6) AS mean_q FROM seqs WINDOW w AS ({SORT} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def win10(spark, sf):
    m = context.module_window(order(), 1, "l_partkey", "kind", F.col("strand") == "N", F.col("q") > 25, ["q"])
    s = context_rows(spark, sf).withColumn("m", m)
    return s.select("seq", "row_order", F.concat_ws(",", F.transform("m.members", lambda x: x.cast("string"))).alias("members"), "m.signature", R("m.unknown").alias("unknown"), "m.histogram", R("m.vote").alias("vote"), R(F.col("m.mean")[0]).alias("mean_q"))


# ---- JOB5: frozen labels, splits and calibration

RULES = {"licensed": ["license", "apache", "copyright"], "tabular": ["[|]"], "numbered": ["[0-9]{4}"]}
FLAG_SQL = {n: f"regexp_matches(lower(coalesce(text, '')), '{'|'.join(p)}')" for n, p in RULES.items()}
FROZEN = f"""fz AS (SELECT doc_id AS item_id, {', '.join(f'({c})::INT AS {n}' for n, c in FLAG_SQL.items())}, {' + '.join(f'({c})::INT' for c in FLAG_SQL.values())} AS positive_label_count, {split_sql(42, 'family', 'source')} AS split, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::UBIGINT / 4294967295.0 < 0.1 AS carved FROM documents),
fr AS (SELECT * EXCLUDE (split, carved), CASE WHEN split = 'train' AND carved THEN 'calibration' ELSE split END AS split FROM fz)"""


def frozen(spark, sf):
    d = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    found = S.rule_labels(F.lower("text"), RULES)
    split = S.group_split(42, "family", "source")
    flags = [F.array_contains(found, n).cast("int").alias(n) for n in RULES]
    return d.select(F.col("doc_id").alias("item_id"), *flags, F.size(found).alias("positive_label_count"), F.when((split == "train") & (S.stable_fraction("text") < 0.1), "calibration").otherwise(split).alias("split"))


@query("job5_frozen_labels", f"WITH {FROZEN} SELECT * FROM fr")
def job5_labels(spark, sf):
    """Every item with its rule labels, their number and its split; a tenth of the training items is carved out for calibration."""
    return frozen(spark, sf)


@query("job5_freeze_report", f"WITH {FROZEN}, u AS (" + " UNION ALL ".join(f"SELECT split, '{n}' AS label_id, {n} AS y FROM fr" for n in RULES) + ") SELECT split, label_id, count(*) AS n, sum(y) AS positives, round(avg(y), 6) AS rate FROM u GROUP BY 1, 2")
def job5_report(spark, sf):
    u = frozen(spark, sf).unpivot("split", list(RULES), "label_id", "y")
    return u.groupBy("split", "label_id").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), R(F.avg("y")).alias("rate"))


# ---- JOB9: the data checks in one table

CHECKS = f"""dx AS (SELECT doc_id AS item_id, text, source AS family, md5(text) AS h, {split_sql(42, 'item', 'doc_id')} AS sp FROM documents), tr AS (SELECT DISTINCT h FROM dx WHERE sp = 'train' AND h IS NOT NULL)"""


@query("job9_data_checks", f"WITH {CHECKS}, c AS (SELECT count(*) AS items, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank, count(*) - count(DISTINCT item_id) AS repeated_ids, count(h) - count(DISTINCT h) AS repeated_texts, count(*) FILTER (sp = 'test') AS test_items, count(*) FILTER (sp = 'test' AND h IN (SELECT h FROM tr)) AS exact_transfer, count(*) FILTER (sp = 'test' AND h IS NOT NULL AND h NOT IN (SELECT h FROM tr)) AS strict_zero FROM dx), f AS (SELECT count(*) AS split_families FROM (SELECT family FROM dx GROUP BY 1 HAVING count(DISTINCT sp) > 1)), l AS (SELECT count(*) AS unlabelled FROM dx WHERE item_id NOT IN (SELECT doc_id FROM labels)), o AS (SELECT count(*) AS orphan_labels FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) SELECT chk, n FROM (UNPIVOT (SELECT * FROM c, f, l, o) ON COLUMNS(*) INTO NAME chk VALUE n)")
def job9(spark, sf):
    """Counts of what would spoil an evaluation: blanks, repeats, texts and families on both sides, labels without items."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.trim("text").alias("t"), F.col("source").alias("family"), F.md5(F.col("text").cast("binary")).alias("h"), S.group_split(42, "item", "doc_id").alias("sp"))
    label = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id")).distinct()
    test = F.col("sp") == "test"
    by_text = d.where("h is not null").groupBy("h").agg(F.count("*").alias("n"), F.bool_or(F.col("sp") == "train").alias("train"), F.count_if(test).alias("test"))
    texts = by_text.agg(F.sum(F.col("n") - 1).alias("repeated_texts"), F.sum(F.when(F.col("train"), F.col("test")).otherwise(0)).alias("exact_transfer"), F.sum(F.when(~F.col("train"), F.col("test")).otherwise(0)).alias("strict_zero"))
    rows = d.agg(F.count("*").alias("items"), F.count_if(F.col("t").isNull() | (F.col("t") == "")).alias("blank"), F.count_if(test).alias("test_items"))
    ids = d.groupBy("item_id").count().agg(F.sum(F.col("count") - 1).alias("repeated_ids"))
    families = d.groupBy("family").agg(F.count_distinct("sp").alias("k")).agg(F.count_if(F.col("k") > 1).alias("split_families"))
    unlabelled = d.join(label, "item_id", "left_anti").agg(F.count("*").alias("unlabelled"))
    orphans = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id")).join(d, "item_id", "left_anti").agg(F.count("*").alias("orphan_labels"))
    one = rows.join(ids).join(texts).join(families).join(unlabelled).join(orphans)  # one row each
    return one.unpivot([], one.columns, "chk", "n")


# ---- JOB10: gold set

POSITIVES, NEGATIVES = 20, 10
GOLD = f"""WITH {SCORES}, x AS (SELECT s.*, length(bin(n_chars)) AS bits, sum(y) OVER (PARTITION BY s.item_id) - y > 0 AS other FROM scores s JOIN items USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY label_id, family, host, bits ORDER BY base DESC, item_id) AS rn FROM x WHERE y = 1), p AS (SELECT label_id, item_id, host, bits FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY rn, family, host, bits) AS k FROM r) WHERE k <= {POSITIVES}),
n AS (SELECT label_id, item_id, row_number() OVER (PARTITION BY label_id ORDER BY ((label_id, host) IN (SELECT (label_id, host) FROM p)) DESC, ((label_id, bits) IN (SELECT (label_id, bits) FROM p)) DESC, other DESC, item_id DESC) AS k FROM x WHERE y = 0),
u AS (SELECT label_id, item_id, 'positive' AS role FROM p UNION ALL SELECT label_id, item_id, 'hard_negative' FROM n WHERE k <= {NEGATIVES})"""


@query("job10_gold_set", GOLD + " SELECT label_id, item_id, role, 'G-' || lpad((row_number() OVER (ORDER BY md5('g|' || label_id || '|' || item_id)))::VARCHAR, 4, '0') AS blind_id FROM u")
def job10(spark, sf):
    """For each label 20 positives in turn over families, hosts and length classes, and 10 hard negatives: of the positives' hosts, then
    lengths, then with another label; under blind ids."""
    from corvane.operators.sampling import round_robin

    s = scores(spark, sf).join(items(spark, sf).select("item_id", F.length(F.bin("n_chars")).alias("bits")), "item_id")
    p = materialise(round_robin(s.where("y = 1"), "label_id", ["family", "host", "bits"], [F.desc("base"), F.col("item_id")], POSITIVES), "positives")
    other = s.groupBy("item_id").agg((F.sum("y") > 0).alias("other"))
    n = s.where("y = 0").join(other, "item_id")
    for c in ("host", "bits"):
        n = n.join(p.select("label_id", c).distinct().withColumn(f"same_{c}", F.lit(1)), ["label_id", c], "left")
    place = F.row_number().over(W.partitionBy("label_id").orderBy(F.coalesce("same_host", F.lit(0)).desc(), F.coalesce("same_bits", F.lit(0)).desc(), F.desc("other"), F.desc("item_id")))
    n = n.withColumn("k", place).where(F.col("k") <= NEGATIVES)
    u = p.select("label_id", "item_id", F.lit("positive").alias("role")).union(n.select("label_id", "item_id", F.lit("hard_negative")))
    key = F.md5(F.concat_ws("|", F.lit("g"), "label_id", F.col("item_id").cast("string")).cast("binary"))
    return u.select("label_id", "item_id", "role", F.format_string("G-%04d", F.row_number().over(W.orderBy(key))).alias("blind_id"))  # thirty rows a label
