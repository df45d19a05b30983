"""Queries: record scans over text that Spark derives from the stored tables, and the remaining features and models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions import scalar as S
from corvane.plans.fixtures import SCORES, scores
from corvane.plans.registry import query
from corvane.session import scratch, table
from corvane.sources import records

R = lambda c, n=6: F.round(c, n)


@query("src1_delimited_round_trip", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def src1(spark, sf):
    path = scratch(spark, "nation") + "/t.tsv"
    records.write_delimited(table(spark, sf, "nation"), path, ["n_nationkey", "n_name"], gz=True)
    return records.delimited(spark, path, "n_nationkey string, n_name string")


@query("src3_sequence_records", "SELECT 'p' || p_partkey AS id, regexp_replace(upper(p_name || p_type), '[^A-Z]', '', 'g') AS sequence, length(regexp_replace(upper(p_name || p_type), '[^A-Z]', '', 'g')) AS length FROM part")
def src3(spark, sf):
    path = scratch(spark, "sequences") + "/f"
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat("p_name", "p_type").alias("sequence"))
    records.write_sequences(p, path)
    return records.sequence_records(spark, path).select("id", "sequence", F.col("length").cast("bigint").alias("length"))


@query("src5_locations", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, least(l_partkey, l_suppkey)::INT AS start, (CASE WHEN l_linenumber % 3 = 0 THEN greatest(l_partkey, l_suppkey) + 100 ELSE greatest(l_partkey, l_suppkey) END)::INT AS end_, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS strand, CASE WHEN l_linenumber % 3 = 0 THEN 'join' ELSE 'simple' END AS kind, CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 1 END AS parts, l_linenumber % 5 = 0 AS partial_left, l_linenumber % 7 = 0 AS partial_right FROM lineitem")
def src5(spark, sf):
    li = table(spark, sf, "lineitem")
    n, low, high = F.col("l_linenumber"), F.least("l_partkey", "l_suppkey").cast("string"), F.greatest("l_partkey", "l_suppkey")
    one = F.concat(F.when(n % 5 == 0, "<").otherwise(""), low, F.lit(".."), F.when(n % 7 == 0, ">").otherwise(""), high.cast("string"))
    two = F.concat(F.lit("join("), one, F.lit(",A12.1:"), high.cast("string"), F.lit(".."), (high + 100).cast("string"), F.lit(")"))
    text = F.when(n % 3 == 0, two).otherwise(one)
    text = F.when(n % 2 == 0, F.concat(F.lit("complement("), text, F.lit(")"))).otherwise(text)
    loc = records.location("loc")
    return li.withColumn("loc", text).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", loc["start"].alias("start"), loc["end"].alias("end_"), *(loc[c].alias(c) for c in ("strand", "kind", "parts", "partial_left", "partial_right")))


@query("src2_capped_rows", "SELECT least(count(*), 12) AS n, min(length(n_name)) >= 1 AS named FROM nation")
def src2(spark, sf):
    """The row cap of a scan: it is the feature."""
    path = scratch(spark, "capped") + "/t.tsv"
    records.write_delimited(table(spark, sf, "nation"), path, ["n_name", "n_nationkey"])
    few = records.delimited(spark, path, "n_name string, n_nationkey string", most=12)
    return few.agg(F.count("*").alias("n"), (F.min(F.length("n_name")) >= 1).alias("named"))


@query("src4_flat_records", "SELECT 'O' || o_orderkey AS accession, o_orderpriority AS definition, (o_orderkey % 900 + 90)::INT AS length, o_custkey::VARCHAR AS taxon, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS host, coalesce(n, 0) AS features, coalesce(back, 0) AS complements, coalesce(product, '') AS product FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS back, min(l_returnflag || ' ' || l_linestatus) AS product FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def src4(spark, sf):
    """Orders as annotated flat records with their lines as features, written and parsed again."""
    path = scratch(spark, "flat") + "/f"
    li = table(spark, sf, "lineitem")
    back = F.col("l_returnflag") == "R"
    place = F.concat(F.col("l_linenumber").cast("string"), F.lit(".."), F.col("l_partkey").cast("string"))
    gene = F.concat(F.lit("     CDS             "), F.when(back, F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(place), F.lit('\n                     /gene="g'), F.col("l_linenumber").cast("string"), F.lit('"\n                     /product="'), F.col("l_returnflag"), F.lit("\n                     "), F.col("l_linestatus"), F.lit('"\n                     /db_xref="a:1"\n                     /db_xref="b:2"'))
    genes = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.concat_ws("\n", F.array_sort(F.collect_list(gene))).alias("genes"))  # lines of one order
    o, key = table(spark, sf, "orders").join(genes, "o_orderkey", "left"), F.col("o_orderkey").cast("string")
    length = (F.col("o_orderkey") % 900 + 90).cast("string")
    host = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('\n                     /host="'), "o_orderstatus", F.lit('"'))).otherwise("")
    head = F.concat(F.lit("LOCUS       O"), key, F.lit("   "), length, F.lit(" bp    DNA     linear\nDEFINITION  "), "o_orderpriority", F.lit("\nACCESSION   O"), key, F.lit("\nFEATURES             Location/Qualifiers\n     source          1.."), length, host, F.lit('\n                     /db_xref="taxon:'), F.col("o_custkey").cast("string"), F.lit('"\n'))
    o.select(F.concat(head, F.coalesce(F.concat("genes", F.lit("\n")), F.lit("")), F.lit("ORIGIN\n        1 acgt\n//"))).write.mode("overwrite").text(path)
    genes = F.filter("features", lambda x: x["type"] == "CDS")
    products = F.transform(genes, lambda x: F.element_at(F.try_element_at(x["qualifiers"], F.lit("product")), 1))
    return records.flat_records(spark, path).select("accession", "definition", "length", "source.taxon", "source.host", F.size(genes).cast("bigint").alias("features"), F.size(F.filter(genes, lambda x: F.contains(x["location"], F.lit("complement")))).cast("bigint").alias("complements"), F.coalesce(F.array_min(products), F.lit("")).alias("product"))


@query("src4_feature_rows", """SELECT 'O' || l_orderkey AS accession, o_custkey::VARCHAR AS taxon, l_linenumber::BIGINT AS line, 'g' || l_linenumber AS gene, 'status "' || l_linestatus || '" of /part=' || l_partkey AS note, l_suppkey || ' and more' AS product, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 3 END AS codon_start,
CASE WHEN l_returnflag = 'R' THEN 'partial,pseudo' ELSE '' END AS flags, (l_linenumber + 60)::INT AS translation_length, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand, least(l_linenumber, l_partkey)::INT AS start, greatest(l_linenumber, l_partkey)::INT AS end_ FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def src4_features(spark, sf):
    """Features with quoted, doubly quoted, wrapped, bare and valueless qualifiers, written and parsed again. Texts are made where they are
    written, so that lines travel as numbers, and files are compressed: a feature takes half a kilobyte as text."""
    path, pad = scratch(spark, "features") + "/f", "\n                     "

    def gene(line):
        text = lambda c: line[c].cast("string")
        back, n = line["l_returnflag"] == "R", line["l_linenumber"]
        place = F.concat(text("l_linenumber"), F.lit(".."), text("l_partkey"))
        place = F.when(back, F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(place)
        return F.concat(
            F.lit("     CDS             "), place, F.lit(f'{pad}/gene="g'), text("l_linenumber"), F.lit(f'"{pad}/note="status ""'), line["l_linestatus"], F.lit(f'"" of{pad}/part='), text("l_partkey"), F.lit(f'"{pad}/product="'),
            text("l_suppkey"), F.lit(f' and{pad}more"'), F.when(back, f"{pad}/pseudo{pad}/partial").otherwise(""), F.when(n % 3 > 0, F.concat(F.lit(f"{pad}/codon_start="), (n % 3).cast("string"))).otherwise(""),
            F.lit(f'{pad}/translation="'), F.repeat(F.lit("M"), F.lit(60)), F.lit(pad), F.repeat(F.lit("K"), n), F.lit(f'"{pad}/locus_tag="'), text("l_linenumber"), F.lit('"'),
        )

    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))  # lines of one order
    o, text = table(spark, sf, "orders").join(lines, "o_orderkey"), lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("LOCUS       O"), text("o_orderkey"), F.lit("   9 bp    DNA     linear\nACCESSION   O"), text("o_orderkey"), F.lit('\nFEATURES             Location/Qualifiers\n     source          1..9\n                     /db_xref="taxon:'), text("o_custkey"), F.lit('"\n'))
    genes = F.concat_ws("\n", F.array_sort(F.transform("lines", gene)))
    records.write_flat(o.select(F.concat(head, genes, F.lit("\nORIGIN\n        1 acgt\n//"))), path)
    f = records.feature_rows(records.flat_records(spark, path))
    return f.select("accession", "taxon", F.col("locus_tag").cast("bigint").alias("line"), "gene", "note", "product", "codon_start", F.concat_ws(",", "flags").alias("flags"), "translation_length", "strand", "start", F.col("end").alias("end_"))


RUNS = """r AS (SELECT split_part(p_brand, '#', 2)::BIGINT AS run, count(*) AS n, avg(p_size) AS size, avg(p_retailprice) / 3000 AS ap, max(p_size) AS epoch FROM part GROUP BY 1)"""


@query("src9_run_registry", f"WITH {RUNS} SELECT 'run=' || run AS run_name, CASE WHEN run % 2 = 0 THEN 'full' ELSE 'sequence' END AS task_mode, 'family' AS split_scheme, CASE WHEN run % 3 = 0 THEN '' ELSE 'b' || run % 4 END AS sequence_backbone, run % 5 < 2 AS with_biophysics, CASE WHEN run % 5 < 2 THEN 'taxonomy,neighbours' ELSE '' END AS selected_context_blocks, CASE WHEN run % 7 = 0 THEN 'shuffled' ELSE 'none' END AS context_control, CASE WHEN run % 3 = 0 THEN 0.2 END AS host_corruption_fraction, CASE WHEN run % 3 = 0 THEN n ELSE 0 END AS host_corrupted_count, epoch AS best_epoch, round(ap, 6) AS validation_ap, CASE WHEN run % 2 = 0 THEN round(ap / 2, 6) END AS test_ap, CASE WHEN run % 2 = 0 THEN round(size, 4) END AS test_f1, run % 6 = 0 AS nested FROM r WHERE run % 4 <> 3")
def src9(spark, sf):
    """Brands as runs in nested folders whose files lack fields in turn, scanned into one table; runs without metrics are no rows."""
    root = scratch(spark, "runs")
    run = F.col("run")
    when = lambda c, x: F.when(c, x)
    r = table(spark, sf, "part").groupBy(F.split("p_brand", "#")[1].cast("bigint").alias("run")).agg(F.count("*").alias("n"), F.avg("p_size").alias("size"), (F.avg("p_retailprice") / 3000).alias("ap"), F.max("p_size").cast("bigint").alias("epoch"))
    has, blocks = run % 4 != 3, run % 5 < 2
    r = r.select(
        "run", F.when(run % 6 == 0, "deep").otherwise("flat").alias("suite"),
        F.when(run % 2 == 0, "full").otherwise("sequence").alias("task_mode"), F.struct(F.lit("family").alias("scheme"), F.lit(42).alias("seed")).alias("split_strategy"),
        when(run % 3 != 0, F.concat(F.lit("b"), (run % 4).cast("string"))).alias("sequence_backbone"), when(blocks, F.array(F.lit("length"))).alias("biophysics_fields"),
        when(blocks, F.array(F.lit("taxonomy"), F.lit("neighbours"))).alias("selected_context_blocks"), when(run % 7 == 0, "shuffled").alias("context_control"),
        when(run % 3 == 0, 0.2).alias("host_corruption_fraction"), when(run % 3 == 0, F.col("n")).alias("host_corrupted_count"), F.lit("x").alias("notes"),
        when(has, F.col("epoch")).alias("best_epoch"), when(has, F.struct(R("ap").alias("macro_average_precision"))).alias("validation"),
        when(has & (run % 2 == 0), F.struct(R(F.col("ap") / 2).alias("macro_average_precision"), R("size", 4).alias("macro_f1"), F.lit(1).alias("other"))).alias("test"),
    )
    for suite, folders in (("flat", ["run"]), ("deep", ["suite", "run"])):
        part = r.where(F.col("suite") == suite)
        names = [c for c in r.columns if c not in ("run", "suite", "best_epoch", "validation", "test")]
        records.write_runs(part, f"{root}/{suite}", folders, names, ["best_epoch", "validation", "test"])
    t = records.run_registry(spark, root)
    return t.select(*t.columns[:10], F.col("validation_macro_average_precision").alias("validation_ap"), F.col("test_macro_average_precision").alias("test_ap"), F.col("test_macro_f1").alias("test_f1"), F.contains("run_dir", F.lit("suite=deep")).alias("nested"))


@query("snk1_delimited", "SELECT doc_id::VARCHAR AS doc_id, source, n_chars::VARCHAR AS n_chars, count(*) OVER ()::VARCHAR AS rows FROM documents")
def snk1(spark, sf):
    """A compressed table with a fixed order of columns, further ones left out, read back as text."""
    path = scratch(spark, "sink") + "/t.tsv.gz"
    records.write_delimited(table(spark, sf, "documents").withColumn("extra", F.lit("x")), path, ["source", "doc_id", "n_chars"], gz=True)
    t = records.delimited(spark, path)
    if t.columns != ["source", "doc_id", "n_chars"]:
        raise ValueError(f"columns came back as {t.columns}")
    return t.join(F.broadcast(t.agg(F.count("*").cast("string").alias("rows"))))  # one row


@query("src6_atom_quality", "SELECT l_returnflag AS model, count(DISTINCT l_orderkey % 9999) AS residues, round(avg(l_quantity + 45), 4) AS mean, round(median(l_quantity + 45), 4) AS median, round(avg((l_quantity + 45 >= 70)::INT), 6) AS high, round(avg((l_quantity + 45 >= 90)::INT), 6) AS very_high FROM lineitem GROUP BY 1")
def src6(spark, sf):
    """Lines as fixed-width atoms, one model for each return flag."""
    path = scratch(spark, "atoms") + "/a"
    residue = F.lpad((F.col("l_orderkey") % 9999).cast("string"), 4, " ")
    line = F.concat(F.lit("ATOM  "), F.lit("    1"), F.lit("  CA  ALA A"), residue, F.lit("       0.000   0.000   0.000  1.00"), F.lpad(F.format_string("%.2f", F.col("l_quantity") + 45), 6, " "))
    table(spark, sf, "lineitem").select(line.alias("value"), F.col("l_returnflag").alias("model")).write.mode("overwrite").partitionBy("model").text(path)
    q = records.atom_quality(spark, path, r"model=([^/]*)/")
    return q.select("model", "residues", R("mean", 4).alias("mean"), R("median", 4).alias("median"), R("high").alias("high"), R("very_high").alias("very_high"))


@query("snk3_wrapped_sequences", "WITH s AS (SELECT 'p' || p_partkey AS id, regexp_replace(upper(repeat(p_name || p_type, 9)), '[^A-Z]', '', 'g') AS s FROM part) SELECT id, length(s) AS length, ceil(length(s) / 80.0)::BIGINT AS lines, least(80, length(s)) AS widest FROM s")
def snk3(spark, sf):
    """Sequences longer than a line: the lines of each record and the widest of them."""
    path = scratch(spark, "wrapped") + "/f"
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.repeat(F.concat("p_name", "p_type"), F.lit(9)).alias("sequence"))
    records.write_sequences(p, path)
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.split(F.regexp_replace("value", r"^>|\n$", ""), "\n").alias("l"))
    body = F.transform(F.slice("l", F.lit(2), F.size("l")), F.length)
    return rec.select(F.col("l")[0].alias("id"), F.aggregate(body, F.lit(0), lambda a, x: a + x).cast("bigint").alias("length"), F.size(body).cast("bigint").alias("lines"), F.array_max(body).cast("bigint").alias("widest"))


@query("src7_hierarchy_dump", "SELECT n_nationkey::VARCHAR AS id, n_regionkey::VARCHAR AS parent, n_name AS name FROM nation")
def src7(spark, sf):
    path = scratch(spark, "dump") + "/d"
    n = table(spark, sf, "nation")
    n.select(F.concat(F.col("n_nationkey").cast("string"), F.lit("\t|\t"), F.col("n_regionkey").cast("string"), F.lit("\t|\t"), F.col("n_name"), F.lit("\t|"))).write.mode("overwrite").text(path)
    return records.dump(spark, path, ["id", "parent", "name"])


@query("src8_hit_table", "SELECT l_orderkey::VARCHAR AS query, l_suppkey::VARCHAR AS target, CASE WHEN l_linenumber > 1 THEN l_linenumber::VARCHAR END AS pident FROM lineitem")
def src8(spark, sf):
    path = scratch(spark, "hits") + "/h"
    li = table(spark, sf, "lineitem")
    line = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("string")))
    li.select(line).write.mode("overwrite").text(path)
    return records.hit_table(spark, path).select("query", "target", "pident")


@query("snk2_report", "SELECT count(*) AS n, count(DISTINCT source) AS families, array_to_string((SELECT list(source ORDER BY c DESC, source) FROM (SELECT source, count(*) AS c FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)), ',') AS top FROM documents")
def snk2(spark, sf):
    d = table(spark, sf, "documents")
    top = d.groupBy("source").count().orderBy(F.desc("count"), "source").limit(20)
    top = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "source"))), lambda x: x["source"]).alias("l"))
    r = d.agg(F.count("*").alias("n"), F.count_distinct("source").alias("families")).join(top)
    path = scratch(spark, "report") + "/r"
    records.write_report(r, path)
    return spark.read.schema("n bigint, families bigint, l array<string>").json(path).select("n", "families", F.concat_ws(",", "l").alias("top"))
