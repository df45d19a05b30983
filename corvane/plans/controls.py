"""Queries: control samples (SMP9, SMP10, SMP12): donors and shuffles that keep what they should not destroy."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import scalar as S
from corvane.operators.sampling import corrupt_fraction, shuffle_within
from corvane.plans.features import SEQ, order, sequences
from corvane.plans.fixtures import bucket_sql
from corvane.plans.jobs import SORT
from corvane.plans.registry import query
from corvane.session import table


@query("smp9_shuffle_in_family", "WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY md5('s|' || doc_id), doc_id) AS b, count(*) OVER (PARTITION BY source) AS n FROM documents), m AS (SELECT source, bool_or(a <> b) AS moved FROM r GROUP BY 1), w AS (SELECT r.*, CASE WHEN moved THEN a ELSE a % n + 1 END AS want FROM r JOIN m USING (source)) SELECT x.doc_id, y.lang AS donor_lang FROM w x JOIN r y ON x.source = y.source AND x.want = y.b")
def smp9(spark, sf):
    return shuffle_within(table(spark, sf, "documents").select("doc_id", "source", "lang"), "source", "doc_id", "s").select("doc_id", "donor_lang")


@query("smp10_corrupt_fraction", f"WITH r AS (SELECT doc_id, source, lang, row_number() OVER (ORDER BY md5('c|' || doc_id), doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS a, count(*) OVER (PARTITION BY source) AS nf, row_number() OVER (ORDER BY doc_id) AS g, count(*) OVER () AS n FROM documents), c AS (SELECT *, h <= round_even(n * 0.2, 0) AS chosen FROM r), d AS (SELECT *, CASE WHEN chosen AND nf > 1 THEN (a - 1 + 1 + ('0x' || substr(md5('d|' || doc_id), 1, 8))::UBIGINT::BIGINT % greatest(nf - 1, 1)) % nf + 1 END AS near, CASE WHEN chosen AND nf = 1 AND n > 1 THEN (g - 1 + 1 + ('0x' || substr(md5('d|' || doc_id), 1, 8))::UBIGINT::BIGINT % greatest(n - 1, 1)) % n + 1 END AS far FROM c) SELECT d.doc_id, coalesce(x.lang, y.lang, d.lang) AS lang, coalesce(x.doc_id, y.doc_id) AS donor FROM d LEFT JOIN r x ON d.source = x.source AND d.near = x.a LEFT JOIN r y ON d.far = y.g")
def smp10(spark, sf):
    """A fifth of the documents, by the lowest hashes, take the language of another document of their source, else of any."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return corrupt_fraction(d, "doc_id", "source", ["lang"], 0.2).select("doc_id", "lang", "donor")


SLOT = ", ".join(f"CASE WHEN {'lag' if k < 0 else 'lead'}(q, {abs(k)}) OVER w IS NOT NULL THEN struct_pack(h := md5('w|' || row_order || '|' || ({k})), k := {k}, q := {'lag' if k < 0 else 'lead'}(q, {abs(k)}) OVER w) END" for k in (-2, -1, 1, 2))


@query("smp12_local_swap", f"WITH {SEQ}, t AS (SELECT seq, row_order, coalesce(lag(kind) OVER w, '__START__') AS p, coalesce(lead(kind) OVER w, '__END__') AS n, list_filter([{SLOT}], lambda x: x IS NOT NULL) AS o FROM seqs WINDOW w AS ({SORT})), u AS (SELECT *, list_sort(o) AS z, {bucket_sql("'w|' || row_order")} < 5000 AS sw FROM t), v AS (SELECT *, CASE WHEN len(o) > 1 AND list_transform(o, lambda x: x.k) = list_transform(z, lambda x: x.k) THEN list_concat(z[len(z):len(z)], z[1:len(z) - 1]) ELSE z END AS y FROM u) SELECT seq, row_order, CASE WHEN sw THEN n ELSE p END AS prev, CASE WHEN sw THEN p ELSE n END AS next, array_to_string(list_transform(y, lambda x: x.q), ',') AS slots FROM v")
def smp12(spark, sf):
    """Each item's previous and next kinds swap with probability one half; its occupied neighbour slots change places."""
    w = order()
    key = lambda k: F.md5(F.concat(F.lit("w|"), F.col("row_order").cast("string"), F.lit(f"|{k}")).cast("binary"))
    at = lambda c, k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)
    slots = F.array_compact(F.array(*(F.when(at("q", k).isNotNull(), F.struct(key(k).alias("h"), F.lit(k).alias("k"), at("q", k).alias("q"))) for k in (-2, -1, 1, 2))))
    s = sequences(spark, sf).select("seq", "row_order", F.coalesce(F.lag("kind").over(w), F.lit("__START__")).alias("p"), F.coalesce(F.lead("kind").over(w), F.lit("__END__")).alias("n"), slots.alias("o"))
    z = F.array_sort("o")
    same = (F.size("o") > 1) & (F.transform("o", lambda x: x["k"]) == F.transform(z, lambda x: x["k"]))
    moved = F.when(same, F.concat(F.slice(z, -1, 1), F.slice(z, F.lit(1), F.size(z) - 1))).otherwise(z)
    swap = S.stable_bucket(F.concat(F.lit("w|"), F.col("row_order").cast("string"))) < 5000
    return s.select("seq", "row_order", F.when(swap, F.col("n")).otherwise(F.col("p")).alias("prev"), F.when(swap, F.col("p")).otherwise(F.col("n")).alias("next"), F.concat_ws(",", F.transform(moved, lambda x: x["q"].cast("string"))).alias("slots"))
