"""Nearest neighbours by shared k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.session import materialise

#: Distinct query runs of at most so many rows are broadcast to the scan of the targets; more are joined by a shuffle.
FEW = 500_000
#: A run in more targets than this is common: it is never joined target by target.
COMMON = 256


def _runs(words: int) -> tuple[Column, Column]:
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1)))
    return w, F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, words)))))


def _kmers(df: DataFrame, name: str, words: int) -> DataFrame:
    w, runs = _runs(words)
    return df.select(F.col("id").alias(name), w.alias("w")).select(name, F.size(runs).alias(f"n_{name}"), F.explode(runs).alias("k"))


def shared_kmers(queries: DataFrame, targets: DataFrame, words: int = 5) -> DataFrame:
    """``(query, target, shared, identity)`` of (id, text) tables: equal runs of words, and the share of the query's. Both sides keep
    distinct runs only. Few query runs travel to the targets, whose other runs never leave the scan."""
    q, t = materialise(_kmers(queries, "query", words), "runs"), _kmers(targets, "target", words).select("target", "k")
    j = t.join(F.broadcast(q), "k") if q.count() <= FEW else t.join(q, "k")
    return j.groupBy("query", "target").agg(F.count("*").alias("shared"), F.first("n_query").alias("n")).select("query", "target", "shared", (F.col("shared") / F.col("n")).alias("identity"))


def nearest_by_kmers(queries: DataFrame, targets: DataFrame, words: int = 5, common: int = COMMON) -> DataFrame:
    """The target that shares most runs with each query, the least id on a tie; queries that share none are left out.

    Runs are taken by rarity. A rare run (in ``common`` targets at most) leads to the targets that have it; these are scored in
    full, common runs by comparing the two texts' sets of them. Targets that share common runs only stand in classes of
    equal sets of common runs, of which the least id counts, and queries in classes of equal sets likewise. A query whose
    best score exceeds the number of its common runs is done. For the others classes meet on their rarest common runs
    first: a class that shares ``best`` of n runs has one of the rarest ``n - best + 1``, so each found score shortens what is
    left to look at. A run that all texts have costs one row a text.
    """
    q = materialise(_kmers(queries, "query", words), "runs")
    wanted = q.select("k").distinct()
    t = _kmers(targets, "target", words).select("target", "k")
    found = t.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "k", "left_semi")
    found = materialise(found, "postings")
    held = found.groupBy("k").agg(F.count("*").alias("df"))
    held = materialise(held, "rarity")
    often = held.where(F.col("df") > common).select("k")

    # rare runs: every pair that shares one, with what both share of the common ones
    q_rare = q.join(held.where(F.col("df") <= common), "k").select("query", "k")
    pairs = q_rare.join(found, "k").groupBy("query", "target").agg(F.count("*").alias("rare"))
    own = lambda df, who: df.join(often, "k", "left_semi").groupBy(who).agg(F.array_sort(F.collect_list("k")).alias(f"c_{who}"))
    q_sets, t_sets = materialise(own(q, "query"), "query-sets"), materialise(own(found, "target"), "target-sets")
    both = pairs.join(q_sets, "query", "left").join(t_sets, "target", "left")
    shared = F.col("rare") + F.coalesce(F.size(F.array_intersect("c_query", "c_target")), F.lit(0))
    first = F.max(F.struct(shared.cast("bigint").alias("shared"), (-F.col("target")).alias("t")))
    best = materialise(both.groupBy("query").agg(first.alias("b")).select("query", "b.*"), "best")

    # targets that share common runs only: classes of equal sets
    joined = q_sets.join(best, "query", "left").select("query", "c_query", F.coalesce("shared", F.lit(0)).alias("at_least")).where(F.col("at_least") <= F.size("c_query"))
    open_ = materialise(joined.withColumn("class", F.xxhash64("c_query")), "open")
    asks = open_.groupBy("class").agg(F.first("c_query").alias("c"), F.greatest(F.min("at_least"), F.lit(1)).alias("best"))
    kinds = t_sets.groupBy(F.xxhash64("c_target").alias("kind")).agg(F.first("c_target").alias("c"), F.min("target").alias("target"))
    kinds = materialise(kinds, "kinds")
    spread = kinds.select("kind", F.explode("c").alias("k"))
    rarity = spread.groupBy("k").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("class").orderBy("df", "k"))
    asked = materialise(asks.select("class", F.explode("c").alias("k")).join(rarity, "k").select("class", "k", place.alias("at")), "asked")
    state = materialise(asks.select("class", "c", F.size("c").alias("n"), "best", F.lit(None).cast("bigint").alias("t")), "classes")
    done, size = 0, 1
    while True:
        live = state.where((F.col("n") - F.col("best") + 1) > done).select("class", "c", (F.col("n") - F.col("best") + 1).alias("last"))
        if live.isEmpty():
            break
        now = asked.where((F.col("at") > done) & (F.col("at") <= done + size)).join(live, "class").where(F.col("at") <= F.col("last"))
        met = now.select("class", "k").join(spread, "k").select("class", "kind").distinct()
        scored = met.join(state.select("class", "c"), "class").join(kinds.select("kind", F.col("c").alias("other"), "target"), "kind")
        scored = scored.groupBy("class").agg(F.max(F.struct(F.size(F.array_intersect("c", "other")).cast("bigint").alias("shared"), (-F.col("target")).alias("t"))).alias("b"))
        old = F.struct(F.col("best").cast("bigint").alias("shared"), F.col("t"))
        new = F.when(F.col("b").isNotNull() & ((F.col("b.shared") > F.col("best")) | ((F.col("b.shared") == F.col("best")) & F.coalesce(F.col("b.t") > F.col("t"), F.lit(True)))), F.col("b")).otherwise(old)
        state = state.join(scored, "class", "left").select("class", "c", "n", new.alias("x")).select("class", "c", "n", F.col("x.shared").cast("int").alias("best"), F.col("x.t").alias("t"))
        state, done, size = materialise(state, "classes"), done + size, 2 * size
    from_classes = open_.join(state.where("t is not null"), "class").select("query", F.col("best").cast("bigint").alias("shared"), "t")
    top = best.unionByName(from_classes).groupBy("query").agg(F.max(F.struct("shared", "t")).alias("x"))
    sizes = q.groupBy("query").agg(F.first("n_query").alias("n"))
    return top.join(sizes, "query").select("query", (-F.col("x.t")).alias("target"), F.col("x.shared").alias("shared"), (F.col("x.shared") / F.col("n")).alias("identity"))
