"""Modules: windows of a sequence with mean vectors, their density clusters, and what the clusters show.

The chain: every item is the centre of a window; the vectors of the window's members are averaged; the means are clustered
by density; clusters are summed up and ranked; size-weighted measures of all clusters are held against clusters dealt at
random. Noise (-1) belongs to no cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from corvane.operators.vectors import density_clusters
from corvane.session import materialise, shuffle_width

#: Modules that are dealt at once inside a task.
SLICE = 1 << 20


def mean_vectors(list_of_vectors: Column) -> Column:
    """The mean of an array of vectors of one length, nulls left out; null without vectors."""
    some = F.filter(list_of_vectors, lambda v: v.isNotNull())
    total = F.aggregate(F.slice(some, F.lit(2), F.greatest(F.size(some) - 1, F.lit(0))), F.get(some, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(F.size(some) > 0, F.transform(total, lambda x: x / F.size(some)))


def module_windows(rows: DataFrame, order: WindowSpec, radius: int, member: str, kind: str, vector: str, unknown: Column, vote: Column, label: str, sensitive: list[str]) -> DataFrame:
    """The rows with ``members``, ``signature``, ``unknown_ratio``, ``vote_fraction``, ``sensitive_fraction`` (members whose label is
    in ``sensitive``, of those with a label) and ``v``, the mean vector; windows without a vector are left out."""
    w = order.rowsBetween(-radius, radius)
    named = F.count(label).over(w)
    out = rows.select(
        "*",
        F.collect_list(member).over(w).alias("members"),
        F.concat_ws("|", F.collect_list(F.coalesce(F.col(kind), F.lit("__missing__"))).over(w)).alias("signature"),
        F.avg(unknown.cast("int")).over(w).alias("unknown_ratio"),
        F.avg(vote.cast("int")).over(w).alias("vote_fraction"),
        F.coalesce(F.try_divide(F.count_if(F.col(label).isin(sensitive)).over(w), named), F.lit(0.0)).alias("sensitive_fraction"),
        F.collect_list(F.col(vector).cast("array<double>")).over(w).alias("_all"),
    )
    return out.withColumn("v", mean_vectors(F.col("_all"))).drop("_all").where("v is not null")


def module_clusters(windows: DataFrame, centre: str, similarity: float = 0.85, least: int = 5) -> DataFrame:
    """The windows with ``cluster``; ``centre`` is a unique whole number."""
    found = density_clusters(windows, similarity, least, centre, "v")
    return windows.drop("v").join(found.withColumnRenamed("id", centre), centre)


def cluster_rollup(modules: DataFrame, family: str) -> DataFrame:
    """``(cluster, module_count, family_count, unknown_ratio, vote_fraction, sensitive_fraction, consistency, top_signature, priority)``: the
    most frequent signature, the least one on a tie; noise is left out."""
    own = modules.where("cluster >= 0")
    shapes = own.groupBy("cluster", "signature").agg(F.count("*").alias("n"))
    top = shapes.groupBy("cluster").agg(F.max("n").alias("top"), F.min_by("signature", F.struct(-F.col("n"), "signature")).alias("top_signature"))
    g = own.groupBy("cluster").agg(F.count("*").alias("module_count"), F.count_distinct(F.when(F.col(family) != "", F.col(family))).alias("family_count"), *(F.avg(c).alias(c) for c in ("unknown_ratio", "vote_fraction", "sensitive_fraction")))
    g = g.join(top, "cluster").withColumn("consistency", F.col("top") / F.col("module_count"))
    return g.drop("top").withColumn("priority", F.col("family_count") + 2 * F.col("unknown_ratio") + F.col("vote_fraction") + F.col("consistency"))


def cluster_metrics(rollup: DataFrame) -> DataFrame:
    """One row: clusters, modules, and means over the clusters weighted by their sizes; the mean of the families a cluster has is plain."""
    total = F.sum("module_count")
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("module_count")), total), F.lit(0.0)).alias(f"weighted_{c}")
    return rollup.agg(F.count("*").alias("cluster_count"), F.coalesce(total, F.lit(0)).alias("module_count"), *(weighted(c) for c in ("consistency", "unknown_ratio", "vote_fraction", "sensitive_fraction")), F.coalesce(F.avg("family_count"), F.lit(0.0)).alias("mean_family_count"))


def _dealt(rng: np.random.Generator, sizes: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Modules, ``kinds`` of them of each kind, dealt at random to clusters of the given rising sizes: arrays (cluster, kind, count) of those that
    meet, by cluster. A portion has about ``SLICE`` modules or one cluster; what it gets of each kind is drawn first, so no table of all is held."""
    left, part = kinds.copy(), (np.cumsum(sizes) - sizes) // SLICE
    edges = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (sizes[1:] > SLICE))) if len(sizes) else []
    for a, b in zip(edges, [*edges[1:], len(sizes)]):
        own = sizes[a:b]
        got = rng.multivariate_hypergeometric(left, own.sum(), method="marginals")
        left -= got
        if 4 * (b - a) * len(kinds) <= own.sum() or b - a == 1:  # few cells: drawn one by one
            table = np.zeros((b - a, len(kinds)), np.int64)
            for c, n in enumerate(own[:-1]):
                table[c] = rng.multivariate_hypergeometric(got, n, method="marginals")
                got -= table[c]
            table[-1] = got
            cluster, kind = np.nonzero(table)
            yield cluster + a, kind, table[cluster, kind]
        else:
            key = np.sort(np.repeat(np.arange(a, b), own) * len(kinds) + rng.permutation(np.repeat(np.arange(len(kinds)), got)))
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            yield key[at] // len(kinds), key[at] % len(kinds), np.diff(np.append(at, len(key)))


def cluster_null(modules: DataFrame, family: str, iterations: int = 500, seed: int = 42) -> DataFrame:
    """``(metric, observed, null_mean, null_low, null_high, p)``: the measures of ``cluster_metrics`` against clusters of the same
    sizes dealt anew, noise among them; p counts the observed one in.

    A measure sees a module by one property only (its signature, its family, its share). For a share it matters only what all clusters get
    together, one draw from a multivariate hypergeometric law; for signatures and families only how many clusters have each size and how many
    kinds each count, so these few numbers travel, and modules are dealt inside tasks. An iteration costs the modules, or clusters by
    kinds where that is less; a task holds one number for each cluster and kind, and a slice of the modules.
    """
    spark = modules.sparkSession

    def repeats(groups: DataFrame) -> tuple[np.ndarray, np.ndarray]:  # counts and how often each occurs: at most the root of twice the modules
        rows = groups.groupBy("n").agg(F.count("*").alias("many")).orderBy("n").collect()
        return np.array([r["n"] for r in rows], np.int64), np.array([r["many"] for r in rows], np.int64)

    kinds = lambda column: modules.groupBy(F.col(column).alias("kind")).agg(F.count("*").alias("n"))
    named = F.coalesce("kind", F.lit("")) != ""
    unnamed = kinds(family).where(~named).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shares = {c: kinds(c).orderBy("kind").toArrow() for c in ("unknown_ratio", "vote_fraction", "sensitive_fraction")}  # one row for each value
    shares = {c: (t["kind"].to_numpy().astype(float), t["n"].to_numpy().astype(np.int64)) for c, t in shares.items()}
    names = sorted(["consistency", "family_count", *shares])
    shipped = spark.sparkContext.broadcast((repeats(modules.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"))), repeats(kinds("signature")), repeats(kinds(family).where(named)), unnamed, shares))

    def run(batches):
        sizes, signatures, families, unnamed, shares = shipped.value
        sizes, signatures, families = (np.repeat(*x) for x in (sizes, signatures, families))
        families = np.append(families, unnamed)  # the last kind is none
        total = int(sizes.sum())

        def value(rng, metric):
            if metric in shares:
                kinds, counts = shares[metric]
                return float(rng.multivariate_hypergeometric(counts, total, method="marginals") @ kinds) / max(total, 1)
            if metric == "consistency":
                best = (np.maximum.reduceat(n, np.flatnonzero(np.append(True, c[1:] != c[:-1]))).sum() for c, _, n in _dealt(rng, sizes, signatures))
                return int(sum(best)) / max(total, 1)
            return int(sum((kind < len(families) - 1).sum() for _, kind, _ in _dealt(rng, sizes, families))) / max(len(sizes), 1)

        for batch in batches:
            out = [(it, metric, value(np.random.default_rng([seed, it, m]), metric)) for it in batch.column(0).to_pylist() for m, metric in enumerate(names)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64())], ["iter", "metric", "v"])

    null = spark.range(0, iterations, 1, min(iterations, 2 * shuffle_width(spark))).mapInArrow(run, "iter long, metric string, v double")
    null = materialise(null.withColumn("v", F.round("v", 9)), "null")
    seen = cluster_metrics(cluster_rollup(modules, family)).withColumnRenamed("mean_family_count", "weighted_family_count")
    seen = seen.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(F.col(f"weighted_{m}"), 9).cast("double").alias("observed")) for m in names))).alias("x")).select("x.*")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    t = null.join(F.broadcast(seen), "metric").groupBy("metric", "observed")  # one row for each measure
    return t.agg(F.avg("v").alias("null_mean"), q[0].alias("null_low"), q[1].alias("null_high"), ((F.count_if(F.col("v") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p"))
