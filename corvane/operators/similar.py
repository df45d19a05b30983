"""Clusters of similar texts by an exact join of word-run sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.operators.components import connected_components
from corvane.operators.skew import hub_join
from corvane.session import materialise, shuffle_width

#: A run that stands in the prefixes of more texts than this is crowded. Most texts and runs of a block of crowded texts. Columns compared at once, and
#: pairs counted at once where a run has few. One text in so many tells which runs are hubs. Equal texts of at most so many rows are broadcast.
CROWD, BLOCK, RUNS, COLUMNS, PAIRS, SOME, FEW = 64, 2048, 1 << 20, 2048, 1 << 22, 64, 500_000


def _shingles(text: str, words: int):
    w = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda x: x != "")
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1)))
    return w, F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, words)))))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common values of every left and right set. Values that many sets hold are multiplied out, a few thousand at a time; values
    of few sets are counted pair by pair, a few million at a time."""
    values, code = np.unique(np.concatenate([*left, *right]) if left or right else np.zeros(0, np.int64), return_inverse=True)
    out = np.zeros((len(left), len(right)), np.float32)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    own = row < len(left)
    (a, a_code), (b, b_code) = (row[own], code[own]), (row[~own] - len(left), code[~own])
    n_a, n_b = (np.bincount(x, minlength=len(values)) for x in (a_code, b_code))
    dense = np.flatnonzero(n_a * n_b > max(out.size // 256, 1))
    for at in range(0, len(dense), COLUMNS):
        place = np.full(len(values), -1)
        place[dense[at : at + COLUMNS]] = np.arange(len(dense[at : at + COLUMNS]))
        some = []
        for rows, codes, n in ((a, a_code, len(left)), (b, b_code, len(right))):
            m = np.zeros((n, min(COLUMNS, len(dense) - at)), np.float32)
            ok = place[codes] >= 0
            m[rows[ok], place[codes[ok]]] = 1
            some.append(m)
        out += some[0] @ some[1].T
    met = n_b.copy()
    met[dense] = 0
    a, a_code = a[met[a_code] > 0], a_code[met[a_code] > 0]
    start, ends = (np.cumsum(n_b) - n_b)[a_code], np.cumsum(met[a_code])
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = met[a_code[at:to]]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cell = np.repeat(a[at:to], n) * len(right) + b[np.repeat(start[at:to], n) + inside]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape)
        at = to
    return out


def chained(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what ``near`` joins: each id with the least id that its links in the block reach."""
    a, b, big = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(near, b[None, :], big).min(1))
        new_b = np.minimum(b, np.where(near, new_a[:, None], big).min(0))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    x, y = near.any(1), near.any(0)
    return np.concatenate([left[x], right[y]]), np.concatenate([a[x], b[y]])


def _crowded_links(members: DataFrame, own: DataFrame, levels: list[float]) -> DataFrame:
    """``(src, dst, similarity)`` that connect, at each level, what the members ``(bucket, id, runs)`` of groups of crowded runs are connected by.
    Blocks of a group meet two by two inside tasks; a block's pairs never leave it, only links that span its components."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("count"), F.sum("runs").alias("runs"))
    parts = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("runs") / RUNS)).cast("int").alias("parts")
    at = hub_join(members.select("bucket", "id"), materialise(sizes.select("bucket", "count", parts), "groups"), ["bucket"], "count")
    at = at.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    at = at.select("bucket", "id", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")
    blocks = at.join(own, "id")  # a text in its own block once

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        part, ids, n = (table[c].to_numpy() for c in ("part", "id", "n"))
        runs = table["r"].combine_chunks()
        edges = runs.offsets.to_numpy()
        flat = runs.values.to_numpy()
        a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
        shared = overlaps(*([flat[edges[k] : edges[k + 1]] for k in x] for x in (a, b)))
        share = shared / np.maximum(n[a][:, None] + n[b][None, :] - shared, 1)
        share[ids[a][:, None] == ids[b][None, :]] = 0
        found = [(*chained(share >= level, ids[a], ids[b]), level) for level in levels]
        src, dst = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        level = np.repeat(levels, [len(f[0]) for f in found])
        keep = src != dst
        return pa.table({"src": src[keep], "dst": dst[keep], "similarity": level[keep]})

    return blocks.select("bucket", "i", "j", "part", "id", "n", "r").groupBy("bucket", "i", "j").applyInArrow(run, "src long, dst long, similarity double").distinct()


def _held_by_several(spread: DataFrame, total: int) -> DataFrame:
    """The rows (id, n, k) whose run k several texts have, with their number ``df``. Rows are shuffled once: a run with more rows than a task's
    share, as one text in ``SOME`` tells, is counted where it stands. A hub that they miss is only slower."""
    most = total / shuffle_width(spread.sparkSession)
    seen = spread.where(F.pmod(F.xxhash64(F.lit("some"), "id"), F.lit(SOME)) == 0).groupBy("k").agg(F.count("*").alias("df"))
    hubs = [r.k for r in seen.where((F.col("df") * SOME > most) & (F.col("df") > 1)).select("k").collect()]  # fewer than a few times the width
    counted = lambda rows: rows.select("*", F.count("*").over(W.partitionBy("k")).cast("int").alias("df"))
    if not hubs:
        return counted(spread).where("df > 1")
    hub = F.col("k").isin(hubs)
    sizes = materialise(spread.where(hub).groupBy("k").agg(F.count("*").cast("int").alias("df")), "hubs")
    return counted(spread.where(~hub)).unionByName(spread.where(hub).join(F.broadcast(sizes), "k")).where("df > 1")


def similar_texts(docs: DataFrame, levels: list[float], words: int = 5, id_col: str = "id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """``(src, dst, similarity)``: links that connect, at each of the ``levels``, exactly the texts whose shares of common runs of words (of
    all of both) connect them. Pairs that meet in a run that is not crowded come with their similarity; crowded runs give links
    that span the components of their texts, with the level as similarity.

    An exact join of sets: runs are ordered by how many texts have them, rarest first. Two sets of n and m runs that share
    enough for the least level t have a common run among the first ``n - ceil(t n) + 1`` and ``m - ceil(t m) + 1``, and t n <= m. Runs with
    the same texts in their prefixes count once, and crowded runs whose texts have the same least hash meet as one group, so that
    a text does not travel once for each of them. Runs of one text meet nobody: they count in a set's size and never travel. Equal
    texts meet in one class first. Texts without words link with nothing.
    """
    least = min(levels)
    w, runs = _shingles("text", words)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select("id", w.alias("w")).where("size(w) > 0")
    each = materialise(named.select("id", F.array_sort(runs).alias("s")).select("*", F.xxhash64("s").alias("h"), F.size("s").alias("n")), "shingles")
    reps = materialise(each.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("count")), "texts")
    same = materialise(hub_join(each.select("id", "h"), reps, ["h"], "count").where("id <> rep"), "equal")
    equal = same.select("id", "h")
    first_of = each.where("id is not null").join(F.broadcast(equal) if same.count() <= FEW else equal, ["id", "h"], "left_anti")
    spread = first_of.select("id", "n", F.explode("s").alias("k"))
    shared = _held_by_several(spread, each.agg(F.sum("n")).first()[0] or 0)
    # runs of one text stand first in its order, so the prefix holds that many fewer of the others
    first = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1 - (F.col("n") - F.size("r"))
    own = shared.groupBy("id", "n").agg(F.array_sort(F.collect_set(F.struct("df", "k"))).alias("x")).select("id", "n", F.transform("x", lambda x: x["k"]).alias("r"))
    own = materialise(own.where(first > 0), "sets")  # others share too little with anyone
    prefix = own.select("id", "n", F.size("r").alias("runs"), F.explode(F.slice("r", F.lit(1), first)).alias("k"))
    buckets = prefix.groupBy("k").agg(F.count("*").alias("count"), F.bit_xor(F.xxhash64("id")).alias("who"), F.min(F.xxhash64("id")).alias("bucket")).where("count > 1")
    buckets = materialise(buckets.groupBy("who", "count", "bucket").agg(F.min("k").alias("k")).select("k", "count", "bucket"), "buckets")
    few = buckets.where(F.col("count") <= crowd).select("k")
    small = materialise(prefix.select("id", "n", "k").join(few, "k", "left_semi"), "members")
    other = small.select("k", F.col("id").alias("dst"), F.col("n").alias("m"))
    pairs = small.withColumnRenamed("id", "src").join(other, "k").where((F.col("src") < F.col("dst")) & (F.col("n") * least <= F.col("m") + 1e-9) & (F.col("m") * least <= F.col("n") + 1e-9))
    pairs = pairs.select("src", "dst").distinct()
    both = pairs.join(own.select(F.col("id").alias("src"), F.col("n"), F.col("r").alias("x")), "src").join(own.select(F.col("id").alias("dst"), F.col("n").alias("m"), F.col("r").alias("y")), "dst")
    common = F.size(F.array_intersect("x", "y"))
    found = both.select("src", "dst", (common / (F.col("n") + F.col("m") - common)).alias("similarity")).where(F.col("similarity") >= least)
    out = found.union(same.select(F.col("rep").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("similarity")))
    large = buckets.where(F.col("count") > crowd)
    if not large.isEmpty():
        members = hub_join(prefix, large, ["k"], "count").select("bucket", "id", "runs").distinct()
        out = out.union(_crowded_links(materialise(members, "crowds"), own, sorted(levels)))
    return out


def similarity_clusters(docs: DataFrame, levels: list[float], id_col: str = "id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """The ids with ``cluster_<level in percent>`` for each level: the least id reachable by links at the level."""
    links = materialise(similar_texts(docs, levels, id_col=id_col, text_col=text_col, crowd=crowd), "links")
    out = docs.select(F.col(id_col).cast("long").alias("id"))
    for level in levels:
        name = f"cluster_{round(level * 100)}"
        part = connected_components(links.where(F.col("similarity") >= level)).select(F.col("node").alias("id"), F.col("component").alias(name))
        out = out.join(part, "id", "left").withColumn(name, F.coalesce(name, "id"))
    return out
