"""Block resampling and exact tests.

Draws are MD5 of (seed, iteration, place), so weights do not depend on partitions and SQL gives the same. F1-type
statistics resample the sums of each block; AP-type statistics re-weight merged scores by vectors of weights.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from corvane.functions.scalar import stable_bucket
from corvane.operators import metrics
from corvane.operators.ranking import ranked, running
from corvane.operators.skew import hub_join
from corvane.session import materialise, shuffle_width


#: Weights that travel to the workers at once (blocks times iterations); iterations go in portions of so many.
PORTION = 4_000_000
#: So few blocks are numbered in one window.
FEW_BLOCKS = 100_000
#: Items that a task sorts by their digests at once; iterations whose slices meet a chunk of names together.
SLICE, TOGETHER = 1_000_000, 16


class BlockDraws:
    """Draws of blocks with replacement, as many as there are blocks, in each iteration.

    A draw is MD5 of (seed, iteration, place), so draws come from a range of numbers that any number of tasks share; what
    comes to the driver is the count of the blocks and, portion by portion, a matrix of ``PORTION`` weights at most.
    """

    def __init__(self, blocks: DataFrame, block: str, iterations: int, seed: int = 42):
        self.block, self.iterations, self.seed = block, iterations, seed
        named = materialise(blocks.select(block).distinct(), "blocks")
        self.count = named.count()
        if self.count <= FEW_BLOCKS:
            self.named = named.withColumn("place", F.row_number().over(W.orderBy(block)) - 1)
        else:
            self.named = ranked(named, [], [F.col(block)], "place").withColumn("place", F.col("place") - 1)
        self.named = self.named.withColumn("place", F.col("place").cast("bigint"))

    def places(self, first: int = 0, last: int | None = None) -> DataFrame:
        """``(iter, place, w)`` of the iterations from ``first`` to before ``last``. A single block allows no draws: no rows."""
        spark, k = self.named.sparkSession, self.count
        last = self.iterations if last is None else last
        n = (last - first) * k if k > 1 else 0
        at = spark.range(0, n, 1, max(1, min(shuffle_width(spark), -(-n // 10_000)), -(-n // 2_000_000)))
        draw = at.select((F.floor(F.col("id") / F.lit(max(k, 1))) + first).cast("bigint").alias("iter"), F.pmod("id", F.lit(max(k, 1))).alias("j"))
        key = F.concat_ws("|", F.lit(str(self.seed)), F.col("iter").cast("string"), F.col("j").cast("string"))
        pick = F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(max(k, 1)))
        return draw.select("iter", pick.alias("place")).groupBy("iter", "place").agg(F.count("*").alias("w"))

    def weights(self) -> DataFrame:
        """``(iter, block, w)``."""
        return self.places().join(self.named, "place").select("iter", self.block, "w")

    def portions(self):
        """``(first iteration, broadcast matrix of weights: places by iterations)``."""
        step = max(1, PORTION // max(self.count, 1))
        for first in range(0, self.iterations if self.count > 1 else 0, step):
            last = min(self.iterations, first + step)
            rows = self.places(first, last).toArrow()  # PORTION at most
            matrix = np.zeros((self.count, last - first), np.int32)
            matrix[rows["place"].to_numpy(), rows["iter"].to_numpy() - first] = rows["w"].to_numpy()
            yield first, self.named.sparkSession.sparkContext.broadcast(matrix)


def block_weights(blocks: DataFrame, block: str, iterations: int, seed: int = 42) -> DataFrame:
    """``(iter, block, w)``: how often each block is drawn, with replacement, in each iteration. A single block allows no
    draws: there are no rows, and ``interval`` gives nulls."""
    return BlockDraws(blocks, block, iterations, seed).weights()


def interval(values: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    low = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(low), F.lit(1 - low)))
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), q[0].alias("low"), q[1].alias("high"))


def _descending(table: pa.Table, matrix: np.ndarray, above: tuple[np.ndarray, np.ndarray] | None = None, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(sum of positives times precision, positives) in each iteration over points (score, place, n, tp) from the highest score down,
    behind the weighted counts ``above``. Rows are weighted a few thousand at a time."""
    score, place, n, tp = (table[c].to_numpy() for c in ("score", "place", "n", "tp"))
    order = np.argsort(-score, kind="stable")
    score, place, n, tp = score[order], place[order], n[order], tp[order]
    width = matrix.shape[1]
    cum_n, cum_tp = above if above is not None else (np.zeros(width), np.zeros(width))
    area, positives = np.zeros(width), np.zeros(width)
    edges = np.append(np.flatnonzero(np.append(True, score[1:] != score[:-1])), len(score)) if len(score) else np.zeros(1, int)
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + rows, side="right")) - 1)
        at = edges[a:b]
        sums = []
        for counts in (n, tp):
            total = np.zeros((len(at), width))
            for k in range(edges[a], edges[b], rows):  # one score may have more rows than a portion
                end = min(k + rows, edges[b])
                np.add.at(total, np.searchsorted(at, np.arange(k, end), side="right") - 1, matrix[place[k:end]] * counts[k:end, None])
            sums.append(total)
        here_n, here_tp = np.cumsum(sums[0], 0) + cum_n, np.cumsum(sums[1], 0) + cum_tp
        area += np.divide(sums[1] * here_tp, here_n, out=np.zeros_like(here_n), where=here_n > 0).sum(0)
        positives += sums[1].sum(0)
        cum_n, cum_tp = here_n[-1], here_tp[-1]
        a = b
    return area, positives


def bootstrap_ap(scored: DataFrame, keys: list[str], block: str, iterations: int, seed: int = 42, score: str = "score", draws: BlockDraws | None = None) -> DataFrame:
    """``(keys, iter, macro_ap)`` of block draws.

    Scores are merged by (label, score, block) and sorted once. Block weights are vectors over iterations, so a task that has a
    range of a label's scores gets all iterations' curves from sums of vectors; ranges meet through their totals.
    """
    draws = draws or BlockDraws(scored, block, iterations, seed)
    spark, series = scored.sparkSession, [*keys, "label_id"]
    merged = scored.groupBy(*series, F.col(score).cast("double").alias("score"), block).agg(F.count("*").cast("bigint").alias("n"), F.sum("y").cast("bigint").alias("tp"))
    if draws.count > PORTION:
        return _joined_ap(merged, keys, draws.weights(), block, metrics.cuts(scored, score))
    at = metrics.cuts(scored, score)
    merged = materialise(metrics.ranged(merged, at).join(draws.named, block).select(*series, "_range", "score", "place", "n", "tp").where("score is not null"), "points")
    kinds = [merged.schema[c] for c in series]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    types, group = [*(to_arrow_type(f.dataType) for f in kinds), pa.int32()], [*series, "_range"]

    def keyed(key, n):
        return [pa.array([k.as_py()] * n, t) for k, t in zip(key, types)]

    def totals(shipped):
        """The weighted counts of a range, as vectors over iterations."""

        def run(key, table):
            w, place = shipped.value, table["place"].to_numpy()
            sums = [np.bincount(place, weights=table[c].to_numpy(), minlength=len(w)) @ w for c in ("n", "tp")]
            return pa.Table.from_arrays([*keyed(key, 1), *(pa.array([x.tobytes()], pa.binary()) for x in sums)], [*group, "n", "tp"])

        return run

    def behind(key, table):
        """The totals of the ranges above each."""
        table = table.sort_by([("_range", "descending")])
        sums = [np.array([np.frombuffer(x) for x in table[c].to_pylist()]) for c in ("n", "tp")]
        before = [np.cumsum(x, 0) - x for x in sums]
        return pa.Table.from_arrays([*keyed(key, table.num_rows), table["_range"].combine_chunks(), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in before)], [*group, "n", "tp"])

    def curve(shipped, first, several):
        def rows(key, area, positives):
            return pa.Table.from_arrays([*keyed(key, len(area)), pa.array(np.arange(first, first + len(area))), pa.array(area), pa.array(positives)], [*series, "iter", "area", "positives"])

        def alone(key, table):
            return rows(key, *_descending(table, shipped.value))

        def both(key, left, right):
            start = tuple(np.frombuffer(right[c][0].as_py()) for c in ("n", "tp")) if right.num_rows else None
            return rows(key[:-1], *_descending(left, shipped.value, start))

        return both if several else alone

    schema, kind, out = f"{head}, iter bigint, area double, positives double", f"{head}, _range int, n binary, tp binary", None
    for first, shipped in draws.portions():
        if at:
            above = merged.groupBy(*group).applyInArrow(totals(shipped), kind).groupBy(*series).applyInArrow(behind, kind)
            part = merged.groupBy(*group).cogroup(above.groupBy(*group)).applyInArrow(curve(shipped, first, True), schema)
        else:
            part = merged.groupBy(*series).applyInArrow(curve(shipped, first, False), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    ap = out.groupBy(*series, "iter").agg(F.try_divide(F.sum("area"), F.sum("positives")).alias("ap"))
    return ap.groupBy(*keys, "iter").agg(F.avg("ap").alias("macro_ap"))


def _joined_ap(merged: DataFrame, keys: list[str], weights: DataFrame, block: str, at: list[float]) -> DataFrame:
    """As ``bootstrap_ap`` for more blocks than fit a vector's portion: weights meet the merged scores by a join."""
    drawn = merged.join(weights, block)
    point = drawn.groupBy(*keys, "iter", "label_id", "score").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("tp")).alias("tp"))
    cum = metrics.cumulated(point, [*keys, "iter", "label_id"], at, always=True)
    ap = cum.groupBy(*keys, "iter", "label_id").agg(F.try_divide(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")), F.sum("tp")).alias("ap"))
    return ap.groupBy(*keys, "iter").agg(F.avg("ap").alias("macro_ap"))


def weighted_cache_ap(scored: DataFrame, block: str, iterations: int, seed: int = 42, score: str = "score") -> DataFrame:
    """``(iter, macro_ap)``: scores are sorted once and re-weighted in each iteration."""
    return bootstrap_ap(scored, [], block, iterations, seed, score)


def item_draws(items: DataFrame, group: str, item: str, sums: list[str], iterations: int, seed: int = 42) -> DataFrame:
    """``(group, iter, sums)``: the summed columns of as many items drawn with replacement in each group as it has, in each iteration.

    Draws stream past the items that they meet, which a task holds as a table, and are summed where they meet; neither a group nor its
    draws come together in a task.
    """
    placed = materialise(ranked(items.select(group, item, *sums), [group], [F.col(item)], "place").select(group, "place", *sums), "places")
    size = materialise(placed.groupBy(group).agg(F.count("*").alias("k"), F.count("*").alias("n")), "sizes")
    each = hub_join(placed.select(group, "place"), size, [group], "n").select(group, "k", F.col("place").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iter"))
    key = F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col("iter").cast("string"), F.col("j").cast("string"))
    pick = F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.col("k")) + 1
    drawn = each.select(group, "iter", pick.cast("bigint").alias("place"))
    met = drawn.join(placed.withColumn("place", F.col("place").cast("bigint")).hint("shuffle_hash"), [group, "place"])
    return met.groupBy(group, "iter").agg(*(F.sum(c).alias(c) for c in sums))


def bootstrap_f1(scored: DataFrame, keys: list[str], block: str, iterations: int, seed: int = 42) -> DataFrame:
    """``(keys, iter, f1)`` from the summed counts of the drawn blocks."""
    sums = metrics.confusion(scored, [*keys, block])
    drawn = sums.join(block_weights(scored, block, iterations, seed), block)
    return drawn.groupBy(*keys, "iter").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in ("tp", "fp", "fn"))).select(*keys, "iter", metrics.f1().alias("f1"))


def metric_draws(scored: DataFrame, model: str, block: str, iterations: int, seed: int = 42) -> DataFrame:
    """``(model, iter, macro_ap, micro_ap, macro_f1, micro_f1)`` of block draws; all models and metrics see the same draws."""
    draws = BlockDraws(scored, block, iterations, seed)
    weights = materialise(draws.weights(), "weights")
    macro = bootstrap_ap(scored, [model], block, iterations, seed, draws=draws)
    micro = bootstrap_ap(scored.withColumn("label_id", F.lit("all")), [model], block, iterations, seed, draws=draws).withColumnRenamed("macro_ap", "micro_ap")
    sums = metrics.confusion(scored, [model, "label_id", block]).join(weights, block)
    sums = sums.groupBy(model, "iter", "label_id").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in ("tp", "fp", "fn")))
    pooled = F.try_divide(2.0 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))
    f = sums.groupBy(model, "iter").agg(F.avg(F.coalesce(metrics.f1(), F.lit(0.0))).alias("macro_f1"), pooled.alias("micro_f1"))
    return macro.join(micro, [model, "iter"]).join(f, [model, "iter"])


_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_TURNS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32), 4, axis=0).reshape(-1)


def _digester(tails: list[bytes]):
    """A function that gives, for a head, the MD5 of the head before each tail as two numbers of 64 bits. Texts of one MD5 block (55 bytes)
    are digested side by side in arrays, several times as fast as one by one; longer ones one by one."""
    size = np.array([len(x) for x in tails])
    longest, laid = int(size.max(initial=0)), {}

    def blocks(at: int) -> np.ndarray:
        raw = np.zeros((len(tails), 64), np.uint8)
        raw[:, at : at + longest] = np.array(tails, f"S{max(longest, 1)}").view(np.uint8).reshape(len(tails), -1)[:, :longest]
        raw[np.arange(len(tails)), at + size] = 128
        raw[:, 56:58] = ((at + size) * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
        return np.ascontiguousarray(raw.view("<u4").T)

    def digests(head: bytes) -> np.ndarray:
        if len(head) + longest > 55:
            return np.frombuffer(b"".join([md5(head + x).digest() for x in tails]), ">u8").reshape(-1, 2).astype(np.uint64)
        if len(head) not in laid:
            laid[len(head)] = blocks(len(head))
        words = laid[len(head)] | np.frombuffer(head.ljust(64, b"\0"), "<u4")[:, None]
        start = [np.full(len(tails), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = start
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f += a
            f += _SINES[i]
            f += words[g]
            a, d, c, b = d, c, b, b + ((f << _TURNS[i]) | (f >> (np.uint32(32) - _TURNS[i])))
        a, b, c, d = ((x + y).byteswap().astype(np.uint64) for x, y in zip((a, b, c, d), start))
        return np.stack([a << np.uint64(32) | b, c << np.uint64(32) | d], 1)

    return digests


def permuted_counts(items: DataFrame, item: str, cluster: str, kinds: list[str], iterations: int, seed: int = 42) -> DataFrame:
    """``(iter, cluster, kinds, n)``: how many items of each kind a cluster has: at -1 as they are, then with the clusters' names dealt anew,
    which keeps the clusters' sizes. In an iteration the item with the k-th least MD5 of (seed, iteration, item) gets the cluster of the k-th item.

    What travels of an item in an iteration is the head of its digest and the number of its kind, packed. Digests are cut into slices of
    about ``SLICE`` items, sorted slice by slice, and laid beside the clusters' names by the sizes of the slices before. Iterations in which heads of
    different kinds are equal are dealt again by whole digests.
    """
    spark = items.sparkSession
    numbered = lambda names, to: materialise(ranked(items.select(*names).distinct(), [], [F.col(c) for c in names], to).withColumn(to, F.col(to) - 1), to.strip("_"))
    clusters, sorts = numbered([cluster], "_c"), numbered(kinds, "_d")
    coded = ranked(items.select(item, cluster, *kinds), [], [F.col(item)], "_k").alias("x")
    for names, table in (([cluster], clusters), (kinds, sorts)):
        table = table.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(names)), table.columns[-1])
        same = F.lit(True)
        for i, c in enumerate(names):
            same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
        coded = coded.join(table, same).drop(*(f"_{i}" for i in range(len(names))))
    coded = materialise(coded.select((F.col("_k") - 1).cast("bigint").alias("k"), F.col(item).cast("string").alias("name"), F.col("_c").cast("bigint").alias("c"), F.col("_d").cast("bigint").alias("d")), "coded")
    count, several, many = coded.count(), sorts.count(), clusters.count()
    kind, place = np.min_scalar_type(max(several - 1, 0)), np.min_scalar_type(max(many - 1, 0))
    slices, size = max(1, -(-count // SLICE)), SLICE
    # so many tasks that each has about a million digests
    spread = coded.select("name", "d").repartition(max(1, min(shuffle_width(spark), -(-count * iterations // 1_000_000))))

    def sliced(width, which):
        """The items of a batch in each iteration, by slices: heads of ``width`` bytes and kinds."""

        def run(batches):
            for batch in batches:
                digests = _digester([b"|" + x.encode() if x is not None else b"" for x in batch.column("name").to_pylist()])
                own, rows, held = batch.column("d").to_numpy().astype(kind), [], 0
                for it in which:
                    h, d = digests(f"{seed}|{it}".encode())[:, : width // 8], own
                    at = ((h[:, 0] >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
                    if slices > 1:
                        order = np.argsort(at, kind="stable")
                        at, h, d = at[order], h[order], d[order]
                    edges = np.searchsorted(at, np.arange(slices + 1, dtype=np.uint64))
                    rows += [(it, k, h[a:b].tobytes(), d[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                    held += h.nbytes + d.nbytes
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["iter", "slice", "h", "d"])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["iter", "slice", "h", "d"])

        return run

    def ordered(width):
        """The kinds of a slice in the order of digests, and whether equal heads leave that order open."""

        def run(key, table):
            h, d = (b"".join(table[c].to_pylist()) for c in "hd")
            h, d = np.frombuffer(h, np.uint64).reshape(-1, width // 8), np.frombuffer(d, kind)
            order = np.lexsort((d, *(h[:, j] for j in reversed(range(width // 8))))) if width > 8 else np.argsort(h[:, 0], kind="stable")
            h, d = h[order], d[order]
            tied = bool(((h[1:] == h[:-1]).all(1) & (d[1:] != d[:-1])).any())
            return pa.table({"iter": [key[0].as_py()], "slice": [key[1].as_py()], "n": [len(d)], "d": pa.array([d.tobytes()], pa.binary()), "tied": [tied]})

        return run

    def dealt(width, which):
        parts = spread.mapInArrow(sliced(width, which), "iter long, slice long, h binary, d binary")
        return materialise(parts.groupBy("iter", "slice").applyInArrow(ordered(width), "iter long, slice long, n long, d binary, tied boolean"), "dealt")

    found = dealt(8, list(range(iterations)))
    again = [r["iter"] for r in found.where("tied").select("iter").distinct().collect()]  # iterations
    if again:
        found = found.where(~F.col("iter").isin(again)).unionByName(dealt(16, again))
    before = W.partitionBy("iter").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = found.select("iter", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each slice of an iteration
    first, last = F.col("chunk") * size, (F.col("chunk") + 1) * size
    pieces = found.join(F.broadcast(starts), ["iter", "slice"]).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size))))
    a, b = F.greatest("start", first), F.least(F.col("start") + F.col("n"), last)
    piece = F.substring("d", ((a - F.col("start")) * kind.itemsize + 1).cast("int"), ((b - a) * kind.itemsize).cast("int"))
    pieces = pieces.select("chunk", F.floor(F.col("iter") / TOGETHER).alias("part"), "iter", (a - first).alias("at"), piece.alias("d"))

    def packed(key, table):
        table = table.sort_by("k")
        return pa.table({"chunk": [key[0].as_py()], "c": pa.array([table["c"].to_numpy().astype(place).tobytes()], pa.binary())})

    names = coded.select(F.floor(F.col("k") / size).alias("chunk"), "k", "c").groupBy("chunk").applyInArrow(packed, "chunk long, c binary")
    names = names.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((iterations - 1) // TOGETHER).cast("bigint"))))

    def counted(key, left, right):
        own, out = np.frombuffer(right["c"][0].as_py(), place).astype(np.int64), {}
        for it, at, d in zip(*(left[c].to_pylist() for c in ("iter", "at", "d"))):
            d = np.frombuffer(d, kind).astype(np.int64)
            pair = own[at : at + len(d)] * several + d
            values, n = np.unique(pair, return_counts=True) if many * several > size else (lambda x: (np.flatnonzero(x), x[x > 0]))(np.bincount(pair))
            out.setdefault(it, []).append((values, n))
        iters, values, n = [], [], []
        for it, parts in out.items():
            v, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            iters.append(np.full(len(v), it, np.int64))
            values.append(v)
            n.append(np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64))
        at, values, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (iters, values, n))
        return pa.table({"iter": at, "_c": values // several, "_d": values % several, "n": n})

    null = pieces.groupBy("chunk", "part").cogroup(names.groupBy("chunk", "part")).applyInArrow(counted, "iter long, _c long, _d long, n long")
    null = null.groupBy("iter", "_c", "_d").agg(F.sum("n").alias("n")).join(clusters, "_c").join(sorts, "_d").select("iter", cluster, *kinds, "n")
    seen = items.groupBy(cluster, *kinds).agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("iter"), cluster, *kinds, "n")
    return seen.unionByName(null)


def stratified_effects(scored: DataFrame, keys: list[str], block: str, iterations: int, seed: int = 42) -> DataFrame:
    """``(keys, n, delta, low, high, p)``: F1 of ``context`` less that of ``base`` at 0.5, its interval over block draws, and the
    share of block-wise swaps whose difference is as large, the observed one counted in."""
    y, names = F.col("y") == 1, [f"{c}_{m}" for c in ("tp", "fp", "fn") for m in "ab"]
    hit = {"a": F.col("base") >= 0.5, "b": F.col("context") >= 0.5}
    each = [F.count_if(x).alias(f"{c}_{m}") for m, h in hit.items() for c, x in (("tp", h & y), ("fp", h & ~y), ("fn", ~h & y))]
    sums = materialise(scored.groupBy(*keys, block).agg(F.count("*").alias("n"), *each), "counts")
    delta = metrics.f1("tp_b", "fp_b", "fn_b") - metrics.f1("tp_a", "fp_a", "fn_a")
    seen = sums.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).select(*keys, "n", delta.alias("delta"))
    drawn = sums.join(block_weights(scored, block, iterations, seed), block).groupBy(*keys, "iter").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in names))
    ci = interval(drawn.select(*keys, delta.alias("d")), keys, "d").select(*keys, "low", "high")
    it = sums.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    swap = stable_bucket(F.concat_ws("|", F.lit(str(seed)), F.col("iter").cast("string"), F.col(block).cast("string")), 2) == 1
    other = {"a": "b", "b": "a"}
    swapped = it.groupBy(*keys, "iter").agg(*(F.sum(F.when(swap, F.col(f"{c}_{other[m]}")).otherwise(F.col(f"{c}_{m}"))).alias(f"{c}_{m}") for c in ("tp", "fp", "fn") for m in "ab"))
    as_large = F.abs(F.coalesce("d", F.lit(0.0))) >= F.abs(F.coalesce("delta", F.lit(0.0))) - 1e-12
    p = swapped.select(*keys, delta.alias("d")).join(seen, keys).groupBy(*keys).agg(((F.count_if(as_large) + 1) / (iterations + 1)).alias("p"))
    return seen.join(ci, keys, "left").join(p, keys, "left")


#: Complement of the error function by a rational approximation (absolute error under 1.5e-7), fixed values.
_ERFC = (0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))


def _erfc(x: Column) -> Column:
    q, a = 1 / (1 + _ERFC[0] * x), _ERFC[1]
    return q * (a[0] + q * (a[1] + q * (a[2] + q * (a[3] + q * a[4])))) * F.exp(-x * x)


def signed_rank(differences: DataFrame, key: str, value: str, exact_up_to: int = 50) -> DataFrame:
    """``(key, w, n, z, p)``: two-sided signed-rank test of the non-zero differences, with average ranks. p is exact for at most
    ``exact_up_to`` differences without ties, else by the normal law with the ties' correction. Equal sizes are merged
    before they are ranked."""
    size = F.abs(F.col(value))
    g = differences.where(F.col(value) != 0).groupBy(key, size.alias("_a")).agg(F.count("*").alias("t"), F.count_if(F.col(value) > 0).alias("up"))
    g = running(g, [key], [F.col("_a")], {"_c": F.col("t")}).withColumn("rank", F.col("_c") - F.col("t") + (F.col("t") + 1) / 2)
    s = g.groupBy(key).agg(F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("minus"), F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)).alias("ties"))
    n, w = F.col("n"), F.least("plus", "minus")
    z = F.try_divide(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    # ways to reach each rank sum with the ranks 1 to n, one rank after another
    few = F.least(n, F.lit(exact_up_to)).cast("int")
    sums = F.sequence(F.lit(0), (few * (few + 1) / 2).cast("int"))
    ways = F.aggregate(F.sequence(F.lit(1), few), F.transform(sums, lambda i: F.when(i == 0, 1.0).otherwise(0.0)), lambda a, k: F.transform(a, lambda x, i: x + F.when(i >= k, F.get(a, i - k)).otherwise(0.0)))
    tail = F.aggregate(F.slice(ways, F.lit(1), w.cast("int") + 1), F.lit(0.0), lambda a, x: a + x)
    exact = F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), few))
    p = F.when((n <= exact_up_to) & (F.col("ties") == 0), exact).otherwise(_erfc(F.abs(z) / math.sqrt(2)))
    return s.select(key, w.alias("w"), "n", z.alias("z"), p.alias("p"))


def swap_test(counts: DataFrame, block: str, iterations: int, seed: int = 42) -> DataFrame:
    """``(observed, p)``: share of block-wise swaps of two models whose absolute F1 difference reaches the observed one.
    Needs columns tp_a, fp_a, fn_a, tp_b, fp_b, fn_b for each block."""
    it = counts.withColumn("iter", F.explode(F.sequence(F.lit(-1), F.lit(iterations - 1))))
    swap = (F.col("iter") >= 0) & (stable_bucket(F.concat_ws("|", F.lit(str(seed)), F.col("iter").cast("string"), F.col(block).cast("string")), 2) == 1)
    pick = lambda c, m: F.sum(F.when(swap, F.col(f"{c}_{'b' if m == 'a' else 'a'}")).otherwise(F.col(f"{c}_{m}"))).alias(f"{c}_{m}")
    s = it.groupBy("iter").agg(*(pick(c, m) for c in ("tp", "fp", "fn") for m in "ab"))
    d = s.select("iter", (F.coalesce(metrics.f1("tp_b", "fp_b", "fn_b"), F.lit(0.0)) - F.coalesce(metrics.f1("tp_a", "fp_a", "fn_a"), F.lit(0.0))).alias("d"))
    observed = F.max(F.when(F.col("iter") == -1, F.col("d")))
    g = d.agg(observed.alias("observed"), F.collect_list(F.when(F.col("iter") >= 0, F.abs("d"))).alias("null"))  # one value an iteration
    return g.select("observed", (F.size(F.filter("null", lambda x: x >= F.abs("observed") - 1e-12)) / iterations).alias("p"))


_SMALL = [math.lgamma(k + 1) for k in range(16)]


def _log_factorial(n: Column) -> Column:
    """ln n!: a table up to 15, then Stirling's series, whose next term is below 1e-13 there."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 16, F.element_at(F.array(*map(F.lit, _SMALL)), F.least(n, F.lit(15)).cast("int") + 1)).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def sign_test(plus: Column, minus: Column) -> Column:
    """Exact two-sided binomial p; null without observations."""
    n, k = (plus + minus).cast("int"), F.least(plus, minus).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, i: a + F.exp(log_choose(n, i) - n * F.log(F.lit(2.0))))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact p of a 2x2 table: the probability of all tables no likelier than the one seen."""
    a, b, c, d = (x.cast("int") for x in (a, b, c, d))
    row, other, column = a + b, c + d, a + c
    p = lambda x: F.exp(log_choose(row, x) + log_choose(other, column - x) - log_choose(row + other, column))
    all_ = F.transform(F.sequence(F.greatest(F.lit(0), column - other), F.least(row, column)), p)
    seen = p(a)
    return F.least(F.lit(1.0), F.aggregate(F.filter(all_, lambda x: x <= seen * (1 + 1e-7)), F.lit(0.0), lambda t, x: t + x))
