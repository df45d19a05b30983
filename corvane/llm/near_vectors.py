"""Operator 1: near-duplicate vectors through spherical-cap filters.

A filter direction is the concatenation of one codeword for each block of dimensions (a random product code), so
``codewords ** BLOCKS`` directions come from a few small tables. A vector is list-decoded to every direction
whose inner product reaches the cap's height, and to its ``LEAST`` best ones where these are fewer: block scores are added
in two halves, and pruned halves are matched by a sorted search.

1. Filters are joined on ``(direction, id, 128 sign bits)`` alone; vectors of a direction whose sign bits differ in more
   places than an angle at the threshold allows (by 4.5 standard deviations) are no pair. Directions with many vectors are cut
   into blocks that are compared two by two.
2. The distinct pairs fetch their vectors once and are verified in double precision.
3. A vector with more than ``MANY`` partners in a direction belongs to a crowd. Pairs inside crowds are not written out:
   their vectors travel with their lists of directions and are counted inside blocks, each pair in the first direction it
   shares.

The number of directions grows with the number of vectors, which keeps the vectors of a direction few.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing;
vectors of different length never link; very large and very small components are scaled first; equal vectors are one class
and link with each other; rows with equal ids and vectors count as copies, rows with equal ids and other vectors are vectors of
their own. A row without an id links like others; its component has the least id there is among its rows, null if none, and it
is kept only in that last case. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.components import connected_components
from corvane.operators.skew import hub_join
from corvane.session import materialise

BLOCKS = 4
#: Directions of a vector by height on average, the least number of them, and random vectors of a direction on average.
LIST, LEAST, CROWD = 16, 24, 128
#: A direction with more vectors is compared block by block.
BLOCK = 512
#: Partners of a vector in one direction beyond which it belongs to a crowd.
MANY = 32
#: Sign bits, and the share of vectors whose directions are counted to find those to be cut into blocks.
BITS, COUNTED = 128, 16
#: A table of crowded directions of at most so many rows is broadcast; a larger one is joined by a shuffle.
FEW = 500_000


class CapFilters:
    """A product code over ``dims`` dimensions."""

    def __init__(self, dims: int, vectors: int, seed: int = 7):
        self.dims = dims
        self.wide = -(-dims // BLOCKS)
        wanted = max(256, vectors * LEAST / CROWD)
        self.words = max(4, round(wanted ** (1 / BLOCKS)))
        code = np.random.default_rng(seed).normal(size=(BLOCKS, self.words, self.wide))
        self.code = code / np.linalg.norm(code, axis=2, keepdims=True) / np.sqrt(BLOCKS)
        share = min(0.5, LIST / self.words**BLOCKS)
        self.height = NormalDist().inv_cdf(1 - share) / np.sqrt(dims)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The sorted direction numbers of each unit vector: all that reach the height, and where these are
        few, the ``LEAST`` best."""
        x = np.zeros((len(unit), BLOCKS, self.wide))
        x.reshape(len(unit), -1)[:, : self.dims] = unit
        score = np.einsum("nbd,bkd->nbk", x, self.code)
        out, square = [], self.words * self.words
        for s in score:
            left, right = (s[0][:, None] + s[1]).ravel(), (s[2][:, None] + s[3]).ravel()
            out.append(self._reach(left, right, self.height, square))
            if len(out[-1]) < LEAST:
                few = min(LEAST, square)
                a, b = np.argpartition(-left, few - 1)[:few], np.argpartition(-right, few - 1)[:few]
                both = (left[a][:, None] + right[b]).ravel()
                best = np.argpartition(-both, few - 1)[:few]
                out[-1] = np.sort(a[best // few] * square + b[best % few])
        return out

    @staticmethod
    def _reach(left: np.ndarray, right: np.ndarray, height: float, square: int) -> np.ndarray:
        a = np.flatnonzero(left >= height - right.max())
        if not len(a):
            return a
        b = np.flatnonzero(right >= height - left.max())
        b = b[np.argsort(-right[b])]
        n = np.searchsorted(-right[b], left[a] - height, side="right")
        total = int(n.sum())
        place = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        return np.sort(np.repeat(a, n) * square + b[place])


def _units(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # squares of very large or small components leave the range
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _signs(unit: np.ndarray) -> np.ndarray:
    """(vectors, BITS / 64): the sides of BITS random planes."""
    planes = np.random.default_rng(23).normal(size=(unit.shape[1], BITS))
    return np.packbits(unit @ planes >= 0, axis=1).view(np.uint64)


def most_different(threshold: float) -> int:
    """Sign bits in which two vectors at the threshold differ at most, but for 4.5 standard deviations."""
    p = np.arccos(np.clip(threshold, -1, 1)) / np.pi
    return int(np.ceil(BITS * p + 4.5 * np.sqrt(BITS * p * (1 - p))))


def _near(signs: np.ndarray, side: np.ndarray | None, most: int, ids: np.ndarray):
    """(pairs of ids, ids in crowds) of one group. Pairs of two crowded ids are left out."""
    n, left, right = len(ids), [], []
    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        far = np.bitwise_count(signs[a : a + step, None, 0] ^ signs[None, :, 0]).astype(np.int16)
        for k in range(1, signs.shape[1]):
            far += np.bitwise_count(signs[a : a + step, None, k] ^ signs[None, :, k])
        near = far <= most
        if side is not None:
            near &= side[a : a + step, None] != side[None, :]
        x, y = np.nonzero(near)
        x += a
        left.append(x[x != y])
        right.append(y[x != y])
    x, y = np.concatenate(left), np.concatenate(right)
    crowded = np.bincount(x, minlength=n) > MANY
    keep = (ids[x] < ids[y]) & ~(crowded[x] & crowded[y])
    return ids[x[keep]], ids[y[keep]], ids[crowded]


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the first row of its component."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(ids, copies, side, unit, lists, direction, threshold):
    """Links of one group: (copies of other classes linked here for the first time, least linked id)."""
    n = len(ids)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return np.zeros(n, np.int64), ids
    earlier = [x[x < direction] for x in lists]
    names, inverse = np.unique(np.concatenate(earlier), return_inverse=True)
    if len(names):
        member = np.zeros((n, len(names)), np.float32)
        member[np.repeat(np.arange(n), [len(x) for x in earlier]), inverse] = 1
        first = linked & ~(member @ member.T > 0)
    else:
        first = linked
    order = np.argsort(ids)
    root = np.empty(n, ids.dtype)
    root[order] = ids[order][_roots(linked[np.ix_(order, order)])]
    return first @ copies, root


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(vector_col).alias("own"))
    good = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    keyed = rows.select("id", F.expr(f"coalesce({good}, false)").alias("good"), "own", F.expr("transform(v, x -> x + 0.0D)").alias("v"))
    keyed = keyed.select("id", "good", "own", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    grouped = keyed.where("good").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("own").alias("v"))
    classes = materialise(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")  # a class has a number of its own, whatever its ids
    shapes = [(r.d, r["count"]) for r in classes.groupBy(F.size("v").alias("d")).count().collect()]  # one row for each length
    found = None
    for dims, count in sorted(shapes):
        part = _links(classes.where(F.size("v") == dims), dims, count, threshold)
        found = part if found is None else found.union(part)
    spark = vectors.sparkSession
    if found is None:
        found = spark.createDataFrame([], "rep long, n long, root long")
    found = materialise(found, "links")
    component = connected_components(found.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    count = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = classes.select("k1", "k2", "rep", "least", "copies").join(count, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    known = materialise(known.withColumn("component", F.coalesce("component", "rep")), "known")
    least = materialise(known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")), "components")
    known = hub_join(known, least, ["component"], "classes").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id", "copies")
    linked = hub_join(keyed.where("good").select("id", "k1", "k2"), materialise(known, "answers"), ["k1", "k2"], "copies").select("id", "n_links", "component_id")
    alone = keyed.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    kept = F.when(F.col("id").isNull(), F.col("component_id").isNull()).otherwise(F.col("id") == F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def _links(classes: DataFrame, dims: int, count: int, threshold: float) -> DataFrame:
    """``(rep, n, root)``: several rows for each class, to be summed and connected."""
    caps = CapFilters(dims, count)
    met = materialise(_candidates(classes.select("rep", "v"), caps, count, threshold), "met")
    crowd = met.where("a = b").select(F.col("a").alias("rep"))
    pairs = met.where("a <> b")
    crowded = crowd.count()
    if crowded:
        for end in ("a", "b"):
            pairs = pairs.join(crowd.select(F.col("rep").alias(end), F.lit(True).alias(f"in_{end}")), end, "left")
        pairs = pairs.where("in_a is null or in_b is null").select("a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("rep").alias(end), F.col("copies").alias(f"n_{end}"), F.col("v").alias(f"v_{end}")), end)

    def verify(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ok = pa.array(np.einsum("ij,ij->i", _units(batch.column("v_a")), _units(batch.column("v_b"))) >= threshold)
            a, b, n_a, n_b = (batch.column(k).filter(ok) for k in ("a", "b", "n_a", "n_b"))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([n_b, n_a]), pa.concat_arrays([a, a])], ["rep", "n", "root"])

    out = pairs.select("a", "b", "n_a", "n_b", "v_a", "v_b").mapInArrow(verify, "rep long, n long, root long")
    return out.union(_crowd_links(classes.join(crowd, "rep", "left_semi"), caps, threshold)) if crowded else out


def _blocks(decoded: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows with ``i``, ``j`` and ``own``: a direction in ``heavy`` is cut into parts, and its rows go to each pair of
    their own part and another."""
    heavy = materialise(heavy, "heavy")
    few = heavy.count() <= FEW
    spread = decoded.join(F.broadcast(heavy) if few else heavy, "direction", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("parts", "other")


def _grouped(batches):
    """(table, edges of its groups) for rows that come sorted by direction, i and j; a group stays in one table."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        key = np.stack([table[c].to_numpy() for c in ("direction", "i", "j")], 1)
        edges = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        last = int(edges[-1]) if len(edges) else 0
        rest = table.slice(last)
        yield table.slice(0, last), np.concatenate([[0], edges])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _candidates(classes: DataFrame, caps: CapFilters, count: int, threshold: float) -> DataFrame:
    """Distinct ``(a, b)`` of ids whose vectors may link, and ``(a, a)`` for ids in crowds."""
    most = most_different(threshold)

    def decode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _units(batch.column("v"))
            lists, signs = caps.decode(unit), _signs(unit).view(np.int64)
            row = np.repeat(np.arange(batch.num_rows), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int64)), batch.column("rep").take(pa.array(row)), pa.array(signs[row, 0]), pa.array(signs[row, 1])], ["direction", "rep", "s0", "s1"])

    def compare(batches):
        for table, edges in _grouped(batches):
            if not table.num_rows:
                continue
            ids, own, i, j = (table[c].to_numpy() for c in ("rep", "own", "i", "j"))
            signs = np.stack([table[c].to_numpy() for c in ("s0", "s1")], 1).view(np.uint64)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(edges[:-1], edges[1:]):
                if y - x > 1:
                    left, right, crowd = _near(signs[x:y], own[x:y] if i[x] != j[x] else None, most, ids[x:y])
                    a += [left, crowd]
                    b += [right, crowd]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    kind = "direction long, rep long, s0 long, s1 long"
    share = COUNTED if count > COUNTED * BLOCK else 1
    some = classes.where(F.pmod(F.xxhash64(F.lit("counted"), "rep"), F.lit(share)) == 0)  # only cuts work into parts
    heavy = some.mapInArrow(decode, kind).groupBy("direction").count().withColumn("parts", F.ceil(F.col("count") * share / BLOCK).cast("int")).where("parts > 1").select("direction", "parts")
    dealt = _blocks(classes.mapInArrow(decode, kind), heavy).repartition("direction", "i", "j").sortWithinPartitions("direction", "i", "j")
    return dealt.select("direction", "i", "j", "own", "rep", "s0", "s1").mapInArrow(compare, "a long, b long").distinct()


def _crowd_links(classes: DataFrame, caps: CapFilters, threshold: float) -> DataFrame:
    """``(rep, n, root)`` of the pairs inside crowds, counted in the blocks of each direction."""
    kind = f"direction long, rep long, copies long, v {classes.schema['v'].dataType.simpleString()}, list array<long>"

    def decode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = caps.decode(_units(batch.column("v")))
            n = [len(x) for x in lists]
            row = np.repeat(np.arange(batch.num_rows), n)
            all_ = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(lists).astype(np.int64)))
            for a in range(0, len(row), 20_000):
                some = pa.array(row[a : a + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)[a : a + 20_000].astype(np.int64)), batch.column("rep").take(some), batch.column("copies").take(some), batch.column("v").take(some), all_.take(some)], ["direction", "rep", "copies", "v", "list"])

    decoded = classes.select("rep", "copies", "v").mapInArrow(decode, kind)
    size = decoded.groupBy("direction").count().where("count > 1")
    decoded = decoded.join(size.select("direction"), "direction", "left_semi")
    heavy = size.withColumn("parts", F.ceil(F.col("count") / BLOCK).cast("int")).where("parts > 1").select("direction", "parts")

    def compare(batches):
        for table, edges in _grouped(batches):
            yield from _groups(table, edges, threshold)

    dealt = _blocks(decoded, heavy).repartition("direction", "i", "j").sortWithinPartitions("direction", "i", "j")
    return dealt.select("direction", "i", "j", "own", "rep", "copies", "v", "list").mapInArrow(compare, "rep long, n long, root long")


def _groups(table: pa.Table, edges: np.ndarray, threshold: float):
    if not table.num_rows:
        return
    table = table.combine_chunks()
    ids, copies, own = table["rep"].to_numpy(), table["copies"].to_numpy(), table["own"].to_numpy()
    direction, i, j = table["direction"].to_numpy(), table["i"].to_numpy(), table["j"].to_numpy()
    unit = _units(table["v"].combine_chunks() if isinstance(table["v"], pa.ChunkedArray) else table["v"])
    lists = table["list"].combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    kept = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a < 2:
            continue
        side = own[a:b] if i[a] != j[a] else None
        if b - a == 2 and unit[a] @ unit[a + 1] < threshold:
            continue
        n, root = _compare(ids[a:b], copies[a:b], side, unit[a:b], [flat[at[k] : at[k + 1]] for k in range(a, b)], direction[a], threshold)
        some = (n > 0) | (root != ids[a:b])
        if some.any():
            kept.append((ids[a:b][some], n[some], root[some]))
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k[c] for k in kept]).astype(np.int64)) for c in range(3)], ["rep", "n", "root"])
