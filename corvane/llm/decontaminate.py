"""Operator 6: benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words, lower-cased and without punctuation. A document is compared with
every item it shares a run of ``SEED`` words with; an item of fewer words is its own seed. Greedy string tiling then marks
the longest run of words common to both and free in both, again and again down to ``TILE`` words; the longest length is found
by a binary search whose steps compare Karp-Rabin window hashes. A document is contaminated by an item if tiles cover at least
the threshold share of the item's words, in whatever order they stand in the document.

A benchmark of at most ``MOST_BYTES`` travels to the workers, and the join on seeds and the tiling run inside one scan of
the documents. A larger one is joined by shuffles: distinct seeds of both sides (those of the documents pass a filter of the
benchmark's seeds first), then the texts of the pairs that met. Both ways give the same rows.

Defined cases: null and empty texts, and items without words, match nothing; repeated items and documents are reported one by
one; rows are told apart by position; an empty table on either side gives no matches; extra columns are ignored. Items of one
or two words are found like others, but ``drop_contaminated`` removes documents only for items of ``least_words`` or more.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.near_text import passes, seen_filter, shingles
from corvane.llm.words import hashes, segment_sum, slices, split_words, starts, texts_of
from corvane.session import free_name, keyed, materialise

SEED, TILE, COVERAGE = 5, 3, 0.8
#: A benchmark of more bytes is joined by a shuffle.
MOST_BYTES = 16 << 20
_BASE = np.uint64(0x9E6C63D0876A9A47)


def plain_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, word hashes in order): lower case, letters and digits only."""
    sizes, codes, words = split_words(texts)
    words = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{N}]+", "")
    h = hashes(words)
    if not len(codes):
        return sizes, np.zeros(0, np.uint64)
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    keep = ~empty[codes]
    return segment_sum(keep.astype(np.int64), sizes), h[codes][keep]


def _windows(h: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the windows of ``size`` free words, their hashes)."""
    at = np.arange(len(h) - size + 1)
    taken = np.append(0, np.cumsum(~free))
    at = at[taken[at + size] == taken[at]]
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        # doubling: the hash of 2k words from two of k words
        power, have, part, k = _BASE, 0, h.copy(), 1
        want = size
        while want:
            if want & 1:
                out = out * power + part[at + have] if have else part[at]
                have += k
            want >>= 1
            if want:
                part = np.append(part[:-k] * power + part[k:], np.zeros(k, np.uint64))
                power, k = power * power, 2 * k
    return at, out


def tiles(item: np.ndarray, text: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in the item, place in the text, words), longest first."""
    free_i, free_t = np.ones(len(item), bool), np.isin(text, item)
    found, top = [], min(len(item), len(text))

    def common(size: int):
        a, x = _windows(item, free_i, size)
        b, y = _windows(text, free_t, size)
        order = np.argsort(y, kind="stable")
        place = np.searchsorted(y[order], x)
        hit = (place < len(y)) & (y[order][np.minimum(place, max(len(y) - 1, 0))] == x) if len(y) else np.zeros(len(x), bool)
        return a[hit], x[hit], b[order], y[order]

    while top >= least:
        low, high = least - 1, top
        while low < high:  # a common run of n words holds one of n - 1
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        a, x, b, y = common(low)
        marked = False
        for i, h in zip(a.tolist(), x):
            if not free_i[i : i + low].all():
                continue
            for t in b[np.searchsorted(y, h) : np.searchsorted(y, h, side="right")].tolist():
                if free_t[t : t + low].all() and (item[i : i + low] == text[t : t + low]).all():
                    free_i[i : i + low] = free_t[t : t + low] = False
                    found.append((i, t, low))
                    marked = True
                    break
        top = low if marked else low - 1
    return found


def _seeds(sizes: np.ndarray, h: np.ndarray, lengths: list[int], exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text of each seed, seeds): the runs of each length in ``lengths``; if ``exact``, of the one length that is a text's
    own (``SEED``, or the number of its words)."""
    owner, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in lengths:
        own = np.minimum(sizes, SEED) == k if exact else sizes >= k
        n, seeds = shingles(np.where(own, sizes, 0), h[np.repeat(own, sizes)], k)
        owner.append(np.repeat(np.arange(len(sizes)), n))
        out.append(seeds)
    return np.concatenate(owner), np.concatenate(out)


def tiled(words: np.ndarray, text: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
    """(coverage, tiles, longest tile) if tiles cover the threshold share of an item's words."""
    if np.isin(words, text).mean() < threshold:
        return None
    found = tiles(words, text, min(TILE, len(words)))
    coverage = sum(t[2] for t in found) / len(words)
    return (coverage, len(found), found[0][2]) if coverage >= threshold else None


class Items:
    """Benchmark items with their sorted seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        sizes, h = plain_words(pa.array([r[1] for r in rows], pa.string()))
        at = starts(sizes)
        self.words = [h[a:b] for a, b in zip(at, at[1:])]
        self.lengths = sorted({min(n, SEED) for n in sizes.tolist() if n})
        owner, seeds = _seeds(sizes, h, self.lengths, True)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], owner[order]

    def matches(self, texts: pa.StringArray, threshold: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item, coverage, tiles, longest tile) of the contaminated texts."""
        if not len(self.seeds):
            return []
        sizes, h = plain_words(texts)
        owner, seeds = _seeds(sizes, h, self.lengths, False)
        place = np.minimum(np.searchsorted(self.seeds, seeds), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[place] == seeds)
        pairs = defaultdict(set)
        for row, s in set(zip(owner[hit].tolist(), seeds[hit].tolist())):
            s = np.uint64(s)
            pairs[row].update(self.owner[np.searchsorted(self.seeds, s) : np.searchsorted(self.seeds, s, side="right")].tolist())
        at, out = starts(sizes), []
        for row in sorted(pairs):
            text = h[at[row] : at[row + 1]]
            for item in sorted(pairs[row]):
                found = tiled(self.words[item], text, threshold)
                if found:
                    out.append((row, self.ids[item], *found))
        return out


_ITEMS: dict[int, Items] = {}


def _opened(shipped) -> Items:
    if shipped.id not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[shipped.id] = Items(shipped.value)
    return _ITEMS[shipped.id]


class _Shipped:
    """A broadcast with a name of its own, so that a worker builds a block once."""

    def __init__(self, broadcast):
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _items(benchmark: DataFrame, id_col: str, text_col: str, least_words: int = 1) -> tuple[DataFrame, bool]:
    """(id and text of the items with so many words or more, whether they are few enough to travel)."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    if least_words > 1:

        def long(batches):
            for batch in batches:
                yield batch.filter(pa.array(plain_words(texts_of(batch.column(1)))[0] >= least_words))

        items = items.mapInArrow(long, items.schema)
    return items, items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0] <= MOST_BYTES


def _shipped(items: DataFrame) -> _Shipped:
    rows = sorted(((r.id, r.text) for r in items.collect()), key=str)  # MOST_BYTES at most
    return _Shipped(items.sparkSession.sparkContext.broadcast(rows))


def _joined(rows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """``(row, item_id, coverage, tiles, longest)`` from rows (row, text) and items (id, text), by shuffles."""
    items = keyed(items, "item")

    def lengths(batches):
        for batch in batches:
            sizes = plain_words(texts_of(batch.column(0)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(sizes[sizes > 0], SEED)))], ["k"])

    levels = sorted(r.k for r in items.select("text").mapInArrow(lengths, "k long").distinct().collect())  # SEED at most

    def seeds(shipped=None):
        def run(batches):
            for batch in slices(batches, "text", 8 << 20):
                owner, h = _seeds(*plain_words(texts_of(batch.column(1))), levels, shipped is None)
                if shipped is not None:
                    keep = passes(h.view(np.int64), shipped.value)
                    owner, h = owner[keep], h[keep]
                both = np.unique(np.stack([owner.astype(np.uint64), h], 1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both[:, 0].astype(np.int64))), pa.array(np.ascontiguousarray(both[:, 1]).view(np.int64))], ["row", "seed"])

        return run

    kind = "row long, seed long"
    own = materialise(items.select("item", "text").mapInArrow(seeds(), kind).toDF("item", "seed"), "item-seeds")
    filter_ = rows.sparkSession.sparkContext.broadcast(seen_filter(own.select("seed").distinct()))  # bounded bits
    met = rows.select("row", "text").mapInArrow(seeds(filter_), kind).join(own, "seed").select("row", "item").distinct()
    both = met.join(items.select("item", F.col("id").alias("item_id"), F.col("text").alias("b")), "item").join(rows.select("row", F.col("text").alias("a")), "row")

    def verify(batches):
        for batch in slices(batches, "a", 8 << 20):
            (n, h), (m, g) = plain_words(texts_of(batch.column(2))), plain_words(texts_of(batch.column(3)))
            at, to, out = starts(n), starts(m), []
            for k in range(batch.num_rows):
                found = tiled(g[to[k] : to[k + 1]], h[at[k] : at[k + 1]], threshold)
                if found:
                    out.append((k, *found))
            some = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), *(pa.array([o[c] for o in out], t) for c, t in ((1, pa.float64()), (2, pa.int64()), (3, pa.int64())))], ["row", "item_id", "coverage", "tiles", "longest"])

    return both.select("row", "item_id", "a", "b").mapInArrow(verify, "row long, item_id long, coverage double, tiles long, longest long")


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id, item_id, coverage, tiles, longest)``: one row for each document and item that contaminates it."""
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items, few = _items(benchmark, item_col, item_text)
    if not few:
        rows = keyed(source, "row")
        found = _joined(rows, items, threshold).join(rows.select("row", "id"), "row")
        return found.select(F.col("id").alias(id_col), "item_id", "coverage", "tiles", "longest")
    kind, shipped = source.schema["id"].dataType.simpleString(), _shipped(items)

    def run(batches):
        items = _opened(shipped)
        for batch in slices(batches, "text", 8 << 20):
            got = items.matches(texts_of(batch.column(1)), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([g[0] for g in got], pa.int64())), *(pa.array([g[k] for g in got], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64())))], ["id", "item_id", "coverage", "tiles", "longest"])

    return source.mapInArrow(run, f"id {kind}, item_id long, coverage double, tiles long, longest long").withColumnRenamed("id", id_col)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least_words: int = TILE) -> DataFrame:
    """The rows of ``documents`` that no item of ``least_words`` or more contaminates, with all their columns."""
    items, few = _items(benchmark, item_col, item_text, least_words)
    if not few:
        row = free_name("row", documents)
        rows = keyed(documents, row)
        found = _joined(rows.select(F.col(row).alias("row"), F.col(text_col).alias("text")), items, threshold)
        return rows.join(found.select(F.col("row").alias(row)).distinct(), row, "left_anti").select(*(rows[c] for c in documents.columns))
    shipped = _shipped(items)

    def run(batches):
        items = _opened(shipped)
        for batch in slices(batches, text_col, 8 << 20):
            keep = np.ones(batch.num_rows, bool)
            keep[[g[0] for g in items.matches(texts_of(batch.column(text_col)), threshold)]] = False
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
