"""Operator 13: exact top-k lexical search with buckets of impact vectors ordered by length.

A document's score for an item is an inner product: the item's vector has a term's repeats times its weight, the document's
vector its impacts. With the weight of a term shared out evenly (its root on each side), the score is at most the product of both
lengths. So documents are ordered by the length of their vectors and searched bucket by bucket:

- an item skips a bucket if its own length times the bucket's longest vector stays below the item's threshold, which is the k-th
  best score known so far; whole row groups go by a filter on the stored length;
- inside a bucket, products over the item's heaviest coordinates bound each document's score; the rest is bounded by Cauchy-Schwarz
  over what is left of both vectors and by the bucket's largest value of each coordinate, whichever is less; only documents
  whose bound reaches the threshold survive;
- survivors are scored again over all coordinates in 64-bit integers, and only these scores are reported.

Bounds are taken a little too high, so that rounding loses nothing. Thresholds come from a first round over the longest
vectors; in the second round they are set for all tasks, and each task raises them by what it finds.

Vectors hold the terms of the items only. Counts (documents, terms, documents of a term) are of the whole corpus. Items travel to the
workers in blocks of ``MOST_BYTES``; the vocabulary of a block and its counts are the only things that reach the driver, besides one
threshold an item. Tasks report ``k`` documents an item at most, and the last step takes the best of these.

Defined cases: null texts and texts without a term count nowhere; an item without a term, with a null text, or with no document that
scores above 0 has no rows; items with equal ids are ranked one by one; repeated rows are documents of their own; equal scores
rank by id, a null id last; empty tables give no rows; further columns are ignored. Ids are whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.llm.words import raw, segment_sum, slices, split_words, starts, texts_of
from corvane.session import materialise, shuffle_width

#: Items of so many bytes are searched at once.
MOST_BYTES = 4 << 20
#: Documents in a bucket. The share of documents in the first round. What bounds are raised by, against rounding.
BUCKET, FIRST, SLACK = 4096, 0.05, 1 + 1e-9
#: The heaviest coordinates of an item that bounds look at hold this share of its squared length.
FOCUS = 0.9
#: Bytes of terms as lower case, all others as a blank.
_PLAIN = np.full(256, 0x20, np.uint8)
for _a, _b, _shift in ((0x30, 0x3A, 0), (0x41, 0x5B, 32), (0x61, 0x7B, 0), (0x80, 0x100, 0)):
    _PLAIN[_a:_b] = np.arange(_a, _b) + _shift


def split_terms(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(terms of each text, term codes of all texts in order, distinct terms)."""
    offsets, data = raw(texts)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(_PLAIN[data].tobytes()))
    return split_words(plain)


class Items:
    """A block of items: vocabulary, and for each item its terms and their repeats."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        sizes, codes, words = split_terms(texts_of(pa.array(texts, pa.string())))
        self.ids, self.vocabulary = ids, words
        cuts = np.split(codes, starts(sizes)[1:-1]) if len(ids) else []
        self.terms = [np.unique(c, return_counts=True) for c in cuts]

    def weigh(self, documents: int, held: np.ndarray) -> np.ndarray:
        """The weight of each term of the vocabulary."""
        return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)


def _index(documents: DataFrame, shipped) -> DataFrame:
    """``(id, n, terms, tfs)`` of every document with a term: its length, and the items' terms that it holds."""

    def run(batches):
        vocabulary = shipped.value
        for batch in slices(batches, "text", 8 << 20):
            n, codes, words = split_terms(texts_of(batch.column(1)))
            known = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
            term, doc = known[codes], np.repeat(np.arange(len(n)), n)
            keys, tf = np.unique((doc * max(len(vocabulary), 1) + term)[term >= 0], return_counts=True)
            doc, term = np.divmod(keys, max(len(vocabulary), 1))
            offsets = pa.array(starts(np.bincount(doc, minlength=len(n))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return documents.mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


def _counts(index: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, their terms, documents that hold each term of the vocabulary)."""

    def run(batches):
        held, documents, total = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            held += np.bincount(batch.column(1).flatten().to_numpy(zero_copy_only=False), minlength=terms)
            documents, total = documents + batch.num_rows, total + (pc.sum(batch.column(0)).as_py() or 0)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int32()), pa.array([documents, total, *held[some].tolist()], pa.int64())], ["term", "n"])

    rows = index.select("n", "terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary at most
    found, held = dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())), np.zeros(terms, np.int64)
    for term, n in found.items():
        if term >= 0:
            held[term] = n
    return found.get(-2, 0), found.get(-1, 0), held


def _vectors(index: DataFrame, documents: int, total: int, shipped) -> DataFrame:
    """``(length, id, terms, impacts)``, in buckets: written by descending length, equal lengths over several tasks."""

    def run(batches):
        weights = shipped.value
        roots = np.sqrt(weights.astype(np.float64))
        for batch in batches:
            n, lists, tfs = batch.column(1).to_numpy(), batch.column(2), batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            m = np.repeat(75 + 25 * n * documents // total, sizes)
            impact = 1_000_000_000 * tfs // (1000 * tfs + 12 * m)
            use = (weights[terms] > 0) & (impact > 0)
            doc = np.repeat(np.arange(len(n)), sizes)[use]
            terms, impact = terms[use], impact[use]
            sizes = np.bincount(doc, minlength=len(n))
            length = np.sqrt(segment_sum((impact * roots[terms]) ** 2, sizes))
            offsets = pa.array(starts(sizes), pa.int32())
            arrays = [pa.array(length), batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(impact, pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["length", "id", "terms", "impacts"]).filter(pa.array(sizes > 0))

    rows = index.mapInArrow(run, "length double, id long, terms array<int>, impacts array<int>")
    order = F.col("length").desc()
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange(shuffle_width(index.sparkSession), order, F.col("salt"))
    return materialise(ranged.sortWithinPartitions(order).drop("salt"), "vectors")


class Best:
    """The k best documents of one item in one task."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold = k, threshold
        self.score, self.id, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        score, ids, none = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.none, none)))
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.id, self.none = score[order], ids[order], none[order]
        if len(order) == self.k:
            self.threshold = max(self.threshold, int(self.score[-1]))


def search_bucket(length: np.ndarray, ids: np.ndarray, none: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, queries: list, best: list[Best], roots: np.ndarray) -> tuple[int, int, int]:
    """Search one bucket for every item; ``queries`` has (terms by falling weight, integer weights, vector, its length, terms in focus).
    Returns how many (item, document) pairs the bucket, the bounds and the scoring saw."""
    n, at = len(length), starts(sizes)
    order = np.argsort(terms, kind="stable")
    by_term, doc_of, square = terms[order], np.repeat(np.arange(n), sizes)[order], impacts[order] * roots[terms[order]]
    longest, dense, most = float(length.max()), np.zeros(len(roots), np.int64), np.zeros(len(roots))
    np.maximum.at(most, by_term, square)
    seen = [0, 0, 0]
    for (own, weights, vector, size, focus), top in zip(queries, best):
        need = max(top.threshold, 1)
        if size * longest * SLACK < need:
            continue
        seen[0] += n
        # products over the coordinates in focus, and what of each document's squared length they use up
        first, last = np.searchsorted(by_term, own[:focus]), np.searchsorted(by_term, own[:focus], side="right")
        count = last - first
        pick = np.repeat(first - starts(count)[:-1], count) + np.arange(int(count.sum()))
        where, value = doc_of[pick], square[pick]
        product = np.bincount(where, weights=value * np.repeat(vector[:focus], count), minlength=n)
        used = np.bincount(where, weights=value * value, minlength=n)
        # the other coordinates: by the lengths that are left, and by the largest value of each in the bucket
        rest = math.sqrt(float((vector[focus:] ** 2).sum()))
        largest = float((vector[focus:] * most[own[focus:]]).sum())
        bound = product + np.minimum(rest * np.sqrt(np.maximum(length * length - used, 0) + 1e-9 * length * length), largest)
        keep = np.flatnonzero(bound * SLACK >= need)
        if not len(keep):
            continue
        seen[1] += len(keep)
        dense[own] = weights
        count = sizes[keep]
        pick = np.repeat(at[keep] - starts(count)[:-1], count) + np.arange(int(count.sum()))
        score = segment_sum(dense[terms[pick]] * impacts[pick], count)
        dense[own] = 0
        good = score >= need
        if good.any():
            seen[2] += int(good.sum())
            top.add(score[good], ids[keep[good]], none[keep[good]])
    return tuple(seen)


def prepared(items: Items, weights: np.ndarray) -> list:
    """The items' vectors for ``search_bucket``."""
    out = []
    for terms, repeats in items.terms:
        own = weights[terms] > 0
        terms, repeats = terms[own], repeats[own]
        vector = repeats * np.sqrt(weights[terms].astype(np.float64))
        order = np.argsort(-vector, kind="stable")
        terms, repeats, vector = terms[order], repeats[order], vector[order]
        squared = np.cumsum(vector**2)
        focus = int(np.searchsorted(squared, FOCUS * squared[-1])) + 1 if len(squared) else 0
        out.append((terms, weights[terms] * repeats, vector, math.sqrt(float(squared[-1])) if len(squared) else 0.0, focus))
    return out


def _search(vectors: DataFrame, shipped, thresholds: np.ndarray, k: int) -> DataFrame:
    """``(item, id, score)``: the best ``k`` documents of every task for each item, none below the thresholds."""

    def run(batches):
        queries, weights = shipped.value
        roots, best = np.sqrt(weights.astype(np.float64)), [Best(k, int(t)) for t in thresholds]
        for batch in batches:
            for a in range(0, batch.num_rows, BUCKET):
                part = batch.slice(a, BUCKET)
                lists = part.column(2)
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                terms, impacts = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                ids = part.column(1)
                search_bucket(part.column(0).to_numpy(), pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), sizes, terms, impacts, queries, best, roots)
        item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        ids, none, score = (np.concatenate([getattr(b, x) for b in best]) if best else np.zeros(0, np.int64) for x in ("id", "none", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids.astype(np.int64), pa.int64(), mask=none.astype(bool)), pa.array(score.astype(np.int64), pa.int64())], ["item", "id", "score"])

    return vectors.mapInArrow(run, "item int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _block(documents: DataFrame, items: Items, k: int) -> DataFrame:
    """``(item, rank, id, score)`` for one block of items."""
    spark = documents.sparkSession
    send = spark.sparkContext.broadcast
    index = materialise(_index(documents, send(items.vocabulary)), "index")
    number, total, held = _counts(index, len(items.vocabulary))
    weights = items.weigh(number, held)
    vectors = _vectors(index, number, max(total, 1), send(weights))
    queries = prepared(items, weights)
    shipped = send((queries, weights))
    thresholds = np.zeros(len(queries), np.int64)
    cut = vectors.agg(F.percentile_approx("length", 1 - FIRST, 1000)).first()[0]
    if cut is None:
        return spark.createDataFrame([], "item int, rank int, id long, score long")
    first = materialise(_best(_search(vectors.where(F.col("length") >= cut), shipped, thresholds, k), k), "first")
    for r in first.where(F.col("rank") == k).select("item", "score").collect():  # one row an item
        thresholds[r["item"]] = r["score"]
    reach = [t / q[3] for t, q in zip(thresholds.tolist(), queries) if q[3]]
    least = min(reach, default=0.0) / SLACK
    rest = _search(vectors.where((F.col("length") < cut) & (F.col("length") >= least)), shipped, thresholds, k)
    return _best(first.select("item", "id", "score").unionByName(rest), k)


def rank(documents: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item, from 1."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-size // MOST_BYTES)
    if blocks > 1:
        asked = materialise(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        some = (asked.where(F.col("block") == block) if blocks > 1 else asked).select("item_id", "text").toArrow()  # about MOST_BYTES
        own = Items(some.column(0).to_pylist(), some.column(1).to_pylist())
        names = F.broadcast(spark.createDataFrame([(i, x) for i, x in enumerate(own.ids)], "item int, item_id long"))
        found = _block(rows, own, k).join(names, "item")
        out = out.unionByName(found.select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), i AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
words AS (SELECT r, doc_id, {_TERMS} AS term FROM d), tf AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r), total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), q AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, {_TERMS} AS term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM df, total),
scored AS (SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (r), total GROUP BY ALL)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS k FROM scored WHERE score > 0) WHERE k <= 20"""
