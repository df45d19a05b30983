"""Operator 2: interpolated modified Kneser-Ney bigram model, counted in Spark, read from mapped arrays.

Words are runs of bytes other than space and 0x09 to 0x0D with A-Z in lower case, then one end token. Three jobs build the
model in the shared folder:

1. word counts, summed in each batch and then by ranges of the word hash. A shard is a sorted array of hashes
   with its counts, and a word's id is its place over all shards;
2. pair counts keyed by (id << 32 | id), summed in each batch and then by ranges of the mixed key, stored as a
   sorted key array with one-byte counts and a list of the larger ones;
3. from the pairs of each shard the sums by left id (total, and pairs seen once, twice, more often) and by right
   id (distinct left neighbours), laid out as dense arrays over ranges of ids.

Rows that cross the shuffles are packed arrays, already summed, spread by hash, so a frequent word costs one entry
for each batch. Workers map the arrays and search only the distinct words and pairs of their batch. The number of
shards is ``spark.sql.shuffle.partitions``, so what one task holds falls as that is raised with the data.

Defined cases: a null or empty text is the end token alone; a text of any length is scored whole; an empty training
part gives probability 1 to every token; rows with equal ids are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import arrays
from corvane.llm.words import gather, hashes, mix, segment_sum, slices, split_words, starts, texts_of
from corvane.llm.token_files import shard_of
from corvane.session import scratch, shuffle_width

END = np.uint64(0)
BIG = 255
_MOST = np.int64(2**32 - 1)


def tokens(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, token codes in order, hash of each code); the last code is the end token."""
    sizes, codes, words = split_words(pc.ascii_lower(texts))
    h = np.append(hashes(words), END)
    full = np.full(int(sizes.sum()) + len(sizes), len(words), np.int64)
    full[gather(starts(sizes + 1)[:-1], sizes, np.arange(len(sizes)))] = codes
    return sizes + 1, full, h


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


def _packed(by: np.ndarray, parts: int, *columns: np.ndarray):
    """One row for each part with entries: its number and the bytes of the columns there. ``by`` is sorted."""
    edge = np.searchsorted(by, np.arange(parts + 1))
    some = np.flatnonzero(np.diff(edge))
    cells = [[c[edge[b] : edge[b + 1]].tobytes() for b in some] for c in columns]
    return [pa.array(some.astype(np.int32)), *(pa.array(c, pa.binary()) for c in cells)]


def _joined(table: pa.Table, column: str, rows: np.ndarray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].take(pa.array(rows)).to_pylist()), dtype)


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3)]


class Model:
    """The arrays of one model folder, opened on demand."""

    def __init__(self, meta: dict):
        self.meta, self.open = meta, {}

    def _get(self, name: str, dtype) -> np.ndarray:
        if name not in self.open:
            kind, _, number = name.rpartition("-")
            if int(number) in self.meta["empty"].get(kind, ()):  # no entry fell into this range when the model was made
                self.open[name] = np.zeros(0, dtype)
            else:  # a file that is gone is an error
                self.open[name] = arrays.mapped(self.meta["root"], name, dtype)
        return self.open[name]

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, training count) of each word hash."""
        order = np.argsort(h)
        shards, offset = self.meta["shards"], self.meta["offset"]
        sorted_h = h[order]
        edge = np.searchsorted(shard_of(sorted_h, shards), np.arange(shards + 1))
        ids, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for b in np.flatnonzero(np.diff(edge)).tolist():
            if offset[b] == offset[b + 1]:
                continue
            keys, n = self._get(f"word-{b}", np.uint64), self._get(f"word-count-{b}", np.int64)
            want = sorted_h[edge[b] : edge[b + 1]]
            k = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[k] == want
            at = order[edge[b] : edge[b + 1]][hit]
            ids[at], count[at] = offset[b] + k[hit], n[k[hit]]
        return ids, count

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Training count of each distinct pair key."""
        shards = self.meta["shards"]
        by = shard_of(mix(keys), shards)
        order = np.lexsort((keys, by))
        edge = np.searchsorted(by[order], np.arange(shards + 1))
        out = np.zeros(len(keys), np.int64)
        for b in np.flatnonzero(np.diff(edge)).tolist():
            known = self._get(f"pair-{b}", np.uint64)
            if not len(known):
                continue
            at = order[edge[b] : edge[b + 1]]
            k = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            hit = known[k] == keys[at]
            n = self._get(f"pair-count-{b}", np.uint8)[k[hit]].astype(np.int64)
            big = np.flatnonzero(n == BIG)
            if len(big):
                place = self._get(f"pair-big-{b}", np.int64).reshape(-1, 2)
                n[big] = place[np.searchsorted(place[:, 0], k[hit][big]), 1]
            out[at[hit]] = n
        return out

    def dense(self, ids: np.ndarray) -> np.ndarray:
        """(len(ids), 5): total, once, twice, more, left neighbours; zeros for unknown ids."""
        out = np.zeros((len(ids), 5), np.int64)
        by = ids // self.meta["chunk"]
        for c in np.unique(by[ids >= 0]).tolist():
            at = np.flatnonzero(by == c)
            at = at[ids[at] >= 0]
            rows = self._get(f"dense-{c}", np.int64).reshape(-1, 5)
            if len(rows):
                out[at] = rows[ids[at] - c * self.meta["chunk"]]
        return out

    def score(self, texts: pa.StringArray) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, log10 probability under the base and under the model."""
        m = self.meta
        sizes, codes, h = tokens(texts)
        ids, count = self.ids(h)
        base = np.log10((count + 0.1) / (m["tokens"] + 0.1 * (m["words"] + 1)))
        begin = len(h)  # the code of the start of a text
        dense = self.dense(np.append(ids, m["words"]))
        lower = np.full(len(h), 1.0 / (m["words"] + 1))
        if m["pairs"]:
            d = np.array([0.0, *m["d_word"]])
            neighbours = dense[:-1, 4]
            lower = np.maximum(neighbours - d[np.minimum(neighbours, 3)], 0) / m["pairs"] + m["left_over"] * lower
        total = dense[:, 0]
        d = m["d_pair"]
        left_over = np.where(total > 0, (d[0] * dense[:, 1] + d[1] * dense[:, 2] + d[2] * dense[:, 3]) / np.maximum(total, 1), 1.0)
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[starts(sizes)[:-1]] = begin
        key_of = np.append(ids, m["words"])
        a, b = key_of[before], ids[codes]
        both = np.flatnonzero((a >= 0) & (b >= 0) & (total[before] > 0))
        keys, inverse = np.unique((a[both].astype(np.uint64) << np.uint64(32)) | b[both].astype(np.uint64), return_inverse=True)
        c = self.pairs(keys)
        c = np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0)
        p = left_over[before] * lower[codes]
        p[both] += c[inverse] / total[before[both]]
        return sizes, segment_sum((count[codes] > 0).astype(np.int64), sizes), segment_sum(base[codes], sizes), segment_sum(np.log10(p), sizes)


_MODELS: dict[str, Model] = {}


def opened(meta: dict) -> Model:
    """One model for each worker process."""
    if meta["root"] not in _MODELS:
        _MODELS.clear()
        _MODELS[meta["root"]] = Model(meta)
    model = _MODELS[meta["root"]]
    model.meta = meta  # it gains entries while the model is built
    return model


def fit(training: DataFrame, text_col: str = "text") -> dict:
    """Count the training texts and write the model; returns its description (a few numbers and array names)."""
    spark = training.sparkSession
    texts = training.select(F.col(text_col).alias("text"))
    root, shards = scratch(spark, "kneser-ney"), shuffle_width(spark)

    def count_words(batches):
        for batch in slices(batches, "text", 16 << 20):
            _, codes, h = tokens(texts_of(batch.column(0)))
            n = np.bincount(codes, minlength=len(h))
            order = np.argsort(h)
            order = order[n[order] > 0]
            yield pa.RecordBatch.from_arrays(_packed(shard_of(h[order], shards), shards, h[order], n[order].astype(np.int64)), ["shard", "keys", "counts"])

    def store_words(batches):
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))
        by, out = table["shard"].to_numpy(), []
        for b in np.unique(by).tolist():
            rows = np.flatnonzero(by == b)
            h, n = _sum_by(_joined(table, "keys", rows, np.uint64), _joined(table, "counts", rows, np.int64))
            arrays.put(root, f"word-{b}", h)
            arrays.put(root, f"word-count-{b}", n)
            out.append((b, len(h), int(n.sum())))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([o[0] for o in out], pa.int32()), "words": pa.array([o[1] for o in out], pa.int64()), "tokens": pa.array([o[2] for o in out], pa.int64())})

    counted = texts.mapInArrow(count_words, "shard int, keys binary, counts binary").repartition(shards, "shard")
    found = counted.mapInArrow(store_words, "shard int, words long, tokens long").collect()  # one row for each shard
    words = np.zeros(shards, np.int64)
    for r in found:
        words[r.shard] = r.words
    offset = starts(words)
    meta = {"root": root, "shards": shards, "offset": offset, "words": int(offset[-1]), "tokens": sum(r.tokens for r in found), "empty": {}}
    if meta["words"] >= 2**32 - 1:
        raise ValueError("a pair key holds two ids of 32 bits; split the vocabulary")
    meta["chunk"] = chunk = -(-(meta["words"] + 1) // shards)

    def count_pairs(batches):
        model = opened(meta)
        for batch in slices(batches, "text", 16 << 20):
            sizes, codes, h = tokens(texts_of(batch.column(0)))
            ids, _ = model.ids(h)
            right = ids[codes]
            left = np.empty_like(right)
            left[1:] = right[:-1]
            left[starts(sizes)[:-1]] = meta["words"]
            keys, n = np.unique((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), return_counts=True)
            by = shard_of(mix(keys), shards)
            order = np.argsort(by, kind="stable")
            yield pa.RecordBatch.from_arrays(_packed(by[order], shards, keys[order], n[order].astype(np.uint32)), ["shard", "keys", "counts"])

    def store_pairs(batches):
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))
        by = table["shard"].to_numpy()
        for b in np.unique(by).tolist():
            rows = np.flatnonzero(by == b)
            keys, n = _sum_by(_joined(table, "keys", rows, np.uint64), _joined(table, "counts", rows, np.uint32).astype(np.int64))
            arrays.put(root, f"pair-{b}", keys)
            arrays.put(root, f"pair-count-{b}", np.minimum(n, BIG).astype(np.uint8))
            big = np.flatnonzero(n >= BIG)
            arrays.put(root, f"pair-big-{b}", np.stack([big, n[big]], 1).astype(np.int64))
            left = (keys >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
            sums = [np.add.reduceat(x, first) for x in (n, n == 1, n == 2, n >= 3)]
            right, seen = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
            counts = np.bincount(np.minimum(n, 5), minlength=6)[1:5].astype(np.int64)
            zero = np.zeros(len(right), np.int64)
            ids = np.concatenate([left[first], right])
            cells = np.stack([np.concatenate([x, zero]) for x in sums] + [np.concatenate([np.zeros(len(first), np.int64), seen])], 1)
            over = np.flatnonzero((cells > _MOST).any(1))
            while len(over):  # a sum over 32 bits travels in several entries of its id
                ids, cells = np.concatenate([ids, ids[over]]), np.concatenate([cells, np.maximum(cells[over] - _MOST, 0)])
                cells[over] = np.minimum(cells[over], _MOST)
                over = np.flatnonzero((cells > _MOST).any(1))
            order = np.argsort(ids, kind="stable")
            ids, cells = ids[order], np.ascontiguousarray(cells[order].astype(np.uint32))
            chunks, local, data = _packed(ids // chunk, shards, (ids % chunk).astype(np.uint32), cells)
            extra = [counts.tobytes() if k == 0 else b"" for k in range(len(chunks))]
            yield pa.RecordBatch.from_arrays([chunks, local, data, pa.array(extra, pa.binary()), pa.array([len(keys) if k == 0 else 0 for k in range(len(chunks))], pa.int64())], ["chunk", "ids", "cells", "counts", "pairs"])

    def store_sums(batches):
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("chunk", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary()), ("counts", pa.binary()), ("pairs", pa.int64())]))
        by, pair, word, total = table["chunk"].to_numpy(), np.zeros(4, np.int64), np.zeros(4, np.int64), 0
        for c in np.unique(by).tolist():
            rows = np.flatnonzero(by == c)
            dense = np.zeros((chunk, 5), np.int64)
            for r in rows.tolist():
                ids = np.frombuffer(table["ids"][r].as_py(), np.uint32)
                np.add.at(dense, ids, np.frombuffer(table["cells"][r].as_py(), np.uint32).reshape(-1, 5))
            arrays.put(root, f"dense-{c}", dense)
            word += np.bincount(np.minimum(dense[:, 4], 5), minlength=6)[1:5]
        for x in table["counts"].to_pylist():
            pair += np.frombuffer(x, np.int64) if x else 0
        total = int(pc.sum(table["pairs"]).as_py() or 0)
        yield pa.RecordBatch.from_pydict({"pair": pa.array([pair.tolist()], pa.list_(pa.int64())), "word": pa.array([word.tolist()], pa.list_(pa.int64())), "pairs": pa.array([total], pa.int64())})

    pairs = texts.mapInArrow(count_pairs, "shard int, keys binary, counts binary").repartition(shards, "shard")
    sums = pairs.mapInArrow(store_pairs, "chunk int, ids binary, cells binary, counts binary, pairs long").repartition(shards, "chunk")
    found = sums.mapInArrow(store_sums, "pair array<long>, word array<long>, pairs long").collect()  # one row for each task
    there = arrays.names(root)
    meta["empty"] = {kind: {b for b in range(shards) if f"{kind}-{b}" not in there} for kind in ("pair", "pair-count", "pair-big", "dense")}
    meta["pairs"] = sum(r.pairs for r in found)
    meta["d_pair"] = discounts([sum(r.pair[k] for r in found) for k in range(4)])
    n_word = [sum(r.word[k] for r in found) for k in range(4)]
    meta["d_word"] = d = discounts(n_word)
    more = meta["words"] - n_word[0] - n_word[1]
    meta["left_over"] = (d[0] * n_word[0] + d[1] * n_word[1] + d[2] * more) / meta["pairs"] if meta["pairs"] else 1.0
    return meta


def score(documents: DataFrame, meta: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    source = documents.select(*keep, F.col(text_col).alias("text"))

    def run(batches):
        model = opened(meta)
        for batch in slices(batches, "text"):
            n, known, base, own = model.score(texts_of(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(n), pa.array(known), pa.array(np.full(len(n), meta["tokens"])), pa.array(base), pa.array(own), pa.array(10 ** (-own / n))], [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def fit_and_score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Learn from the rows whose crc32 of the id is not 0 modulo ``folds`` and score all rows."""
    marked = documents.select(F.col(id_col).alias("doc_id"), F.expr(f"coalesce(crc32(cast(cast(`{id_col}` as string) as binary)) % {folds} = 0, false)").alias("held_out"), F.col(text_col).alias("text"))
    meta = fit(marked.where("not held_out"))
    return score(marked, meta, ["doc_id", "held_out"])
