"""Operator 4: byte-level BPE encoding and decoding on padded numpy matrices.

Every text is cut by the tokenizer's pattern; distinct pieces of a batch are encoded once. Pieces of
similar byte length share one padded matrix, and each round merges the leftmost lowest-rank pair of
every row, looks up the two new pairs in a hash table and drops finished rows. A run longer than
``LONG`` bytes is a row of its own: its rounds merge all occurrences of the least pair at once and close the gaps.

Defined cases: a null or empty text gives no tokens (digests of the empty string); repeated rows give
equal rows; extra columns are ignored; text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from corvane.llm.words import gather, hashes, pieces, raw, slices, starts, texts_of

NONE = np.int32(2**31 - 1)
LONG = 192
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128, LONG)
#: Pieces that any version of Unicode sees as one optional space and letters.
PLAIN = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"


class PairTable:
    """Open addressing: pair of ids -> rank of the merged token."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(keys) * 2.5).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(at[todo], return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            todo = todo[~(free & first)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1) & (keys != -2))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class ByteBPE:
    """A tokenizer from the lines of a rank file: base64 of the bytes, a space, the rank (also the id)."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, rank_file.splitlines()) if t}
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, value = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), value.append(rank)
        self.pairs = PairTable((np.array(left, np.int64) << 32) | np.array(right, np.int64), np.array(value, np.int32))
        # a piece that is a token as a whole is that token, even where the merges end elsewhere
        whole = sorted(ranks, key=ranks.get)
        sizes, ids = self._merge_all(whole)
        at = starts(sizes)
        self.whole = {t: ranks[t] for k, t in enumerate(whole) if sizes[k] != 1 or ids[at[k]] != ranks[t]}
        self.whole_hash = np.sort(hashes(pa.array(self.whole.keys(), pa.binary()).cast(pa.string(), safe=False))) if self.whole else np.zeros(0, np.uint64)

    def _merge_all(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.merge(starts(np.fromiter(map(len, tokens), np.int64, len(tokens))), np.frombuffer(b"".join(tokens), np.uint8))

    def merge(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each byte string, ids in order)."""
        length = np.diff(offsets)
        sizes = np.minimum(length, 1)
        out = np.zeros(len(data), np.int32)  # a string's ids stand at its own first bytes
        ids = self.of_byte[data]
        out[offsets[:-1][length > 0]] = ids[offsets[:-1][length > 0]]
        low = 1
        for width in WIDTHS:
            rows = np.flatnonzero((length > low) & (length <= width))
            low = width
            for a in range(0, len(rows), 1 << 17):
                self._matrix(rows[a : a + (1 << 17)], width, offsets, length, ids, sizes, out)
        for row in np.flatnonzero(length > LONG).tolist():
            got = self._rounds(ids[offsets[row] : offsets[row + 1]])
            sizes[row] = len(got)
            out[offsets[row] : offsets[row] + len(got)] = got
        return sizes, out[gather(offsets[:-1], sizes, np.arange(len(sizes)))]

    def _matrix(self, rows, width, offsets, length, ids, sizes, out) -> None:
        place = offsets[rows][:, None] + np.arange(width)
        tokens = np.where(np.arange(width) < length[rows][:, None], ids[np.minimum(place, len(ids) - 1)], np.int32(-1))
        rank = self.pairs(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(rows), width - 1)
        left = length[rows].copy()
        column = np.arange(width)
        while len(rows):
            at = rank.argmin(1)
            every = np.arange(len(rows))
            best = rank[every, at]
            done = best == NONE
            if done.any():
                end = np.flatnonzero(done)
                sizes[rows[end]] = left[end]
                keep = column[None, :] < left[end][:, None]
                out[(offsets[rows[end]][:, None] + column)[keep]] = tokens[end][keep]
                go = ~done
                rows, tokens, rank, left, at, best = rows[go], tokens[go], rank[go], left[go], at[go], best[go]
                if not len(rows):
                    break
                every = np.arange(len(rows))
            tokens[every, at] = best
            right = column[None, 1:-1] > at[:, None]  # tokens after the merged pair move one to the left
            tokens[:, 1:-1] = np.where(right, tokens[:, 2:], tokens[:, 1:-1])
            tokens[:, -1] = -1
            rank[:, :-1] = np.where(column[None, : rank.shape[1] - 1] >= at[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            left -= 1
            inner = at < rank.shape[1]
            follow = np.where(at + 1 < tokens.shape[1], tokens[every, np.minimum(at + 1, tokens.shape[1] - 1)], -1)
            rank[every[inner], at[inner]] = self.pairs(best, follow)[inner]
            before = at > 0
            rank[every[before], at[before] - 1] = self.pairs(tokens[every[before], at[before] - 1], best[before])

    def _rounds(self, ids: np.ndarray) -> np.ndarray:
        """The merges of one long run. A round takes every occurrence of the least pair from the left, up to the first
        one whose merge opens a pair of lower rank; the result is that of one merge a round."""
        ids = ids.copy()
        rank = self.pairs(ids[:-1], ids[1:])
        while len(rank):
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            run = np.flatnonzero(np.append(True, np.diff(at) > 1))  # of overlapping occurrences every other one
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            before = np.where(at > 0, ids[np.maximum(at - 1, 0)], np.int32(-1))
            before[1:][np.diff(at) == 2] = best
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], np.int32(-1))
            merged = np.full(len(at), best, np.int32)
            lower = np.flatnonzero(np.minimum(self.pairs(before, merged), self.pairs(merged, after)) < best)
            if len(lower):
                at = at[: lower[0] + 1]
            ids[at] = best
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
            place = at - np.arange(len(at))
            place = np.unique(np.concatenate([place, place - 1]))
            place = place[(place >= 0) & (place < len(rank))]
            rank[place] = self.pairs(ids[place], ids[place + 1])
        return ids

    def encode_distinct(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each string, ids in order), each string cut by the pattern first."""
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        count = np.ones(len(words), np.int64)
        odd = np.flatnonzero(~plain)
        cut = [self.pattern.findall(w) for w in words.take(pa.array(odd)).to_pylist()]
        count[odd] = [len(x) for x in cut]
        flat = pa.concat_arrays([words.filter(pa.array(plain)), pa.array([y for x in cut for y in x], pa.string())])
        place = np.empty(int(count.sum()), np.int64)  # place in flat of each piece, in order
        at = starts(count)
        place[at[:-1][plain]] = np.arange(int(plain.sum()))
        place[gather(at[:-1], count, odd)] = np.arange(int(plain.sum()), len(flat))
        coded = flat.dictionary_encode()
        offsets, data = raw(coded.dictionary)
        sizes, ids = self.merge(offsets, data)
        if self.whole:
            h = hashes(coded.dictionary)
            near = np.flatnonzero(np.isin(h, self.whole_hash))
            fix = {int(k): self.whole[t] for k, t in zip(near, (x.encode() for x in coded.dictionary.take(pa.array(near)).to_pylist())) if t in self.whole}
            if fix:
                parts = np.split(ids, starts(sizes)[1:-1])
                for k, v in fix.items():
                    parts[k] = np.array([v], np.int32)
                sizes, ids = np.array([len(x) for x in parts], np.int64), np.concatenate(parts)
        picks = coded.indices.to_numpy().astype(np.int64)[place]
        per_piece = sizes[picks]
        total = np.zeros(len(words), np.int64)
        full = count > 0
        if full.any():
            total[full] = np.add.reduceat(per_piece, at[:-1][full])
        return total, ids[gather(starts(sizes)[:-1], sizes, picks)]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, ids in order)."""
        count, codes, distinct = pieces(texts)
        sizes, ids = self.encode_distinct(distinct)
        per_piece = sizes[codes]
        at = starts(count)
        total = np.zeros(len(texts), np.int64)
        full = count > 0
        if full.any():
            total[full] = np.add.reduceat(per_piece, at[:-1][full])
        return total, ids[gather(starts(sizes)[:-1], sizes, codes)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


_LOADED: dict[int, ByteBPE] = {}


def loaded(rank_file: bytes, pattern: str) -> ByteBPE:
    """One tokenizer for each worker process and file."""
    key = hash((rank_file, pattern))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(rank_file, pattern)
    return _LOADED[key]


def encode_documents(documents: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every whole text; null counts as empty."""
    shipped = documents.sparkSession.sparkContext.broadcast(_read(rank_path))

    def run(batches):
        bpe = loaded(shipped.value, pattern)
        for batch in slices(batches, "text", 4 << 20):
            total, ids = bpe.encode(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(starts(total).astype(np.int32)), pa.array(ids))], ["id", "ids"])

    source = documents.selectExpr(f"`{id_col}` id", f"`{text_col}` text")
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def round_trip(documents: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids and of what they decode to."""
    shipped = documents.sparkSession.sparkContext.broadcast(_read(rank_path))

    def run(batches):
        bpe = loaded(shipped.value, pattern)
        for batch in slices(batches, "text"):
            total, ids = bpe.encode(texts_of(batch.column(1)))
            at = starts(total).tolist()
            little = ids.astype("<u4")
            a, b = [], []
            for x, y in zip(at, at[1:]):
                a.append(hashlib.sha256(little[x:y]).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids[x:y])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = documents.selectExpr(f"`{id_col}` id", f"`{text_col}` text")
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


#: A rank file is broadcast whole; one over this many bytes is refused.
MOST_RANK_BYTES = 64 << 20


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_RANK_BYTES + 1)
    if len(data) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MOST_RANK_BYTES} bytes")
    return data
