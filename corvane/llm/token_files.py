"""Operator 9: token ids in byte-aligned variable-length files.

1. Each distinct piece of the corpus is encoded once with the ``tokenizers`` library; the result is kept
   in hash-ordered arrays that workers map into memory.
2. Ids are numbered by descending corpus frequency, so frequent ones take one data byte.
   Pieces with equal hashes are compared byte by byte; two different ones stop the job.
3. Documents are laid out in ascending id order over files. A document's record is its control bytes (two
   bits for each number: data bytes less one, four numbers to a byte) followed by the data bytes, low byte
   first; the last group is filled with zeros. A file ends with an index of (doc_id, numbers, record bytes)
   and the count of documents.
4. Reading decodes with a 256-entry table of lengths.

Defined cases: a null or empty text is the end id alone; rows with equal doc_id keep an arbitrary order among
themselves (their own texts decide their digests); a null doc_id sorts first; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import arrays
from corvane.llm.words import gather, hashes, pieces, raw, slices, starts, texts_of
from corvane.session import scratch, shuffle_width

END_ID = 0
#: Lengths of the four numbers of each control byte.
LENGTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)


def pack(sizes: np.ndarray, values: np.ndarray) -> list[bytes]:
    """One record for each segment of non-negative numbers below 2**32."""
    groups = -(-sizes // 4)
    at, padded = starts(sizes), np.zeros(int(groups.sum()) * 4, np.uint32)
    place = np.arange(len(values)) + np.repeat(starts(groups)[:-1] * 4 - at[:-1], sizes)
    padded[place] = values
    code = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    ends = starts(code.astype(np.int64) + 1)
    data = np.zeros(int(ends[-1]), np.uint8)
    for k in range(4):
        has = code >= k
        data[ends[:-1][has] + k] = (padded[has] >> np.uint32(8 * k)) & 0xFF
    c, d = starts(groups), ends[starts(groups) * 4]
    control, data = control.tobytes(), data.tobytes()
    return [control[c[i] : c[i + 1]] + data[d[i] : d[i + 1]] for i in range(len(sizes))]


def unpack(sizes: np.ndarray, records: list[bytes]) -> np.ndarray:
    """The numbers of all records in order."""
    groups = -(-sizes // 4)
    control = np.frombuffer(b"".join(r[:g] for r, g in zip(records, groups)), np.uint8)
    data = np.frombuffer(b"".join(r[g:] for r, g in zip(records, groups)) + b"\0\0\0", np.uint8).astype(np.uint32)
    length = LENGTHS[control].ravel()
    at = starts(length)[:-1]
    keep = gather(starts(groups)[:-1] * 4, sizes, np.arange(len(sizes)))
    at, length = at[keep], length[keep]
    out = data[at]
    for k in range(1, 4):
        more = length > k
        if more.any():
            out[more] |= data[at[more] + k] << np.uint32(8 * k)
    return out


class Encoder:
    """The library's tokenizer over many short pieces."""

    def __init__(self, text: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        n = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(n)])

    def __call__(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each piece, ids in order). Pieces that are one space and a run without white space are
        encoded as one string: only their first token opens with a space."""
        simple = pc.match_substring_regex(words, r"^ [!-~À-ÖØ-öø-ÿ]+$").to_numpy(zero_copy_only=False)
        sizes, parts = np.zeros(len(words), np.int64), {}
        rows = np.flatnonzero(simple)
        for a in range(0, len(rows), 1 << 16):
            some = rows[a : a + (1 << 16)]
            ids = np.array(self.tokenizer.encode("".join(words.take(pa.array(some)).to_pylist()), add_special_tokens=False).ids, np.int32)
            first = np.flatnonzero(self.opens[ids])
            if len(first) != len(some):
                raise ValueError("the tokenizer joins what it should cut before a space")
            sizes[some] = np.diff(np.append(first, len(ids)))
            parts[a] = ids
        rest = np.flatnonzero(~simple)
        for a in range(0, len(rest), 1 << 13):
            some = rest[a : a + (1 << 13)]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words.take(pa.array(some)).to_pylist(), add_special_tokens=False)]
            sizes[some] = [len(x) for x in got]
            parts[len(rows) + a] = np.array([y for x in got for y in x], np.int32)
        order = np.concatenate([rows, rest])
        flat = np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.zeros(0, np.int32)
        at = np.zeros(len(words), np.int64)
        at[order] = starts(sizes[order])[:-1]
        return sizes, flat[gather(at, sizes, np.arange(len(words)))]


class PieceTable:
    """Hash -> ids over the files of all shards; a shard is a range of the hash."""

    def __init__(self, root: str, shards: int):
        self.root, self.shards, self.open = root, shards, {}

    def _shard(self, b: int):
        if b not in self.open:
            self.open[b] = (arrays.mapped(self.root, f"hash-{b}", np.uint64), arrays.mapped(self.root, f"at-{b}", np.int64), arrays.mapped(self.root, f"ids-{b}", np.int32))
        return self.open[b]

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h)
        h = h[order]
        edge = np.searchsorted(shard_of(h, self.shards), np.arange(self.shards + 1))
        sizes, parts = np.zeros(len(h), np.int64), []
        for b in range(self.shards):
            lo, hi = edge[b], edge[b + 1]
            if lo == hi:
                continue
            keys, at, ids = self._shard(b)
            k = np.searchsorted(keys, h[lo:hi])
            if (k >= len(keys)).any() or (keys[k] != h[lo:hi]).any():
                raise KeyError("a piece is missing from the table")
            sizes[lo:hi] = at[k + 1] - at[k]
            parts.append(ids[gather(at[:-1], np.diff(at), k)])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        back_n, back_at = np.empty_like(sizes), np.empty_like(sizes)
        back_n[order], back_at[order] = sizes, starts(sizes)[:-1]
        return back_n, flat[gather(back_at, back_n, np.arange(len(h)))]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


_TOKENIZERS: dict[int, Encoder] = {}
_TABLES: dict[str, PieceTable] = {}


def write_token_files(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> tuple[DataFrame, str]:
    """(the files: file, first, docs, tokens; their folder). ``first`` is the number of ids before the file."""
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    source = documents.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text")
    root, shards = scratch(spark, "token-files"), shuffle_width(spark)

    def distinct(batches):
        for batch in slices(batches, "text", 12 << 20):
            _, codes, words = pieces(texts_of(batch.column("text")))
            by = shard_of(hashes(words), shards)
            order = np.argsort(by, kind="stable")
            count = np.bincount(codes, minlength=len(words)).astype(np.uint32)[order]
            words, edge = words.take(pa.array(order)), np.searchsorted(by[order], np.arange(shards + 1))
            offsets, data = raw(words)
            some = np.flatnonzero(np.diff(edge))
            cells = [(data[offsets[edge[b]] : offsets[edge[b + 1]]].tobytes(), np.diff(offsets[edge[b] : edge[b + 1] + 1]).astype(np.uint32).tobytes(), count[edge[b] : edge[b + 1]].tobytes()) for b in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array([c[k] for c in cells], pa.binary()) for k in range(3))], ["shard", "pieces", "sizes", "counts"])

    def encode(batches):
        key = hash(shipped.value)
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = Encoder(shipped.value)
        got = [(b, *cells) for batch in batches for b, *cells in zip(*(batch.column(k).to_pylist() for k in range(4)))]
        if not got:
            return
        data = b"".join(g[1] for g in got)
        offsets = starts(np.frombuffer(b"".join(g[2] for g in got), np.uint32).astype(np.int64))
        n = np.frombuffer(b"".join(g[3] for g in got), np.uint32).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data))
        keys, first, inverse = np.unique(hashes(words), return_index=True, return_inverse=True)
        known, words = words, words.take(pa.array(first))
        if not pc.all(pc.equal(known, words.take(pa.array(inverse)))).as_py():
            raise ValueError("two different pieces share a hash")
        total = np.bincount(inverse, weights=n, minlength=len(keys))
        sizes, ids = _TOKENIZERS[key](words)
        at, edge = starts(sizes), np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
        for b in sorted({g[0] for g in got}):
            lo, hi = edge[b], edge[b + 1]
            arrays.put(root, f"hash-{b}", keys[lo:hi])
            arrays.put(root, f"at-{b}", at[lo : hi + 1] - at[lo])
            arrays.put(root, f"ids-{b}", ids[at[lo] : at[hi]])
        count = np.bincount(ids, weights=np.repeat(total, sizes))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some].astype(np.int64))], ["token", "n"])

    pieces_of = source.select("text").mapInArrow(distinct, "shard int, pieces binary, sizes binary, counts binary")
    counts = pieces_of.repartition(shards, "shard").mapInArrow(encode, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    # bounded by the vocabulary; ids that do not occur follow in id order
    ids_of = np.array([r.token for r in sorted(counts, key=lambda r: (-r.n, r.token))], np.int64)
    known = np.union1d(ids_of, [end_id])
    ids_of = np.concatenate([ids_of, np.setdiff1d(known, ids_of)]).astype(np.uint32)
    rank_of = np.zeros(int(ids_of.max()) + 1, np.uint32)
    rank_of[ids_of] = np.arange(len(ids_of))
    arrays.put(root, "ids-by-rank", ids_of)
    files = shards
    bounds = source.where("id is not null").approxQuantile("id", [k / files for k in range(1, files)], 0.1 / files) if files > 1 else []
    bounds = np.array(bounds, np.int64)

    def records(batches):
        if root not in _TABLES:
            _TABLES.clear()
            _TABLES[root] = PieceTable(root, shards)
        for batch in slices(batches, "text", 6 << 20):
            ids = batch.column("id")
            count, codes, words = pieces(texts_of(batch.column("text")))
            sizes, flat = _TABLES[root](hashes(words))
            per_piece = sizes[codes]
            n = np.zeros(batch.num_rows, np.int64)
            np.add.at(n, np.repeat(np.arange(batch.num_rows), count), per_piece)
            tokens = rank_of[flat][gather(starts(sizes)[:-1], sizes, codes)]
            full = np.full(int(n.sum()) + len(n), rank_of[end_id], np.uint32)
            full[gather(starts(n + 1)[:-1], n, np.arange(len(n)))] = tokens
            number = np.searchsorted(bounds, pc.fill_null(ids, -(2**63)).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), ids, pa.array(n + 1), pa.array(pack(n + 1, full), pa.binary())], ["file", "id", "n", "record"])

    def write(batches):
        sink, index, done = None, [], []

        def close():
            flat = np.array(index, np.int64).reshape(-1, 4)
            sink.write(flat.tobytes() + np.array([len(flat)], np.int64).tobytes())
            sink.close()
            done.append((number, len(flat), int(flat[:, 2].sum())))

        number = None
        for batch in batches:
            for f, i, n, r in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if f != number:
                    if sink is not None:
                        close()
                    number, sink, index = f, arrays.Sink(root, f"tokens-{f}"), []
                index.append((i if i is not None else 0, i is None, n, len(r)))
                sink.write(r)
        if sink is not None:
            close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([d[0] for d in done], pa.int32()), "docs": pa.array([d[1] for d in done], pa.int64()), "tokens": pa.array([d[2] for d in done], pa.int64())})

    laid = source.mapInArrow(records, "file int, id long, n long, record binary").repartition(files, "file").sortWithinPartitions("file", "id")
    written = sorted(laid.mapInArrow(write, "file int, docs long, tokens long").collect())  # one row for each file
    before, rows = 0, []
    for r in written:
        rows.append((r.file, before, r.docs, r.tokens))
        before += r.tokens
    return spark.createDataFrame(rows, "file int, first long, docs long, tokens long"), root


def read_token_files(files: DataFrame, root: str, id_col: str = "doc_id", block: int = 4 << 20) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, decoded from the files."""

    def read(batches):
        ids_of = arrays.mapped(root, "ids-by-rank", np.uint32)
        for batch in batches:
            for number, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                data = arrays.mapped(root, f"tokens-{number}", np.uint8)
                docs = int(data[-8:].view(np.int64)[0])
                index = data[len(data) - 8 - docs * 32 : len(data) - 8].tobytes()
                index = np.frombuffer(index, np.int64).reshape(-1, 4)
                at, begin = starts(index[:, 3]), first + starts(index[:, 2])
                group = at[:-1] // block
                edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), docs]
                for a, b in zip(edges, edges[1:]):
                    if a == b:
                        continue
                    ids = ids_of[unpack(index[a:b, 2], [data[at[k] : at[k + 1]].tobytes() for k in range(a, b)])].astype("<u4")
                    cut = starts(index[a:b, 2])
                    crc = [zlib.crc32(ids[cut[k] : cut[k + 1]]) for k in range(b - a)]
                    yield pa.RecordBatch.from_arrays([pa.array(index[a:b, 0], mask=index[a:b, 1] == 1), pa.array(begin[a:b]), pa.array(index[a:b, 2]), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.repartition(n, "file").mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def encode_and_read_back(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    files, root = write_token_files(documents, tokenizer_path)
    return read_token_files(files, root)
