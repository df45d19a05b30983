"""Arrow and numpy helpers shared by the text operators. They work on one Arrow batch inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words that are hashed at once.
HASHED = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), element by element."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def texts_of(column) -> pa.StringArray:
    """A batch's text column as one plain string array, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def split_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(words of each text, word codes of all texts in order, distinct words). A word is a run of bytes
    other than space and 0x09 to 0x0D."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    sizes = np.diff(parts.offsets.to_numpy()).astype(np.int64)
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # at the ends of a text
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sizes = sizes - np.bincount(doc[empty], minlength=len(sizes))
        flat = flat.filter(pa.array(~empty))
    coded = flat.dictionary_encode()
    return sizes, coded.indices.to_numpy().astype(np.int64), coded.dictionary


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MIX)
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        base = np.full(max(n, 1024), np.uint64(0x9E6C63D0876A9A47))
        base[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[0] = np.multiply.accumulate(base)
    return _POWERS[0]


def hashes(words: pa.Array | list) -> np.ndarray:
    """A 64-bit polynomial hash of each word's UTF-8 bytes over random byte values, then finalised."""
    if not isinstance(words, pa.Array):
        words = pa.array(words, pa.string())
    offsets, data = raw(words)
    sizes = np.diff(offsets)
    out = np.zeros(len(words), np.uint64)
    group = np.flatnonzero(np.diff(offsets[:-1] // HASHED)) + 1  # a few bytes at a time: a byte takes 40 while it is hashed
    for a, b in zip([0, *group.tolist()], [*group.tolist(), len(words)]):
        some, own = data[offsets[a] : offsets[b]], sizes[a:b]
        if len(some):
            place = np.arange(len(some)) - np.repeat(offsets[a:b] - offsets[a], own)
            with np.errstate(over="ignore"):
                terms = _BYTE[some] * _powers(int(own.max()))[place]
            out[a:b] = segment_sum(terms, own)
    with np.errstate(over="ignore"):
        return mix(out + sizes.astype(np.uint64) * MIX)


def raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string array."""
    n = len(words)
    kind = np.dtype(np.int64 if pa.types.is_large_string(words.type) or pa.types.is_large_binary(words.type) else np.int32)
    offsets = np.frombuffer(words.buffers()[1], kind, n + 1, words.offset * kind.itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    data = words.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def starts(sizes: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def segment_sum(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each consecutive segment; empty segments give 0. Each segment is summed on its own."""
    out = np.zeros(len(sizes), values.dtype)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts(sizes)[:-1][full])
    return out


def gather(parts_at: np.ndarray, parts_n: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Positions that lay the segments ``picks`` (start, length) of a flat array one behind another."""
    n = parts_n[picks]
    total = int(n.sum())
    at = np.repeat(parts_at[picks] - starts(n)[:-1], n)
    return at + np.arange(total)


def whitespace_safe_cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of lone spaces and lone newlines with no white space on either side.

    Byte-level pre-tokenisers always cut before such a space and on both sides of such a newline, so the
    pieces can be encoded apart. Where a neighbour might be the end or start of a non-ASCII white-space
    character the position is left out, which only makes a piece longer.
    """
    n = len(data)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < n - 1)]
    if not len(at):
        return at, at
    before, after = data[at - 1], data[at + 1]
    ascii_white = np.zeros(256, bool)
    ascii_white[[*range(9, 14), *range(28, 33)]] = True
    lead = np.zeros(256, bool)
    lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    ok = ~ascii_white[before] & ~ascii_white[after] & ~lead[after]
    high = before >= 0x80
    if high.any():
        two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        ok &= ~(high & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))
    at = at[ok]
    lines = data[at] == 10
    return at[~lines], at[lines]


def pieces(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(pieces of each text, piece codes in order, distinct pieces): the texts cut where every byte-level
    pre-tokeniser cuts them too. An empty text has no piece; the pieces of a text join to the text."""
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1).astype(np.int64)
    data_buffer = texts.buffers()[2]
    data = np.frombuffer(data_buffer, np.uint8)[: offsets[-1]] if data_buffer is not None else np.zeros(0, np.uint8)
    space, line = whitespace_safe_cuts(data)
    cut = np.zeros(len(data) + 1, bool)
    for x in (offsets, space, line, line + 1):
        cut[x] = True
    cut[: offsets[0]] = False
    bounds = np.flatnonzero(cut)
    first = np.searchsorted(bounds, offsets)
    flat = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32).tobytes()), data_buffer) if len(bounds) > 1 else pa.array([], pa.string())
    coded = flat.dictionary_encode()
    return np.diff(first), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def slices(batches, column: str, most: int = 16 << 20):
    """Record batches cut so that the text of each stays near ``most`` bytes (one row at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if len(group) else [0]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()
