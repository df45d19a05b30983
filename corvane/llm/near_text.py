"""Operator 10: near-duplicate texts by order min-hash, verified by banded alignment.

A text is its sequence of white-space separated words in lower case. Its k-mers are runs of words, labelled
with their occurrence number so that repeats differ. For each of ``TABLES`` hash functions the sketch keeps the
two least k-mers *in text order*, so two texts meet in a table if they share both and agree on their order, which
follows edit similarity. Texts that meet are aligned word by word inside a band, and link if
``1 - edit distance / longer length`` is at least the threshold.

Runs of five words cannot meet where every fifth word differs, which the threshold of 0.8 allows, so the runs are shorter:
three words, and two words in short texts (``FAMILIES``; lengths in both ranges are sketched twice, so that two texts whose
lengths differ by a fifth always share a family). A bucket's key also holds a class of the text's length on a scale whose
cuts each table shifts, so that passages common to texts of all lengths do not bring all of them together.

Texts with equal word sequences form one class beforehand. In each bucket members are aligned with a leader first, not with each
other: each text with the one leader it shares most buckets with, then with all leaders of other groups, for texts
that link take a common label and need no further alignment. A bucket that still holds several groups gets a new leader from *all*
its members, so that a member that passed may lead one that failed. What then remains is exact: of every bucket all members with
different labels are aligned with each other, in buckets of more than ``CROWD`` members block by block inside tasks, behind a bound by
their common words. So every two texts that meet in a bucket are aligned or joined by links; no bucket is cut off.

Defined cases: a null text or one without words belongs to no group (it is its own); texts of fewer than two words
have one k-mer; equal ids are taken as one document; a null id is never grouped; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.words import MIX, gather, hashes, mix, segment_sum, slices, split_words, starts, texts_of
from corvane.operators.components import connected_components
from corvane.operators.similar import overlaps
from corvane.operators.skew import hub_join
from corvane.session import materialise

TABLES, SIMILARITY = 48, 0.8
#: Members of a bucket that are paired by a join; more meet in blocks of so many members.
CROWD, BLOCK = 64, 256
#: (words of a k-mer, least and most words of the texts sketched by it).
FAMILIES = ((2, 1, 50), (3, 40, 2**62))
_LAST = np.uint64(2**64 - 1)
#: The bits of a key that hold its family (times 64) and table.
_CODE = 127
#: Width of a class of lengths, as a logarithm: a factor of 2.7; one of 1.25 stays in a class in three tables of four.
LENGTHS = 1.0


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, 64-bit hash of each word in order)."""
    sizes, codes, words = split_words(texts)
    return sizes, hashes(pc.utf8_lower(words))[codes] if len(words) else np.zeros(0, np.uint64)


def shingles(sizes: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-mers of each text, their hashes in order); a shorter text with words has one k-mer."""
    n = np.where(sizes > 0, np.maximum(sizes - k + 1, 1), 0)
    at, total = starts(sizes), len(h)
    begin = gather(at[:-1], n, np.arange(len(sizes)))
    end = np.repeat(at[1:], n)
    out = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            place = begin + j
            inside = place < end
            out = out * np.uint64(0x9E6C63D0876A9A47) + np.where(inside, h[np.minimum(place, max(total - 1, 0))], np.uint64(j + 1))
    return n, mix(out)


def label_occurrences(n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes changed so that the second, third, ... occurrence of a k-mer in its text differs from the first."""
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    with np.errstate(over="ignore"):
        key = mix(h ^ (doc * MIX))
    order = np.argsort(key, kind="stable")
    same = np.append(False, key[order][1:] == key[order][:-1])
    if not same.any():
        return h
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    number = np.zeros(len(h), np.uint64)
    number[order] = run
    with np.errstate(over="ignore"):
        return np.where(number > 0, mix(h + number * MIX), h)


def sketch(n: np.ndarray, h: np.ndarray, code: int = 0, tables: int = TABLES) -> np.ndarray:
    """(texts with k-mers, tables): one key for each table from its two least k-mers in text order. The last bits of a key
    hold ``code`` and the table's number."""
    full = n[n > 0]
    if not len(full):
        return np.zeros((0, tables), np.uint64)
    begin = starts(full)[:-1]
    low = np.uint64((1 << max(20, int(full.max()).bit_length())) - 1)  # bits that hold the place of a k-mer
    place = (np.arange(len(h)) - np.repeat(begin, full)).astype(np.uint64)
    size = np.log(full)
    rng = np.random.default_rng(11)
    seed, odd = rng.integers(0, 2**63, tables, dtype=np.uint64), rng.integers(0, 2**63, tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(full), tables), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(tables):
            v = (((h ^ seed[j]) * odd[j]) & ~low) | place
            a = begin + (np.minimum.reduceat(v, begin) & low).astype(np.int64)
            v[a] = _LAST
            least = np.minimum.reduceat(v, begin)
            b = begin + np.where(least == _LAST, np.uint64(0), least & low).astype(np.int64)
            second = np.where(least == _LAST, np.uint64(0), h[b])
            first, second = np.where(a < b, h[a], second), np.where(a < b, second, h[a])
            class_ = np.floor((size + rng.random() * LENGTHS) / LENGTHS).astype(np.uint64)
            out[:, j] = mix((first * MIX + second) * MIX + class_ * odd[j] + np.uint64(j)) & ~np.uint64(_CODE) | np.uint64(code + j)
    return out


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray, cells: int = 4 << 20) -> np.ndarray:
    """Word edit distance of each pair, or its limit + 1 if it is larger. Alignments of similar size run together."""
    out = np.zeros(len(pairs), np.int64)
    todo = []
    for k, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > limits[k]:
            out[k] = limits[k] + 1
            continue
        same = a == b[: len(a)]
        head = int(np.argmin(same)) if not same.all() else len(a)
        a, b = a[head:], b[head:]
        if len(a):
            same = a[::-1] == b[::-1][: len(a)]
            tail = int(np.argmin(same)) if not same.all() else len(a)
            a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not len(a):
            out[k] = len(b)
            continue
        words, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = np.bincount(inverse[: len(a)], minlength=len(words)), np.bincount(inverse[len(a) :], minlength=len(words))
        if len(b) - np.minimum(x, y).sum() > limits[k]:  # more words must change than may
            out[k] = limits[k] + 1
            continue
        todo.append((k, inverse[: len(a)].astype(np.int32), inverse[len(a) :].astype(np.int32)))
    band = 12
    while todo:
        todo.sort(key=lambda t: len(t[1]))
        again, at = [], 0
        while at < len(todo):
            end, longest = at, 0
            while end < len(todo) and (end == at or (end - at + 1) * (len(todo[end][2]) + 2 * band + 1) <= cells and len(todo[end][1]) <= 1.3 * len(todo[at][1]) + 16):
                longest = max(longest, len(todo[end][2]))
                end += 1
            group = todo[at:end]
            at = end
            d = _banded(group, band, longest, np.minimum(limits[[k for k, _, _ in group]], band))
            for (k, a, b), x in zip(group, d):
                limit = limits[k]
                if x <= min(band, limit):
                    out[k] = x
                elif band >= limit:
                    out[k] = limit + 1
                else:
                    again.append((k, a, b))
        todo, band = again, band * 3
    return out


def _banded(group, band: int, longest: int, most: np.ndarray) -> np.ndarray:
    """Distances of (k, a, b) with len(a) <= len(b), exact where they are at most ``most``, else larger than that. Pairs
    whose row of the table lies above ``most`` throughout leave the matrix."""
    wide, rows = 2 * band + 1, max(len(a) for _, a, _ in group)
    n, m = np.array([len(a) for _, a, _ in group]), np.array([len(b) for _, _, b in group])
    left = np.full((len(group), rows), -1, np.int32)
    right = np.full((len(group), max(longest, rows) + wide + band), -2, np.int32)
    for k, (_, a, b) in enumerate(group):
        left[k, : len(a)] = a
        right[k, band : band + len(b)] = b
    column = np.arange(wide, dtype=np.int32)
    far = np.int32(1 << 28)
    # row 0: j insertions at column j + band
    d = np.where(column >= band, column - band, far) + np.zeros((len(group), 1), np.int32)
    out = most.astype(np.int64) + 1
    here = np.arange(len(group))
    for i in range(1, rows + 1):
        cost = d + (left[:, i - 1 : i] != right[:, i - 1 : i - 1 + wide])
        cost[:, :-1] = np.minimum(cost[:, :-1], d[:, 1:] + 1)
        if i <= band:  # columns before the first word do not exist
            cost[:, : band - i] = far
            cost[:, band - i] = i
        d = np.minimum.accumulate(cost - column, axis=1) + column
        done = np.flatnonzero(n == i)
        if len(done):
            c = m[done] - i + band
            ok = c < wide
            out[here[done[ok]]] = d[done[ok], c[ok]]
        if i % 16 == 0:
            go = (n > i) & (d.min(1) <= most)
            if not go.any():
                break
            if go.mean() < 0.8:
                here, n, m, most, d, left, right = here[go], n[go], m[go], most[go], d[go], left[go], right[go]
    return out


_KEYS = [f"keys{k}" for k, _, _ in FAMILIES]


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text", 8 << 20):
            sizes, h = word_hashes(texts_of(batch.column(1)))
            at = starts(sizes)
            place = (np.arange(len(h)) - np.repeat(at[:-1], sizes)).astype(np.uint64)
            with np.errstate(over="ignore"):
                k1 = segment_sum(mix(h + place * MIX), sizes)
                k2 = segment_sum(mix((h ^ np.uint64(0x5851F42D4C957F2D)) * MIX + place), sizes)
            columns = [batch.column(0), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))]
            for f, (k, least, most) in enumerate(FAMILIES):
                own = (sizes >= least) & (sizes <= most)
                n, g = shingles(np.where(own, sizes, 0), h[np.repeat(own, sizes)], k)
                keys = sketch(n, label_occurrences(n, g), 64 * f).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, TABLES, dtype=np.int32)), pa.array(keys.ravel()))
                columns.append(lists.take(pa.array(np.cumsum(own) - 1, mask=~own)))
            yield pa.RecordBatch.from_arrays(columns, ["id", "k1", "k2", *_KEYS]).filter(pa.array(sizes > 0))

    return docs.mapInArrow(run, "id long, k1 long, k2 long, " + ", ".join(f"{c} array<long>" for c in _KEYS))


#: The id filter takes at most so many bits; with more ids it lets more rows by, which a later join drops.
MOST_BITS = 1 << 27
_CELL = 1 << 15


def seen_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter over ids as an array of bits: 16 bits and two hashes an id, in cells that tasks combine."""
    bits = min(MOST_BITS, max(_CELL, 1 << (16 * max(ids.count(), 1) - 1).bit_length()))

    def cells(found):
        out = [pa.array([k for k, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())]
        return pa.RecordBatch.from_arrays(out, ["cell", "bits"])

    def mark(batches):
        flags = np.zeros(bits, bool)
        for batch in batches:
            flags[_places(batch.column(0).to_numpy(), bits).ravel()] = True
        some = np.flatnonzero(flags.reshape(-1, _CELL).any(1))
        yield cells([(k, np.packbits(flags[k * _CELL : (k + 1) * _CELL]).tobytes()) for k in some.tolist()])

    def combine(batches):
        both: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                both[k] = both.get(k, 0) | np.frombuffer(b, np.uint8)
        yield cells([(k, b.tobytes()) for k, b in both.items()])

    kind = "cell int, bits binary"
    rows = ids.mapInArrow(mark, kind).repartition("cell").mapInArrow(combine, kind).collect()  # MOST_BITS bits at most
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["cell"] * _CELL // 8 : (r["cell"] + 1) * _CELL // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def passes(ids: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Whether each id may be in the filter."""
    at = _places(ids, len(seen) * 8)
    return (seen[at >> 3] >> (7 - (at & 7)) & 1).astype(bool).all(0)


def _word_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, words)``: the low 32 bits of each word's hash, for the rows of ``ids`` and few others."""
    shipped = docs.sparkSession.sparkContext.broadcast(seen_filter(ids))

    def run(batches):
        seen = shipped.value
        for batch in batches:
            batch = batch.filter(pa.array(passes(batch.column(0).to_numpy(), seen)))
            yield from words_of(batch)

    def words_of(batch):
        for batch in slices([batch], "text", 8 << 20):
            sizes, h = word_hashes(texts_of(batch.column(1)))
            low, at = h.astype(np.uint32), starts(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([low[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["id", "words"])

    return docs.mapInArrow(run, "id long, words binary")


def _aligned(pairs: DataFrame, similarity: float) -> DataFrame:
    """``(id, leader, label, own, ok)`` from rows with both word arrays."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = np.zeros(len(a), bool)
            for at in range(0, len(a), 512):
                both = [(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(a[at : at + 512], b[at : at + 512])]
                longest = np.array([max(len(x), len(y)) for x, y in both])
                limit = np.floor((1 - similarity) * longest + 1e-9).astype(np.int64)
                ok[at : at + len(both)] = edit_distances(both, limit) <= limit
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "leader", "label", "own")), pa.array(ok)], ["id", "leader", "label", "own", "ok"])

    return pairs.mapInArrow(run, "id long, leader long, label long, own long, ok boolean")


def _crowded(members: DataFrame, similarity: float) -> DataFrame:
    """``(src, dst)``: links that join what the members ``(key, id, label, parts, words, keys)`` of crowded buckets are joined by. Blocks of a
    bucket meet two by two; a pair is left to the first table in which it meets, and one with too few common words is not aligned."""
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    at = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    at = at.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "label", "words", "keys")

    def run(key, table):
        table = table.combine_chunks()
        i, j = key[1].as_py(), key[2].as_py()
        part, ids, label = (table[c].to_numpy() for c in ("part", "id", "label"))
        a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
        words = [np.frombuffer(w, np.uint32) for w in table["words"].to_pylist()]
        size = np.array([len(w) for w in words], np.int64)
        bags = label_occurrences(size, np.concatenate(words).astype(np.uint64)).view(np.int64) if len(words) else np.zeros(0, np.int64)
        bags = np.split(bags, np.cumsum(size)[:-1])
        longest = np.maximum(size[a][:, None], size[b][None, :])
        limit = np.floor((1 - similarity) * longest + 1e-9).astype(np.int64)
        near = longest - overlaps([bags[k] for k in a], [bags[k] for k in b]) <= limit
        near &= label[a][:, None] != label[b][None, :]
        near &= ids[a][:, None] < ids[b][None, :] if i == j else True
        sketches = np.array(table["keys"].to_pylist(), np.int64).reshape(len(ids), -1)
        for t in range(int(key[0].as_py()) & 63):
            near &= sketches[a, t][:, None] != sketches[b, t][None, :]
        root = {x: x for x in label.tolist()}

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out, todo = [], np.argwhere(near)
        for at in range(0, len(todo), 512):
            some = [(a[x], b[y], limit[x, y]) for x, y in todo[at : at + 512] if top(label[a[x]]) != top(label[b[y]])]
            if not some:
                continue
            most = np.array([m for _, _, m in some])
            for (x, y, _), ok in zip(some, edit_distances([(words[x], words[y]) for x, y, _ in some], most) <= most):
                if ok and top(label[x]) != top(label[y]):
                    root[top(label[x])] = top(label[y])
                    out.append((ids[x], ids[y]))
        return pa.table({"src": pa.array([x for x, _ in out], pa.int64()), "dst": pa.array([y for _, y in out], pa.int64())})

    return at.groupBy("key", "i", "j").applyInArrow(run, "src long, dst long")


def _relabelled(met: DataFrame, linked: DataFrame) -> DataFrame:
    """``met`` with common labels for the groups that ``linked`` joins: the larger label of a link takes the smaller one, and
    later alignments make up for chains of such steps. Labels only save alignments; groups are the components of all links."""
    step = linked.groupBy(F.greatest("label", "own").alias("old")).agg(F.min(F.least("label", "own")).alias("new"))
    step = materialise(step, "step")
    for c in ("label", "own"):
        met = met.join(step.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}")), c, "left").withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"new_{c}")
    return met


def near_texts(documents: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, group_id, kept)`` for every row: group_id is the least id of the group, and that row is kept."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = docs.where("id is not null")
    seen = materialise(_sketches(known), "sketches")
    classes = materialise(seen.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = materialise(seen.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", *_KEYS), "reps")
    rows = reps.select("id", F.explode(F.concat(*(F.coalesce(c, F.array().cast("array<long>")) for c in _KEYS))).alias("key"))
    lead = rows.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("other"), F.count("*").alias("n")).where("leader <> other")
    lead = materialise(lead.select("key", "leader", F.col("leader").alias("own"), "n"), "leaders")
    met = materialise(hub_join(rows.select("id", "key", F.col("id").alias("label")), lead, ["key"], "n"), "met")
    edges = words = None
    checked = known.sparkSession.createDataFrame([], "id long, leader long")

    def compare(pairs: DataFrame) -> None:
        """Align (id, leader, label, own) and give the groups that link common labels."""
        nonlocal edges, words, checked, met
        if words is None:  # later rounds meet texts of the first one only
            ids = met.select("id").union(met.select("leader")).distinct()
            words = materialise(_word_ids(known, ids), "words")
        both = pairs.join(words.withColumnRenamed("words", "a"), "id")
        both = both.join(words.select(F.col("id").alias("leader"), F.col("words").alias("b")), "leader")
        result = materialise(_aligned(both.select("id", "leader", "label", "own", "a", "b"), similarity), "aligned")
        found = result.where("ok").select(F.col("id").alias("src"), F.col("leader").alias("dst"))
        edges = found if edges is None else edges.union(found)
        checked = checked.union(result.select("id", "leader"))
        if not found.isEmpty():
            met = materialise(_relabelled(met, result.where("ok")), "labels")

    def led_anew(rows: DataFrame, turn: int) -> DataFrame:
        """The rows of buckets that hold several groups, with another leader."""
        order = F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("o"), "id", "label")).alias("x")
        lead = rows.groupBy("key").agg(order, F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).where("least <> most")
        lead = materialise(lead.select("key", F.col("x.id").alias("leader"), F.col("x.label").alias("own"), "n"), "leaders")
        return materialise(hub_join(rows, lead, ["key"], "n"), "met")

    def open_pairs() -> DataFrame:
        return met.where("label <> own").select("id", "leader", "label", "own").distinct().join(checked, ["id", "leader"], "left_anti")

    def still_open() -> tuple[DataFrame, DataFrame]:
        """The members of buckets that hold several groups, and these buckets with their sizes."""
        own = met.select("id", "key", "label").distinct()
        size = own.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).where("least <> most")
        return own, materialise(size.select("key", "n"), "open")

    def finished() -> DataFrame:
        """The links, with those of all pairs of a bucket that are neither aligned nor joined yet."""
        own, size = still_open()
        few = own.join(size.where(F.col("n") <= CROWD).select("key"), "key", "left_semi")
        other = few.select("key", F.col("id").alias("leader"), F.col("label").alias("own"))
        pairs = few.join(other, "key").where("id < leader and label <> own").select("id", "leader", "label", "own").distinct()
        both_ways = checked.union(checked.select("leader", "id"))
        compare(pairs.join(both_ways, ["id", "leader"], "left_anti"))
        own, size = still_open()
        large = size.where(F.col("n") > CROWD)
        if large.isEmpty():
            return edges
        code = F.col("key").bitwiseAND(_CODE)
        members = hub_join(own, large.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")), ["key"], "n")
        members = members.join(words, "id").join(reps, "id").withColumn("keys", F.when(code < 64, F.col(_KEYS[0])).otherwise(F.col(_KEYS[1])))
        return edges.union(materialise(_crowded(members, similarity), "crowded"))

    if not met.isEmpty():
        shared = met.groupBy("id", "leader", "label", "own").agg(F.count("*").alias("shared"))
        first = F.max_by(F.struct("leader", "label", "own"), F.struct("shared", -F.col("leader"))).alias("x")
        compare(shared.groupBy("id").agg(first).select("id", "x.*").where("label <> own"))
        compare(open_pairs())
        met = led_anew(met.select("id", "key", "label"), 1)
        compare(open_pairs())
        edges = finished()
    groups = classes.withColumn("group_id", F.col("rep"))
    if edges is not None:
        part = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("group_id"))
        groups = classes.join(part, "rep", "left").withColumn("group_id", F.coalesce("group_id", "rep"))
    groups = materialise(groups.select("k1", "k2", "group_id", "n"), "groups")
    member = hub_join(seen.select("id", "k1", "k2"), groups, ["k1", "k2"], "n").groupBy("id").agg(F.min("group_id").alias("group_id"))
    out = docs.select("id").join(member, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
    return out.select(F.col("id").alias(id_col), "group_id", F.coalesce(F.col("id") == F.col("group_id"), F.lit(True)).alias("kept"))
