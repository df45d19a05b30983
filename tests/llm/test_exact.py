"""Operators with an exact answer: brute force, the public libraries, or a round trip."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from corvane.llm import byte_bpe, kneser_ney, near_vectors, sharding, token_files

ODD = [None, "", " ", "a", "a  b\n\n c\t", "don't 123 été 🙂!!", "x" * 3000, "ab " * 2000, "the cat sat " * 3, "the cat sat " * 3, " a   b"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", i * 2) for i, t in enumerate(texts)], "doc_id long, text string, id string, n_tokens long")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def tiktok():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_byte_bpe_equals_library(spark, sf, tiktok):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for df in (table(spark, ODD), documents(spark, sf)):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        rows = byte_bpe.round_trip(df, path, public_tokenizers.PATTERN).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = tiktok.encode_ordinary(texts[r.doc_id])
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == sha(np.array(ids, "<u4").tobytes())
            assert r.decoded_sha256 == sha(texts[r.doc_id].encode())
    assert byte_bpe.encode_documents(table(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_long_runs_equal_the_library(tiktok):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        bpe = byte_bpe.ByteBPE(f.read(), public_tokenizers.PATTERN)
    import pyarrow as pa

    rng = random.Random(5)
    words = ["".join(rng.choice("abtheingon") for _ in range(n)) for n in (1, 2, 150, 191, 192, 193, 194, 700, 5000)]
    words += ["a" * 20_001, "ab" * 3000, "aab" * 1500, "=" * 999, "".join(rng.choice("aA1/+é🙂") for _ in range(4000))]
    words += ["".join(rng.choice(("the", "he", "er", "in", "a", "s", "tion")) for _ in range(600)) for _ in range(20)]
    sizes, ids = bpe.encode(pa.array(words))
    at = np.cumsum(np.append(0, sizes))
    for k, w in enumerate(words):
        assert ids[at[k] : at[k + 1]].tolist() == tiktok.encode_ordinary(w)


def test_token_files_round_trip(spark, sf):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for df in (table(spark, [*ODD, "<|endoftext|> x", "a <|endoftext|>b <|endoftext|><|endoftext|>\n<|endoftext|> ", "  <|endoftext|>  <|endoftext|>"]), documents(spark, sf)):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        rows = {r.doc_id: r for r in token_files.encode_and_read_back(df, path).collect()}
        assert rows.keys() == texts.keys()
        at = 0
        for i in sorted(texts):
            ids = [*lib.encode(texts[i], add_special_tokens=False).ids, 0]
            assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    assert token_files.encode_and_read_back(table(spark, []), path).count() == 0


def test_variable_length_records():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 9, 50)
    values = (rng.integers(0, 2**32, int(sizes.sum()), dtype=np.uint64) >> rng.integers(0, 32, int(sizes.sum())).astype(np.uint64)).astype(np.uint32)
    assert (token_files.unpack(sizes, token_files.pack(sizes, values)) == values).all()


def brute_links(vectors):
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v in vectors if v and None not in v and np.isfinite(v).all() and any(v)}
    links = defaultdict(set)
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95:
                links[a].add(b)
    seen = {}
    for i, _ in sorted(vectors):
        if i not in seen:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = i
                    todo += links[x]
    return {i: (len(links[i]), seen[i], seen[i] == i) for i, _ in vectors}


def test_near_vectors_equal_brute_force(spark, sf):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    odd = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] * 4), (904, [float("nan")] * 8), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 8)]
    near = [(k, (base[k % 40] + rng.normal(size=8) * 0.1).tolist()) for k in range(300)]
    copies = [(1000 + k, near[0][1]) for k in range(30)]
    stored = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    for rows in (odd + near + copies, stored):
        df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()}
        assert got == brute_links(rows)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("count", [500, 4000, 12000])
def test_recall_of_near_vectors_at_the_threshold(spark, count):
    """Pairs just above the threshold among random vectors, at growing sizes; nothing else links."""
    rng = np.random.default_rng(count)
    a = rng.normal(size=(count, 64))
    n = count // 4
    far = rng.normal(size=(n, 64))
    far -= (far * a[:n]).sum(1, keepdims=True) * a[:n] / (a[:n] ** 2).sum(1, keepdims=True)
    b = 0.951 * a[:n] / np.linalg.norm(a[:n], axis=1, keepdims=True) + np.sqrt(1 - 0.951**2) * far / np.linalg.norm(far, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))]
    got = {r.vec_id: r.component_id for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert np.mean([got[count + k] == k for k in range(n)]) >= 0.97
    assert all(got[k] == k for k in range(count))


def test_very_large_and_small_components(spark):
    v = np.random.default_rng(5).normal(size=8)
    rows = [(0, (v * 1e200).tolist()), (1, (v * 3e200).tolist()), (2, (v * 1e-200).tolist()), (3, (v * -1e-200).tolist()), (4, v.tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (0, 3), 4: (3, 0)}


@pytest.mark.parametrize("many", [0, 5, 32])
def test_crowded_direction_is_cut_into_blocks(spark, monkeypatch, many):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    monkeypatch.setattr(near_vectors, "MANY", many)
    rng = np.random.default_rng(2)
    rows = [(k, (np.ones(6) + rng.normal(size=6) * 0.2).tolist()) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()}
    assert got == brute_links(rows)


def brute_language_model(rows):
    split = lambda t: [w.decode("utf-8", "surrogateescape").translate({k: k + 32 for k in range(65, 91)}) for w in (t or "").encode().split()] + ["</s>"]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    one, two = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            w = split(t)
            one.update(w)
            two.update(zip(["<s>", *w], w))
    left, right = defaultdict(list), Counter()
    for (a, b), n in two.items():
        left[a].append(n)
        right[b] += 1
    d2 = [0.0, *kneser_ney.discounts([sum(n == k for n in two.values()) for k in (1, 2, 3, 4)])]
    d1 = [0.0, *kneser_ney.discounts([sum(n == k for n in right.values()) for k in (1, 2, 3, 4)])]
    n, v, t = sum(one.values()), len(one), len(two)
    out = {}
    for i, text in rows:
        w, base, own = split(text), 0.0, 0.0
        for a, b in zip(["<s>", *w], w):
            base += math.log10((one[b] + 0.1) / (n + 0.1 * (v + 1)))
            low = max(right[b] - d1[min(right[b], 3)], 0) / t + sum(d1[min(x, 3)] for x in right.values()) / t / (v + 1)
            if left[a]:
                c = two[a, b]
                low = max(c - d2[min(c, 3)], 0) / sum(left[a]) + sum(d2[min(x, 3)] for x in left[a]) / sum(left[a]) * low
            own += math.log10(low)
        out[i] = (held[i], len(w), sum(one[x] > 0 for x in w), n, base, own)
    return out


def test_kneser_ney_equals_brute_force(spark, sf):
    stored = [(r.doc_id, r.text) for r in documents(spark, sf).limit(60).collect()]
    for rows in ([*enumerate(ODD)], stored):
        df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
        want = brute_language_model(rows)
        got = kneser_ney.fit_and_score(df).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
            assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-9)
    assert kneser_ney.fit_and_score(df.limit(0)).count() == 0


def test_kneser_ney_counts(spark):
    meta = kneser_ney.fit(table(spark, ["a b a c", "a b b", "c a"]))
    assert (meta["words"], meta["tokens"], meta["pairs"]) == (4, 12, 10)


def test_sharding_is_balanced_and_moves_little(spark, sf):
    df = documents(spark, sf)
    rows = sharding.shard_rows(df, 8).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    assert len(rows) == len(texts)
    count = Counter(r.shard for r in rows)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None)
    more = {r.doc_id: r.shard for r in sharding.shard_rows(df, 9).collect()}
    moved = sum(more[r.doc_id] != r.shard for r in rows)
    assert moved < 0.45 * len(rows)  # a plain modulus moves 8 of 9 rows


def test_sharding_equals_one_by_one_placement(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPLAY", 3)
    from pyspark.sql import functions as F

    df = table(spark, ["t%d" % k for k in range(203)]).union(table(spark, ["same"] * 1)).union(table(spark, ["t0"]))
    number, walks = sharding.ring(5)
    keys = df.select("doc_id", F.pmod(F.xxhash64(F.lit("ring"), "doc_id"), F.lit(sharding.SLOTS)).alias("at"), F.shiftrightunsigned(F.xxhash64(F.lit("turn"), "doc_id"), 64 - sharding.BITS).alias("turn")).collect()
    room, want = sharding.capacities(len(keys), 5), Counter()
    for k in sorted(keys, key=lambda k: k.turn):
        s = next(s for s in walks[number[k["at"]]] if room[s])
        room[s] -= 1
        want[k.doc_id, s] += 1
    assert Counter((r.doc_id, r.shard) for r in sharding.shard_rows(df, 5).collect()) == want


def test_sharding_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "é" * 9)], "doc_id long, text string")
    rows = sharding.shard_rows(df, 8).collect()
    assert sorted((r.doc_id is None, r.size) for r in rows) == [(False, 1), (False, 1), (False, 19), (True, 1)]
    assert max(Counter(r.shard for r in rows).values()) == 1
    assert sharding.shard_rows(df.limit(0), 8).count() == 0


def test_near_vectors_without_ids_and_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.01]), (3, [0.01, 3.0]), (None, [1.0, 0.001]), (None, [-1.0, 0.0]), (None, [-2.0, 0.0]), (None, None), (9, None), (1, [1.0, 0.0])]
    base = np.random.default_rng(7).normal(size=(2, 32))
    rows = [(i, v if v is None else (np.array(v) @ base).tolist()) for i, v in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rep string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()), key=str)
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (1, 1, 1, True), (3, 1, 1, False)]
    want += [(None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (9, 0, 9, True)]
    assert got == sorted(want, key=str)
