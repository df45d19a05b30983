"""Manifest, license scan and ranked search against plain versions of the same contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from corvane.llm import lexical, license_rules, licenses, manifest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- manifest


def plain_manifest(rows):
    """The contract, node by node."""

    def leaf(r, more=0):
        n = None if r["n_chars"] is None else r["n_chars"] + more
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], n, r["text"])))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    trees = {}
    for lang, own in groups.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, bytes.fromhex(leaf(r))))
        trees[lang] = levels([leaf(r) for r in own])
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    upper = levels([trees[x][-1][0] for x in order])
    out = []
    for place, lang in enumerate(order):
        for i, r in enumerate(groups[lang]):
            more = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now, siblings = leaf(r, int(more)), []
            for tree, at in ((trees[lang], i), (upper, place)):
                for level in tree[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    siblings += [x for k, x in enumerate(run) if k != at % 2]
                    now = digest("".join(now if k == at % 2 else x for k, x in enumerate(run)))
                    at //= 2
            root = upper[-1][0]
            out.append((r["doc_id"], leaf(r), trees[lang][-1][0], root, digest("".join(siblings)), now, now == root))
    return sorted(out, key=str)


def proved(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[n] for n in names) for r in manifest.prove_documents(df).collect()), key=str)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a", "é🙂", "x" * 5000, "\n"]), rng.choice([None, "en", "en", "en", "", "é", "zz", "-"]), rng.choice([None, "s"]), rng.choice([None, 0, 7, 2**63 - 1])) for _ in range(150)]
    rows += [(5, "same", "en", "s", 4)] * 9 + [(None, None, None, None, None)] * 3
    return spark.createDataFrame(rows, DOCUMENTS)


def test_manifest_equals_the_plain_version(spark, sf, odd):
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        assert proved(df) == plain_manifest(rows_of(df))


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_descents_through_several_packs(spark, odd, monkeypatch, stride):
    monkeypatch.setattr(manifest, "STRIDE", stride)  # 100 groups and 162 leaves then need several packs on each path
    df = odd.withColumn("lang", odd.lang.cast("string"))
    assert proved(df) == plain_manifest(rows_of(df))
    many = spark.createDataFrame([(i, "t", f"g{i % 37}", "s", i) for i in range(120)], DOCUMENTS)
    assert proved(many) == plain_manifest(rows_of(many))


def test_manifest_of_few_rows_and_other_columns(spark):
    assert manifest.prove_documents(spark.createDataFrame([], DOCUMENTS)).count() == 0
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], DOCUMENTS)
    assert proved(one) == plain_manifest(rows_of(one))
    clash = one.selectExpr("*", "1 AS tree", "2 AS rank", "3 AS leaf", "4 AS id", "5 AS row", "6 AS digest")
    assert proved(clash) == plain_manifest(rows_of(one))


def test_changed_rows_fail_and_others_verify(spark, sf):
    got = manifest.prove_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in got)


def test_a_forged_record_is_found():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    top, records = manifest.pack(leaves, 3)
    store = manifest.opened(records)
    for i, leaf in enumerate(leaves):
        found, steps = manifest.descend(store, top, i, 3)
        assert found == leaf and manifest.fold(leaf, manifest.proof(steps)) == top
        assert manifest.fold(leaves[(i + 1) % 5], manifest.proof(steps)) != top


# ---- licenses

LICENSED = [
    None,
    "",
    "no license here",
    "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache\n * License",
    "GNU Lesser General Public License v2.1 or the xgnu general public license or gnu general public licenses",
    "# SPDX-License-Identifier: GPL-2.0-or-later\n# SPDX-License-Identifier: MIT",
    "cc by, CC-BY 4.0, CC BY-SA 4.0 and cc  by; https://creativecommons.org/licenses/by-sa/4.0/ ccby",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files",
    '{"license": "BSD-3-Clause"} distributed under the terms of the MPL-2.0',
    "dédié the mit license: émit licenseé MIT LICENSE mit -- license",
    "GNU GPL v3 or later; gpl 2",
    "the mit license " * 3000,
    "Copyright 2020 X. All rights reserved. Proprietary and confidential.",
]


def plain_licenses(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    base, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        base += found
        labels |= {label} if found else set()
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels))


def plain_detections(text, rules):
    """Every rule on every text, then pair by pair."""
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    found = [(r.priority, n, m.start(), m.end()) for n, r in enumerate(rules) for m in r.pattern.finditer(low)]

    def beaten(j):
        for i in found:
            holds, held = i[2] <= j[2] and i[3] >= j[3], j[2] <= i[2] and j[3] >= i[3]
            if i[0] > j[0] and (holds or held) or i[0] == j[0] and i != j and holds and (not held or i[1] < j[1]):
                return True
        return False

    return found, [f for f in found if not beaten(f)]


def test_there_are_hundreds_of_rules_and_all_compile():
    rules = license_rules.written()
    assert len(license_rules.HAND_WRITTEN.strip().splitlines()) > 180 and len(rules) > 500
    assert {r.priority for r in rules} <= set(license_rules.TRUST)


def test_prefilter_loses_no_detection():
    rules = license_rules.written()
    tool = licenses.Detector(rules)
    for text in LICENSED[:13] + LICENSED[14:]:
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        found, kept = plain_detections(text, rules)
        got = [(rules[n].priority, n, a, b) for n, a, b in tool.matches(low)]
        assert sorted(got) == sorted(found)
        assert sorted(g for g, k in zip(got, licenses.unsuppressed(got)) if k) == sorted(kept)
    assert tool.live(b"plain words about nothing in particular") == []


def test_suppression_equals_pairs():
    rng = random.Random(1)
    for _ in range(200):
        found = [(rng.choice([30, 60, 90]), rng.randrange(6), a, a + rng.randrange(1, 12)) for a in (rng.randrange(20) for _ in range(rng.randrange(12)))]
        found = list(dict.fromkeys(found))

        def beaten(j):
            return any(i[0] > j[0] and (i[2] <= j[2] and i[3] >= j[3] or j[2] <= i[2] and j[3] >= i[3]) or i[0] == j[0] and i != j and i[2] <= j[2] and i[3] >= j[3] and (i[2:] != j[2:] or i[1] < j[1]) for i in found)

        assert licenses.unsuppressed(found).tolist() == [not beaten(j) for j in found]


def test_report_equals_the_plain_version(spark, sf):
    odd = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(LICENSED)], "doc_id long, text string, labels string, id string")
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
        got = licenses.report(df).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(texts[r.doc_id])
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
            assert (r.score > 0) == bool(r.labels)
    assert licenses.report(odd.limit(0)).count() == 0


def test_labels_of_known_texts(spark):
    odd = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")
    labels = {r.doc_id: set(r.labels.split(",")) - {""} for r in licenses.report(odd).collect()}
    assert labels[0] == labels[1] == labels[2] == set()
    assert labels[3] == {"gpl", "gpl-3.0"} and labels[4] == {"mit"} and labels[5] == {"apache", "apache-2.0"}
    assert labels[6] == {"lgpl-2.1"} and labels[7] == {"gpl-2.0+", "mit"}
    assert labels[8] >= {"cc-by", "cc-by-4.0", "cc-by-sa-4.0"} and labels[9] == {"mit"} and labels[10] == {"bsd-3-clause", "mpl-2.0"}
    assert labels[12] == {"gpl-3.0+", "gpl-2.0"} and labels[14] == {"proprietary", "all-rights-reserved"}
    spans = licenses.scan(odd.where("doc_id = 11")).where("kept").collect()
    assert {LICENSED[11][r.start : r.end].lower() for r in spans} == {"the mit license", "mit -- license"}  # a no-break space is part of a word


# ---- ranked search

SEARCHED = [(None, "the the quick"), (1, "The quick-brown fox; fox"), (1, "the quick brown fox fox"), (2, None), (3, ""), (4, "été ÉTÉ foo_bar"), (5, "!!"), (6, "the " * 500 + "fox"), (7, "x" * 3000)]
ITEMS = [(1, "quick fox"), (1, "quick fox"), (2, None), (3, ""), (None, "été the foo bar"), (5, "absent"), (6, "fox fox FOX")]


def plain_search(documents, items, k=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(cut(t))) for i, t in documents]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    number, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 75 + 25 * n * number // total
            score = sum(times * math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(cut(text)).items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(documents, items, **kw):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank(documents, items, **kw).collect()), key=str)


def test_search_equals_the_plain_version(spark, sf):
    documents = spark.createDataFrame([(i, t, 1, "x") for i, t in SEARCHED], "doc_id long, text string, length long, id string")
    items = spark.createDataFrame([(*x, "x") for x in ITEMS], "item_id long, text string, doc_id string")
    assert found(documents, items) == plain_search(SEARCHED, ITEMS)
    assert found(documents, items, k=2) == plain_search(SEARCHED, ITEMS, 2)
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [[tuple(r) for r in x.select(i, "text").collect()] for x, i in ((d, "doc_id"), (b, "item_id"))]
    assert found(d, b) == plain_search(*rows)


def test_search_of_empty_tables(spark):
    documents, items = spark.createDataFrame(SEARCHED, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(documents.limit(0), items) == [] and found(documents, items.limit(0)) == [] and found(documents.where("text = '!!'"), items) == []


def test_items_in_blocks_and_small_buckets(spark, sf, monkeypatch):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = found(d, b)
    monkeypatch.setattr(lexical, "MOST_BYTES", 3000)
    monkeypatch.setattr(lexical, "BUCKET", 16)
    assert found(d, b) == whole


def test_buckets_and_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    weights = rng.integers(1, 8000, 300)
    roots = np.sqrt(weights.astype(float))
    docs = [np.unique(rng.zipf(1.3, rng.integers(1, 60)) % 300) for _ in range(3000)]
    impacts = [rng.integers(1, 700_000, len(d)) for d in docs]
    length = np.array([math.sqrt(float(((x * roots[d]) ** 2).sum())) for d, x in zip(docs, impacts)])
    order = np.argsort(-length)
    items = lexical.Items([0], [" ".join(f"t{i}" for i in range(300))])
    items.terms = [np.unique(rng.integers(0, 300, 12), return_counts=True) for _ in range(20)]
    queries = lexical.prepared(items, weights)
    best, saw = [lexical.Best(5, 0) for _ in queries], np.zeros(3, int)
    for a in range(0, 3000, 100):
        part = order[a : a + 100]
        saw += lexical.search_bucket(length[part], part.astype(np.int64), np.zeros(len(part), bool), np.array([len(docs[i]) for i in part]), np.concatenate([docs[i] for i in part]), np.concatenate([impacts[i] for i in part]), queries, best, roots)
    for (terms, repeats), top in zip(items.terms, best):
        dense = np.zeros(300, np.int64)
        dense[terms] = weights[terms] * repeats
        scores = np.array([int((dense[d] * x).sum()) for d, x in zip(docs, impacts)])
        want = np.lexsort((np.arange(3000), -scores))[:5]
        assert top.id.tolist() == want.tolist() and top.score.tolist() == scores[want].tolist()
    assert saw[0] < 20 * 3000 and saw[1] < saw[0] / 2


def test_search_and_manifest_equal_their_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(c.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.SQL})").fetchall(), key=str) == found(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted(c.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({manifest.SQL})").fetchall(), key=str) == proved(spark.read.parquet(f"{sf}/documents.parquet"))
