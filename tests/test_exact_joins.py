"""Draws, nearest neighbours, similar texts and module clusters against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.operators import discovery, metrics, resample, shared_kmers, similar

# ---- block draws


def plain_weights(blocks, iterations, seed=42):
    names, out = sorted(set(blocks)), []
    for it in range(iterations):
        pick = [int(hashlib.md5(f"{seed}|{it}|{j}".encode()).hexdigest()[:8], 16) % len(names) for j in range(len(names))]
        out.append(Counter(names[p] for p in pick))
    return out


def plain_ap(rows, weights):
    """Macro AP of one iteration with ties grouped."""
    values = []
    for label in sorted({r[0] for r in rows}):
        n, tp = Counter(), Counter()
        for lab, score, y, block in rows:
            if lab == label:
                n[score] += weights.get(block, 0)
                tp[score] += y * weights.get(block, 0)
        cn = ct = area = 0
        for score in sorted(n, reverse=True):
            cn, ct = cn + n[score], ct + tp[score]
            area += tp[score] * ct / cn if cn else 0
        if ct:
            values.append(area / ct)
    return sum(values) / len(values) if values else None


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([rng.randrange(20) / 20, rng.random()]), int(rng.random() < 0.4), f"f{rng.choice([0, 0, 0, *range(9)])}") for _ in range(400)]
    return rows, spark.createDataFrame(rows, "label_id string, score double, y int, family string")


@pytest.mark.parametrize("ranges, portion", [(100_000, 4_000_000), (40, 4_000_000), (40, 30), (100_000, 3)])
def test_bootstrap_ap_in_ranges_and_portions(scored, monkeypatch, ranges, portion):
    rows, df = scored
    monkeypatch.setattr(metrics, "RANGE_ROWS", ranges)
    monkeypatch.setattr(resample, "PORTION", portion)  # 3 is less than the blocks: weights are joined
    got = {r["iter"]: r["macro_ap"] for r in resample.bootstrap_ap(df, [], "family", 7).collect()}
    want = {i: plain_ap(rows, w) for i, w in enumerate(plain_weights([r[3] for r in rows], 7))}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_bootstrap_of_one_block_and_of_nothing(spark):
    one = spark.createDataFrame([("a", 0.5, 1, "f")], "label_id string, score double, y int, family string")
    assert resample.bootstrap_ap(one, [], "family", 5).count() == 0
    assert resample.bootstrap_ap(one.limit(0), [], "family", 5).count() == 0
    assert resample.block_weights(one, "family", 5).count() == 0


def test_draws_come_from_many_tasks(spark):
    blocks = spark.range(3000).selectExpr("id AS b")
    draws = resample.BlockDraws(blocks, "b", 100)
    assert draws.places().agg(F.sum("w")).first()[0] == 300_000
    plan = draws.places()._jdf.queryExecution().toString()
    assert "Range (0, 300000" in plan and "Generate" not in plan


def test_large_curves_in_few_rows():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    n = 5000
    table = pa.table({"score": rng.choice([0.1, 0.5, 0.9], n), "place": rng.integers(0, 7, n), "n": np.ones(n, np.int64), "tp": rng.integers(0, 2, n)})
    w = rng.integers(0, 4, (7, 3)).astype(np.int32)
    small = resample._descending(table, w, rows=64)
    large = resample._descending(table, w, rows=100_000)
    assert np.allclose(small, large)


# ---- nearest by shared runs


def runs(text, words=5):
    w = [x for x in text.lower().split() if x]
    return {" ".join(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))}


def plain_nearest(queries, targets):
    out = {}
    for q, text in queries:
        own = runs(text)
        best = max(((len(own & runs(t)), -i) for i, t in targets), default=(0, 0))
        if best[0]:
            out[q] = (-best[1], best[0])
    return out


def words(rng, n):
    return " ".join(rng.choice(["ash", "birch", "cedar", "elm", "fir", "oak", "pine", "yew"]) + str(rng.randrange(6)) for _ in range(n))


@pytest.mark.parametrize("common", [0, 2, 10, 256])
def test_nearest_by_kmers_at_any_rarity(spark, common):
    rng = random.Random(common)
    passage, other = words(rng, 12), words(rng, 9)
    targets = [(i, " ".join(rng.sample([passage, other, words(rng, 8), words(rng, 8)], rng.randrange(1, 5)))) for i in range(60)]
    queries = [(i, rng.choice([passage, other, passage + " " + other, targets[rng.randrange(60)][1], words(rng, 10), passage[: len(passage) // 2]])) for i in range(30)]
    a, b = (spark.createDataFrame(x, "id long, text string") for x in (queries, targets))
    got = {r["query"]: (r["target"], r["shared"]) for r in shared_kmers.nearest_by_kmers(a, b, common=common).collect()}
    assert got == plain_nearest(queries, targets)


def test_a_run_that_all_texts_have_costs_a_row_a_text(spark, monkeypatch):
    """Every text holds one passage: nothing is joined pair by pair."""
    passage = "one two three four five six"
    queries = spark.range(400).selectExpr("id", f"concat('q', id, ' {passage}') AS text")
    targets = spark.range(400).selectExpr("id", f"concat('t', id, ' {passage}') AS text")
    made, keep = [], shared_kmers.materialise

    def counted(df, name="step"):
        out = keep(df, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(shared_kmers, "materialise", counted)
    got = shared_kmers.nearest_by_kmers(queries, targets, common=50).collect()
    assert {(r["target"], r["shared"]) for r in got} == {(0, 2)} and len(got) == 400
    assert max(made) <= 3 * 400


# ---- similar texts


def plain_clusters(texts, level):
    sets = {i: runs(t) for i, t in texts.items() if t and t.split()}
    group = {i: i for i in texts}
    change = True
    while change:
        change = False
        for a in sets:
            for b in sets:
                if a < b and group[a] != group[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= level:
                    x, y = sorted((group[a], group[b]))
                    group = {k: x if v == y else v for k, v in group.items()}
                    change = True
    return group


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_similarity_clusters_equal_brute_force(spark, crowd):
    rng = random.Random(9)
    passage = words(rng, 20)
    texts = {}
    for i in range(70):
        kind = rng.randrange(4)
        if kind == 0 or i < 5:
            texts[i] = words(rng, rng.randrange(1, 40))
        elif kind == 1:
            w = texts[rng.randrange(i)].split()
            for _ in range(max(1, len(w) // rng.choice([6, 12, 25]))):
                w[rng.randrange(len(w))] = words(rng, 1)
            texts[i] = " ".join(w)
        elif kind == 2:
            texts[i] = passage + " " + words(rng, rng.randrange(5, 50))
        else:
            texts[i] = texts[rng.randrange(i)]
    texts |= {70: "", 71: None, 72: " \n "}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = similar.similarity_clusters(df, [0.3, 0.5, 0.7], crowd=crowd).collect()
    for level in (0.3, 0.5, 0.7):
        assert {r["id"]: r[f"cluster_{round(level * 100)}"] for r in got} == plain_clusters(texts, level)


def family(rng, copies, changes, length=60):
    """Near copies of one text, each with words of its own."""
    base, out = words(rng, length).split(), []
    for i in range(copies):
        w = list(base)
        for at in rng.sample(range(length), changes):
            w[at] = f"own{i}x{at}"
        out.append(" ".join(w))
    return out


def test_near_copies_do_not_travel_once_for_each_run(spark, monkeypatch):
    rng, seen = random.Random(4), {}
    write = similar.materialise

    def noted(df, name):
        seen[name] = write(df, name)
        return seen[name]

    monkeypatch.setattr(similar, "materialise", noted)
    texts = dict(enumerate(family(rng, 40, 4) + family(rng, 40, 9)))
    got = similar.similarity_clusters(spark.createDataFrame(list(texts.items()), "id long, text string"), [0.3, 0.5, 0.7], crowd=10).collect()
    for level in (0.3, 0.5, 0.7):
        assert {r["id"]: r[f"cluster_{round(level * 100)}"] for r in got} == plain_clusters(texts, level)
    crowded = seen["buckets"].where("count > 10")
    assert crowded.agg(F.sum("count")).first()[0] > 8 * len(texts)
    assert seen["crowds"].count() <= 4 * len(texts)
    assert seen["sets"].selectExpr("max(size(r) - n)").first()[0] < 0  # runs of one text stay behind


@pytest.mark.parametrize("block, runs", [(8, 1 << 20), (2048, 300)])
def test_similarity_clusters_in_blocks_and_with_hubs(spark, monkeypatch, block, runs):
    rng = random.Random(8)
    for name, value in (("BLOCK", block), ("RUNS", runs), ("SOME", 1), ("PAIRS", 7), ("COLUMNS", 4), ("FEW", 0)):
        monkeypatch.setattr(similar, name, value)
    texts = family(rng, 20, 4) + family(rng, 20, 9) + [f"a b c d e {words(rng, 1)}" for _ in range(400)]
    texts = dict(enumerate(texts + texts[:9]))
    got = similar.similarity_clusters(spark.createDataFrame(list(texts.items()), "id long, text string"), [0.3, 0.5, 0.7], crowd=10).collect()
    for level in (0.3, 0.5, 0.7):
        assert {r["id"]: r[f"cluster_{round(level * 100)}"] for r in got} == plain_clusters(texts, level)


def test_overlaps_of_many_columns(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(similar, "COLUMNS", 16)
    sets = [np.unique(rng.integers(0, 300, n)) for n in (0, 1, 5, 80, 200)]
    want = [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]
    assert similar.overlaps(sets, sets[1:]).tolist() == want


# ---- modules


@pytest.fixture(scope="module")
def modules(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([-1, 3, 8, 8, 11]), rng.choice("AABC"), rng.choice(["x", "y", ""]), rng.randrange(4) / 4, rng.randrange(3) / 3, rng.randrange(2) / 1.0) for i in range(90)]
    return rows, spark.createDataFrame(rows, "centre long, cluster long, signature string, family string, unknown_ratio double, vote_fraction double, sensitive_fraction double")


def plain_metrics(rows, clusters):
    by = {}
    for r, c in zip(rows, clusters):
        if c >= 0:
            by.setdefault(c, []).append(r)
    n = sum(map(len, by.values()))
    return {
        "consistency": sum(max(Counter(r[2] for r in own).values()) for own in by.values()) / n,
        "family_count": sum(len({r[3] for r in own} - {""}) for own in by.values()) / len(by),
        **{m: sum(r[k] for own in by.values() for r in own) / n for k, m in ((4, "unknown_ratio"), (5, "vote_fraction"), (6, "sensitive_fraction"))},
    }


def test_cluster_null_follows_shuffles(modules):
    rows, df = modules
    got = {r["metric"]: r for r in discovery.cluster_null(df, "family", 400).collect()}
    seen = plain_metrics(rows, [r[1] for r in rows])
    rng, null = random.Random(1), []
    for _ in range(2000):
        names = [r[1] for r in rows]
        rng.shuffle(names)
        null.append(plain_metrics(rows, names))
    assert got.keys() == seen.keys()
    for m, r in got.items():
        values = np.array([x[m] for x in null])
        assert abs(r["observed"] - seen[m]) < 1e-8
        assert abs(r["null_mean"] - values.mean()) < 5 * max(values.std(), 1e-9) / 20 + 1e-9
        assert abs(r["p"] - (values >= seen[m] - 1e-9).mean()) < 0.1
        assert abs(r["null_low"] - np.quantile(values, 0.025)) < 1.2 * values.std() + 1e-9


def test_rollup_and_metrics(modules):
    rows, df = modules
    m = discovery.cluster_metrics(discovery.cluster_rollup(df, "family")).first()
    seen = plain_metrics(rows, [r[1] for r in rows])
    assert m["module_count"] == sum(r[1] >= 0 for r in rows) and m["cluster_count"] == 3
    assert abs(m["mean_family_count"] - seen.pop("family_count")) < 1e-9
    assert all(abs(m[f"weighted_{k}"] - v) < 1e-9 for k, v in seen.items())
    none = discovery.cluster_metrics(discovery.cluster_rollup(df.where("cluster < 0"), "family")).first()
    assert none["cluster_count"] == 0 and none["weighted_consistency"] == 0


def test_mean_vectors_of_windows(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, None), (1, 3, [0.0, 2.0]), (2, 1, None), (2, 2, None)]
    df = spark.createDataFrame([(*r, "k", "l") for r in rows], "seq long, at long, e array<double>, kind string, label string")
    w = discovery.module_windows(df, W.partitionBy("seq").orderBy("at"), 1, "at", "kind", "e", F.lit(True), F.col("at") > 1, "label", ["l"])
    got = {(r["seq"], r["at"]): (r["v"], r["members"], r["signature"], r["unknown_ratio"], r["vote_fraction"], r["sensitive_fraction"]) for r in w.collect()}
    assert got == {(1, 1): ([1.0, 0.0], [1, 2], "k|k", 1.0, 0.5, 1.0), (1, 2): ([0.5, 1.0], [1, 2, 3], "k|k|k", 1.0, 2 / 3, 1.0), (1, 3): ([0.0, 2.0], [2, 3], "k|k", 1.0, 1.0, 1.0)}


def test_cluster_null_of_many_clusters_and_kinds(spark):
    """2,100 clusters by 2,500 kinds were an error, since a table of counts had 4 million cells at most."""
    rng = random.Random(8)
    names = [-1] * 300 + [c for c in range(2100) for _ in range(2 + c % 2)]
    rows = [(i, c, f"s{rng.randrange(3000)}", rng.choice(["", None, *(f"f{k}" for k in range(3000))]), rng.randrange(4) / 4, 0.5, rng.randrange(2) / 1.0) for i, c in enumerate(names)]
    df = spark.createDataFrame(rows, "centre long, cluster long, signature string, family string, unknown_ratio double, vote_fraction double, sensitive_fraction double")
    got = {r["metric"]: r for r in discovery.cluster_null(df, "family", 200).collect()}
    plain, null = [(*r[:3], r[3] or "", *r[4:]) for r in rows], []
    for _ in range(40):
        rng.shuffle(names)
        null.append(plain_metrics(plain, names))
    for m, r in got.items():
        values = np.array([x[m] for x in null])
        assert abs(r["null_mean"] - values.mean()) < 5 * values.std() / 40**0.5 + 1e-9
        assert values.mean() - 4 * values.std() - 1e-9 <= r["null_low"] <= r["null_high"] <= values.mean() + 4 * values.std() + 1e-9


@pytest.mark.parametrize("portion, sizes, kinds", [(1 << 20, [1, 2, 4, 60], [40, 30, 10]), (8, [1, 2, 2, 4, 12, 30], [40, 30, 10]), (20, [2, 3, 3, 7], [1] * 9 + [3, 4]), (8, [], [5])])
def test_dealt_modules_follow_the_law(monkeypatch, portion, sizes, kinds):
    """In portions of every kind: sizes are kept, no kind is dealt twice, and means are those of a random deal."""
    monkeypatch.setattr(discovery, "SLICE", portion)
    sizes, kinds = np.array(sizes, np.int64), np.array(kinds, np.int64)
    tables = np.zeros((3000, len(sizes), len(kinds)), np.int64)
    for it in range(len(tables)):
        last = -1
        for c, k, n in discovery._dealt(np.random.default_rng([it]), sizes, kinds):
            assert c.min() > last and (np.diff(c) >= 0).all() and n.min() > 0
            last = c.max()
            np.add.at(tables[it], (c, k), n)
    assert (tables.sum(2) == sizes).all() and (tables.sum(1) <= kinds).all()
    want = sizes[:, None] * kinds / kinds.sum()
    spread = want * (1 - kinds / kinds.sum()) * (kinds.sum() - sizes[:, None]) / (kinds.sum() - 1)
    assert (np.abs(tables.mean(0) - want) <= 5 * np.sqrt(spread / len(tables)) + 1e-9).all()
    assert (np.abs(tables.var(0) - spread) <= 0.25 * spread + 0.02).all()
