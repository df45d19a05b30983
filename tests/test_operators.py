"""Edge rules, properties and brute force for the library's own operators."""

import hashlib
import itertools
import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import scalar as S
from corvane.operators import audit, conform, hierarchy, matching, metrics, neighbours, ranking, regression, resample, sampling, similar, skew, validate, vectors
from corvane.operators.components import connected_components
from corvane.plans import registry
from corvane.sources import records


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_average_precision_merges_ties_and_is_null_without_positives(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("a", 0.5, 0), ("a", 0.5, 1), ("b", 0.3, 0)], "label_id string, score double, y int")
    got = {r.label_id: r.ap for r in metrics.average_precision(df, ["label_id"]).collect()}
    assert got["a"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and got["b"] is None


def test_average_precision_equals_brute_force_across_ranges(spark):
    rng = random.Random(1)
    data = [(round(rng.random(), 3), rng.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(data, "score double, y int")
    want, total = 0.0, sum(y for _, y in data)
    for t in sorted({s for s, _ in data}, reverse=True):
        over = [y for s, y in data if s >= t]
        want += sum(y for s, y in data if s == t) / total * sum(over) / len(over)
    assert metrics.average_precision(df, []).first().ap == pytest.approx(want)


def test_row_checks_count_the_first_failure(spark):
    sub = spark.createDataFrame([(1, "x", "0.5", 1), (1, "x", "0.6", 2), (9, "z", "bad", 3), (1, "z", "bad", 4), (2, "x", "", 5), (2, "x", "1.01", 6), (2, "x", "NaN", 7), (2, "x", "1", 8)], "item_id int, label_id string, score string, row_order int")
    known = spark.createDataFrame([(1, "x"), (2, "x")], "item_id int, label_id string")
    got = {r.row_order: r.status for r in validate.check_rows(sub, known, known).collect()}
    assert got == {1: "ok", 2: "duplicate", 3: "unknown_item", 4: "unknown_label", 5: "not_numeric", 6: "out_of_range", 7: "not_finite", 8: "ok"}
    with pytest.raises(ValueError):
        validate.require_columns(sub, {"item": ["protein"]})


def test_splits_depend_on_their_key_only(spark):
    df = spark.range(2000).select((F.col("id") % 50).alias("g"))
    a = rows(df.select("g", S.group_split(42, "s", "g").alias("s")).distinct())
    b = rows(df.repartition(7).select("g", S.group_split(42, "s", "g").alias("s")).distinct())
    assert a == b and len(a) == 50


def test_projection_operators_run_on_a_stream(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k string").parquet(str(tmp_path / "in"))
    q = stream.select("id", S.group_split(1, "s", "k").alias("s"), S.stable_bucket("k").alias("b")).writeStream.format("memory").queryName("stream_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = spark.read.parquet(str(tmp_path / "in")).select("id", S.group_split(1, "s", "k").alias("s"), S.stable_bucket("k").alias("b"))
    assert rows(spark.table("stream_out")) == rows(want)


def test_train_priors_do_not_see_held_out_labels(spark):
    base = [(1, k, k % 2 == 0, k % 3 == 0) for k in range(12)]
    turned = [(s, k, t, f if t else not f) for s, k, t, f in base]
    f = lambda data: rows(spark.createDataFrame(data, "seq int, k int, tr boolean, f boolean").select("k", neighbours.train_prior(F.col("f"), F.col("tr"), "seq").alias("p")))
    assert f(base) == f(turned)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = dict(rows(connected_components(spark.createDataFrame(edges, "src long, dst long"))))
    assert got == {x: top(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_chase_marks_cycles_and_paths_reach_the_root(spark):
    got = {r.old: (r.new, r.cyclic) for r in hierarchy.chase(spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "old int, new int")).collect()}
    assert got[1] == (3, False) and got[2] == (3, False) and got[5][1] and got[6][1]
    tree = spark.createDataFrame([("r", "r", "R"), ("a", "r", "A"), ("b", "a", "B"), ("c", "b", "C")], "id string, parent string, name string")
    paths = {r.id: (r.ids, r.depth) for r in hierarchy.root_paths(tree).collect()}
    assert paths["c"] == (["r", "a", "b", "c"], 3) and paths["r"] == (["r"], 0)


@pytest.mark.parametrize("kind, per, fetch", [("mixed", 1, 8), ("one label", 2, 3), ("alike", 2, 3)])
def test_matching_equals_first_come_first_served(spark, kind, per, fetch):
    """Seven keys: label, low, family, host, distance, gain, -probability; then the id."""
    rng = random.Random(5)
    names = [("x", "f", "p")] if kind != "mixed" else [("x", "f", "p"), ("x", "g", "p"), (None, "f", "p"), (None, "f", "q")]
    some = lambda: (*rng.choice(names), float(rng.randrange(12)))
    cand = [(f"c{k}", 2 * k + 1, *(("x", "f", "p", 3.0) if kind == "alike" else some())) for k in range(8)]
    pool = [(f"p{k:02d}", *some(), rng.random() < 0.8 if kind == "mixed" else True, float(rng.randrange(3)), -rng.randrange(3) / 4) for k in range(24)]
    c = spark.createDataFrame(rng.sample(cand, len(cand)), "candidate string, turn int, label string, family string, host string, value double")
    p = spark.createDataFrame(pool, "control string, label string, family string, host string, value double, low boolean, gain double, p double")
    got = {(r.candidate, r.match_rank): r.control for r in matching.matched_controls(c, p, ["label", "family", "host"], ["gain", "p"], per, fetch).collect()}
    used, want = set(), {}
    for name, _, lab, fam, host, value in cand:
        free = [((q[1] or "") != (lab or ""), not q[5], q[2] != fam, q[3] != host, abs(q[4] - value), q[6], q[7], q[0]) for q in pool if q[0] not in used]
        for k, best in enumerate(sorted(free)[:per], 1):
            want[(name, k)] = best[-1]
            used.add(best[-1])
    assert got == want


def test_exact_tests_have_known_values(spark):
    one = spark.range(1)
    assert one.select(resample.sign_test(F.lit(12), F.lit(0)).alias("p")).first().p == pytest.approx(0.00048828125)
    assert one.select(resample.sign_test(F.lit(0), F.lit(0)).alias("p")).first().p is None
    assert one.select(resample.fisher(F.lit(5), F.lit(22), F.lit(17), F.lit(10)).alias("p")).first().p == pytest.approx(0.001973, abs=1e-6)


def test_single_block_has_no_interval(spark):
    df = spark.createDataFrame([("f", "l", 0.9, 1), ("f", "l", 0.2, 0)], "family string, label_id string, score double, y int")
    r = resample.interval(resample.bootstrap_ap(df, [], "family", 5), [], "macro_ap").first()
    assert (r["mean"], r.low, r.high) == (None, None, None)
    assert resample.weighted_cache_ap(df, "family", 5).count() == 0


def test_ranks_and_running_sums_over_ranges(spark):
    rng = random.Random(31)
    data = [(None if k % 7 == 0 else "g" * (1 + k % 2), rng.randint(0, 50), k) for k in range(300)]
    df = spark.createDataFrame(data, "g string, v int, k int")
    got = {r.k: (r.rank, r.s) for r in ranking.running(df, ["g"], [F.desc("v"), F.col("k")], {"rank": F.lit(1), "s": F.col("v")}).collect()}
    for g in (None, "g", "gg"):
        total = 0
        for n, (_, v, k) in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            total += v
            assert got[k] == (n, total)


def test_signed_rank_equals_enumeration_and_the_normal_law(spark):
    free = [1.5, -0.2, 3.0, 2.5, -0.7, 4.0, 0.9]
    tied = [1.0, 1.0, -1.0, 2.0, 2.0, -3.0, 4.0, 0.0]
    df = spark.createDataFrame([("free", x) for x in free] + [("tied", x) for x in tied], "k string, d double")
    got = {r.k: r for r in resample.signed_rank(df, "k", "d").collect()}
    w = [sum(r * s for r, s in zip(range(1, 8), signs)) for signs in itertools.product((0, 1), repeat=7)]
    assert got["free"].w == 3 and got["free"].p == pytest.approx(min(1, 2 * sum(x <= 3 for x in w) / 2**7))
    n, ties = 7, (3**3 - 3) + (2**3 - 2)
    z = (8 - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)  # the minus ranks: 2 and 6
    assert got["tied"].w == 8 and got["tied"].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)


def test_large_exact_tests_are_closed_forms(spark):
    r = spark.range(1).select(resample.sign_test(F.lit(4000), F.lit(4100)).alias("s"), resample.fisher(*(F.lit(x) for x in (2000, 4000, 2100, 3900))).alias("f"), resample.log_choose(F.lit(15), F.lit(7)).alias("c")).first()
    assert r.c == pytest.approx(math.log(math.comb(15, 7)))
    assert r.s == pytest.approx(2 * sum(math.comb(8100, k) for k in range(4001)) / 2**8100, rel=1e-6)
    whole = math.comb(12000, 4100)
    p = [math.comb(6000, x) * math.comb(6000, 4100 - x) / whole for x in range(0, 4101)]
    assert r.f == pytest.approx(sum(x for x in p if x <= p[2000] * (1 + 1e-7)), rel=1e-6)


def test_least_squares_equal_numpy(spark):
    rng = random.Random(5)
    data = [(x := rng.random(), z := rng.gauss(0, 2), c := rng.choice("abc"), 3 * x - z + (c == "b") + rng.gauss(0, 0.3), 1.0, 2 * x) for _ in range(80)]
    df = spark.createDataFrame(data, "x double, z double, c string, y double, one double, twice double")
    got = {r.term: r for r in regression.least_squares(df, "y", ["x", "z", "one", "twice"], ["c"]).collect()}
    assert set(got) == {"intercept", "x", "z", "c=b", "c=c"}
    y = np.array([d[3] for d in data])
    m = np.array([[d[0], d[1], d[2] == "b", d[2] == "c"] for d in data], float)
    m = np.column_stack([np.ones(80), (m - m.mean(0)) / m.std(0)])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    left = y - m @ beta
    error = np.sqrt(left @ left / 75 * np.diag(np.linalg.inv(m.T @ m)))
    for k, name in enumerate(("intercept", "x", "z", "c=b", "c=c")):
        assert got[name].coefficient == pytest.approx(beta[k]) and got[name].error == pytest.approx(error[k])
    assert got["x"].r2 == pytest.approx(1 - left @ left / ((y - y.mean()) ** 2).sum())
    assert regression.student_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert regression.least_squares(df.limit(4), "y", ["x"]).count() == 0


def test_truth_forms_and_their_errors(spark):
    pairs = spark.createDataFrame([(1, "a", 1), (1, "b", 0)], "item_id int, label_id string, y int")
    lists = spark.createDataFrame([(1, "a"), (2, '["b", "a"]'), (3, None)], "item_id int, true_labels string")
    wide = spark.createDataFrame([(1, 1, 0)], "item_id int, `label:a` int, y_b int")
    load = lambda df: rows(validate.load_truth(df, ["a", "b"]))
    assert load(pairs) == load(wide) == [(1, "a", 1), (1, "b", 0)]
    assert load(lists) == [(1, "a", 1), (1, "b", 0), (2, "a", 1), (2, "b", 1), (3, "a", 0), (3, "b", 0)]
    for bad in (pairs.union(pairs), lists.union(lists), wide.union(wide), wide.drop("y_b")):
        with pytest.raises(ValueError):
            load(bad)


def test_corrupted_rows_take_values_of_others(spark):
    df = spark.createDataFrame([(k, f"f{k % 4}" if k else "alone", f"v{k}") for k in range(41)], "id int, f string, v string")
    got = sampling.corrupt_fraction(df, "id", "f", ["v"], 1.0).collect()
    family = {r.id: r.f for r in got}
    assert len(got) == 41 and all(r.v == f"v{r.donor}" and r.donor != r.id and (r.id == 0 or family[r.donor] == r.f) for r in got)
    assert sum(r.donor is not None for r in sampling.corrupt_fraction(df, "id", "f", ["v"], 0.3).collect()) == 12


def test_cyclic_trees_are_refused(spark):
    tree = spark.createDataFrame([("a", "b", "A"), ("b", "a", "B"), ("r", "r", "R"), ("c", "r", "C")], "id string, parent string, name string")
    with pytest.raises(ValueError):
        hierarchy.root_paths(tree)
    assert [(r.id, list(r.ids)) for r in hierarchy.root_paths(tree.where("id in ('r', 'c')")).orderBy("id").collect()] == [("c", ["r", "c"]), ("r", ["r"])]


def test_hub_join_parts_rows_by_a_filter_and_not_by_a_join(spark):
    rows_ = spark.createDataFrame([(i, "hub" if i % 3 else f"k{i}") for i in range(300)] + [(900, None), (901, "nowhere")], "id long, k string")
    right = rows_.where("k is not null and k <> 'nowhere'").groupBy("k").agg(F.count("*").alias("n"))
    got = skew.hub_join(rows_, right, ["k"], "n")
    assert sorted(r.id for r in got.collect()) == list(range(300))
    assert "Anti" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_hub_join_keeps_all_rows(spark):
    rows_ = spark.createDataFrame([(0, k) for k in range(200)] + [(k % 20, k) for k in range(200, 260)], "k int, v int")
    right = rows_.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = skew.hub_join(rows_, right, ["k"], "n")
    assert got.columns == ["k", "v", "m"] and rows(got) == rows(rows_.join(right.drop("n"), "k"))


def test_scalar_edges(spark):
    df = spark.createDataFrame([("[1", " ", 0), ('["b"," ","a"]', "nan", 8), (None, "x; y|x", 7)], "j string, t string, n int")
    got = df.select(S.json_list("j"), S.token_list("t"), S.length_bin("n"), S.blank_words("t")).collect()
    assert [list(r[0]) for r in got] == [[], ["b", "a"], []]
    assert list(got[2][1]) == ["x", "y"] and [r[2] for r in got] == ["len_0", "len2^3-4", "len2^2-3"] and [r[3] for r in got] == [None, None, "x; y|x"]
    w = spark.range(1).select(S.windows_of(F.lit(25), 10, 2).alias("w"), S.head_tail(F.lit("abcdefgh"), 4).alias("h"), S.longest_run(F.lit("xaabaaay"), "a").alias("r")).first()
    assert (w.w, w.h, w.r) == ([0, 8, 15], "abgh", 3)


def test_dense_windows_equal_a_greedy_loop(spark, sf):
    for r in spark.read.parquet(f"{sf}/part.parquet").select(F.lower("p_name").alias("s"), S.dense_windows(F.lower("p_name"), "aeiou", 4, 0.5).alias("n")).limit(50).collect():
        n, end = 0, 0
        for i in range(len(r.s) - 3):
            if i >= end and sum(c in "aeiou" for c in r.s[i : i + 4]) >= 2:
                n, end = n + 1, i + 4
        assert r.n == n


def test_strict_zero_leaves_null_keys_out(spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, "a", "test"), (3, "b", "test"), (4, None, "test"), (5, None, "train")], "id int, h string, s string")
    assert [r.id for r in audit.strict_zero(df, "h", "s").collect()] == [3]


def test_rules_and_modes_refuse(spark):
    df = spark.createDataFrame([("a Gear nut",)], "t string")
    rules = spark.createDataFrame([("m", "gear", None), ("n", "nut", "gear")], "label string, pattern string, exclude string")
    assert [r.label for r in conform.apply_rules(df, "t", rules).collect()] == ["m"]
    with pytest.raises(ValueError):
        conform.project_mode(df, {"a": ["x"]}, "a", ["t"])


def test_record_scans(spark, tmp_path):
    (tmp_path / "s.faa").write_text(">a first [Some bug]\nMKV\nLL\n>b second\nAAA\n")
    got = {r.id: (r.organism, r.sequence, r.length) for r in records.sequence_records(spark, str(tmp_path / "s.faa")).collect()}
    assert got == {"a": ("Some bug", "MKVLL", 5), "b": (None, "AAA", 3)}
    flat = 'LOCUS       X1   90 bp    DNA     linear\nACCESSION   X1\nDEFINITION  A thing.\nSOURCE      s\n  ORGANISM  Some bug\n            Realm; Family;\n            genus.\nREFERENCE   1\nFEATURES             Location/Qualifiers\n     source          1..90\n                     /host="h"\n                     /db_xref="taxon:7"\n                     /db_xref="other:8"\n     CDS             complement(12..30)\n                     /gene="g"\n                     /product="p q"\nORIGIN\n//\n'
    (tmp_path / "f.gb").write_text(flat)
    r = records.flat_records(spark, str(tmp_path / "f.gb")).first()
    assert (r.accession, r.features[1].type, r.features[1].location, r.features[1].qualifiers) == ("X1", "CDS", "complement(12..30)", {"gene": ["g"], "product": ["p q"]})
    assert (r.locus, r.length, r.molecule, r.organism, r.taxonomy, r.source.taxon, r.source.host) == ("X1", 90, "DNA", "Some bug", "Realm; Family; genus.", "7", "h")
    assert r.features[0].qualifiers["db_xref"] == ["taxon:7", "other:8"]
    atom = lambda n, res, b: f"ATOM  {n:5d}  CA  ALA A{res:4d}    {0:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{b:6.2f}\n"
    (tmp_path / "m1.pdb").write_text(atom(1, 1, 95) + atom(2, 2, 60) + "HETATM\n")
    q = records.atom_quality(spark, str(tmp_path / "m1.pdb")).first()
    assert (q.model, q.residues, q.mean, q.high, q.very_high) == ("m1", 2, 77.5, 0.5, 0.5)
    (tmp_path / "h.tsv").write_text("query\ttarget\tbits\nq\tt\t5\nq2\tt2\n")
    assert rows(records.hit_table(spark, str(tmp_path / "h.tsv"))) == [("q", "t", "5"), ("q2", "t2", None)]
    for k, deep in (("a", "x"), ("b", "x/y"), ("c", "")):  # at any depth; the second lacks fields, the third its metrics
        at = tmp_path / "runs" / deep / k
        at.mkdir(parents=True)
        (at / "run_manifest.json").write_text(json.dumps({"task_mode": k, "other": 1} | ({"biophysics_fields": ["f"], "selected_context_blocks": ["p", "q"]} if k == "a" else {})))
        if k != "c":
            (at / "metrics_summary.json").write_text(json.dumps({"best_epoch": 3, "test": {"macro_f1": 0.5}}, indent=1))
    runs = records.run_registry(spark, str(tmp_path / "runs")).collect()
    assert sorted((r.run_name, r.task_mode, r.with_biophysics, r.selected_context_blocks, r.context_control, r.best_epoch, r.test_macro_f1, r.validation_macro_f1) for r in runs) == [("a", "a", True, "p,q", "none", 3, 0.5, None), ("b", "b", False, "", "none", 3, 0.5, None)]


def test_qualifiers_of_every_form(spark, tmp_path):
    pad = "\n                     "
    body = f'     CDS             join(1..5,{pad}9..12){pad}/gene="a ""b"" c"{pad}/codon_start=2{pad}/pseudo{pad}/note="x{pad}/gene=y"{pad}/anticodon=(pos:1..3,{pad}aa:Met){pad}/db_xref="p"{pad}/db_xref=q{pad}/empty=""'
    (tmp_path / "f.gb").write_text(f"LOCUS       X1   90 bp    DNA     linear\nACCESSION   X1\nFEATURES             Location/Qualifiers\n{body}\nORIGIN\n//\n")
    r = records.flat_records(spark, str(tmp_path / "f.gb"))
    q = r.first().features[0].qualifiers
    assert q == {"gene": ['a "b" c'], "codon_start": ["2"], "pseudo": [""], "note": ["x /gene=y"], "anticodon": ["(pos:1..3, aa:Met)"], "db_xref": ["p", "q"], "empty": [""]}
    f = records.feature_rows(r).first()
    assert (f.location, f.start, f.end, f.parts, f.kind, f.codon_start, f.gene, f.flags) == ("join(1..5,9..12)", 1, 12, 2, "join", 2, 'a "b" c', ["empty", "pseudo"])


def test_open_queries_give_sane_rows(spark, sf):
    q = registry.queries()
    t = q["met14_temperature"](spark, sf).first()
    assert 0.2 < t.temperature < 10
    assert all(r.ap is None or 0 <= r.ap <= 1 for r in q["met23_linear_probe"](spark, sf).collect())
    assert all(0 <= r.share <= 1 for r in q["fn18_low_complexity"](spark, sf).collect())
    clusters = defaultdict(int)
    for r in q["ev16_density_clusters"](spark, sf).collect():
        clusters[r.cluster] += 1
    assert all(n >= 5 for c, n in clusters.items() if c != -1)
    taken = [r.control for r in q["smp4_matched_controls"](spark, sf).collect()]
    assert len(taken) == len(set(taken))
    assert not any(a == b for a, b in itertools.combinations(q, 2))


def cosines(v):
    v = np.array(v)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    return v @ v.T


@pytest.mark.parametrize("cell", [2000, 40])
def test_density_clusters_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 8)) * 3
    v = np.concatenate([centre[k % 6] + rng.normal(size=8) * 0.8 for k in range(240)]).reshape(240, 8)
    v = np.concatenate([v, rng.normal(size=(40, 8))])
    near = cosines(v) >= 0.85
    core = near.sum(1) >= 5
    label = np.where(core, np.arange(len(v)), -1)
    for _ in range(len(v)):  # least core of each component
        for i in np.flatnonzero(core):
            label[i] = label[near[i] & core].min()
    for i in np.flatnonzero(~core):
        label[i] = label[near[i] & core].min() if (near[i] & core).any() else -1
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    got = {r.id: r.cluster for r in vectors.density_clusters(df).collect()}
    assert [got[k] for k in range(len(v))] == label.tolist() and len(set(label)) > 3


@pytest.mark.parametrize("spread, recall", [(2.0, 0.98), (0.0, 0.98), (0.0, 1)])
def test_nearest_neighbours_reach_the_recall_asked_for(spark, monkeypatch, spread, recall):
    """In clusters and without any; 1 is exact."""
    monkeypatch.setattr(vectors, "CELL", 100)
    monkeypatch.setattr(vectors, "BLOCK", 256)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 16)) * spread
    n = 1200
    v = np.array([centre[k % 12] + rng.normal(size=16) for k in range(n)])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    got = defaultdict(set)
    for r in vectors.nearest_neighbours(df, 10, recall=recall).collect():
        got[r.src].add(r.dst)
    s = cosines(v)
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :10]
    assert all(len(x) == 10 for x in got.values())
    assert np.mean([len(got[k] & set(best[k].tolist())) / 10 for k in range(n)]) >= (1 if recall == 1 else 0.95)


def test_similarity_clusters_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(15):
        own = [word() for _ in range(60)]
        texts.append(" ".join(own))
        for part in (0.05, 0.15, 0.3):
            n = int(60 * part)
            at = rng.randrange(60 - n)
            texts.append(" ".join(own[:at] + [word() for _ in range(n)] + own[at + n :]))
    texts += [texts[0], "", None, "one two"]
    runs = []
    for t in texts:
        w = (t or "").split()
        runs.append({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in similar.similarity_clusters(df, [0.3, 0.5, 0.7]).collect()}
    for level in (0.3, 0.5, 0.7):
        root = list(range(len(texts)))
        find = lambda i: i if root[i] == i else find(root[i])  # noqa: B023, E731
        for i in range(len(texts)):
            for j in range(i):
                if runs[i] and runs[j] and len(runs[i] & runs[j]) / len(runs[i] | runs[j]) >= level:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        same = [got[i][f"cluster_{round(level * 100)}"] == find(i) for i in range(len(texts))]
        assert all(same), level


def test_splits_of_similarity_clusters_share_no_cluster(spark, sf):
    queries = registry.queries()
    for r in queries["agg36_threshold_overlaps"](spark, sf).collect():
        assert r.shared_clusters == 0 and r.train_clusters > 0
    assert queries["ev18_similarity_cluster_holdout"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_fitted_queries_have_their_terms(spark, sf):
    terms = {r.term for r in registry.queries()["inf16_linear_regression"](spark, sf).collect()}
    assert {"intercept", "l_quantity", "l_discount", "l_tax", "day", "flag=N", "flag=R"} == terms
    assert {r.label_id for r in registry.queries()["met23_linear_probe"](spark, sf).collect()} <= {"quality", "toxic"}
    rows_ = registry.queries()["ev16_density_clusters"](spark, sf).collect()
    sizes = defaultdict(int)
    for r in rows_:
        sizes[r.cluster] += 1
    assert all(n >= 5 for c, n in sizes.items() if c >= 0)


def test_windows_of_characters_take_texts_of_every_length_at_once():
    """batches of array operations, no folds that are interpreted symbol by symbol."""
    import numpy as np
    import pandas as pd

    from corvane.functions import windows

    texts = ["", "ab", None, "aaaaaaaaaaaa", "abcdefghijkl", "é€😀aaaa" * 4, "a" * 40, ""]
    got = windows.by_text(pd.Series(texts, dtype=object), lambda p, at, n: windows.low_complexity(p, at, n, 12, 4, 1.8)).tolist()

    def low(t):
        if len(t) < 12:
            return float(len(set(t)) <= max(1, len(t) // 3))
        flags = []
        for i in range(len(t) - 11):
            w = t[i : i + 12]
            shares = [w.count(c) / 12 for c in set(w)]
            flags.append(len(shares) <= 4 or -sum(x * np.log2(x) for x in shares) <= 1.8)
        return sum(flags) / len(flags)

    assert [None if x is None or x != x else round(x, 9) for x in got] == [None if t is None else round(low(t), 9) for t in texts]
    count = windows.by_text(pd.Series(texts, dtype=object), lambda p, at, n: windows.greedy(windows.whole(p, at, n, 5), at, n, 5)).tolist()
    assert count == [None if t is None else len(t) // 5 for t in texts]


def test_sequence_features_hold_no_interpreted_fold(spark, sf):
    """the plan has no lambda over the symbols of a sequence but that of the longest run."""
    from corvane.plans import registry

    for name in ("fn14_dense_windows", "fn18_low_complexity"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "lambdafunction" not in plan and "ArrowEvalPython" in plan


def test_the_atlas_keeps_strata_of_20_rows(spark, sf):
    """the least stratum had been raised to 100 rows."""
    from corvane.plans import registry

    found = [r.n for r in registry.queries()["inf19_stratified_atlas"](spark, sf).collect()]
    sizes = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").groupBy("source").count().where("count >= 20 and count < 100").count()
    assert min(found) >= 20 and sum(n < 100 for n in found) >= 2 * sizes


def test_item_draws_stream_past_the_items(spark, sf):
    """draws were merged by place in one hash table a task, 200 entries an item; now a task holds items only."""
    from corvane.plans.inference import family_draws

    plan = family_draws(spark, sf)._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_feature_quartiles_come_from_merged_values(spark, sf):
    """percentiles collected every value of a feature in one task."""
    from corvane.plans import registry

    plan = registry.queries()["agg28_feature_qc"](spark, sf)._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_qualifiers_are_parsed_once(spark, tmp_path):
    (tmp_path / "f").write_text("LOCUS       A   9 bp    DNA\nFEATURES   L\n     CDS             1..9\n                     /gene=\"g\"\nORIGIN\n//\n")
    plan = records.flat_records(spark, str(tmp_path / "f")).select("features")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_case_evidence_comes_from_windows_without_a_self_join(spark, sf):
    plan = registry.queries()["ev11_case_evidence"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


@pytest.mark.parametrize("share", [0.0, 2.0])
def test_vectors_with_and_without_cells_have_the_same_clusters_and_neighbours(spark, monkeypatch, share):
    monkeypatch.setattr(vectors, "CELL", 40)
    monkeypatch.setattr(vectors, "SHARE", share)  # 2: cells always
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "HELD", 500)
    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(30, 6)), 10, axis=0) + 0.4 * rng.normal(size=(300, 6))
    v[7] = v[250]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    found = defaultdict(list)
    for r in vectors.nearest_neighbours(df, 7, recall=1).collect():
        found[r.src].append((-round(r.w, 9), r.dst))
    for i in range(300):
        assert sorted(found[i]) == sorted((-max(s[i, j], 0.0), j) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:7])
    near = unit @ unit.T >= 0.85
    core = near.sum(1) >= 5
    label = np.where(core, np.arange(300), 300)
    while True:
        new = np.where(core, np.where(near & core[None, :], label[None, :], 300).min(1), 300)
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None, :], label[None, :], 300).min(1)
    want = [int(x) if x < 300 else -1 for x in border]
    got = {r.id: r.cluster for r in vectors.density_clusters(df).collect()}
    assert [got[i] for i in range(300)] == want


def test_vectors_in_most_cells_reach_travel_in_few_blocks(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(5000, 16)))], "id long, v array<double>")
    cells = vectors._Cells(vectors._prepared(df, "id", "v"))
    cells.weigh(len(cells.centres), 4)
    assert len(cells.centres) == 3 and cells.blocks == 3
    cells.blocks = 0
    cells.weigh(0.1, 4)
    assert cells.blocks == 0
    copies = vectors._Cells(vectors._prepared(df, "id", "v"))
    copies.blocks = 2
    assert vectors._dealt(vectors._prepared(df, "id", "v"), copies, None).count() == 5000 * 2 * 2


def test_permuted_counts_equal_a_deal_by_digests(spark, monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 40)
    rows = [(f"{'x' * (60 if k % 7 == 0 else 0)}{k // 2 if k in (10, 11) else k}", f"c{k % 5}", f"k{k % 3}", None if k % 4 == 0 else k % 2) for k in range(150)]  # long names, and one twice
    items = spark.createDataFrame(rows, "item string, cluster string, kind string, large int")
    got = {(r.iter, r.cluster, r.kind, r.large): r.n for r in resample.permuted_counts(items, "item", "cluster", ["kind", "large"], 20).collect()}
    names = [r[1] for r in sorted(rows)]
    want = defaultdict(int)
    for _, c, k, x in rows:
        want[-1, c, k, x] += 1
    number = {d: i for i, d in enumerate(sorted({r[2:] for r in rows}, key=lambda d: (d[0], d[1] is not None, d[1])))}
    for it in range(20):
        dealt = sorted(rows, key=lambda r: (hashlib.md5(f"42|{it}|{r[0]}".encode()).hexdigest(), number[r[2:]]))
        for c, r in zip(names, dealt):
            want[it, c, *r[2:]] += 1
    assert got == dict(want)


@pytest.mark.parametrize("group", [0, 30, 1_000_000])
def test_matching_by_groups_equals_first_come_first_served(spark, monkeypatch, group):
    """Lists, both, and groups alone; all candidates want the same controls, and some groups run out."""
    monkeypatch.setattr(matching, "GROUP", group)
    rng = random.Random(9)
    some = lambda: (rng.choice("xy"), rng.choice("fg"), rng.choice("pq"))
    cand = [(k, 2 * k, *some(), 100.0 + rng.randrange(5)) for k in range(30)]
    pool = [(1000 + k, *some(), rng.random() < 0.7, float(rng.randrange(60)), float(rng.randrange(3)), None if k % 9 == 0 else k % 2) for k in range(80)]
    c = spark.createDataFrame(cand, "candidate long, turn long, label string, family string, host string, value double")
    p = spark.createDataFrame(pool, "control long, label string, family string, host string, low boolean, value double, gain double, p int")
    got = {(r.candidate, r.match_rank): r.control for r in matching.matched_controls(c, p, ["label", "family", "host"], ["gain", "p"], 2).collect()}
    used, want = set(), {}
    for name, _, lab, fam, host, value in cand:
        free = sorted((q[1] != lab, not q[4], q[2] != fam, q[3] != host, abs(q[5] - value), q[6], q[7] is not None, q[7] or 0, q[0]) for q in pool if q[0] not in used)
        for k, best in enumerate(free[:2], 1):
            want[name, k] = best[-1]
            used.add(best[-1])
    assert got == want


def test_matching_takes_few_jobs_where_many_want_the_same(spark):
    c = spark.createDataFrame([(k, k, "x", 100.0 + k) for k in range(40)], "candidate long, turn long, label string, value double")
    p = spark.createDataFrame([(k, "x", float(k), True) for k in range(60)], "control long, label string, value double, low boolean")
    spark.sparkContext.setJobGroup("matching", "matching")
    got = {r.candidate: r.control for r in matching.matched_controls(c, p, ["label"], [], 1, 1).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("matching"))
    spark.sparkContext.setJobGroup("others", "others")
    assert got == {k: 59 - k for k in range(40)} and jobs < 100


def test_four_places_equals_a_formatted_double(spark):
    values = [0.0, -0.0, 1.0, -1.0, 0.5, -0.5, 1e-9, -1e-9, 0.00005, -0.00005, 1.00005, 2.34565, 123456.789, 9999999999999999.0, -3e17, 1e30, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.four_places(F.col("x")).alias("got"), F.format_string("%.4f", F.round("x", 4)).alias("want"))
    assert [r.got for r in df.collect()] == [r.want for r in df.collect()]
    plan = registry.queries()["win9_slots"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "decimal(20,4)" in plan  # no double is formatted where a decimal will do


def test_vectors_travel_once_for_each_block_where_pairs_are_mutual(spark):
    data = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)]
    df = spark.createDataFrame(data, "id long, v array<float>")
    rows_ = vectors._prepared(df, "id", "v")
    assert rows_.schema["v"].dataType.simpleString() == "array<float>"
    cells = vectors._Cells(rows_)
    cells.blocks = 4
    dealt = vectors._dealt(rows_, cells, None, True).select("i", "j", "query", "id").collect()
    assert len(dealt) == 60 * 4 and all(r.i <= r.j for r in dealt)
    met = defaultdict(set)
    for r in dealt:
        met[r.i, r.j].add(r.id)
    assert all(any({a, b} <= x for x in met.values()) for a, b in itertools.combinations(range(60), 2))


def test_four_metrics_read_the_rows_once(spark, monkeypatch):
    """Every measure comes from points of equal scores: rows are read once, and the points are as many as the scores."""
    seen, write, reads = [], metrics.materialise, spark.sparkContext.accumulator(0)
    monkeypatch.setattr(metrics, "materialise", lambda df, name: seen.append(write(df, name)) or seen[-1])
    rows = [(m, lab, (i * 7 % 5) / 4 if i % 11 else None, int(i % 3 == 0)) for m in "ab" for lab in "xyz" for i in range(200)]

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "model string, label_id string, score double, y int").mapInArrow(counted, "model string, label_id string, score double, y int")
    got = {r.model: r for r in metrics.four_metrics(df, ["model"]).collect()}
    assert reads.value == len(rows)
    assert [p.count() for p in seen] == [2 * 3 * 6]

    def ap(of):
        of, n, tp, out = [r for r in of if r[2] is not None], 0, 0, 0.0
        for s in sorted({r[2] for r in of}, reverse=True):
            own = [r[3] for r in of if r[2] == s]
            n, tp = n + len(own), tp + sum(own)
            out += sum(own) * tp / n
        return out / sum(r[3] for r in of)

    def f1(of):
        tp, fp, fn = (sum(1 for r in of if r[2] is not None and (r[2] >= 0.5) == h and r[3] == y) for h, y in ((True, 1), (True, 0), (False, 1)))
        return 2 * tp / (2 * tp + fp + fn)

    for m in "ab":
        own = [r for r in rows if r[0] == m]
        by = [[r for r in own if r[1] == lab] for lab in "xyz"]
        want = (sum(map(ap, by)) / 3, ap(own), sum(map(f1, by)) / 3, f1(own))
        assert all(abs(got[m][c] - w) < 1e-12 for c, w in zip(("macro_ap", "micro_ap", "macro_f1", "micro_f1"), want))


@pytest.mark.parametrize("held", [1 << 22, 500])
def test_neighbour_edges_are_exact_beyond_one_cell(spark, tmp_path, monkeypatch, held):
    """Vectors in crowds and alone, some of them equal: cells of the nearest centres hold most neighbours, not all."""
    monkeypatch.setattr(vectors, "CELL", 40)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "HELD", held)
    monkeypatch.setattr(vectors, "SHARE", 2)  # cells wherever a search may leave out some
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(10, 12)) * 1.5
    v = np.array([centre[k % 10] + rng.normal(size=12) for k in range(700)])
    v[100:130] = v[99]
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = defaultdict(list)
    for r in registry.queries()["ev17_neighbour_edges"](spark, str(tmp_path)).collect():
        found[r.src].append((r.dst, r.w))
    s = cosines(v)
    for i in range(len(v)):
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:15]
        assert sorted(j for j, _ in found[i]) == sorted(order)
        assert all(abs(w - max(s[i, j], 0)) < 1e-5 for j, w in found[i])


def test_feature_rows_write_compressed_records_and_parse_them_once(spark, sf, tmp_path, monkeypatch):
    """the records took half a kilobyte of disk for each feature, and their lines went through the shuffle as text."""
    from corvane.plans import records as plans

    monkeypatch.setattr(plans, "scratch", lambda *_: str(tmp_path))
    rows_ = registry.queries()["src4_feature_rows"](spark, sf)
    assert rows_._jdf.queryExecution().optimizedPlan().toString().count("FEATURES") == 1
    size = sum(f.stat().st_size for f in (tmp_path / "f").glob("part-*"))
    texts = spark.read.text(str(tmp_path / "f")).agg(F.sum(F.length("value") + 1)).first()[0]
    assert size * 8 < texts and texts > 400 * rows_.count()


def test_flat_records_come_back_from_several_compressed_files(spark, tmp_path):
    text = lambda k: f'LOCUS       X{k}   90 bp    DNA     linear\nACCESSION   X{k}\nFEATURES             Location/Qualifiers\n     CDS             1..{k}\n                     /note="a = b\n                     c"\n                     /pseudo\n                     /rate=a=b \nORIGIN\n        1 acgt\n//'
    records.write_flat(spark.createDataFrame([(text(k),) for k in range(1, 8)], "value string").coalesce(1), str(tmp_path / "f"), 3)
    assert len(list((tmp_path / "f").glob("part-*.gz"))) == 3
    got = records.flat_records(spark, str(tmp_path / "f")).collect()
    assert sorted((r.accession, r.features[0].location) for r in got) == [(f"X{k}", f"1..{k}") for k in range(1, 8)]
    assert all(r.features[0].qualifiers == {"note": ["a = b c"], "pseudo": [""], "rate": ["a=b"]} for r in got)
