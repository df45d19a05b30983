"""Operators with brute force on small fixtures or held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import decontaminate, language, near_text, pii, toxicity

EMPTY = [None, "", " \n", "x"]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", 1, True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, score int, kept boolean")


def words(rng, n, stems=("ka", "lo", "mi", "re", "tu", "san", "ver")):
    return ["".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_banded_alignment_equals_full_alignment():
    rng = random.Random(1)
    pairs = []
    for _ in range(150):
        a = [rng.randint(0, 20) for _ in range(rng.randint(0, 70))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randint(0, 20) for _ in range(rng.randint(0, 8))]
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
    limit = np.array([int(0.3 * max(len(a), len(b))) for a, b in pairs])
    want = [min(edit(a.tolist(), b.tolist()), x + 1) for (a, b), x in zip(pairs, limit)]
    assert near_text.edit_distances(pairs, limit).tolist() == want


def test_near_texts_group_copies_and_edited_copies(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        w = words(rng, rng.randint(30, 200))
        texts += [" ".join(w), " ".join(w), " ".join(w).upper()]
        v = list(w)
        for k in range(0, len(v), 25):
            v[k] = "changed"
        texts.append(" ".join(v))
        texts.append(" ".join(words(rng, 40)))
    texts += ["short one", "short one", *EMPTY, *EMPTY]
    got = {r.doc_id: (r.group_id, r.kept) for r in near_text.near_texts(frame(spark, texts)).collect()}
    for g in range(12):
        assert [got[5 * g + k][0] for k in range(4)] == [5 * g] * 4 and got[5 * g + 4] == (5 * g + 4, True)
    assert got[61] == (60, False) and got[62] == (62, True) and got[63] == (63, True)  # no words: alone
    assert got[65][0] == 65 and got[69][0] == 65  # "x" twice
    assert near_text.near_texts(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [20, 100, 1000])
def test_recall_of_near_texts_at_and_above_the_threshold(spark, size):
    """Scattered substitutions, edits in every fifth word, and a passage common to all texts: at least 0.9 of the pairs."""
    rng = random.Random(size)
    shared = words(rng, 60)
    many = 60 if size < 1000 else 25
    texts, bins = [], {}
    for similarity in (0.8, 0.85, 0.9, 0.95, "every fifth"):
        for k in range(many):
            own = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            if k % 2 and size > 20:
                own[5 : 5 + min(size // 4, 60)] = shared[: size // 4]
            places = range(4, size, 5) if similarity == "every fifth" else rng.sample(range(size), int((1 - similarity) * size + 1e-9))
            other = list(own)
            for at in places:
                other[at] = f"x{rng.randrange(10**6)}"
            assert edit(own, other) <= 0.2 * size + 1e-9 if size <= 100 else True
            bins.setdefault(similarity, []).append(len(texts))
            texts += [" ".join(own), " ".join(other)]
    got = {r.doc_id: r.group_id for r in near_text.near_texts(frame(spark, texts)).collect()}
    for similarity, first in bins.items():
        assert np.mean([got[i] == got[i + 1] for i in first]) >= 0.9, similarity


def test_near_texts_follow_chains_of_links_and_keep_unlike_texts_apart(spark):
    """Groups are the components of the true links, with chains whose ends are not alike and a passage that most texts hold."""
    rng = random.Random(21)
    shared, texts = words(rng, 40), []
    for g in range(12):
        own = [f"g{g}n{k}" for k in range(90)]
        own[20:50] = shared[:30]
        for _ in range(5):  # each differs from the one before by a tenth
            texts.append(" ".join(own))
            for at in rng.sample(range(len(own)), 13):
                own[at] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(words(rng, 30) + shared + words(rng, 40)))
    split = [t.split() for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if edit(split[i], split[j]) <= 0.2 * max(len(split[i]), len(split[j])) + 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.group_id for r in near_text.near_texts(frame(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_tiling_covers_reordered_passages():
    rng = random.Random(3)
    item = np.array([rng.randint(0, 10**6) for _ in range(40)], np.uint64)
    text = np.concatenate([np.arange(5, dtype=np.uint64), item[20:], np.arange(7, dtype=np.uint64), item[:20]])
    found = decontaminate.tiles(item, text)
    assert sorted(t[2] for t in found) == [20, 20]
    assert decontaminate.tiles(item, np.arange(50, dtype=np.uint64)) == []


def greedy(item, text, least):
    """Textbook tiling: the longest common run of free places, the first one in the item and then in the text."""
    a, b, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and a[i + k] and b[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        a[i : i + k] = [False] * k
        b[j : j + k] = [False] * k
        out.append((i, j, k))


def test_tiling_equals_the_textbook():
    rng = random.Random(4)
    for _ in range(40):
        item = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 25))], np.uint64)
        text = np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 40))], np.uint64)
        assert sum(t[2] for t in decontaminate.tiles(item, text)) == sum(t[2] for t in greedy(item.tolist(), text.tolist(), 3))


def test_decontamination(spark):
    rng = random.Random(5)
    items = [words(rng, 30) for _ in range(5)]
    clean = [" ".join(words(rng, 80)) for _ in range(10)]
    dirty = [" ".join(words(rng, 10) + items[k][15:] + ["and"] + items[k][:15] + words(rng, 10)).title() for k in range(5)]
    bench = spark.createDataFrame([(k, " ".join(t), k) for k, t in enumerate(items)] + [(9, None, 1), (10, "!!", 1)], "item_id long, text string, doc_id int")
    docs = frame(spark, clean + dirty + EMPTY)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(10 + k, k) for k in range(5)]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [*range(10), *range(15, 19)]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_short_items_and_the_joined_way(spark, sf, monkeypatch):
    """Items under five words are found whole, and a benchmark too large to travel gives the same rows by shuffles."""
    rng = random.Random(14)
    texts = [" ".join(words(rng, 30)) for _ in range(6)] + ["well, Four words ONLY here: kalo", "four words kalo only here", "yes", *EMPTY]
    docs = frame(spark, [*texts, texts[6]])
    items = ["four words only here", "three words here", "yes", " ".join(texts[2].split()[3:25]), "x", None, ""]
    bench = spark.createDataFrame([(k, t, k) for k, t in enumerate([*items, items[0]])], "item_id long, text string, spans int")
    want = [(2, 3), (6, 0), (6, 7), (8, 2), (12, 4), (13, 0), (13, 7)]
    stored, tests = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    results = []
    for most in (decontaminate.MOST_BYTES, 10):
        monkeypatch.setattr(decontaminate, "MOST_BYTES", most)
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == want
        kept = decontaminate.drop_contaminated(docs.withColumn("row", pii.F.lit(1)), bench)
        assert kept.columns == [*docs.columns, "row"] and sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 8, 9, 10, 11, 12]
        results.append((sorted(decontaminate.contaminated(stored, tests).collect()), decontaminate.drop_contaminated(stored, tests).count()))
    assert results[0] == results[1] and results[0][0]


KINDS = ("email", "ip", "card", "phone")
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        s = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_spans(t):
    found = sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PLAIN[kind], t or "") if valid(kind, m[0]))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def test_strict_spans_equal_plain_patterns(spark, sf):
    rng = random.Random(6)
    alphabet = ["a", "b", "@", ".", "-", "+", "_", "1", "22", "255", "256", " ", "é", "🙂", "(", ")", "4111 1111 1111 1111", "+1 (555) 123-4567", "a.b@c.de", "1.2.3.4", "0001"]
    texts = EMPTY + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    for docs in (frame(spark, texts), spark.read.parquet(f"{sf}/documents.parquet")):
        text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        base = pii.scan(docs).select("id", pii.F.expr(pii._text_of("base")).alias("b")).collect()
        assert len(base) == len(text)
        for r in base:
            assert r.b == brute_spans(text[r.id]), text[r.id]
    assert pii.report(frame(spark, [])).count() == 0


def test_contexts_discover_unseen_forms_and_masking_follows(spark):
    rng = random.Random(7)
    texts = [f"{' '.join(words(rng, 5))} my phone number: +1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)} {' '.join(words(rng, 3))}" for _ in range(60)]
    texts += ["kalo my phone number: 555-201-3344 mire", "release 2.0.1-77 tusan"]
    docs = frame(spark, texts)
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got[60] == "phone:22:34" and got[61] == ""
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[60] == "kalo my phone number: [PHONE] mire" and masked[61] == texts[61]


def test_each_loose_form_is_discovered_in_a_confident_context(spark):
    rng = random.Random(13)
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    texts = []
    for k in range(60):
        texts.append(f"kalo my phone number: +1 555 {digits(3)} {digits(4)} mire")
        texts.append(f"kalo write me at {words(rng, 1)[0]}{k}@example.com mire")
        texts.append(f"kalo the server ip 10.{k}.3.4 mire")
        card = "411111111111" + digits(3)
        card = next(card + x for x in "0123456789" if valid("card", card + x))
        texts.append(f"kalo paid with card {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} mire")
        texts.append(f"lore +1 555 {digits(3)} {digits(4)} is my cell, tu")
        secret = f"f{digits(24)}x{k}a"
        texts += [f'kalo auth token = "{secret}" mire', f"tu bearer {secret} sanver"]
    forms = {
        "kalo my phone number: 555 201 3344 mire": "kalo my phone number: [PHONE] mire",
        "kalo my phone number: (555) 201-3344 mire": "kalo my phone number: [PHONE] mire",
        "kalo my phone number: 555.201.3344, mire": "kalo my phone number: [PHONE], mire",
        "kalo my phone number: 555-201-3344 5th": "kalo my phone number: [PHONE] 5th",
        "kalo my phone number: 555 201 3344 123456 mire": "kalo my phone number: [PHONE] 123456 mire",
        "kalo my phone number: 555 201 3344 10.0.0.1 mire": "kalo my phone number: [PHONE] [IP] mire",
        "kalo write me at john.doe(at)example.com mire": "kalo write me at [EMAIL] mire",
        "kalo write me at john[at]example.com, mire": "kalo write me at [EMAIL], mire",
        "kalo write me at john (AT) example.com mire": "kalo write me at [EMAIL] mire",
        "kalo the server ip 10-0-3-4 mire": "kalo the server ip [IP] mire",
        "kalo paid with card 4111 1111 1111 1112 mire": "kalo paid with card [CARD] mire",
        "kalo paid with card 4111-1111-1111-1112 mire": "kalo paid with card [CARD] mire",
        'kalo auth token = "ab12cd34ef56" mire': 'kalo auth token = "[SECRET]" mire',
        "kalo bearer ab9876543210zz mire": "kalo bearer [SECRET] mire",
        "kalo 555-201-3344 is my cell, mire": "kalo [PHONE] is my cell, mire",
        "tusan 555 201 3344 and john(at)example.com": "tusan 555 201 3344 and john(at)example.com",
    }
    got = {r.doc_id: r.text for r in pii.mask(frame(spark, texts + list(forms))).collect()}
    assert [got[len(texts) + k] for k in range(len(forms))] == list(forms.values())


def planted(spark, sf):
    """The given documents with contexts at the end of every fifth text: most with a seed, every eleventh with an identifier
    that no strict pattern matches. Returns them and the places of what is to be discovered."""
    rng = random.Random(17)
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    rows, want = [], set()
    for n, r in enumerate(spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()):
        text = r.text or ""
        if n % 5 == 0:
            unseen = n % 11 == 0
            context, seed, other, kind = [
                ("dial us under ", f"+1 555 {digits(3)} {digits(4)}", f"0{digits(3)} {digits(3)}-{digits(4)}", "phone"),
                ("mailbox of mine: ", f"u{digits(6)}@example.org", f"u{digits(6)} (at) example.org", "email"),
                ("gateway host at ", f"10.1.{digits(2)}.{digits(2)}", f"10-1-{digits(2)}-{digits(2)}", "ip"),
            ][n // 5 % 3]
            text += f"\n{context}"
            if unseen:
                want.add((r.doc_id, f"{kind}:{len(text)}:{len(text) + len(other)}"))
            text += (other if unseen else seed) + " thanks"
        want |= {(r.doc_id, f"secret:{m.start(1)}:{m.end(1)}") for m in re.finditer(r'token = "([0-9a-f]+)"', text)}
        rows.append((r.doc_id, text))
    return spark.createDataFrame(rows, "doc_id long, text string"), want


def discovered(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    out = set()
    for r in pii.report(docs).collect():
        base, spans = ({s for s in x.split(",") if s} for x in (brute_spans(text[r.doc_id]), r.spans))
        assert base <= spans
        out |= {(r.doc_id, s) for s in spans - base}
    return out


def test_contexts_discover_planted_and_given_identifiers_and_nothing_without_them(spark, sf, monkeypatch):
    """Recall and precision of what no strict pattern matches: planted identifiers of three kinds and the given secrets."""
    docs, want = planted(spark, sf)
    kinds = {s.split(":")[0] for _, s in want}
    assert kinds == {"phone", "email", "ip", "secret"} and len(want) > 20
    got = discovered(docs)
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got), (want - got, got - want)
    monkeypatch.setattr(pii, "CONFIDENT", 2.0)  # no pattern is trusted: discovery is off
    assert discovered(docs) == set()


def test_key_like_strings_need_a_context(spark):
    key = lambda k: f"{k:02d}9f" * 8
    few = [f'kalo token = "{key(k)}" mire' for k in range(3)]
    assert {r.spans for r in pii.report(frame(spark, few)).collect()} == {""}
    many = [f'kalo token = "{key(k)}" mire' for k in range(10, 30)] + [f'tusan "{key(40)}" only here']
    assert [r.spans for r in pii.report(frame(spark, many)).orderBy("doc_id").collect()] == ["secret:14:46"] * 20 + [""]


def test_many_matches_in_a_text_keep_their_places(spark):
    text = " ".join(f"u{k}@x.org 10.0.0.{k % 256}" for k in range(3000))
    assert pii.scan(frame(spark, [text])).select(pii.F.expr(pii._text_of("base"))).first()[0] == brute_spans(text)


def test_masking_tells_rows_apart_by_position(spark):
    rows = [(None, "write to a@b.com now"), (None, "nothing here"), (7, "card 4111 1111 1111 1111"), (7, "ip 10.0.0.1 and c@d.org"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 spans", "2 row", "3 _id", "4 base", "5 _row", "6 new")
    assert pii.mask(docs).columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in pii.mask(docs).collect())
    assert got == sorted([("None", "write to [EMAIL] now"), ("None", "nothing here"), ("7", "card [CARD]"), ("7", "ip [IP] and [EMAIL]"), ("8", "None")])


def test_near_duplicates_stage_tells_rows_apart_by_position(spark, sf):
    import corpus_pipeline

    rng = random.Random(12)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    rows = [(9, a), (3, a), (3, a), (None, a), (None, b), (None, b), (5, c), (5, d), (4, d), (6, None), (None, "")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert got == sorted([("3", a), ("None", b), ("5", c), ("4", d), ("6", "None"), ("None", "")])


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    odd = {r.doc_id: r.lang_pred for r in language.identify(docs.unionByName(spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "12 34", "en", "s", 0)], docs.schema))).collect()}
    assert odd[10**6] == odd[10**6 + 1] == "und"
    assert language.identify(docs.limit(0)).count() == 0


def test_restoration(spark):
    model = toxicity.Characters({"idiot": 50, "stupid": 50, "house": 50, "garden": 50, "loser": 40, "table": 60})
    assert [model.restore(t) for t in ("1d10t", "stuuupid", "l.o.s.e.r", "$tup1d", "idiot")] == ["idiot", "stupid", "loser", "stupid", "idiot"]


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    bad = ["idiot", "moron", "stupid"]
    texts, labels = [], []
    for k in range(400):
        w = words(rng, 30)
        if k % 4 == 0:
            w[rng.randint(0, 29)] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append((k, int(k % 4 == 0)))
    texts += [" ".join(words(rng, 10) + ["1d10t"] + words(rng, 5)), "kalo i d i o t mire", *EMPTY]
    docs, marks = frame(spark, texts), spark.createDataFrame(labels + [(399, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.fit_and_score(docs, marks).collect()}
    held = [k for k, _ in labels if got[k].held_out]
    assert np.mean([got[k].predicted == labels[k][1] for k in held]) > 0.97
    assert got[400].predicted == 1 and got[401].predicted == 1 and all(got[k].predicted == 0 for k in range(402, 406))
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and 400 not in {r.doc_id for r in kept.collect()}
    assert toxicity.fit_and_score(docs.limit(0), marks).count() == 0


def test_glued_and_spaced_words_are_read_one_by_one():
    model = toxicity.Characters({"idiot": 50, "stupid": 50, "house": 50, "garden": 50, "loser": 40, "table": 60, "a": 200, "you": 80, "well": 60})
    assert "stupid" in model.words("astupid", True) and "idiot" in model.words("youidiot", True)
    for token in ("you-idiot", "well/1d10t", "you...idiot", "idiot?you"):
        assert "idiot" in model.words(token), token
    assert model.words("l.o.s.e.r") == ["loser"] and model.words("s t u p i d".replace(" ", ""), True)[-1] == "stupid"
    assert model.words("house-" * 300)[:300] == ["house"] * 300  # longer than any single part


def test_toxic_words_beside_others_are_scored(spark):
    rng = random.Random(9)
    bad = ["idiot", "moron", "stupid"]
    texts, labels = [], []
    for k in range(400):
        w = words(rng, 28) + rng.sample(["a", "you", "well", "no", "man", "such"], 3)
        rng.shuffle(w)
        if k % 4 == 0:
            w[rng.randint(0, 29)] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append((k, int(k % 4 == 0)))
    odd = ["such a s t u p i d man", "y o u i d i o t", "kalo you-idiot mire", "well/idiot", "no...idiot", "you?idiot", "well\u2014idiot no"]
    clean = ["such a m a n", "y o u", "kalo-mire", "well/you", "no...man"]
    docs, marks = frame(spark, texts + odd + clean), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.fit_and_score(docs, marks).collect()}
    assert [got[400 + k] for k in range(len(odd) + len(clean))] == [1] * len(odd) + [0] * len(clean)


def test_pipeline_keeps_clean_documents(spark, sf):
    import corpus_pipeline
    from corvane.session import table

    docs = table(spark, sf, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.5 * len(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(ids)
    pytest.importorskip("public_tokenizers")


def test_restoration_equals_the_best_of_all_paths():
    model = toxicity.Characters({"sale": 30, "seal": 20, "ails": 10, "lass": 25, "as": 60, "is": 40})
    rng = random.Random(17)

    def best(token, k, state, cost, text):
        if k == len(token):
            yield cost + (0.0 if state == toxicity.START and text else model.cost(state, "\3")), text
            return
        c = token[k]
        for x, step in [(c, toxicity.SAME)] * c.isalpha() + [(x, toxicity.ALIKE) for x in toxicity.LOOK_ALIKE.get(c, "")]:
            yield from best(token, k + 1, state[1] + x, cost + step + model.cost(state, x), text + x)
            if state[1] == x and k and (token[k - 1] == c or c not in toxicity.LOOK_ALIKE):
                yield from best(token, k + 1, state, cost + step + toxicity.REPEAT, text)
        if not c.isalpha():
            yield from best(token, k + 1, state, cost + toxicity.NOTHING, text)

    for _ in range(150):
        token = "".join(rng.choice("sale5@1!-l") for _ in range(rng.randint(1, 6)))
        cost, want = min(best(token, 0, toxicity.START, 0.0, ""))
        got = model.restore(token)
        paths = [c for c, t in best(token, 0, toxicity.START, 0.0, "") if t == got]
        assert got == want or abs(min(paths) - cost) < 1e-9, token


def brute_character_model(texts):
    """Interpolated Kneser-Ney over character 4-grams inside words, with dictionaries: cost of a word's characters."""
    from collections import Counter, defaultdict

    from corvane.llm.kneser_ney import discounts

    letters = lambda w: [ord(c) for c in re.sub(r"\d", "0", w.lower())] + [3]
    gram = lambda c, i, k: tuple([2] * max(k - 1 - i, 0) + c[max(i - k + 1, 0) : i + 1])
    words = Counter(w for t in texts for w in t.split())
    count = {k: Counter() for k in range(1, 5)}
    for w, n in words.items():
        c = letters(w)
        for i in range(len(c)):
            count[4][gram(c, i, 4)] += n
    for k in (3, 2, 1):
        wider = {gram(letters(w), i, k + 1) for w in words for i in range(len(letters(w)))}
        count[k] = Counter(g[1:] for g in wider)
    levels = {}
    for k in range(1, 5):
        d = [0.0, *discounts([sum(n == x for n in count[k].values()) for x in (1, 2, 3, 4)])]
        total, left = defaultdict(float), defaultdict(float)
        for g, n in count[k].items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3)]
        levels[k] = ({g: (n - d[min(n, 3)]) / total[g[:-1]] for g, n in count[k].items()}, {h: left[h] / total[h] for h in total})

    def cost(word, size):
        c, out = letters(word), 0.0
        for i in range(len(c)):
            p = 1.0 / size
            for k in range(1, 5):
                g = gram(c, i, k)
                p = p * levels[k][1].get(g[:-1], 1.0) + levels[k][0].get(g, 0.0)
            out -= np.log(p)
        return out, len(c)

    return cost, {g for g in count[1]}


def test_character_models_equal_dictionaries(spark):
    rng = random.Random(19)
    texts = {"aa": [" ".join(words(rng, 12)) for _ in range(20)], "bb": [" ".join(words(rng, 12, ("el", "no", "7x", "ri"))) for _ in range(20)]}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang in texts for t in texts[lang])]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    models = {lang: brute_character_model([t for i, t, g in rows if g == lang and not held(i)]) for lang in texts}
    size = max(2, len(set().union(*(m[1] for m in models.values()))) + 1)
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        entropy = {}
        for lang, (cost, _) in models.items():
            parts = [cost(w, size) for w in t.split()]
            entropy[lang] = sum(p[0] for p in parts) / sum(p[1] for p in parts)
        least = min(entropy.values())
        assert got[i].held_out == held(i) and got[i].lang_pred == min(entropy, key=entropy.get)
        assert got[i].entropy == pytest.approx(least, rel=1e-4)
        assert got[i].score == pytest.approx(1 / sum(np.exp(-(e - least) * language.EVIDENCE) for e in entropy.values()), rel=1e-2)


def test_pipeline_with_odd_rows_and_columns(spark, sf, tmp_path):
    """The stages chained over nulls, repeated ids, clashing names and empty tables."""
    import corpus_pipeline

    rng = random.Random(23)
    own = " ".join(words(rng, 50))
    rows = [(1, own), (1, own), (2, "mail me at a.b@c.org now"), (None, "call +1 555 123 4567 ok"), (None, None), (3, ""), (3, " ".join(words(rng, 40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars", "1 row", "2 _row", "3 spans", "4 ids", "5 label", "6 key")
    for name, table in (("documents", docs), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at = spark.createDataFrame(at.collect(), at.schema)
    texts = sorted((str(r.doc_id), str(r.text)) for r in at.collect())
    assert texts == sorted([("1", own), ("2", "mail me at [EMAIL] now"), ("None", "call [PHONE] ok"), ("None", "None"), ("3", ""), ("3", rows[-1][1])])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == 6 and {r.n_tokens for r in out if r.doc_id is None} >= {0}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("crowd", [64, 8])
def test_every_pair_that_meets_in_a_crowded_bucket_is_aligned(spark, monkeypatch, crowd):
    """F8, F9: texts with a common passage, two by two at the threshold; the members of large buckets met one or two leaders only."""
    if hasattr(near_text, "CROWD"):
        monkeypatch.setattr(near_text, "CROWD", crowd)
    if hasattr(near_text, "BLOCK"):
        monkeypatch.setattr(near_text, "BLOCK", 2 * crowd)
    rng = random.Random(21)
    passage, texts = words(rng, 50), []
    for k in range(90):
        own = [f"{w}{k}" for w in words(rng, 50)]
        other = list(own)
        for at in rng.sample(range(50), 20):  # 20 of 100 words
            other[at] = f"x{at}y{k}"
        texts += [" ".join(passage + own), " ".join(passage + other)]
    got = {r.doc_id: r.group_id for r in near_text.near_texts(frame(spark, texts)).collect()}
    sizes, h = near_text.word_hashes(pa.array(texts))
    n, grams = near_text.shingles(sizes, h, 3)
    keys = near_text.sketch(n, near_text.label_occurrences(n, grams), 64)
    meet = [2 * k for k in range(90) if (keys[2 * k] == keys[2 * k + 1]).any()]
    assert len(meet) > 80 and [k for k in meet if got[k] != got[k + 1]] == []
    assert len(set(got.values())) >= 90  # different pairs stay apart


def test_toxic_words_are_learned_from_all_labelled_rows(spark):
    """beyond 20,000 labelled rows only a sample was learned from; here the evidence lies in the other rows."""
    from pyspark.sql import functions as F

    ids = spark.range(30_000).where("crc32(cast(cast(id as string) as binary)) % 4 <> 2")
    total = ids.count()
    late = [r.id for r in ids.where(F.pmod(F.xxhash64(F.lit("labels"), "id"), F.lit(1 << 30)) >= int((1 << 30) * 20_000 / total)).orderBy("id").limit(24).collect()]
    rng, mark = random.Random(4), set(late)
    texts = [" ".join([*words(rng, 5), *(["zorgblat"] if k in mark else []), *words(rng, 1)]) for k in range(30_000)]
    docs = frame(spark, [*texts, "you zorgblat man"])
    got = {r.doc_id: r.predicted for r in toxicity.fit_and_score(docs, spark.createDataFrame([(k, int(k in mark)) for k in range(30_000)], "doc_id long, toxic int")).where("doc_id = 30000").collect()}
    assert got == {30_000: 1}


def test_hashing_words_takes_little_memory():
    import tracemalloc

    from corvane.llm import words

    some = pa.array([f"word{i}" for i in range(400_000)], pa.string())
    tracemalloc.start()
    got = words.hashes(some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20 and (got[[0, 399_999]] == words.hashes(["word0", "word399999"])).all()
