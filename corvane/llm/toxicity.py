"""Operator 7: toxicity scores after noisy-channel restoration of disguised words.

Restoration. A token that mixes letters with digits or signs, repeats a letter three times or more, or is one of three or
more single characters in a row is read as the noisy form of one word or several: each observed character is a letter
itself, a look-alike of letters, a repetition of the letter before, or a separator that stands for nothing or ends a word;
in a row of single characters a word may end behind each. Viterbi decoding finds the most likely words under this channel
and an interpolated Kneser-Ney character model of plain words. Where they are several, the most likely single word is read
too. All other tokens stay as they are. Distinct tokens of a batch are restored once.

Score. Features are the restored words and their prefixes of ``PREFIXES`` letters. Evidence for a feature is the number of
*different words before it*, so that copies and repeated passages count once, and the number of different texts that hold
it, each in toxic and in other training texts.
A feature is toxic if the lower confidence bounds of both toxic shares are at least ``FLOOR``, and harmless if three texts
hold it and most are not toxic; the longest feature of a word that is either decides on the word. A text's score is a
noisy-or over its distinct toxic words, above a small base rate.

Training. All labelled rows of the training folds count; the character model is of the plain words of the same texts.

Defined cases: null and empty texts, and any text when nothing is learned, get the base rate; a label that is null is not
learned from; an id, or a text, with several labels counts as toxic if one says so; equal texts get equal scores; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.kneser_ney import discounts
from corvane.llm.near_text import passes, seen_filter
from corvane.llm.words import gather, hashes, mix, segment_sum, slices, split_words, starts, texts_of
from corvane.session import materialise

PREFIXES, FLOOR, BASE, SPACED = (6, 5, 4, 3), 0.75, 0.02, 3
#: What a sign may stand for; fixed values of the channel.
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "ø": "o",
}
#: Negative log probabilities of the channel's steps.
SAME, ALIKE, REPEAT, NOTHING = 0.05, 1.0, 0.7, 1.2
START = "\2\2"


class Characters:
    """Interpolated Kneser-Ney character trigrams over plain words, for the decoder."""

    def __init__(self, counts: dict[str, int]):
        """Counts of plain words."""
        three: dict[str, int] = {}
        for word, n in counts.items():
            w = f"\2\2{word}\3"
            for k in range(len(w) - 2):
                three[w[k : k + 3]] = three.get(w[k : k + 3], 0) + n
        self._learn(three)

    @classmethod
    def of_trigrams(cls, three: dict[str, int]) -> Characters:
        out = cls.__new__(cls)
        out._learn(three)
        return out

    def _learn(self, three: dict[str, int]) -> None:
        self.levels, grams = [], three
        for _ in range(3):
            d = [0.0, *discounts([sum(c == k for c in grams.values()) for k in (1, 2, 3, 4)])]
            total: dict[str, float] = {}
            left: dict[str, float] = {}
            lower: dict[str, int] = {}
            for g, c in grams.items():
                total[g[:-1]] = total.get(g[:-1], 0) + c
                left[g[:-1]] = left.get(g[:-1], 0) + d[min(c, 3)]
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            self.levels.append(({g: (c - d[min(c, 3)]) / total[g[:-1]] for g, c in grams.items()}, {h: left[h] / total[h] for h in total}))
            grams = lower
        self.alphabet = {g[-1] for g in three}
        self.kept: dict[tuple[str, str], float] = {}

    def cost(self, context: str, c: str) -> float:
        """-log p(c | two characters before)."""
        key = (context, c)
        if key not in self.kept:
            p, weight = 0.0, 1.0
            for k, (prob, back) in enumerate(self.levels):
                h = context[k:]
                p += weight * prob.get(h + c, 0.0)
                weight *= back.get(h, 1.0)
            self.kept[key] = -math.log(p + weight / (len(self.alphabet) + 1))
        return self.kept[key]

    def restore(self, token: str) -> str:
        """The most likely single word behind a token."""
        return self._decode(token, False, False)

    def words(self, token: str, spaced: bool = False) -> list[str]:
        """The most likely words behind a token or, if ``spaced``, a run of single characters, and its single word if
        that is another reading."""
        found = self._decode(token, True, spaced).split()
        return [*found, self.restore(token)] if len(found) > 1 else found or [""]

    def _decode(self, token: str, several: bool, spaced: bool) -> str:
        """Words of the cheapest path, with spaces between them. A word may end at a sign, which then stands for nothing
        else, and in a spaced run behind every character."""
        best = {START: (0.0, None)}  # last two letters -> (cost, (path before, letter))
        for k, c in enumerate(token):
            new: dict[str, tuple[float, tuple | None]] = {}

            def put(state, cost, path, letter=""):
                if state not in new or cost < new[state][0]:
                    new[state] = (cost, (path, letter) if letter else path)

            letters = [(c, SAME)] if c.isalpha() else []
            letters += [(x, ALIKE) for x in LOOK_ALIKE.get(c, "")]
            for state, (cost, path) in best.items():
                for x, step in letters:
                    put(state[1] + x, cost + step + self.cost(state, x), path, x)
                    if state[1] == x and k and (token[k - 1] == c or c not in LOOK_ALIKE):
                        put(state, cost + step + REPEAT, path)
                if not c.isalpha():
                    put(state, cost + NOTHING, path)
                    if several and state != START:
                        put(START, cost + NOTHING + self.cost(state, "\3"), path, " ")
            if spaced:
                for state, (cost, path) in list(new.items()):
                    if state != START:
                        put(START, cost + self.cost(state, "\3"), path, " ")
            best = new or best

        def text(path):
            out = []
            while path:
                path, letter = path
                out.append(letter)
            return "".join(reversed(out))

        ends = [(cost + (0.0 if state == START and path else self.cost(state, "\3")), path) for state, (cost, path) in best.items()]
        least = min(cost for cost, _ in ends)
        return min(text(path) for cost, path in ends if cost == least)


SUSPECT = r"\p{L}.*[^\p{L}\p{M}].*\p{L}|[0-9@$!|+(<€£¡§].*\p{L}.*\p{L}|\p{L}.*\p{L}.*[0-9@$!|+(<€£¡§]"
THREE = r"aaa|bbb|ccc|ddd|eee|fff|ggg|hhh|iii|jjj|kkk|lll|mmm|nnn|ooo|ppp|qqq|rrr|sss|ttt|uuu|vvv|www|xxx|yyy|zzz"
EDGE = r"^[^\p{L}\p{N}@$!|+(<€£¡§]+|[^\p{L}\p{N}@$]+$"


def restored(texts: pa.StringArray, model: Characters) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(words of each text, codes in order, distinct plain words). Spaced-out letters come as further words behind the
    others of their text."""
    sizes, codes, words = split_words(texts)
    low = pc.utf8_lower(words)
    single = pc.equal(pc.utf8_length(low), 1).to_numpy(zero_copy_only=False)
    plain = pc.replace_substring_regex(low, r"[^\p{L}]+", "")
    core = pc.replace_substring_regex(low, EDGE, "")
    odd = pc.or_(pc.match_substring_regex(core, SUSPECT), pc.match_substring_regex(core, THREE))
    odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    found = plain.to_pylist()
    more: dict[int, list[str]] = {}
    for k, token in zip(odd.tolist(), core.take(pa.array(odd)).to_pylist()):
        found[k], *rest = model.words(token)
        if rest:
            more[k] = rest
    # runs of single characters
    extra_doc, extra = [], []
    if len(codes):
        one = single[codes]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        edge = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (doc[1:] != doc[:-1])))
        length = np.diff(np.append(edge, len(one)))
        signs = low.to_pylist() if one.any() else []
        read: dict[str, list[str]] = {}
        for a, n in zip(edge[one[edge] & (length >= SPACED)].tolist(), length[one[edge] & (length >= SPACED)].tolist()):
            run = "".join(signs[c] for c in codes[a : a + n].tolist())
            if run not in read:
                read[run] = model.words(run, True)
            extra_doc += [int(doc[a])] * len(read[run])
            extra += read[run]
    if more:
        many = np.ones(len(found), np.int64)
        many[list(more)] += [len(x) for x in more.values()]
        at = starts(many)[:-1]
        parts = np.repeat(np.arange(len(found)), many)
        for k, rest in more.items():
            parts[at[k] + 1 : at[k] + many[k]] = len(found) + np.arange(len(rest))
            found += rest
        sizes, codes = segment_sum(many[codes], sizes), parts[gather(at, many, codes)]
    if extra:
        codes = np.insert(codes, starts(sizes)[1:][extra_doc], len(found) + np.arange(len(extra)))
        sizes = sizes + np.bincount(extra_doc, minlength=len(sizes))
        found += extra
    return sizes, codes, pa.array(found, pa.string())


def features(words: pa.StringArray) -> np.ndarray:
    """(words, 1 + prefixes): hashes of each word and its prefixes; 0 where there is none."""
    n = pc.utf8_length(words).to_numpy()
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = np.where(n > 1, hashes(words), 0)
    for k, p in enumerate(PREFIXES, 1):
        out[:, k] = np.where(n >= p, mix(hashes(pc.utf8_slice_codeunits(words, 0, p)) + np.uint64(p)), 0)
    return out


def _trigrams_of(texts: DataFrame) -> dict[str, int]:
    """Character trigrams, with marks for the ends, of the plain words that the texts hold at least twice. The alphabet
    bounds them."""

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            _, codes, words = split_words(texts_of(batch.column("text")))
            n = np.bincount(codes, minlength=len(words))
            low = pc.utf8_lower(pc.replace_substring_regex(words, r"[.,;:!?]+$", ""))
            ok = pc.match_substring_regex(low, r"^\p{L}+$").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([low.filter(pa.array(ok)), pa.array(n[ok])], ["word", "n"])

    rows = texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    grams = "transform(sequence(1, char_length(word) + 1), k -> substring(concat('\u0002\u0002', word, '\u0003'), k, 3))"
    rows = rows.select("n", F.explode(F.expr(grams)).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in rows.collect()}


def fit(documents: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The character model and the lexicon; both are small and travel with the tasks."""
    spark = documents.sparkSession
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(f"id is not null and y is not null and crc32(cast(cast(id as string) as binary)) % {folds} <> {fold}")
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # hashes of labelled texts first: only texts that pass a filter over them are shuffled, once
    own = F.xxhash64("text").alias("h")
    known = materialise(texts.select("id", own).join(marks, "id").groupBy("h").agg(F.max("y").alias("y")), "labelled-hashes")
    seen = spark.sparkContext.broadcast(seen_filter(known.select("h")))

    def among(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(0).to_numpy(), seen.value)))

    some = texts.select(own, F.col("text").cast("string").alias("text")).mapInArrow(among, "h long, text string")
    labelled = materialise(some.join(known, "h").groupBy("h").agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y"), "labelled")
    model = Characters.of_trigrams(_trigrams_of(labelled))
    shipped = spark.sparkContext.broadcast(model)

    def by_text(batches):
        """Texts of either kind for each feature, summed in the batch."""
        for batch in slices(batches, "text", 4 << 20):
            sizes, codes, words = restored(texts_of(batch.column("text")), shipped.value)
            if not len(codes):
                continue
            doc, table = np.repeat(np.arange(len(sizes)), sizes), features(words)
            y = batch.column("y").to_numpy(zero_copy_only=False) > 0
            pairs = np.unique(doc * np.int64(len(words)) + codes)
            doc, codes = pairs // len(words), pairs % len(words)
            for k in range(table.shape[1]):
                keys, first, name = np.unique(table[:, k], return_index=True, return_inverse=True)
                both = np.unique(doc * np.int64(len(keys)) + name[codes])  # a feature once a text
                f = both % len(keys)
                total = np.bincount(f, minlength=len(keys))
                bad = np.bincount(f, weights=y[both // len(keys)], minlength=len(keys)).astype(np.int64)
                some = np.flatnonzero((keys != 0) & (total > 0))
                root = table[first, -1]
                for at in range(0, len(some), 1 << 16):
                    part = some[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(root[part].view(np.int64)), pa.array((total - bad)[part]), pa.array(bad[part])], ["f", "root", "good", "bad"])

    count = labelled.mapInArrow(by_text, "f long, root long, good long, bad long").groupBy("f").agg(F.min("root").alias("root"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    count = materialise(count.where(F.col("good") + F.col("bad") > 2), "features")
    likely = count.where("bad > 4").withColumn("q", _lower_bound("bad", "good")).where(F.col("q") >= FLOOR)
    wanted = np.array(sorted(r.f & (2**64 - 1) for r in likely.select("f").collect()), np.uint64)  # words and prefixes that mark toxic texts, not rows

    def by_word(batches):
        """Words before each likely feature."""
        for batch in slices(batches, "text", 4 << 20):
            sizes, codes, words = restored(texts_of(batch.column("text")), shipped.value)
            y = np.repeat(batch.column("y").to_numpy(zero_copy_only=False) > 0, sizes).astype(np.uint64)
            name, table = hashes(words)[codes], features(words)
            before = np.append(np.uint64(1), name[:-1])[: len(name)]
            before[starts(sizes)[:-1][sizes > 0]] = 1
            for k in range(table.shape[1]):
                ok = np.flatnonzero(np.isin(table[:, k], wanted)[codes])
                found = np.unique(np.stack([table[codes[ok], k], before[ok], y[ok]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, c]).view(np.int64)) for c in range(3)], ["f", "before", "y"])

    seen = labelled.mapInArrow(by_word, "f long, before long, y long").distinct()
    words = seen.groupBy("f").agg(F.count_if(F.col("y") == 0).alias("good_words"), F.count_if(F.col("y") == 1).alias("bad_words")).where("bad_words > 4")
    bad = likely.join(words, "f").select("f", "root", F.least("q", _lower_bound("bad_words", "good_words")).alias("q")).where(F.col("q") >= FLOOR)
    bad = materialise(bad, "lexicon")
    harmless = count.where("good >= bad").join(bad.select("root").distinct(), "root", "left_semi").select("f", F.lit(0.0).alias("q"))
    rows = bad.select("f", "q").union(harmless).collect()  # the marking words and others that begin alike
    rows = sorted((r.f & (2**64 - 1), r.q) for r in rows)
    return {"keys": np.array([r[0] for r in rows], np.uint64), "q": np.array([min(r[1], 0.99) for r in rows]), "characters": shipped}


def _lower_bound(bad: str, good: str, z: float = 1.64):
    """Wilson's lower bound of bad / (bad + good)."""
    n = F.col(bad) + F.col(good)
    p = F.col(bad) / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def probabilities(texts: pa.StringArray, model: dict) -> np.ndarray:
    sizes, codes, words = restored(texts, model["characters"].value)
    out = np.full(len(sizes), math.log(1 - BASE))
    if not len(codes) or not len(model["keys"]):
        return 1 - np.exp(out)
    table = features(words)
    place = np.minimum(np.searchsorted(model["keys"], table), len(model["keys"]) - 1)
    known = (model["keys"][place] == table) & (table != 0)
    q = np.where(known.any(1), model["q"][place][np.arange(len(table)), known.argmax(1)], 0.0)
    hot = np.flatnonzero(q[codes] > 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)[hot]
    pairs = np.unique(np.stack([doc, codes[hot]], 1), axis=0) if len(hot) else np.zeros((0, 2), np.int64)
    np.add.at(out, pairs[:, 0], np.log1p(-q[pairs[:, 1]]))
    return 1 - np.exp(out)


def score(documents: DataFrame, model: dict, keep: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns ``keep`` with ``score`` and ``predicted``."""
    source = documents.select(*keep, F.col(text_col).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            p = probabilities(texts_of(batch.column(len(keep))), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return source.mapInArrow(run, f"{kept}, score double, predicted int")


def fit_and_score(documents: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    model = fit(documents, labels, folds, fold)
    marked = documents.select("doc_id", F.expr(f"coalesce(crc32(cast(cast(doc_id as string) as binary)) % {folds} = {fold}, false)").alias("held_out"), "text")
    return score(marked, model, ["doc_id", "held_out"])


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents`` that score under the threshold, with all their columns."""
    model = fit(documents, labels)

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            yield batch.filter(pa.array(probabilities(texts_of(batch.column("text")), model) < threshold))

    return documents.mapInArrow(run, documents.schema)
