"""Operator 5: language identification by Kneser-Ney character models.

For each language an interpolated Kneser-Ney model of character 4-grams inside words (with marks for the word's ends) is
counted in Spark from a bounded sample of labelled texts. The models of all languages share one set of sorted hash
arrays, so one search gives the discounted probability of a character, or the back-off weight of its context, in every
language. A text gets the language with the lowest cross-entropy per character. Its score is the posterior over
``EVIDENCE`` characters. A text whose cross-entropy is above what all but a ``REJECT`` share of the language's own
training texts show is marked in ``rejected``.

Training sample: texts are taken by the hash of their id so that about ``sample`` whole texts of each language remain,
however many there are; a language with fewer gives all.

Defined cases: a null text or one without a letter is ``und`` with score 0; a row without a language is never learned
from; without any labelled text everything is ``und``; equal rows get equal answers; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import arrays
from corvane.llm.kneser_ney import discounts
from corvane.llm.words import MIX, hashes, mix, segment_sum, slices, split_words, starts, texts_of
from corvane.session import scratch

ORDER, SAMPLE, EVIDENCE, REJECT = 4, 800, 20, 0.01


def characters(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(characters of each word with its end mark, code points in order); every digit counts as one."""
    words = pc.replace_substring_regex(pc.utf8_lower(words), r"\p{N}", "0")
    text = "".join(words.to_pylist())
    flat = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = pc.utf8_length(words).to_numpy().astype(np.int64)
    out = np.full(len(flat) + len(n), 3, np.uint32)
    place = np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)
    out[place] = flat
    return n + 1, out


def grams(sizes: np.ndarray, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 1 to ORDER: (hash of the context, hash of context and character) at each character. Before the
    word's first character stand start marks."""
    place = np.arange(len(chars)) - np.repeat(starts(sizes)[:-1], sizes)
    context = np.zeros(len(chars), np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for order in range(1, ORDER + 1):
            if order > 1:
                back = order - 1
                before = np.where(place >= back, chars[np.maximum(np.arange(len(chars)) - back, 0)], np.uint32(2)).astype(np.uint64)
                context = mix(context * MIX + before + np.uint64(order))
            out.append((context, mix(context + (chars.astype(np.uint64) + np.uint64(7)) * MIX)))
    return out


def _sample(training: DataFrame, texts: int) -> DataFrame:
    """``(lang, text)``: about so many texts of each language, by the hash of the id."""
    size = training.groupBy("lang").count().select("lang", F.least(F.lit(1.0), F.lit(float(texts)) / F.col("count")).alias("share"))
    rolled = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) / float(1 << 20)
    return training.join(F.broadcast(size), "lang").where(rolled < F.col("share")).select("lang", "text")


def _word_counts(sample: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of the sample, summed in each batch and then over all."""

    def run(batches):
        for batch in slices(batches, "text", 8 << 20):
            coded = batch.column("lang").dictionary_encode()
            sizes, codes, words = split_words(texts_of(batch.column("text")))
            lang = np.repeat(coded.indices.to_numpy(), sizes).astype(np.int64)
            both, n = np.unique(lang * max(len(words), 1) + codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(both // max(len(words), 1))), words.take(pa.array(both % max(len(words), 1))), pa.array(n)], ["lang", "word", "n"])

    return sample.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _build(words: pa.StringArray, n: np.ndarray) -> list:
    """One language's arrays from its distinct words and their counts: for each order (gram hashes, discounted
    probabilities, context hashes, back-off weights). Lower orders count distinct left contexts."""
    sizes, chars = characters(words)
    weight = np.repeat(n, sizes)
    levels = grams(sizes, chars)
    out, extended = [None] * ORDER, None
    for k in range(ORDER - 1, -1, -1):
        context, gram = levels[k]
        if extended is None:
            keys, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
            count = np.bincount(inverse, weights=weight).astype(np.int64)
            own = context[first]
        else:  # distinct (wider gram) for each gram
            _, wide = np.unique(extended, return_index=True)
            keys, first, count = np.unique(gram[wide], return_index=True, return_counts=True)
            own = context[wide][first]
        d = np.array([0.0, *discounts([int((count == n).sum()) for n in (1, 2, 3, 4)])])
        names, inverse = np.unique(own, return_inverse=True)
        total = np.bincount(inverse, weights=count)
        cut = d[np.minimum(count, 3)]
        out[k] = (keys, ((count - cut) / total[inverse]).astype(np.float32), names, (np.bincount(inverse, weights=cut) / total).astype(np.float32))
        extended = gram
    return out


def fit(documents: DataFrame, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict | None:
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(f"lang is not null and text is not null and crc32(cast(cast(id as string) as binary)) % {folds} <> {fold}")
    root = scratch(spark, "language")

    def build(batches):
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))
        for lang in sorted(set(table["lang"].to_pylist())):
            own = table.filter(pc.equal(table["lang"], lang)).sort_by("word").combine_chunks()
            levels = _build(pa.concat_arrays(own["word"].chunks), own["n"].to_numpy())
            name = hashes([lang])[0]
            for k, level in enumerate(levels):
                for part, x in zip(("gram", "prob", "context", "weight"), level):
                    arrays.put(root, f"{name}-{k}-{part}", x)
            yield pa.RecordBatch.from_pydict({"lang": [lang]})

    # one task holds the distinct words of its languages' samples, which ``sample`` bounds
    langs = sorted(r.lang for r in _word_counts(_sample(rows, sample)).repartition("lang").mapInArrow(build, "lang string").collect())
    if not langs:
        return None
    parts = []  # the languages side by side: bounded by the sample
    for k in range(ORDER):
        for keys, values, empty in (("gram", "prob", 0.0), ("context", "weight", 1.0)):
            known = [(arrays.mapped(root, f"{hashes([g])[0]}-{k}-{keys}", np.uint64), arrays.mapped(root, f"{hashes([g])[0]}-{k}-{values}", np.float32)) for g in langs]
            names = np.unique(np.concatenate([x for x, _ in known]))
            table = np.full((len(names), len(langs)), empty, np.float32)
            for column, (x, v) in enumerate(known):
                table[np.searchsorted(names, x), column] = v
            arrays.put(root, f"all-{k}-{keys}", names)
            arrays.put(root, f"all-{k}-{values}", table)
            parts.append(len(names))
    meta = {"root": root, "langs": langs, "size": max(2, parts[0] + 1), "limit": [np.inf] * len(langs)}
    # rejection: the cross-entropy that all but a REJECT share of a language's own sample stays under
    own = _scored(_sample(rows, sample), ["lang"], meta, raw=True).where("lang = lang_pred")
    limits = own.groupBy("lang").agg(F.percentile_approx("entropy", 1 - REJECT, 10000).alias("limit")).collect()
    limits = {r.lang: r.limit for r in limits}
    meta["limit"] = [limits.get(g, np.inf) for g in langs]
    return meta


class Models:
    def __init__(self, meta: dict):
        self.meta, n = meta, len(meta["langs"])
        get = lambda k, part, kind: arrays.mapped(meta["root"], f"all-{k}-{part}", kind)
        self.levels = [(get(k, "gram", np.uint64), get(k, "prob", np.float32).reshape(-1, n), get(k, "context", np.uint64), get(k, "weight", np.float32).reshape(-1, n)) for k in range(ORDER)]

    @staticmethod
    def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return place, keys[place] == want

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(characters of each word, natural log probability in each language)."""
        sizes, chars = characters(words)
        # few characters follow many contexts: look each distinct 4-gram up once
        levels = grams(sizes, chars)
        last, first, inverse = np.unique(levels[-1][1], return_index=True, return_inverse=True)
        p = np.full((len(first), len(self.meta["langs"])), 1.0 / self.meta["size"], np.float32)
        for (context, gram), (keys, prob, names, weight) in zip(levels, self.levels):
            at, hit = self._find(names, context[first])
            p[hit] *= weight[at[hit]]
            at, hit = self._find(keys, gram[first])
            p[hit] += prob[at[hit]]
        log = np.log(p)
        at = starts(sizes)[:-1]
        out = np.stack([np.add.reduceat(log[:, k].astype(np.float64)[inverse], at) if len(at) else np.zeros(0) for k in range(p.shape[1])], 1)
        return sizes, out

    def texts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(best language or -1, cross-entropy per character in each language)."""
        sizes, codes, words = split_words(texts)
        n, log = self.words(words)
        total = np.maximum(segment_sum(n[codes], sizes), 1)
        entropy = np.stack([-segment_sum(log[codes, k], sizes) / total for k in range(log.shape[1])], 1)
        letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        return np.where(letters, entropy.argmin(1), -1), entropy


_OPEN: dict[str, Models] = {}


def _scored(documents: DataFrame, keep: list[str], meta: dict, raw: bool = False) -> DataFrame:
    source = documents.select(*keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches):
        if meta["root"] not in _OPEN:
            _OPEN.clear()
            _OPEN[meta["root"]] = Models(meta)
        model = _OPEN[meta["root"]]
        for batch in slices(batches, "text", 8 << 20):
            best, entropy = model.texts(texts_of(batch.column("text")))
            none = best < 0
            low = entropy.min(1)
            score = np.where(none, 0.0, 1 / np.exp(-(entropy - low[:, None]) * EVIDENCE).sum(1))
            name = pa.array(np.array([*meta["langs"], "und"], object)[best], pa.string())
            limit = np.array(meta["limit"])[np.maximum(best, 0)]
            columns = [*(batch.column(k) for k in keep), name, pa.array(score), pa.array(low), pa.array(none | (low > limit))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "entropy", "rejected"])

    return source.mapInArrow(run, f"{kept}, lang_pred string, score double, entropy double, rejected boolean")


def identify(documents: DataFrame, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``(id, held_out, lang_pred, score, entropy, rejected)`` for every row."""
    marked = documents.select(F.col(id_col).alias("doc_id"), F.expr(f"coalesce(crc32(cast(cast(`{id_col}` as string) as binary)) % {folds} = {fold}, false)").alias("held_out"), F.col(text_col).alias("text"))
    meta = fit(documents, folds, fold, id_col, text_col, lang_col, sample)
    if meta is None:
        return marked.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected"))
    return _scored(marked, ["doc_id", "held_out"], meta)
