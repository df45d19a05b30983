"""Operator 12: a license scan by ordered signature rules.

Several hundred regular expressions (``license_rules``) name licenses, their versions, sentences, addresses and tags. One pass of a
keyword automaton over a text finds the longest word of each rule's key; a rule runs only where all words of its key
occur, so a plain text runs none. Detections that overlap are resolved by interval containment: where one interval contains
another, the one of lower priority goes; of equal priority the inner one goes, and of equal intervals the later rule. Every detection is
held against all others, kept or not, by running maxima and minima over the sorted ends, so thousands of detections
in one text take no square of time.

Beside the rules the base phrases are found: places where their words stand one after another, whatever lies between. Their
labels always stay.

One scan of the table, no shuffle; a batch holds about 8 MB of text. Texts are matched whole.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows and null ids are reported row by row; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.license_rules import TRUST, Rule, written
from corvane.llm.words import raw, slices, texts_of

#: The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Trust in a base phrase.
PHRASE_TRUST = 0.8
#: Bytes of words after lower-casing; the bytes of characters beyond ASCII are all of them.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Phrase:
    """One base phrase over lower-case bytes."""

    def __init__(self, words: str, label: str):
        first, *rest = words.encode().split()
        self.label, self.first = label, first
        self.pattern = re.compile(first + b"".join(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+" + w for w in rest) + rb"(?![0-9a-z\x80-\xff])")
        self.needed = [first, *rest]

    def places(self, text: bytes) -> list[int]:
        if not all(w in text for w in self.needed):
            return []
        return [m.start() for m in self.pattern.finditer(text) if not m.start() or not WORD[text[m.start() - 1]]]


class Detector:
    """The rules behind their keyword prefilter."""

    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.rules, self.by_anchor = rules, {}
        for number, rule in enumerate(rules):
            self.by_anchor.setdefault(max(rule.key, key=len), []).append(number)
        self.automaton = ahocorasick.Automaton()
        for anchor in self.by_anchor:
            self.automaton.add_word(anchor, anchor)
        self.automaton.make_automaton()

    def live(self, text: bytes) -> list[int]:
        """The rules all of whose key words occur."""
        anchors = {a for _, a in self.automaton.iter(text.decode("latin-1"))}
        found: dict[str, bool] = dict.fromkeys(anchors, True)

        def has(word: str) -> bool:
            if word not in found:
                found[word] = word.encode() in text
            return found[word]

        return sorted(n for a in anchors for n in self.by_anchor[a] if all(map(has, self.rules[n].key)))

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes."""
        return [(n, m.start(), m.end()) for n in self.live(text) for m in self.rules[n].pattern.finditer(text)]


def unsuppressed(found: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Which of the detections (priority, rule, start, end) stay."""
    if not found:
        return np.zeros(0, bool)
    priority, rule, start, end = np.array(found, np.int64).T
    keep = np.ones(len(priority), bool)
    for p in np.unique(priority):
        own, above = np.flatnonzero(priority == p), np.flatnonzero(priority > p)
        if len(above):
            order = above[np.argsort(start[above], kind="stable")]
            starts, ends = start[order], end[order]
            furthest, nearest = np.maximum.accumulate(ends), np.minimum.accumulate(ends[::-1])[::-1]
            upto, since = np.searchsorted(starts, start[own], side="right"), np.searchsorted(starts, start[own])
            inside = (upto > 0) & (furthest[np.maximum(upto - 1, 0)] >= end[own])
            around = (since < len(starts)) & (nearest[np.minimum(since, len(starts) - 1)] <= end[own])
            keep[own[inside | around]] = False
        order = own[np.lexsort((rule[own], -end[own], start[own]))]
        before = np.maximum.accumulate(end[order])[:-1]
        keep[order[1:][before >= end[order][1:]]] = False
    return keep


_DETECTOR: list[Detector] = []


def detector() -> Detector:
    if not _DETECTOR:
        _DETECTOR.append(Detector(written()))
    return _DETECTOR[0]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a word starts at each byte of lower-case texts laid one behind another."""
    word = WORD[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = word[inner]
    return begins


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, label, priority, rule, start, end, kept)``: every detection of every text; places count code points, the end is
    exclusive, and ``rule`` is a rule's number in the order of writing."""
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        tool = detector()
        for batch in slices(batches, "text", 8 << 20):
            offsets, data = raw(texts_of(batch.column(1)))
            low, rows, out = LOWER[data].tobytes(), [], []
            for i in range(batch.num_rows):
                text = low[offsets[i] : offsets[i + 1]]
                found = tool.matches(text)
                if found:
                    keep = unsuppressed([(tool.rules[n].priority, n, a, b) for n, a, b in found])
                    points = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
                    rows += [i] * len(found)
                    out += [(tool.rules[n].label, tool.rules[n].priority, n, int(points[a]), int(points[b]), bool(k)) for (n, a, b), k in zip(found, keep)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], ["id", "label", "priority", "rule", "start", "end", "kept"])

    return source.mapInArrow(run, f"id {kind}, label string, priority int, rule int, start long, end long, kept boolean").withColumnRenamed("id", id_col)


def report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row. The score is the highest trust
    in a label that stays."""
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        tool, phrases = detector(), [Phrase(*p) for p in PHRASES]
        for batch in slices(batches, "text", 8 << 20):
            offsets, data = raw(texts_of(batch.column(1)))
            data = LOWER[data]
            low, count = data.tobytes(), np.append(0, np.cumsum(word_starts(data, offsets)))
            out = []
            for i in range(batch.num_rows):
                text = low[offsets[i] : offsets[i + 1]]
                base = {p.label: p.places(text) for p in phrases}
                places = [int(count[offsets[i] + at] - count[offsets[i]]) for at in sorted(x for found in base.values() for x in found)]
                own = {label for label, found in base.items() if found}
                found = tool.matches(text)
                kept = [tool.rules[n] for (n, _, _), k in zip(found, unsuppressed([(tool.rules[n].priority, n, a, b) for n, a, b in found])) if k]
                score = max([PHRASE_TRUST * bool(own), *(TRUST[r.priority] for r in kept)])
                out.append((len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(own)), ",".join(sorted(own | {r.label for r in kept})), float(score)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count[offsets[1:]] - count[offsets[:-1]], pa.int64()), *columns], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
