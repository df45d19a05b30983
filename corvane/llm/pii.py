"""Operator 3: personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the matches of four strict patterns (addresses, IP numbers, card numbers that pass Luhn, phone numbers), with
code-point spans, and key-like strings: 24 or more letters and digits between quotes. Each seed
and each other identifier-like string (a token of six or more characters with a digit or ``@``, a quoted string with a digit, a
run of 7 to 19 digits with single spaces, dots, dashes and parentheses, an address with (at) or [at]) is an instance with
lexical patterns: the one, two and three chunks of text before it, the two after it, and the one before with the one after; a
pattern without any letter says nothing and is left out.
Distinct pattern-value pairs form a graph, in which a value that is a seed somewhere counts as one everywhere. A
pattern's score for a kind is the mean score of its values, smoothed by one; an unseen value takes the best score among
its patterns with enough different seeds; both are recomputed ``ROUNDS`` times. Unseen tokens in patterns that score at
least ``CONFIDENT`` and have the loose form of the kind become further spans, the outermost where one holds another. The
spans of the four strict patterns stay as they are; found spans come in addition, with one of the four kinds or ``secret``.
A key-like string is no span by itself: it becomes one only where a confident pattern of secrets marks it, as unseen ones do.

Patterns are summed over distinct values with map-side partial sums, so a frequent context costs a row a task.

Defined cases: a null text is empty and has no spans; rows are told apart by position, so equal or null ids do no harm;
repeated values count once for a pattern; an empty table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import free_name, keyed, materialise

KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of spans; the last one is the method's own.
NAMES = (*KINDS, "secret")
#: Equal to the plain patterns in what they match; look-behinds and possessive repeats only spare vain attempts.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Strings between quotes, and what a seed of secrets looks like among them.
QUOTED = r"(?<=[\"'])(?=[A-Za-z+/_=.-]*+[0-9])[A-Za-z0-9+/_=.-]{8,}+(?=[\"'])"
KEY = "v rlike '^[A-Za-z0-9+/_=-]{24,}$' and v rlike '[A-Za-z]' and length(regexp_replace(v, '[^0-9]', '')) >= 5"
NEEDS = {"email": "contains(text, '@')", "ip": "text rlike '[0-9]'", "card": "text rlike '[0-9]'", "phone": "contains(text, '+')"}
_ZERO_FREE = "trim(LEADING '0' FROM x)"
_DIGITS = "regexp_replace(m.v, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": f"forall(split(m.v, '[.]'), x -> length({_ZERO_FREE}) <= 3 and coalesce(try_cast({_ZERO_FREE} as int), 0) <= 255)",
    "card": f"aggregate(sequence(1, length({_DIGITS})), 0, (t, i) -> t + case when i % 2 = 1 then int(substring({_DIGITS}, -i, 1)) when int(substring({_DIGITS}, -i, 1)) > 4 then 2 * int(substring({_DIGITS}, -i, 1)) - 9 else 2 * int(substring({_DIGITS}, -i, 1)) end) % 10 = 0",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
IDENTIFIER = r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]{6,}+"
#: Runs of 7 to 19 digits with single spaces, dots, dashes and parentheses, and addresses with (at) or [at].
_STEP = r"(?:\)?[\x20.-]?(?:\((?=[0-9]{1,5}\)))?[0-9])"
RUN = r"(?<![A-Za-z0-9@._%+#-])\+?(?:\((?=[0-9]{1,5}\)))?[0-9]" + _STEP + r"{6,18}(?![A-Za-z0-9@_%])"
AT = r"(?<![A-Za-z0-9@._%+#-])[A-Za-z0-9._%+-]++\x20?[(\[][Aa][Tt][)\]]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: The first 7 to 15 digits of a longer run, cut where a group of digits ends.
SHORT = r"^\+?(?:\((?=[0-9]{1,5}\)))?[0-9]" + _STEP + r"{6,14}(?![0-9])"
LOOSE = {"email": "v rlike '^[^@]+(@|[(\\\\[]at[)\\\\]]).+'", "ip": "v rlike '^[0-9]+([.-][0-9]+){3}$'", "card": "length(regexp_replace(v, '[^0-9]', '')) between 12 and 19", "phone": "v rlike '^[+0-9 ().-]+$' and length(regexp_replace(v, '[^0-9]', '')) between 7 and 15", "secret": "length(v) >= 12 and v rlike '[a-z]' and v rlike '[0-9]' and not contains(v, '@')"}
SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
SECRET, OPEN = len(KINDS), -1
ROUNDS, SUPPORT, CONFIDENT = 3, 5, 0.8
#: Matches whose places are summed in one go, so that a text with many matches costs little more than their number.
BLOCK = 256
#: So many texts with found spans at most are broadcast to the masking scan; more are joined by a shuffle.
FEW = 200_000


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _found(pattern: str, kind: int, need: str, text: str = "text") -> str:
    """SQL for the spans of a pattern's matches: the pieces between matches give the places."""
    p = _quoted(pattern)
    pieces, matches = f"split({text}, '{p}', -1)", f"regexp_extract_all({text}, '{p}', 0)"
    step = f"""named_struct('at', a.at + length(x.p) + length(x.m), 'out', array_append(a.out,
        named_struct('s', a.at + length(x.p), 'k', {kind}, 'e', a.at + length(x.p) + length(x.m), 'v', x.m)))"""
    zipped = f"zip_with(slice({pieces}, 1, size({matches})), {matches}, (p, m) -> named_struct('p', p, 'm', m))"
    none = f"cast(array() as {SPAN})"
    blocks = f"transform(sequence(0, cast((size(z) - 1) div {BLOCK} as int)), i -> slice(z, i * {BLOCK} + 1, {BLOCK}))"
    starts = f"aggregate({blocks}, array(0), (t, b) -> array_append(t, element_at(t, -1) + aggregate(b, 0, (n, x) -> n + length(x.p) + length(x.m))))"
    spans = f"flatten(zip_with({blocks}, {starts}, (b, w) -> if(b is null, {none}, aggregate(b, named_struct('at', w, 'out', {none}), (a, x) -> {step}, a -> a.out))))"
    return f"case when {need} then element_at(transform(array({zipped}), z -> if(size(z) = 0, {none}, {spans})), 1) else {none} end"


def base_spans(documents: DataFrame) -> DataFrame:
    """Adds ``base``, the spans of the four strict patterns in order of start and kind. Needs a non-null ``text``."""
    out = documents
    for k, kind in enumerate(KINDS):
        out = out.withColumn(f"all_{kind}", F.expr(_found(STRICT[kind], k, NEEDS[kind])))
    parts = ", ".join(f"filter(all_{kind}, m -> {VALID[kind]})" for kind in KINDS)
    return out.withColumn("base", F.expr(f"array_sort(concat({parts}))")).drop(*(f"all_{k}" for k in KINDS))


def _patterns(each: DataFrame) -> DataFrame:
    before = [f"regexp_extract(left, '({pattern}\\\\s*)$', 1)" for pattern in ("\\\\S+", "\\\\S+\\\\s+\\\\S+", "\\\\S+\\\\s+\\\\S+\\\\s+\\\\S+")]
    after = [f"regexp_extract(right, '^({pattern})', 1)" for pattern in ("\\\\s*\\\\S+\\\\s+\\\\S+", "\\\\s*\\\\S+")]
    both = f"if({before[0]} = '' or {after[1]} = '', '', concat({before[0]}, '\u2026', {after[1]}))"
    chunks = f"array({', '.join(before)}, if({after[0]} = '', '', concat('\u2026', {after[0]})), {both})"
    norm = f"array_distinct(filter(transform({chunks}, c -> regexp_replace(c, '\\\\s+', ' ')), c -> c rlike '\\\\p{{L}}'))"
    return each.select("row", "s", "e", "v", "k", F.explode(F.expr(norm)).alias("pattern"))


def _discover(each: DataFrame) -> DataFrame:
    """``(row, s, e, k, v)`` of strings that confident patterns mark, strict spans left out."""
    seen = _patterns(each)
    graph = materialise(seen.select("pattern", "v", "k").distinct(), "pattern-graph")
    known = graph.where("k >= 0").groupBy("v").agg(F.min("k").alias("seed"))
    graph = graph.join(known, "v", "left").select("pattern", "v", F.greatest("k", F.coalesce("seed", F.lit(-1))).alias("k")).distinct()
    useful = graph.where("k >= 0").groupBy("pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SUPPORT).select("pattern")
    graph = materialise(graph.join(useful, "pattern", "left_semi"), "useful-graph")
    size = graph.groupBy("pattern").agg(F.count_distinct("v").alias("n"))
    score = graph.where("k >= 0").select("pattern", "v", F.col("k").alias("kind"), F.lit(1.0).alias("p"))
    open_ = graph.where("k < 0").select("pattern", "v")
    rated = None
    for _ in range(ROUNDS):
        rated = score.groupBy("pattern", "kind").agg(F.sum("p").alias("p"), F.count_if(F.col("p") == 1.0).alias("seeds")).join(size, "pattern")
        rated = materialise(rated.select("pattern", "kind", "seeds", (F.col("p") / (F.col("n") + 1)).alias("rate")), "patterns")
        best = open_.join(rated.where(F.col("seeds") >= SUPPORT), "pattern").groupBy("v", "kind").agg(F.max("rate").alias("p"))
        spread = open_.join(best, "v").select("pattern", "v", "kind", F.least("p", F.lit(0.99)).alias("p"))
        score = materialise(graph.where("k >= 0").select("pattern", "v", F.col("k").alias("kind"), F.lit(1.0).alias("p")).union(spread), "scores")
    sure = rated.where((F.col("rate") >= CONFIDENT) & (F.col("seeds") >= SUPPORT)).select("pattern", "kind")
    form = F.expr("case kind " + " ".join(f"when {k} then {LOOSE[kind]}" for k, kind in enumerate(NAMES)) + " else false end")
    digits = "length(regexp_replace(v, '[^0-9]', ''))"
    cut = F.expr(f"case when kind = {KINDS.index('phone')} and v rlike '^[+0-9 ().-]+$' and {digits} > 15 then regexp_extract(v, '{_quoted(SHORT)}', 0) else v end")
    hits = seen.where(F.col("k").isin(OPEN, SECRET)).join(sure, "pattern").where((F.col("k") == OPEN) | (F.col("kind") == SECRET)).withColumn("v", cut).withColumn("e", F.col("s") + F.char_length("v")).where(form)
    return hits.groupBy("row", "s", "e").agg(F.min("kind").alias("k"), F.first("v").alias("v"))


def _text_of(spans: str) -> str:
    return f"concat_ws(',', transform({spans}, x -> concat(element_at(array({', '.join(repr(k) for k in NAMES)}), x.k + 1), ':', x.s, ':', x.e)))"


#: The text with the strict spans blotted out.
_BARE = """aggregate(base, named_struct('at', 0, 'out', ''), (a, x) -> case when x.s < a.at
    then named_struct('at', greatest(a.at, x.e), 'out', concat(a.out, repeat('#', greatest(x.e - a.at, 0))))
    else named_struct('at', x.e, 'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), repeat('#', x.e - x.s))) end,
    a -> if(a.at = 0, text, concat(a.out, substring(text, a.at + 1))))"""
#: Found spans that lie in no other one.
_OUTER = """aggregate(array_sort(new), named_struct('at', 0, 'out', cast(array() as array<struct<s:int,k:int,e:int>>)), (a, x) -> case when -x.e <= a.at
    then a else named_struct('at', -x.e, 'out', array_append(a.out, named_struct('s', x.s, 'k', x.k, 'e', -x.e))) end, a -> a.out)"""


_ARRAY = "array<struct<s:int,k:int,e:int>>"
_BRIEF = lambda c: F.expr(f"transform({c}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))")


def _spans(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (row, id, text): the written table (row, id, base), and (row, new) of the rows with found spans."""
    rows = base_spans(rows)
    rows = rows.withColumn("bare", F.expr(_BARE))
    quoted = _found(QUOTED, OPEN, "text rlike '[\"\\'][^\\\\s]{8}'")
    loose = [_found(IDENTIFIER, OPEN, "text rlike '[0-9@]'"), _found(RUN, OPEN, "bare rlike '[0-9]'", "bare"), _found(AT, OPEN, "bare rlike '[(\\\\[][Aa][Tt][)\\\\]]'", "bare")]
    rows = rows.withColumn("quoted", F.expr(quoted))
    seeds = f"transform(quoted, m -> named_struct('s', m.s, 'k', if({KEY.replace('v ', 'm.v ').replace('(v,', '(m.v,')}, {SECRET}, {OPEN}), 'e', m.e, 'v', m.v))"
    more = rows.withColumn("more", F.expr(f"array_distinct(concat({seeds}, {', '.join(loose)}))")).drop("bare", "quoted")
    free = "filter(more, m -> not exists(base, b -> b.s < m.e and m.s < b.e))"
    sides = "lower(substring(text, greatest(x.s - 39, 1), least(x.s, 40))), 'right', lower(substring(text, x.e + 1, 40))"
    each = more.withColumn("each", F.expr(f"transform(concat(base, {free}), x -> named_struct('s', x.s, 'e', x.e, 'v', lower(x.v), 'k', x.k, 'left', {sides}))"))
    found = materialise(each.select("row", "id", _BRIEF("base").alias("base"), "each"), "pii")
    new = _discover(found.select("row", F.explode("each").alias("x")).select("row", "x.*"))
    new = new.groupBy("row").agg(F.collect_list(F.struct("s", (-F.col("e")).alias("e"), "k")).alias("new"))
    return found, new.select("row", F.expr(_OUTER).alias("new"))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, spans)`` of every row; spans are in order of start and kind."""
    found, new = _spans(documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    out = found.select("row", "id", "base").join(new, "row", "left")
    return out.select("id", "base", F.expr(f"array_sort(concat(base, coalesce(new, cast(array() as {_ARRAY}))))").alias("spans"))


def report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row; the counts are of the strict spans."""
    count = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return scan(documents, id_col, text_col).select(F.col("id").alias(id_col), *count, F.sha2(F.expr(_text_of("base")), 256).alias("base_sha256"), F.expr(_text_of("spans")).alias("spans"))


def mask(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in square brackets; overlapping spans become the first one's.

    Strict spans are found again in the scan that masks; only the rows with found spans are joined to it, by position.
    """
    row = free_name("row", documents)
    rows = keyed(documents, row)
    _, new = _spans(rows.select(F.col(row).alias("row"), F.lit(None).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    new = materialise(new, "found")
    own = [f"column{k}" for k in range(len(documents.columns))]
    place = [c.lower() for c in documents.columns].index(text_col.lower())
    safe = rows.toDF(*own, "row").withColumn("text", F.coalesce(F.col(own[place]), F.lit("")))
    joined = base_spans(safe).join(F.broadcast(new) if new.count() <= FEW else new, "row", "left")
    joined = joined.withColumn("spans", F.concat(_BRIEF("base"), F.expr(f"coalesce(new, cast(array() as {_ARRAY}))")))
    step = f"""case when x.s < a.at then named_struct('at', greatest(a.at, x.e), 'out', a.out)
        else named_struct('at', x.e, 'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), '[', upper(element_at(array({", ".join(repr(k) for k in NAMES)}), x.k + 1)), ']')) end"""
    masked = F.expr(f"aggregate(array_sort(spans), named_struct('at', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring(text, a.at + 1)))")
    joined = joined.withColumn(own[place], F.when(F.size("spans") > 0, masked).otherwise(F.col(own[place])))
    return joined.select(*own).toDF(*documents.columns)
