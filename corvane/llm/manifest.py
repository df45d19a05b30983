"""Operator 11: a Merkle manifest of a dataset, proved by descents through a content-addressed DAG.

Every row is a leaf, the digest of its fields. The leaves of a group, in the order of a column, form a tree of runs of two;
the roots of the groups, in the order of the groups, form a tree in the same way, and its root names the whole dataset.

The store holds records ``digest -> children``. ``STRIDE`` levels of records lie in one pack under the digest of their top, so a
descent takes one join for each ``STRIDE`` levels instead of one for each level, and requests below one node share its join. A
leaf's request starts at the root; the digits of its rank (the bits, from the highest) choose a child in each record, and
the children not chosen are collected. The path comes out from the root down; reversed, it is the proof. Equal
subtrees have equal digests and are stored once.

Ranks come from ranges of the order (``operators/ranking.py``), a task handles blocks of 256 nodes, and only counts and the root
come to the driver, so neither a group that holds most rows nor the number of groups matters.

Defined cases: a null field counts as ``-``; rows with equal ids follow each other by their digests, null ids come first; repeated
rows are leaves of their own; a null group is a group, the first one; a group of one row is its own root; an empty table
has no root and no rows; further columns are ignored. Rows without an id are never tampered with.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.ranking import ranked
from corvane.operators.skew import hub_join
from corvane.session import materialise

#: Levels of records in a pack; a pack lies above 2 ** STRIDE nodes at most.
STRIDE = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A record: digest, number of children, two children (the second may be blank). A step of a path: side of the sibling, sibling.
RECORD, STEP, BLANK = 97, 33, bytes(32)
ALONE, LEFT, RIGHT = b"0", b"L", b"R"


def joined(*digests: bytes) -> bytes:
    """The digest of digests, which enter as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def pack(digests: list[bytes], height: int) -> tuple[bytes, bytes]:
    """(digest of the top, records) of ``height`` levels of runs of two above the nodes."""
    records = []
    for _ in range(height):
        runs = [digests[i : i + 2] for i in range(0, len(digests), 2)]
        digests = [joined(*run) for run in runs]
        records += [d + bytes([len(run)]) + run[0] + (run[1] if len(run) > 1 else BLANK) for d, run in zip(digests, runs)]
    return digests[0], b"".join(records)


def opened(records: bytes) -> dict[bytes, list[bytes]]:
    """Digest to children."""
    found = {}
    for at in range(0, len(records), RECORD):
        n = records[at + 32]
        found[records[at : at + 32]] = [records[at + 33 + 32 * k : at + 65 + 32 * k] for k in range(n)]
    return found


def descend(store: dict[bytes, list[bytes]], digest: bytes, digits: int, height: int) -> tuple[bytes, bytes]:
    """(digest reached, steps from the top down): each bit of ``digits`` chooses a child, the other one is collected."""
    steps = []
    for level in range(height - 1, -1, -1):
        children = store[digest]
        chosen = digits >> level & 1
        digest = children[chosen]
        steps.append(ALONE + BLANK if len(children) == 1 else (LEFT if chosen else RIGHT) + children[1 - chosen])
    return digest, b"".join(steps)


def proof(path: bytes) -> list[tuple[bytes, bytes]]:
    """The steps of a path from the leaf up: (side, sibling)."""
    return [(path[at : at + 1], path[at + 1 : at + STEP]) for at in range(len(path) - STEP, -1, -STEP)]


def fold(leaf: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, sibling in steps:
        leaf = joined(leaf) if side == ALONE else joined(sibling, leaf) if side == LEFT else joined(leaf, sibling)
    return leaf


def row_digest(*values: Column) -> Column:
    """The digest of fields: each is ``-`` if null, else its size in bytes, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _height(n: Column, stride: int) -> Column:
    """Levels of a tree of ``n`` leaves that a pack of this stride holds."""
    depth = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(STRIDE), depth - STRIDE * stride)).cast("int")


@dataclass
class Forest:
    """The packs of the trees, stride by stride from the leaves up, and ``(tree, n, digest)`` of every top."""

    packs: list[DataFrame]
    tops: DataFrame


def _forest(blocks: DataFrame) -> Forest:
    """From blocks ``(tree, n, rank, digests)`` of the lowest stride."""

    def packed(batches):
        for batch in batches:
            tops = [pack(d, h) for d, h in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([t[0] for t in tops], pa.binary()), pa.array([t[1] for t in tops], pa.binary())], ["tree", "n", "rank", "height", "digest", "records"])

    packs, stride = [], 0
    while True:
        sized = blocks.select("tree", "n", "rank", _height(F.col("n"), stride).alias("height"), "digests")
        packs.append(materialise(sized.mapInArrow(packed, "tree string, n long, rank long, height int, digest binary, records binary"), "packs"))
        stride += 1
        nodes = packs[-1].select("tree", "n", "rank", "digest")
        if nodes.where("rank > 0").isEmpty():
            return Forest(packs, nodes.select("tree", "n", "digest"))
        blocks = nodes.groupBy("tree", "n", F.shiftright("rank", STRIDE).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("nodes"))
        blocks = blocks.select("tree", "n", F.col("block").alias("rank"), F.col("nodes.digest").alias("digests"))


def _next(forest: Forest, stride: int, at: DataFrame, wanted: DataFrame) -> DataFrame:
    """One pack down: ``at`` has (tree, rank, digest, path, subroot) of nodes, ``wanted`` the (tree, rank) of nodes below them.
    A tree that is lower than this stride has its top here and goes on unchanged."""
    store = forest.packs[stride].where("height > 0").groupBy("digest").agg(F.first("records").alias("records"), F.first("height").alias("height"))
    below = wanted.groupBy("tree", F.shiftright("rank", STRIDE).alias("rank")).agg(F.collect_list("rank").alias("ranks"))
    met = at.join(below, ["tree", "rank"]).join(store, "digest", "left")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                store, mask = opened(r["records"] or b""), (1 << STRIDE) - 1
                for rank in r["ranks"]:
                    digest, steps = descend(store, r["digest"], rank & mask, r["height"] or 0)
                    out.append((r["tree"], rank, digest, r["path"] + steps, r["subroot"]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["tree", "rank", "digest", "path", "subroot"])

    return met.select("tree", "digest", "path", "subroot", "ranks", "records", "height").mapInArrow(run, "tree string, rank long, digest binary, path binary, subroot binary")


def _prefixes(ranks: DataFrame, strides: int) -> list[DataFrame]:
    """The distinct (tree, rank) that requests pass, by stride: at 0 the requests themselves."""
    out = [ranks]
    for _ in range(strides - 1):
        out.append(out[-1].select("tree", F.shiftright("rank", STRIDE).alias("rank")).distinct())
    return out


def prove(documents: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", changed: dict[str, Column] | None = None, tamper: Column | None = None) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)``: builds the manifest of ``documents`` and requests every
    leaf. ``changed`` says which fields get another value in rows where ``tamper`` holds; the roots of these rows are folded from the
    changed leaf and the stored siblings."""
    changed = changed or {}
    kind = documents.schema[order].dataType.simpleString()
    leaf = row_digest(*(F.col(f) for f in fields))
    other = row_digest(*(changed.get(f, F.col(f)) for f in fields))
    rows = documents.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"),
        F.col(order).alias("id"),
        F.unhex(leaf).alias("leaf"),
        (F.when(tamper, F.unhex(other)) if tamper is not None else F.lit(None).cast("binary")).alias("other"),
    )
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = ranked(rows, ["tree"], [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("row")]).withColumn("rank", F.col("rank") - 1)
    blocks = placed.groupBy("tree", F.shiftright("rank", STRIDE).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "leaf", "other"))).alias("members"))
    blocks = materialise(blocks.withColumnRenamed("block", "rank"), "blocks")
    sizes = materialise(blocks.groupBy("tree").agg(F.sum(F.size("members")).alias("n"), F.count("*").alias("count")), "sizes")
    groups = _forest(hub_join(blocks.select("tree", "rank", F.col("members.leaf").alias("digests")), sizes, ["tree"], "count").select("tree", "n", "rank", "digests"))

    # the tree above the groups: their tops in the order of the groups, null first
    tops = ranked(groups.tops.select(F.col("tree").alias("name"), "digest"), [], [F.col("name")]).select("name", "digest", (F.col("rank") - 1).alias("rank"))
    tops = materialise(tops, "subroots")
    several = tops.count()
    upper = tops.groupBy(F.lit("").alias("tree"), F.shiftright("rank", STRIDE).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("nodes"))
    upper = _forest(upper.select("tree", F.lit(several).cast("long").alias("n"), F.col("block").alias("rank"), F.col("nodes.digest").alias("digests")))
    first = upper.tops.first()
    root = bytes(first.digest) if first else b""

    # descents: first to the tops of the groups, then inside them
    at = upper.tops.select("tree", F.lit(0).cast("long").alias("rank"), "digest", F.lit(b"").alias("path"), F.lit(b"").alias("subroot"))
    wanted = _prefixes(tops.select(F.lit("").alias("tree"), "rank"), len(upper.packs))
    for stride in range(len(upper.packs) - 1, -1, -1):
        at = _next(upper, stride, at, wanted[stride])
    at = at.select("rank", "digest", "path").join(tops.select("rank", "name"), "rank")
    at = materialise(at.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("rank"), "digest", "path", F.col("digest").alias("subroot")), "tops")
    strides = len(groups.packs)
    if strides > 1:
        wanted = _prefixes(blocks.select("tree", "rank"), strides - 1)
        for stride in range(strides - 1, 0, -1):
            at = _next(groups, stride, at, wanted[stride - 1])
    store = groups.packs[0].where("height > 0").groupBy("digest").agg(F.first("records").alias("records"), F.first("height").alias("height"))
    met = at.join(store, "digest", "left").join(blocks, ["tree", "rank"])

    def last(batches):
        for batch in batches:
            cells, out = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names) if c != "members"}, []
            members, mask = batch.column(batch.schema.names.index("members")), (1 << STRIDE) - 1
            at, flat = members.offsets.to_pylist(), members.values
            ranks, ids, leaves, others = flat.field("rank").to_pylist(), flat.field("id"), flat.field("leaf").to_pylist(), flat.field("other").to_pylist()
            picks = []
            for i in range(batch.num_rows):
                store = opened(cells["records"][i] or b"")
                for k in range(at[i], at[i + 1]):
                    found, steps = descend(store, cells["digest"][i], ranks[k] & mask, cells["height"][i] or 0)
                    if found != leaves[k]:
                        raise ValueError("a descent ended at another leaf")
                    steps = proof(cells["path"][i] + steps)
                    siblings = hashlib.sha256("".join(s.hex() for side, s in steps if side != ALONE).encode()).hexdigest()
                    folded = fold(leaves[k] if others[k] is None else others[k], steps)
                    picks.append(k)
                    out.append((found.hex(), cells["subroot"][i].hex(), root.hex(), siblings, folded.hex(), folded == root))
            names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(picks, pa.int64())), *(pa.array([o[k] for o in out], pa.string()) for k in range(5)), pa.array([o[5] for o in out], pa.bool_())], ["id", *names, "verified"])

    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return met.select("digest", "path", "subroot", "records", "height", "members").mapInArrow(last, schema).withColumnRenamed("id", order)


def prove_documents(documents: DataFrame) -> DataFrame:
    """The query of the operator: where 7 divides the CRC-32 of the decimal id, ``n_chars`` is one more."""
    tamper = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return prove(documents, changed={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, tamper=tamper)


_TOKENS = " || ".join(f"coalesce(strlen({{{c}}}::VARCHAR) || ':' || {{{c}}}::VARCHAR, '-')" for c in FIELDS)
_PLAIN = _TOKENS.format(**{c: c for c in FIELDS})
_CHANGED = _TOKENS.format(**{c: c for c in FIELDS} | {"n_chars": "(n_chars::HUGEINT + 1)"})
_CRC = "xor(list_reduce([4294967295::BIGINT] || [unicode(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')], lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295::BIGINT)"


def _levels(name: str, base: str) -> str:
    """A recursive table of all nodes of the trees: (g, level, i, d, n)."""
    return f"""{name}(g, level, i, d, n) AS ({base} UNION ALL SELECT g, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, i // 2, n)"""


SQL = f"""WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256({_PLAIN}) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN sha256({_CHANGED}) ELSE sha256({_PLAIN}) END AS other FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS r FROM leaves),
{_levels("low", "SELECT g, 0, i, leaf, n FROM placed")},
subs AS MATERIALIZED (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
{_levels("high", "SELECT '', 0, i, d, n FROM subs")},
steps AS (SELECT p.r, l.level, l.n, p.i >> l.level AS place, l.g, 0 AS part FROM placed p JOIN (SELECT DISTINCT g, level, n FROM low WHERE n > 1) l USING (g)
  UNION ALL SELECT p.r, h.level, h.n, s.i >> h.level, '', 1 FROM placed p JOIN subs s USING (g), (SELECT DISTINCT level, n FROM high WHERE n > 1) h),
sided AS (SELECT s.r, s.part, s.level, s.place, coalesce(l.d, h.d) AS d FROM steps s
  LEFT JOIN low l ON s.part = 0 AND l.g = s.g AND l.level = s.level AND l.i = xor(s.place, 1) LEFT JOIN high h ON s.part = 1 AND h.level = s.level AND h.i = xor(s.place, 1)),
paths AS (SELECT r, list(CASE WHEN d IS NULL THEN '0' WHEN place % 2 = 1 THEN 'L' || d ELSE 'R' || d END ORDER BY part, level) AS path, sha256(coalesce(string_agg(d, '' ORDER BY part, level), '')) AS proof FROM sided GROUP BY r),
folded AS (SELECT p.r, p.doc_id, p.leaf, s.d AS subroot, coalesce(x.proof, sha256('')) AS proof_sha256, (SELECT d FROM high WHERE n = 1) AS root,
  list_reduce([p.other] || coalesce(x.path, []), lambda a, b: sha256(CASE b[1] WHEN 'L' THEN b[2:] || a WHEN 'R' THEN a || b[2:] ELSE a END)) AS folded_root
  FROM placed p JOIN subs s USING (g) LEFT JOIN paths x USING (r))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
