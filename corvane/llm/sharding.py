"""Operator 8: consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring; a key belongs to the next point clockwise. A shard takes at most its
capacity; keys arrive in the order of a second hash, and a key that finds its shard full goes on clockwise to
the next shard with room. Because all shards see one order, the outcome is fixed by one cut-off for each shard:
the arrival at which it became full. The cut-offs come from histograms of the arrivals whose size depends on
the ring only, refined where a shard fills up, so no rows but those of a last small bin reach the driver.

Law ``rows``: capacities are the row count over the shards, rounded down or up, so counts differ by one at most.

Defined cases: null text has size 1 and checksum 0; rows with equal or null ids are placed one by one like any
others; fewer rows than shards leave shards empty; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from corvane.session import materialise

SLOTS, VIRTUAL, STEP, BITS = 4096, 64, 8, 56
#: A bin of at most so many rows is replayed on the driver; larger ones are refined.
REPLAY = 20_000


def ring(shards: int, virtual: int = VIRTUAL, slots: int = SLOTS) -> tuple[list[int], list[list[int]]]:
    """(number of the walk that starts at each slot, the walks: shards in clockwise order)."""
    points = sorted((int.from_bytes(hashlib.md5(f"{s}:{v}".encode()).digest()[:8], "big"), s) for s in range(shards) for v in range(virtual))
    place = [(h * slots >> 64, s) for h, s in points]
    walks, number, at = {}, [], 0
    for slot in range(slots):
        while at < len(place) and place[at][0] < slot:
            at += 1
        walk = tuple(dict.fromkeys(s for _, s in place[at:] + place[:at]))
        number.append(walks.setdefault(walk, len(walks)))
    return number, [list(w) for w in walks]


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _cutoffs(keys: DataFrame, walks: list[list[int]], room: list[int]) -> list[tuple[int, int] | None]:
    """For each shard the first arrival ``(turn, ord)`` that it rejects; None if it never fills."""
    room, cut = list(room), [None] * len(room)

    def take(walk: int, n: int = 1) -> None:
        for s in walks[walk]:
            if cut[s] is None:
                room[s] -= n
                return

    def fits(group) -> bool:
        """Whether all of a bin's arrivals go to their first open shard without filling one up."""
        need = [0] * len(room)
        for walk, n in group.items():
            for s in walks[walk]:
                if cut[s] is None:
                    need[s] += n
                    break
        return all(n < r for n, r in zip(need, room) if n)

    def go(rows: DataFrame, column: str, shift: int) -> None:
        wide = max(shift - STEP, 0)
        bins: dict[int, dict[int, int]] = {}
        for r in rows.groupBy("walk", F.shiftright(column, wide).alias("bin")).count().collect():
            bins.setdefault(r["bin"], {})[r["walk"]] = r["count"]
        for b in sorted(bins):
            if fits(bins[b]):
                for walk, n in bins[b].items():
                    take(walk, n)
                continue
            inside = rows.where(F.shiftright(column, wide) == b)
            if sum(bins[b].values()) <= REPLAY:
                for r in inside.select("turn", "ord", "walk").orderBy("turn", "ord").collect():
                    for s in range(len(room)):
                        if cut[s] is None and room[s] == 0:
                            cut[s] = (r.turn, r.ord)
                    take(r.walk)
            elif wide:
                go(inside, column, wide)
            else:
                go(inside, "ord", 64)  # equal turns: equal ids

    go(keys, "turn", BITS)
    return cut


def shard_rows(documents: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` for every row."""
    spark = documents.sparkSession
    number, walks = ring(shards)
    key = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    digest = key.select(
        "id",
        F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).alias("bytes") + 1,
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.lit("ring"), "id"), F.lit(SLOTS)).cast("int").alias("at"),
        F.shiftrightunsigned(F.xxhash64(F.lit("turn"), "id"), 64 - BITS).alias("turn"),
        F.monotonically_increasing_id().alias("ord"),
    ).toDF("id", "size", "text_crc32", "at", "turn", "ord")
    digest = materialise(digest, "sharding")  # numbers of rows stay the same when a task runs again
    slots = spark.createDataFrame([(i, w, walks[w]) for i, w in enumerate(number)], "at int, walk int, walk_shards array<int>")
    keys = digest.join(F.broadcast(slots), "at")  # SLOTS rows
    rows = digest.count()
    cut = _cutoffs(keys.select("walk", "turn", "ord"), walks, capacities(rows, shards))
    open_ = F.array(*[F.lit(True) if c is None else (F.col("turn") < c[0]) | ((F.col("turn") == c[0]) & (F.col("ord") < c[1])) for c in cut])
    placed = keys.select("id", "size", "text_crc32", "turn", "ord", "walk_shards", open_.alias("open"))
    placed = placed.select("id", "size", "text_crc32", "turn", "ord", F.expr("filter(walk_shards, s -> open[s])[0]").alias("shard"))
    # slots: a running number inside small ranges of turns, behind the rows of earlier ranges
    ranges = max(6, (rows // 4096).bit_length() + 2)
    placed = placed.withColumn("range", F.shiftright("turn", BITS - min(ranges, 40)))
    size = placed.groupBy("shard", "range").count()
    before = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offset = size.select("shard", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("shard", "range").orderBy("turn", "ord"))
    return (
        placed.withColumn("inside", inside)
        .join(offset, ["shard", "range"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
    )
