"""Matched controls without reuse."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from corvane.operators.ranking import ranked, running
from corvane.session import materialise

#: Controls that a candidate's list gets at once. So few controls are ranked in plain windows. Controls of the largest group that a task settles.
FETCH, FEW, GROUP = 16, 100_000, 1_000_000


class _Nearest:
    """The controls of each group of equal ``keys`` in two orders: by rising and by falling value, equal values by ``order``.

    A candidate's nearest controls are the merge of two streams that start at its own value. ``starts`` says where.
    """

    def __init__(self, pool: DataFrame, points: DataFrame, keys: list[str], order: list[str], few: bool):
        self.keys, self.order = keys, order
        pool = pool.withColumn("_pool", F.lit(1))
        own = points.select(*keys, "value").distinct()
        both = pool.select(*keys, "value", *order, "control", "_pool").unionByName(own.withColumn("_pool", F.lit(0)), allowMissingColumns=True)
        rising = [F.col("value"), F.col("_pool"), *map(F.col, order), F.col("control")]
        falling = [F.col("value").desc(), *map(F.col, order), F.col("control")]
        if few:
            up = materialise(both.withColumn("_at", F.sum("_pool").over(W.partitionBy(*keys).orderBy(*rising).rowsBetween(W.unboundedPreceding, 0))), "rising")
            down = materialise(pool.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*falling))), "falling")
        else:
            up = materialise(running(both, keys, rising, {"_at": F.col("_pool")}), "rising")
            down = materialise(ranked(pool, keys, falling, "_at"), "falling")
        size = pool.groupBy(*keys).agg(F.count("*").alias("_size"))
        before = up.where("_pool = 0").select(*keys, "value", F.col("_at").alias("_below"))
        # a candidate whose group has no control is left out
        self.starts = (before.join(size, keys) if keys else before.join(size.where("_size > 0"))).select(*keys, "value", "_below", (F.col("_size") - F.col("_below")).alias("_above"))
        self.sides = [(side, df.select(*keys, "_at", F.col("value").alias("_value"), *order, "control")) for side, df in (("right", up.where("_pool = 1")), ("left", down))]

    def after(self, asks: DataFrame, tag: list[str]) -> DataFrame:
        """The next ``want`` controls of each ask (tag, keys, value, right, left, want) in order, as (tag, pos, control, right, left): the
        place behind the cursors, and the cursors behind the control."""
        at = asks.join(self.starts, [*self.keys, "value"])
        found = None
        for side, rows in self.sides:
            start = F.col("_below") if side == "right" else F.col("_above")
            each = at.select(*tag, *self.keys, "value", "want", F.explode(F.sequence(start + F.col(side) + 1, start + F.col(side) + F.col("want"))).alias("_at"))
            part = each.join(rows, [*self.keys, "_at"]).select(*tag, "want", F.abs(F.col("_value") - F.col("value")).alias("_d"), *self.order, "control", F.lit(int(side == "right")).alias("_right"))
            found = part if found is None else found.unionByName(part)
        w = W.partitionBy(*tag).orderBy("_d", *self.order, "control")
        found = found.withColumn("pos", F.row_number().over(w)).withColumn("right", F.sum("_right").over(w.rowsBetween(W.unboundedPreceding, 0)))
        return found.where("pos <= want").select(*tag, "pos", "control", "right", (F.col("pos") - F.col("right")).alias("left"))


def _chosen(hungry: DataFrame, pool: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """``(c, control)``: what each of the hungry gets of the controls with its ``keys``, in their order: the nearest that no earlier one holds or got.

    A task has a group. Its controls lie in both orders by value; a control that is gone points to the next one in each.
    """
    kind = pool.schema["control"].dataType
    right = pool.join(hungry.select(*keys).distinct(), keys, "left_semi") if keys else pool
    right = right.join(held.select("control", F.col("c").alias("holder")), "control", "left")
    group = [*keys, "_all"]

    def free(after, at):
        while after[at] != at:
            after[at] = after[after[at]]
            at = after[at]
        return at

    def run(key, left, right):
        n, value, turn = right.num_rows, right["value"].to_numpy(), right["_order"].to_numpy()
        orders = [np.lexsort((turn, value)), np.lexsort((turn, -value))]  # rising and falling, equal values by order
        places = [np.argsort(o) for o in orders]
        gone = [list(range(n + 1)), list(range(n + 1))]

        def take(row):
            for place, after in zip(places, gone):
                after[place[row]] = place[row] + 1

        holder = right["holder"]
        kept = np.flatnonzero(holder.is_valid().to_numpy())
        holders = holder.take(pa.array(kept)).to_numpy()
        first = np.argsort(holders, kind="stable")
        kept, holders, h = kept[first], holders[first], 0
        left = left.sort_by("c")
        c, own = left["c"].to_numpy(), left["value"].to_numpy()
        starts = np.searchsorted(value[orders[0]], own, "left"), np.searchsorted(-value[orders[1]], -own, "right")
        got, rows = [], []
        for k in range(len(c)):
            while h < len(kept) and holders[h] < c[k]:  # an earlier one holds it
                take(kept[h])
                h += 1
            best = None
            for order, after, start in zip(orders, gone, starts):
                at = free(after, int(start[k]))
                if at < n:
                    d = abs(value[order[at]] - own[k])
                    this = (float("inf") if d != d else d, turn[order[at]], order[at])
                    best = this if best is None or this < best else best
            if best is not None:
                got.append(c[k])
                rows.append(best[2])
                take(best[2])
        return pa.table({"c": pa.array(got, pa.int64()), "control": right["control"].take(pa.array(rows, pa.int64()))})

    one = lambda df: df.withColumn("_all", F.lit(0)).groupBy(*group)
    return one(hungry.select(*keys, "c", "value")).cogroup(one(right.select(*keys, "control", "value", "_order", "holder"))).applyInArrow(run, f"c long, control {kind.simpleString()}")


def matched_controls(candidates: DataFrame, pool: DataFrame, match: list[str], order: list[str], per: int = 1, fetch: int = FETCH) -> DataFrame:
    """``(candidate, control, match_rank)``: candidates in the order of ``turn`` take their ``per`` nearest free controls.

    A control is nearer than another by, in this order: the first column of ``match`` equal to the candidate's, its own flag ``low``,
    the other columns of ``match`` equal, the distance of ``value``, the columns of ``order``, its id. ``candidates`` has candidate, turn (a
    unique whole number), ``match`` and value; ``pool`` has control, ``match``, low, value and ``order``. Controls run out only with the
    pool; then the last candidates get fewer.

    First come, first served equals deferred acceptance with controls that prefer earlier candidates: a candidate proposes to its
    next control, a control keeps its earliest suitor, until nobody moves. Groups of equal columns of up to ``GROUP`` controls are settled each in
    a task: all their candidates without a control propose in their order at once. Where groups are larger, lists are fetched when they are needed,
    ``fetch`` controls at a time, from orders by value inside the groups. The wider groups (another label, another
    family) come up only if a candidate comes to them. Of candidates alike in all columns the n-th starts at the n-th
    control, since the earlier ones leave it nothing better.
    """
    spark = candidates.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pool = materialise(pool.select("control", *(text(c).alias(c) for c in match), F.coalesce("low", F.lit(False)).alias("low"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), *order), "pool")
    people = candidates.select("candidate", F.explode(F.sequence(F.lit(1), F.lit(per))).alias("match_rank"), F.col("turn").cast("long").alias("turn"), *(text(c).alias(c) for c in match), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    people = materialise(people.withColumn("c", F.col("turn") * per + F.col("match_rank")), "candidates")
    tiers = [dict(zip([match[0], "low", *match[1:]], bits)) for bits in product((True, False), repeat=len(match) + 1)]
    indexes: dict[tuple, _Nearest | None] = {}
    few = pool.count() <= FEW
    turns = pool.select("control", F.row_number().over(W.orderBy(*order, "control")).alias("_order")) if few else ranked(pool.select(*order, "control"), [], [*map(F.col, order), F.col("control")], "_order").select("control", F.col("_order").cast("long").alias("_order"))
    placed = materialise(pool.join(turns, "control").select("control", *match, "low", "value", F.col("_order").cast("long").alias("_order")), "placed")
    state = people.select("c", *match, "value", F.lit(0).alias("tier"), F.lit(0).cast("long").alias("right"), F.lit(0).cast("long").alias("left"))
    state = materialise(state, "cursors")
    held = spark.createDataFrame([], f"c long, control {pool.schema['control'].dataType.simpleString()}, pos long")
    lists, turn = spark.createDataFrame([], held.schema), 0
    while True:
        hungry = materialise(state.where(F.col("tier") < len(tiers)).join(held.select("c"), "c", "left_anti"), "hungry")
        levels = sorted(r.tier for r in hungry.select("tier").distinct().collect())  # fewer than there are tiers
        if not levels:
            break
        own = None
        for tier in levels:
            bits = tiers[tier]
            keys, other = [c for c in match if bits[c]], [c for c in match if not bits[c]]
            name = (bits["low"], *keys)
            of = placed.where(F.col("low") == bits["low"])
            if name not in indexes:
                largest = of.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
                indexes[name] = None if largest <= GROUP else _Nearest(pool.where(F.col("low") == bits["low"]), people, keys, order, few)
            if indexes[name] is None:
                part = _chosen(hungry.where(F.col("tier") == tier), of, held, keys).select("c", "control", F.lit(1).cast("long").alias("pos"), *(F.lit(0).cast("long").alias(x) for x in ("right", "left")), F.lit(True).alias("ok"))
                own = part if own is None else own.unionByName(part)
                continue
            like = [*match, "value", "right", "left"]
            now = hungry.where(F.col("tier") == tier).withColumn("n", F.row_number().over(W.partitionBy(*like).orderBy("c")))  # among candidates alike in all columns
            kinds = now.groupBy(*like).agg((F.max("n") + fetch - 1).alias("want"), F.min("c").alias("kind"))
            near = indexes[name].after(kinds.select("kind", *keys, "value", "right", "left", "want"), ["kind"])
            part = now.join(kinds.select("kind", *like), like).select("c", "kind", "n", *other).join(near, "kind").where((F.col("pos") >= F.col("n")) & (F.col("pos") < F.col("n") + fetch))
            ok = F.lit(True)  # controls of a better tier come up again among wider groups
            if other:
                part = part.join(pool.select("control", *(F.col(c).alias(f"_{c}") for c in other)), "control")
                for c in other:
                    ok = ok & (F.col(c) != F.col(f"_{c}"))
            part = part.select("c", "control", "pos", "right", "left", ok.alias("ok"))
            own = part if own is None else own.unionByName(part)
        own = materialise(own, "fetched")
        ends = own.groupBy("c").agg(F.max("right").alias("r"), F.max("left").alias("l"))
        after, done = hungry.join(ends, "c", "left"), F.col("r").isNull()  # nothing left in the tier
        after = after.select("c", *match, "value", (F.col("tier") + done.cast("int")).alias("tier"), F.when(done, 0).otherwise(F.col("right") + F.col("r")).cast("long").alias("right"), F.when(done, 0).otherwise(F.col("left") + F.col("l")).cast("long").alias("left"))
        state = materialise(state.join(hungry.select("c"), "c", "left_anti").unionByName(after), "cursors")
        new = own.where("ok").select("c", "control", (F.col("pos") + (turn << 40)).alias("pos"))
        lists, turn = lists.unionByName(new), turn + 1
        held = _proposed(held, lists, new.groupBy("c").agg(F.min("pos").alias("pos")))
    return held.join(people.select("c", "candidate", "match_rank"), "c").select("candidate", "control", "match_rank")


def _proposed(held: DataFrame, lists: DataFrame, at: DataFrame) -> DataFrame:
    """The pairs (c, control, pos) after all have proposed down their lists from ``at``, or hold a control. Who loses a control goes on
    behind it; who comes to the end of a list waits for the next one. Up to ``FEW`` entries are settled in one task."""
    if lists.limit(FEW + 1).count() <= FEW:
        return materialise(_settled(held, lists), "matching")
    while True:
        suit = at.join(lists, ["c", "pos"]).select("c", "control", "pos")
        both = held.unionByName(suit).withColumn("lost", F.col("c") > F.min("c").over(W.partitionBy("control")))
        behind = lists.select("c", F.col("pos").alias("p")).join(both.where("lost").select("c", "pos"), "c").where("p > pos").groupBy("c").agg(F.min("p").alias("next"))
        both = materialise(both.join(behind, "c", "left"), "matching")
        held, at = both.where("not lost").select("c", "control", "pos"), both.where("lost and next is not null").select("c", F.col("next").alias("pos"))
        if at.isEmpty():
            return held


def _settled(held: DataFrame, lists: DataFrame) -> DataFrame:
    """As ``_proposed`` for few entries."""
    kind = held.schema["control"].dataType

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        holds = {r["control"]: (r["c"], r["pos"]) for r in rows if r["held"]}
        own: dict[int, list] = {}
        for r in rows:
            if not r["held"]:
                own.setdefault(r["c"], []).append((r["pos"], r["control"]))
        at = {c: -1 for c in own} | dict(holds.values())
        free = sorted(own.keys() - {c for c, _ in holds.values()}, reverse=True)
        own = {c: sorted(x, reverse=True) for c, x in own.items()}
        while free:
            c = free.pop()
            while own.get(c):
                pos, control = own[c].pop()
                if pos <= at[c] or control in holds and holds[control][0] < c:
                    continue
                if control in holds:
                    free.append(holds[control][0])
                holds[control] = (c, pos)
                break
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in holds.values()], pa.int64()), pa.array(list(holds), to_arrow_type(kind)), pa.array([x[1] for x in holds.values()], pa.int64())], ["c", "control", "pos"])

    both = held.withColumn("held", F.lit(True)).unionByName(lists.select("c", "control", "pos").withColumn("held", F.lit(False)))
    return both.coalesce(1).mapInArrow(run, f"c long, control {kind.simpleString()}, pos long")
