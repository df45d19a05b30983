"""Joins whose keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import shuffle_width


def hub_join(rows: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join with a table of one row for each key, whose column ``count`` says how many rows have the key.

    Keys with more than twice a task's share of the rows are fewer than the tasks. Their hashes come to the driver; rows with one of them meet
    the broadcast part of ``right`` and stay where they are, all others meet by a shuffle. ``count`` is dropped. ``right`` should be a written table.
    """
    width = shuffle_width(rows.sparkSession)
    most = 2 * (right.agg(F.sum(count)).first()[0] or 0) // width + 1
    name = lambda: F.xxhash64(*(F.col(k).cast(right.schema[k].dataType) for k in keys))
    found = [r[0] for r in right.where(F.col(count) > most).select(name()).collect()]  # fewer than ``width``
    if not found:
        return rows.join(right.drop(count), keys)
    hub = name().isin(found)  # a filter on both sides; another key of the same hash is broadcast too, which changes no row
    right = right.drop(count)
    return rows.where(hub).join(F.broadcast(right.where(hub)), keys).unionByName(rows.where(~hub).join(right.where(~hub), keys))
