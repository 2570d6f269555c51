"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than a 500th of all rows is hot, so there are fewer than 500 hot keys.
HOT = 500


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row per key and its number of ``rows`` in ``count``.

    Keys with more than ``total`` / HOT rows are fewer than HOT, whatever the data, so they are
    broadcast and their rows stay where they are; the others are shuffled. ``total`` is at least
    the sum of all counts.
    """
    least = max(total // HOT, 1)
    hot = keyed.where(F.col(count) > least)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(count) <= least), on)
    return near.unionByName(far)
