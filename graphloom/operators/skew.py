"""Joins that no hot key can pull into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than this share of all rows, so at most 1 / HOT keys are.
HOT = 0.001


def join_unique(rows: DataFrame, unique: DataFrame, on: list[str], total: int | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined to a table with one row per key (no null keys), whatever the keys' frequencies.

    Keys with more than ``HOT`` of all rows are at most 1 / HOT; their part of ``unique`` is
    broadcast. All others are shuffled. ``rows`` is read twice, so it should be materialised.
    """
    total = rows.count() if total is None else total
    often = rows.groupBy(*on).count().filter(F.col("count") > max(1000, HOT * total)).select(*on)  # at most 1 / HOT rows
    hot = F.broadcast(unique.join(F.broadcast(often), on, "left_semi"))
    first = rows.join(hot, on)
    rest = rows.join(F.broadcast(often), on, "left_anti").join(unique, on, how)
    if how == "left":  # hot keys without a partner
        rest = rest.unionByName(rows.join(F.broadcast(often), on, "left_semi").join(hot, on, "left_anti"), allowMissingColumns=True)
    return first.unionByName(rest)
