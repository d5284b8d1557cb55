"""Order statistics over a seeded hash, without sorting or moving the rows.

The n-th smallest ``(unit, key)`` is found by counting rows in equal hash ranges and
narrowing the range that holds it. Callers then keep or label rows by comparing
with that cut, which needs no shuffle.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 1024
SORT_LIMIT = 20_000


def nth_smallest(rows: DataFrame, unit: str, key: str, n: int) -> tuple[float, Any] | None:
    """``(unit, key)`` of the n-th smallest row, ``unit`` uniform on [0, 1).

    Returns None when there are fewer than ``n`` rows. At most ``FANOUT`` counts or one
    row reach the driver per step.
    """
    if n < 1:
        raise ValueError("n starts at 1")
    low, width, rank = 0.0, 1.0, n
    inside = rows.select(unit, key)
    while True:
        step = width / FANOUT
        slot = F.least(F.floor((F.col(unit) - low) / step), F.lit(FANOUT - 1)).cast("int")
        counts = {r["slot"]: r["count"] for r in inside.groupBy(slot.alias("slot")).count().collect()}
        if sum(counts.values()) < rank:
            return None
        for found in sorted(counts):
            if counts[found] >= rank:
                break
            rank -= counts[found]
        inside = inside.where(slot == found)
        if counts[found] <= SORT_LIMIT or step < 1e-15:
            first = inside.orderBy(unit, key).limit(rank)
            row = first.agg(F.max(F.struct(unit, key)).alias("m")).first()["m"]
            return row[0], row[1]
        low, width = low + found * step, step


def upto(unit: str, key: str, cut: tuple[float, Any] | None) -> Column:
    """True for rows not after ``cut``; a missing cut accepts every row."""
    if cut is None:
        return F.lit(True)
    value, tie = cut
    return (F.col(unit) < F.lit(value)) | ((F.col(unit) == F.lit(value)) & (F.col(key) <= F.lit(tie)))


def first_n(rows: DataFrame, unit: str, key: str, n: int) -> Column:
    """Condition that holds for the ``n`` rows with the smallest ``(unit, key)``."""
    return F.lit(False) if n < 1 else upto(unit, key, nth_smallest(rows, unit, key, n))
