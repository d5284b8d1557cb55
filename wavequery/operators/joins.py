"""Joins against a side that is usually, but not always, small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 * 1024**2


def join_checked(
    rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", limit: int | None = None
) -> DataFrame:
    """Join ``rows`` with a per-key table without shuffling ``rows`` when that table is small.

    At most ``limit + 1`` rows of the table are fetched; pass a low limit for wide rows. If
    rows and bytes fit, those rows are broadcast, so a key that holds most of ``rows``
    costs nothing extra. If not, this is a shuffle join, whose skewed partitions
    adaptive execution splits.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    found = small.limit(limit + 1).toArrow()
    if found.num_rows > limit or found.nbytes > BROADCAST_BYTES:
        return rows.join(small, list(keys), how)
    held = rows.sparkSession.createDataFrame(found, small.schema)
    return rows.join(F.broadcast(held), list(keys), how)
