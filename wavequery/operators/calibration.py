"""Isotonic calibration, fitted and applied without a collect.

The scores are cut into ranges. Each range is pooled by itself (adjacent violators), which leaves a few blocks of constant value;
neighbouring ranges are then pooled together, a fixed number at a time, until one group of blocks is left. Pooling blocks gives
the same fit as pooling their points, since a block that was pooled once stays together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequery.operators.running import range_edges, running, with_range_bucket
from wavequery.session import cut_lineage

RANGE_POINTS = 100_000  # distinct scores of one range
FAN_IN = 16  # ranges that are pooled together in one step
HOT = 1000  # a score with more than 1 / HOT of all rows is hot, so at most HOT are

_BLOCK = "grp long, lo double, hi double, wy double, w double"


def pooled(lo: np.ndarray, hi: np.ndarray, wy: np.ndarray, w: np.ndarray) -> tuple[list, list, list, list]:
    """Blocks of rising value from blocks in order: neighbours are pooled while the left one is not below the right one."""
    out_lo, out_hi, out_y, out_w = [], [], [], []
    for a, b, y, n in zip(lo.tolist(), hi.tolist(), wy.tolist(), w.tolist(), strict=True):
        while out_w and out_y[-1] * n >= y * out_w[-1]:
            a, y, n = out_lo.pop(), y + out_y.pop(), n + out_w.pop()
            out_hi.pop()
        out_lo.append(a)
        out_hi.append(b)
        out_y.append(y)
        out_w.append(n)
    return out_lo, out_hi, out_y, out_w


def _pool_group(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("lo")
    columns = pooled(*(rows[c].to_numpy() for c in ("lo", "hi", "wy", "w")))
    group = [rows["grp"][0].as_py()] * len(columns[0])
    return pa.table({"grp": pa.array(group, pa.int64()), **{n: pa.array(c, pa.float64()) for n, c in zip(("lo", "hi", "wy", "w"), columns, strict=True)}})


def isotonic_fit(points: DataFrame) -> DataFrame:
    """Blocks ``(lo, hi, y)`` of the fit of weighted ``points`` ``(x, y, w)`` with distinct ``x``; missing values are left out.

    The blocks are the model: their number is that of the steps of the fit.
    """
    known = "x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL AND NOT isnan(y) AND w > 0"
    points = cut_lineage(points.where(known))
    groups = max(1, -(-points.count() // RANGE_POINTS))
    placed = with_range_bucket(points, "x", range_edges(points, "x", groups))
    blocks = placed.select(
        F.col("_bucket").cast("bigint").alias("grp"), F.col("x").alias("lo"), F.col("x").alias("hi"), (F.col("y") * F.col("w")).alias("wy"), "w"
    )
    blocks = blocks.groupBy("grp").applyInArrow(_pool_group, _BLOCK)
    while groups > 1:
        blocks = cut_lineage(blocks).withColumn("grp", F.floor(F.col("grp") / FAN_IN))
        blocks = blocks.groupBy("grp").applyInArrow(_pool_group, _BLOCK)
        groups = -(-groups // FAN_IN)
    return cut_lineage(blocks.select("lo", "hi", (F.col("wy") / F.col("w")).alias("y")))


def _interpolated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, n, lx, ly, ux, uy = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        with np.errstate(invalid="ignore", divide="ignore"):
            inner = ly + (uy - ly) * (x - lx) / (ux - lx)
        p = np.where(np.isnan(lx), uy, np.where(np.isnan(ux) | (ux == lx), ly, inner))
        yield pa.RecordBatch.from_arrays([pa.array(x), batch.column("n"), pa.array(p)], ["x", "n", "p"])


def isotonic_values(blocks: DataFrame, scores: DataFrame) -> DataFrame:
    """``x``, ``n`` and the fitted ``p`` of distinct scores ``(x, n)``: constant in a block, linear between, clipped outside."""
    ends = blocks.select("y", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"))
    zero = F.lit(0).cast("bigint")
    line = ends.select("x", zero.alias("n"), F.struct("x", "y").alias("end"))
    none = F.lit(None).cast("struct<x: double, y: double>").alias("end")
    # A boundary that is a score too is one row of the line.
    line = line.unionByName(scores.select("x", "n", none)).groupBy("x").agg(F.sum("n").alias("n"), F.max("end").alias("end"))
    line = cut_lineage(line)
    line = with_range_bucket(line, "x", range_edges(line, "x"))
    line = running(line, "x", {"_l": ("max", "end")})
    line = running(line, "x", {"_u": ("min", "end")}, descending=True).where("n > 0")
    columns = [F.col(f"{s}.{c}").alias(f"{s}{c}") for s in ("_l", "_u") for c in ("x", "y")]
    return line.select("x", "n", *columns).mapInArrow(_interpolated, "x double, n long, p double")


def isotonic(train: DataFrame, rows: DataFrame, score_col: str = "score", label: str = "label", out: str = "p") -> DataFrame:
    """Isotonic calibration: fit on ``train``, applied to ``rows``, clipped outside the fitted range.

    Rows are reduced to one weighted point per distinct score before the fit, and meet their value by score; hot scores do so by
    broadcast. A missing score has no value.
    """
    points = train.groupBy((F.col(score_col).cast("double") + 0.0).alias("x")).agg(
        F.avg(F.col(label).cast("double")).alias("y"), F.count(label).cast("double").alias("w")
    )
    x = F.col(score_col).cast("double") + 0.0
    scored = rows.withColumn("_x", F.when(~F.isnan(x), x))
    scores = scored.where("_x IS NOT NULL").groupBy(F.col("_x").alias("x")).agg(F.count("*").alias("n"))
    values = cut_lineage(isotonic_values(isotonic_fit(points), scores))
    total = values.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(values.where(F.col("n") * HOT > total).select(F.col("x").alias("_x"), F.col("p").alias(out)))
    cold = values.where(F.col("n") * HOT <= total).select(F.col("x").alias("_x"), F.col("p").alias(out))
    found = scored.join(hot, "_x").unionByName(scored.join(hot.select("_x"), "_x", "left_anti").join(cold, "_x", "left"))
    return found.select(*rows.columns, out)
