"""Array columns that hold waveforms.

Short helpers are Spark expressions. Numeric work over whole waveforms runs in
pandas functions on Arrow batches, where one numpy call handles a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-12
WAVE = T.ArrayType(T.DoubleType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _groups_by_length(waves: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and stacked float64 matrix of the waves of each length."""
    lengths = waves.map(lambda w: -1 if w is None else len(w)).to_numpy()
    for length in np.unique(lengths):
        where = np.flatnonzero(lengths == length)
        if length >= 0:
            yield where, np.array([np.asarray(waves.iloc[i], dtype=np.float64) for i in where])


def _standardized(m: np.ndarray) -> np.ndarray:
    m = m - m.mean(axis=1, keepdims=True)
    return m / (m.std(axis=1, keepdims=True) + EPS)


@F.pandas_udf(WAVE)
def zscore(waves: pd.Series) -> pd.Series:
    """Zero mean and unit deviation of each wave."""
    out = pd.Series([None] * len(waves), dtype=object)
    for where, m in _groups_by_length(waves):
        out.iloc[where] = list(_standardized(m)) if m.shape[1] else list(m)
    return out


@F.pandas_udf(_struct(peak=T.DoubleType(), kurt=T.DoubleType()))
def glitch_stats(waves: pd.Series) -> pd.DataFrame:
    """Largest magnitude and Pearson kurtosis of the standardized wave."""
    out = pd.DataFrame({"peak": np.full(len(waves), np.nan), "kurt": np.full(len(waves), np.nan)})
    for where, m in _groups_by_length(waves):
        if m.shape[1]:
            z = _standardized(m)
            out.loc[where, "peak"] = np.abs(z).max(axis=1)
            out.loc[where, "kurt"] = (_standardized(z) ** 4).mean(axis=1)
    return out


@F.pandas_udf(
    _struct(lo=T.DoubleType(), hi=T.DoubleType(), mean=T.DoubleType(), std=T.DoubleType(), nonzero=T.LongType())
)
def wave_stats(waves: pd.Series) -> pd.DataFrame:
    """Smallest, largest, mean, deviation and number of nonzero samples."""
    rows = np.full((len(waves), 5), np.nan)
    for where, m in _groups_by_length(waves):
        if m.shape[1]:
            rows[where] = np.stack(
                [m.min(axis=1), m.max(axis=1), m.mean(axis=1), m.std(axis=1), (m != 0).sum(axis=1)], axis=1
            )
    out = pd.DataFrame(rows, columns=["lo", "hi", "mean", "std", "nonzero"])
    return out.assign(nonzero=out["nonzero"].fillna(0).astype("int64"))


def fit_length(wave: Column, length: int, align: str = "right") -> Column:
    """Crop or zero-pad to ``length``; ``right`` keeps the end, ``left`` keeps the start."""
    zeros = F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(wave), F.lit(0)))
    if align == "right":
        first = F.greatest(F.size(wave) - length, F.lit(0)) + 1
        return F.concat(zeros, F.slice(wave, first, F.lit(length)))
    return F.concat(F.slice(wave, 1, length), zeros)


def shifted(wave: Column, lag: Column) -> Column:
    """Move samples by ``lag`` places and fill with zeros."""
    n = F.size(wave)
    size = F.least(F.abs(lag), n)
    zeros = F.array_repeat(F.lit(0.0), size)
    return F.when(lag >= 0, F.concat(zeros, F.slice(wave, F.lit(1), n - size))).otherwise(
        F.concat(F.slice(wave, size + 1, n - size), zeros)
    )


def rolled(wave: Column, shift: Column) -> Column:
    """Circular roll to the right by ``shift`` places."""
    n = F.size(wave)
    k = F.pmod(shift, n)
    return F.concat(F.slice(wave, n - k + 1, k), F.slice(wave, F.lit(1), n - k))


def peak_normalized(wave: Column) -> Column:
    """Divide by the largest magnitude plus 1e-9."""
    top = F.array_max(F.transform(wave, lambda v: F.abs(v))) + 1e-9
    return F.transform(wave, lambda v: v / top)


def tukey(length: int, alpha: float) -> list[float]:
    """Weights of a symmetric tapered-cosine window."""
    if length < 2:
        return [1.0] * length
    alpha = min(max(alpha, 0.0), 1.0)
    x = np.linspace(0.0, 1.0, length)
    w = np.ones(length)
    if alpha > 0:
        edge = np.minimum(x, 1.0 - x)
        inside = edge < alpha / 2
        w[inside] = 0.5 * (1.0 - np.cos(2.0 * np.pi * edge[inside] / alpha))
    return w.tolist()


def tapered(alpha: float):
    """A function that tapers a wave, removes its mean and scales it to unit deviation."""

    @F.pandas_udf(WAVE)
    def taper(waves: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(waves), dtype=object)
        for where, m in _groups_by_length(waves):
            out.iloc[where] = list(_standardized(m * np.asarray(tukey(m.shape[1], alpha))))
        return out

    return taper
