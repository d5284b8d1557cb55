"""Windows of a strain table for scoring: looked up, cut, resampled, fitted and vetoed.

A window that cannot be used gets the first reason that applies (see ``checks.REASONS``) and no samples; it still is a row, and
scores 0. The kernel works on Arrow batches: one matrix per batch, length and rate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavequery.operators import gaps, signal
from wavequery.operators.checks import reason_of
from wavequery.operators.templates import EPS, right_aligned

PEAK_LIMIT, KURT_LIMIT = 20.0, 80.0
_LOADED = T.StructType([T.StructField("wave", T.ArrayType(T.DoubleType())), T.StructField("reason", T.StringType())])


def resampled_rows(m: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling of each row, zeros outside."""
    kernel, half = signal._lowpass(up, down)
    n = m.shape[1]
    centre = np.arange(-(-n * up // down)) * down
    reach = half // up + 1
    taps = (centre // up)[:, None] + np.arange(-reach, reach + 1)
    at = taps * up - centre[:, None]
    weight = np.where((taps >= 0) & (taps < n) & (np.abs(at) <= half), kernel[np.clip(at + half, 0, 2 * half)], 0.0)
    return np.einsum("rkt,kt->rk", m[:, np.clip(taps, 0, max(n - 1, 0))], weight)


def usable(m: np.ndarray, length: int, up: int, down: int, peak_limit: float, kurt_limit: float):
    """Standardized rows of ``length`` and a reason or None for each.

    Bad samples count as the mean of the others. What is longer keeps its end, what is shorter gets zeros in front.
    """
    good = np.isfinite(m)
    known = good.sum(axis=1)
    mean = np.where(good, m, 0.0).sum(axis=1) / np.maximum(known, 1)
    x = np.where(good, m, mean[:, None])
    if up != down:
        x = resampled_rows(x, up, down)
    x = right_aligned(x, length)
    x = x - x.mean(axis=1, keepdims=True)
    x = x / (x.std(axis=1, keepdims=True) + EPS)
    peak = np.abs(x).max(axis=1, initial=0.0)
    again = (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, keepdims=True) + EPS)
    kurt = (again**4).mean(axis=1)
    reasons = np.full(len(m), None, object)
    reasons[kurt > kurt_limit] = "glitch_veto_kurt"
    reasons[peak > peak_limit] = "glitch_veto_peak"
    reasons[known == 0] = "non_finite"
    return x, reasons


def window_kernel(seconds: float, target_rate: int, peak_limit: float = PEAK_LIMIT, kurt_limit: float = KURT_LIMIT):
    """A function of (samples, rate) columns: ``struct(wave, reason)``, one of them null."""
    length = int(round(seconds * target_rate))

    @F.pandas_udf(_LOADED)
    def load(samples: pd.Series, rates: pd.Series) -> pd.DataFrame:
        waves, reasons = np.full(len(samples), None, object), np.full(len(samples), None, object)
        sizes = samples.map(lambda s: -1 if s is None else len(s)).to_numpy()
        keys = np.stack([sizes, rates.fillna(0).to_numpy(dtype=np.int64)], axis=1)
        for size, rate in np.unique(keys, axis=0) if len(keys) else ():
            if size < 0 or rate <= 0:
                continue
            where = np.flatnonzero((keys == (size, rate)).all(axis=1))
            m = np.array([np.asarray(samples.iloc[i], dtype=np.float64) for i in where])
            up, down = signal.rational_ratio(target_rate, rate)
            x, why = usable(m, length, up, down, peak_limit, kurt_limit)
            reasons[where] = why
            for i, row, reason in zip(where, x, why, strict=True):
                waves[i] = row if reason is None else None
        return pd.DataFrame({"wave": waves, "reason": reasons})

    return load


def loaded_windows(
    wanted: DataFrame,
    index: DataFrame,
    strain: DataFrame,
    seconds: float,
    target_rate: int,
    peak_limit: float = PEAK_LIMIT,
    kurt_limit: float = KURT_LIMIT,
) -> DataFrame:
    """``wanted`` rows (``window_id``, ``file_id``, ``start_us``) with their ``wave`` or the ``reason`` why there is none.

    ``index`` tells the first sample of a window by file and start time, ``strain`` is a strain table. A null or unknown file or
    start is ``miss_sgps``; repeated rows of the index count as the one with the smallest sample. ``window_id`` is unique.
    """
    starts = index.groupBy("file_id", "start_us").agg(F.min("start_idx").alias("start_idx"))
    headers = strain.where("chunk_id = 0").select("file_id", "fs", "chunk_len", "n_samples")
    found = wanted.select("window_id", "file_id", "start_us").join(starts, ["file_id", "start_us"], "left")
    found = found.join(headers, "file_id", "left").withColumn("_len", F.round(F.col("fs") * seconds).cast("int"))
    end = F.col("start_idx") + F.col("_len")
    early = reason_of(
        {
            "miss_sgps": F.col("start_idx").isNull(),
            "fs_unknown": F.coalesce(F.col("fs") <= 0, F.lit(True)),
            "out_of_bounds": (F.col("start_idx") < 0) | (end > F.col("n_samples")),
        }
    )
    found = found.withColumn("_early", early)
    rejected = found.where("_early IS NOT NULL").select(
        "window_id", "file_id", "start_us", F.lit(None).cast("array<double>").alias("wave"), F.col("_early").alias("reason")
    )
    windows = found.where("_early IS NULL").select("window_id", "file_id", "start_us", "start_idx", "fs", "chunk_len", "_len")
    chunks = strain.select("file_id", "chunk_id", "first_idx", F.col("samples").cast("array<double>").alias("samples"))
    cut = gaps.window_slices(windows, chunks, F.col("chunk_len"), F.col("_len"))
    done = window_kernel(seconds, target_rate, peak_limit, kurt_limit)("samples", "fs").alias("_w")
    cut = cut.select("window_id", "file_id", "start_us", done)
    # A chunk that is missing inside the file leaves no samples.
    reason = F.coalesce("_w.reason", F.when(F.col("_w.wave").isNull(), "out_of_bounds"))
    return cut.select("window_id", "file_id", "start_us", "_w.wave", reason.alias("reason")).unionByName(rejected)


def checked_windows(windows: DataFrame, length: int, peak_limit: float = PEAK_LIMIT, kurt_limit: float = KURT_LIMIT) -> DataFrame:
    """Windows that hold their samples already: the same kernel, without lookup; a null ``wave`` is ``out_of_bounds``."""
    done = window_kernel(1.0, length, peak_limit, kurt_limit)("wave", F.lit(length)).alias("_w")
    reason = F.coalesce("_w.reason", F.when(F.col("_w.wave").isNull(), "out_of_bounds"))
    keep = [c for c in windows.columns if c != "wave"]
    return windows.select(*keep, done).select(*keep, "_w.wave", reason.alias("reason"))
