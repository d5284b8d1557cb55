"""Sliding frames over time series and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequery.operators.joins import join_checked


def crest(peak: Column, rms: Column) -> Column:
    """Peak over RMS, guarded against a vanishing RMS and never negative."""
    safe = F.when(F.abs(rms) < 1e-12, F.lit(1e-12)).otherwise(rms)
    return F.greatest(peak / safe, F.lit(0.0))


def series_extent(points: DataFrame, key: str, time: str) -> DataFrame:
    """First and last time of each series (one row per series)."""
    return points.groupBy(key).agg(F.min(time).alias("origin_us"), F.max(time).alias("last_us"))


def frame_features(
    points: DataFrame,
    extent: DataFrame,
    key: str,
    time: str,
    value: str,
    frame_us: int,
    stride_us: int,
    snr_threshold: float | None = None,
) -> DataFrame:
    """RMS, peak and crest factor of every full frame ``origin + k * stride``.

    Points are first reduced to panes of one stride, before any shuffle of the
    frames; only panes are then copied into the frames that overlap them.
    """
    if frame_us <= 0 or stride_us <= 0:
        raise ValueError("frame and stride must be positive")
    if frame_us % stride_us:
        raise ValueError("the frame must be a multiple of the stride")
    per_frame = frame_us // stride_us
    pane = F.expr(f"({time} - origin_us) div {stride_us}L")
    panes = (
        join_checked(points, extent, [key])
        .withColumn("pane", pane)
        .groupBy(key, "pane")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col(value) * F.col(value)).alias("energy"),
            F.max(F.abs(value)).alias("peak"),
            F.first("origin_us").alias("origin_us"),
            F.first("last_us").alias("last_us"),
        )
    )
    return _combine_panes(panes, key, per_frame, frame_us, stride_us, snr_threshold)


def _combine_panes(panes, key, per_frame, frame_us, stride_us, snr_threshold):
    frames = panes.withColumn("frame", F.explode(F.sequence(F.col("pane") - (per_frame - 1), F.col("pane"))))
    start = F.col("frame") * stride_us + F.col("origin_us")
    frames = frames.where((F.col("frame") >= 0) & (start + frame_us <= F.col("last_us")))
    features = (
        frames.groupBy(key, start.alias("start_us"))
        .agg(F.sum("n").alias("n"), F.sum("energy").alias("energy"), F.max("peak").alias("snr_peak"))
        .withColumn("snr_rms", F.sqrt(F.col("energy") / F.col("n") + 1e-12))
    )
    if snr_threshold is not None:
        features = features.where(F.greatest("snr_rms", "snr_peak") >= snr_threshold)
    return features.select(
        key,
        "start_us",
        (F.col("start_us") + frame_us).alias("end_us"),
        "n",
        "snr_rms",
        "snr_peak",
        crest(F.col("snr_peak"), F.col("snr_rms")).alias("crest_factor"),
    )


def chunk_frame_features(
    chunks: DataFrame, window: int, stride: int, samples: str = "samples", chunk_start: str = "first_idx"
) -> DataFrame:
    """Frame features of a chunked series without moving any sample.

    ``chunks`` holds ``file_id``, the index of the first sample and an array of
    samples; chunk lengths (but the last) are multiples of ``stride``. Each chunk is
    reduced to panes where it is read; frames are joined from panes.
    """
    if window % stride:
        raise ValueError("the window must be a multiple of the stride")
    panes = chunks.select(
        "file_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(samples) - 1) / stride).cast("int")),
                lambda k: F.struct(
                    (F.expr(f"{chunk_start} div {stride}") + k).alias("pane"),
                    F.slice(F.col(samples), k * stride + 1, F.lit(stride)).alias("part"),
                ),
            )
        ).alias("p"),
    ).select(
        "file_id",
        "p.pane",
        F.size("p.part").alias("n"),
        F.aggregate("p.part", F.lit(0.0), lambda a, v: a + v.cast("double") * v).alias("energy"),
        F.array_max(F.transform("p.part", lambda v: F.abs(v))).alias("peak"),
    )
    per_frame = window // stride
    frames = panes.withColumn("frame", F.explode(F.sequence(F.col("pane") - (per_frame - 1), F.col("pane"))))
    return (
        frames.where("frame >= 0")
        .groupBy("file_id", (F.col("frame") * stride).alias("start_idx"))
        .agg(F.sum("n").alias("n"), F.sum("energy").alias("energy"), F.max("peak").alias("snr_peak"))
        .where(F.col("n") == window)
        .withColumn("snr_rms", F.sqrt(F.col("energy") / F.col("n") + 1e-12))
        .select(
            "file_id",
            "start_idx",
            "snr_rms",
            "snr_peak",
            crest(F.col("snr_peak"), F.col("snr_rms")).alias("crest_factor"),
        )
    )
