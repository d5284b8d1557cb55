"""The same work on streams: frames, coincidences, labelling, de-duplication, bursts.

Each function maps streaming DataFrames to a streaming DataFrame; :func:`run_available`
processes what is there and stores it, so a job can be stopped and resumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequery.operators.timejoin import interval_label
from wavequery.session import scratch_path
from wavequery.streaming.full_frames import PROVIDER


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the Parquet files of a folder whose names match the pattern."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_available(
    stream: DataFrame, path: str | None = None, checkpoint: str | None = None, state_store: str | None = None
) -> DataFrame:
    """Process everything available, append to Parquet and return the stored rows.

    ``state_store`` is the state store provider of this run; the session keeps its own.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    checkpoint = checkpoint or scratch_path(spark, "stream-checkpoint")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    own = spark.conf.get(PROVIDER, None)
    if state_store:
        spark.conf.set(PROVIDER, state_store)
    try:
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if state_store:
            spark.conf.set(PROVIDER, own) if own else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(path)


def frame_features(
    points: DataFrame, key: str, time: str, value: str, frame: str, stride: str, delay: str, start: str = "0 seconds"
) -> DataFrame:
    """RMS and peak per sliding frame; a frame is emitted once the watermark has passed its end."""
    framed = points.withWatermark(time, delay).groupBy(key, F.window(time, frame, stride, start))
    x = F.col(value)
    return framed.agg(
        F.count("*").alias("n"), F.sqrt(F.avg(x * x) + 1e-12).alias("snr_rms"), F.max(F.abs(x)).alias("snr_peak")
    ).select(key, F.col("window.start").alias("frame_start"), F.col("window.end").alias("frame_end"), "n", "snr_rms", "snr_peak")


def coincidences(
    left: DataFrame, right: DataFrame, dt_us: int, left_time: str, right_time: str, delay: str, salts: int = 4
) -> DataFrame:
    """Pairs of two streams at most ``dt`` apart: an equality on time cells plus a time bound.

    A stream cannot be counted beforehand, so every cell is split: a row has one own salt
    and is copied to each salt of the other side, and a pair meets in one state store.
    """
    width = max(int(dt_us), 1)

    def cell(c: str):
        return F.floor(F.unix_micros(c) / width).cast("long")

    a = left.withWatermark(left_time, delay).withColumn("_home", cell(left_time))
    a = a.withColumn("_cell", F.explode(F.sequence(F.col("_home") - 1, F.col("_home") + 1))).drop("_home")
    b = right.withWatermark(right_time, delay).withColumn("_rcell", cell(right_time))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    a = a.withColumn("_a1", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).withColumn("_b1", every)
    b = b.withColumn("_b2", F.pmod(F.xxhash64(*right.columns), F.lit(salts)).cast("int")).withColumn("_a2", every)
    near = F.expr(
        f"_cell = _rcell AND _a1 = _a2 AND _b1 = _b2 AND {left_time} BETWEEN {right_time} - INTERVAL {dt_us} MICROSECONDS "
        f"AND {right_time} + INTERVAL {dt_us} MICROSECONDS"
    )
    return a.join(b, near).drop("_cell", "_rcell", "_a1", "_a2", "_b1", "_b2")


def labelled(windows: DataFrame, catalog: DataFrame, pre_us: int, pos_us: int, length_range_us: tuple[int, int]) -> DataFrame:
    """Label a stream of windows against a stored catalogue."""
    return interval_label(windows, catalog, pre_us, pos_us, length_range_us)


def deduplicated(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row per key while the watermark has not passed it."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def bursts(rows: DataFrame, key: str, time: str, value: str, gap: str, delay: str) -> DataFrame:
    """Sessions of triggers no more than ``gap`` apart: number of triggers and largest value."""
    grouped = rows.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("s"))
    return grouped.agg(F.count("*").alias("n"), F.max(value).alias("peak")).select(
        key, F.col("s.start").alias("burst_start"), F.col("s.end").alias("burst_end"), "n", "peak"
    )


def activity(rows: DataFrame, key: str, time: str, width: str, delay: str) -> DataFrame:
    """Rows per key and tumbling window."""
    grouped = rows.withWatermark(time, delay).groupBy(key, F.window(time, width).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("bin_start"), "n")
