"""Strain tables: sampled series in chunks, with the attributes of their files.

One row per chunk: ``file_id``, ``detector``, ``gps_start_us`` (absolute time of sample 0), ``fs`` (null if no attribute tells it),
``chunk_len``, ``n_samples`` (of the file), ``chunk_id``, ``first_idx``, ``samples``. File attributes stand on every
chunk, so a chunk can be checked and placed in time without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequery.operators.gaps import chunked
from wavequery.sources.tables import sample_rate

HEADER = ["file_id", "detector", "gps_start_us", "fs", "chunk_len", "n_samples"]


def strain_table(series: DataFrame, headers: DataFrame, chunk_len: int) -> DataFrame:
    """A strain table of a long-form series ``(file_id, idx, x)``.

    ``headers`` has one row per file: ``detector``, ``gps_start_us``, ``n_samples`` and the rate attributes ``fs_attr``,
    ``sample_rate_attr`` and ``spacing_attr``. Samples that are missing in ``series`` are missing in the chunk, and are noticed
    when it is read.
    """
    placed = series.select("file_id", "idx", F.floor(F.col("idx") / chunk_len).alias("chunk_id"), "x")
    rate = sample_rate(F.col("fs_attr"), F.col("sample_rate_attr"), F.col("spacing_attr"))
    attributes = headers.select("file_id", "detector", "gps_start_us", rate.alias("fs"), "n_samples")
    chunks = chunked(placed).withColumn("chunk_len", F.lit(chunk_len))
    return chunks.join(attributes, "file_id").select(*HEADER, "chunk_id", "first_idx", "samples")


def checked(strain: DataFrame) -> DataFrame:
    """The same table; a chunk at a wrong place, or of a wrong length, raises an error when its samples are read."""
    whole = F.least(F.col("chunk_len"), F.col("n_samples") - F.col("first_idx"))
    fits = (F.col("first_idx") == F.col("chunk_id") * F.col("chunk_len")) & (F.size("samples") == whole)
    where = F.concat_ws(" ", F.lit("file"), "file_id", F.lit("chunk"), "chunk_id", F.lit("is not where its length puts it"))
    return strain.withColumn("samples", F.when(F.coalesce(fits, F.lit(False)), F.col("samples")).otherwise(F.raise_error(where)))


def incomplete_files(strain: DataFrame) -> DataFrame:
    """``file_id``, ``n_chunks`` and ``expected`` of files that lack or repeat chunks."""
    expected = F.ceil(F.max("n_samples") / F.max("chunk_len"))
    counts = strain.groupBy("file_id").agg(
        F.count("*").alias("n_chunks"), F.count_distinct("chunk_id").alias("_distinct"), expected.alias("expected")
    )
    return counts.where("n_chunks != expected OR _distinct != expected").drop("_distinct")


def write_strain(strain: DataFrame, path: str) -> None:
    """Typed Parquet with zstd, one folder per detector."""
    strain.write.mode("overwrite").option("compression", "zstd").partitionBy("detector").parquet(path)


def read_strain(spark: SparkSession, path: str) -> DataFrame:
    """A checked strain table; filters on ``detector`` leave whole folders out."""
    return checked(spark.read.parquet(path)).select(*HEADER, "chunk_id", "first_idx", "samples")


def file_headers(strain: DataFrame) -> DataFrame:
    """One row of attributes per file, from its first chunk."""
    return strain.where("chunk_id = 0").select(*HEADER)


def sample_time_us(index: Column, start: str = "gps_start_us", fs: str = "fs") -> Column:
    """Absolute time of a sample; null without a rate."""
    return F.col(start) + F.round(index * 1_000_000 / F.col(fs)).cast("bigint")


def window_index(strain: DataFrame, stride: int, length: int = 1) -> DataFrame:
    """``file_id``, ``start_idx``, ``start_us`` of the windows that begin every ``stride`` samples and end inside the file.

    Each chunk lists the windows that begin in it, so a long file is spread over its chunks.
    """
    first = F.ceil(F.col("first_idx") / stride) * stride
    last = F.least(F.col("first_idx") + F.col("chunk_len") - 1, F.col("n_samples") - length)
    starts = F.when(first <= last, F.sequence(first, last.cast("bigint"), F.lit(stride).cast("bigint")))
    rows = strain.select("file_id", "gps_start_us", "fs", F.explode(starts).alias("start_idx"))
    return rows.select("file_id", "start_idx", sample_time_us(F.col("start_idx")).alias("start_us"))


