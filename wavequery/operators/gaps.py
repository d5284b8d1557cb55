"""Gaps in sampled series: runs, interpolation and the policy for bad samples.

A series is a table of chunks ``(file_id, chunk_id, first_idx, samples)`` and is read at most twice: once for a row of a few
numbers per chunk (bad samples, outermost good ones, runs inside), once to fill the gaps. What crosses a chunk border is
carried over those rows, so samples never become rows and a hot file stays spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavequery.operators.running import running
from wavequery.session import cut_lineage

CHUNK = ["file_id", "chunk_id"]
# State is carried over groups of this many chunks first.
CHUNK_GROUP = 1024

_GOOD = T.StructType([T.StructField("i", T.LongType()), T.StructField("v", T.DoubleType())])
_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def is_bad(value: Column) -> Column:
    """True for null, NaN and infinite samples."""
    return value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def chunk_arrays(batch: pa.RecordBatch, column: str = "samples") -> Iterator[np.ndarray]:
    """The samples of each chunk as doubles; null samples are NaN, a missing chunk is empty."""
    lists = batch.column(column)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for n, end in zip(sizes, ends, strict=True):
        yield values[end - n : end]


def gap_summary(chunks: DataFrame) -> DataFrame:
    """One row per chunk: ``n``, ``n_bad``, the first and last good sample, bad ``head`` and ``tail``, ``runs`` between good samples."""
    keys = [f for f in chunks.schema if f.name in CHUNK]
    names = [f.name for f in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first, x in zip(batch.column("first_idx").to_pylist(), chunk_arrays(batch), strict=True):
                good = np.flatnonzero(np.isfinite(x))
                if not len(good):
                    rows.append((first, len(x), len(x), None, None, len(x), len(x), []))
                    continue
                lo, hi = int(good[0]), int(good[-1])
                step = np.diff(good)
                at = np.flatnonzero(step > 1)
                inner = [{"start": first + int(good[k]) + 1, "length": int(step[k]) - 1} for k in at]
                ends = [{"i": first + i, "v": float(x[i])} for i in (lo, hi)]
                rows.append((first, len(x), len(x) - len(good), *ends, lo, len(x) - 1 - hi, inner))
            arrays = [batch.column(n) for n in names]
            good_type = pa.struct([("i", pa.int64()), ("v", pa.float64())])
            run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            kinds = [pa.int64()] * 3 + [good_type] * 2 + [pa.int64()] * 2 + [run_type]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            arrays += [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *[f.name for f in added]])

    added = [T.StructField(n, T.LongType()) for n in ("first_idx", "n", "n_bad")]
    added += [T.StructField("first_good", _GOOD), T.StructField("last_good", _GOOD)]
    added += [T.StructField(n, T.LongType()) for n in ("head", "tail")] + [T.StructField("runs", _RUNS)]
    return chunks.select(*CHUNK, "first_idx", "samples").mapInArrow(run, T.StructType([*keys, *added]))


def carried(summary: DataFrame) -> DataFrame:
    """Add ``prev`` and ``next``: the nearest good samples of the file outside each chunk."""
    rows = summary.withColumn("_bucket", F.floor(F.col("chunk_id") / CHUNK_GROUP))
    rows = running(rows, "chunk_id", {"prev": ("max", "last_good")}, by=["file_id"], exclusive=True)
    rows = running(rows, "chunk_id", {"next": ("min", "first_good")}, by=["file_id"], descending=True, exclusive=True)
    return rows.drop("_bucket")


def filled(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks with bad samples interpolated; ``edges`` holds ``prev`` and ``next`` of each chunk (see ``carried``).

    The ends of a file hold its nearest good value; a file without any gives 0.
    """
    fields = [f if f.name != "samples" else T.StructField("samples", T.ArrayType(T.DoubleType())) for f in chunks.schema]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            sides = zip(batch.column("_prev").to_pylist(), batch.column("_next").to_pylist(), strict=True)
            starts = batch.column("first_idx").to_pylist()
            for first, x, (before, after) in zip(starts, chunk_arrays(batch), sides, strict=True):
                good = np.isfinite(x)
                if not good.all():
                    index = np.arange(first, first + len(x))
                    at, value = index[good], x[good]
                    if before is not None:
                        at, value = np.append(before["i"], at), np.append(before["v"], value)
                    if after is not None:
                        at, value = np.append(at, after["i"]), np.append(value, after["v"])
                    x = np.where(good, x, np.interp(index, at, value) if len(at) else 0.0)
                done.append(x)
            sizes = np.cumsum([0, *map(len, done)])
            flat = pa.array(np.concatenate([np.empty(0), *done]), pa.float64())
            samples = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([samples if n == "samples" else batch.column(n) for n in names], names)

    sides = edges.select(*CHUNK, F.col("prev").alias("_prev"), F.col("next").alias("_next"))
    return chunks.join(sides, CHUNK).mapInArrow(run, T.StructType(fields))


def gap_fill(chunks: DataFrame) -> DataFrame:
    """Linear interpolation of bad samples; edges hold the nearest good value, all-bad files give 0."""
    return filled(chunks, carried(gap_summary(chunks)))


def runs_of(edges: DataFrame, max_gap: int) -> DataFrame:
    """Runs of bad samples ``(file_id, run_start, run_length, big)`` from the rows of ``carried``.

    A run that touches a chunk border is named by the last good sample before it, and its pieces are added up.
    """
    inside = edges.select("file_id", F.inline("runs")).select(
        "file_id", F.col("start").alias("run_start"), F.col("length").alias("run_length")
    )
    head = F.struct(F.col("prev.i").alias("after"), F.col("first_idx").alias("start"), F.col("head").alias("length"))
    tail_start = (F.col("first_idx") + F.col("n") - F.col("tail")).alias("start")
    # The tail of a chunk without good samples is its head.
    own = F.when(F.col("last_good").isNotNull(), F.col("tail")).otherwise(0)
    tail = F.struct(F.col("last_good.i").alias("after"), tail_start, own.alias("length"))
    pieces = edges.select("file_id", F.inline(F.array(head, tail))).where("length > 0")
    across = pieces.groupBy("file_id", "after").agg(F.min("start").alias("run_start"), F.sum("length").alias("run_length"))
    runs = inside.unionByName(across.drop("after"))
    return runs.select("file_id", "run_start", "run_length", (F.col("run_length") > max_gap).cast("int").alias("big"))


def gap_runs(chunks: DataFrame, max_gap: int) -> DataFrame:
    """Contiguous runs of bad samples: ``(file_id, run_start, run_length, big)``."""
    return runs_of(carried(gap_summary(chunks)), max_gap)


def file_shares(summary: DataFrame) -> DataFrame:
    """``bad_frac`` and ``n_samples`` of each file."""
    total = summary.groupBy("file_id").agg(F.sum("n").alias("n_samples"), F.sum("n_bad").alias("_bad"))
    return total.select("file_id", "n_samples", (F.col("_bad") / F.col("n_samples")).alias("bad_frac"))


def nan_policy(chunks: DataFrame, policy: str = "interp", max_frac: float = 0.30, summary: DataFrame | None = None) -> DataFrame:
    """Apply a policy to bad samples and drop files that are too contaminated.

    ``interp`` and any unknown policy interpolate, ``zero`` writes zeros, ``skip`` and
    ``strict`` drop every file with a bad sample. Adds ``bad_frac``. ``summary`` is the stored ``gap_summary``
    of the same chunks, if there is one.
    """
    summary = cut_lineage(gap_summary(chunks)) if summary is None else summary
    limit = 0.0 if policy in ("skip", "strict") else max_frac
    share = file_shares(summary).where(F.col("bad_frac") <= limit).select("file_id", "bad_frac")
    # Rows of a few numbers meet the share of their file; the chunks are joined to them by chunk.
    kept = chunks.join(summary.select(*CHUNK).join(share, "file_id"), CHUNK)
    samples = F.col("samples").cast("array<double>")
    if policy == "zero":
        return kept.withColumn("samples", F.transform(samples, lambda v: F.when(is_bad(v), F.lit(0.0)).otherwise(v)))
    if policy in ("skip", "strict"):
        return kept.withColumn("samples", samples)
    return filled(kept, carried(summary))


def chunked(
    series: DataFrame, file: str = "file_id", chunk: str = "chunk_id", idx: str = "idx", value: str = "x"
) -> DataFrame:
    """One row per chunk with its samples in order; a chunk has a fixed length."""
    cell = F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v"))))
    return series.groupBy(file, chunk).agg(F.min(idx).alias("first_idx"), cell.alias("_c")).select(
        file, chunk, "first_idx", F.col("_c.v").alias("samples")
    )


def sample_times(chunks: DataFrame, rate: float, start_s: Column, samples: str = "samples") -> DataFrame:
    """Long form with a time axis: ``t = start + index / rate``."""
    long_form = chunks.select("file_id", "first_idx", start_s.alias("_start"), F.posexplode(samples).alias("_i", "x"))
    index = F.col("first_idx") + F.col("_i")
    return long_form.select("file_id", index.alias("idx"), (F.col("_start") + index / F.lit(float(rate))).alias("t_s"), "x")


def window_slices(
    windows: DataFrame, chunks: DataFrame, chunk_len: int | Column, length: int | Column, zero_fill: bool = False
) -> DataFrame:
    """Samples ``[start_idx, start_idx + length)`` of each window; lengths may be columns of ``windows``.

    A window looks up only the chunks it touches by ``(file_id, chunk_id)``; windows
    that leave the series give null, or zeros with ``zero_fill``.
    """
    first = F.floor(F.col("start_idx") / chunk_len)
    last = F.floor((F.col("start_idx") + length - 1) / chunk_len)
    wanted = windows.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    parts = wanted.join(chunks.withColumn("chunk_id", F.col("chunk_id").cast("long")), ["file_id", "chunk_id"], "left")
    begin = F.greatest(F.col("start_idx") - F.col("first_idx"), F.lit(0))
    end = F.least(F.col("start_idx") + length - F.col("first_idx"), F.size("samples"))
    piece = F.when(
        F.col("samples").isNotNull() & (end > begin),
        F.slice("samples", (begin + 1).cast("int"), (end - begin).cast("int")),
    )
    rest = [c for c in windows.columns if c not in ("file_id", "start_idx")]
    merged = parts.groupBy("file_id", "start_idx", *rest).agg(
        F.sort_array(F.collect_list(F.struct("chunk_id", piece.alias("p")))).alias("_p")
    )
    joined = F.flatten(F.filter("_p.p", lambda p: p.isNotNull()))
    whole = (F.size(joined) == length) & (F.col("start_idx") >= 0)
    missing = F.array_repeat(F.lit(0.0), length) if zero_fill else F.lit(None)
    return merged.withColumn("samples", F.when(whole, joined).otherwise(missing)).drop("_p")
