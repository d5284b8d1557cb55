"""Spectral work over chunked series: PSD, spectrogram, filters, whitening, resampling.

A series is a table of chunks ``(file_id, chunk_id, first_idx, samples)``; all chunks
but the last of a file have the same length. No operator gathers a file in one
task:

* segments that lie inside a chunk are cut where the chunk is read; only the short
  heads and tails around chunk borders are shuffled for the rest;
* filters work on a chunk plus a halo of neighbouring samples;
* per-file values (mean, spectrum, scale) are joined by ``(file_id, chunk_id)``, so a
  file with very many chunks stays spread out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavequery.session import cut_lineage

CHUNK = ["file_id", "chunk_id"]
WAVE = T.ArrayType(T.DoubleType())


# --- segments ---------------------------------------------------------------------


def segments(chunks: DataFrame, chunk_len: int, length: int, hop: int) -> DataFrame:
    """Full segments ``[k * hop, k * hop + length)`` of each file: ``(file_id, seg, samples)``."""
    if chunk_len % hop or length % hop or chunk_len < length:
        raise ValueError("chunk and segment lengths must be multiples of the hop, chunks not shorter than segments")
    lap = length - hop

    def cut(rows: DataFrame, first: str) -> DataFrame:
        starts = F.sequence(F.lit(0), F.size("samples") - length, F.lit(hop))
        parts = F.transform(
            starts,
            lambda s: F.struct(
                ((F.col(first) + s) / hop).cast("long").alias("seg"),
                F.slice("samples", s + 1, F.lit(length)).alias("samples"),
            ),
        )
        whole = rows.where(F.size("samples") >= length)
        return whole.select("file_id", F.explode(parts).alias("p")).select("file_id", "p.seg", "p.samples")

    inside = cut(chunks, "first_idx")
    if not lap:
        return inside
    n = F.size("samples")
    tails = chunks.where(n == chunk_len).select(
        "file_id",
        (F.col("chunk_id") + 1).alias("border"),
        F.lit(0).alias("part"),
        (F.col("first_idx") + n - lap).alias("at"),
        F.slice("samples", n - lap + 1, F.lit(lap)).alias("s"),
    )
    heads = chunks.select(
        "file_id", F.col("chunk_id").alias("border"), F.lit(1).alias("part"), F.col("first_idx").alias("at"),
        F.slice("samples", 1, lap).alias("s"),
    )
    borders = (
        tails.unionByName(heads)
        .groupBy("file_id", "border")
        .agg(F.count("*").alias("sides"), F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("part", "s"))).alias("p"))
        .where("sides = 2")
        .select("file_id", "at", F.flatten("p.s").alias("samples"))
    )
    return inside.unionByName(cut(borders, "at"))


def _hann(n: int, periodic: bool) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / (n if periodic else n - 1))


def periodograms(m: np.ndarray, rate: float, periodic: bool = True, detrend: bool = True) -> np.ndarray:
    """One-sided spectral density of each row under a Hann window."""
    if detrend:
        m = m - m.mean(axis=1, keepdims=True)
    window = _hann(m.shape[1], periodic)
    power = np.abs(np.fft.rfft(m * window)) ** 2 / (rate * (window**2).sum())
    power[:, 1 : -1 if m.shape[1] % 2 == 0 else None] *= 2.0
    return power


def welch_psd(chunks: DataFrame, chunk_len: int, rate: float, length: int, hop: int) -> DataFrame:
    """Mean periodogram per file: ``(file_id, bin, freq, psd)``.

    Every batch of segments is reduced to one partial sum per file before the shuffle.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, rows in batch.groupby("file_id"):
                power = periodograms(np.array(rows["samples"].tolist(), dtype=np.float64), rate)
                yield pd.DataFrame({"file_id": [file_id], "n": [len(rows)], "total": [power.sum(axis=0)]})

    cut = segments(chunks, chunk_len, length, hop).select("file_id", "samples")
    file_type = chunks.schema["file_id"].dataType.simpleString()
    sums = cut.mapInPandas(partial, f"file_id {file_type}, n long, total array<double>")
    return (
        sums.select("file_id", "n", F.posexplode("total").alias("bin", "total"))
        .groupBy("file_id", "bin")
        .agg((F.sum("total") / F.sum("n")).alias("psd"))
        .select("file_id", "bin", (F.col("bin") * F.lit(rate / length)).alias("freq"), "psd")
    )


def spectrogram(chunks: DataFrame, chunk_len: int, rate: float, length: int = 256) -> DataFrame:
    """Density per segment and frequency: ``(file_id, t_bin, t_s, f_bin, freq, psd, db)``, half overlapping."""

    @F.pandas_udf(WAVE)
    def density(samples: pd.Series) -> pd.Series:
        m = np.array(samples.tolist(), dtype=np.float64)
        return pd.Series(list(periodograms(m, rate, periodic=False, detrend=False)) if len(m) else [])

    cut = segments(chunks, chunk_len, length, length // 2).select("file_id", "seg", density("samples").alias("p"))
    rows = cut.select("file_id", F.col("seg").alias("t_bin"), F.posexplode("p").alias("f_bin", "psd"))
    return rows.select(
        "file_id",
        "t_bin",
        ((F.col("t_bin") * (length // 2) + length / 2) / F.lit(float(rate))).alias("t_s"),
        "f_bin",
        (F.col("f_bin") * F.lit(rate / length)).alias("freq"),
        "psd",
        (F.lit(10.0) * F.log10(F.col("psd") + 1e-10)).alias("db"),
    )


# --- blocks with halo -------------------------------------------------------------


def with_halo(chunks: DataFrame, halo: int) -> DataFrame:
    """Chunks with up to ``halo`` samples of each neighbour: adds ``pad_left`` and ``core_len``.

    Only the first and the last chunk of a file may be shorter than the halo; others raise an error. Each chunk is shuffled once with its own
    key, its edges go to the neighbouring keys.
    """
    n = F.size("samples")
    whole = F.struct(F.lit(1).alias("part"), F.col("samples").alias("s"), F.col("chunk_id").alias("to"))
    tail = F.struct(F.lit(0).alias("part"), F.slice("samples", F.greatest(n - halo, F.lit(0)) + 1, F.lit(halo)).alias("s"), (F.col("chunk_id") + 1).alias("to"))
    head = F.struct(F.lit(2).alias("part"), F.slice("samples", 1, halo).alias("s"), (F.col("chunk_id") - 1).alias("to"))
    sent = chunks.select("file_id", "first_idx", F.explode(F.array(whole, tail, head)).alias("p"))
    pieces = F.sort_array(F.collect_list(F.struct("p.part", "p.s")))
    met = sent.groupBy("file_id", F.col("p.to").alias("chunk_id")).agg(
        pieces.alias("p"), F.max(F.when(F.col("p.part") == 1, F.col("first_idx"))).alias("first_idx")
    )
    of_part = lambda k: F.flatten(F.transform(F.filter("p", lambda e: e["part"] == k), lambda e: e["s"]))
    inner = F.exists("p", lambda e: e["part"] == 0) & F.exists("p", lambda e: e["part"] == 2)
    short = F.raise_error(F.lit(f"a chunk between two others is shorter than the halo of {halo} samples"))
    return met.where("first_idx is not null").select(
        *CHUNK,
        "first_idx",
        F.size(of_part(0)).alias("pad_left"),
        F.size(of_part(1)).alias("core_len"),
        F.when(inner & (F.size(of_part(1)) < halo), short).otherwise(F.flatten("p.s")).alias("samples"),
    )


def core(blocks: DataFrame) -> DataFrame:
    """Drop the halo again."""
    return blocks.select(*CHUNK, "first_idx", F.expr("slice(samples, pad_left + 1, core_len)").alias("samples"))


def attach(blocks: DataFrame, per_file: DataFrame) -> DataFrame:
    """Join per-file values to blocks by ``(file_id, chunk_id)``; the blocks keep their partitioning."""
    keys = blocks.select(*CHUNK).join(per_file, "file_id")
    return blocks.join(keys, CHUNK)


def _block_map(blocks: DataFrame, fn, extra: tuple[str, ...] = ()) -> DataFrame:
    """Replace ``samples`` of each block by ``fn(array, row)``."""
    fields = [f for f in blocks.schema.fields if f.name not in extra]
    fields = [T.StructField("samples", WAVE) if f.name == "samples" else f for f in fields]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            rows = batch.to_dict("records")
            batch = batch.assign(samples=[fn(np.asarray(r["samples"], dtype=np.float64), r) for r in rows])
            yield batch[names]

    return blocks.mapInPandas(run, T.StructType(fields))


# --- filters ----------------------------------------------------------------------


# Limits of a band's edges and its least width, as shares of the Nyquist rate.
BAND_LIMITS = (1e-3, 0.999)
LEAST_BAND = 0.05


def bandpass_gain(freqs: np.ndarray, rate: float, low: float, high: float, order: int = 6) -> np.ndarray:
    """Zero-phase gain of a Butterworth band-pass run forward and backward."""
    nyquist = rate / 2.0
    lo, hi = np.clip(np.array([low, high]) / nyquist, *BAND_LIMITS)
    hi = hi if hi > lo else np.minimum(lo + LEAST_BAND, BAND_LIMITS[1])
    w1, w2 = np.tan(np.pi * lo / 2.0), np.tan(np.pi * hi / 2.0)
    w = np.tan(np.pi * np.minimum(freqs / nyquist, 1.0 - 1e-12) / 2.0)
    gain = np.zeros(len(freqs))
    inside = w > 0
    ratio = (w[inside] ** 2 - w1 * w2) / (w[inside] * (w2 - w1))
    with np.errstate(over="ignore"):
        gain[inside] = 1.0 / (1.0 + ratio ** (2 * order))
    return gain


def notch_gain(freqs: np.ndarray, rate: float, base: float, count: int, q: float = 30.0) -> np.ndarray:
    """Zero-phase gain of second-order notches at the harmonics of ``base`` below Nyquist."""
    harmonics = np.arange(1, count + 1) * max(base or 0.0, 0.0)
    w0 = 2.0 * np.pi * harmonics[(harmonics > 0) & (harmonics < rate / 2.0), None] / rate
    g = 1.0 / (1.0 + np.tan(w0 / q / 2.0))
    z = np.exp(-2j * np.pi * freqs / rate)
    notches = g * (1.0 - 2.0 * np.cos(w0) * z + z**2) / (1.0 - 2.0 * g * np.cos(w0) * z + (2.0 * g - 1.0) * z**2)
    return np.prod(np.abs(notches) ** 2, axis=0)


def filtered(
    blocks: DataFrame,
    rate: float,
    low: float = 35.0,
    high: float = 350.0,
    order: int = 6,
    notch_base: float = 60.0,
    notch_count: int = 0,
) -> DataFrame:
    """Band-pass and notch filter of blocks with halo. Equal to the filter of the whole
    file wherever the halo covers the filter's ringing."""

    def apply(x: np.ndarray, _row) -> np.ndarray:
        size = 1 << int(np.ceil(np.log2(2 * max(len(x), 1))))
        freqs = np.fft.rfftfreq(size, 1.0 / rate)
        gain = bandpass_gain(freqs, rate, low, high, order) * notch_gain(freqs, rate, notch_base, notch_count)
        return np.fft.irfft(np.fft.rfft(x, size) * gain, size)[: len(x)]

    return _block_map(blocks, apply)


def spectra(psd: DataFrame) -> DataFrame:
    """One row per file: the spectrum as an array (its length is that of a segment)."""
    cells = F.sort_array(F.collect_list(F.struct("bin", "psd")))
    return psd.groupBy("file_id").agg(cells.alias("c")).select("file_id", F.col("c.psd").alias("spectrum"))


def repaired_spectrum(p: np.ndarray, floor: float | None = 1e-24, median_share: float = 1e-6) -> np.ndarray:
    """Non-finite values become the median; a floor is fixed or a share of the median."""
    p = np.asarray(p, dtype=np.float64)
    finite = np.isfinite(p)
    median = float(np.median(p[finite])) if finite.any() else 1.0
    p = np.where(finite, p, median)
    return np.maximum(p, floor if floor is not None else median * median_share)


def whitened_blocks(blocks: DataFrame, spectrum: DataFrame, rate: float, variant: str = "standard") -> DataFrame:
    """Divide each block by its file's amplitude spectrum.

    ``standard`` divides by ``sqrt(psd * rate / 2)``, at least 1e-12; ``plain`` by
    ``sqrt(psd) + 1e-12`` with the spectrum floored at a millionth of its median.
    """
    if variant not in ("standard", "plain"):
        raise ValueError("variant must be 'standard' or 'plain'")

    def apply(x: np.ndarray, row) -> np.ndarray:
        p = repaired_spectrum(row["spectrum"], 1e-24 if variant == "standard" else None)
        size = 1 << int(np.ceil(np.log2(2 * max(len(x), 1))))
        grid = np.linspace(0.0, rate / 2.0, len(p))
        level = np.interp(np.fft.rfftfreq(size, 1.0 / rate), grid, p)
        amplitude = np.maximum(np.sqrt(level * rate / 2.0), 1e-12) if variant == "standard" else np.sqrt(level) + 1e-12
        return np.fft.irfft(np.fft.rfft(x, size) / amplitude, size)[: len(x)]

    return _block_map(attach(blocks, spectrum), apply, extra=("spectrum",))


def file_moments(chunks: DataFrame) -> DataFrame:
    """Mean and population deviation of the samples of each file, from per-chunk sums."""
    add = lambda f: F.aggregate("samples", F.lit(0.0), lambda a, v: a + f(v))
    sums = chunks.select(
        "file_id",
        F.size("samples").alias("n"),
        add(lambda v: v.cast("double")).alias("s"),
        F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double") * v).alias("q"),
    )
    total = sums.groupBy("file_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return total.select("file_id", mean.alias("mean"), spread.alias("std"))


def standardized(chunks: DataFrame, centre_only: bool = False) -> DataFrame:
    """Remove each file's mean and divide by its deviation."""
    placed = attach(chunks, file_moments(chunks))
    scale = F.lit(1.0) if centre_only else F.col("std") + 1e-12
    moved = placed.withColumn("_m", F.col("mean")).withColumn("_s", scale)
    return moved.withColumn("samples", F.transform("samples", lambda v: (v - F.col("_m")) / F.col("_s"))).select(
        *chunks.columns
    )


def whiten(
    chunks: DataFrame, chunk_len: int, rate: float, length: int, hop: int, halo: int, variant: str = "standard"
) -> DataFrame:
    """Whiten a series by its own Welch spectrum. The standard variant is also standardized."""
    spectrum = spectra(welch_psd(chunks, chunk_len, rate, length, hop))
    flat = core(whitened_blocks(with_halo(chunks, halo), spectrum, rate, variant))
    return standardized(cut_lineage(flat)) if variant == "standard" else flat


# --- resampling -------------------------------------------------------------------


def rational_ratio(target: float, rate: float, limit: int = 64) -> tuple[int, int]:
    """``up / down`` close to ``target / rate`` with a bounded denominator."""
    from fractions import Fraction

    ratio = Fraction(int(target), int(rate)).limit_denominator(limit)
    return ratio.numerator, ratio.denominator


def _lowpass(up: int, down: int) -> tuple[np.ndarray, int]:
    """Windowed-sinc kernel on the upsampled grid and its half length."""
    top = max(up, down)
    half = 10 * top
    t = np.arange(-half, half + 1)
    kernel = np.sinc(t / top) / top * np.kaiser(2 * half + 1, 5.0)
    return kernel / kernel.sum() * up, half


def resampled(chunks: DataFrame, up: int, down: int, halo: int) -> DataFrame:
    """Polyphase resampling. Output chunks hold the samples whose time lies in the input chunk."""
    reach = -(-10 * max(up, down) // up) + 1
    if halo < reach:
        raise ValueError(f"the halo must cover {reach} samples")

    def run(batches):
        kernel, half = _lowpass(up, down)
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                x = np.asarray(r["samples"], dtype=np.float64)
                start = int(r["first_idx"])
                origin = start - int(r["pad_left"])
                first = -(-start * up // down)
                stop = -(-(start + int(r["core_len"])) * up // down)
                m = np.arange(first, stop)
                centre = m * down
                nearest = centre // up
                taps = nearest[:, None] + np.arange(-reach, reach + 1)[None, :]
                at = taps * up - centre[:, None]
                inside = (taps >= origin) & (taps < origin + len(x)) & (np.abs(at) <= half)
                weight = np.where(inside, kernel[np.clip(at + half, 0, 2 * half)], 0.0)
                value = x[np.clip(taps - origin, 0, max(len(x) - 1, 0))]
                rows.append((r["file_id"], r["chunk_id"], first, (weight * value).sum(axis=1)))
            yield pd.DataFrame(rows, columns=[*CHUNK, "first_idx", "samples"])

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    schema = f"file_id {kinds['file_id']}, chunk_id {kinds['chunk_id']}, first_idx long, samples array<double>"
    return with_halo(chunks, halo).mapInPandas(run, schema)


# --- full chain -------------------------------------------------------------------


def preprocess(
    chunks: DataFrame,
    chunk_len: int,
    rate: float,
    low: float,
    high: float,
    length: int,
    hop: int,
    halo: int,
    policy: str = "interp",
    max_bad: float = 0.30,
    max_gap_s: float = 2.0,
    notch_base: float = 60.0,
    notch_count: int = 0,
    target_rate: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Gap policy, detrending, filters, whitening and resampling of a chunked series.

    The chunks are read twice: for the gap summary and to be filled. Returns the whitened chunks and one row of processing
    statistics per kept file.
    """
    from wavequery.operators import gaps

    summary = cut_lineage(gaps.gap_summary(chunks))
    runs = gaps.runs_of(gaps.carried(summary), int(round(max_gap_s * rate)))
    gap_stats = runs.groupBy("file_id").agg(F.sum("run_length").alias("n_interp"), F.sum("big").alias("n_big_gaps"))
    limit = 0.0 if policy in ("skip", "strict") else max_bad
    stats = gaps.file_shares(summary).where(F.col("bad_frac") <= limit)
    stats = stats.select("file_id", F.col("bad_frac").alias("nan_frac"), "n_samples")
    stats = stats.join(gap_stats, "file_id", "left").fillna(0, ["n_interp", "n_big_gaps"])

    # Each stage below reads its input more than once, so stages are stored, not recomputed.
    kept = gaps.nan_policy(chunks, policy, max_bad, summary).select(*CHUNK, "first_idx", "samples")
    flat = standardized(cut_lineage(kept), centre_only=True)
    passed = core(filtered(with_halo(flat, halo), rate, low, high, notch_base=notch_base, notch_count=notch_count))
    white = whiten(cut_lineage(passed), chunk_len, rate, length, hop, halo)
    if target_rate and target_rate != rate:
        up, down = rational_ratio(target_rate, rate)
        white = resampled(white, up, down, halo)
    return white, stats


# --- matched filter with spectral weighting ---------------------------------------


def reweighted_snr(
    windows: DataFrame,
    templates: DataFrame,
    rate: float,
    f_low: float,
    segment: int,
    bands: int = 16,
    max_shift_s: float = 0.02,
) -> DataFrame:
    """Peak SNR and chi-square re-weighted peak around the window centre for every pair.

    The window's own Welch spectrum weights the filter; chi-square compares ``bands``
    frequency bands of equal expected power.
    """
    from wavequery.operators.templates import BLOCK_BYTES, _long, _per_block

    def score(ids, bank, batch, waves):
        peaks = np.array([snr_peaks(x, bank, rate, f_low, segment, bands, max_shift_s) for x in waves])
        return _long(ids, batch, (peaks[:, 0, :], peaks[:, 1, :]), ("new_snr", "snr"))

    schema = "window_id long, template_id long, new_snr double, snr double"
    return _per_block(windows, templates, schema, score, BLOCK_BYTES)


def best_reweighted_snr(
    windows: DataFrame,
    templates: DataFrame,
    rate: float,
    f_low: float,
    segment: int,
    bands: int = 16,
    max_shift_s: float = 0.02,
) -> DataFrame:
    """Largest re-weighted and plain peak of each window, and the number of templates, without a row per pair."""
    from wavequery.operators.templates import BLOCK_BYTES, _per_block

    def score(ids, bank, batch, waves):
        new, plain = best_snr_peaks(waves, bank, rate, f_low, segment, bands, max_shift_s)
        return pd.DataFrame({"window_id": batch["window_id"], "new_snr": new, "snr": plain, "n": len(ids)})

    parts = _per_block(windows, templates, "window_id long, new_snr double, snr double, n long", score, BLOCK_BYTES)
    return parts.groupBy("window_id").agg(F.max("new_snr").alias("new_snr"), F.max("snr").alias("snr"), F.sum("n").alias("n"))


# Templates of a bank that are filtered at once; their arrays stay in the cache.
PEAK_TEMPLATES = 512
# The same for the matrix products of some windows with a bank, and for chosen pairs.
PEAK_WINDOWS, PEAK_COLUMNS, PEAK_PAIRS = 4, 1024, 2048


def _near_centre(n: int, rate: float, f_low: float, max_shift_s: float):
    """Places of the used frequencies, and a function of (spectra of them) that gives the complex output near the centre.

    If the outputs are few, the transform is evaluated there alone, by the matrix in third place; else that is None.
    """
    df = rate / n
    at = np.flatnonzero(np.fft.rfftfreq(n, 1.0 / rate) >= f_low)
    near = np.flatnonzero(np.abs(np.arange(n) - n // 2) <= int(max_shift_s * rate))
    direct = len(near) <= 4 * np.log2(n)
    turns = 4.0 * df * np.exp(2j * np.pi / n * (np.outer(at, near) % n)) if direct else None

    def series(part):
        if direct:
            return part @ turns
        full = np.zeros((len(part), n), dtype=complex)
        full[:, at] = part
        return 4.0 * df * n * np.fft.ifft(full, axis=1)[:, near]

    return at, series, turns


def _weighted_window(x, rate, segment, at):
    """Transform of a window and its own Welch spectrum, at the used frequencies."""
    n = len(x)
    cuts = np.array([x[s : s + segment] for s in range(0, n - segment + 1, segment // 2)])
    psd = repaired_spectrum(periodograms(cuts, rate).mean(axis=0))
    level = np.interp(np.fft.rfftfreq(n, 1.0 / rate), np.linspace(0.0, rate / 2.0, len(psd)), psd)
    return np.fft.rfft(x)[at] / rate, level[at]


def _pair_peaks(hf, xf, level, series, df, bands) -> np.ndarray:
    """Re-weighted and plain peaks, shape (2, rows), of rows of template spectra; window spectra are one row or as many."""
    power = 4.0 * df * np.abs(hf) ** 2 / level
    sigma2 = power.sum(axis=1)
    safe = np.where(sigma2 > 0, sigma2, 1.0)[:, None]
    weighted_product = xf * np.conj(hf) / level
    z = series(weighted_product)
    share = np.minimum((np.cumsum(power, axis=1) / safe * bands - 1e-9).astype(int), bands - 1)
    chi2 = sum(np.abs(series(weighted_product * (share == b)) - z / bands) ** 2 for b in range(bands)) * bands / safe
    reduced = chi2 / max(2 * bands - 2, 1)
    snr = np.abs(z) / np.sqrt(safe)
    weighted = snr / np.where(reduced > 1.0, ((1.0 + reduced**3) / 2.0) ** (1.0 / 6.0), 1.0)
    return np.where(sigma2 > 0, np.array([weighted.max(axis=1), snr.max(axis=1)]), 0.0)


def snr_peaks(x, bank, rate, f_low, segment, bands, max_shift_s, spectrum=None) -> np.ndarray:
    """Re-weighted and plain peaks of one window against every template, shape (2, templates).

    Only outputs near the centre count. ``spectrum`` is the transform of the bank, if it is at hand.
    """
    if spectrum is None:
        spectrum = np.fft.rfft(bank, axis=1)
    at, series, _ = _near_centre(len(x), rate, f_low, max_shift_s)
    xf, level = _weighted_window(x, rate, segment, at)
    parts = range(0, len(bank), PEAK_TEMPLATES)
    found = [_pair_peaks(spectrum[i : i + PEAK_TEMPLATES, at] / rate, xf, level, series, rate / len(x), bands) for i in parts]
    return np.concatenate(found, axis=1)


def best_snr_peaks(waves, bank, rate, f_low, segment, bands, max_shift_s) -> tuple[np.ndarray, np.ndarray]:
    """Largest re-weighted and largest plain peak of each window over all templates.

    The plain peaks of all pairs are matrix products. A re-weighted peak is never above the plain one, so it is computed for
    those pairs only whose plain peak is above the best re-weighted one found so far for the window.
    """
    n = waves.shape[1]
    df = rate / n
    spectrum = np.fft.rfft(bank, axis=1)
    at, series, turns = _near_centre(n, rate, f_low, max_shift_s)
    if turns is None:
        peaks = [snr_peaks(x, bank, rate, f_low, segment, bands, max_shift_s, spectrum).max(axis=1) for x in waves]
        return tuple(np.array(peaks).T)
    hf = spectrum[:, at] / rate
    xf, level = (np.array(part) for part in zip(*[_weighted_window(x, rate, segment, at) for x in waves], strict=True))
    plain = _plain_peaks(hf, xf, level, turns, df)

    def weighted_peaks(w, t):
        parts = [slice(i, i + PEAK_PAIRS) for i in range(0, len(w), PEAK_PAIRS)]
        return np.concatenate([_pair_peaks(hf[t[p]], xf[w[p]], level[w[p]], series, df, bands)[0] for p in parts])

    first = plain.argmax(axis=1)
    new = weighted_peaks(np.arange(len(waves)), first)
    # The two ways to compute a plain peak differ in the last bits.
    reach = plain * (1.0 + 1e-9)
    w, t = np.nonzero(reach > new[:, None])
    order = np.lexsort((-reach[w, t], w))
    w, t = w[order], t[order]
    step = 4
    while len(w):
        now = np.arange(len(w)) - np.searchsorted(w, w) < step
        np.maximum.at(new, w[now], weighted_peaks(w[now], t[now]))
        rest = ~now & (reach[w, t] > new[w])
        w, t, step = w[rest], t[rest], 4 * step
    return new, plain[np.arange(len(waves)), first]


def _plain_peaks(hf, xf, level, turns, df) -> np.ndarray:
    """Largest plain signal-to-noise near the centre, shape (windows, templates)."""
    n, m = len(xf), len(hf)
    parts = np.concatenate([hf.real, hf.imag], axis=1).T
    out = np.empty((n, m))
    for i in range(0, n, PEAK_WINDOWS):
        filters = ((xf / level)[i : i + PEAK_WINDOWS, :, None] * turns).transpose(0, 2, 1)
        # Rows of the real outputs, then of the imaginary ones, against real and imaginary parts of a template.
        rows = np.stack([np.concatenate([filters.real, filters.imag], axis=2), np.concatenate([filters.imag, -filters.real], axis=2)], axis=1)
        shape = rows.shape[:3]
        rows = rows.reshape(-1, rows.shape[3])
        for j in range(0, m, PEAK_COLUMNS):
            z = rows @ parts[:, j : j + PEAK_COLUMNS]
            z *= z
            z = z.reshape(*shape, -1)
            z[:, 0] += z[:, 1]
            z[:, 0].max(axis=1, out=out[i : i + PEAK_WINDOWS, j : j + PEAK_COLUMNS])
    sigma2 = 4.0 * df * ((1.0 / level) @ (np.abs(hf) ** 2).T)
    return np.where(sigma2 > 0, np.sqrt(out / np.where(sigma2 > 0, sigma2, 1.0)), 0.0)
