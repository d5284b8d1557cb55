"""Spectral queries over the chunked series."""

from __future__ import annotations

import math
import re

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wavequery.operators import gaps, signal
from wavequery.operators.models import principal_components
from wavequery.plans import stand_ins as si
from wavequery.plans.frame_plans import GOOD_SQL
from wavequery.plans.registry import query

RATE = float(si.SERIES_FS)
SEG, HOP = 100, 50
HALO = 250
SPEC = 100

CLEAN_SQL = f"""clean AS (SELECT event_id // {si.FILE_SAMPLES} AS file_id, event_id % {si.FILE_SAMPLES} AS idx, value AS x FROM events)"""


def segments_sql(source: str) -> str:
    """Samples of every full segment, with the position inside the segment."""
    return f"""size AS (SELECT file_id, max(idx) + 1 AS n FROM {source} GROUP BY file_id),
segs AS (SELECT file_id, unnest(range(0, n - {SEG} + 1, {HOP})) AS start FROM size WHERE n >= {SEG}),
pts AS (SELECT s.file_id, s.start // {HOP} AS seg, c.idx - s.start AS i, c.x FROM segs s JOIN {source} c ON c.file_id = s.file_id AND c.idx BETWEEN s.start AND s.start + {SEG} - 1),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {SEG // 2} + 1))"""


SEGMENTS_SQL = f"{CLEAN_SQL}, {segments_sql('clean')}"


def dft_sql(value: str, window: str) -> str:
    """Periodogram of every segment by the definition of the transform."""
    return f"""w AS (SELECT file_id, seg, i, {value} AS v, {window} AS h FROM pts),
dft AS (SELECT file_id, seg, bin, pow(sum(v * h * cos(2 * pi() * bin * i / {SEG})), 2) + pow(sum(v * h * sin(2 * pi() * bin * i / {SEG})), 2) AS p, sum(h * h) AS e
  FROM w CROSS JOIN bins GROUP BY file_id, seg, bin),
power AS (SELECT file_id, seg, bin, p / ({RATE} * e) * CASE WHEN bin IN (0, {SEG // 2}) THEN 1 ELSE 2 END AS psd FROM dft)"""


WELCH_DFT = dft_sql("x - avg(x) OVER (PARTITION BY file_id, seg)", f"0.5 - 0.5 * cos(2 * pi() * i / {SEG})")
WELCH_SQL = f"{SEGMENTS_SQL}, {WELCH_DFT}"


def clean_chunks(spark, sf_dir):
    return gaps.chunked(si.clean_strain(spark, sf_dir))


@query(
    "welch_psd",
    f"WITH {WELCH_SQL} SELECT file_id, bin, round(bin * {RATE / SEG}::DOUBLE, 6) AS freq, round(avg(psd), 6) AS psd FROM power GROUP BY file_id, bin",
)
def welch_psd(spark, sf_dir):
    out = signal.welch_psd(clean_chunks(spark, sf_dir), si.CHUNK_SAMPLES, RATE, SEG, HOP)
    return out.select("file_id", "bin", F.round("freq", 6).alias("freq"), F.round("psd", 6).alias("psd"))


@query(
    "spectrogram",
    f"""WITH {SEGMENTS_SQL},
{dft_sql('x', f'0.5 - 0.5 * cos(2 * pi() * i / {SEG - 1})')}
SELECT file_id, seg AS t_bin, bin AS f_bin, round(psd, 6) AS psd, round(10 * log10(psd + 1e-10), 4) AS db FROM power""",
)
def spectrogram(spark, sf_dir):
    out = signal.spectrogram(clean_chunks(spark, sf_dir), si.CHUNK_SAMPLES, RATE, SPEC)
    return out.select("file_id", "t_bin", "f_bin", F.round("psd", 6).alias("psd"), F.round("db", 4).alias("db"))


# --- filters by the definition of a convolution -------------------------------------
#
# A zero-phase filter is a convolution with an even kernel, the cosine transform of its
# gain. A block sees its chunk and HALO samples on each side.

GRID = 2_048


def blocks_sql(source: str) -> str:
    return f"""blocks AS (SELECT c.file_id, c.idx // {si.CHUNK_SAMPLES} AS chunk_id, min(c.idx) AS first_idx, CAST(count(*) AS INTEGER) AS n FROM {source} c GROUP BY 1, 2)"""



def kernel_sql(gains: str, keys: str = "") -> str:
    """Kernel values at all distances inside a block, from gains per frequency bin."""
    group = f"{keys}, d" if keys else "d"
    return f"""kern AS (SELECT {group}, sum(gain * cos(2 * pi() * k * d / {GRID}) * CASE WHEN k IN (0, {GRID // 2}) THEN 1 ELSE 2 END) / {GRID} AS g
  FROM {gains} CROSS JOIN (SELECT range AS d FROM range(0, {si.CHUNK_SAMPLES + HALO + 1})) GROUP BY {group})"""


def convolve_sql(source: str, keyed: bool) -> str:
    join = "k.file_id = b.file_id AND k.d = abs(o.idx - c.idx)" if keyed else "k.d = abs(o.idx - c.idx)"
    return f"""conv AS (SELECT b.file_id, b.chunk_id, b.first_idx, b.n, o.idx, sum(c.x * k.g) AS y
  FROM blocks b JOIN {source} o ON o.file_id = b.file_id AND o.idx // {si.CHUNK_SAMPLES} = b.chunk_id
  JOIN {source} c ON c.file_id = b.file_id AND c.idx BETWEEN b.first_idx - {HALO} AND b.first_idx + b.n - 1 + {HALO}
  JOIN kern k ON {join} GROUP BY ALL)"""


def stats_sql(source: str) -> str:
    return f"""SELECT file_id, chunk_id, first_idx, n, round(sum(y), 4) + 0.0 AS total, round(sum(y * y), 4) AS energy, round(max(y), 4) AS top
FROM {source} GROUP BY file_id, chunk_id, first_idx, n"""


def notch_sql(centre: float) -> str:
    w0 = 2 * math.pi * centre / RATE
    g = 1 / (1 + math.tan(w0 / 30.0 / 2))
    w = f"(2 * pi() * k / {GRID})"

    def square(c0, c1, c2):
        return (
            f"(pow({c0!r}::DOUBLE + {c1!r}::DOUBLE * cos({w}) + {c2!r}::DOUBLE * cos(2 * {w}), 2)"
            f" + pow({c1!r}::DOUBLE * sin({w}) + {c2!r}::DOUBLE * sin(2 * {w}), 2))"
        )

    return f"{square(g, -2 * g * math.cos(w0), g)} / {square(1.0, -2 * g * math.cos(w0), 2 * g - 1)}"


LOW, HIGH = 4.0, 20.0
EDGE1, EDGE2 = math.tan(math.pi * LOW / RATE), math.tan(math.pi * HIGH / RATE)


def bandpass_steps(source: str) -> str:
    """Detrending, band-pass and notches of a series as common table expressions ending in ``conv``."""
    return f"""flat AS (SELECT file_id, idx, x - avg(x) OVER (PARTITION BY file_id) AS x FROM {source}),
warped AS (SELECT range AS k, tan(pi() * least(CAST(range AS DOUBLE) / {GRID // 2}, 1 - 1e-12) / 2) AS w FROM range(0, {GRID // 2 + 1})),
gains AS (SELECT k, CASE WHEN w = 0 THEN 0 ELSE 1 / (1 + pow((w * w - {EDGE1 * EDGE2!r}::DOUBLE) / (w * {EDGE2 - EDGE1!r}::DOUBLE), 12)) END
  * {notch_sql(6.0)} * {notch_sql(12.0)} * {notch_sql(18.0)} AS gain FROM warped),
{kernel_sql('gains')}, {convolve_sql('flat', False)}"""


def whiten_steps(source: str, amplitude: str, floor: str) -> str:
    """Whitening by each file's own spectrum, interpolated on the grid of the block."""
    return f"""spec AS (SELECT file_id, bin, avg(psd) AS p FROM power GROUP BY file_id, bin),
floored AS (SELECT file_id, bin, greatest(p, {floor}) AS p FROM spec),
grid AS (SELECT range AS k, CAST(range AS DOUBLE) * {SEG} / {GRID} AS at FROM range(0, {GRID // 2 + 1})),
level AS (SELECT a.file_id, g.k, a.p + coalesce((b.p - a.p) * (g.at - a.bin), 0) AS p
  FROM grid g JOIN floored a ON a.bin = CAST(floor(g.at) AS INTEGER) LEFT JOIN floored b ON b.file_id = a.file_id AND b.bin = a.bin + 1),
gains AS (SELECT file_id, k, 1 / ({amplitude}) AS gain FROM level),
{kernel_sql('gains', 'file_id')}, {convolve_sql(source, True)},
z AS (SELECT file_id, chunk_id, first_idx, n, idx, (y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-12) AS y FROM conv WINDOW w AS (PARTITION BY file_id))"""


STANDARD = (f"greatest(sqrt(p * {RATE} / 2), 1e-12)", "1e-24")
BANDPASS_SQL = f"WITH {CLEAN_SQL}, {blocks_sql('clean')}, {bandpass_steps('clean')} {stats_sql('conv')}"
WHITEN_SQL = f"WITH {WELCH_SQL}, {blocks_sql('clean')}, {whiten_steps('clean', *STANDARD)} {stats_sql('z')}"
PLAIN = ("sqrt(p) + 1e-12", "1e-6 * median(p) OVER (PARTITION BY file_id)")
WHITEN_PLAIN_SQL = f"WITH {WELCH_SQL}, {blocks_sql('clean')}, {whiten_steps('clean', *PLAIN)} {stats_sql('conv')}"

# Kaiser window with shape 5 through the power series of the Bessel function.
UP, DOWN = 3, 4
HALF = 10 * max(UP, DOWN)


def bessel_sql(x: str) -> str:
    return f"list_sum(list_transform(range(0, 30), lambda m: pow(pow({x} / 2, m) / factorial(CAST(m AS INTEGER)), 2)))"




def resample_steps(source: str) -> str:
    """Polyphase resampling of a series as common table expressions ending in ``placed``."""
    return f"""taps AS (SELECT range AS t, CASE WHEN range = 0 THEN 1 ELSE sin(pi() * range / {max(UP, DOWN)}) / (pi() * range / {max(UP, DOWN)}) END
  * {bessel_sql(f'(5.0::DOUBLE * sqrt(1 - pow(CAST(range AS DOUBLE) / {HALF}, 2)))')} AS h FROM range(-{HALF}, {HALF} + 1)),
scaled AS (SELECT t, h / sum(h) OVER () * {UP} AS h FROM taps),
outs AS (SELECT file_id, unnest(range(0, ((max(idx) + 1) * {UP} + {DOWN - 1}) // {DOWN})) AS m FROM {source} GROUP BY file_id),
out_y AS (SELECT o.file_id, o.m, sum(c.x * s.h) AS y FROM outs o JOIN {source} c ON c.file_id = o.file_id AND abs(c.idx * {UP} - o.m * {DOWN}) <= {HALF}
  JOIN scaled s ON s.t = c.idx * {UP} - o.m * {DOWN} GROUP BY o.file_id, o.m),
placed AS (SELECT file_id, (m * {DOWN}) // {UP} // {si.CHUNK_SAMPLES} AS chunk_id, m, y FROM out_y)"""


RESAMPLE_SQL = f"""WITH {CLEAN_SQL}, {resample_steps('clean')}
SELECT file_id, chunk_id, min(m) AS first_idx, CAST(count(*) AS INTEGER) AS n, round(sum(y), 4) + 0.0 AS total, round(sum(y * y), 4) AS energy, round(max(y), 4) AS top
FROM placed GROUP BY file_id, chunk_id"""


def _renamed(steps: str) -> str:
    """The band-pass steps under names of their own, so that whitening can follow."""
    for name in ("flat", "warped", "gains", "kern", "conv"):
        steps = re.sub(rf"\b{name}\b", f"bp_{name}", steps)
    return steps


PREPROCESS_SQL = f"""WITH {GOOD_SQL},
share AS (SELECT file_id, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS bad_frac, count(*) AS n_samples FROM strain GROUP BY file_id HAVING bad_frac <= 0.3),
bad AS (SELECT file_id, idx, idx - row_number() OVER (PARTITION BY file_id ORDER BY idx) AS island FROM strain WHERE x IS NULL),
runs AS (SELECT file_id, count(*) AS len FROM bad GROUP BY file_id, island),
gap_stats AS (SELECT file_id, sum(len) AS n_interp, count(*) FILTER (len > {2 * si.SERIES_FS}) AS n_big_gaps FROM runs GROUP BY file_id),
kept AS (SELECT f.file_id, f.idx, f.filled AS x FROM filled f JOIN share USING (file_id)),
{blocks_sql('kept')}, {_renamed(bandpass_steps('kept'))},
passed AS (SELECT file_id, idx, y AS x FROM bp_conv),
{segments_sql('passed')}, {WELCH_DFT}, {whiten_steps('passed', *STANDARD)},
white AS (SELECT file_id, idx, y AS x FROM z), {resample_steps('white')},
result AS (SELECT file_id, CAST(count(*) AS BIGINT) AS n_out, round(sum(y * y), 3) AS energy, round(max(y), 4) AS top FROM placed GROUP BY file_id)
SELECT r.*, round(s.bad_frac, 6) AS nan_frac, CAST(s.n_samples AS BIGINT) AS n_samples, CAST(coalesce(g.n_interp, 0) AS BIGINT) AS n_interp,
       CAST(coalesce(g.n_big_gaps, 0) AS BIGINT) AS n_big_gaps
FROM result r JOIN share s ON s.file_id = r.file_id LEFT JOIN gap_stats g ON g.file_id = r.file_id"""


# --- weighted matched filter by the definition of the transform ----------------------

MF_SEG, MF_BANDS, MF_LOW, MF_SHIFT = 32, 4, 2.0, 0.1
N = 64
MF_SQL = f"""WITH {si.WAVES_SQL},
samples AS (SELECT window_id, unnest(range(0, {N})) AS i, unnest(wave) AS x FROM wave_windows),
cuts AS (SELECT window_id, s.range AS start, x.i - s.range AS i, x.x FROM samples x JOIN range(0, {N - MF_SEG + 1}, {MF_SEG // 2}) s ON x.i BETWEEN s.range AND s.range + {MF_SEG - 1}),
tapered AS (SELECT window_id, start, i, x - avg(x) OVER (PARTITION BY window_id, start) AS v, 0.5 - 0.5 * cos(2 * pi() * i / {MF_SEG}) AS h FROM cuts),
pgram AS (SELECT window_id, start, b.range AS bin, (pow(sum(v * h * cos(2 * pi() * b.range * i / {MF_SEG})), 2) + pow(sum(v * h * sin(2 * pi() * b.range * i / {MF_SEG})), 2))
    / ({float(N)} * sum(h * h)) * CASE WHEN b.range IN (0, {MF_SEG // 2}) THEN 1 ELSE 2 END AS p FROM tapered CROSS JOIN range(0, {MF_SEG // 2 + 1}) b GROUP BY window_id, start, b.range),
psd AS (SELECT window_id, bin, greatest(avg(p), 1e-24) AS p FROM pgram GROUP BY window_id, bin),
level AS (SELECT a.window_id, f.range AS k, a.p + coalesce((b.p - a.p) * (f.range / 2.0::DOUBLE - a.bin), 0) AS s
  FROM range({int(MF_LOW)}, {N // 2 + 1}) f JOIN psd a ON a.bin = f.range // 2 LEFT JOIN psd b ON b.window_id = a.window_id AND b.bin = a.bin + 1),
xf AS (SELECT window_id, f.range AS k, sum(x * cos(2 * pi() * f.range * i / {N})) / {N} AS re, -sum(x * sin(2 * pi() * f.range * i / {N})) / {N} AS im
  FROM samples CROSS JOIN range({int(MF_LOW)}, {N // 2 + 1}) f GROUP BY window_id, f.range),
tsamples AS (SELECT template_id, unnest(range(0, {N})) AS i, unnest(wave) AS x FROM templates),
hf AS (SELECT template_id, f.range AS k, sum(x * cos(2 * pi() * f.range * i / {N})) / {N} AS re, -sum(x * sin(2 * pi() * f.range * i / {N})) / {N} AS im
  FROM tsamples CROSS JOIN range({int(MF_LOW)}, {N // 2 + 1}) f GROUP BY template_id, f.range),
prod AS (SELECT x.window_id, h.template_id, x.k, 4 * (h.re * h.re + h.im * h.im) / l.s AS power, 4 * (x.re * h.re + x.im * h.im) / l.s AS re, 4 * (x.im * h.re - x.re * h.im) / l.s AS im
  FROM xf x JOIN level l ON l.window_id = x.window_id AND l.k = x.k JOIN hf h ON h.k = x.k),
banded AS (SELECT *, sum(power) OVER (PARTITION BY window_id, template_id) AS s2,
    least(CAST(floor(sum(power) OVER (PARTITION BY window_id, template_id ORDER BY k) / sum(power) OVER (PARTITION BY window_id, template_id) * {MF_BANDS} - 1e-9) AS INTEGER), {MF_BANDS - 1}) AS band FROM prod),
zb AS (SELECT window_id, template_id, t.range AS t, band, any_value(s2) AS s2, sum(re * cos(2 * pi() * k * t.range / {N}) - im * sin(2 * pi() * k * t.range / {N})) AS re,
    sum(re * sin(2 * pi() * k * t.range / {N}) + im * cos(2 * pi() * k * t.range / {N})) AS im
  FROM banded CROSS JOIN range({N // 2 - int(MF_SHIFT * N)}, {N // 2 + int(MF_SHIFT * N) + 1}) t GROUP BY window_id, template_id, t.range, band),
zt AS (SELECT window_id, template_id, t, any_value(s2) AS s2, sum(re) AS re, sum(im) AS im, sum(re * re + im * im) AS within, count(*) AS bands FROM zb GROUP BY window_id, template_id, t),
snr AS (SELECT window_id, template_id, sqrt((re * re + im * im) / s2) AS snr, (within - (re * re + im * im) / {MF_BANDS}) * {MF_BANDS} / s2 / {2 * MF_BANDS - 2} AS chi FROM zt),
weighted AS (SELECT *, snr / CASE WHEN chi > 1 THEN pow((1 + pow(chi, 3)) / 2, 1.0::DOUBLE / 6) ELSE 1 END AS new_snr FROM snr)
SELECT window_id, round(max(new_snr), 6) AS new_snr, round(max(snr), 6) AS snr, CAST(count(DISTINCT template_id) AS BIGINT) AS n FROM weighted GROUP BY window_id"""


def _chunk_stats(chunks):
    """Length and rounded statistics of each chunk."""
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    energy = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v)
    return chunks.select(
        "file_id", "chunk_id", "first_idx", F.size("samples").alias("n"),
        (F.round(total, 4) + 0.0).alias("total"), F.round(energy, 4).alias("energy"), F.round(F.array_max("samples"), 4).alias("top"),
    )


@query("bandpass", BANDPASS_SQL)
def bandpass(spark, sf_dir):
    blocks = signal.with_halo(signal.standardized(clean_chunks(spark, sf_dir), centre_only=True), HALO)
    return _chunk_stats(signal.core(signal.filtered(blocks, RATE, LOW, HIGH, notch_base=6.0, notch_count=3)))


@query("whiten", WHITEN_SQL)
def whiten(spark, sf_dir):
    return _chunk_stats(signal.whiten(clean_chunks(spark, sf_dir), si.CHUNK_SAMPLES, RATE, SEG, HOP, HALO))


@query("whiten_plain", WHITEN_PLAIN_SQL)
def whiten_plain(spark, sf_dir):
    return _chunk_stats(signal.whiten(clean_chunks(spark, sf_dir), si.CHUNK_SAMPLES, RATE, SEG, HOP, HALO, "plain"))


@query("resample", RESAMPLE_SQL)
def resample(spark, sf_dir):
    up, down = signal.rational_ratio(48, RATE)
    return _chunk_stats(signal.resampled(clean_chunks(spark, sf_dir), up, down, HALO))


@query("preprocess", PREPROCESS_SQL)
def preprocess(spark, sf_dir):
    white, stats = signal.preprocess(
        si.strain_chunks(spark, sf_dir), si.CHUNK_SAMPLES, RATE, 4.0, 20.0, SEG, HOP, HALO, notch_base=6.0, notch_count=3, target_rate=48
    )
    out = _chunk_stats(white).groupBy("file_id").agg(
        F.sum("n").alias("n_out"), F.round(F.sum("energy"), 3).alias("energy"), F.round(F.max("top"), 4).alias("top")
    )
    return out.join(stats.withColumn("nan_frac", F.round("nan_frac", 6)), "file_id")


@query("reweighted_snr", MF_SQL)
def reweighted_snr(spark, sf_dir):
    out = signal.best_reweighted_snr(si.wave_windows(spark, sf_dir), si.templates(spark, sf_dir), float(N), MF_LOW, MF_SEG, MF_BANDS, MF_SHIFT)
    return out.select("window_id", F.round("new_snr", 6).alias("new_snr"), F.round("snr", 6).alias("snr"), "n")


# The leading direction of a covariance matrix is the limit of its normalized powers;
# repeated squaring reaches a very high power in a few steps.
SQUARINGS = 18


def leading_sql(name: str, source: str) -> str:
    return f"""{name}_pow(i, m) AS (
  SELECT 0, m FROM {source} UNION ALL
  SELECT i + 1, list_transform(s, lambda r: list_transform(r, lambda v: v / t)) FROM (
    SELECT i, s, list_sum(list_transform(range(1, len(s) + 1), lambda j: s[j][j])) AS t FROM (
      SELECT i, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS s FROM {name}_pow WHERE i < {SQUARINGS}))),
{name}_last AS (SELECT m FROM {name}_pow WHERE i = {SQUARINGS}),
{name}_col AS (SELECT m[list_position(d, list_max(d))] AS c FROM (SELECT m, list_transform(range(1, len(m) + 1), lambda j: m[j][j]) AS d FROM {name}_last)),
{name}_unit AS (SELECT list_transform(c, lambda v: v / sqrt(list_dot_product(c, c))) AS u FROM {name}_col),
{name}_axis AS (SELECT list_transform(u, lambda v: v * sign(u[list_position(list_transform(u, lambda w: abs(w)), list_max(list_transform(u, lambda w: abs(w))))])) AS u FROM {name}_unit)"""


PCA_SQL = f"""WITH RECURSIVE vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
long_v AS (SELECT vec_id, unnest(range(1, len(e) + 1)) AS j, unnest(e) AS v FROM vec),
centred AS (SELECT vec_id, j, v - avg(v) OVER (PARTITION BY j) AS v FROM long_v),
wide AS (SELECT vec_id, list(v ORDER BY j) AS x FROM centred GROUP BY vec_id),
dims AS (SELECT j, list(v ORDER BY vec_id) AS col FROM centred GROUP BY j),
cov AS (SELECT list(r ORDER BY j) AS m FROM (SELECT a.j, list(list_dot_product(a.col, b.col) ORDER BY b.j) AS r FROM dims a CROSS JOIN dims b GROUP BY a.j)),
{leading_sql('one', 'cov')},
rest AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * u[i] * u[j])) AS m
  FROM (SELECT m, u, list_dot_product(u, list_transform(m, lambda r: list_dot_product(r, u))) AS l FROM cov CROSS JOIN one_axis)),
{leading_sql('two', 'rest')}
SELECT w.vec_id, v.label, round(list_dot_product(w.x, a.u), 6) + 0.0 AS pc1, round(list_dot_product(w.x, b.u), 6) + 0.0 AS pc2
FROM wide w JOIN vec v ON v.vec_id = w.vec_id CROSS JOIN one_axis a CROSS JOIN two_axis b"""


@query("pca_2d", PCA_SQL)
def pca_2d(spark, sf_dir):
    vectors = array_to_vector(F.col("embedding").cast("array<double>")).alias("v")
    rows = si.table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors)
    out = principal_components(rows, "v", ["vec_id", "label"])
    return out.select("vec_id", "label", *[(F.round(c, 6) + 0.0).alias(c) for c in ("pc1", "pc2")])
