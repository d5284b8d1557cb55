"""Frame, gap and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequery.operators import frames, gaps, signal
from wavequery.plans import stand_ins as si
from wavequery.plans.registry import query

SNR_MIN = 60.0


@query(
    "window_features",
    f"""WITH {si.WINDOWS_SQL} SELECT file_id, start_us, end_us, CAST(n AS BIGINT) AS n, snr_rms, snr_peak, crest_factor
FROM windows WHERE greatest(snr_rms, snr_peak) >= {SNR_MIN}""",
)
def window_features(spark, sf_dir):
    return si.windows(spark, sf_dir, SNR_MIN)


@query(
    "chunk_window_features",
    f"""WITH {si.STRAIN_SQL}, clean AS (SELECT event_id // {si.FILE_SAMPLES} AS file_id, event_id % {si.FILE_SAMPLES} AS idx, value AS x FROM events),
f AS (SELECT file_id, unnest(range(greatest(idx // 50 - 3, 0), idx // 50 + 1)) * 50 AS start_idx, x FROM clean),
a AS (SELECT file_id, start_idx, count(*) AS n, sqrt(avg(x * x) + 1e-12) AS rms, max(abs(x)) AS peak FROM f GROUP BY file_id, start_idx)
SELECT file_id, start_idx, round(rms, 6) AS snr_rms, round(peak, 6) AS snr_peak, round(greatest(peak / rms, 0), 6) AS crest_factor
FROM a WHERE n = 200""",
)
def chunk_window_features(spark, sf_dir):
    chunks = gaps.chunked(si.clean_strain(spark, sf_dir))
    out = frames.chunk_frame_features(chunks, window=200, stride=50)
    return out.withColumns({c: F.round(c, 6) for c in ("snr_rms", "snr_peak", "crest_factor")})


GOOD_SQL = f"""{si.STRAIN_SQL},
near AS (
  SELECT file_id, idx, chunk_id, x,
         max(CASE WHEN x IS NOT NULL THEN idx END) OVER (PARTITION BY file_id ORDER BY idx) AS pi,
         min(CASE WHEN x IS NOT NULL THEN idx END) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni
  FROM strain),
filled AS (
  SELECT n.file_id, n.idx, n.chunk_id, n.x,
         CASE WHEN n.x IS NOT NULL THEN n.x
              WHEN n.pi IS NOT NULL AND n.ni IS NOT NULL THEN p.x + (q.x - p.x) / (n.ni - n.pi) * (n.idx - n.pi)
              ELSE coalesce(p.x, q.x, 0.0) END AS filled
  FROM near n LEFT JOIN strain p ON p.file_id = n.file_id AND p.idx = n.pi
              LEFT JOIN strain q ON q.file_id = n.file_id AND q.idx = n.ni)"""


def by_sample(chunks, name="filled", *keep):
    """The rounded samples of a result, one row each."""
    rows = chunks.select("file_id", "first_idx", *keep, F.posexplode("samples").alias("_i", "_v"))
    return rows.select("file_id", (F.col("first_idx") + F.col("_i")).alias("idx"), (F.round("_v", 6) + 0.0).alias(name), *keep)


@query("gap_fill", f"WITH {GOOD_SQL} SELECT file_id, idx, round(filled, 6) AS filled FROM filled")
def gap_fill(spark, sf_dir):
    return by_sample(gaps.gap_fill(si.strain_chunks(spark, sf_dir)))


@query(
    "gap_runs",
    f"""WITH {si.STRAIN_SQL}, bad AS (SELECT file_id, idx, idx - row_number() OVER (PARTITION BY file_id ORDER BY idx) AS island FROM strain WHERE x IS NULL)
SELECT file_id, min(idx) AS run_start, CAST(count(*) AS BIGINT) AS run_length, CASE WHEN count(*) > 2 THEN 1 ELSE 0 END AS big
FROM bad GROUP BY file_id, island""",
)
def gap_runs(spark, sf_dir):
    return gaps.gap_runs(si.strain_chunks(spark, sf_dir), 2)


def policy_sql(keep: str, value: str) -> str:
    return f"""WITH {GOOD_SQL},
share AS (SELECT file_id, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS bad_frac FROM strain GROUP BY file_id)
SELECT f.file_id, f.idx, round({value}, 6) AS filled, round(s.bad_frac, 6) AS bad_frac
FROM filled f JOIN share s ON s.file_id = f.file_id WHERE {keep}"""


def _policy(spark, sf_dir, policy, max_frac):
    out = gaps.nan_policy(si.strain_chunks(spark, sf_dir), policy, max_frac)
    return by_sample(out.withColumn("bad_frac", F.round("bad_frac", 6)), "filled", "bad_frac")


@query("nan_policy", policy_sql("s.bad_frac <= 0.2::DOUBLE", "f.filled"))
def nan_policy(spark, sf_dir):
    return _policy(spark, sf_dir, "interp", 0.2)


@query("nan_policy_zero", policy_sql("s.bad_frac <= 0.3::DOUBLE", "coalesce(f.x, 0.0)"))
def nan_policy_zero(spark, sf_dir):
    return _policy(spark, sf_dir, "zero", 0.3)


@query(
    "detrend",
    f"""WITH clean AS (SELECT event_id // {si.FILE_SAMPLES} AS file_id, event_id % {si.FILE_SAMPLES} AS idx, value AS x FROM events)
SELECT file_id, idx, round(x - avg(x) OVER (PARTITION BY file_id), 6) + 0.0 AS detrended FROM clean""",
)
def detrend(spark, sf_dir):
    return by_sample(signal.standardized(gaps.chunked(si.clean_strain(spark, sf_dir)), centre_only=True), "detrended")


@query(
    "sample_times",
    f"""SELECT event_id // {si.FILE_SAMPLES} AS file_id, event_id % {si.FILE_SAMPLES} AS idx, value AS x,
       round(event_id // {si.FILE_SAMPLES} * 100.0 + (event_id % {si.FILE_SAMPLES}) / {float(si.SERIES_FS)}, 6) AS t_s FROM events""",
)
def sample_times(spark, sf_dir):
    chunks = gaps.chunked(si.clean_strain(spark, sf_dir))
    out = gaps.sample_times(chunks, si.SERIES_FS, F.col("file_id") * 100.0)
    return out.select("file_id", "idx", "x", F.round("t_s", 6).alias("t_s"))


# Windows of 128 samples every 90 samples; the last ones of a file run out of bounds.
@query(
    "window_slice",
    f"""WITH clean AS (SELECT event_id // {si.FILE_SAMPLES} AS file_id, event_id % {si.FILE_SAMPLES} AS idx, value AS x FROM events),
w AS (SELECT file_id, unnest(range(0, max(idx) + 1, 90)) AS start_idx FROM clean GROUP BY file_id),
s AS (SELECT w.file_id, w.start_idx, count(c.idx) AS n, sum(c.x) AS total, min_by(c.x, c.idx) AS head, max_by(c.x, c.idx) AS tail
      FROM w JOIN clean c ON c.file_id = w.file_id AND c.idx BETWEEN w.start_idx AND w.start_idx + 127 GROUP BY w.file_id, w.start_idx)
SELECT file_id, start_idx, CASE WHEN n = 128 THEN 1 ELSE 0 END AS usable, CASE WHEN n = 128 THEN round(total, 4) END AS total,
       CASE WHEN n = 128 THEN head END AS head, CASE WHEN n = 128 THEN tail END AS tail FROM s""",
)
def window_slice(spark, sf_dir):
    out = gaps.window_slices(slice_windows(spark, sf_dir), gaps.chunked(si.clean_strain(spark, sf_dir)), si.CHUNK_SAMPLES, 128)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return out.select(
        "file_id",
        "start_idx",
        F.col("samples").isNotNull().cast("int").alias("usable"),
        F.round(total, 4).alias("total"),
        F.get("samples", F.lit(0)).alias("head"),
        F.get("samples", F.lit(127)).alias("tail"),
    )


def slice_windows(spark, sf_dir, first=0, stride=90):
    """Window keys of each file: one window every ``stride`` samples."""
    lengths = si.clean_strain(spark, sf_dir).groupBy("file_id").agg(F.max("idx").alias("last_idx"))
    return lengths.select("file_id", F.explode(F.expr(f"sequence({first}L, last_idx, {stride}L)")).alias("start_idx"))
