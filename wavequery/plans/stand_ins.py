"""Domain tables derived from the input tables, as DataFrames and as SQL.

Each ``*_SQL`` text is a list of common table expressions that builds the same
rows as the function of the same name, so that queries and oracles share inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequery.operators import gaps
from wavequery.operators.frames import frame_features, series_extent
from wavequery.session import scratch_path, table
from wavequery.sources import strain as sources

SECOND_US = 1_000_000

# Sliding frames over the event values of one user.
FRAME_US = 21_600 * SECOND_US
STRIDE_US = 5_400 * SECOND_US

# Label margins before and after an event of the catalogue.
PRE_US = 1_200 * SECOND_US
POS_US = 1_800 * SECOND_US

# Sampled series: one file holds this many consecutive samples, one chunk a quarter of it.
FILE_SAMPLES = 2_000
CHUNK_SAMPLES = 500
SERIES_FS = 64


def time_us(column: str) -> Column:
    """Microseconds since the epoch of a timestamp without time zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


# --- triggers -----------------------------------------------------------------

TRIGGERS_SQL = """
triggers AS (
  SELECT event_id, epoch_us(ts) AS t_us, value AS score, user_id AS file_id,
         CASE event_type WHEN 'click' THEN 'H1' WHEN 'view' THEN 'L1' ELSE 'V1' END AS detector
  FROM events)"""


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate triggers of three detectors: time, score and file."""
    detector = F.when(F.col("event_type") == "click", "H1").when(F.col("event_type") == "view", "L1").otherwise("V1")
    return table(spark, sf_dir, "events").select(
        "event_id",
        time_us("ts").alias("t_us"),
        F.col("value").alias("score"),
        F.col("user_id").alias("file_id"),
        detector.alias("detector"),
    )


# --- catalogue ----------------------------------------------------------------

CATALOG_SQL = """
catalog AS (SELECT event_id AS event, epoch_us(ts) AS tc_us FROM events WHERE event_type = 'purchase')"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event catalogue: one reference time per event."""
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'purchase'")
        .select(F.col("event_id").alias("event"), time_us("ts").alias("tc_us"))
    )


# --- windows ------------------------------------------------------------------

WINDOWS_SQL = f"""
pts AS (SELECT user_id AS file_id, epoch_us(ts) AS t_us, value AS x FROM events),
extent AS (SELECT file_id, min(t_us) AS origin_us, max(t_us) AS last_us FROM pts GROUP BY file_id),
spread AS (
  SELECT p.file_id, e.origin_us, e.last_us, p.x,
         unnest(range((p.t_us - e.origin_us) // {STRIDE_US} - {FRAME_US // STRIDE_US - 1},
                      (p.t_us - e.origin_us) // {STRIDE_US} + 1)) AS frame
  FROM pts p JOIN extent e USING (file_id)),
raw_windows AS (
  SELECT file_id, frame * {STRIDE_US} + origin_us AS start_us,
         frame * {STRIDE_US} + origin_us + {FRAME_US} AS end_us, count(*) AS n,
         sqrt(avg(x * x) + 1e-12) AS snr_rms, max(abs(x)) AS snr_peak
  FROM spread WHERE frame >= 0 AND frame * {STRIDE_US} + origin_us + {FRAME_US} <= last_us
  GROUP BY file_id, frame, origin_us),
windows AS (
  SELECT file_id, start_us, end_us, n, round(snr_rms, 6) AS snr_rms, round(snr_peak, 6) AS snr_peak,
         round(greatest(snr_peak / CASE WHEN abs(snr_rms) < 1e-12 THEN 1e-12 ELSE snr_rms END, 0), 6) AS crest_factor
  FROM raw_windows)"""


def windows(spark: SparkSession, sf_dir: str, snr_threshold: float | None = None) -> DataFrame:
    """Sliding frames with features, one series per user."""
    points = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), time_us("ts").alias("t_us"), F.col("value").alias("x")
    )
    out = frame_features(
        points, series_extent(points, "file_id", "t_us"), "file_id", "t_us", "x", FRAME_US, STRIDE_US, snr_threshold
    )
    return out.withColumns({c: F.round(c, 6) for c in ("snr_rms", "snr_peak", "crest_factor")})


# --- sampled series -----------------------------------------------------------

STRAIN_SQL = f"""
strain AS (
  SELECT event_id // {FILE_SAMPLES} AS file_id, event_id % {FILE_SAMPLES} AS idx,
         event_id % {FILE_SAMPLES} // {CHUNK_SAMPLES} AS chunk_id,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x
  FROM events)"""


def strain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled series in long form; samples of type ``error`` are gaps."""
    position = F.expr(f"event_id % {FILE_SAMPLES}")
    return table(spark, sf_dir, "events").select(
        F.expr(f"event_id div {FILE_SAMPLES}").alias("file_id"),
        position.alias("idx"),
        F.expr(f"event_id % {FILE_SAMPLES} div {CHUNK_SAMPLES}").alias("chunk_id"),
        F.when(F.col("event_type") == "error", None).otherwise(F.col("value")).alias("x"),
    )


def strain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled series as chunks."""
    return gaps.chunked(strain(spark, sf_dir))


def clean_strain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same series without gaps."""
    return table(spark, sf_dir, "events").select(
        F.expr(f"event_id div {FILE_SAMPLES}").alias("file_id"),
        F.expr(f"event_id % {FILE_SAMPLES}").alias("idx"),
        F.expr(f"event_id % {FILE_SAMPLES} div {CHUNK_SAMPLES}").alias("chunk_id"),
        F.col("value").alias("x"),
    )


STRAIN_SOURCE_SQL = f"""{STRAIN_SQL},
dead AS (SELECT file_id, idx, CASE WHEN file_id % 5 = 4 AND idx BETWEEN 1000 AND 1299 THEN NULL ELSE x END AS x FROM strain),
heads AS (SELECT file_id, ['H1', 'L1', 'V1'][1 + file_id % 3] AS detector, (1126257414 + 100 * file_id) * 1000000 AS gps_start_us,
            CASE WHEN file_id % 4 < 3 THEN {SERIES_FS} END AS fs, max(idx) + 1 AS n_samples FROM strain GROUP BY file_id)"""


def strain_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strain table written once and read back; every fifth file has a dead stretch, every fourth tells no rate."""
    series = strain(spark, sf_dir)
    dead = (F.col("file_id") % 5 == 4) & F.col("idx").between(1000, 1299)
    series = series.withColumn("x", F.when(~dead, F.col("x")))
    f = F.col("file_id") % 4
    heads = series.groupBy("file_id").agg((F.max("idx") + 1).alias("n_samples")).select(
        "file_id", "n_samples",
        F.element_at(F.array(*map(F.lit, ("H1", "L1", "V1"))), (F.col("file_id") % 3 + 1).cast("int")).alias("detector"),
        ((1_126_257_414 + 100 * F.col("file_id")) * SECOND_US).alias("gps_start_us"),
        F.when(f == 0, SERIES_FS).alias("fs_attr"),
        F.when(f == 1, SERIES_FS).alias("sample_rate_attr"),
        F.when(f == 2, 1.0 / SERIES_FS).alias("spacing_attr"),
    )
    path = scratch_path(spark, "strain")
    sources.write_strain(sources.strain_table(series, heads, CHUNK_SAMPLES), path)
    return sources.read_strain(spark, path)


# --- scores -------------------------------------------------------------------

SCORES_SQL = """
scores AS (
  SELECT l.doc_id, d.source AS file_id, l.doc_id * 500000 AS start_us, l.quality AS label,
         CAST(d.n_chars % 97 AS DOUBLE) / 97 AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored windows of one model over the labelled documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return (
        table(spark, sf_dir, "labels")
        .select("doc_id", "quality")
        .join(documents, "doc_id")
        .select(
            "doc_id",
            F.col("source").alias("file_id"),
            (F.col("doc_id") * 500_000).alias("start_us"),
            F.col("quality").alias("label"),
            ((F.col("n_chars") % 97).cast("double") / 97).alias("score"),
        )
    )


EVENT_SCORES_SQL = """
event_scores AS (
  SELECT event_id, user_id AS file_id, epoch_us(ts) AS start_us,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, value AS score
  FROM events)"""


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored windows over the events: positives are the purchases."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("file_id"),
        time_us("ts").alias("start_us"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
        F.col("value").alias("score"),
    )


LINE_SCORES_SQL = """
line_scores AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_extendedprice AS score FROM lineitem)"""


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest score table: one row per line item, positives are the returns."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), F.col("l_extendedprice").alias("score")
    )


# --- strain files -------------------------------------------------------------

STRAIN_FILES_SQL = """
file_parts AS (
  SELECT p_partkey, p_size, p_brand, p_type,
         CASE p_size % 4 WHEN 0 THEN 'H1' WHEN 1 THEN 'L1' WHEN 2 THEN 'V1' ELSE 'K1' END AS det,
         CASE WHEN p_type = 'SMALL' THEN '16KHZ' ELSE '4KHZ' END AS rate,
         CASE WHEN p_brand = 'Brand#2' THEN '32' ELSE '4096' END AS dur
  FROM part),
strain_files AS (
  SELECT p_partkey AS file_no, p_brand AS event,
         substr(det, 1, 1) || '-' || det || '_SITE_' || rate || '_R1-' || CAST(1126257414 + p_partkey AS VARCHAR)
           || '-' || dur || '.hdf5' AS fname,
         CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 8388608 END AS bytes
  FROM file_parts)"""


def strain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File catalogue: event, file name and size (null when unknown)."""
    size = F.col("p_size") % 4
    det = F.when(size == 0, "H1").when(size == 1, "L1").when(size == 2, "V1").otherwise("K1")
    rate = F.when(F.col("p_type") == "SMALL", "16KHZ").otherwise("4KHZ")
    dur = F.when(F.col("p_brand") == "Brand#2", "32").otherwise("4096")
    start = (F.lit(1_126_257_414) + F.col("p_partkey")).cast("string")
    name = F.concat(det.substr(1, 1), F.lit("-"), det, F.lit("_SITE_"), rate, F.lit("_R1-"), start, F.lit("-"), dur, F.lit(".hdf5"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("file_no"),
        F.col("p_brand").alias("event"),
        name.alias("fname"),
        F.when(F.col("p_size") % 5 == 0, None).otherwise(F.col("p_size").cast("long") * 8_388_608).alias("bytes"),
    )


# --- waveforms ----------------------------------------------------------------

WAVES_SQL = """
templates AS (
  SELECT vec_id AS template_id, CAST(embedding AS DOUBLE[]) AS wave FROM embeddings WHERE label = 0),
wave_windows AS (
  SELECT vec_id AS window_id, label, CAST(embedding AS DOUBLE[]) AS wave FROM embeddings WHERE label <> 0)"""


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template bank: the vectors of class 0."""
    return table(spark, sf_dir, "embeddings").where("label = 0").select(
        F.col("vec_id").alias("template_id"), F.col("embedding").cast("array<double>").alias("wave")
    )


def wave_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened windows: the vectors of every other class."""
    return table(spark, sf_dir, "embeddings").where("label <> 0").select(
        F.col("vec_id").alias("window_id"), "label", F.col("embedding").cast("array<double>").alias("wave")
    )
