"""Streaming queries, run over what is available and checked against the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequery.plans import stand_ins as si
from wavequery.plans.registry import query
from wavequery.streaming import full_frames, jobs

DT_US = 60 * si.SECOND_US
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def event_stream(spark, sf_dir):
    """The events as a stream with an event time that watermarks accept."""
    schema = si.table(spark, sf_dir, "events").schema
    stream = jobs.file_stream(spark, sf_dir, "events.parquet", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_window_features",
    f"""WITH f AS (SELECT user_id, value, unnest(range(epoch_us(ts) // {si.STRIDE_US} - {si.FRAME_US // si.STRIDE_US - 1}, epoch_us(ts) // {si.STRIDE_US} + 1)) AS frame FROM events)
SELECT user_id, frame * {si.STRIDE_US} AS start_us, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(value * value) + 1e-12), 6) AS snr_rms, round(max(abs(value)), 6) AS snr_peak
FROM f GROUP BY user_id, frame HAVING frame * {si.STRIDE_US} + {si.FRAME_US} <= epoch_us({CLOSED})""",
)
def stream_window_features(spark, sf_dir):
    framed = jobs.frame_features(event_stream(spark, sf_dir), "user_id", "ts", "value", "6 hours", "90 minutes", "1 hour")
    out = jobs.run_available(framed)
    return out.select(
        "user_id", F.unix_micros("frame_start").alias("start_us"), "n",
        F.round("snr_rms", 6).alias("snr_rms"), F.round("snr_peak", 6).alias("snr_peak"),
    )


# The frames of the batch query that are closed when the stream ends.
@query(
    "stream_full_frames",
    f"""WITH {si.WINDOWS_SQL} SELECT file_id, start_us, end_us, CAST(n AS BIGINT) AS n, snr_rms, snr_peak, crest_factor
FROM windows WHERE end_us <= epoch_us({CLOSED})""",
)
def stream_full_frames(spark, sf_dir):
    points = event_stream(spark, sf_dir).select(F.col("user_id").alias("file_id"), "ts", "value")
    framed = full_frames.full_frames(points, "file_id", "ts", "value", si.FRAME_US, si.STRIDE_US, "1 hour")
    out = jobs.run_available(framed, state_store=full_frames.ROCKS_DB)
    return out.withColumns({c: F.round(c, 6) for c in ("snr_rms", "snr_peak", "crest_factor")})


@query(
    "stream_coinc",
    f"""WITH {si.TRIGGERS_SQL}
SELECT h.event_id AS h_id, l.event_id AS l_id, round(sqrt(h.score * h.score + l.score * l.score), 6) AS score_coinc
FROM triggers h JOIN triggers l ON abs(h.t_us - l.t_us) <= {DT_US} WHERE h.detector = 'H1' AND l.detector = 'L1'""",
)
def stream_coinc(spark, sf_dir):
    def side(kind, p):
        rows = event_stream(spark, sf_dir).where(F.col("event_type") == kind)
        return rows.select(F.col("event_id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts"), F.col("value").alias(f"{p}_score"))

    out = jobs.run_available(jobs.coincidences(side("click", "h"), side("view", "l"), DT_US, "h_ts", "l_ts", "10 minutes"))
    return out.select("h_id", "l_id", F.round(F.hypot("h_score", "l_score"), 6).alias("score_coinc"))


HOUR_US = 3_600 * si.SECOND_US


@query(
    "stream_pending",
    f"""WITH {si.CATALOG_SQL}
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM catalog c WHERE epoch_us(e.ts) + {HOUR_US} >= c.tc_us - {si.PRE_US} AND epoch_us(e.ts) <= c.tc_us + {si.POS_US})
       THEN 1 ELSE 0 END AS label FROM events e WHERE event_type <> 'purchase'""",
)
def stream_pending(spark, sf_dir):
    start = F.unix_micros("ts")
    windows = event_stream(spark, sf_dir).where("event_type <> 'purchase'").select(
        "event_id", start.alias("start_us"), (start + HOUR_US).alias("end_us")
    )
    labelled = jobs.labelled(windows, si.catalog(spark, sf_dir), si.PRE_US, si.POS_US, (HOUR_US, HOUR_US))
    return jobs.run_available(labelled).select("event_id", "label")


@query("stream_dedup", f"SELECT DISTINCT user_id, epoch_us(ts) // {HOUR_US} AS hour_no FROM events")
def stream_dedup(spark, sf_dir):
    rows = event_stream(spark, sf_dir).withColumn("hour_no", F.floor(F.unix_micros("ts") / HOUR_US).cast("long"))
    out = jobs.run_available(jobs.deduplicated(rows, ["user_id", "hour_no"], "ts", "1 hour"))
    return out.select("user_id", "hour_no")


@query(
    "stream_bursts",
    f"""WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 3 HOUR) AS end_us, CAST(count(*) AS BIGINT) AS n, max(value) AS peak FROM g
GROUP BY user_id, burst HAVING max(ts) + INTERVAL 3 HOUR <= {CLOSED}""",
)
def stream_bursts(spark, sf_dir):
    out = jobs.run_available(jobs.bursts(event_stream(spark, sf_dir), "user_id", "ts", "value", "3 hours", "1 hour"))
    return out.select(
        "user_id", F.unix_micros("burst_start").alias("start_us"), F.unix_micros("burst_end").alias("end_us"), "n", "peak"
    )


@query(
    "stream_activity",
    f"""SELECT event_type, epoch_us(ts) // {24 * HOUR_US} AS day_no, CAST(count(*) AS BIGINT) AS n FROM events
GROUP BY event_type, epoch_us(ts) // {24 * HOUR_US} HAVING (day_no + 1) * {24 * HOUR_US} <= epoch_us({CLOSED})""",
)
def stream_activity(spark, sf_dir):
    out = jobs.run_available(jobs.activity(event_stream(spark, sf_dir), "event_type", "ts", "1 day", "1 hour"))
    return out.select("event_type", F.floor(F.unix_micros("bin_start") / (24 * HOUR_US)).alias("day_no"), "n")
