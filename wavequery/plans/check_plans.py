"""Filter, check and veto queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequery.functions import arrays as ar
from wavequery.operators import checks as ck
from wavequery.operators import loading as ld
from wavequery.plans import stand_ins as si
from wavequery.plans.registry import query
from wavequery.plans.split_sql import HASH_SPLIT_CASE, hash_subset
from wavequery.sources import files as fl
from wavequery.sources import strain as sr


@query("semi_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL')")
def semi_filter(spark, sf_dir):
    index = si.table(spark, sf_dir, "part").where("p_type = 'SMALL'").select(F.col("p_partkey").alias("l_partkey"))
    line = si.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return line.join(index, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "dataset_checks",
    f"""WITH {si.EVENT_SCORES_SQL}, d AS (SELECT label, {HASH_SPLIT_CASE} AS subset FROM event_scores),
t AS (SELECT count(*) FILTER (label IS NULL) AS nl, count(*) FILTER (label NOT IN (0, 1)) AS ol, count(*) FILTER (subset = 'train') AS tr,
             count(*) FILTER (subset = 'val') AS va, count(*) FILTER (subset = 'test') AS te FROM d)
SELECT 'required_columns' AS "check", 0 AS ok, 'window_sec' AS detail FROM t
UNION ALL SELECT 'labels_not_null', CAST(nl = 0 AS INTEGER), CAST(nl AS VARCHAR) FROM t
UNION ALL SELECT 'labels_binary', CAST(ol = 0 AS INTEGER), CAST(ol AS VARCHAR) FROM t
UNION ALL SELECT 'has_val_or_test', CAST(va + te > 0 AS INTEGER), CAST(va + te AS VARCHAR) FROM t
UNION ALL SELECT 'has_train_or_val', CAST(tr + va > 0 AS INTEGER), CAST(tr + va AS VARCHAR) FROM t
UNION ALL SELECT 'min_rows_val', CAST(va >= 20 AS INTEGER), CAST(va AS VARCHAR) FROM t
UNION ALL SELECT 'min_rows_test', CAST(te >= 100000000 AS INTEGER), CAST(te AS VARCHAR) FROM t""",
)
def dataset_checks(spark, sf_dir):
    data = hash_subset(si.event_scores(spark, sf_dir))
    required = {"file_id", "start_us", "label", "subset", "window_sec"}
    return ck.dataset_checks(data, required, {"val": 20, "test": 100_000_000})


@query("candidates", f"WITH {si.EVENT_SCORES_SQL} SELECT event_id, file_id, start_us, score FROM event_scores WHERE score >= 150 ORDER BY score DESC, event_id")
def candidates(spark, sf_dir):
    rows = si.event_scores(spark, sf_dir).where("score >= 150")
    return rows.select("event_id", "file_id", "start_us", "score").orderBy(F.desc("score"), "event_id")


Z_STEPS = f"""long_w AS (SELECT window_id, unnest(wave) AS v FROM wave_windows),
mv AS (SELECT window_id, avg(v) AS m, stddev_pop(v) AS s FROM long_w GROUP BY window_id),
z AS (SELECT window_id, (v - m) / (s + 1e-12) AS z FROM long_w JOIN mv USING (window_id)),
stats AS (SELECT window_id, max(abs(z)) AS peak, avg(z * z * z * z) AS kurt FROM z GROUP BY window_id)"""
Z_STATS_SQL = f"{si.WAVES_SQL}, {Z_STEPS}"

# Veto limits that suit 64-sample vectors; the library defaults are 20 and 80.
PEAK, KURT = 3.0, 3.6


@query(
    "glitch_veto",
    f"""WITH {Z_STATS_SQL} SELECT window_id, round(peak, 6) AS peak, round(kurt, 6) AS kurt,
       CASE WHEN peak > {PEAK} THEN 'glitch_veto_peak' WHEN kurt > {KURT} THEN 'glitch_veto_kurt' END AS reason FROM stats""",
)
def glitch_veto(spark, sf_dir):
    stats = si.wave_windows(spark, sf_dir).select("window_id", ar.glitch_stats("wave").alias("g"))
    return ck.glitch_veto(stats.select("window_id", "g.peak", "g.kurt"), PEAK, KURT).select(
        "window_id", F.round("peak", 6).alias("peak"), F.round("kurt", 6).alias("kurt"), "reason"
    )


# Windows of two seconds every half second over strain files with dead stretches; limits at which both vetoes occur.
LOAD_S, LOAD_STRIDE = 2.0, 32
LOAD_PEAK, LOAD_KURT = 5.0, 9.0
LOAD_LEN = int(LOAD_S * si.SERIES_FS)

LOADED_SQL = f"""{si.STRAIN_SOURCE_SQL},
w AS (SELECT d.file_id, d.idx AS start_idx, (d.file_id + d.idx // {LOAD_STRIDE}) % 10 = 0 AS moved FROM dead d WHERE d.idx % {LOAD_STRIDE} = 0),
j AS (SELECT w.file_id, w.start_idx, w.moved, h.fs, h.n_samples, count(d.x) AS good, avg(d.x) AS m, sqrt(var_pop(d.x) * count(d.x) / count(*)) AS s
      FROM w JOIN heads h USING (file_id) LEFT JOIN dead d ON d.file_id = w.file_id AND d.idx BETWEEN w.start_idx AND w.start_idx + {LOAD_LEN - 1}
      GROUP BY ALL),
k AS (SELECT j.file_id, j.start_idx, max(abs((d.x - m) / s)) AS peak, sum(pow((d.x - m) / s, 4)) / {LOAD_LEN} AS kurt
      FROM j JOIN dead d ON d.file_id = j.file_id AND d.idx BETWEEN j.start_idx AND j.start_idx + {LOAD_LEN - 1} GROUP BY ALL),
r AS (SELECT j.file_id, j.start_idx, CASE WHEN moved THEN 'miss_sgps' WHEN fs IS NULL THEN 'fs_unknown'
        WHEN start_idx + {LOAD_LEN} > n_samples THEN 'out_of_bounds' WHEN good = 0 THEN 'non_finite'
        WHEN peak > {LOAD_PEAK} THEN 'glitch_veto_peak' WHEN kurt > {LOAD_KURT} THEN 'glitch_veto_kurt' END AS reason
      FROM j JOIN k USING (file_id, start_idx))"""


def wanted_windows(strain):
    """Every window start of a strain table; some times are a little off, so that no window begins there."""
    index = sr.window_index(strain, LOAD_STRIDE)
    at = F.expr(f"(file_id + start_idx div {LOAD_STRIDE}) % 10 = 0")
    # A file without a rate has no absolute times of its windows: sample numbers stand in.
    time = F.coalesce("start_us", "start_idx")
    index = index.withColumn("start_us", time)
    number = F.col("file_id") * 1_000_000 + F.col("start_idx")
    wanted = index.select(number.alias("window_id"), "file_id", F.when(at, time + 7).otherwise(time).alias("start_us"))
    return wanted, index


def loaded(spark, sf_dir):
    """All windows of the strain files, with samples or a reason."""
    strain = si.strain_source(spark, sf_dir)
    wanted, index = wanted_windows(strain)
    return ld.loaded_windows(wanted, index, strain, LOAD_S, si.SERIES_FS, LOAD_PEAK, LOAD_KURT)


def reject_rows(spark, sf_dir):
    start = F.col("window_id") % 1_000_000
    return loaded(spark, sf_dir).select("file_id", start.alias("start_idx"), "reason")


@query("reject_reasons", f"WITH {LOADED_SQL} SELECT reason, CAST(count(*) AS BIGINT) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def reject_reasons(spark, sf_dir):
    return ck.reason_counts(reject_rows(spark, sf_dir))


@query(
    "reject_samples",
    f"""WITH {LOADED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY file_id, start_idx) AS rn FROM r WHERE reason IS NOT NULL)
SELECT file_id, start_idx, reason, CAST(rn AS INTEGER) AS rn FROM ranked WHERE rn <= 3""",
)
def reject_samples(spark, sf_dir):
    return ck.reason_samples(reject_rows(spark, sf_dir), ["file_id", "start_idx"])


@query("row_cap", f"""WITH {si.EVENT_SCORES_SQL}, d AS (SELECT event_id, {HASH_SPLIT_CASE} AS subset FROM event_scores),
r AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY event_id) AS rn FROM d)
SELECT event_id, subset FROM r WHERE rn <= 500""")
def row_cap(spark, sf_dir):
    data = hash_subset(si.event_scores(spark, sf_dir)).select("event_id", "subset")
    return ck.first_rows(data, "subset", ["event_id"], 500)


@query(
    "sweep_pending",
    """WITH grid AS (SELECT s_suppkey, d, t FROM supplier, range(0, 11) AS a(d), range(0, 9) AS b(t))
SELECT s_suppkey, d, t FROM grid WHERE NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND CAST(round(l_discount * 100) AS BIGINT) = d AND CAST(round(l_tax * 100) AS BIGINT) = t)""",
)
def sweep_pending(spark, sf_dir):
    suppliers = si.table(spark, sf_dir, "supplier").select("s_suppkey")
    grid = ck.parameter_grid(suppliers, d=list(range(11)), t=list(range(9)))
    logged = si.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"),
        F.round(F.col("l_discount") * 100).cast("long").alias("d"),
        F.round(F.col("l_tax") * 100).cast("long").alias("t"),
    )
    return fl.pending(grid, logged, ["s_suppkey", "d", "t"])
