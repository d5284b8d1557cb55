"""Whole flows: dataset build, template scoring run, candidate run, report and score files."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequery.operators import loading as ld
from wavequery.operators import ranking as rk
from wavequery.operators import splits as sp
from wavequery.operators import templates as tp
from wavequery.operators import thresholds as th
from wavequery.operators import timejoin as tj
from wavequery.plans import stand_ins as si
from wavequery.plans.check_plans import KURT, LOAD_LEN, LOADED_SQL, PEAK, Z_STEPS, loaded
from wavequery.plans.ranking_plans import SPLIT_SCORES_SQL, TARGET_FAR, points_sql
from wavequery.plans.registry import query
from wavequery.plans.split_plans import unit_sql
from wavequery.plans.split_sql import hash_subset, split_case
from wavequery.plans.template_plans import LAG_STEP, MAX_SHIFT, NCC_SQL, zlist_sql
from wavequery.plans.timejoin_plans import SLIDES_SQL, slide_table
from wavequery.session import cut_lineage, scratch_path
from wavequery.sources import tables as tb

TEST, VAL = 0.15, 0.15
WAVE_LEN = 64


def dataset(spark, sf_dir):
    """Frames with features, label and group-safe subset with minimum rows."""
    w = tj.interval_label(
        si.windows(spark, sf_dir), si.catalog(spark, sf_dir), si.PRE_US, si.POS_US, (si.FRAME_US, si.FRAME_US)
    )
    split = sp.group_split(w, "file_id", TEST, VAL).withColumn("key", F.concat_ws("|", "file_id", "start_us"))
    # Stored once: the minimum rule counts rows before it reassigns them.
    return sp.enforce_minimums(cut_lineage(split), "key", {"train": 200, "val": 60, "test": 60})


@query(
    "dataset_build",
    f"""WITH {si.WINDOWS_SQL}, {si.CATALOG_SQL},
grp AS (SELECT DISTINCT file_id FROM windows),
r AS (SELECT file_id, row_number() OVER (ORDER BY {unit_sql('file_id')}, file_id) AS rk, count(*) OVER () AS n FROM grp),
c AS (SELECT *, ceil({TEST}::DOUBLE * n) AS n_test FROM r),
s AS (SELECT file_id, CASE WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + ceil(({VAL}::DOUBLE / (1.0::DOUBLE - {TEST}::DOUBLE)) * (n - n_test)) THEN 'val' ELSE 'train' END AS subset FROM c)
SELECT w.file_id, w.start_us, w.crest_factor, s.subset,
       CASE WHEN EXISTS (SELECT 1 FROM catalog c WHERE w.end_us >= c.tc_us - {si.PRE_US} AND w.start_us <= c.tc_us + {si.POS_US}) THEN 1 ELSE 0 END AS label
FROM windows w JOIN s ON s.file_id = w.file_id""",
)
def dataset_build(spark, sf_dir):
    return dataset(spark, sf_dir).select("file_id", "start_us", "crest_factor", "subset", "label")


RUN_SPLIT = split_case("CAST(window_id AS VARCHAR)", 0.5, 0.5)
RATES_SQL = """round(CAST(tp AS DOUBLE) / greatest(tp + fp, 1), 6) AS precision, round(CAST(tp AS DOUBLE) / greatest(tp + fn, 1), 6) AS recall,
       round(CAST(fp AS DOUBLE) / greatest(fp + tn, 1), 6) AS fpr"""
COUNTS_SQL = """CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp"""


def confusion_sql(rows: str, threshold: str) -> str:
    return f"""conf AS (SELECT any_value(t.threshold) AS threshold, count(*) FILTER (label = 0 AND score < t.threshold) AS tn, count(*) FILTER (label = 0 AND score >= t.threshold) AS fp,
  count(*) FILTER (label = 1 AND score < t.threshold) AS fn, count(*) FILTER (label = 1 AND score >= t.threshold) AS tp FROM {rows} CROSS JOIN {threshold} t)"""


CONSTRAINED_SQL = f"""pick AS (SELECT threshold FROM points ORDER BY (fpr <= {TARGET_FAR}::DOUBLE) DESC, CASE WHEN fpr <= {TARGET_FAR}::DOUBLE THEN -tpr ELSE fpr END, -tpr, threshold DESC LIMIT 1)"""

# Correlations of the standardized windows.
Z_NCC_SQL = NCC_SQL.replace("lags AS (", f"zw AS (SELECT window_id, {zlist_sql('wave')} AS wave FROM wave_windows), lags AS (", 1).replace(
    "FROM wave_windows w CROSS JOIN", "FROM zw w CROSS JOIN"
)
TEMPLATE_RUN_CTE = f"""{Z_NCC_SQL}, {Z_STEPS}, m AS (SELECT window_id, template_id, max(v) AS s FROM c GROUP BY window_id, template_id),
ncc_scores AS (SELECT m.window_id, CASE WHEN any_value(peak) > {PEAK} OR any_value(kurt) > {KURT} THEN 0.0 ELSE round(max(s), 9) END AS score
  FROM m JOIN stats USING (window_id) GROUP BY m.window_id),
run_rows AS (SELECT n.window_id, n.score, CASE WHEN w.label <= 3 THEN 1 ELSE 0 END AS label, {RUN_SPLIT.replace('window_id', 'n.window_id')} AS subset
  FROM ncc_scores n JOIN wave_windows w ON w.window_id = n.window_id),
run_val AS (SELECT * FROM run_rows WHERE subset = 'val'), run_test AS (SELECT * FROM run_rows WHERE subset = 'test')"""


def template_scores(spark, sf_dir):
    """Best correlation of every window, with label and subset; a window that is vetoed scores 0."""
    windows = ld.checked_windows(si.wave_windows(spark, sf_dir), WAVE_LEN, PEAK, KURT)
    windows = windows.withColumn("label", (F.col("label") <= 3).cast("int"))
    scores = tp.pooled_scores(windows, si.templates(spark, sf_dir), 1, MAX_SHIFT, LAG_STEP, keep=("label", "reason"))
    rows = scores.select("window_id", F.round("score", 9).alias("score"), "label", "reason")
    return cut_lineage(sp.hash_split(rows, ["window_id"], 0.5, 0.5))


@query(
    "template_run",
    f"""WITH {points_sql('run_val', TEMPLATE_RUN_CTE)}, {CONSTRAINED_SQL}, {confusion_sql('run_test', 'pick')}
SELECT threshold, {COUNTS_SQL}, {RATES_SQL} FROM conf""",
)
def template_run(spark, sf_dir):
    rows = template_scores(spark, sf_dir)
    points = rk.operating_points(rows.where("subset = 'val'"))
    threshold = th.constrained(points, TARGET_FAR).first()["threshold"]
    out = th.confusion(rows.where("subset = 'test'"), threshold)
    rates = [F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr")]
    return out.select(F.lit(threshold).alias("threshold"), "tn", "fp", "fn", "tp", *rates)


# Templates are shorter than the windows of the strain files, so their end meets the end of the window.
@query(
    "strain_template_scores",
    f"""WITH {LOADED_SQL}, {si.WAVES_SQL},
zx AS (SELECT r.file_id, r.start_idx, list(CASE WHEN d.x IS NULL THEN 0.0 ELSE (d.x - m) / s END ORDER BY d.idx) AS wave
  FROM r JOIN j USING (file_id, start_idx) JOIN dead d ON d.file_id = r.file_id AND d.idx BETWEEN r.start_idx AND r.start_idx + {LOAD_LEN - 1}
  WHERE r.reason IS NULL GROUP BY r.file_id, r.start_idx),
cosines AS (SELECT file_id, start_idx, list_dot_product(zx.wave[{LOAD_LEN - WAVE_LEN + 1}:], t.wave)
    / (sqrt(list_dot_product(zx.wave, zx.wave)) * sqrt(list_dot_product(t.wave, t.wave)) + 1e-8) AS c FROM zx CROSS JOIN templates t),
best AS (SELECT *, row_number() OVER (PARTITION BY file_id, start_idx ORDER BY c DESC) AS rn FROM cosines),
pooled AS (SELECT file_id, start_idx, avg(c) AS score FROM best WHERE rn <= 3 GROUP BY file_id, start_idx)
SELECT file_id, start_idx, reason, round(coalesce(score, 0.0), 6) + 0.0 AS score FROM r LEFT JOIN pooled USING (file_id, start_idx)""",
)
def strain_template_scores(spark, sf_dir):
    zeros = F.array_repeat(F.lit(0.0), LOAD_LEN - WAVE_LEN)
    bank = si.templates(spark, sf_dir).withColumn("wave", F.concat(zeros, "wave"))
    out = tp.pooled_scores(loaded(spark, sf_dir), bank, 3, keep=("file_id", "reason"))
    start = F.col("window_id") % 1_000_000
    return out.select("file_id", start.alias("start_idx"), "reason", (F.round("score", 6) + 0.0).alias("score"))


RUN_DT_US = 7_200 * si.SECOND_US


def candidates(spark, sf_dir):
    """Test rows at or above the threshold chosen on the validation rows."""
    rows = hash_subset(si.event_scores(spark, sf_dir)).withColumn("det", F.col("event_id") % 3)
    threshold = th.constrained(rk.operating_points(rows.where("subset = 'val'")), 0.3).select("threshold").scalar()
    return rows.where((F.col("subset") == "test") & (F.col("score") >= threshold))


CANDIDATE_SQL = f"""WITH RECURSIVE {points_sql('val_scores', SPLIT_SCORES_SQL)},
pick AS (SELECT max_by(threshold, struct_pack(a := tpr, b := threshold)) AS threshold FROM points WHERE fpr <= 0.3::DOUBLE),
cand AS (SELECT event_id % 3 AS det, start_us FROM test_scores CROSS JOIN pick p WHERE score >= p.threshold),
h AS (SELECT start_us, row_number() OVER (ORDER BY start_us) AS k FROM cand WHERE det = 0),
l AS (SELECT start_us, row_number() OVER (ORDER BY start_us) AS k FROM cand WHERE det = 1),
{SLIDES_SQL},
bg AS (SELECT s.slide_id, count(h.start_us) AS pairs FROM slides s CROSS JOIN l LEFT JOIN h ON abs(h.start_us - (l.start_us + s.shift_us)) <= {RUN_DT_US} GROUP BY s.slide_id),
span AS (SELECT (least((SELECT max(start_us) FROM h), (SELECT max(start_us) FROM l)) - greatest((SELECT min(start_us) FROM h), (SELECT min(start_us) FROM l))) / 1e6 AS tobs),
walk(i, j, hit) AS (
  SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), 0
  UNION ALL
  SELECT CASE WHEN h.start_us - l.start_us > {RUN_DT_US} THEN i ELSE i + 1 END, CASE WHEN l.start_us - h.start_us > {RUN_DT_US} THEN j ELSE j + 1 END,
         CASE WHEN abs(h.start_us - l.start_us) <= {RUN_DT_US} THEN 1 ELSE 0 END
  FROM walk JOIN h ON h.k = walk.i JOIN l ON l.k = walk.j)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM cand) AS candidates, (SELECT CAST(sum(hit) AS BIGINT) FROM walk) AS coinc_real,
       round(avg(pairs), 6) AS bg_mean, round(stddev_samp(pairs), 6) AS bg_std, round(any_value(tobs), 6) AS tobs_s,
       round(avg(pairs) / any_value(tobs) * 86400.0, 6) AS far_per_day FROM bg CROSS JOIN span"""


@query("candidate_run", CANDIDATE_SQL)
def candidate_run(spark, sf_dir):
    found = cut_lineage(candidates(spark, sf_dir).select("det", F.col("start_us").alias("t_us")))
    h1, l1 = found.where("det = 0"), found.where("det = 1")
    real = tj.greedy_matches(h1, l1, RUN_DT_US).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    background = tj.count_pairs_by_slide(h1, l1, RUN_DT_US, slide_table(spark))
    far = tj.false_alarm_rate(background, tj.observation_span(h1, l1))
    numbers = [F.round(c, 6).alias(c) for c in ("bg_mean", "bg_std", "tobs_s", "far_per_day")]
    return far.select(
        found.agg(F.count("*")).scalar().alias("candidates"), real.select("n").scalar().alias("coinc_real"), *numbers
    )


@query(
    "run_summary",
    f"""WITH {si.EVENT_SCORES_SQL}, t AS (SELECT 100.0::DOUBLE AS threshold), {confusion_sql('event_scores', 't')}
SELECT 'r2' AS run_id, {COUNTS_SQL}, {RATES_SQL} FROM conf""",
)
def run_summary(spark, sf_dir):
    from wavequery.sources import files as fl

    root = scratch_path(spark, "runs")
    rows = si.event_scores(spark, sf_dir)
    for run, threshold in (("r1", 50.0), ("r2", 100.0)):
        counts = th.confusion(rows, threshold).select("tn", "fp", "fn", "tp")
        report = counts.select(F.lit(threshold).alias("threshold"), F.struct(F.struct("*").alias("confusion_at_thr")).alias("test"))
        tb.write_report(report, f"{root}/run_id={run}/kind=summary")
    # A run that never got its report has an artefact of another kind only.
    tb.write_report(spark.range(1), f"{root}/run_id=r3/kind=log")
    counts_schema = "tn long, fp long, fn long, tp long"
    schema = f"threshold double, test struct<confusion_at_thr:struct<{counts_schema.replace(' ', ':').replace(',:', ',')}>>, id long"
    artefacts = spark.read.schema(f"{schema}, run_id string, kind string").json(root)
    latest = fl.latest_complete_run(artefacts, ["summary"]).select("run_id").scalar()
    chosen = artefacts.where((F.col("run_id") == latest) & (F.col("kind") == "summary"))
    out = th.with_rates(chosen.select("run_id", "test.confusion_at_thr.*"))
    return out.select("run_id", "tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr")])


@query("csv_roundtrip", f"WITH {si.SCORES_SQL} SELECT file_id, start_us / 1e6 AS start_gps, label, score FROM scores")
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "scores")
    rows = si.scores(spark, sf_dir)
    tb.write_csv(
        rows.select(F.col("file_id").alias("fileid"), (F.col("start_us") / 1e6).alias("start"), F.col("label").alias("target"), F.col("score").alias("ncc")),
        path,
    )
    return tb.read_scores_csv(spark, path).select("file_id", "start_gps", "label", "score")


@query("file_index", "SELECT 'dataset' AS kind, CAST(count(DISTINCT event_type) AS BIGINT) AS folders, 1 AS unique_names FROM events")
def file_index(spark, sf_dir):
    from wavequery.sources import files as fl

    path = scratch_path(spark, "indexed")
    si.table(spark, sf_dir, "events").write.partitionBy("event_type").parquet(path)
    files = fl.list_files(spark, path, "*.parquet")
    folder = F.element_at(F.split("path", "/"), -2)
    return files.agg(
        F.lit("dataset").alias("kind"),
        F.count_distinct(folder).alias("folders"),
        (F.count_distinct("path") == F.count("*")).cast("int").alias("unique_names"),
    )
