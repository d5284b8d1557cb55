"""Ranking, curve and threshold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequery.operators import ranking as rk
from wavequery.operators import thresholds as th
from wavequery.plans import stand_ins as si
from wavequery.plans.registry import query
from wavequery.plans.split_sql import HASH_SPLIT_CASE, hash_subset

TARGET_FAR = 0.05


def points_sql(source: str, cte: str, name: str = "points", score: str = "score") -> str:
    """Operating points of a scored table as common table expressions."""
    return f"""{cte},
{name}_counts AS (
  SELECT {score} AS threshold, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
         sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg
  FROM {source} GROUP BY {score}),
{name}_cum AS (
  SELECT threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg
  FROM {name}_counts WINDOW w AS (ORDER BY threshold DESC)),
{name} AS (
  SELECT threshold, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, CAST(tp AS BIGINT) AS tp,
         CAST(fp AS BIGINT) AS fp, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
         CAST(tp AS DOUBLE) / greatest(n_pos, 1) AS tpr, CAST(fp AS DOUBLE) / greatest(n_neg, 1) AS fpr,
         CAST(tp AS DOUBLE) / greatest(tp + fp, 1) AS precision,
         CAST(2 * tp AS DOUBLE) / greatest(tp + fp + n_pos, 1) AS f1
  FROM {name}_cum)"""


EVENT_POINTS = points_sql("event_scores", si.EVENT_SCORES_SQL)
LINE_POINTS = points_sql("line_scores", si.LINE_SCORES_SQL)


def event_points(spark, sf_dir):
    return rk.operating_points(si.event_scores(spark, sf_dir))


def rounded(df, digits=6, **columns):
    return df.select(*[F.round(c, digits).alias(c) if columns.get(c) else F.col(c) for c in df.columns])


@query("roc_curve", f"WITH {EVENT_POINTS} SELECT threshold, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM points")
def roc_curve(spark, sf_dir):
    p = event_points(spark, sf_dir)
    return p.select("threshold", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("pr_curve", f"WITH {EVENT_POINTS} SELECT threshold, round(precision, 6) AS precision, round(tpr, 6) AS recall FROM points")
def pr_curve(spark, sf_dir):
    p = event_points(spark, sf_dir)
    return p.select("threshold", F.round("precision", 6).alias("precision"), F.round("tpr", 6).alias("recall"))


@query(
    "roc_auc",
    f"""WITH {LINE_POINTS}
SELECT round(sum(pos * (n_neg - fp + neg / 2.0::DOUBLE)) / any_value(n_pos) / any_value(n_neg), 6) AS auc FROM points""",
)
def roc_auc(spark, sf_dir):
    p = rk.operating_points(si.line_scores(spark, sf_dir))
    return rk.roc_auc(p).select(F.round("auc", 6).alias("auc"))


@query("avg_precision", f"WITH {LINE_POINTS} SELECT round(sum(pos * precision) / any_value(n_pos), 6) AS ap FROM points")
def avg_precision(spark, sf_dir):
    p = rk.operating_points(si.line_scores(spark, sf_dir))
    return rk.average_precision(p).select(F.round("ap", 6).alias("ap"))


@query(
    "rank_norm",
    """SELECT event_id, CASE WHEN count(*) OVER () > 1 THEN
         round(CAST(rank() OVER (ORDER BY value) - 1 AS DOUBLE) / (count(*) OVER () - 1), 9) ELSE 0.0 END AS rank_norm
       FROM events""",
)
def rank_norm(spark, sf_dir):
    rows = si.table(spark, sf_dir, "events").select("event_id", "value")
    return rk.rank_normalized(rows, "value").select("event_id", F.round("rank_norm", 9).alias("rank_norm"))


@query(
    "thr_best_f1",
    f"""WITH {EVENT_POINTS}
SELECT threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(tpr, 6) AS recall
FROM points ORDER BY points.f1 DESC, threshold LIMIT 1""",
)
def thr_best_f1(spark, sf_dir):
    return rounded(th.best_f1(event_points(spark, sf_dir)), f1=True, precision=True, recall=True)


ROUNDED_SQL = f"""{si.SCORES_SQL},
r4 AS (SELECT label, round(least(greatest(score, 0), 1), 4) AS score FROM scores),
ends AS (SELECT label, score FROM r4 UNION ALL SELECT NULL, 0.0 UNION ALL SELECT NULL, 1.0),
c AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM ends GROUP BY score),
k AS (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n_pos FROM c
      WINDOW w AS (ORDER BY threshold DESC))"""


@query(
    "thr_best_f1_rounded",
    f"""WITH {ROUNDED_SQL}
SELECT threshold, round(CAST(2 * tp AS DOUBLE) / greatest(tp + fp + n_pos, 1), 6) AS f1
FROM k ORDER BY CAST(2 * tp AS DOUBLE) / greatest(tp + fp + n_pos, 1) DESC, threshold LIMIT 1""",
)
def thr_best_f1_rounded(spark, sf_dir):
    return th.best_f1_rounded(si.scores(spark, sf_dir)).select("threshold", F.round("f1", 6).alias("f1"))


@query(
    "thr_target_far",
    f"""WITH {EVENT_POINTS}
SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, tp, fp FROM points
ORDER BY abs(points.fpr - {TARGET_FAR}::DOUBLE) + CASE WHEN tp = 0 THEN 1e3 ELSE 0 END, threshold DESC LIMIT 1""",
)
def thr_target_far(spark, sf_dir):
    return rounded(th.closest_fpr(event_points(spark, sf_dir), TARGET_FAR, need_tp=True), fpr=True, tpr=True)


@query(
    "thr_constrained",
    f"""WITH {EVENT_POINTS},
ok AS (SELECT * FROM points WHERE fpr <= {TARGET_FAR}::DOUBLE ORDER BY tpr DESC, threshold DESC LIMIT 1),
relaxed AS (SELECT * FROM points ORDER BY fpr, tpr DESC, threshold DESC LIMIT 1),
pick AS (SELECT *, 'constrained' AS mode FROM ok
         UNION ALL SELECT *, 'relaxed' FROM relaxed WHERE NOT EXISTS (SELECT 1 FROM ok))
SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, mode,
       (SELECT max(threshold) FROM points WHERE neg > 0) AS above FROM pick""",
)
def thr_constrained(spark, sf_dir):
    return rounded(th.constrained(event_points(spark, sf_dir), TARGET_FAR, strict=True), fpr=True, tpr=True)


@query(
    "thr_first_hit",
    f"""WITH {EVENT_POINTS}
SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, 'constrained' AS mode FROM points
WHERE fpr <= {TARGET_FAR}::DOUBLE ORDER BY threshold DESC LIMIT 1""",
)
def thr_first_hit(spark, sf_dir):
    return rounded(th.constrained(event_points(spark, sf_dir), TARGET_FAR, first_hit=True), fpr=True, tpr=True)


@query(
    "thr_recall",
    f"""WITH {EVENT_POINTS}
SELECT threshold, round(tpr, 6) AS recall, round(precision, 6) AS precision FROM points
WHERE tpr >= 0.3::DOUBLE ORDER BY threshold DESC LIMIT 1""",
)
def thr_recall(spark, sf_dir):
    return rounded(th.at_recall(event_points(spark, sf_dir), 0.3), recall=True, precision=True)


@query(
    "thr_guarded",
    f"""WITH {si.EVENT_SCORES_SQL},
q AS (SELECT least(0.999::DOUBLE, greatest(0.95::DOUBLE, 1 - 10.0::DOUBLE / greatest(count(*) FILTER (label = 0), 1))) AS q,
             least(1e6::DOUBLE, max(score)) AS usable FROM event_scores),
tp AS (SELECT count(*) FILTER (e.label = 1 AND e.score >= q.usable) AS tp FROM event_scores e CROSS JOIN q),
ranked AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM event_scores),
ends AS (SELECT max(score) FILTER (i = floor(q.q * (n - 1))) AS lo, max(score) FILTER (i = ceil(q.q * (n - 1))) AS hi,
                any_value(q.q * (n - 1) - floor(q.q * (n - 1))) AS f FROM ranked CROSS JOIN q)
SELECT 1e6::DOUBLE AS proposed, round(q.q, 9) AS quantile,
       round(CASE WHEN tp.tp > 0 THEN q.usable ELSE ends.lo + ends.f * (ends.hi - ends.lo) END, 6) AS threshold
FROM q CROSS JOIN tp CROSS JOIN ends""",
)
def thr_guarded(spark, sf_dir):
    g = th.guarded(si.event_scores(spark, sf_dir), 1e6)
    return g.select("proposed", F.round("quantile", 9).alias("quantile"), F.round("threshold", 6).alias("threshold"))


# False-alarm targets of the report grid: fixed values.
REPORT_FARS = (1e-6, 5e-6, 1e-5, 5e-4, 1e-3, 5e-3, 1e-2)
# False-alarm targets of the sweep: fixed values.
SWEEP_FARS = (1e-5, 3e-5, 1e-4, 3e-4, 1e-3, 3e-3, 1e-2)


def _values(targets):
    return ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in targets)


@query(
    "far_grid",
    f"""WITH {EVENT_POINTS}, targets(far) AS (VALUES {_values(REPORT_FARS)}),
ranked AS (SELECT far, p.*, row_number() OVER (PARTITION BY far ORDER BY abs(fpr - far), threshold DESC) AS rn
           FROM targets CROSS JOIN points p)
SELECT far, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, tp, fp FROM ranked WHERE rn = 1""",
)
def far_grid(spark, sf_dir):
    return rounded(th.fpr_grid(event_points(spark, sf_dir), REPORT_FARS), fpr=True, tpr=True)


SPLIT_SCORES_SQL = f"""{si.EVENT_SCORES_SQL},
split_scores AS (SELECT *, {HASH_SPLIT_CASE} AS subset FROM event_scores),
val_scores AS (SELECT * FROM split_scores WHERE subset = 'val'),
test_scores AS (SELECT * FROM split_scores WHERE subset = 'test')"""


@query(
    "far_sweep",
    f"""WITH {points_sql('val_scores', SPLIT_SCORES_SQL)}, targets(far) AS (VALUES {_values(SWEEP_FARS)}),
ok AS (SELECT far, p.*, row_number() OVER (PARTITION BY far ORDER BY tpr DESC, threshold DESC) AS rn
       FROM targets JOIN points p ON p.fpr <= far),
relaxed AS (SELECT * FROM points ORDER BY fpr, tpr DESC, threshold DESC LIMIT 1),
pick AS (SELECT t.far, coalesce(ok.threshold, r.threshold) AS threshold, coalesce(ok.fpr, r.fpr) AS val_fpr,
                coalesce(ok.tpr, r.tpr) AS val_tpr, coalesce(ok.precision, r.precision) AS val_prec
         FROM targets t LEFT JOIN ok ON ok.far = t.far AND ok.rn = 1 CROSS JOIN relaxed r),
conf AS (
  SELECT far, any_value(p.threshold) AS threshold, any_value(val_fpr) AS val_fpr, any_value(val_tpr) AS val_tpr,
         any_value(val_prec) AS val_prec,
         count(*) FILTER (label = 0 AND score < p.threshold) AS tn, count(*) FILTER (label = 0 AND score >= p.threshold) AS fp,
         count(*) FILTER (label = 1 AND score < p.threshold) AS fn, count(*) FILTER (label = 1 AND score >= p.threshold) AS tp
  FROM pick p CROSS JOIN test_scores GROUP BY far)
SELECT far, threshold, round(val_fpr, 6) AS val_fpr, round(val_tpr, 6) AS val_tpr, round(val_prec, 6) AS val_prec,
       CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
       round(CAST(tp AS DOUBLE) / greatest(tp + fp, 1), 6) AS precision,
       round(CAST(tp AS DOUBLE) / greatest(tp + fn, 1), 6) AS recall,
       round(CAST(fp AS DOUBLE) / greatest(fp + tn, 1), 6) AS fpr
FROM conf""",
)
def far_sweep(spark, sf_dir):
    rows = hash_subset(si.event_scores(spark, sf_dir))
    points = rk.operating_points(rows.where("subset = 'val'"))
    swept = th.sweep(points, rows.where("subset = 'test'"), SWEEP_FARS)
    return rounded(swept, val_fpr=True, val_tpr=True, val_prec=True, precision=True, recall=True, fpr=True)


@query(
    "confusion",
    f"""WITH {EVENT_POINTS}, t AS (SELECT threshold FROM points ORDER BY f1 DESC, threshold LIMIT 1),
c AS (SELECT count(*) FILTER (label = 0 AND score < t.threshold) AS tn, count(*) FILTER (label = 0 AND score >= t.threshold) AS fp,
             count(*) FILTER (label = 1 AND score < t.threshold) AS fn, count(*) FILTER (label = 1 AND score >= t.threshold) AS tp
      FROM event_scores CROSS JOIN t)
SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
       round(CAST(tp AS DOUBLE) / greatest(tp + fp, 1), 6) AS precision,
       round(CAST(tp AS DOUBLE) / greatest(tp + fn, 1), 6) AS recall,
       round(CAST(fp AS DOUBLE) / greatest(fp + tn, 1), 6) AS fpr FROM c""",
)
def confusion(spark, sf_dir):
    threshold = th.choose("best_f1", event_points(spark, sf_dir)).select("threshold").scalar()
    return rounded(th.confusion(si.event_scores(spark, sf_dir), threshold), precision=True, recall=True, fpr=True)


@query(
    "class_report",
    f"""WITH {si.EVENT_SCORES_SQL},
c AS (SELECT count(*) FILTER (label = 0 AND score < 25) AS tn, count(*) FILTER (label = 0 AND score >= 25) AS fp,
             count(*) FILTER (label = 1 AND score < 25) AS fn, count(*) FILTER (label = 1 AND score >= 25) AS tp FROM event_scores),
k AS (SELECT '0' AS class, tn AS hit, tn + fn AS called, tn + fp AS support FROM c
      UNION ALL SELECT '1', tp, tp + fp, tp + fn FROM c),
m AS (SELECT class, CASE WHEN called = 0 THEN 0 ELSE CAST(hit AS DOUBLE) / called END AS precision,
             CASE WHEN support = 0 THEN 0 ELSE CAST(hit AS DOUBLE) / support END AS recall,
             CASE WHEN called + support = 0 THEN 0 ELSE CAST(2 * hit AS DOUBLE) / (called + support) END AS f1, support FROM k),
a AS (SELECT class, precision, recall, f1, support FROM m
      UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM m
      UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                       sum(f1 * support) / sum(support), sum(support) FROM m
      UNION ALL SELECT 'accuracy', CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn),
                       CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), tp + tn + fp + fn FROM c)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM a""",
)
def class_report(spark, sf_dir):
    report = th.class_report(si.event_scores(spark, sf_dir), 25.0)
    return rounded(report, precision=True, recall=True, f1=True)


@query(
    "degenerate_threshold",
    """WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n
                  FROM lineitem WHERE l_returnflag <> 'R'),
p AS (SELECT max(v) FILTER (i = floor(0.999::DOUBLE * (n - 1))) AS lo, max(v) FILTER (i = ceil(0.999::DOUBLE * (n - 1))) AS hi,
             any_value(0.999::DOUBLE * (n - 1) - floor(0.999::DOUBLE * (n - 1))) AS f FROM r)
SELECT round(lo + f * (hi - lo), 4) AS threshold, 'degenerate' AS mode FROM p""",
)
def degenerate_threshold(spark, sf_dir):
    one_class = si.line_scores(spark, sf_dir).where("label = 0")
    return th.constrained_or_degenerate(one_class, 1e-4).select(F.round("threshold", 4).alias("threshold"), "mode")
