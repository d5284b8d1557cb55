"""Classifier and calibration queries over the labelled windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequery.operators import calibration as cb
from wavequery.operators import models as md
from wavequery.operators import timejoin as tj
from wavequery.operators.splits import group_split
from wavequery.plans import stand_ins as si
from wavequery.plans.ranking_plans import SPLIT_SCORES_SQL
from wavequery.plans.registry import query
from wavequery.plans.split_sql import hash_subset
from wavequery.session import cut_lineage, scratch_path

FEATURES = ["snr_rms", "snr_peak", "crest_factor", "n"]
STACK_TREES = 100
KEEP = ["file_id", "start_us", "label", "subset"]


def labelled_windows(spark, sf_dir):
    """The window dataset with labels, a group-safe split, detector and row key, stored once."""
    w = tj.interval_label(
        si.windows(spark, sf_dir), si.catalog(spark, sf_dir), si.PRE_US, si.POS_US, (si.FRAME_US, si.FRAME_US)
    )
    split = group_split(w, "file_id", 0.18, 0.18)
    detector = F.when(F.col("file_id") % 2 == 0, "H1").otherwise("L1")
    keyed = split.withColumn("detector", detector).withColumn("key", F.concat_ws("|", "file_id", "start_us"))
    return cut_lineage(keyed)


def _parts(rows):
    return rows.where("subset = 'train'"), rows.where("subset <> 'train'")


def _rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    train, rest = _parts(labelled_windows(spark, sf_dir))
    model = md.fit_on_cells(train, md.binned_stages(train, FEATURES), md.boosted_trees())
    stored = md.save_and_load(model, scratch_path(spark, "model"))
    return _rounded(md.score(stored, rest, KEEP), "score")


@query("logreg_scores")
def logreg_scores(spark, sf_dir):
    train, rest = _parts(labelled_windows(spark, sf_dir))
    stages = md.feature_stages(FEATURES, log_columns=["snr_rms", "snr_peak", "crest_factor"], category="detector")
    return _rounded(md.score(md.fit(md.with_class_weight(train), stages, md.balanced_logistic()), rest, KEEP), "score")


@query("forest_scores")
def forest_scores(spark, sf_dir):
    train, rest = _parts(labelled_windows(spark, sf_dir))
    model = md.fit_on_cells(md.with_class_weight(train), md.binned_stages(train, FEATURES), md.forest())
    return _rounded(md.score(model, rest, KEEP), "score")


@query("stacked_scores")
def stacked_scores(spark, sf_dir):
    train, rest = _parts(labelled_windows(spark, sf_dir))
    out = md.stacked(train, rest, ["snr_rms", "n"], FEATURES, KEEP, trees=STACK_TREES, depth=6)
    return _rounded(out, "score1", "score2")


@query("platt_calib")
def platt_calib(spark, sf_dir):
    train, rest = _parts(labelled_windows(spark, sf_dir))
    return _rounded(md.sigmoid_calibrated(train, rest, "key", FEATURES, KEEP), "score", "p")


@query("multi_seed")
def multi_seed(spark, sf_dir):
    rows = labelled_windows(spark, sf_dir)
    trials = md.multi_seed(
        rows.where("subset = 'train'"),
        rows.where("subset = 'val'"),
        "key",
        FEATURES,
        (1, 2, 3),
        lambda _s: md.balanced_logistic(),
        max_pos=5_000,
        neg_per_pos=3,
    )
    per_metric = [md.spread(trials, m).withColumn("metric", F.lit(m)) for m in ("ap", "auc")]
    return _rounded(per_metric[0].unionByName(per_metric[1]), "mean", "std", "lo", "hi")


@query(
    "isotonic_calib",
    f"""WITH {SPLIT_SCORES_SQL},
pt AS (SELECT score AS x, avg(label) AS y, count(*) AS w, row_number() OVER (ORDER BY score) AS i FROM val_scores GROUP BY score),
cum AS (SELECT i, x, sum(w) OVER (ORDER BY i) AS cw, sum(y * w) OVER (ORDER BY i) AS cy FROM pt),
seg AS (SELECT a.i AS a, b.i AS b, (b.cy - coalesce(z.cy, 0)) / (b.cw - coalesce(z.cw, 0)) AS m
        FROM pt a JOIN cum b ON b.i >= a.i LEFT JOIN cum z ON z.i = a.i - 1),
low AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM seg),
iso AS (SELECT i, max(m) AS y FROM low GROUP BY i),
fit AS (SELECT pt.x, iso.y FROM pt JOIN iso USING (i)),
rows_ AS (SELECT event_id, subset, score FROM split_scores WHERE subset <> 'train'),
p AS (SELECT r.event_id, r.subset, r.score, l.x AS lx, l.y AS ly, u.x AS ux, u.y AS uy
      FROM rows_ r ASOF LEFT JOIN fit l ON r.score >= l.x ASOF LEFT JOIN fit u ON r.score <= u.x)
SELECT event_id, subset, round(CASE WHEN lx IS NULL THEN uy WHEN ux IS NULL OR ux = lx THEN ly ELSE ly + (uy - ly) * (score - lx) / (ux - lx) END, 6) AS p FROM p""",
)
def isotonic_calib(spark, sf_dir):
    rows = hash_subset(si.event_scores(spark, sf_dir))
    out = cb.isotonic(rows.where("subset = 'val'"), rows.where("subset <> 'train'"))
    return out.select("event_id", "subset", F.round("p", 6).alias("p"))
