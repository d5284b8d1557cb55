"""Summary, top-k and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequery.functions import physics
from wavequery.operators import summaries as sm
from wavequery.plans import stand_ins as si
from wavequery.plans.registry import query
from wavequery.plans.split_sql import HASH_SPLIT_CASE, hash_subset


@query(
    "subset_summary",
    f"""WITH {si.EVENT_SCORES_SQL}, d AS (SELECT label, {HASH_SPLIT_CASE} AS subset FROM event_scores)
SELECT coalesce(subset, 'total') AS subset, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS pos,
       round(100.0::DOUBLE * sum(label) / count(*), 6) AS pos_pct FROM d GROUP BY ROLLUP (subset)""",
)
def subset_summary(spark, sf_dir):
    out = sm.subset_summary(hash_subset(si.event_scores(spark, sf_dir)))
    return out.withColumn("pos_pct", F.round("pos_pct", 6))


@query("value_counts", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return si.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "score_heatmap",
    f"""WITH {si.TRIGGERS_SQL}, s AS (SELECT min(t_us / 1e6) AS lo, max(t_us / 1e6) AS hi FROM triggers),
b AS (SELECT CAST(least(greatest(floor((t_us / 1e6 - lo) / (hi - lo + 1e-9) * 48), 0), 47) AS INTEGER) AS bin, detector, score FROM triggers CROSS JOIN s)
SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(max(score) FILTER (detector = 'H1'), 0) AS "H1", coalesce(max(score) FILTER (detector = 'L1'), 0) AS "L1"
FROM range(48) r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin""",
)
def score_heatmap(spark, sf_dir):
    t = si.triggers(spark, sf_dir).withColumn("t_s", F.col("t_us") / 1e6)
    return sm.time_heatmap(t, "t_s", "score", "detector", ["H1", "L1"])


@query(
    "score_summary",
    f"""WITH {si.LINE_SCORES_SQL} SELECT CAST(count(*) AS BIGINT) AS n, min(score) AS lo, max(score) AS hi,
       round(avg(CASE WHEN score > 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS frac_nonzero, round(median(score), 6) AS median FROM line_scores""",
)
def score_summary(spark, sf_dir):
    out = sm.score_summary(si.line_scores(spark, sf_dir))
    return out.withColumn("frac_nonzero", F.round("frac_nonzero", 6)).withColumn("median", F.round("median", 6))


@query(
    "score_histogram",
    f"""WITH {si.LINE_SCORES_SQL}, e AS (SELECT label, min(score) AS lo, max(score) AS hi, count(*) AS total FROM line_scores GROUP BY label),
b AS (SELECT label, CAST(least(greatest(floor((score - lo) / ((hi - lo) / 60)), 0), 59) AS INTEGER) AS bin FROM line_scores JOIN e USING (label)),
c AS (SELECT label, bin, count(*) AS n FROM b GROUP BY label, bin),
g AS (SELECT label, CAST(r.bin AS INTEGER) AS bin, lo, hi, total FROM e CROSS JOIN range(60) r(bin))
SELECT label, bin, round(lo + bin * ((hi - lo) / 60), 4) AS bin_lo, CAST(coalesce(n, 0) AS BIGINT) AS n,
       round(coalesce(n, 0) / (total * ((hi - lo) / 60)), 9) AS density FROM g LEFT JOIN c USING (label, bin)""",
)
def score_histogram(spark, sf_dir):
    out = sm.histogram(si.line_scores(spark, sf_dir), "score", 60, ["label"])
    return out.withColumn("bin_lo", F.round("bin_lo", 4)).withColumn("density", F.round("density", 9))


@query(
    "class_weight",
    f"""WITH {si.LINE_SCORES_SQL}, c AS (SELECT CAST(count(*) FILTER (label = 1) AS BIGINT) AS n_pos, CAST(count(*) FILTER (label = 0) AS BIGINT) AS n_neg FROM line_scores)
SELECT n_pos, n_neg, round(greatest(CAST(n_neg AS DOUBLE) / greatest(n_pos, 1), 1.0), 6) AS weight FROM c""",
)
def class_weight(spark, sf_dir):
    return sm.class_weight(si.line_scores(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(
    "param_effects",
    """WITH g AS (SELECT avg(l_extendedprice) AS g FROM lineitem),
m AS (SELECT 'l_returnflag' AS param, avg(l_extendedprice) AS mean FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT 'l_linestatus', avg(l_extendedprice) FROM lineitem GROUP BY l_linestatus
  UNION ALL SELECT 'l_linenumber', avg(l_extendedprice) FROM lineitem GROUP BY l_linenumber)
SELECT param, round(avg(abs(mean - g.g)), 4) AS mean_abs_delta, CAST(count(*) AS BIGINT) AS values, round(any_value(g.g), 4) AS global_mean
FROM m CROSS JOIN g GROUP BY param""",
)
def param_effects(spark, sf_dir):
    trials = si.table(spark, sf_dir, "lineitem")
    out = sm.param_effects(trials, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice")
    return out.select(
        "param", F.round("mean_abs_delta", 4).alias("mean_abs_delta"), "values", F.round("global_mean", 4).alias("global_mean")
    )


@query(
    "sweep_best",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_discount END AS recall_at_far, l_extendedprice AS auc FROM lineitem
ORDER BY (recall_at_far IS NOT NULL) DESC, coalesce(recall_at_far, auc) DESC, auc DESC, l_orderkey DESC, l_linenumber DESC LIMIT 1""",
)
def sweep_best(spark, sf_dir):
    metric = F.when(F.col("l_returnflag") == "R", F.col("l_discount"))
    rows = si.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", metric.alias("recall_at_far"), F.col("l_extendedprice").alias("auc")
    )
    return sm.best_row(rows, "recall_at_far", "auc", ["auc", "l_orderkey", "l_linenumber"])


@query(
    "hard_negatives",
    f"WITH {si.EVENT_SCORES_SQL} SELECT event_id, file_id, score FROM event_scores WHERE label = 0 ORDER BY score DESC, event_id LIMIT 2000",
)
def hard_negatives(spark, sf_dir):
    negatives = si.event_scores(spark, sf_dir).where("label = 0").select("event_id", "file_id", "score")
    return negatives.orderBy(F.desc("score"), "event_id").limit(2_000)


TWO_MODELS_SQL = f"""{si.SCORES_SQL},
other AS (SELECT doc_id, 1.0::DOUBLE - CAST(n_chars % 89 AS DOUBLE) / 89 AS score FROM documents WHERE lang <> 'en'),
joined AS (SELECT s.doc_id, s.file_id, s.label, s.score AS score_mf, o.score AS score_ml FROM scores s LEFT JOIN other o ON o.doc_id = s.doc_id)"""


def two_models(spark, sf_dir):
    docs = si.table(spark, sf_dir, "documents").where("lang <> 'en'")
    other = docs.select("doc_id", (F.lit(1.0) - (F.col("n_chars") % 89).cast("double") / 89).alias("score"))
    base = si.scores(spark, sf_dir)
    return sm.join_scores(
        base.select("doc_id", "file_id", "label"), {"score_mf": base.select("doc_id", "score"), "score_ml": other}, ["doc_id"]
    )


@query("join_scores", f"WITH {TWO_MODELS_SQL} SELECT doc_id, file_id, label, round(score_mf, 9) AS score_mf, round(score_ml, 9) AS score_ml FROM joined")
def join_scores(spark, sf_dir):
    j = two_models(spark, sf_dir)
    return j.withColumn("score_mf", F.round("score_mf", 9)).withColumn("score_ml", F.round("score_ml", 9))


@query(
    "top_files",
    f"""WITH {TWO_MODELS_SQL}, f AS (SELECT file_id, max(greatest(score_mf, score_ml)) AS peak, max(label) AS has_pos FROM joined GROUP BY file_id)
SELECT file_id, round(peak, 9) AS peak, has_pos FROM f ORDER BY has_pos DESC, f.peak DESC, file_id LIMIT 12""",
)
def top_files(spark, sf_dir):
    files = sm.peak_by_file(two_models(spark, sf_dir), "file_id", ["score_mf", "score_ml"])
    return sm.shortlist(files, "file_id").select("file_id", F.round("peak", 9).alias("peak"), "has_pos")


@query(
    "timeline_order",
    f"WITH {TWO_MODELS_SQL} SELECT file_id, doc_id, row_number() OVER (PARTITION BY file_id ORDER BY doc_id) AS pos FROM joined",
)
def timeline_order(spark, sf_dir):
    from wavequery.operators.running import range_edges, running, with_range_bucket

    rows = two_models(spark, sf_dir).select("file_id", "doc_id")
    edges = range_edges(si.table(spark, sf_dir, "labels"), "doc_id")
    line = with_range_bucket(rows, "doc_id", edges)
    return running(line, "doc_id", {"pos": ("sum", F.lit(1).cast("long"))}, by=["file_id"]).drop("_bucket")


@query(
    "fallback_pick",
    f"""WITH {si.EVENT_SCORES_SQL}, d AS (SELECT *, {HASH_SPLIT_CASE} AS subset FROM event_scores),
k AS (SELECT event_id FROM d WHERE subset = 'val' AND label = 1 ORDER BY event_id LIMIT 5)
SELECT 1 AS tier, event_id, 1.0::DOUBLE AS score FROM k""",
)
def fallback_pick(spark, sf_dir):
    data = hash_subset(si.event_scores(spark, sf_dir))
    # A run whose score file holds no score at all: the dataset tiers apply.
    unscored = data.select("event_id", F.lit(None).cast("double").alias("score"))
    return sm.fallback_pick(unscored, data.select("event_id", "label", "subset"), ["event_id"], 5)


@query(
    "minmax_score",
    """WITH e AS (SELECT min(l_extendedprice - l_quantity * 1000) AS lo, max(l_extendedprice - l_quantity * 1000) AS hi FROM lineitem)
SELECT l_linenumber, CAST(count(*) AS BIGINT) AS n, round(avg((l_extendedprice - l_quantity * 1000 - lo) / greatest(hi - lo, 1e-12)), 6) AS mean_score,
       round(max((l_extendedprice - l_quantity * 1000 - lo) / greatest(hi - lo, 1e-12)), 6) AS top_score
FROM lineitem CROSS JOIN e GROUP BY l_linenumber""",
)
def minmax_score(spark, sf_dir):
    line = si.table(spark, sf_dir, "lineitem")
    decision = (F.col("l_extendedprice") - F.col("l_quantity") * 1000).alias("d")
    scaled = sm.minmax(line.select("l_linenumber", decision), "d")
    return scaled.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score"), 6).alias("top_score")
    )


TEACHER_SQL = """history AS (SELECT l_partkey, max_by(l_discount * 10, struct_pack(a := l_orderkey, b := l_linenumber, c := l_extendedprice)) AS teacher
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)"""


def teacher(spark, sf_dir):
    line = si.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    rows = line.select(
        "l_partkey",
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"),
        (F.col("l_discount") * 10).alias("score"),
    )
    return sm.teacher_scores(rows, ["l_partkey"], "seq")


@query("teacher_join", f"WITH {TEACHER_SQL} SELECT p_partkey, p_size, round(teacher, 6) AS teacher FROM part LEFT JOIN history ON l_partkey = p_partkey")
def teacher_join(spark, sf_dir):
    part = si.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    known = teacher(spark, sf_dir).withColumnRenamed("l_partkey", "p_partkey")
    return part.join(known, "p_partkey", "left").select("p_partkey", "p_size", F.round("teacher", 6).alias("teacher"))


@query(
    "loss_report",
    f"""WITH {TEACHER_SQL},
r AS (SELECT CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END AS label, 1.0::DOUBLE / (1 + exp(-(p_size - 25.0::DOUBLE) / 10)) AS s1,
             1.0::DOUBLE / (1 + exp(-(p_size - 30.0::DOUBLE) / 8)) AS s2, teacher FROM part LEFT JOIN history ON l_partkey = p_partkey),
w AS (SELECT greatest(1.0::DOUBLE, CAST(count(*) FILTER (label = 0) AS DOUBLE) / greatest(count(*) FILTER (label = 1), 1)) AS w FROM r),
p AS (SELECT *, least(greatest(s2, 1e-7), 1 - 1e-7) AS q FROM r CROSS JOIN w)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(-(w * label * ln(q) + (1 - label) * ln(1 - q))), 6) AS bce, round(avg(2 * (s1 - s2) * (s1 - s2)), 6) AS consistency,
       round(coalesce(avg((s2 - least(greatest(teacher, 0), 1)) * (s2 - least(greatest(teacher, 0), 1))), 0), 6) AS distillation,
       CAST(count(teacher) AS BIGINT) AS n_teacher FROM p""",
)
def loss_report(spark, sf_dir):
    part = si.table(spark, sf_dir, "part")
    known = teacher(spark, sf_dir).withColumnRenamed("l_partkey", "p_partkey")
    rows = part.join(known, "p_partkey", "left").select(
        F.when(F.col("p_type") == "SMALL", 1).otherwise(0).alias("label"),
        physics.sigmoid((F.col("p_size") - 25.0) / 10).alias("s1"),
        physics.sigmoid((F.col("p_size") - 30.0) / 8).alias("s2"),
        "teacher",
    )
    out = sm.loss_report(rows, "label", "s1", "s2", "teacher")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("bce", "consistency", "distillation")], "n_teacher")


@query(
    "feature_transform",
    """SELECT event_id, round(ln(1 + greatest(value - 5, 0)), 6) AS log_value, round(1.0::DOUBLE / (1 + exp(-(value - 40) / 20)), 6) AS prob,
       round(sqrt(value * value + user_id * user_id), 6) AS combined, round(value, 1) AS rounded FROM events""",
)
def feature_transform(spark, sf_dir):
    value = F.col("value")
    return si.table(spark, sf_dir, "events").select(
        "event_id",
        F.round(physics.log1p_clipped(value - 5), 6).alias("log_value"),
        F.round(physics.sigmoid((value - 40) / 20), 6).alias("prob"),
        F.round(F.hypot(value, F.col("user_id")), 6).alias("combined"),
        F.round(value, 1).alias("rounded"),
    )


def residual_sql(mass: str, freq: str, snr: str) -> str:
    return f"""abs(pow(least(greatest({mass}, 5.0), 100.0) * {physics.MSUN}::DOUBLE * (pi() * {physics.G}::DOUBLE / pow({physics.C}::DOUBLE, 3)), 5.0::DOUBLE / 3)
  * pow(least(greatest({freq}, 20.0), 2048.0), 11.0::DOUBLE / 3) * (96.0::DOUBLE / (5 * pi())) / 1e-4 - ln(1 + {snr}))"""


# Masses and frequencies are scaled so that residuals stay in a readable range.
@query(
    "chirp_residual",
    f"""WITH r AS (SELECT event_type, value, {residual_sql('user_id::DOUBLE', 'value', 'value')} AS residual FROM events WHERE event_type IN ('purchase', 'view'))
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(ln(residual)), 6) AS mean_log_residual, round(min(ln(residual)), 6) AS min_log_residual FROM r GROUP BY event_type""",
)
def chirp_residual(spark, sf_dir):
    events = si.table(spark, sf_dir, "events").where("event_type IN ('purchase', 'view')")
    residual = physics.chirp_residual(F.col("user_id").cast("double"), F.col("value"), F.col("value"))
    return events.select("event_type", F.log(residual).alias("r")).groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean_log_residual"), F.round(F.min("r"), 6).alias("min_log_residual")
    )


@query(
    "grid_scan",
    """WITH c AS (SELECT p_partkey, p_size, sqrt(pow(p_size - 20.25::DOUBLE, 2) + pow((p_retailprice - 1100) / 10, 2)) AS cost FROM part)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(cost), 6) AS mean_cost, round(max(cost), 6) AS max_cost, round(min(cost), 6) AS min_cost,
       arg_min(p_partkey, struct_pack(a := cost, b := p_partkey)) AS p_partkey, arg_min(p_size, struct_pack(a := cost, b := p_partkey)) AS p_size FROM c""",
)
def grid_scan(spark, sf_dir):
    part = si.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    cost = F.sqrt(F.pow(F.col("p_size") - 20.25, 2) + F.pow((F.col("p_retailprice") - 1100) / 10, 2))
    out = sm.grid_scan(part, cost, ["p_partkey", "p_size"])
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean_cost", "max_cost", "min_cost")], "p_partkey", "p_size")


@query(
    "template_grid",
    """WITH part_range AS (SELECT 3.0::DOUBLE AS lo, 3.0::DOUBLE + max(p_size) AS hi, CAST(count(*) AS BIGINT) AS wanted FROM part),
side AS (SELECT *, CAST(greatest(ceil(sqrt(wanted)), 1) AS BIGINT) AS side FROM part_range),
bank AS (SELECT i * side + j AS pos, lo + i * ((hi - lo) / greatest(side - 1, 1)) AS m1, lo + j * ((hi - lo) / greatest(side - 1, 1)) AS m2
  FROM side, range(0, 2000) a(i), range(0, 2000) b(j) WHERE i < side AND j < side AND i * side + j < wanted)
SELECT pos, round(m1, 6) AS m1, round(m2, 6) AS m2, CASE WHEN pos % 2 = 0 THEN 1 ELSE 0 END AS used FROM bank""",
)
def template_grid(spark, sf_dir):
    from wavequery.operators.templates import template_bank

    # The bank has as many templates as the table has parts and spans their sizes.
    facts = si.table(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.max("p_size").alias("top")).first()
    bank = template_bank(spark, facts["n"], (3.0, 3.0 + facts["top"]), (3.0, 3.0 + facts["top"]), subsample=2)
    return bank.select("pos", F.round("m1", 6).alias("m1"), F.round("m2", 6).alias("m2"), "used")
