"""Summary tables over scores, datasets and experiment logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavequery.operators.joins import join_checked
from wavequery.operators.running import exact_quantiles


def subset_summary(rows: DataFrame, subset: str = "subset", label: str = "label") -> DataFrame:
    """Rows, positives and their percentage per subset, with a total row."""
    positive = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    return (
        rows.rollup(subset)
        .agg(F.count("*").alias("n"), positive.alias("pos"))
        .select(
            F.coalesce(subset, F.lit("total")).alias(subset),
            "n",
            "pos",
            (F.lit(100.0) * F.col("pos") / F.greatest("n", F.lit(1))).alias("pos_pct"),
        )
    )


def score_summary(rows: DataFrame, score: str = "score") -> DataFrame:
    """Smallest, exact median and largest score, and the share above 1e-6."""
    plain = rows.agg(
        F.count("*").alias("n"),
        F.min(score).alias("lo"),
        F.max(score).alias("hi"),
        F.avg(F.when(F.col(score) > 1e-6, 1.0).otherwise(0.0)).alias("frac_nonzero"),
    )
    return plain.withColumn("median", exact_quantiles(rows, score, {"m": 0.5}).scalar())


def histogram(rows: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width density histogram per key; the largest value falls into the last bin.

    Every bin of a key has a row, but a key whose values are all equal has one bin; null and NaN values are left out.
    """
    by = list(by)
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    # A struct, so that a null key meets itself.
    key = ["_k"] if by else []
    rows = rows.withColumn("_k", F.struct(*by)) if by else rows
    ends = rows.groupBy(*key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    spec = F.struct("lo", "hi", "total")
    if by:
        # One row per key of the histogram, such as a label or a detector.
        placed = join_checked(rows, ends.select(*key, spec.alias("_e")), key)
    else:
        placed = rows.withColumn("_e", ends.select(spec).scalar())
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    index = F.floor((F.col(value) - F.col("_e.lo")) / width)
    bin_no = F.when(width > 0, F.least(F.greatest(index, F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counted = placed.groupBy(*key, bin_no.alias("bin"), "_e").agg(F.count("*").alias("n"))
    every_bin = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    empty = ends.where("hi > lo").select(*key, every_bin, spec.alias("_e"), F.lit(0).cast("long").alias("n"))
    counted = counted.unionByName(empty).groupBy(*key, "bin", "_e").agg(F.sum("n").alias("n"))
    low = F.col("_e.lo") + F.col("bin") * width
    density = F.when(width > 0, F.col("n") / (F.col("_e.total") * width))
    return counted.select(*[F.col("_k")[c].alias(c) for c in by], "bin", low.alias("bin_lo"), "n", density.alias("density"))


def time_heatmap(
    rows: DataFrame, time: str, score: str, detector: str, detectors: Sequence[str], bins: int = 48
) -> DataFrame:
    """Largest score per time bin and detector; bins without a score hold 0."""
    span = rows.agg(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi")).alias("s")).scalar()
    placed = rows.withColumn("_s", span)
    unit = (F.col(time) - F.col("_s.lo")) / (F.col("_s.hi") - F.col("_s.lo") + F.lit(1e-9))
    index = F.least(F.greatest(F.floor(unit * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    pivot = placed.groupBy(index.alias("bin")).pivot(detector, list(detectors)).agg(F.max(score))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(pivot, "bin", "left").fillna(0.0)


def class_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive, at least 1; 1 without positives."""
    counts = rows.agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_pos"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n_neg"),
    )
    ratio = F.greatest(F.col("n_neg") / F.greatest("n_pos", F.lit(1)), F.lit(1.0))
    return counts.withColumn("weight", F.when(F.col("n_pos") < 1, F.lit(1.0)).otherwise(ratio))


def param_effects(trials: DataFrame, params: Sequence[str], metric: str) -> DataFrame:
    """Mean distance of the group means from the global mean, per parameter.

    Parameters with a single value and trials without a metric (null or NaN) are left out.
    """
    m = F.col(metric).cast("double")
    trials = trials.withColumn("_m", m).where(m.isNotNull() & ~F.isnan(m))
    long = trials.select(
        "_m",
        F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in params])).alias("p"),
    )
    means = long.where("p.value is not null").groupBy("p.param", "p.value").agg(F.avg("_m").alias("mean"))
    overall = trials.agg(F.avg("_m")).scalar()
    return (
        means.groupBy("param")
        .agg(F.avg(F.abs(F.col("mean") - overall)).alias("mean_abs_delta"), F.count("*").alias("values"))
        .where("values > 1")
        .withColumn("global_mean", overall)
    )


def best_row(rows: DataFrame, metric: str, fallback: str, ties: Sequence[str]) -> DataFrame:
    """Row with the largest metric, or the largest fallback where no metric is finite."""

    def finite(c):
        return F.when(~F.isnan(c) & F.col(c).isNotNull(), F.col(c))

    key = F.struct(finite(metric).isNotNull(), F.coalesce(finite(metric), finite(fallback)), *ties)
    usable = finite(metric).isNotNull() | finite(fallback).isNotNull()
    return rows.where(usable).agg(F.max_by(F.struct(*rows.columns), key).alias("b")).where("b is not null").select("b.*")


def peak_by_file(rows: DataFrame, file: str, scores: Sequence[str], label: str = "label") -> DataFrame:
    """Largest score over all models and whether the file holds a positive."""
    score = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    return rows.groupBy(file).agg(F.max(score).alias("peak"), F.max(F.col(label)).alias("has_pos"))


def shortlist(files: DataFrame, file: str, n: int = 12) -> DataFrame:
    """Files with positives first, then by peak score."""
    return files.orderBy(F.desc("has_pos"), F.desc("peak"), file).limit(n)


def fallback_pick(
    scored: DataFrame, dataset: DataFrame, order: Sequence[str], n: int, score: str = "score", subset: str = "subset"
) -> DataFrame:
    """Top scored windows; without scores the positives of VAL, else any VAL rows, scored 1.0.

    Each tier is cut to ``n`` rows before the tiers are combined.
    """
    columns = list(order)
    top = scored.where(F.col(score).isNotNull()).orderBy(F.desc(score), *order).limit(n)
    top = top.select(F.lit(0).alias("tier"), *columns, F.col(score).alias("score"))
    val = dataset.where(F.lower(subset) == "val")
    positive = val.where("label = 1").orderBy(*order).limit(n).select(F.lit(1).alias("tier"), *columns, F.lit(1.0).alias("score"))
    any_val = val.orderBy(*order).limit(n).select(F.lit(2).alias("tier"), *columns, F.lit(1.0).alias("score"))
    # At most 3 n rows are left here.
    tiers = top.unionByName(positive).unionByName(any_val)
    return tiers.withColumn("_first", F.min("tier").over(Window.partitionBy())).where("tier = _first").drop("_first")


def minmax(rows: DataFrame, value: str, out: str = "score") -> DataFrame:
    """Scale an unbounded decision value to [0, 1] over the whole set."""
    ends = rows.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    placed = rows.withColumn("_e", ends)
    width = F.greatest(F.col("_e.hi") - F.col("_e.lo"), F.lit(1e-12))
    return placed.withColumn(out, (F.col(value) - F.col("_e.lo")) / width).drop("_e")


def join_scores(base: DataFrame, models: dict[str, DataFrame], keys: Sequence[str], score: str = "score") -> DataFrame:
    """Attach one score column per model; a missing score stays null."""
    for name, scores in models.items():
        base = base.join(scores.select(*keys, F.col(score).alias(name)), list(keys), "left")
    return base


def teacher_scores(history: DataFrame, keys: Sequence[str], order: str, score: str = "score", out: str = "teacher") -> DataFrame:
    """Last known score per key."""
    return history.groupBy(*keys).agg(F.max_by(score, order).alias(out))


def loss_report(rows: DataFrame, label: str, stage1: str, stage2: str, teacher: str) -> DataFrame:
    """Weighted cross entropy of stage 2, stage consistency and distillation error.

    ``stage1`` and ``stage2`` are probabilities. The positive weight is the class ratio;
    consistency counts both directions; the distillation error uses only rows with a
    teacher score, clipped to [0, 1], and is 0 without any.
    """
    weight = class_weight(rows, label).select("weight").scalar()
    p = F.least(F.greatest(F.col(stage2), F.lit(1e-7)), F.lit(1 - 1e-7))
    y = F.col(label).cast("double")
    target = F.least(F.greatest(F.col(teacher), F.lit(0.0)), F.lit(1.0))
    return rows.select("*", weight.alias("_w")).agg(
        F.count("*").alias("n"),
        F.avg(-(F.col("_w") * y * F.log(p) + (1 - y) * F.log(1 - p))).alias("bce"),
        F.avg(2 * F.pow(F.col(stage1) - F.col(stage2), 2)).alias("consistency"),
        F.coalesce(F.avg(F.pow(F.col(stage2) - target, 2)), F.lit(0.0)).alias("distillation"),
        F.count(teacher).alias("n_teacher"),
    )


def grid_scan(points: DataFrame, cost, at: Sequence[str]) -> DataFrame:
    """Number of grid points, mean, largest and smallest cost and where the smallest lies."""
    scored = points.select(*at, cost.alias("cost"))
    best = F.min(F.struct("cost", *at)).alias("b")
    out = scored.agg(F.count("cost").alias("n"), F.avg("cost").alias("mean_cost"), F.max("cost").alias("max_cost"), best)
    return out.select("n", "mean_cost", "max_cost", F.col("b.cost").alias("min_cost"), *[F.col(f"b.{c}").alias(c) for c in at])


def recall_over_trials(trials: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Number of trials, median and largest score, share of trials above the threshold."""
    plain = trials.agg(
        F.count(score).alias("trials"),
        F.max(score).alias("best"),
        F.avg(F.when(F.col(score) > threshold, 1.0).otherwise(0.0)).alias("recall"),
    )
    return plain.withColumn("median_score", exact_quantiles(trials, score, {"m": 0.5}).scalar())
