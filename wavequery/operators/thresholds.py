"""Threshold choice on operating points. Every function returns one row per ``by`` key.

Operating points use all distinct scores. Ties always resolve to one threshold, so
results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavequery.operators.ranking import operating_points
from wavequery.operators.running import exact_quantiles


def best_f1(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest F1; the lowest threshold wins a tie."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("t"), "precision", "tpr"))
    return points.groupBy(*by).agg(best.alias("b")).select(
        *by, (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"), "b.precision", F.col("b.tpr").alias("recall")
    )


def best_f1_rounded(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Best F1 over scores clipped to [0, 1] and rounded to four digits.

    The end points 0 and 1 take part as thresholds; they carry no row of their own.
    """
    snapped = rows.select(label, F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias(score))
    counts = snapped.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"),
    )
    # At most 10001 thresholds are left, so one ordered window holds them all.
    ends = rows.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "threshold double, pos long, neg long")
    merged = counts.unionByName(ends).groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    down = Window.orderBy(F.desc("threshold"))
    tp, fp, n_pos = F.sum("pos").over(down), F.sum("neg").over(down), F.sum("pos").over(Window.partitionBy())
    points = merged.select(
        "threshold",
        (2 * tp / F.greatest(tp + fp + n_pos, F.lit(1))).alias("f1"),
        (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"),
        (tp / F.greatest(n_pos, F.lit(1))).alias("tpr"),
    )
    return best_f1(points)


def closest_fpr(points: DataFrame, target: float, by: Sequence[str] = (), need_tp: bool = False) -> DataFrame:
    """Smallest distance to the target false positive rate; the highest threshold wins a tie.

    ``need_tp`` rules out points without a true positive as long as others exist.
    """
    gap = F.abs(F.col("fpr") - F.lit(float(target)))
    if need_tp:
        gap = gap + F.when(F.col("tp") == 0, 1e3).otherwise(0.0)
    best = F.min(F.struct(gap.alias("gap"), (-F.col("threshold")).alias("t"), "fpr", "tpr", "tp", "fp"))
    return points.groupBy(*by).agg(best.alias("b")).select(
        *by, (-F.col("b.t")).alias("threshold"), "b.fpr", "b.tpr", "b.tp", "b.fp"
    )


def constrained(
    points: DataFrame, target: float, by: Sequence[str] = (), first_hit: bool = False, strict: bool = False
) -> DataFrame:
    """Highest true positive rate with ``fpr <= target``; else the lowest fpr, then the highest tpr.

    ``first_hit`` stops at the highest score that meets the target. ``strict`` accepts
    no negative at all: rows must score above the highest negative, reported as
    ``above`` for use with ``score > above``.
    """
    allowed = F.col("fpr") <= F.lit(float(target))
    if first_hit:
        pick = F.max(F.when(allowed, F.struct("threshold", "fpr", "tpr")))
        chosen = F.struct(pick["threshold"].alias("t"), pick["fpr"].alias("fpr"), pick["tpr"].alias("tpr"))
    else:
        pick = F.max(F.when(allowed, F.struct("tpr", "threshold", "fpr")))
        chosen = F.struct(pick["threshold"].alias("t"), pick["fpr"].alias("fpr"), pick["tpr"].alias("tpr"))
    relaxed = F.min(F.struct("fpr", (-F.col("tpr")).alias("m"), (-F.col("threshold")).alias("t")))
    fallback = F.struct((-relaxed["t"]).alias("t"), relaxed["fpr"].alias("fpr"), (-relaxed["m"]).alias("tpr"))
    out = points.groupBy(*by).agg(
        chosen.alias("c"),
        fallback.alias("r"),
        F.max(F.when(F.col("neg") > 0, F.col("threshold"))).alias("highest_negative"),
    )
    met = F.col("c.t").isNotNull()
    columns = [
        F.when(met, F.col("c.t")).otherwise(F.col("r.t")).alias("threshold"),
        F.when(met, F.col("c.fpr")).otherwise(F.col("r.fpr")).alias("fpr"),
        F.when(met, F.col("c.tpr")).otherwise(F.col("r.tpr")).alias("tpr"),
        F.when(met, "constrained").otherwise("relaxed").alias("mode"),
    ]
    if strict:
        columns.append(F.col("highest_negative").alias("above"))
    return out.select(*by, *columns)


def at_recall(points: DataFrame, recall: float, by: Sequence[str] = (), fallback: float = 0.999) -> DataFrame:
    """Highest threshold whose recall reaches the target.

    Where none does, as without positives, it is the ``fallback`` quantile of the scores, linear between neighbours; its recall
    and precision are null.
    """
    by = list(by)
    upto = F.col("tp") + F.col("fp")
    reached = F.when(F.col("tpr") >= F.lit(float(recall)), F.struct("threshold", "tpr", "precision"))
    found = points.groupBy(*by).agg(F.max(reached).alias("b"), F.max(upto).alias("_n"))
    if by:
        sized = points.join(found.select(*by, "_n"), by)
    else:
        sized = points.withColumn("_n", found.select("_n").scalar())
    # ``upto`` counts from the highest score down: element i from below is the first to have n - i rows.
    position = F.lit(float(fallback)) * (F.col("_n") - 1)
    at = [F.max(F.when(upto >= F.col("_n") - i, F.col("threshold"))) for i in (F.floor(position), F.ceil(position))]
    part = F.max(position - F.floor(position))
    quantile = sized.groupBy(*by).agg((at[0] + part * (at[1] - at[0])).alias("_q"))
    if by:
        found = found.join(quantile, by)
    else:
        found = found.withColumn("_q", quantile.scalar())
    return found.select(
        *by, F.coalesce("b.threshold", "_q").alias("threshold"), F.col("b.tpr").alias("recall"), "b.precision"
    )


def fpr_grid(points: DataFrame, targets: Sequence[float]) -> DataFrame:
    """Closest operating point for every target rate, in one pass over the points."""
    picks = []
    for target in targets:
        gap = F.abs(F.col("fpr") - F.lit(float(target)))
        best = F.min(F.struct(gap.alias("gap"), (-F.col("threshold")).alias("t"), "fpr", "tpr", "tp", "fp"))
        picks.append(F.struct(F.lit(float(target)).alias("far"), best.alias("b")))
    grid = points.agg(F.array(*picks).alias("g")).select(F.inline("g"))
    return grid.select("far", (-F.col("b.t")).alias("threshold"), "b.fpr", "b.tpr", "b.tp", "b.fp")


def constrained_grid(points: DataFrame, targets: Sequence[float]) -> DataFrame:
    """Highest tpr with ``fpr <= target`` for every target, in one pass over the points."""
    picks = []
    for target in targets:
        allowed = F.when(F.col("fpr") <= F.lit(float(target)), F.struct("tpr", "threshold", "fpr", "precision"))
        relaxed = F.min(F.struct("fpr", (-F.col("tpr")).alias("m"), (-F.col("threshold")).alias("t"), "precision"))
        picks.append(F.struct(F.lit(float(target)).alias("far"), F.max(allowed).alias("b"), relaxed.alias("r")))
    grid = points.agg(F.array(*picks).alias("g")).select(F.inline("g"))
    met = F.col("b").isNotNull()
    return grid.select(
        "far",
        F.when(met, F.col("b.threshold")).otherwise(-F.col("r.t")).alias("threshold"),
        F.when(met, F.col("b.fpr")).otherwise(F.col("r.fpr")).alias("fpr"),
        F.when(met, F.col("b.tpr")).otherwise(-F.col("r.m")).alias("tpr"),
        F.when(met, F.col("b.precision")).otherwise(F.col("r.precision")).alias("precision"),
    )


def guarded(rows: DataFrame, proposed: float, label: str = "label", score: str = "score") -> DataFrame:
    """Repair a proposed threshold that no score reaches or that finds no positive.

    A threshold above every score falls to the highest score. If it accepts no
    positive, the quantile ``clamp(1 - 10 / n_neg, 0.95, 0.999)`` of the scores is used.
    """
    proposed_lit = F.lit(float(proposed))
    top = rows.agg(
        F.max(score).alias("top"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n_neg"),
    ).first()
    usable = min(float(proposed), float(top["top"])) if top["top"] is not None else float(proposed)
    q = min(0.999, max(0.95, 1.0 - 10.0 / max(top["n_neg"] or 0, 1)))
    accepted = rows.agg(
        F.sum(F.when((F.col(label) == 1) & (F.col(score) >= F.lit(usable)), 1).otherwise(0)).alias("tp")
    )
    fallback = exact_quantiles(rows, score, {"v": q}).scalar()
    return accepted.select(
        proposed_lit.alias("proposed"),
        F.lit(q).alias("quantile"),
        F.when(F.coalesce("tp", F.lit(0)) > 0, F.lit(usable)).otherwise(fallback).alias("threshold"),
    )


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "best_f1": lambda points, _target: best_f1(points),
    "target_far": lambda points, target: closest_fpr(points, target, need_tp=True),
    "constrained_roc": lambda points, target: constrained(points, target),
    "target_recall": lambda points, target: at_recall(points, target),
}


def choose(strategy: str, points: DataFrame, target: float = 1e-4) -> DataFrame:
    """Run a threshold strategy by name."""
    try:
        return STRATEGIES[strategy.strip().lower()](points, target)
    except KeyError:
        raise ValueError(f"unknown threshold strategy: {strategy}") from None


def confusion(
    rows: DataFrame, threshold, label: str = "label", score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """Counts and rates at a threshold (a number or a column); denominators are at least one."""
    threshold = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    hit, truth = F.col(score) >= threshold, F.col(label) == 1

    def count(condition):
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))

    counts = rows.groupBy(*by).agg(
        count(~truth & ~hit).alias("tn"),
        count(~truth & hit).alias("fp"),
        count(truth & ~hit).alias("fn"),
        count(truth & hit).alias("tp"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall and false positive rate from confusion counts."""
    one = F.lit(1)
    return (
        counts.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one))
        .withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one))
        .withColumn("fpr", F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), one))
    )


def sweep(points: DataFrame, test: DataFrame, targets: Sequence[float], label: str = "label", score: str = "score") -> DataFrame:
    """Thresholds chosen on the validation points for each target, confusion on the test rows.

    The test rows are read once: the few chosen thresholds are an array that every
    row is compared with, and partial counts are merged per target.
    """
    chosen = constrained_grid(points, targets).collect()
    picks = F.array(
        *[
            F.struct(
                *[F.lit(float(r[c])).alias(n) for c, n in (
                    ("far", "far"), ("threshold", "threshold"), ("fpr", "val_fpr"), ("tpr", "val_tpr"), ("precision", "val_prec")
                )]
            )
            for r in chosen
        ]
    )
    spread = test.select(F.col(label).alias("label"), F.col(score).alias("score"), F.explode(picks).alias("p"))
    keys = ["far", "threshold", "val_fpr", "val_tpr", "val_prec"]
    return confusion(spread.select("label", "score", "p.*"), F.col("threshold"), by=keys)


def class_report(rows: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    A vanishing denominator gives 0.
    """
    counts = confusion(rows, threshold, label, score)

    def ratio(top, bottom):
        return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)

    def of_class(name, hit, called, support):
        return F.struct(
            F.lit(name).alias("class"),
            ratio(F.col(hit), called).alias("precision"),
            ratio(F.col(hit), support).alias("recall"),
            ratio(2 * F.col(hit), called + support).alias("f1"),
            support.alias("support"),
        )

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    both = counts.select(
        of_class("0", "tn", tn + fn, tn + fp).alias("neg"),
        of_class("1", "tp", tp + fp, tp + fn).alias("pos"),
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
    )
    total = F.col("neg.support") + F.col("pos.support")

    def mean(name, weight_neg, weight_pos):
        return F.struct(
            F.lit(name).alias("class"),
            *[
                (F.col(f"neg.{m}") * weight_neg + F.col(f"pos.{m}") * weight_pos).alias(m)
                for m in ("precision", "recall", "f1")
            ],
            total.alias("support"),
        )

    accuracy = F.struct(
        F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(m) for m in ("precision", "recall", "f1")], total.alias("support")
    )
    macro = mean("macro", F.lit(0.5), F.lit(0.5))
    weighted = mean("weighted", ratio(F.col("neg.support"), total), ratio(F.col("pos.support"), total))
    return both.select(F.inline(F.array("neg", "pos", macro, weighted, accuracy)))


def constrained_or_degenerate(
    rows: DataFrame, target: float, label: str = "label", score: str = "score"
) -> DataFrame:
    """:func:`constrained`, or the 99.9 percentile of the scores when only one class occurs."""
    classes = rows.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    if classes["lo"] != classes["hi"]:
        return constrained(operating_points(rows, label, score), target)
    return exact_quantiles(rows, score, {"threshold": 0.999}).select(
        "threshold", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit("degenerate").alias("mode")
    )
