"""Ordered evaluation: operating points, ROC and PR curves, AUC, average precision.

Rows are first counted per distinct score (a map-side combined aggregate, so a
score shared by many rows costs one row), then running counts along descending
scores give every operating point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequery.operators.running import range_edges, running, with_hash_bucket, with_range_bucket


def score_counts(rows: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    positive = F.when(F.col(label) == 1, 1).otherwise(0)
    return rows.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


def operating_points(
    rows: DataFrame,
    label: str = "label",
    score: str = "score",
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct score, used as threshold ``score >= threshold``.

    Columns: ``threshold, pos, neg, tp, fp, n_pos, n_neg, tpr, fpr, precision, f1``.
    """
    counts = score_counts(rows, label, score, by)
    binned = with_range_bucket(counts, "threshold", range_edges(rows, score, buckets))
    points = running(
        binned, "threshold", {"tp": ("sum", "pos"), "fp": ("sum", "neg")}, by=by, descending=True, totals=True
    )
    tp, fp = F.col("tp"), F.col("fp")
    n_pos, n_neg = F.col("tp_total"), F.col("fp_total")
    return points.select(
        *by,
        "threshold",
        "pos",
        "neg",
        "tp",
        "fp",
        n_pos.alias("n_pos"),
        n_neg.alias("n_neg"),
        (tp / F.greatest(n_pos, F.lit(1))).alias("tpr"),
        (fp / F.greatest(n_neg, F.lit(1))).alias("fpr"),
        (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"),
        (2 * tp / F.greatest(tp + fp + n_pos, F.lit(1))).alias("f1"),
    )


def roc_auc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware area under the ROC curve; null when a class is missing."""
    n_pos, n_neg = F.max("n_pos").cast("double"), F.max("n_neg").cast("double")
    below = F.col("n_neg") - F.col("fp") + F.col("neg") / 2
    wins = F.sum(F.col("pos") * below)
    return points.groupBy(*by).agg(F.when((n_pos > 0) & (n_neg > 0), wins / n_pos / n_neg).alias("auc"))


def average_precision(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision over the distinct scores; null without positives."""
    n_pos = F.max("n_pos").cast("double")
    gained = F.sum(F.col("pos") * F.col("precision"))
    return points.groupBy(*by).agg(F.when(n_pos > 0, gained / n_pos).alias("ap"))


def rank_normalized(rows: DataFrame, value: str, buckets: int | None = None, out: str = "rank_norm") -> DataFrame:
    """``(rank - 1) / (n - 1)`` ascending; equal values share the lowest rank, a null has none."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    ranked = running(
        with_range_bucket(counts, value, range_edges(rows, value, buckets)), value, {"_upto": ("sum", "_n")}, totals=True
    )
    ranks = ranked.select(
        value,
        F.when(F.col("_upto_total") > 1, (F.col("_upto") - F.col("_n")) / (F.col("_upto_total") - 1))
        .otherwise(F.lit(0.0))
        .alias(out),
    )
    return rows.join(ranks, value, "left")


def seeded_unit(key: Column | str, seed: int) -> Column:
    """A reproducible value in [0, 1) from sha1 of the key and a seed."""
    text = F.concat(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(f"|{seed}"))
    return hash_unit(text)


def hash_unit(text: Column) -> Column:
    """First eight bytes of sha1 as a fraction of 2^64."""
    head = F.substring(F.sha1(text), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hash_ranked(rows: DataFrame, unit: str, ties: Sequence[str], by: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """Rank rows by a hash that is uniform on [0, 1), spread over equal hash ranges."""
    binned = with_hash_bucket(rows, unit)
    return running(binned, [unit, *ties], {out: ("sum", F.lit(1).cast("long"))}, by=by, totals=True).drop("_bucket")
