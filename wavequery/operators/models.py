"""Tabular, two-stage and calibrated classifiers on Spark ML."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Bucketizer, Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequery.operators.ranking import average_precision, hash_unit, operating_points, roc_auc
from wavequery.operators.splits import downsample
from wavequery.session import cut_lineage


def feature_stages(
    features: Sequence[str], scale: bool = True, log_columns: Sequence[str] = (), category: str | None = None
) -> list:
    """Median imputation, optional log1p and one-hot stages, assembly, standardization."""
    stages: list = []
    columns = list(features)
    if log_columns:
        changed = ", ".join(f"log1p(greatest({c}, 0)) AS {c}_log" for c in log_columns)
        stages.append(SQLTransformer(statement=f"SELECT *, {changed} FROM __THIS__"))
        columns = [f"{c}_log" if c in log_columns else c for c in columns]
    filled = [f"{c}_filled" for c in columns]
    stages.append(Imputer(strategy="median", inputCols=columns, outputCols=filled))
    assembled = list(filled)
    if category:
        stages.append(StringIndexer(inputCol=category, outputCol=f"{category}_index", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{category}_index"], outputCols=[f"{category}_hot"]))
        assembled.append(f"{category}_hot")
    stages.append(VectorAssembler(inputCols=assembled, outputCol="raw_features", handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
    else:
        stages[-1].setOutputCol("features")
    return stages


def binned_stages(train: DataFrame, features: Sequence[str], bins: int = 32) -> list:
    """Median imputation, the quantile bin of each feature (``bins`` at most, the number a tree looks at), assembly."""
    filled, binned = [f"{c}_filled" for c in features], [f"{c}_bin" for c in features]
    edges = train.approxQuantile(list(features), [i / bins for i in range(1, bins)], 0.1 / bins)
    splits = [[float("-inf"), *(sorted(set(e)) or [0.0]), float("inf")] for e in edges]
    buckets = Bucketizer(splitsArray=splits, inputCols=filled, outputCols=binned, handleInvalid="keep")
    return [Imputer(strategy="median", inputCols=list(features), outputCols=filled), buckets, VectorAssembler(inputCols=binned, outputCol="features")]


# Rows that a weighted row stands for at least, where a cell of bins has many; draws of a tree take or leave one of these.
CELL_PARTS = 16


def fit_on_cells(train: DataFrame, stages: list, learner) -> PipelineModel:
    """Fit on weighted rows: rows of one label in the same bins of all features look the same to a tree.

    A cell with up to ``CELL_PARTS`` rows keeps them one by one; a larger one is that many rows of equal weight. So a tree
    reads rows by the number of cells, and every row counts, by its own weight if ``train`` has the learner's weight column.
    """
    prepared = Pipeline(stages=stages).fit(train)
    names = stages[-1].getInputCols()
    own = learner.isSet(learner.weightCol) and learner.getWeightCol() in train.columns
    whole = F.sum(learner.getWeightCol()) if own else F.count("*")
    rows = prepared.transform(train).groupBy(*names, learner.getLabelCol()).agg(F.count("*").alias("_n"), whole.alias("_w"))
    parts = F.least(F.col("_n"), F.lit(CELL_PARTS)).cast("int")
    cells = rows.withColumn("weight", F.col("_w") / parts).withColumn("_part", F.explode(F.sequence(F.lit(1), parts)))
    # Stored once: draws of the trees stay the same.
    cells = cut_lineage(stages[-1].transform(cells).select("features", learner.getLabelCol(), "weight"))
    return PipelineModel([*prepared.stages, learner.copy({learner.weightCol: "weight"}).fit(cells)])


def boosted_trees(trees: int = 600, depth: int = 6, rate: float = 0.05, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.9, featureSubsetStrategy="0.8", seed=seed,
        labelCol="label",
    )


def balanced_logistic() -> LogisticRegression:
    return LogisticRegression(labelCol="label", weightCol="weight", maxIter=50)


def forest(trees: int = 300, depth: int = 8, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", weightCol="weight")


def with_class_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: each class gets half of the total weight."""
    n = F.count("*")
    n_pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    # Counted here: as a subquery they would be counted again in every pass of a fit.
    total, positive = rows.agg(n, F.coalesce(n_pos, F.lit(0))).first()
    share = F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(total - positive))
    return rows.withColumn("weight", F.lit(total) / (2 * F.greatest(share, F.lit(1))))


def fit(train: DataFrame, stages: list, learner) -> PipelineModel:
    return Pipeline(stages=[*stages, learner]).fit(train)


def score(model, rows: DataFrame, keep: Sequence[str], out: str = "score") -> DataFrame:
    """Probability of the positive class of every row."""
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias(out))


def save_and_load(model: PipelineModel, path: str) -> PipelineModel:
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def stacked(
    train: DataFrame, rows: DataFrame, cheap: Sequence[str], full: Sequence[str], keep: Sequence[str], trees: int, depth: int
) -> DataFrame:
    """Two stages: a logistic score on cheap features joins the features of boosted trees.

    Adds ``score1`` and ``score2``; the second is the output of the pair.
    """
    first = fit(with_class_weight(train), feature_stages(cheap), balanced_logistic())
    internal = ["features", "raw_features", "rawPrediction", "prediction", "probability", *[f"{c}_filled" for c in cheap]]

    def staged(df: DataFrame) -> DataFrame:
        scored = first.transform(df).withColumn("score1", vector_to_array("probability")[1])
        return scored.drop(*internal)

    scored = staged(train)
    second = fit_on_cells(scored, binned_stages(scored, [*full, "score1"]), boosted_trees(trees, depth))
    return score(second, staged(rows), [*keep, "score1"], "score2")


def fold_of(key: str, folds: int = 3, seed: int = 42):
    return F.floor(hash_unit(F.concat(F.col(key).cast("string"), F.lit(f"|fold|{seed}"))) * folds).cast("int")


def sigmoid_calibrated(
    train: DataFrame, rows: DataFrame, key: str, features: Sequence[str], keep: Sequence[str], folds: int = 3
) -> DataFrame:
    """Sigmoid calibration per fold: each fold has a model of the others and a calibrator on its own scores.

    ``p`` is the mean of the calibrated scores of all folds, ``score`` the mean of their plain scores.
    """
    # Stored once with what the fits read: every fold passes over it several times.
    folded = cut_lineage(train.select(*dict.fromkeys([*features, "label"]), fold_of(key, folds).alias("fold")))
    assemble = VectorAssembler(inputCols=["score"], outputCol="features")
    scored = rows
    for k in range(folds):
        model = fit(with_class_weight(folded.where(F.col("fold") != k)), feature_stages(features), balanced_logistic())
        held_out = score(model, folded.where(F.col("fold") == k), ["label"])
        calibrator = Pipeline(stages=[assemble, LogisticRegression(labelCol="label")]).fit(held_out)
        names = list(scored.columns)
        scored = score(calibrator, score(model, scored, names), [*names, F.col("score").alias(f"_m{k}")], f"_p{k}")

    def mean(prefix: str):
        return sum((F.col(f"{prefix}{k}") for k in range(1, folds)), F.col(f"{prefix}0")) / folds

    return scored.select(*keep, mean("_m").alias("score"), mean("_p").alias("p"))


def multi_seed(
    train: DataFrame,
    val: DataFrame,
    key: str,
    features: Sequence[str],
    seeds: Sequence[int],
    make: Callable[[int], object],
    max_pos: int | None = None,
    neg_per_pos: int | None = None,
) -> DataFrame:
    """Train once per seed: ``(seed, ap, auc, n_train, wall_s)``.

    ``max_pos`` and ``neg_per_pos`` bound the training sample, drawn anew per seed; by default it is all rows.
    """
    rows = []
    for seed in seeds:
        start = time.time()
        # Stored once: a fit and its metrics read them many times.
        sample = cut_lineage(downsample(train, key, max_pos=max_pos, neg_per_pos=neg_per_pos, seed=seed))
        model = fit(with_class_weight(sample), feature_stages(features), make(seed))
        points = cut_lineage(operating_points(cut_lineage(score(model, val, ["label"]))))
        auc, ap = roc_auc(points).first()["auc"], average_precision(points).first()["ap"]
        rows.append((seed, ap, auc, sample.count(), time.time() - start))
    return train.sparkSession.createDataFrame(rows, "seed long, ap double, auc double, n_train long, wall_s double")


def spread(trials: DataFrame, metric: str) -> DataFrame:
    """Mean, sample deviation and range of a metric over trials."""
    return trials.agg(
        F.count(metric).alias("trials"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
        F.min(metric).alias("lo"), F.max(metric).alias("hi"),
    )


def principal_components(rows: DataFrame, vector: str, keep: Sequence[str], k: int = 2) -> DataFrame:
    """Projection of the centred vectors on the first ``k`` principal components, as ``pc1 ...``.

    Only the component matrix and the mean (one value per dimension) reach the driver. A
    component points to where its largest loading is positive.
    """
    model = PCA(k=k, inputCol=vector, outputCol="_p").fit(rows)
    loadings = model.pc.toArray()
    mean = rows.select(Summarizer.mean(F.col(vector)).alias("m")).first()["m"].toArray()
    columns = []
    for i in range(k):
        axis = loadings[:, i]
        sign = 1.0 if axis[abs(axis).argmax()] > 0 else -1.0
        columns.append(((F.col("_a")[i] - F.lit(float(axis @ mean))) * F.lit(sign)).alias(f"pc{i + 1}"))
    return model.transform(rows).withColumn("_a", vector_to_array("_p")).select(*keep, *columns)
