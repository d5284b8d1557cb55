import numpy as np
import pytest

from wavequery.operators import ranking as rk
from wavequery.operators import thresholds as th


def scored(spark, labels, scores):
    return spark.createDataFrame([(int(y), float(s)) for y, s in zip(labels, scores)], "label int, score double")


def brute_auc(y, s):
    p, n = s[y == 1], s[y == 0]
    wins = (p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()
    return wins / (len(p) * len(n))


def brute_ap(y, s):
    order = np.unique(s)[::-1]
    total, last = 0.0, 0
    for t in order:
        tp, k = ((s >= t) & (y == 1)).sum(), (s >= t).sum()
        total += (tp - last) * tp / k
        last = tp
    return total / (y == 1).sum()


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.3).astype(int)
    return y, np.round(rng.normal(y * 0.7, 1.0), 1)


def test_auc_ap_with_ties(spark, sample):
    y, s = sample
    points = rk.operating_points(scored(spark, y, s))
    assert rk.roc_auc(points).first()["auc"] == pytest.approx(brute_auc(y, s))
    assert rk.average_precision(points).first()["ap"] == pytest.approx(brute_ap(y, s))


def test_auc_invariant_under_monotone_map(spark, sample):
    y, s = sample
    a = rk.roc_auc(rk.operating_points(scored(spark, y, s))).first()["auc"]
    b = rk.roc_auc(rk.operating_points(scored(spark, y, np.exp(s / 3)))).first()["auc"]
    assert a == pytest.approx(b)


@pytest.mark.parametrize("sign, want", [(1, 1.0), (-1, 0.0)])
def test_perfect_and_inverted(spark, sign, want):
    rows = scored(spark, [0, 0, 1, 1], [sign * v for v in (1, 2, 3, 4)])
    assert rk.roc_auc(rk.operating_points(rows)).first()["auc"] == want


def test_one_class(spark):
    rows = scored(spark, [0, 0, 0], [1, 2, 3])
    assert rk.roc_auc(rk.operating_points(rows)).first()["auc"] is None
    row = th.constrained_or_degenerate(rows, 0.1).first()
    assert row["mode"] == "degenerate" and row["threshold"] == pytest.approx(np.percentile([1, 2, 3], 99.9))


def test_thresholds_against_scan(spark, sample):
    y, s = sample
    points = rk.operating_points(scored(spark, y, s))
    grid = np.unique(s)
    tp = np.array([((s >= t) & (y == 1)).sum() for t in grid])
    fp = np.array([((s >= t) & (y == 0)).sum() for t in grid])
    tpr, fpr = tp / (y == 1).sum(), fp / (y == 0).sum()
    f1 = 2 * tp / (tp + fp + (y == 1).sum())
    assert th.best_f1(points).first()["threshold"] == grid[np.argmax(f1)]
    allowed = fpr <= 0.1
    best = tpr[allowed].max()
    assert th.constrained(points, 0.1).first()["threshold"] == grid[allowed & (tpr == best)].max()
    assert th.at_recall(points, 0.4).first()["threshold"] == grid[tpr >= 0.4].max()
    gap = np.abs(fpr - 0.2)
    assert th.closest_fpr(points, 0.2).first()["threshold"] == grid[gap == gap.min()].max()
    assert th.constrained(points, 0.1, first_hit=True).first()["threshold"] == grid.max()
    assert th.constrained(points, 0.1, strict=True).first()["above"] == s[y == 0].max()
    swept = {r["far"]: r["threshold"] for r in th.constrained_grid(points, [0.1]).collect()}
    assert swept[0.1] == th.constrained(points, 0.1).first()["threshold"]


def test_relaxed_branch(spark):
    row = th.constrained(rk.operating_points(scored(spark, [0, 1, 0], [3, 2, 1])), 0.1).first()
    assert (row["mode"], row["threshold"]) == ("relaxed", 2.0)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        th.choose("nonsense", rk.operating_points(scored(spark, [0, 1], [0, 1])))


def test_guard(spark):
    rows = scored(spark, [1] + [0] * 99, [0.5] + [i / 100 for i in range(1, 100)])
    row = th.guarded(rows, 5.0).first()
    q = min(0.999, max(0.95, 1 - 10 / 99))
    assert row["threshold"] == pytest.approx(np.quantile([0.5] + [i / 100 for i in range(1, 100)], q))
    assert th.guarded(rows, 0.4).first()["threshold"] == 0.4


def test_rank_normalized(spark):
    rows = spark.createDataFrame([(v,) for v in (3.0, 1.0, 2.0, 2.0)], "v double")
    got = sorted((r["v"], r["rank_norm"]) for r in rk.rank_normalized(rows, "v").collect())
    assert got == [(1.0, 0.0), (2.0, 1 / 3), (2.0, 1 / 3), (3.0, 1.0)]


def test_confusion_and_report(spark):
    rows = scored(spark, [1, 1, 0, 0, 0], [0.9, 0.2, 0.8, 0.1, 0.3])
    c = th.confusion(rows, 0.5).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (2, 1, 1, 1)
    report = {r["class"]: r for r in th.class_report(rows, 0.5).collect()}
    assert report["accuracy"]["f1"] == 0.6 and report["1"]["support"] == 2
    nobody = {r["class"]: r for r in th.class_report(rows, 2.0).collect()}
    assert nobody["1"]["precision"] == 0.0


@pytest.mark.parametrize("by", [[], ["k"]])
def test_unreachable_recall_falls_back_to_a_quantile(spark, by):
    rng = np.random.default_rng(4)
    scores = {"a": np.round(rng.normal(size=700), 1), "b": np.array([3.0]), "c": rng.normal(size=50)}
    rows = [(k, float(v), int(k == "c" and i == 0)) for k, x in scores.items() for i, v in enumerate(x)]
    if not by:
        rows = [r for r in rows if r[0] == "a"]
    points = rk.operating_points(spark.createDataFrame(rows, "k string, score double, label int"), by=by)
    got = {r["k"] if by else "a": r for r in th.at_recall(points, 0.9, by=by).collect()}
    assert got["a"]["threshold"] == pytest.approx(np.percentile(scores["a"], 99.9)) and got["a"]["recall"] is None
    if by:
        assert got["b"]["threshold"] == 3.0 and got["c"]["threshold"] == scores["c"][0] and got["c"]["recall"] == 1.0
