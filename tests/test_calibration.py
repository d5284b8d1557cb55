"""Isotonic fits against the minimum-maximum formula."""

import numpy as np
import pytest

from wavequery.operators import calibration

KINDS = ("rising", "falling", "noise", "mixed")


def plain_fit(y, w):
    """The value at i is the largest, over starts, of the smallest, over ends, weighted mean."""
    n = len(y)
    s, t = np.concatenate([[0], np.cumsum(y * w)]), np.concatenate([[0], np.cumsum(w)])
    mean = lambda a, b: (s[b + 1] - s[a]) / (t[b + 1] - t[a])
    return np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def made(kind, rng, n):
    y = {"rising": np.arange(n) / n, "falling": -np.arange(n) / n, "noise": rng.integers(0, 2, n).astype(float)}.get(kind)
    return y if y is not None else np.where(np.arange(n) % 7 < 4, np.arange(n) / n, rng.random(n))


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("size, fan", [(3, 2), (9, 16), (100_000, 16)])
def test_fit_in_ranges_equals_the_formula(spark, monkeypatch, kind, size, fan):
    monkeypatch.setattr(calibration, "RANGE_POINTS", size)
    monkeypatch.setattr(calibration, "FAN_IN", fan)
    rng = np.random.default_rng(KINDS.index(kind))
    x, w = np.sort(rng.choice(1000, 50, replace=False)) / 10, rng.integers(1, 9, 50).astype(float)
    y = made(kind, rng, 50)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, y, w)] + [(None, 1.0, 1.0), (float("nan"), 0.0, 5.0), (3.33, None, 1.0)]
    blocks = calibration.isotonic_fit(spark.createDataFrame(rows, "x double, y double, w double").repartition(3)).collect()
    got = np.array([next(b.y for b in blocks if b.lo <= v <= b.hi) for v in x])
    assert np.allclose(got, plain_fit(y, w))
    if kind == "falling":
        assert len(blocks) == 1


def test_values_inside_between_and_outside(spark):
    train = [(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 0), (5.0, 1), (5.0, 1), (None, 1), (4.0, None)]
    rows = [(0, 0.0), (1, 1.0), (2, 2.5), (3, 3.0), (4, 4.0), (5, 5.0), (6, 9.0), (7, None), (8, float("nan"))] + [(9, 2.5)] * 40
    schema = "x int, score double"
    got = calibration.isotonic(spark.createDataFrame(train, "score double, label int"), spark.createDataFrame(rows, schema))
    assert got.columns == ["x", "score", "p"] and got.count() == len(rows)
    third = 1 / 3
    want = {0: 0.0, 1: 0.0, 2: third, 3: third, 4: third + (1 - third) / 2, 5: 1.0, 6: 1.0, 7: None, 8: None, 9: third}
    for r in got.collect():
        assert r.p == (want[r.x] if want[r.x] is None else pytest.approx(want[r.x]))
    assert calibration.isotonic(spark.createDataFrame(train, "score double, label int"), spark.createDataFrame(rows, schema).limit(0)).count() == 0
