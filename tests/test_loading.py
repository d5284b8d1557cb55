"""Strain tables, window loading and reject reasons."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wavequery.operators import loading
from wavequery.operators import templates as tp
from wavequery.sources import strain as sr

HEADS = "file_id long, detector string, gps_start_us long, n_samples long, fs_attr double, sample_rate_attr double, spacing_attr double"
RNG = np.random.default_rng(11)
SERIES = {1: RNG.normal(size=100), 2: RNG.normal(size=90), 3: RNG.normal(size=64), 4: RNG.normal(size=200)}
SERIES[1][40:60] = np.nan
SERIES[2][50] = 500.0
RATES = {1: (16.0, None, None), 2: (None, None, 1 / 16), 3: (None, None, None), 4: (None, 32.0, None)}


@pytest.fixture(scope="module")
def strain(spark, tmp_path_factory):
    rows = [(f, i, float(v)) for f, x in SERIES.items() for i, v in enumerate(x)]
    series = spark.createDataFrame(rows, "file_id long, idx long, x double").repartition(4)
    heads = [(f, "H1" if f < 3 else "L1", 1_000_000_000 * f, len(x), *RATES[f]) for f, x in SERIES.items()]
    path = str(tmp_path_factory.mktemp("strain") / "t")
    sr.write_strain(sr.strain_table(series, spark.createDataFrame(heads, HEADS), 32), path)
    return sr.read_strain(spark, path)


def test_headers_follow_the_rate_rule(strain):
    got = {r.file_id: (r.detector, r.gps_start_us, r.fs, r.n_samples) for r in sr.file_headers(strain).collect()}
    assert got == {f: ("H1" if f < 3 else "L1", 10**9 * f, fs, len(SERIES[f])) for f, fs in ((1, 16), (2, 16), (3, None), (4, 32))}
    assert sr.incomplete_files(strain).count() == 0


def test_wrong_chunks_are_noticed(strain):
    short = strain.withColumn("samples", F.when(F.col("chunk_id") == 1, F.slice("samples", 1, 30)).otherwise(F.col("samples")))
    with pytest.raises(PySparkException, match="is not where its length puts it"):
        sr.checked(short).collect()
    with pytest.raises(PySparkException, match="is not where its length puts it"):
        sr.checked(strain.withColumn("first_idx", F.col("first_idx") + 1)).collect()
    got = sr.incomplete_files(strain.where("NOT (file_id = 4 AND chunk_id = 2)")).collect()
    assert [(r.file_id, r.n_chunks, r.expected) for r in got] == [(4, 6, 7)]
    assert sr.incomplete_files(strain.union(strain)).count() == 4


def test_window_index(strain):
    got = sorted((r.file_id, r.start_idx, r.start_us) for r in sr.window_index(strain, 10, 32).collect())
    want = [
        (f, i, 10**9 * f + i * 1_000_000 // fs if fs else None)
        for f, fs in ((1, 16), (2, 16), (3, None), (4, 32)) for i in range(0, len(SERIES[f]) - 31, 10)
    ]
    assert got == sorted(want, key=lambda r: r[:2])


def plain(x, length, peak, kurt):
    good = np.isfinite(x)
    if not good.any():
        return None, "non_finite"
    x = np.where(good, x, x[good].mean())
    x = x[-length:] if len(x) >= length else np.append(np.zeros(length - len(x)), x)
    z = (x - x.mean()) / (x.std() + 1e-12)
    if np.abs(z).max() > peak:
        return None, "glitch_veto_peak"
    if (((z - z.mean()) / (z.std() + 1e-12)) ** 4).mean() > kurt:
        return None, "glitch_veto_kurt"
    return z, None


def test_every_reason_and_wave(spark, strain):
    index = sr.window_index(strain, 4).withColumn("start_us", F.coalesce("start_us", "start_idx"))
    index = index.union(spark.createDataFrame([(1, -5, -1)], index.schema))
    rows = [(r.file_id, r.start_us, r.start_idx) for r in index.collect()] + [(1, 77, None), (9, 0, None), (None, 0, None), (1, None, None)]
    wanted = spark.createDataFrame([(i, f, t) for i, (f, t, _) in enumerate(rows)], "window_id long, file_id long, start_us long")
    got = {r.window_id: r for r in loading.loaded_windows(wanted, index, strain, 1.0, 16, 3.5, 5.0).collect()}
    assert len(got) == len(rows)
    seen = set()
    for i, (f, _, at) in enumerate(rows):
        fs = {1: 16, 2: 16, 4: 32}.get(f)
        if at is None:
            want = (None, "miss_sgps")
        elif fs is None:
            want = (None, "fs_unknown")
        elif at < 0 or at + fs > len(SERIES[f]):
            want = (None, "out_of_bounds")
        elif fs == 16:
            want = plain(SERIES[f][at : at + fs], 16, 3.5, 5.0)
        else:
            assert got[i].reason is not None or len(got[i].wave) == 16
            continue
        seen.add(want[1])
        assert got[i].reason == want[1]
        assert got[i].wave is None if want[0] is None else np.allclose(got[i].wave, want[0])
    assert seen == {None, "miss_sgps", "fs_unknown", "out_of_bounds", "non_finite", "glitch_veto_peak", "glitch_veto_kurt"}


def test_resampling_keeps_a_slow_tone():
    t = np.arange(256) / 64.0
    for up, down in ((1, 2), (3, 4), (2, 1)):
        n = -(-256 * up // down)
        got = loading.resampled_rows(np.sin(2 * np.pi * t)[None, :], up, down)[0]
        assert np.allclose(got[60:-60], np.sin(2 * np.pi * np.arange(n) / (64.0 * up / down))[60:-60], atol=2e-2)


def test_rejected_windows_score_zero(spark):
    windows = spark.createDataFrame(
        [(1, [1.0, 2.0, 3.0, 2.0], "a"), (2, None, "b"), (3, [float("nan")] * 4, "c"), (4, [0.0] * 3 + [1e9], "d"), (5, [], "e")],
        "window_id long, wave array<double>, label string",
    )
    bank = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 2.0])], "template_id long, wave array<double>")
    checked = loading.checked_windows(windows, 4, 1.7, 80.0)
    got = {r.window_id: (r.label, r.reason, round(r.score, 6)) for r in tp.pooled_scores(checked, bank, 1, keep=("label", "reason")).collect()}
    assert got[1][:2] == ("a", None) and got[1][2] > 0
    assert {k: got[k][1:] for k in (2, 3, 4, 5)} == {
        2: ("out_of_bounds", 0), 3: ("non_finite", 0), 4: ("glitch_veto_peak", 0), 5: ("non_finite", 0)
    }
