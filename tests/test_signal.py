import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequery.operators import gaps, signal

RATE, CHUNK = 256.0, 512


def chunks(spark, series, chunk=CHUNK):
    rows = [
        (f, i // chunk, i, [float(v) for v in x[i : i + chunk]]) for f, x in series.items() for i in range(0, len(x), chunk)
    ]
    return spark.createDataFrame(rows, "file_id long, chunk_id long, first_idx long, samples array<double>").repartition(5)


def joined(df):
    parts = df.orderBy("file_id", "first_idx").toPandas()
    return {f: np.concatenate(g["samples"].tolist()) for f, g in parts.groupby("file_id")}


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(0)
    t = np.arange(5 * CHUNK + 130) / RATE
    tone = np.sin(2 * np.pi * 40 * t) + 3 * np.sin(2 * np.pi * 2 * t)
    return {1: tone + rng.normal(size=len(t)), 2: rng.normal(size=3 * CHUNK) + 5.0}


@pytest.mark.parametrize("length, hop", [(128, 64), (128, 32), (64, 64), (512, 256)])
def test_segments(spark, series, length, hop):
    got = signal.segments(chunks(spark, series), CHUNK, length, hop).toPandas()
    for f, x in series.items():
        mine = got[got["file_id"] == f].sort_values("seg")
        starts = range(0, len(x) - length + 1, hop)
        assert mine["seg"].tolist() == [s // hop for s in starts]
        assert np.array_equal(np.array(mine["samples"].tolist()), np.array([x[s : s + length] for s in starts]))


def test_welch(spark, series):
    got = signal.welch_psd(chunks(spark, series), CHUNK, RATE, 128, 64).orderBy("file_id", "bin").toPandas()
    for f, x in series.items():
        cut = np.array([x[s : s + 128] for s in range(0, len(x) - 127, 64)])
        cut = cut - cut.mean(axis=1, keepdims=True)
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(128) / 128)
        p = np.abs(np.fft.rfft(cut * w)) ** 2 / (RATE * (w**2).sum())
        p[:, 1:-1] *= 2
        assert np.allclose(got[got["file_id"] == f]["psd"], p.mean(axis=0))
    first = got[got["file_id"] == 1]
    assert first[first["freq"] > 10].sort_values("psd").iloc[-1]["freq"] == 40.0
    # Parseval: the density of unit white noise integrates to one.
    assert got[got["file_id"] == 2]["psd"].sum() * RATE / 128 == pytest.approx(1.0, rel=0.1)


def test_halo_and_core(spark, series):
    blocks = signal.with_halo(chunks(spark, series), 100)
    for r in blocks.collect():
        x = series[r["file_id"]]
        lo = max(0, r["first_idx"] - 100)
        hi = min(len(x), r["first_idx"] + r["core_len"] + 100)
        assert np.array_equal(r["samples"], x[lo:hi])
    back = joined(signal.core(blocks))
    assert all(np.array_equal(back[f], series[f]) for f in series)


def test_bandpass_equals_whole_series_filter(spark, series):
    got = joined(signal.core(signal.filtered(signal.with_halo(chunks(spark, series), 500), RATE, 20.0, 60.0)))
    x = series[1]
    size = 1 << 14
    gain = signal.bandpass_gain(np.fft.rfftfreq(size, 1 / RATE), RATE, 20.0, 60.0)
    want = np.fft.irfft(np.fft.rfft(x, size) * gain, size)[: len(x)]
    assert np.abs(got[1] - want).max() < 1e-3


def test_gains():
    f = np.array([0.0, 2.0, 40.0, 110.0, 128.0])
    g = signal.bandpass_gain(f, RATE, 20.0, 60.0)
    assert g[0] == 0 and g[1] < 1e-6 and g[2] > 0.99 and g[3] < 1e-3
    # Half power at the edges of the band, squared by the two passes.
    assert signal.bandpass_gain(np.array([20.0]), RATE, 20.0, 60.0)[0] == pytest.approx(0.5)
    n = signal.notch_gain(np.array([30.0, 60.0, 45.0]), RATE, 30.0, 2)
    assert n[0] < 1e-9 and n[1] < 1e-9 and n[2] > 0.9


def test_whiten(spark, series):
    white = signal.whiten(chunks(spark, series), CHUNK, RATE, 128, 64, 256)
    out = joined(white)
    for x in out.values():
        assert x.mean() == pytest.approx(0.0, abs=1e-9) and x.std() == pytest.approx(1.0, abs=1e-6)
    level = signal.welch_psd(white, CHUNK, RATE, 128, 64).where("file_id = 1 and bin between 4 and 60").toPandas()["psd"]
    assert level.max() / level.min() < 3.0


def test_resample_tone(spark):
    t = np.arange(4 * CHUNK) / RATE
    x = np.sin(2 * np.pi * 10 * t)
    up, down = signal.rational_ratio(192, RATE)
    got = joined(signal.resampled(chunks(spark, {1: x}), up, down, 64))[1]
    assert (up, down) == (3, 4) and len(got) == 3 * CHUNK
    want = np.sin(2 * np.pi * 10 * np.arange(len(got)) / 192)
    assert np.abs(got - want)[40:-40].max() < 5e-3


def test_spectrogram_peak(spark, series):
    got = signal.spectrogram(chunks(spark, series), CHUNK, RATE, 256).where("file_id = 1 and freq > 10").toPandas()
    assert set(got.loc[got.groupby("t_bin")["psd"].idxmax(), "freq"]) == {40.0}
    assert np.allclose(got["db"], 10 * np.log10(got["psd"] + 1e-10))


def test_reweighted_snr_prefers_the_true_template():
    rng = np.random.default_rng(4)
    n = 512
    bank = rng.normal(size=(4, n))
    # The filter looks around the centre, so the signal is the template moved by half a window.
    x = np.roll(bank[2], n // 2) + 0.5 * rng.normal(size=n)
    new, plain = signal.snr_peaks(x, bank, RATE, 5.0, 128, 8, 0.02)
    assert plain.argmax() == 2 and new.argmax() == 2 and (new <= plain + 1e-9).all()


def test_preprocess(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f, bad in ((1, 0.05), (2, 0.6)):
        for i in range(4 * CHUNK):
            rows.append((f, i, i // CHUNK, None if rng.random() < bad else float(rng.normal())))
    s = spark.createDataFrame(rows, "file_id long, idx long, chunk_id long, x double")
    white, stats = signal.preprocess(gaps.chunked(s), CHUNK, RATE, 20.0, 100.0, 128, 64, 256, target_rate=192)
    assert [r["file_id"] for r in stats.collect()] == [1]
    out = joined(white)
    assert set(out) == {1} and len(out[1]) == 3 * CHUNK


# --- gaps --------------------------------------------------------------------------


def long_form(spark, values, chunk=4):
    rows = [(f, i, i // chunk, v) for f, x in values.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "file_id long, idx long, chunk_id long, x double")


NAN, INF = float("nan"), float("inf")
CASES = {
    1: [None, None, 1.0, NAN, 3.0, None, None, None, None, None, None, None, 11.0, -INF],
    2: [None, NAN, INF],
    3: [1.0, 2.0],
}


def gap_chunks(spark, values, chunk=4):
    return gaps.chunked(long_form(spark, values, chunk)).repartition(3)


@pytest.mark.parametrize("group", [1, 2, 1024])
def test_gap_fill(spark, monkeypatch, group):
    monkeypatch.setattr(gaps, "CHUNK_GROUP", group)
    got = joined(gaps.gap_fill(gap_chunks(spark, CASES)))
    for f, x in CASES.items():
        v = np.array([np.nan if e is None else e for e in x])
        good = np.isfinite(v)
        want = np.interp(np.arange(len(v)), np.flatnonzero(good), v[good]) if good.any() else np.zeros(len(v))
        assert np.allclose(got[f], want)


def test_gap_runs(spark):
    got = sorted(tuple(r) for r in gaps.gap_runs(gap_chunks(spark, CASES), 2).collect())
    assert got == [(1, 0, 2, 0), (1, 3, 1, 0), (1, 5, 7, 1), (1, 13, 1, 0), (2, 0, 3, 1)]


def test_random_gaps_at_any_chunk_length(spark):
    rng = np.random.default_rng(7)
    series = {}
    for f in range(12):
        x = rng.normal(size=rng.integers(1, 60))
        bad = np.repeat(rng.random(30) < rng.random(), 2)[: len(x)]
        series[f] = [None if b else float(v) for v, b in zip(x, bad)]
    for chunk in (1, 3, 64):
        frame = gap_chunks(spark, series, chunk)
        got = joined(gaps.gap_fill(frame))
        runs = {(r["file_id"], r["run_start"]): r["run_length"] for r in gaps.gap_runs(frame, 2).collect()}
        want_runs = {}
        for f, x in series.items():
            v = np.array([np.nan if e is None else e for e in x])
            good = np.isfinite(v)
            assert np.allclose(got[f], np.interp(np.arange(len(v)), np.flatnonzero(good), v[good]) if good.any() else 0.0)
            at = 0
            while at < len(v):
                stop = at
                while stop < len(v) and not good[stop]:
                    stop += 1
                if stop > at:
                    want_runs[f, at] = stop - at
                at = stop + 1
        assert runs == want_runs
    assert gaps.gap_fill(frame.limit(0)).count() == 0


@pytest.mark.parametrize("policy, files", [("interp", {3}), ("zero", {3}), ("skip", {3}), ("strict", {3}), ("other", {3})])
def test_policy(spark, policy, files):
    out = gaps.nan_policy(gap_chunks(spark, CASES), policy, 0.3)
    assert {r["file_id"] for r in out.select("file_id").distinct().collect()} == files
    if policy in ("interp", "zero"):
        got = joined(gaps.nan_policy(gap_chunks(spark, {5: [1.0, None, 3.0, 5.0, None, None, 8.0]}), policy, 0.5))
        assert got[5].tolist() == ([1, 2, 3, 5, 6, 7, 8] if policy == "interp" else [1, 0, 3, 5, 0, 0, 8])


def test_window_slices(spark):
    x = np.arange(22.0)
    s = gaps.chunked(long_form(spark, {1: x.tolist()}, chunk=8), value="x")
    w = spark.createDataFrame([(1, i) for i in (-1, 0, 5, 7, 12, 13)], "file_id long, start_idx long")
    got = {r["start_idx"]: r["samples"] for r in gaps.window_slices(w, s, 8, 10).collect()}
    assert got[-1] is None and got[13] is None
    for i in (0, 5, 7, 12):
        assert got[i] == list(x[i : i + 10])
    zeros = {r["start_idx"]: r["samples"] for r in gaps.window_slices(w, s, 8, 10, zero_fill=True).collect()}
    assert zeros[13] == [0.0] * 10


def test_moments(spark, series):
    got = {r["file_id"]: r for r in signal.file_moments(chunks(spark, series)).collect()}
    for f, x in series.items():
        assert got[f]["mean"] == pytest.approx(x.mean()) and got[f]["std"] == pytest.approx(x.std())


def test_best_peaks_equal_the_largest_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, bank = rng.normal(size=(5, 64)), rng.normal(size=(7, 64))
    bank[3] = 0.0
    frame = lambda m, key: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], f"{key} long, wave array<double>")
    windows, templates = frame(x, "window_id"), frame(bank, "template_id")
    pairs = signal.reweighted_snr(windows, templates, 64.0, 2.0, 32, 4, 0.1)
    want = pairs.groupBy("window_id").agg(F.max("new_snr"), F.max("snr"), F.count("*")).orderBy("window_id").collect()
    monkeypatch.setattr("wavequery.operators.templates.BLOCK_BYTES", 8 * 64 * 4)
    got = signal.best_reweighted_snr(windows, templates, 64.0, 2.0, 32, 4, 0.1).orderBy("window_id").collect()
    assert [r["n"] for r in got] == [7] * 5 and np.allclose(np.array(got), np.array(want))


def test_peaks_of_few_outputs_equal_the_whole_transform(monkeypatch):
    rng = np.random.default_rng(7)
    x, bank = rng.normal(size=64), rng.normal(size=(5, 64))
    few = signal.snr_peaks(x, bank, 64.0, 2.0, 32, 4, 0.1)
    # No transform of the length of the window is left; taking one logarithm for 0 turns the short way off.
    monkeypatch.setattr(signal.np, "log2", lambda n: 0.0)
    assert np.allclose(few, signal.snr_peaks(x, bank, 64.0, 2.0, 32, 4, 0.1), rtol=1e-12, atol=0)


def test_best_peaks_of_a_tile_weigh_few_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    waves, bank = rng.normal(size=(12, 64)), rng.normal(size=(900, 64))
    waves[0], waves[1], bank[5] = 0.0, bank[17] * 3.0, 0.0
    bank[400:404] = bank[3]
    args = (64.0, 2.0, 32, 4, 0.1)
    want = np.array([signal.snr_peaks(x, bank, *args).max(axis=1) for x in waves]).T
    rows, real = [], signal._pair_peaks
    monkeypatch.setattr(signal, "_pair_peaks", lambda hf, *rest: rows.append(len(hf)) or real(hf, *rest))
    assert np.allclose(np.array(signal.best_snr_peaks(waves, bank, *args)), want, rtol=1e-12, atol=1e-12)
    assert sum(rows) < len(waves) * len(bank) / 4


def test_best_peaks_when_every_pair_must_be_weighed(monkeypatch):
    rng = np.random.default_rng(9)
    # Alike templates fit the window badly in some band, so the bound helps little.
    waves, bank = rng.normal(size=(3, 64)), rng.normal(size=64) + 1e-6 * rng.normal(size=(60, 64))
    args = (64.0, 2.0, 32, 4, 0.1)
    want = np.array([signal.snr_peaks(x, bank, *args).max(axis=1) for x in waves]).T
    monkeypatch.setattr(signal, "PEAK_PAIRS", 7)
    monkeypatch.setattr(signal, "PEAK_COLUMNS", 11)
    monkeypatch.setattr(signal, "PEAK_WINDOWS", 2)
    assert np.allclose(np.array(signal.best_snr_peaks(waves, bank, *args)), want, rtol=1e-12, atol=1e-12)
