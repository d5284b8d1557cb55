import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequery.functions import arrays as ar
from wavequery.operators import templates as tp


def waves(spark, m, key):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], f"{key} long, wave array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    return rng.normal(size=(40, 48)), rng.normal(size=(9, 48))


def long_matrix(rows, shape, column="score"):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r["window_id"], r["template_id"]] = r[column]
    return out


@pytest.mark.parametrize("block_bytes", [10**8, 8 * 48 * 2, 1])
def test_cosine_blocks(spark, data, block_bytes):
    x, h = data
    got = tp.cosine_scores(waves(spark, x, "window_id"), waves(spark, h, "template_id"), block_bytes).collect()
    want = x @ h.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(h, axis=1) + 1e-8)
    assert np.allclose(long_matrix(got, want.shape), want)


def brute_ncc(x, h, max_shift, step):
    full = np.convolve(x, h[::-1]) / (np.linalg.norm(x) * np.linalg.norm(h) + 1e-12)
    centre = len(full) // 2
    return full[max(0, centre - max_shift) : min(len(full), centre + max_shift + 1) : step]


@pytest.mark.parametrize("max_shift, step", [(13, 4), (5, 1), (0, 1)])
def test_ncc(spark, data, max_shift, step):
    x, h = data
    got = tp.ncc_scores(waves(spark, x, "window_id"), waves(spark, h, "template_id"), max_shift, step).collect()
    want = np.array([[brute_ncc(a, b, max_shift, step).max() for b in h] for a in x])
    lags = np.array([[brute_ncc(a, b, max_shift, step).argmax() * step - max_shift for b in h] for a in x])
    assert np.allclose(long_matrix(got, want.shape), want)
    assert np.array_equal(long_matrix(got, want.shape, "lag"), lags)


def test_lag_recovery():
    rng = np.random.default_rng(3)
    a = rng.normal(size=8192)
    b = np.roll(a, 13) + 0.1 * rng.normal(size=8192)
    c = tp.overlap_correlations(a[None], b[None], 64)[0, 0]
    assert c.argmax() - 64 == 13


def test_overlap_definition(data):
    x, h = data
    a, b = x[0], h[0]
    za, zb = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
    want = [
        (za[: 48 - k] @ zb[k:] if k >= 0 else za[-k:] @ zb[: 48 + k]) / (48 - abs(k)) for k in range(-6, 7)
    ]
    assert np.allclose(tp.overlap_correlations(a[None], b[None], 6)[0, 0], want)


def test_zero_lag_option():
    assert 0 not in tp.lag_grid(8192, 61, 4)
    assert 0 in tp.lag_grid(8192, 61, 4, include_zero=True)


@pytest.mark.parametrize("block_bytes", [10**8, 1])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_pooling(spark, data, k, block_bytes):
    x, h = data
    got = {r["window_id"]: r["score"] for r in tp.pooled_scores(waves(spark, x, "window_id"), waves(spark, h, "template_id"), k, 5, 1, block_bytes).collect()}
    scores = np.array([[brute_ncc(a, b, 5, 1).max() for b in h] for a in x])
    top = np.sort(scores, axis=1)[:, ::-1][:, :k].mean(axis=1)
    assert np.allclose([got[i] for i in range(len(x))], top)


@pytest.mark.parametrize("block_bytes", [10**8, 8 * 48 * 4])
def test_preselect(spark, data, block_bytes):
    x, h = data
    got = [r["template_id"] for r in tp.preselect(waves(spark, x, "window_id"), waves(spark, h, "template_id"), 4, block_bytes=block_bytes).collect()]
    score = np.abs(x @ h.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(h, axis=1))).mean(axis=0)
    assert got == list(np.argsort(-score)[:4])
    few = tp.preselect(waves(spark, x[:7], "window_id"), waves(spark, h, "template_id"), 4)
    assert few.count() == len(h)


def test_best_match_recovers_lag_and_scale(spark, data):
    _, h = data
    x = np.zeros((2, 48))
    x[0, 8:] = 2.0 * h[5][:40]
    x[1, :41] = 3.0 * h[2][7:]
    got = {r["window_id"]: r for r in tp.best_match(waves(spark, x, "window_id"), waves(spark, h, "template_id"), 12, 1, block_bytes=1).collect()}
    assert (got[0]["template_id"], got[0]["lag"]) == (5, 8)
    assert (got[1]["template_id"], got[1]["lag"]) == (2, -7)
    assert got[0]["scale"] > 0


def test_sweep_blocks_agree(spark, data):
    x, h = data
    configs = [{"config_id": i, "templates_n": n, "subsample": s, "topk": k} for i, (n, s, k) in enumerate([(9, 1, 1), (5, 2, 2), (9, 4, 3)])]
    w, t = waves(spark, x, "window_id"), waves(spark, h, "template_id")
    one = {(r["config_id"], r["window_id"]): r["score"] for r in tp.sweep_scores(w, t, configs).collect()}
    many = {(r["config_id"], r["window_id"]): r["score"] for r in tp.sweep_scores(w, t, configs, 8 * 48 * 2).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k]) for k in one)


def test_sweep_over_mass_ranges_equals_plain_pooling(spark, data):
    x, h = data
    masses = [(5.0 + 9 * i % 40, 5.0 + 17 * i % 60) for i in range(len(h))]
    bank = spark.createDataFrame(
        [(i, *m, [float(v) for v in row]) for i, (m, row) in enumerate(zip(masses, h))], "template_id long, m1 double, m2 double, wave array<double>"
    )
    ranges = ((5.0, 30.0), (20.0, 80.0))
    configs = tp.sweep_grid(ranges, ranges, (2, 5, 100), (1, 2), (1, 3))
    assert len(configs) == 48 and [c["config_id"] for c in configs] == list(range(48))
    logged = spark.createDataFrame([(0,), (7,), (7,)], "config_id long")
    left = tp.pending_configs(configs, logged)
    assert {c["config_id"] for c in left} == set(range(48)) - {0, 7}
    cos = tp.cosine_matrix(x, h)
    want = {}
    for c in left:
        held = [i for i, m in enumerate(masses) if all(lo <= v <= hi for v, (lo, hi) in zip(m, (c["m1"], c["m2"])))]
        held = held[: c["templates_n"]][:: c["subsample"]]
        if held:
            want |= {(c["config_id"], w): np.sort(cos[w, held])[::-1][: c["topk"]].mean() for w in range(len(x))}
    for size in (tp.BLOCK_BYTES, 8 * 48 * 2):
        got = {(r.config_id, r.window_id): r.score for r in tp.sweep_scores(waves(spark, x, "window_id"), bank, left, size).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert tp.sweep_scores(waves(spark, x, "window_id"), bank, []).count() == 0


def test_injection_raises_the_score(spark, data):
    x, h = data
    pairs = spark.createDataFrame([([float(v) for v in a], [float(v) for v in h[i % 9]]) for i, a in enumerate(x)], "x array<double>, h array<double>")
    weak = pairs.select(F.avg(tp.injected_score(0.0, 0, 1)("x", "h"))).first()[0]
    strong = pairs.select(F.avg(tp.injected_score(5.0, 0, 1)("x", "h"))).first()[0]
    assert strong > 0.9 > weak


def test_augment_is_reproducible(spark, data):
    x, _ = data
    fn = tp.augmented(max_shift=4, noise=0.1, dropout=0.1, snr=5.0)
    rows = waves(spark, x, "window_id")
    a = {r["window_id"]: r["z"] for r in rows.repartition(1).select("window_id", fn("window_id", "wave").alias("z")).collect()}
    b = {r["window_id"]: r["z"] for r in rows.repartition(7).select("window_id", fn("window_id", "wave").alias("z")).collect()}
    assert a == b
    assert np.mean(a[0]) == pytest.approx(0, abs=1e-9) and np.std(a[0]) == pytest.approx(1)


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, -4.0, 2.0],)], "w array<double>")
    w = F.col("w")
    row = df.select(
        ar.shifted(w, F.lit(1)).alias("right"), ar.shifted(w, F.lit(-2)).alias("left"), ar.shifted(w, F.lit(9)).alias("out"),
        ar.rolled(w, F.lit(-1)).alias("roll"), ar.fit_length(w, 5).alias("pad"), ar.fit_length(w, 2).alias("crop"),
        ar.fit_length(w, 5, "left").alias("pad_left"), ar.fit_length(w, 2, "left").alias("crop_left"), ar.zscore(w).alias("z"),
    ).first()
    assert row["right"] == [0.0, 1.0, -4.0] and row["left"] == [2.0, 0.0, 0.0] and row["out"] == [0.0] * 3
    assert row["roll"] == [-4.0, 2.0, 1.0]
    assert row["pad"] == [0.0, 0.0, 1.0, -4.0, 2.0] and row["crop"] == [-4.0, 2.0]
    assert row["pad_left"] == [1.0, -4.0, 2.0, 0.0, 0.0] and row["crop_left"] == [1.0, -4.0]
    assert np.allclose(row["z"], (np.array([1, -4, 2]) + 1 / 3) / np.std([1, -4, 2]))


def test_tukey_shape():
    w = np.array(ar.tukey(101, 0.2))
    assert w[0] == 0 and w[50] == 1 and np.allclose(w, w[::-1]) and (w[12:89] == 1).all()
    assert ar.tukey(5, 0.0) == [1.0] * 5


def test_bank_is_row_major_and_exact(spark):
    bank = tp.template_bank(spark, 5, (3.0, 5.0), (10.0, 20.0)).orderBy("pos").collect()
    # The first five of three by three cells.
    assert [(r["m1"], r["m2"]) for r in bank] == [(3.0, 10.0), (3.0, 15.0), (3.0, 20.0), (4.0, 10.0), (4.0, 15.0)]


def test_a_tile_bounds_the_memory_of_a_window_batch():
    import tracemalloc

    rng = np.random.default_rng(5)
    batch, bank = rng.normal(size=(1000, 16)), rng.normal(size=(1500, 16))
    lags = tp.lag_grid(16, 6, 1)
    tracemalloc.start()
    for tile in tp._tiles(len(batch), len(bank)):
        x = batch[tile]
        top, at = tp.best_lags(lambda part: tp.correlations(x, part, lags), bank, len(x), len(lags))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All windows, templates and lags at once are 156 MB.
    assert peak < 60e6
    whole = tp.correlations(x, bank[-20:], lags)
    assert np.array_equal(at[:, -20:], whole.argmax(axis=2)) and np.array_equal(top[:, -20:], whole.max(axis=2))


def test_summaries_of_cosines_over_several_blocks(spark, data):
    x, h = data
    want = tp.cosine_matrix(x, h)
    for size in (tp.BLOCK_BYTES, 8 * 48 * 4):
        rows = tp.cosine_summaries(waves(spark, x, "window_id"), waves(spark, h, "template_id"), 0.1, size).collect()
        got = {r.window_id: r for r in rows}
        assert len(rows) == len(x) and all(got[i].n == 9 and got[i].above == (want[i] > 0.1).sum() for i in range(len(x)))
        assert np.allclose([got[i].best for i in range(len(x))], want.max(axis=1))
        assert np.allclose([got[i].mean_abs for i in range(len(x))], np.abs(want).mean(axis=1))


def test_preselection_sends_one_partial_sum_per_task(spark, data):
    x, h = data
    windows = waves(spark, x, "window_id").repartition(2)
    seen = []
    real = tp._over_blocks
    try:
        tp._over_blocks = lambda *args: seen.append(real(*args)) or seen[-1]
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = [r["template_id"] for r in tp.preselect(windows, waves(spark, h, "template_id"), 4).collect()]
        rows = seen[0][0].count()
    finally:
        tp._over_blocks = real
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    score = np.abs(x @ h.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(h, axis=1))).mean(axis=0)
    assert got == list(np.argsort(-score)[:4]) and rows == 2 * len(h)


def test_sweep_sends_only_templates_of_some_bank(spark, data):
    x, h = data
    rows = [(i, 5.0 + i % 7, 5.0 + i % 11, [float(v) for v in h[i % 9]]) for i in range(400)]
    bank = spark.createDataFrame(rows, "template_id long, m1 double, m2 double, wave array<double>")
    ranges = ((5.0, 8.0), (9.0, 11.0))
    configs = tp.sweep_grid(ranges, ranges, (2, 5), (1, 2), (1, 3))
    sent, real = [], tp.bank_blocks
    try:
        tp.bank_blocks = lambda bank, *args: sent.append(bank.count()) or real(bank, *args)
        got = {(r.config_id, r.window_id): r.score for r in tp.sweep_scores(waves(spark, x, "window_id"), bank, configs).collect()}
    finally:
        tp.bank_blocks = real
    assert sent[0] <= 4 * 5
    cos = tp.cosine_matrix(x, np.array([r[3] for r in rows]))
    for c in configs:
        held = [r[0] for r in rows if c["m1"][0] <= r[1] <= c["m1"][1] and c["m2"][0] <= r[2] <= c["m2"][1]][: c["templates_n"]][:: c["subsample"]]
        assert all(got[c["config_id"], w] == pytest.approx(np.sort(cos[w, held])[::-1][: c["topk"]].mean()) for w in range(len(x)))


def test_pairs_leave_a_task_in_bounded_frames(data):
    import pandas as pd

    ids, batch = np.arange(1000), pd.DataFrame({"window_id": np.arange(300)})
    scores = np.arange(300_000.0).reshape(300, 1000)
    frames = list(tp._long(ids, batch, (scores, scores.astype(int)), ("score", "lag")))
    assert max(len(f) for f in frames) <= tp.PAIR_ROWS
    whole = pd.concat(frames)
    assert np.array_equal(whole["score"], np.arange(300_000)) and np.array_equal(whole["lag"], np.arange(300_000))
    assert np.array_equal(whole["window_id"] * 1000 + whole["template_id"], np.arange(300_000))


@pytest.mark.parametrize("max_shift, step", [(13, 4), (5, 1), (0, 1), (47, 1)])
def test_products_at_few_lags_equal_the_transforms(data, monkeypatch, max_shift, step):
    x, h = data
    lags = tp.lag_grid(48, max_shift, step)
    whole, overlap = tp.correlations(x, h, lags), tp.overlap_correlations(x, h, max_shift)
    monkeypatch.setattr(tp, "PRODUCT_SHAPE", (7, 4))
    monkeypatch.setattr(tp.np.fft, "irfft", None)
    top, at = tp.best_correlations(x, h, lags)
    assert np.allclose(top, whole.max(axis=2), rtol=0, atol=1e-12) and np.array_equal(at, whole.argmax(axis=2))
    assert np.array_equal(top, tp.best_correlations(x, h, lags, places=False)[0])
    top, at = tp.best_overlap_correlations(x, h, max_shift)
    assert np.allclose(top, overlap.max(axis=2), rtol=0, atol=1e-12) and np.array_equal(at, overlap.argmax(axis=2))


def test_the_first_lag_wins_an_exact_tie(spark):
    x = np.zeros((2, 48))
    x[0, [7, 19, 31]] = 3.0
    h = np.zeros((1, 48))
    h[0, 20] = 1.0
    got = tp.ncc_scores(waves(spark, x, "window_id"), waves(spark, h, "template_id"), 13, 4).orderBy("window_id").collect()
    assert [(r["lag"], round(r["score"], 6)) for r in got] == [(-13, 0.57735), (-13, 0.0)]


def test_many_lags_go_by_transforms(data, monkeypatch):
    x, h = data
    lags = tp.lag_grid(48, 13, 4)
    want = tp.best_correlations(x, h, lags)
    monkeypatch.setattr(tp, "DIRECT_LAGS", 0)
    monkeypatch.setattr(tp, "_best_products", None)
    got = tp.best_correlations(x, h, lags)
    assert np.allclose(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert tp.best_overlap_correlations(x, h, 5)[0].shape == (40, 9)
