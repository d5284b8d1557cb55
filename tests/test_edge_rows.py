"""Null keys, null and NaN values, empty bins and wrong statements about the input."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wavequery.functions import physics
from wavequery.operators import frames, models, ranking, running, signal, splits, summaries, timejoin
from wavequery.operators import templates as tp


@pytest.mark.parametrize("fanout", [None, 2])
def test_running_sums_of_a_null_key(spark, fanout):
    df = spark.range(12).select("id", F.when(F.col("id") % 2 == 0, "a").alias("k"), (F.col("id") / 2).cast("int").alias("c"))
    got = running.running(df, "id", {"s": ("sum", F.lit(1))}, by=["k"], bucket="c", totals=True, fanout=fanout)
    assert [(r["k"], r["s"], r["s_total"]) for r in got.orderBy("k", "id").collect()] == [
        (k, i, 6) for k in (None, "a") for i in range(1, 7)
    ]


def test_missing_short_and_nan_windows(spark):
    windows = spark.createDataFrame(
        [(1, [1.0, 2.0, 3.0]), (2, None), (3, [1.0, 2.0]), (4, [1.0, math.nan, 3.0]), (5, [1.0, 2.0, 3.0, 9.0]), (6, [1.0, None, 3.0])],
        "window_id long, wave array<double>",
    )
    bank = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "template_id long, wave array<double>")
    got = {r["window_id"]: r["score"] for r in tp.cosine_scores(windows, bank).collect()}
    # The end of a longer window is kept, a shorter one gets zeros in front.
    assert got[1] == pytest.approx(1) and got[5] == pytest.approx(35 / math.sqrt(94 * 14)) and got[2] == 0
    assert got[3] == pytest.approx(8 / math.sqrt(5 * 14)) and got[4] == got[6] == pytest.approx(10 / math.sqrt(140))
    lagged = {r["window_id"]: r["score"] for r in tp.ncc_scores(windows, bank, 1, 1).collect()}
    assert lagged[1] == pytest.approx(1) and lagged[2] == 0


def test_rows_without_a_group_stay(spark):
    rows = spark.createDataFrame([(1, "a", "f"), (2, None, "f"), (3, None, None), (4, "b", "g")], "id long, hint string, file string")
    assert splits.group_split(rows, "hint", 0.3, 0.3).count() == 4
    out = splits.group_split(rows, ["hint", "file", "id"], 0.3, 0.3)
    assert out.count() == 4 and out.columns == [*rows.columns, "subset"]


def test_downsample_leaves_null_labels_out(spark):
    rows = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 0)], "id long, label int")
    assert {r["id"] for r in splits.downsample(rows, "id", max_pos=None, neg_per_pos=None).collect()} == {1, 2, 4}


@pytest.mark.parametrize(
    ("counts", "minimum", "wanted"),
    [
        ({"train": 90, "val": 5, "test": 5}, {"train": 10, "val": 10, "test": 20}, [("train", "test", 15), ("train", "val", 5)]),
        ({"train": 12, "val": 18}, {"train": 10, "val": 10, "test": 10}, [("val", "test", 8), ("train", "test", 2)]),
        ({"train": 10, "val": 10, "test": 10}, {"train": 10, "val": 10, "test": 10}, []),
        ({"val": 3}, {"train": 5, "val": 5, "test": 5}, [("val", "train", 1), ("val", "test", 1)]),
        ({}, {"train": 1, "val": 1, "test": 1}, []),
    ],
)
def test_minimum_moves(counts, minimum, wanted):
    assert sorted(splits.minimum_moves(counts, minimum)) == sorted(wanted)


def test_nan_metric_leaves_the_other_trials(spark):
    trials = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 6.0), ("b", math.nan), ("b", None)], "p string, m double")
    row = summaries.param_effects(trials, ["p"], "m").first()
    assert row["global_mean"] == pytest.approx(10 / 3) and row["mean_abs_delta"] == pytest.approx(2)


def test_histogram_has_every_bin(spark):
    rows = spark.createDataFrame([(0, 0.0), (0, 1.0), (0, math.nan), (0, None), (None, 2.0), (None, 4.0)], "k int, v double")
    got = summaries.histogram(rows, "v", 4, ["k"]).orderBy("k", "bin").collect()
    assert [(r["k"], r["bin"], r["n"]) for r in got] == [(k, b, n) for k in (None, 0) for b, n in enumerate((1, 0, 0, 1))]
    assert [r["bin_lo"] for r in got][:4] == [2.0, 2.5, 3.0, 3.5]
    assert summaries.histogram(rows, "v", 4).agg(F.sum("n")).first()[0] == 4


def test_heat_map_has_every_bin(spark):
    rows = spark.createDataFrame([(0.0, 0.5, "H1"), (9.0, 0.7, "L1")], "t double, score double, det string")
    got = summaries.time_heatmap(rows, "t", "score", "det", ["H1", "L1"], bins=5).orderBy("bin").collect()
    assert [tuple(r) for r in got] == [(0, 0.5, 0.0), (1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 0.0, 0.7)]


def test_features_of_tiny_values_are_not_rounded(spark):
    points = spark.createDataFrame([("f", t, 1e-9 * t) for t in range(11)], "k string, t long, x double")
    got = frames.frame_features(points, frames.series_extent(points, "k", "t"), "k", "t", "x", 4, 2).orderBy("start_us").first()
    assert got["snr_peak"] == pytest.approx(3e-9)


def test_rank_of_a_null_is_null(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "id long, v double")
    got = {r["id"]: r["rank_norm"] for r in ranking.rank_normalized(rows, "v").collect()}
    assert got == {1: 0.0, 2: None, 3: 1.0}


def test_inner_chunks_shorter_than_the_halo_raise(spark):
    rows = [("f", c, 4 * c, [float(4 * c + i) for i in range(4)]) for c in range(3)]
    chunks = spark.createDataFrame(rows, "file_id string, chunk_id int, first_idx int, samples array<double>")
    with pytest.raises(PySparkException, match="shorter than the halo"):
        signal.with_halo(chunks, 6).collect()
    ends = signal.with_halo(chunks.where("chunk_id < 2"), 6).orderBy("chunk_id").collect()
    assert [r["samples"] for r in ends] == [[float(i) for i in range(8)]] * 2


def test_wrong_length_range_raises(spark):
    windows = spark.createDataFrame([(1000, 1010)], "start_us long, end_us long")
    catalog = spark.createDataFrame([(1500,)], "tc_us long")
    assert timejoin.interval_label(windows, catalog, 0, 0).first()["label"] == 0
    with pytest.raises(PySparkException, match="length_range_us"):
        timejoin.interval_label(windows, catalog, 0, 0, length_range_us=(1000, 1000)).collect()


@pytest.mark.parametrize(
    ("gps", "utc"),
    [
        (0, "1980-01-06 00:00:00"),
        (1_126_259_462, "2015-09-14 09:50:45"),
        (1_167_264_018, "2017-01-01 00:00:00"),
        (1_187_008_882, "2017-08-17 12:41:04"),
        (900_000_000, "2008-07-13 15:59:46"),
    ],
)
def test_leap_seconds_by_date(spark, gps, utc):
    at = physics.gps_to_timestamp(F.lit(gps * 1_000_000).cast("long")).cast("string")
    assert spark.range(1).select(at).first()[0] == utc


def test_restored_split_of_a_key_that_was_saved_twice(spark):
    base = spark.createDataFrame([(i,) for i in range(5)], "id long")
    saved = [(0, "train"), (0, "test"), (1, "val"), (1, "train"), (2, "other"), (2, "train"), (3, None)]
    sidecar = spark.createDataFrame(saved, "id long, split string")
    got = {r.id: r.split for r in splits.split_restore(base, sidecar, ["id"]).collect()}
    assert got == {0: "test", 1: "val", 2: "train", 3: "train", 4: "train"}
    got = {r.id: r.split for r in splits.split_restore(base, sidecar, ["id"], order=["train", "val"]).collect()}
    assert got == {0: "train", 1: "train", 2: "train", 3: "train", 4: "train"}


def test_calibration_per_fold(spark):
    rows = [(i, (i * 37 % 101) / 10, int((i * 37 % 101) + (i * 13 % 40) > 70)) for i in range(400)]
    data = spark.createDataFrame(rows, "id long, a double, label int")
    got = models.sigmoid_calibrated(data, data, "id", ["a"], ["id", "label"]).collect()
    assert len(got) == 400 and all(0 <= r.p <= 1 and 0 <= r.score <= 1 for r in got)
    order = [r.p for r in sorted(got, key=lambda r: r.score)]
    assert order == sorted(order)
    # Calibrated on rows that the model has not seen, the mean is close to the share of positives.
    assert abs(sum(r.p for r in got) - sum(r.label for r in got)) < 20
