import json

import pytest
from pyspark.sql import functions as F

from wavequery.functions import names, physics
from wavequery.operators import calibration, checks, frames, models, splits, summaries
from wavequery.session import cut_lineage, scratch_path
from wavequery.sources import files, tables


# --- names ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    "name, det, loose, event",
    [
        ("/x/H-H1_SITE_4KHZ_R1-1126257414-4096.hdf5", "H1", "H1", ""),
        ("l-l1_gw150914_4khz.hdf5", "L1", "UNK", "GW150914"),
        ("GW170817_V1.txt", "UNK", "V1", "GW170817"),
        ("plain.hdf5", "UNK", "UNK", ""),
        ("a_GW12345_H1", "UNK", "H1", ""),
    ],
)
def test_names(spark, name, det, loose, event):
    n = F.lit(name)
    row = spark.range(1).select(names.detector(n).alias("d"), names.detector_loose(n).alias("l"), names.event_hint(n).alias("e")).first()
    assert (row["d"], row["l"], row["e"]) == (det, loose, event)


def test_key_and_gps(spark):
    row = spark.range(1).select(
        names.template_key(*[F.lit(v) for v in (3.0, 80.5, 0.0, -0.25)]).alias("k"),
        physics.gps_to_timestamp(F.lit(1_126_259_462_000_000), 17).cast("string").alias("t"),
    ).first()
    assert row["k"] == "3.000-80.500-0.000--0.250" and row["t"] == "2015-09-14 09:50:45"


# --- sources ---------------------------------------------------------------------------


def test_catalog_json(spark, tmp_path):
    page = {"results": [{"name": "gwA-v1", "gps": 1.0}, {"shortName": "gwB", "gps": 2.0}, {"name": "gwC"}, {"name": "gwA-v1", "gps": 9.0}], "next": None}
    (tmp_path / "p1.json").write_text(json.dumps(page, indent=1))
    items = tables.read_catalog_json(spark, str(tmp_path))
    assert {r["name"]: r["gps"] for r in tables.dedupe_catalog(items, ["page", "pos"]).collect()} == {"GWA-V1": 9.0, "GWB": 2.0}
    first = tables.dedupe_catalog(items, ["page", "pos"], keep="first", strip_version=True)
    assert {r["name"]: r["gps"] for r in first.collect()} == {"GWA": 1.0, "GWB": 2.0}


def test_dataset_sink(spark):
    path = scratch_path(spark, "test")
    rows = spark.createDataFrame([("f", None, None, 1, 2.5)], "file_id string, detector string, subset string, label int, snr_rms double")
    tables.write_dataset(rows, path, partition_by="subset")
    back = tables.read_dataset(spark, path)
    row = back.first()
    assert (row["detector"], row["subset"], row["label"]) == ("UNK", "train", 1)
    assert dict(back.dtypes)["snr_rms"] == "float" and dict(back.dtypes)["label"] == "tinyint"


def test_preview_and_checksum(spark, tmp_path):
    path = scratch_path(spark, "preview")
    tables.write_preview(spark.range(50), path, ["id"], 7)
    assert spark.read.option("header", True).csv(path).count() == 7
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.bin").write_bytes(b"abc")
    assert files.file_checksums(spark, str(tmp_path)).first()["checksum"] == "ba7816bf8f01"
    listed = files.list_files(spark, str(tmp_path), "*.bin").first()
    assert (listed["fname"], listed["bytes"]) == ("a.bin", 3)


def test_scores_csv_with_schema(spark):
    path = scratch_path(spark, "scores")
    rows = spark.createDataFrame([("f", 1.5, 1, 0.25)], tables.SCORE_SCHEMA)
    tables.write_csv(rows, path)
    assert tables.read_scores_csv(spark, path, tables.SCORE_SCHEMA).collect() == rows.collect()


def test_unknown_reason():
    with pytest.raises(ValueError):
        checks.reason_of({"nonsense": None})


def test_normalize_flags_and_rate(spark):
    raw = spark.createDataFrame([("a", 1.0, 0.5, False, True)], "fileid string, start double, proba double, is_val boolean, is_test boolean")
    out = tables.normalize_columns(raw)
    assert out.columns == ["file_id", "start_gps", "score", "subset"] and out.first()["subset"] == "test"
    rates = spark.createDataFrame([(0.0, 4096.0, 0.1), (None, None, 1 / 4096), (16384.0, 1.0, None)], "a double, b double, c double")
    got = [r[0] for r in rates.select(tables.sample_rate(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [4096, 4096, 16384]
    with pytest.raises(ValueError):
        tables.require_columns(raw, {"label"})
    assert tables.feature_columns(spark.createDataFrame([(1, 2.0, "x")], "label int, snr double, detector string")) == ["snr"]


def test_report_metric_fallbacks(spark):
    reports = [
        ({"val": {"ap": 0.5}, "test": {"auc": 0.7}}, (0.5, None)),
        ({"val": {}, "test": {"auc": 0.7, "ap": 0.4}}, (0.4, 0.7)),
        ({"eval": {"average_precision": 0.1, "AUC": 0.2}}, (0.1, 0.2)),
        ({"best_val_ap": 0.3}, (0.3, None)),
    ]
    rows = spark.createDataFrame([(json.dumps(r),) for r, _ in reports], "report string")
    assert [(r["ap"], r["auc"]) for r in tables.report_metrics(rows).collect()] == [w for _, w in reports]


def test_download_plan(spark):
    mib = 1024**2
    rows = [(1, 1, "a", 100 * mib), (1, 2, "b", None), (1, 3, "c", 10 * mib), (2, 1, "d", 900 * mib), (2, 2, "e", 50 * mib), (3, 1, "f", 1 * mib)]
    catalog = spark.createDataFrame(rows, "event_no long, file_no long, fname string, bytes long")
    have = spark.createDataFrame([("c",)], "fname string")
    plan = files.download_plan(catalog, have, budget=406 * mib, max_file=500 * mib, per_event=2).orderBy("total").collect()
    assert [(r["fname"], r["total"] // mib) for r in plan] == [("a", 100), ("b", 356), ("e", 406)]
    capped = files.download_plan(catalog, have, budget=10**12, max_file=500 * mib, per_event=1)
    assert {r["fname"] for r in capped.collect()} == {"a", "e", "f"}


def test_latest_run(spark):
    art = spark.createDataFrame([("r1", "s"), ("r1", "t"), ("r2", "s"), ("r3", "t"), ("r3", "x")], "run_id string, kind string")
    assert files.latest_complete_run(art, ["s", "t"]).first()["run_id"] == "r1"
    assert files.latest_complete_run(art, ["q"]).count() == 0


# --- splits ---------------------------------------------------------------------------


def test_group_split_is_group_safe(spark):
    # One group holds a third of all rows.
    rows = spark.range(900).withColumn("g", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 20))
    out = splits.group_split(rows, "g", 0.2, 0.2)
    per_group = out.groupBy("g").agg(F.count_distinct("subset").alias("n")).collect()
    assert all(r["n"] == 1 for r in per_group) and out.count() == 900
    groups = {r["subset"]: r["n"] for r in out.groupBy("subset").agg(F.count_distinct("g").alias("n")).collect()}
    assert groups == {"test": 4, "val": 4, "train": 12}


def test_random_split_counts(spark):
    out = splits.random_split(spark.range(1000), "id", 0.18, 0.18)
    counts = {r["subset"]: r["count"] for r in out.groupBy("subset").count().collect()}
    assert counts == {"test": 180, "val": round(0.18 * 820), "train": 820 - round(0.18 * 820)}


@pytest.mark.parametrize("counts", [{"train": 100}, {"train": 50, "val": 45, "test": 5}, {"val": 3}])
def test_minimums(spark, counts):
    data = [(i, s) for s, n in counts.items() for i in range(n)]
    rows = spark.createDataFrame([(k, s) for k, (_, s) in enumerate(data)], "id long, subset string")
    goal = {"train": 20, "val": 10, "test": 10}
    out = splits.enforce_minimums(rows, "id", goal)
    got = {r["subset"]: r["count"] for r in out.groupBy("subset").count().collect()}
    assert sum(got.values()) == len(data)
    if len(data) >= 40:
        assert all(got.get(s, 0) >= n for s, n in goal.items())


def test_ensure_split(spark):
    rows = spark.range(300).withColumn("g", F.col("id") % 30)
    out = splits.ensure_split(rows.withColumn("subset", F.lit("train")), "g", "id", 0.2, 0.2)
    assert out.groupBy("g").agg(F.count_distinct("subset").alias("n")).where("n > 1").count() == 0
    assert {r[0] for r in out.select("subset").distinct().collect()} == {"train", "val", "test"}
    assert splits.ensure_split(out, "g", "id", 0.5, 0.2).collect() == out.collect()
    one_group = splits.ensure_split(rows.withColumn("g", F.lit(1)), "g", "id", 0.2, 0.25)
    counts = {r["subset"]: r["count"] for r in one_group.groupBy("subset").count().collect()}
    assert counts == {"test": 60, "val": 60, "train": 180}


def test_first_rows_beyond_the_pushed_limit(spark):
    rows = spark.range(5000).withColumn("k", (F.col("id") % 10 < 8).cast("int"))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        many = checks.first_rows(rows, "k", ["id"], 700)
        assert {r["k"]: r["count"] for r in many.groupBy("k").count().collect()} == {0: 700, 1: 700}
        few = checks.first_rows(rows, "k", ["id"], 7)
        assert sorted(r["id"] for r in few.where("k = 0").collect()) == [8, 9, 18, 19, 28, 29, 38]
        # 700 rows with k = 1 are the first 8 of every ten: 87 full tens and 4 more.
        assert many.where("k = 1").agg(F.max("id")).first()[0] == 873
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1000")


def test_samples_without_positives(spark):
    rows = spark.range(50).withColumn("label", F.lit(0))
    assert splits.downsample(rows, "id", max_pos=200, neg_per_pos=50).count() == 50
    assert splits.stratified_sample(rows, "id", neg_per_pos=800, cap=20).count() == 20


def test_stratified_keeps_every_positive(spark):
    rows = spark.range(300).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    out = splits.stratified_sample(rows, "id", neg_per_pos=1, cap=60)
    assert out.where("label = 1").count() == 100 and out.count() == 100


# --- summaries, checks, frames, models --------------------------------------------------


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(float(v),) for v in (0, 0, 5, 10)], "v double")
    got = {r["bin"]: r["n"] for r in summaries.histogram(rows, "v", 10).collect()}
    assert got == {b: {0: 2, 5: 1, 9: 1}.get(b, 0) for b in range(10)}
    flat = summaries.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).collect()
    assert [(r["bin"], r["n"]) for r in flat] == [(0, 2)]


def test_fallback_tiers(spark):
    data = spark.createDataFrame([(1, 0, "val"), (2, 1, "train"), (3, 0, "VAL")], "id long, label int, subset string")
    scored = spark.createDataFrame([(7, 0.3), (8, 0.9)], "id long, score double")
    none = scored.where("false")
    pick = lambda s, d: [r["id"] for r in summaries.fallback_pick(s, d, ["id"], 2).orderBy(F.desc("score"), "id").collect()]
    assert pick(scored, data) == [8, 7]
    assert pick(none, data) == [1, 3]
    assert pick(none, data.withColumn("label", F.lit(1)).where("id <> 1")) == [3]


def test_param_effects_skips_constants(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0)], "p int, q string, m double")
    got = summaries.param_effects(t, ["p", "q"], "m").collect()
    assert [(r["param"], r["mean_abs_delta"]) for r in got] == [("q", 1.0)]


def test_best_row_falls_back(spark):
    t = spark.createDataFrame([(1, None, 0.2), (2, float("nan"), 0.9)], "id int, a double, b double")
    assert summaries.best_row(t, "a", "b", ["id"]).first()["id"] == 2
    assert summaries.best_row(t.select("id", "a", F.lit(None).cast("double").alias("b")), "a", "b", ["id"]).count() == 0


def test_dataset_checks(spark):
    bad = spark.createDataFrame([(None, "train"), (2, "train")], "label int, subset string")
    got = {r["check"]: r["ok"] for r in checks.dataset_checks(bad, {"label", "file_id"}, {"val": 1}).collect()}
    assert got == {"required_columns": 0, "labels_not_null": 0, "labels_binary": 0, "has_val_or_test": 0, "has_train_or_val": 1, "min_rows_val": 0}


def test_frames_need_full_windows(spark):
    points = spark.createDataFrame([("f", t, float(t)) for t in range(0, 11)], "k string, t long, x double")
    extent = frames.series_extent(points, "k", "t")
    got = frames.frame_features(points, extent, "k", "t", "x", 4, 2).orderBy("start_us").collect()
    assert [r["start_us"] for r in got] == [0, 2, 4, 6]
    assert [r["snr_peak"] for r in got] == [3.0, 5.0, 7.0, 9.0]
    with pytest.raises(ValueError):
        frames.frame_features(points, extent, "k", "t", "x", 5, 2)


def test_isotonic_is_monotone_and_clipped(spark):
    rows = spark.createDataFrame([(float(i), int(y)) for i, y in enumerate([0, 0, 1, 0, 1, 1])], "score double, label int")
    probe = spark.createDataFrame([(-5.0,), (2.5,), (99.0,)], "score double")
    got = [r["p"] for r in calibration.isotonic(rows, probe).orderBy("score").collect()]
    assert got == [0.0, 0.5, 1.0]


def test_saved_model_scores_alike(spark):
    rows = spark.createDataFrame([(i, float(i % 7), None if i % 11 == 0 else float(i % 5), int(i % 7 > 3)) for i in range(200)], "id int, a double, b double, label int")
    model = models.fit(models.with_class_weight(rows), models.feature_stages(["a", "b"], log_columns=["a"]), models.balanced_logistic())
    again = models.save_and_load(model, scratch_path(spark, "model"))
    a = [r["score"] for r in models.score(model, rows, ["id"]).orderBy("id").collect()]
    b = [r["score"] for r in models.score(again, rows, ["id"]).orderBy("id").collect()]
    assert a == b and min(a) >= 0 and max(a) <= 1


def test_trees_read_weighted_cells_and_every_row_counts(spark, monkeypatch):
    rows = spark.range(6_000).select(
        "id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 7 > 3).cast("int").alias("label")
    )
    seen, real = [], models.cut_lineage
    monkeypatch.setattr(models, "cut_lineage", lambda df: seen.append(real(df)) or seen[-1])
    model = models.fit_on_cells(rows, models.binned_stages(rows, ["a", "b"]), models.boosted_trees(3, 2))
    cells = seen[0].agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    assert cells["w"] == pytest.approx(6_000) and cells["n"] <= 35 * models.CELL_PARTS
    again = models.save_and_load(model, scratch_path(spark, "model"))
    got = models.score(again, rows, ["label"]).groupBy("label").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    ends = {r["label"]: (r["lo"], r["hi"]) for r in got}
    assert ends[0][1] < 0.5 < ends[1][0]


def test_settings_of_the_user_stay(spark):
    from wavequery.session import prepare

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    own, other = spark.newSession(), spark.newSession()
    own.conf.set(key, "32m")
    assert prepare(own).conf.get(key) == "32m"
    assert prepare(other).conf.get(key) == "2m"
    assert int(other.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 1024


# --- passes of fits over their rows ------------------------------------------------------


@pytest.fixture
def read_rows(spark):
    """Rows of two classes, and a function that tells how often they were read."""
    seen, n = spark.sparkContext.accumulator(0), 400

    def watch(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(n).selectExpr("id AS key", "CAST(id % 4 = 0 AS INT) AS label", "CAST(id % 7 AS DOUBLE) + id % 4 AS a", "CAST(id % 5 AS DOUBLE) AS b")
    return rows.mapInPandas(watch, rows.schema), lambda: seen.value / n


def test_multi_seed_reads_its_rows_for_the_draw_only(spark, read_rows):
    rows, passes = read_rows
    val = cut_lineage(rows)
    before = passes()
    trials = models.multi_seed(rows, val, "key", ["a", "b"], (1, 2), lambda _s: models.balanced_logistic(), max_pos=50, neg_per_pos=2)
    assert [(r["seed"], r["n_train"], r["auc"] > 0.5) for r in trials.orderBy("seed").collect()] == [(1, 150, True), (2, 150, True)]
    assert passes() - before <= 2 * 8


def test_calibration_reads_its_rows_once(spark, read_rows):
    rows, passes = read_rows
    scored = models.sigmoid_calibrated(rows, cut_lineage(rows), "key", ["a", "b"], ["key", "label"])
    assert passes() <= 2 * 2 and scored.count() == 400
    ends = scored.groupBy("label").agg(F.avg("p").alias("p")).collect()
    assert {r["label"]: r["p"] for r in ends}[1] > {r["label"]: r["p"] for r in ends}[0]


def test_cells_keep_the_weights_of_their_rows(spark, monkeypatch):
    rows = spark.range(4_000).selectExpr("CAST(id % 3 AS DOUBLE) AS a", "CAST(id % 4 AS DOUBLE) AS b", "CAST(id % 3 = 0 AND id % 8 < 5 AS INT) AS label")
    weighted = models.with_class_weight(rows)
    seen, real = [], models.cut_lineage
    monkeypatch.setattr(models, "cut_lineage", lambda df: seen.append(real(df)) or seen[-1])
    learner = models.forest(5, 3)
    model = models.fit_on_cells(weighted, models.binned_stages(rows, ["a", "b"]), learner)
    per_class = {r["label"]: r["w"] for r in seen[0].groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert per_class == {0: pytest.approx(2_000), 1: pytest.approx(2_000)}
    assert seen[0].count() <= 24 * models.CELL_PARTS
    plain = models.fit(weighted, models.feature_stages(["a", "b"]), learner)
    scores = [models.score(m, rows.distinct(), ["a", "b", "label"]).orderBy("a", "b", "label").collect() for m in (plain, model)]
    assert all(abs(p["score"] - q["score"]) < 0.1 for p, q in zip(*scores, strict=True))


def test_both_stages_read_cells(spark, read_rows, monkeypatch):
    rows, _ = read_rows
    seen, real = [], models.fit_on_cells
    monkeypatch.setattr(models, "fit_on_cells", lambda *a: seen.append(a) or real(*a))
    out = models.stacked(rows, rows, ["a"], ["a", "b"], ["key", "label"], trees=3, depth=2)
    assert out.columns == ["key", "label", "score1", "score2"] and out.count() == 400 and len(seen) == 1
