import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequery.operators import timejoin as tj


def times(spark, values, name="t_us"):
    return spark.createDataFrame([(int(v), i) for i, v in enumerate(values)], f"{name} long, id long")


def two_pointer(a, b, dt):
    a, b = sorted(a), sorted(b)
    i = j = 0
    pairs = []
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= dt:
            pairs.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif a[i] > b[j]:
            j += 1
        else:
            i += 1
    return sorted(pairs)


def expanded(rows):
    return sorted((r["left_us"], r["right_us"]) for r in rows for _ in range(r["n"]))


# --- interval label ---------------------------------------------------------------


def brute_label(windows, catalog, pre, pos):
    return [int(any(e >= tc - pre and s <= tc + pos for tc in catalog)) for s, e in windows]


def run_label(spark, windows, catalog, pre, pos, length=None):
    w = spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(windows)], "i long, start_us long, end_us long")
    c = spark.createDataFrame([(t,) for t in catalog], "tc_us long")
    out = tj.interval_label(w, c, pre, pos, length)
    return [r["label"] for r in out.orderBy("i").collect()]


def test_interval_edges(spark):
    # Windows of length 20 touch tc - 3 and tc + 7 exactly, and miss them by one.
    windows = [(77, 97), (76, 96), (107, 127), (108, 128), (90, 110), (-40, -20)]
    assert run_label(spark, windows, [100], 3, 7, (20, 20)) == [1, 0, 1, 0, 1, 0]


@pytest.mark.parametrize("lengths", [(20, 20), (5, 90), (1, 900)])
@pytest.mark.parametrize("margins", [(0, 0), (3, 7), (50, 2)])
def test_interval_random(spark, lengths, margins):
    rng = np.random.default_rng(5)
    starts = rng.integers(-300, 3000, 400)
    size = rng.integers(lengths[0], lengths[1] + 1, 400)
    windows = [(int(s), int(s + n)) for s, n in zip(starts, size)]
    catalog = [int(t) for t in rng.integers(-200, 3200, 25)] + [500] * 40
    assert run_label(spark, windows, catalog, *margins) == brute_label(windows, catalog, *margins)


def test_interval_label_keeps_rows_and_empty_catalog(spark):
    assert run_label(spark, [(0, 10), (0, 10)], [5], 0, 0, (10, 10)) == [1, 1]
    w = spark.createDataFrame([(0, 10)], "start_us long, end_us long")
    empty = spark.createDataFrame([], "tc_us long")
    assert tj.interval_label(w, empty, 1, 1).first()["label"] == 0


@pytest.mark.parametrize("length", [(20, 20), (1, 2000)])
def test_interval_label_by_hint(spark, length):
    w = spark.createDataFrame([("a", 0, 20), ("b", 0, 20), ("c", 50, 70)], "h string, start_us long, end_us long")
    c = spark.createDataFrame([("a", 10), ("b", 30), ("a", 60)], "h string, tc_us long")
    out = tj.interval_label(w, c, 5, 5, length, by=["h"])
    assert {r["h"]: r["label"] for r in out.collect()} == {"a": 1, "b": 0, "c": 0}


def test_range_probe_and_summary(spark):
    rng = np.random.default_rng(6)
    ranges = [(i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(0, 900, 40), rng.integers(0, 200, 40)))]
    catalog = [int(t) for t in rng.integers(0, 1000, 60)]
    r = spark.createDataFrame(ranges, "k long, lo long, hi long")
    c = spark.createDataFrame([(t,) for t in catalog], "tc_us long")
    inside = {k: sorted(t for t in catalog if lo <= t <= hi) for k, lo, hi in ranges}
    pairs = tj.range_probe(r, c, 64, "lo", "hi").groupBy("k").agg(F.sort_array(F.collect_list("tc_us")).alias("t"))
    assert {x["k"]: x["t"] for x in pairs.collect()} == {k: v for k, v in inside.items() if v}
    got = {x["k"]: (x["n_tc"], x["first_tc"], x["last_tc"]) for x in tj.range_summary(r, c, "k", "lo", "hi").collect()}
    assert got == {k: (len(v), v[0], v[-1]) for k, v in inside.items() if v}


# --- band, counts, nearest ----------------------------------------------------------


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("dt", [1, 17])
def test_band_join(spark, monkeypatch, dt, hot):
    if hot:
        monkeypatch.setattr(tj, "HOT_MIN_ROWS", 5)
        monkeypatch.setattr(tj, "SALTS", 3)
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.integers(0, 2000, 80), np.full(30, 500)])
    b = np.concatenate([rng.integers(0, 2000, 80), np.full(30, 501)])
    left, right = times(spark, a, "a_us").withColumnRenamed("id", "i"), times(spark, b, "b_us").withColumnRenamed("id", "j")
    got = sorted((r["i"], r["j"]) for r in tj.band_join(left, right, dt, "a_us", "b_us").collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x - y) <= dt)


@pytest.mark.parametrize("chunk", [8, 16_384])
def test_count_pairs_by_slide(spark, monkeypatch, chunk):
    monkeypatch.setattr(tj, "CHUNK_TIMES", chunk)
    rng = np.random.default_rng(8)
    a = np.concatenate([rng.integers(0, 2000, 60), np.full(20, 700)])
    b = np.concatenate([rng.integers(0, 2000, 60), np.full(20, 690)])
    shifts = {1: 0, 2: 33, 3: -250, 4: 99_999}
    slides = spark.createDataFrame(list(shifts.items()), "slide_id long, shift_us long")
    got = {r["slide_id"]: r["pairs"] for r in tj.count_pairs_by_slide(times(spark, a), times(spark, b), 12, slides).collect()}
    want = {k: int(sum(abs(x - (y + s)) <= 12 for x in a for y in b)) for k, s in shifts.items()}
    assert got == want and got[4] == 0
    none = tj.count_pairs_by_slide(times(spark, a).limit(0), times(spark, b), 12, slides)
    assert {r["slide_id"]: r["pairs"] for r in none.collect()} == dict.fromkeys(shifts, 0)


@pytest.mark.parametrize("chunk, at_once, cells", [(8, 5, 3), (8, 1000, 4096), (16_384, 50, 64)])
def test_slide_thresholds_equal_the_sorted_pairs(spark, monkeypatch, chunk, at_once, cells):
    monkeypatch.setattr(tj, "CHUNK_TIMES", chunk)
    monkeypatch.setattr(tj, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(cells)
    # Many rows of one time, ties, negative scores and missing values.
    a = [(int(t), float(v)) for t, v in zip(np.append(rng.integers(0, 900, 60), [400] * 30), rng.integers(-9, 30, 90) / 3)]
    b = [(int(t), float(v)) for t, v in zip(np.append(rng.integers(0, 900, 60), [390] * 30), rng.integers(0, 30, 90) / 7)]
    shifts = {1: 0, 2: 33, 3: -250}
    slides = spark.createDataFrame(list(shifts.items()), "slide_id long, shift_us long")
    left = spark.createDataFrame([*a, (None, 1.0), (400, None)], "t long, score double").repartition(3)
    right = spark.createDataFrame(b, "t long, score double")
    pairs = sorted(round(float(np.hypot(u, v)), 6) for s in shifts.values() for t, u in a for r, v in b if abs(t - r - s) <= 15)
    targets = [1e-4, 0.01, 0.3, 0.9999]
    got = {r["far"]: (r["bg_count"], r["threshold"]) for r in tj.slide_thresholds(left, right, 15, slides, targets, cells).collect()}
    for far in targets:
        index = min(max(int(np.ceil((1 - far) * len(pairs))) - 1, 0), len(pairs) - 1)
        assert got[far] == (len(pairs), pytest.approx(pairs[index], abs=1e-9))
    assert tj.slide_thresholds(left.limit(0), right, 15, slides, targets).count() == 0
    assert tj.slide_thresholds(left, right.withColumn("t", F.col("t") + 10**9), 15, slides, targets).count() == 0


def test_work_on_slides_is_dealt_to_tasks(spark):
    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([(int(t), float(v)) for t, v in zip(rng.integers(0, 90_000, 400), rng.integers(0, 9, 400))], "t long, score double")
    # Equal rows are counted, so copies of the rows are no work of their own.
    copies = rows.unionByName(rows).unionByName(rows)
    slides = spark.createDataFrame([(k, 10 * k) for k in range(1, 201)], "slide_id long, shift_us long")
    counted = copies.groupBy("t", "score").agg(F.count("*").alias("n"))
    jobs = tj._chunk_pairs(counted, counted, 500, slides, ["score", "n"])
    assert jobs.rdd.getNumPartitions() > 1 and all(len(r["slides"]) <= tj.JOB_SLIDES for r in jobs.collect())
    one = {r["s"]: r["n"] for r in tj.background_scores(rows, rows, 500, slides, top=13.0).collect()}
    many = {r["s"]: r["n"] for r in tj.background_scores(copies, copies, 500, slides, top=13.0).collect()}
    assert many == {s: 9 * n for s, n in one.items()}
    near = {r["s"]: r["n"] for r in tj.background_scores(copies, copies, 500, slides, [(5.0, 5.000001), (9.0, 11.0)]).collect()}
    times, scores = (np.array(x) for x in zip(*[(r["t"], r["score"]) for r in rows.collect()]))
    joint = np.round(np.hypot(scores[:, None], scores), 6)
    pairs = sum((np.abs(times[:, None] - times - 10 * k) <= 500).astype(int) for k in range(1, 201))
    kept = (joint == 5.0) | ((joint >= 9.0) & (joint < 11.0))
    values = np.unique(joint[kept & (pairs > 0)])
    assert near == {v: 9 * int(pairs[joint == v].sum()) for v in values.tolist()}


def test_nearest(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 5000, 50), rng.integers(100, 4000, 30)
    got = {r["t_us"]: r["dist_us"] for r in tj.nearest_match(times(spark, a), times(spark, b)).collect()}
    assert got == {int(t): int(np.abs(b - t).min()) for t in a}


# --- one-to-one matching --------------------------------------------------------------


@pytest.mark.parametrize("dt, span, buckets", [(5, 4000, 1), (5, 4000, 60), (60, 900, 9), (300, 500, 2), (300, 500, 5)])
def test_greedy_matches_two_pointer(spark, dt, span, buckets):
    rng = np.random.default_rng(dt + buckets)
    a, b = rng.integers(0, span, 90).tolist(), rng.integers(0, span, 110).tolist()
    got = tj.greedy_matches(times(spark, a), times(spark, b), dt, buckets=buckets).collect()
    assert expanded(got) == two_pointer(a, b, dt)


def test_fifty_dense_ranges_take_no_further_rounds(spark, monkeypatch):
    """No gap is above dt and the state is carried through all ranges; the plan is the same for any number of them."""
    monkeypatch.setattr(tj, "MATCH_ROWS", 7)
    rng = np.random.default_rng(21)
    a, b = rng.integers(0, 3000, 700).tolist(), rng.integers(0, 3000, 500).tolist() + [1500] * 60
    stored = []
    cut = tj.cut_lineage
    monkeypatch.setattr(tj, "cut_lineage", lambda df: stored.append(1) or cut(df))
    for dt in (40, 1000):
        stored.clear()
        got = tj.greedy_matches(times(spark, a), times(spark, b), dt, buckets=50).collect()
        assert expanded(got) == two_pointer(a, b, dt)
        assert len(stored) == 2


def test_greedy_by_null_key(spark):
    rows = [(None, 1), (None, 5), ("k", 1)]
    left = spark.createDataFrame(rows, "k string, t_us long")
    right = spark.createDataFrame([(None, 2), ("k", 30)], "k string, t_us long")
    assert [tuple(r) for r in tj.greedy_matches(left, right, 3, by=["k"], buckets=2).collect()] == [(None, 1, 2, 1)]
    assert tj.greedy_matches(left.limit(0), right, 3, by=["k"]).count() == 0


def test_greedy_ties_and_hot_time(spark):
    a, b = [10] * 40 + [20, 30], [10] * 25 + [22, 41]
    got = tj.greedy_matches(times(spark, a), times(spark, b), 2, buckets=4).collect()
    assert expanded(got) == two_pointer(a, b, 2)


def test_greedy_gap_equal_to_dt(spark):
    assert expanded(tj.greedy_matches(times(spark, [0, 21]), times(spark, [10, 32]), 10).collect()) == [(0, 10)]
    assert tj.greedy_matches(times(spark, [0]), times(spark, [11]), 10).count() == 0


def test_greedy_by_key(spark):
    rng = np.random.default_rng(11)
    sides = {k: (rng.integers(0, 600, 40).tolist(), rng.integers(0, 600, 40).tolist()) for k in (1, 2, 3)}

    def rows(side):
        data = [(k, int(t)) for k, pair in sides.items() for t in pair[side]]
        return spark.createDataFrame(data, "slide_id long, t_us long")

    got = tj.greedy_matches(rows(0), rows(1), 25, by=["slide_id"], buckets=5).collect()
    for k, (a, b) in sides.items():
        assert expanded([r for r in got if r["slide_id"] == k]) == two_pointer(a, b, 25)


def test_random_order_scan_equals_two_pointer():
    rng = np.random.default_rng(12)
    for _ in range(300):
        a, b = rng.integers(0, 80, rng.integers(0, 25)).tolist(), rng.integers(0, 80, rng.integers(0, 25)).tolist()
        line = sorted(set(a) | set(b))
        pairs, _, _ = tj.match_in_order(line, [a.count(t) for t in line], [b.count(t) for t in line], 6)
        assert sorted((x, y) for x, y, n in pairs for _ in range(n)) == two_pointer(a, b, 6)


def test_false_alarm_rate(spark):
    bg = spark.createDataFrame([(1,), (3,), (5,)], "pairs long")
    span = tj.observation_span(times(spark, [0, 10_000_000]), times(spark, [5_000_000, 20_000_000]))
    row = tj.false_alarm_rate(bg, span).first()
    assert (row["bg_mean"], row["bg_std"], row["tobs_s"], row["far_per_sec"]) == (3.0, 2.0, 5.0, 0.6)


def test_background_thresholds(spark):
    values = np.arange(1, 1001) / 10
    scores = spark.createDataFrame([(float(v),) for v in values], "score double")
    got = {r["far"]: r["threshold"] for r in tj.background_thresholds(scores, [0.01, 0.5, 0.9999]).collect()}
    for far, threshold in got.items():
        index = min(max(int(np.ceil((1 - far) * 1000)) - 1, 0), 999)
        assert threshold == values[index]


@pytest.mark.parametrize("rows_per_range", [5, 40, 10**6])
def test_match_counts_by_slide_equal_matching_of_slid_copies(spark, rows_per_range):
    rng = np.random.default_rng(rows_per_range)
    a, b = rng.integers(0, 2_000, 150), rng.integers(-300, 1_500, 130)
    shifts = [0, 7, 40, 333, 1_900, 10_000, *range(50, 1_500, 47)]
    one = lambda m: spark.createDataFrame([(int(v),) for v in m] + [(None,)], "t_us long")
    slides = spark.createDataFrame(list(enumerate(shifts)), "slide_id long, shift_us long")
    got = {r.slide_id: r.pairs for r in tj.count_matches_by_slide(one(a), one(b), 12, slides, rows_per_range=rows_per_range).collect()}
    assert len(got) == len(shifts)
    for i, shift in enumerate(shifts):
        h, l, i_h, i_l, n = np.sort(a), np.sort(b) + shift, 0, 0, 0
        while i_h < len(h) and i_l < len(l):
            gap = h[i_h] - l[i_l]
            n += abs(gap) <= 12
            i_h, i_l = i_h + (gap <= 12), i_l + (gap >= -12)
        assert got[i] == n
    assert {r.pairs for r in tj.count_matches_by_slide(one([]), one(b), 12, slides).collect()} == {0}
    assert {r.pairs for r in tj.count_matches_by_slide(one(a), one([]), 12, slides).collect()} == {0}


def test_slide_thresholds_list_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(12)
    a, b = (list(zip(rng.integers(0, 4000, 2000).tolist(), rng.exponential(50.0, 2000).tolist(), strict=True)) for _ in range(2))
    left, right = (spark.createDataFrame(x, "t long, score double") for x in (a, b))
    slides = spark.createDataFrame([(1, 0), (2, 700), (3, 1900)], "slide_id long, shift_us long")
    listed, real = [], tj._open_counts
    def counted(met, dt, l_edges, r_edges, brackets, *rest):  # noqa: E306
        bins = [np.searchsorted(e, [v for _, v in x], "right") for e, x in ((l_edges, a), (r_edges, b))]
        listed.append(sum(float(mask[bins[0]][:, bins[1]].mean()) for mask, _, _ in brackets))
        return real(met, dt, l_edges, r_edges, brackets, *rest)
    monkeypatch.setattr(tj, "_open_counts", counted)  # noqa: E305
    got = {r["far"]: (r["bg_count"], r["threshold"]) for r in tj.slide_thresholds(left, right, 300, slides, [1e-3, 0.1]).collect()}
    (t, u), (r, v) = (np.array(x).T for x in (a, b))
    met = sum((np.abs(t[:, None] - r - s) <= 300).astype(int) for s in (0, 700, 1900))
    pairs = np.sort(np.repeat(np.round(np.hypot(u[:, None], v), 6).ravel(), met.ravel()))
    for far in (1e-3, 0.1):
        assert got[far] == (len(pairs), pytest.approx(pairs[int(np.ceil((1 - far) * len(pairs))) - 1], abs=1e-9))
    # The share of the pairs that the two passes list, for both targets.
    assert len(listed) == 2 and listed[1] <= listed[0] < 0.15


def test_an_infinite_score_is_an_error(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, float("inf"))], "t long, score double")
    slides = spark.createDataFrame([(1, 0)], "slide_id long, shift_us long")
    with pytest.raises(ValueError, match="infinite"):
        tj.slide_thresholds(rows, rows, 5, slides, [0.1])
