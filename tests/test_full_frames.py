"""Full frames on a stream against the batch operator."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wavequery.operators import frames
from wavequery.streaming import full_frames, jobs

FRAME, STRIDE = 4_000_000, 1_000_000
SCHEMA = "k string, ts timestamp, v double"
ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def made():
    """Series with gaps, one that begins out of order, one shorter than a frame; the clock runs on to close all frames."""
    rng = np.random.default_rng(5)
    rows = []
    for k, first in (("a", 10.3), ("b", 17.0), ("c", 33.777), ("gap", 12.0)):
        times = first + np.cumsum(rng.exponential(0.7, 90))
        if k == "gap":
            times[40:] += 500
        rows += [(k, float(t), float(v)) for t, v in zip(times, rng.normal(size=90), strict=True)]
    rows += [("short", 20.0, 1.0), ("short", 22.0, 2.0), (None, 21.0, 1.0), ("a", 30.0, None)]
    return rows


def write(spark, rows, folder, number):
    at = [ZERO + dt.timedelta(microseconds=round(t * 1e6)) for _, t, _ in rows]
    path = f"{folder}/part-{number}.parquet"
    names, values = [r[0] for r in rows], [r[2] for r in rows]
    columns = {"k": pa.array(names, pa.string()), "ts": pa.array(at, pa.timestamp("us", "UTC")), "v": pa.array(values, pa.float64())}
    pq.write_table(pa.table(columns), path)
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def batch(spark, rows):
    data = [(k, ZERO + dt.timedelta(microseconds=round(t * 1e6)), v) for k, t, v in rows]
    points = spark.createDataFrame(data, SCHEMA).dropna().select("k", F.unix_micros("ts").alias("t"), "v")
    out = frames.frame_features(points, frames.series_extent(points, "k", "t"), "k", "t", "v", FRAME, STRIDE)
    return rounded(out)


def rounded(df):
    return sorted((r.k, r.start_us, r.end_us, r.n, round(r.snr_rms, 9), round(r.snr_peak, 9), round(r.crest_factor, 9)) for r in df.collect())


@pytest.fixture
def stream(spark, tmp_path):
    def run(name="run", files=1):
        source = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", SCHEMA, files)
        framed = full_frames.full_frames(source, "k", "ts", "v", FRAME, STRIDE, "5 seconds")
        return jobs.run_available(framed, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-checkpoint"), full_frames.ROCKS_DB)

    (tmp_path / "in").mkdir()
    return tmp_path, run


def test_files_late_rows_and_restart_equal_batch(spark, stream):
    folder, run = stream
    rng = np.random.default_rng(1)
    rows = made()
    # Rows come up to 4 s out of order, within the delay of 5 s.
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 4))
    clock = [("clock", 2000.0, 0.0), ("clock", 2001.0, 0.0)]
    parts = np.array_split(np.arange(len(order)), 6)
    for i, part in enumerate(parts[:3]):
        write(spark, [order[j] for j in part], folder / "in", i)
    first = rounded(run())
    for i, part in enumerate(parts[3:], 3):
        write(spark, [order[j] for j in part], folder / "in", i)
    write(spark, clock, folder / "in", 9)
    got = rounded(run())
    want = batch(spark, rows)
    assert 0 < len(first) < len(want) and set(first) <= set(want)
    assert got == want
    assert rounded(run()) == want  # nothing is sent twice


def test_rows_beyond_the_delay_are_dropped(spark, stream):
    folder, run = stream
    rows = [("a", 10 + 0.5 * i, 1.0) for i in range(40)]
    write(spark, rows, folder / "in", 0)
    write(spark, [("a", 100.0, 1.0)], folder / "in", 1)
    write(spark, [("a", 11.2, 50.0), ("late", 12.0, 9.0), ("clock", 500.0, 0.0)], folder / "in", 2)
    got = rounded(run())
    assert got == [r for r in batch(spark, [*rows, ("a", 100.0, 1.0)])]


def test_wrong_lengths(spark):
    points = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        full_frames.full_frames(points, "k", "ts", "v", 5, 2, "1 second")


class Kept:
    """A state variable in memory that counts its calls."""

    calls = 0

    def __init__(self):
        self.rows, self.value = [], None
        self.map = {}

    def __getattribute__(self, name):
        if not name.startswith("_") and name not in ("rows", "value", "map", "calls"):
            Kept.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None or bool(self.rows)

    def get(self):
        return self.value if self.value is not None else iter(self.rows)

    def update(self, value):
        self.value = value

    def appendValue(self, row):
        self.rows.append(row)

    def appendList(self, rows):
        self.rows.extend(rows)

    def clear(self):
        self.rows = []

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def iterator(self):
        return iter(list(self.map.items()))


def test_state_calls_do_not_follow_the_rows():
    class Handle:
        def getValueState(self, *_):
            return Kept()

        getListState = getMapState = getValueState

        def registerTimer(self, _):
            pass

    class Clock:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    state, clock = full_frames.FrameState("k", FRAME, STRIDE), Clock()
    state.init(Handle())
    rows = pd.DataFrame({"t_us": np.arange(2_000) * 500_000 + STRIDE, "x": np.ones(2_000)})
    Kept.calls = 0
    assert not list(state.handleInputRows(("a",), iter([rows]), clock))
    clock.now = 990_000
    sent = pd.concat(state.handleExpiredTimer(("a",), clock, None))
    # Whole frames until the watermark; what is left are the panes behind it.
    assert len(sent) == (990_000_000 - STRIDE - FRAME) // STRIDE + 1 and set(sent["n"]) == {8}
    assert Kept.calls < 40
