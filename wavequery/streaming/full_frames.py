"""Full frames on a stream: aligned with the first sample of each series, as in batch.

The state of a series is bounded by its frame, whatever its rate: until the watermark has passed the first known time, an
earlier row may still come, so rows wait in a list; then they are sums per pane of one stride. Panes are added up in memory, and
only those that are still needed go to the state store. A frame is sent once the watermark
has passed its end and the series has reached it, so frames are whole and none is sent twice; its panes are dropped when
no later frame needs them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

_FRAME = "start_us long, end_us long, n long, snr_rms double, snr_peak double, crest_factor double"
_COLUMNS = "start_us end_us n snr_rms snr_peak crest_factor".split()


class FrameState(StatefulProcessor):
    """Panes and frames of one series; ``meta`` is origin, last time, whether the origin is settled, and the next frame."""

    def __init__(self, key: str, frame_us: int, stride_us: int):
        self.key, self.frame_us, self.stride_us = key, frame_us, stride_us
        self.per_frame = frame_us // stride_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "origin long, last long, settled boolean, frame long")
        # One entry per series and batch: a call of the state store costs more than the rows in it.
        self.early = handle.getListState("early", "t array<long>, x array<double>")
        self.panes = handle.getMapState("panes", "pane long", "n long, energy double, peak double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        t = np.concatenate([p["t_us"].to_numpy(dtype=np.int64) for p in parts])
        x = np.concatenate([p["x"].to_numpy(dtype=np.float64) for p in parts])
        if not len(t):
            return
        if self.meta.exists():
            origin, last, settled, frame = self.meta.get()
        else:
            origin, last, settled, frame = int(t.min()), int(t.max()), False, 0
        last = max(last, int(t.max()))
        if not settled:
            origin = min(origin, int(t.min()))
            if timerValues.getCurrentWatermarkInMs() * 1000 < origin:
                self.early.appendValue((t.tolist(), x.tolist()))
                self.meta.update((origin, last, settled, frame))
                self._wake(origin)
                return
        held = t >= origin
        yield from self._send(key, timerValues, (origin, last, settled, frame), t[held], x[held])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        meta = self.meta.get()
        if not meta[2] and timerValues.getCurrentWatermarkInMs() * 1000 < meta[0]:
            self._wake(meta[0])
            return
        yield from self._send(key, timerValues, meta, np.zeros(0, np.int64), np.zeros(0))

    def _added(self, panes: dict[int, tuple], t: np.ndarray, x: np.ndarray, origin: int) -> None:
        """Put rows into ``panes``."""
        if not len(t):
            return
        numbers, at = np.unique((t - origin) // self.stride_us, return_inverse=True)
        n, energy = np.bincount(at), np.bincount(at, x * x)
        peak = np.zeros(len(numbers))
        np.maximum.at(peak, at, np.abs(x))
        for pane, *new in zip(numbers.tolist(), n.tolist(), energy.tolist(), peak.tolist(), strict=True):
            old = panes.get(pane, (0, 0.0, 0.0))
            panes[pane] = (old[0] + new[0], old[1] + new[1], max(old[2], new[2]))

    def _send(self, key, timerValues, meta, t: np.ndarray, x: np.ndarray) -> Iterator[pd.DataFrame]:
        """Add rows to the panes and send the frames that are whole; only panes that changed are written or removed."""
        origin, last, settled, frame = meta
        now = timerValues.getCurrentWatermarkInMs() * 1000
        stored = {k[0]: tuple(v) for k, v in self.panes.iterator()} if settled else {}
        panes = dict(stored)
        if not settled:
            waiting = list(self.early.get()) if self.early.exists() else []
            self.early.clear()
            t = np.concatenate([*(np.array(w[0], np.int64) for w in waiting), t])
            x = np.concatenate([*(np.array(w[1], np.float64) for w in waiting), x])
        self._added(panes, t, x, origin)
        frames, order, next_at = [], sorted(panes), 0
        while next_at < len(order):
            # Frames before the first pane are empty.
            frame = max(frame, order[next_at] - self.per_frame + 1)
            start = origin + frame * self.stride_us
            if start + self.frame_us > min(last, now):
                if start + self.frame_us > now:
                    self._wake(start + self.frame_us)
                break
            inside = [panes[p] for p in range(frame, frame + self.per_frame) if p in panes]
            n, energy, peak = sum(v[0] for v in inside), sum(v[1] for v in inside), max(v[2] for v in inside)
            rms = float(np.sqrt(energy / n + 1e-12))
            crest = max(peak / (rms if abs(rms) >= 1e-12 else 1e-12), 0.0)
            frames.append((start, start + self.frame_us, n, rms, peak, crest))
            if panes.pop(frame, None) is not None:
                next_at += 1
            frame += 1
        for pane in stored.keys() - panes.keys():
            self.panes.removeKey((pane,))
        for pane, value in panes.items():
            if stored.get(pane) != value:
                self.panes.updateValue((pane,), value)
        self.meta.update((origin, last, True, frame))
        if frames:
            out = pd.DataFrame(frames, columns=_COLUMNS)
            out.insert(0, self.key, [key[0]] * len(out))
            yield out

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(-(-at_us // 1000))

    def close(self) -> None:
        pass


def full_frames(points: DataFrame, key: str, time: str, value: str, frame_us: int, stride_us: int, delay: str) -> DataFrame:
    """``key``, ``start_us``, ``end_us``, ``n``, ``snr_rms``, ``snr_peak``, ``crest_factor`` of every full frame of a stream of points.

    Rows without a key, a time or a value are left out. Rows later than ``delay`` may be. The state lives in RocksDB: run the
    stream with ``jobs.run_available(..., state_store=ROCKS_DB)`` or set the provider of the session.
    """
    if frame_us <= 0 or stride_us <= 0 or frame_us % stride_us:
        raise ValueError("the frame must be a positive multiple of the stride")
    rows = points.select(key, time, F.unix_micros(time).alias("t_us"), F.col(value).cast("double").alias("x")).dropna()
    schema = T.StructType([points.schema[key], *T.StructType.fromDDL(_FRAME)])
    return (
        rows.withWatermark(time, delay)
        .groupBy(key)
        .transformWithStateInPandas(FrameState(key, frame_us, stride_us), schema, "append", "EventTime")
    )
