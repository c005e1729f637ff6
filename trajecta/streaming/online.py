"""The online trackers over a stream of detections.

Rows of a micro-batch come in any order, so frames wait in the state until the watermark has
passed them; then they are stepped in order. Patience and ages are numbers of frames, counted
when frames are released. Frames later than the watermark are dropped by Spark. A sequence that
has had no rows for ``idle_ms`` of event time is over; its state is removed."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trajecta.operators.tracker import TRACKS, AppearanceTracker, KalmanTracker, as_frame


def event_time(frame: Column, rate: float = 25.0, origin: str = "2020-01-01 00:00:00") -> Column:
    """A frame's time: ``origin`` plus frame / rate seconds."""
    return F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(origin))) + F.round(frame * F.lit(1e6 / rate)).cast("bigint"))


def online_tracks(dets: DataFrame, delay: str = "1 second", machine: Callable[[], object] = KalmanTracker, idle_ms: int = 60_000) -> DataFrame:
    """dets: seq_id, frame, det_idx, x, y, w, h, event_time (and feature for appearance) ->
    rows of tracks, appended as frames are released."""
    appearance = isinstance(machine(), AppearanceTracker)
    columns = ["seq_id", "frame", "det_idx", "x", "y", "w", "h", "event_time", *(["feature"] if appearance else [])]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live, waiting, done, latest = pickle.loads(state.get[0]) if state.exists else (machine(), {}, None, 0)
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                at = int(row.event_time.value // 1_000_000)
                waiting.setdefault(int(row.frame), (at, []))[1].append((int(row.det_idx), row.x, row.y, row.w, row.h, getattr(row, "feature", None)))
        mark = state.getCurrentWatermarkMs()
        latest = max([latest, *(at for at, _ in waiting.values())])
        if not waiting and latest + idle_ms <= mark:
            if state.exists:
                state.remove()
            return
        rows: list[tuple] = []
        ready = [f for f, (at, _) in waiting.items() if at <= mark]
        if ready:
            for f in range(min(ready) if done is None else done + 1, max(ready) + 1):
                got = sorted(waiting.pop(f, (0, []))[1], key=lambda r: r[0])
                boxes = np.array([r[1:5] for r in got], float).reshape(-1, 4)
                if appearance:
                    out = live.step(f, boxes, np.array([r[5] for r in got], float).reshape(len(got), -1))
                else:
                    out = live.step(boxes)
                rows += [(int(key[0]), f, t, got[k][0] if k >= 0 else None, *map(int, b), seen) for t, k, b, seen in out]
                done = f
        state.update((pickle.dumps((live, waiting, done, latest)),))
        state.setTimeoutTimestamp(max(mark + 1, min(at for at, _ in waiting.values()) + 1 if waiting else latest + idle_ms))
        yield as_frame(rows)

    return dets.select(*columns).withWatermark("event_time", delay).groupBy("seq_id").applyInPandasWithState(run, TRACKS, "machine binary", "append", GroupStateTimeout.EventTimeTimeout)
