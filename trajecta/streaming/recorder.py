"""The history of a sequence's last frames as keyed state: similarity and overlap of each new
frame's detections with those of the frames before.

A sequence's state is a map of frames (a ring: what is more than ``frames`` back goes), a map of
frames that wait for the watermark, and the last time seen. Rows of a micro-batch come in any
order; timers release frames in order once the watermark has passed them. A sequence without
rows for ``idle`` is over, and a timer removes all of its state. Only the frames that a step
needs are read and written, not the whole state. The state lives in RocksDB, which this kind of
state needs: :func:`recorded` sets that store for the session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trajecta.operators.tracker import overlaps

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORDS = "seq_id int, a_frame int, a_det_idx int, frame int, det_idx int, similarity double, overlap double"
_ROWS = "at long, idx array<int>, boxes array<double>, features array<double>"


class Recorder(StatefulProcessor):
    """Detections of one sequence in, pairs with its history out."""

    def __init__(self, frames: int = 26, decay: float = 1.0, idle_ms: int = 60_000) -> None:
        self.frames, self.decay, self.idle = frames, decay, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getMapState("ring", "frame int", _ROWS)
        self.waiting = handle.getMapState("waiting", "frame int", _ROWS)
        self.latest = handle.getValueState("latest", "at long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = self.latest.get()[0] if self.latest.exists() else -1
        for pdf in rows:
            for frame, part in pdf.groupby("frame"):
                at = int(part["event_time"].iloc[0].value // 1_000_000)
                have = self.waiting.getValue((int(frame),)) if self.waiting.containsKey((int(frame),)) else (at, [], [], [])
                features = np.stack(part["feature"].to_numpy()).astype(float)
                now = part["det_idx"].tolist(), part[["x", "y", "w", "h"]].to_numpy(float).ravel().tolist(), features.ravel().tolist()
                self.waiting.updateValue((int(frame),), (at, *[[*a, *b] for a, b in zip(have[1:], now, strict=True)]))
                self.handle.registerTimer(at)
                latest = max(latest, at)
        if latest >= 0:
            self.latest.update((latest,))
            self.handle.registerTimer(latest + self.idle)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        ready = sorted((f[0], v) for f, v in self.waiting.iterator() if v[0] <= mark)
        for frame, (at, idx, boxes, features) in ready:
            self.waiting.removeKey((frame,))
            order = np.argsort(idx, kind="stable")
            idx, boxes, features = np.asarray(idx)[order], np.reshape(boxes, (-1, 4))[order], np.reshape(features, (len(idx), -1))[order]
            norm = np.linalg.norm(features, axis=1, keepdims=True)
            features = np.divide(features, norm, out=np.zeros_like(features), where=norm > 0)
            past = sorted((f[0], v) for f, v in self.ring.iterator())
            for f, (_, old_idx, old_boxes, old) in past:
                if f < frame - self.frames:
                    self.ring.removeKey((f,))
                    continue
                if f >= frame:  # what came twice or after its turn has no history here
                    continue
                like = np.reshape(old, (len(old_idx), -1)) @ features.T * self.decay ** (frame - f)
                i, j = (x.ravel() for x in np.indices(like.shape))
                yield pd.DataFrame({"seq_id": int(key[0]), "a_frame": f, "a_det_idx": np.asarray(old_idx)[i], "frame": frame, "det_idx": idx[j], "similarity": like.ravel(), "overlap": overlaps(np.reshape(old_boxes, (-1, 4)), boxes, signed=True).ravel()})
            self.ring.updateValue((frame,), (at, idx.tolist(), boxes.ravel().tolist(), features.ravel().tolist()))
        if self.latest.exists() and self.latest.get()[0] + self.idle <= mark and not any(True for _ in self.waiting.keys()):
            for state in (self.ring, self.waiting, self.latest):
                state.clear()


def recorded(dets: DataFrame, frames: int = 26, decay: float = 1.0, delay: str = "1 second", idle_ms: int = 60_000) -> DataFrame:
    """dets (a stream): seq_id, frame, det_idx, x, y, w, h, feature, event_time -> pairs of each
    detection with those of up to ``frames`` earlier frames: the cosine times decay ** gap, and
    the signed IoU. Frames later than the watermark are dropped by Spark."""
    dets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    named = dets.select("seq_id", "frame", "det_idx", "x", "y", "w", "h", "feature", "event_time").withWatermark("event_time", delay)
    return named.groupBy("seq_id").transformWithStateInPandas(statefulProcessor=Recorder(frames, decay, idle_ms), outputStructType=RECORDS, outputMode="Append", timeMode="EventTime")
