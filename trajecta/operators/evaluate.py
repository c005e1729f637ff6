"""CLEAR and identity metrics. Candidate pairs are made by frame; matching is sequential within
a sequence, so it is a kernel per sequence; sums are aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.operators.assignment import optimal
from trajecta.operators.lineage import written
from trajecta.operators.pairs import dealt, overlapping, streamed, whole_frames


def _near(a: np.ndarray, b: np.ndarray, cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the boxes of a and b whose IoU distance is at most ``cutoff``, and it, in pieces.
    Below a distance of 1 boxes share area."""
    if cutoff < 1:
        for i, j, overlap in overlapping(a, b, max(0.0, 1 - cutoff - 1e-6)):
            near = 1 - overlap <= cutoff
            yield i[near], j[near], 1 - overlap[near]
        return
    for k in range(0, len(a), 64):
        p = a[k : k + 64, None]
        both = np.maximum(0.0, np.minimum(p[..., :2] + p[..., 2:], b[:, :2] + b[:, 2:]) - np.maximum(p[..., :2], b[:, :2])).prod(-1)
        whole = p[..., 2] * p[..., 3] + b[:, 2] * b[:, 3] - both
        d = 1 - np.divide(both, whole, out=np.full_like(both, np.nan), where=whole != 0)
        i, j = np.nonzero(d <= cutoff)
        yield i + k, j, d[i, j]


def _sides(gt: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    boxes = ["x", "y", "w", "h"]
    return tuple(t.select("seq_id", "frame", F.col(c).cast("long").alias("id"), *(F.col(b).cast("double").alias(b) for b in boxes)) for t, c in ((gt, "obj_id"), (tracks, "track_id")))


def candidates(gt: DataFrame, tracks: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Pairs of a frame with an IoU distance of at most ``cutoff``: seq_id, frame, obj_id,
    track_id, distance. They are made in the frame's task, in pieces; only boxes are sent."""
    kinds = {c: t.schema[c].dataType.simpleString() for t, c in ((gt, "seq_id"), (gt, "frame"), (gt, "obj_id"), (tracks, "track_id"))}

    def run(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[pd.DataFrame]:
        a, b = (t[["x", "y", "w", "h"]].to_numpy(float) for t in (x, y))
        keys = {c: x[c].iloc[0] for c in ("seq_id", "frame")}
        held, n = [], 0
        for part in _near(a, b, cutoff):
            held.append(part)
            n += len(part[0])
            if n > 1 << 16:
                yield rows(held, x, y, keys)
                held, n = [], 0
        if n:
            yield rows(held, x, y, keys)

    def rows(held: list, x: pd.DataFrame, y: pd.DataFrame, keys: dict) -> pd.DataFrame:
        i, j, d = (np.concatenate(c) for c in zip(*held, strict=True))
        return pd.DataFrame(keys | {"obj_id": x["id"].to_numpy()[i], "track_id": y["id"].to_numpy()[j], "distance": d})

    return streamed(*_sides(gt, tracks), ["seq_id", "frame"], run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", distance double")


class _Matches:
    """Matches of a sequence, frame by frame: those of earlier frames stay while they can."""

    def __init__(self) -> None:
        self.kept: dict[int, int] = {}
        self.switches, self.matches, self.total = 0, 0, 0.0

    def step(self, obj: np.ndarray, trk: np.ndarray, d: np.ndarray) -> None:
        order = np.lexsort((d, trk, obj))
        obj, trk, d = obj[order], trk[order], d[order]
        if not len(obj):
            return
        kept = self.kept
        objs, tracks = np.unique(obj), np.unique(trk)
        at, place = ({v: n for n, v in enumerate(x.tolist())} for x in (objs, tracks))
        pair = np.searchsorted(objs, obj) * len(tracks) + np.searchsorted(tracks, trk)
        known = [(a, b) for a, b in kept.items() if a in at and b in place]
        wish = np.array([at[a] * len(tracks) + place[b] for a, b in known], np.int64)
        where = np.minimum(np.searchsorted(pair, wish), len(pair) - 1)
        now = {a: (b, k) for (a, b), k, met in zip(known, where.tolist(), (pair[where] == wish).tolist(), strict=True) if met}
        last = {b: a for a, (b, _) in now.items()}
        now = {a: now[a] for a in last.values()}
        rest = np.flatnonzero(~(np.isin(obj, list(now)) | np.isin(trk, [b for b, _ in now.values()])))
        for k in rest[optimal(obj[rest], trk[rest], d[rest])].tolist():
            a, b = int(obj[k]), int(trk[k])
            self.switches += a in kept and kept[a] != b
            now[a] = (b, k)
        kept.update((a, b) for a, (b, _) in now.items())
        self.matches += len(now)
        self.total += sum(d[[k for _, k in now.values()]].tolist())


def clear_mot(gt: DataFrame, tracks: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Per sequence: counts, mota and motp (mean distance of matches), with their signs. A task
    holds a frame's boxes and pairs and the last match of each object, never a whole sequence."""
    a, b = _sides(gt, tracks)
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    rows = dealt(both, "seq_id").sortWithinPartitions("seq_id", "frame", "side", "id")
    kind = gt.schema["seq_id"].dataType.simpleString()

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, seq, found = _Matches(), None, []
        for part in whole_frames(batches):
            if part["seq_id"].iloc[0] != seq:
                state, seq = _Matches(), part["seq_id"].iloc[0]
                found.append((seq, state))
            x, y = part[part["side"] == 0], part[part["side"] == 1]
            near = list(_near(*(t[["x", "y", "w", "h"]].to_numpy() for t in (x, y)), cutoff)) if len(x) and len(y) else []
            if near:
                i, j, d = (np.concatenate(c) for c in zip(*near, strict=True))
                state.step(x["id"].to_numpy()[i], y["id"].to_numpy()[j], d)
        yield pd.DataFrame([(q, s.matches, int(s.switches), s.total) for q, s in found], columns=["seq_id", "matches", "switches", "distance"])

    found = rows.mapInPandas(match, f"seq_id {kind}, matches long, switches long, distance double")
    n = gt.groupBy("seq_id").agg(F.count(F.lit(1)).alias("objects"))
    p = tracks.groupBy("seq_id").agg(F.count(F.lit(1)).alias("predictions"))
    out = n.join(p, "seq_id", "full").join(found, "seq_id", "left").fillna(0)
    misses, false = F.col("objects") - F.col("matches"), F.col("predictions") - F.col("matches")
    return out.select("seq_id", "objects", "predictions", "matches", misses.alias("misses"), false.alias("false_positives"), "switches", (1 - F.try_divide(misses + false + F.col("switches"), F.col("objects"))).alias("mota"), F.try_divide(F.col("distance"), F.col("matches")).alias("motp"))


def cooccurrence(gt: DataFrame, tracks: DataFrame, cutoff: float = 0.5) -> DataFrame:
    return candidates(gt, tracks, cutoff).groupBy("seq_id", "obj_id", "track_id").agg(F.count(F.lit(1)).alias("frames"))


def _possible(frames: DataFrame) -> DataFrame:
    """Of ``cooccurrence``, without the pairs that cannot be in a best pairing of their sequence: no
    pairing is better than the sum of each object's most frames, and one that lets each track have
    the best of the objects that want it most exists; a pair that loses more than lies between
    the two is in none of the best."""
    most = frames.groupBy("seq_id", "obj_id").agg(F.max("frames").alias("most"), F.max(F.struct("frames", "track_id"))["track_id"].alias("track_id"))
    each = most.groupBy("seq_id", "track_id").agg(F.max("most").alias("given"), F.sum("most").alias("wanted"))
    gap = each.groupBy("seq_id").agg(F.sum(F.col("wanted") - F.col("given")).alias("gap"))
    kept = frames.join(most.select("seq_id", "obj_id", "most"), ["seq_id", "obj_id"]).join(F.broadcast(gap), "seq_id")
    return kept.where(F.col("most") - F.col("frames") <= F.col("gap")).select("seq_id", "obj_id", "track_id", "frames")


def idf1(gt: DataFrame, tracks: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Identity F1 per sequence by the best one-to-one pairing of objects and tracks."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        # most frames, not most pairs: every object has a column of its own, at no gain
        objs, oi = np.unique(pdf["obj_id"], return_inverse=True)
        trks, ti = np.unique(pdf["track_id"], return_inverse=True)
        alone = np.arange(len(objs))
        i, j = np.concatenate([oi, alone]), np.concatenate([ti, len(trks) + alone])
        c = np.concatenate([-pdf["frames"].to_numpy(float), np.zeros(len(objs))])
        chosen = optimal(i, j, c)
        return pd.DataFrame({"seq_id": [int(pdf["seq_id"].iloc[0])], "idtp": [int(-c[chosen].sum())]})

    found = _possible(written(cooccurrence(gt, tracks, cutoff), "frames")).groupBy("seq_id").applyInPandas(best, "seq_id int, idtp long")
    n = gt.groupBy("seq_id").agg(F.count(F.lit(1)).alias("objects"))
    p = tracks.groupBy("seq_id").agg(F.count(F.lit(1)).alias("predictions"))
    out = n.join(p, "seq_id", "full").join(found, "seq_id", "left").fillna(0)
    return out.select("seq_id", "objects", "predictions", "idtp", F.try_divide(2 * F.col("idtp"), F.col("objects") + F.col("predictions")).alias("idf1"))
