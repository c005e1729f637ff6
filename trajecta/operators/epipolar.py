"""Fundamental matrices from matched points by the normalised eight-point method and RANSAC."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = p.mean(0)
    s = np.sqrt(2) / max(np.sqrt(((p - mean) ** 2).sum(1)).mean(), 1e-12)
    t = np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])
    return np.c_[p, np.ones(len(p))] @ t.T, t


#: Distances of points that are judged at once (a few times 8 bytes each).
_AT_ONCE = 1 << 20


def eight_points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """F with b^T F a = 0 for matched points (n, 2), n >= 8."""
    (pa, ta), (pb, tb) = _scaled(a), _scaled(b)
    rows = np.einsum("ni,nj->nij", pb, pa).reshape(len(a), 9)
    # the left vectors would be a square of the matches; of eight rows the ninth right one is needed
    f = np.linalg.svd(rows, full_matrices=len(rows) < 9)[2][-1].reshape(3, 3)
    u, s, v = np.linalg.svd(f)
    f = tb.T @ (u @ np.diag([s[0], s[1], 0.0]) @ v) @ ta
    return f / max(np.linalg.norm(f), 1e-300)


def _sampled(a: np.ndarray, b: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """``eight_points`` of many samples (k, 8) at once."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = p.mean(1)
        s = np.sqrt(2) / np.maximum(np.sqrt(((p - mean[:, None]) ** 2).sum(2)).mean(1), 1e-12)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = s
        t[:, :2, 2], t[:, 2, 2] = -s[:, None] * mean, 1
        return np.concatenate([(p - mean[:, None]) * s[:, None, None], np.ones((*p.shape[:2], 1))], 2), t

    (pa, ta), (pb, tb) = scaled(a[picks]), scaled(b[picks])
    rows = np.einsum("kni,knj->knij", pb, pa).reshape(len(picks), -1, 9)
    u, s, v = np.linalg.svd(np.linalg.svd(rows)[2][:, -1].reshape(-1, 3, 3))
    s[:, 2] = 0
    f = tb.transpose(0, 2, 1) @ (u * s[:, None]) @ v @ ta
    return f / np.maximum(np.linalg.norm(f, axis=(1, 2)), 1e-300)[:, None, None]


def ransac(a: np.ndarray, b: np.ndarray, within: float = 1.0, draws: int = 200, seed: int = 26) -> tuple[np.ndarray, np.ndarray]:
    """The matrix with most inliers over seeded draws of eight matches (the first of equal ones),
    fitted again to those; draws are solved and judged together, as many as ``_AT_ONCE`` allows."""
    random = np.random.default_rng(seed)
    pa, pb = np.c_[a, np.ones(len(a))], np.c_[b, np.ones(len(b))]
    each, best = max(1, _AT_ONCE // len(a)), np.zeros(len(a), bool)
    for k in range(0, draws if len(a) > 8 else 1, each):
        f = _sampled(a, b, np.argpartition(random.random((min(each, draws - k), len(a))), 7, axis=1)[:, :8] if len(a) > 8 else np.tile(np.arange(8), (1, 1)))
        la, lb = np.einsum("ni,kij->knj", pb, f), np.einsum("ni,kji->knj", pa, f)
        e = np.abs(np.einsum("ni,kni->kn", pb, lb))
        far = np.maximum(e / np.maximum(np.hypot(la[..., 0], la[..., 1]), 1e-12), e / np.maximum(np.hypot(lb[..., 0], lb[..., 1]), 1e-12))
        inside = far <= within
        top = inside.sum(1).argmax()
        if inside[top].sum() > best.sum():
            best = inside[top]
    if best.sum() < 8:
        best = np.ones(len(a), bool)
    return eight_points(a[best], b[best]), best


def fundamental_matrices(pairs: DataFrame) -> DataFrame:
    """pairs(seq_id, a_frame, a_u, a_v, b_u, b_v, a_obj_id: an order of a frame's pairs) -> seq_id,
    frame, matches, inliers, f; frames with fewer than eight pairs have no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a_obj_id", kind="stable")
        a, b = pdf[["a_u", "a_v"]].to_numpy(), pdf[["b_u", "b_v"]].to_numpy()
        if len(a) < 8:
            return pd.DataFrame(columns=["seq_id", "frame", "matches", "inliers", "f"], dtype=object)
        f, inside = ransac(a, b)
        return pd.DataFrame({"seq_id": [int(pdf["seq_id"].iloc[0])], "frame": [int(pdf["a_frame"].iloc[0])], "matches": [len(a)], "inliers": [int(inside.sum())], "f": [f.ravel().tolist()]})

    return pairs.groupBy("seq_id", "a_frame").applyInPandas(run, "seq_id int, frame int, matches int, inliers int, f array<double>")


def fundamental_from_matches(points: DataFrame, matches: DataFrame) -> DataFrame:
    """points(seq_id, frame, idx, u, v) and matches of descriptors (seq_id, frame, a_idx, b_idx,
    rank; b in the frame after) -> ``fundamental_matrices`` of the matched points, cut to whole
    pixels."""
    at = lambda p: points.select("seq_id", F.col("frame").alias(f"{p}_frame"), F.col("idx").alias(f"{p}_idx"), *[F.col(c).cast("int").cast("double").alias(f"{p}_{c}") for c in "uv"])
    both = matches.withColumn("a_frame", F.col("frame")).withColumn("b_frame", F.col("frame") + 1)
    both = both.join(at("a"), ["seq_id", "a_frame", "a_idx"]).join(at("b"), ["seq_id", "b_frame", "b_idx"])
    return fundamental_matrices(both.withColumnRenamed("rank", "a_obj_id"))
