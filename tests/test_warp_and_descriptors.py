"""Warps of planted points, descriptor matches against all pairs, matrices from matches."""

import numpy as np
import pytest

from trajecta.operators import descriptors, epipolar, warp

POINTS = "seq_id int, frame int, ax double, ay double, bx double, by double"


def planted(spark, noise=0.0):
    """Points of some frames, moved by a warp of each frame."""
    rng = np.random.default_rng(0)
    truth, rows = {}, []
    for f in range(12):
        turn, shear = rng.uniform(-1, 1), rng.uniform(-0.3, 0.3)
        for mode, m in (("translation", np.eye(2)), ("euclidean", np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])), ("affine", np.array([[1.1, shear], [-0.2, 0.9]]))):
            move = rng.uniform(-80, 80, 2)
            truth[mode, f] = np.c_[m, move]
            a = rng.uniform(0, 1000, (int(rng.integers(3, 30)), 2))
            b = a @ m.T + move + noise * rng.standard_normal(a.shape)
            rows += [(list(warp.LEAST).index(mode), f, *map(float, p), *map(float, q)) for p, q in zip(a, b, strict=True)]
    return spark.createDataFrame(rows, POINTS), truth


@pytest.mark.parametrize("mode", list(warp.LEAST))
@pytest.mark.parametrize("scale", [1.0, 0.25])
def test_planted_warps_come_back(spark, mode, scale):
    points, truth = planted(spark)
    got = warp.warps(points.where(f"seq_id = {list(warp.LEAST).index(mode)}"), mode, ["frame"], scale=scale).collect()
    assert len(got) == 12
    for r in got:
        assert np.allclose([[r.w00, r.w01, r.w02], [r.w10, r.w11, r.w12]], truth[mode, r.frame], atol=1e-6)


def test_affine_is_the_least_squares_solution(spark):
    points, _ = planted(spark, 5.0)
    got = {(r.seq_id, r.frame): [[r.w00, r.w01, r.w02], [r.w10, r.w11, r.w12]] for r in warp.warps(points, "affine", ["seq_id", "frame"]).collect()}
    for key, p in points.toPandas().groupby(["seq_id", "frame"]):
        want = np.linalg.lstsq(np.c_[p[["ax", "ay"]], np.ones(len(p))], p[["bx", "by"]].to_numpy(), rcond=None)[0].T
        assert np.allclose(got[key], want, atol=1e-6)


def test_undetermined_warps_are_null(spark):
    rows = [(0, 0, 1.0, 2.0, 3.0, 4.0)] * 4 + [(0, 1, float(k), 2.0 * k, 3.0 * k, 4.0) for k in range(5)] + [(0, 2, 1.0, 1.0, 4.0, 5.0)]
    points = spark.createDataFrame(rows, POINTS)
    got = {r.frame: r for r in warp.warps(points, "affine", ["frame"]).collect()}
    assert all(got[f].w00 is None and got[f].w02 is None for f in range(3))
    assert {r.frame: r.w00 is None for r in warp.warps(points, "euclidean", ["frame"]).collect()} == {0: True, 1: False, 2: True}
    assert {r.frame: (r.w02, r.w12) for r in warp.warps(points, "translation", ["frame"]).collect()}[2] == (3.0, 4.0)
    assert warp.warps(points.where("false"), "affine", ["frame"]).count() == 0


def words(rng, n):
    return rng.integers(-(2**63), 2**63 - 1, (n, 4), dtype=np.int64)


def flipped(rng, w, most):
    out = w.copy()
    for row in out:
        for bit in rng.choice(256, int(rng.integers(0, most + 1)), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64)).astype(np.int64)
    return out


@pytest.mark.parametrize(("radius", "top"), [(0, None), (12, 5), (31, None), (70, 8), (255, None)])
def test_matches_equal_all_pairs(spark, radius, top):
    rng = np.random.default_rng(radius)
    a, b, want = [], [], []
    for f in range(4):
        x = words(rng, 25)
        x[3] = x[4]  # a tie
        y = np.concatenate([flipped(rng, x[:15], 40), words(rng, 6), flipped(rng, x[2:4], 3)])
        a += [(0, f, i, w.tolist()) for i, w in enumerate(x)]
        b += [(0, f, i, w.tolist()) for i, w in enumerate(y)]
        d = np.bitwise_count((x[:, None] ^ y[None]).view(np.uint64)).sum(2)
        mutual = [(int(d[i, j]), i, j) for i in range(len(x)) for j in [int(d[i].argmin())] if int(d[:, j].argmin()) == i and d[i, j] <= radius]
        want += [(0, f, i, j, s, k + 1) for k, (s, i, j) in enumerate(sorted(mutual)[:top])]
    kind = "seq_id int, frame int, idx int, words array<long>"
    got = descriptors.matches(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), ["seq_id", "frame"], radius, top)
    assert sorted(tuple(r) for r in got.select("seq_id", "frame", "a_idx", "b_idx", "distance", "rank").collect()) == sorted(want)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def test_matrix_from_matched_descriptors(spark):
    rng = np.random.default_rng(1)
    world = np.c_[rng.uniform(-5, 5, (60, 2)), rng.uniform(4, 12, 60)]
    moved = world + [1.0, 0.2, 0.1]
    u, v = world[:, :2] / world[:, 2:] * 5000, moved[:, :2] / moved[:, 2:] * 5000
    w = words(rng, 60)
    near = flipped(rng, w, 4)
    v[:9] += rng.uniform(400, 900, (9, 2))
    points, d = [], []
    for f, (at, bits) in enumerate(((u, w), (v, near))):
        points += [(0, f, k, *map(float, p)) for k, p in enumerate(at)]
        d += [(0, f, k, x.tolist()) for k, x in enumerate(bits)]
    frame = spark.createDataFrame(d, "seq_id int, frame int, idx int, words array<long>")
    m = descriptors.matches(frame, frame.withColumn("frame", frame["frame"] - 1), ["seq_id", "frame"], 20, 50)
    r = epipolar.fundamental_from_matches(spark.createDataFrame(points, "seq_id int, frame int, idx int, u double, v double"), m).first()
    assert r.matches == 50 and r.inliers >= 0.75 * 50
    f = np.array(r.f).reshape(3, 3)
    a, b = np.c_[u[9:], np.ones(51)], np.c_[v[9:], np.ones(51)]
    line = a @ f.T
    assert np.median(np.abs((b * line).sum(1)) / np.hypot(line[:, 0], line[:, 1])) < 1.0


def test_samples_together_equal_one_by_one():
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 900, (2, 30, 2))
    picks = np.array([rng.choice(30, 8, replace=False) for _ in range(20)])
    for f, p in zip(epipolar._sampled(a, b, picks), picks, strict=True):
        g = epipolar.eight_points(a[p], b[p])
        assert min(np.abs(f - g).max(), np.abs(f + g).max()) < 1e-6
