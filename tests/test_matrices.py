"""Matrices as columns, the filter and the smoother against numpy."""

import numpy as np
from pyspark.sql import functions as F

from trajecta.operators import kalman, matrices as M


def test_products_and_inverses(spark):
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 5):
        m = r.normal(size=(n, n))
        df = spark.createDataFrame([(m.tolist(), (m @ m.T + np.eye(n)).tolist())], f"m {M.MATRIX}, s {M.MATRIX}")
        g = M.grid(F.col("m"), n, n)
        got = df.select(M.packed(M.product(g, M.turned(g))).alias("p"), M.inverse(F.col("s"), n).alias("v")).first()
        assert np.allclose(got["p"], m @ m.T) and np.allclose(got["v"], np.linalg.inv(m @ m.T + np.eye(n)))


def test_singular_matrix_has_no_inverse(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [2.0, 4.0]],)], f"m {M.MATRIX}")
    assert all(x is None for row in df.select(M.inverse(F.col("m"), 2).alias("v")).first()["v"] for x in row)


def _model(dt):
    f = np.array([[1, 0, dt, 0], [0, 1, 0, dt], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    return f, (0.5 + dt) * np.eye(4), np.eye(2, 4), (2.0 + dt) * np.eye(2)


def _runs():
    r = np.random.default_rng(9)
    rows, want = [], {}
    x0, p0 = np.zeros(4), np.diag([25.0, 25.0, 100.0, 100.0])
    for key in range(3):
        zs = [None if n % 5 == 3 else r.normal(size=2) * 4 + n for n in range(9)]
        steps = [_model(1.0 + (n * (key + 1)) % 3) for n in range(9)]
        for n, (z, (f, q, h, rr)) in enumerate(zip(zs, steps, strict=True)):
            rows.append((key, n, None if z is None else z.tolist(), f.tolist(), q.tolist(), h.tolist(), rr.tolist(), x0.tolist(), p0.tolist()))
        want[key] = zs, [dict(zip("FQHR", s, strict=True)) for s in steps]
    schema = f"k int, n int, z array<double>, f {M.MATRIX}, q {M.MATRIX}, h {M.MATRIX}, r {M.MATRIX}, x0 array<double>, p0 {M.MATRIX}"
    return rows, schema, want, x0, p0


def test_filter_with_matrices_of_each_step(spark):
    rows, schema, want, x0, p0 = _runs()
    for first in (False, True):
        got = {x["k"]: x["steps"] for x in M.filtered(spark.createDataFrame(rows, schema), ["k"], "n", 4, 2, 1.05, first).collect()}
        for k, (zs, steps) in want.items():
            m = kalman.MatrixFilter(x0[:, None].copy(), p0.copy(), *(steps[0][c] for c in "FHQR"), alpha=1.05)
            out = m.run(zs, steps, first)
            for n, s in enumerate(got[k]):
                for name, other in (("x", "x"), ("x_before", "x_before")):
                    assert np.allclose(s[name], out[other][n][:, 0])
                assert np.allclose(s["p"], out["P"][n]) and np.allclose(s["p_before"], out["P_before"][n])
                assert (s["d"] is None) == (out["d"][n] is None) and (s["d"] is None or np.isclose(s["d"], out["d"][n]))


def test_smoother_with_matrices_of_each_step(spark):
    rows, schema, want, x0, p0 = _runs()
    got = M.smoothed(M.filtered(spark.createDataFrame(rows, schema), ["k"], "n", 4, 2), ["k"], "n", 4).collect()
    for k, (zs, steps) in want.items():
        m = kalman.MatrixFilter(x0[:, None].copy(), p0.copy(), *(steps[0][c] for c in "FHQR"))
        out = m.run(zs, steps)
        xs, ps = [x.copy() for x in out["x"]], [p.copy() for p in out["P"]]
        for n in range(len(zs) - 2, -1, -1):
            f, q = steps[n + 1]["F"], steps[n + 1]["Q"]
            before = f @ ps[n] @ f.T + q
            gain = ps[n] @ f.T @ np.linalg.inv(before)
            xs[n], ps[n] = xs[n] + gain @ (xs[n + 1] - f @ xs[n]), ps[n] + gain @ (ps[n + 1] - before) @ gain.T
        mine = {x["n"]: x for x in got if x["k"] == k}
        assert len(mine) == len(zs)
        for n in range(len(zs)):
            assert np.allclose(mine[n]["x"], xs[n][:, 0]) and np.allclose(mine[n]["p"], ps[n])


def test_no_rows(spark):
    rows, schema, *_ = _runs()
    none = spark.createDataFrame([], schema)
    assert M.smoothed(M.filtered(none, ["k"], "n", 4, 2), ["k"], "n", 4).count() == 0
