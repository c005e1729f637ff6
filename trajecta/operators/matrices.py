"""Small dense matrices as columns (arrays of rows of doubles), and the general Kalman filter and
smoother as folds over them, so that linear models of any size run inside the JVM.

Sizes are known when the plan is made, so a matrix is a grid of columns and a product is plain
arithmetic. Intermediate grids are bound by :func:`bound`, else their cells would be written out
again in every cell that uses them; expressions grow with the cube of the state's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MATRIX = "array<array<double>>"
Grid = list[list[Column]]


def grid(m: Column, rows: int, cols: int) -> Grid:
    """The cells of an array of rows; those that the array does not have are null."""
    return [[F.get(F.get(m, F.lit(i)), F.lit(j)) for j in range(cols)] for i in range(rows)]


def tall(v: Column, rows: int) -> Grid:
    """An array of doubles as a grid of one column."""
    return [[F.get(v, F.lit(i))] for i in range(rows)]


def packed(g: Grid) -> Column:
    return F.array(*[F.array(*row) for row in g])


def flat(g: Grid) -> Column:
    return F.array(*[x for row in g for x in row])


def literal(m) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in m])


def bound(body: Callable[..., Column], *grids: Grid) -> Column:
    """``body`` of the grids, each cell of which is computed once."""
    value = F.struct(*[packed(g).alias(f"g{k}") for k, g in enumerate(grids)])
    sizes = [(len(g), len(g[0])) for g in grids]
    return F.get(F.transform(F.array(value), lambda v: body(*[grid(v[f"g{k}"], *s) for k, s in enumerate(sizes)])), F.lit(0))


def turned(a: Grid) -> Grid:
    return [list(c) for c in zip(*a, strict=True)]


def product(a: Grid, b: Grid) -> Grid:
    def cell(row: list[Column], col: list[Column]) -> Column:
        total = row[0] * col[0]
        for x, y in zip(row[1:], col[1:], strict=True):
            total = total + x * y
        return total

    return [[cell(row, col) for col in turned(b)] for row in a]


def plus(a: Grid, b: Grid, times: float = 1.0) -> Grid:
    """a + times * b."""
    return [[x + (y if times == 1.0 else F.lit(times) * y) for x, y in zip(r, s, strict=True)] for r, s in zip(a, b, strict=True)]


def unit(n: int) -> Grid:
    return [[F.lit(float(i == j)) for j in range(n)] for i in range(n)]


def with_inverse(m: Grid, body: Callable[[Grid], Column]) -> Column:
    """``body`` of the inverse of a symmetric positive definite matrix (which needs no exchange of
    rows); where a pivot is zero, the cells are null."""
    n = len(m)

    def eliminated(wide: Grid, k: int) -> Column:
        if k == n:
            return body([row[n:] for row in wide])
        pivot = [F.try_divide(x, wide[k][k]) for x in wide[k]]
        rest = [pivot if i == k else [x - row[k] * y for x, y in zip(row, pivot, strict=True)] for i, row in enumerate(wide)]
        return bound(lambda g: eliminated(g, k + 1), rest)

    return bound(lambda g: eliminated(g, 0), [row + one for row, one in zip(m, unit(n), strict=True)])


def inverse(m: Column, n: int) -> Column:
    """Inverse of a column of symmetric positive definite n x n matrices."""
    return with_inverse(grid(m, n, n), packed)


def _state(x: Grid, p: Grid, d: Column | None = None) -> Column:
    return F.struct(flat(x).alias("x"), packed(p).alias("p"), (F.lit(None) if d is None else d).cast("double").alias("d"))


def ahead(x: Grid, p: Grid, f: Grid, q: Grid, alpha: float = 1.0) -> Column:
    """struct(x, p, d) of the next step: F x and alpha^2 F P F' + Q; d is null."""
    return bound(lambda fp: _state(product(f, x), plus(q, product(fp, turned(f)), alpha * alpha)), product(f, p))


def corrected(x: Grid, p: Grid, z: Grid, h: Grid, r: Grid) -> Column:
    """struct(x, p, d) after a measurement, the covariance in Joseph's form; d is the Mahalanobis
    distance of the measurement."""

    def innovated(cross: Grid, y: Grid) -> Column:
        def gained(back: Grid) -> Column:
            def kept(gain: Grid, keep: Grid) -> Column:
                size = F.sqrt(product(turned(y), product(back, y))[0][0])
                return bound(lambda kp, gr: _state(plus(x, product(gain, y)), plus(product(kp, turned(keep)), product(gr, turned(gain))), size), product(keep, p), product(gain, r))

            return bound(lambda gain: bound(kept, gain, plus(unit(len(x)), product(gain, h), -1.0)), product(cross, back))

        return with_inverse(plus(product(h, cross), r), gained)

    return bound(innovated, product(p, turned(h)), plus(z, product(h, x), -1.0))


def _of(s: Column, n: int) -> tuple[Grid, Grid]:
    return tall(s["x"], n), grid(s["p"], n, n)


def _once(body: Callable[[Column], Column], value: Column) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filtered(rows: DataFrame, keys: list[str], order: str, n: int, m: int, alpha: float = 1.0, update_first: bool = False) -> DataFrame:
    """One row for each key: ``steps``, an array over the order of struct(order, x, p, d, x_before,
    p_before, f, q), for a state of n and measurements of m numbers.

    ``rows`` has, for each step, z (array of doubles; null: no measurement, the state stays as
    predicted and d is null), the matrices f, q, h and r, and x0, p0, of which the first step's are
    the state before it. Rows of equal order come in the order of their z. Where an innovation's
    pivot is zero or a matrix has nulls, cells are null from there on. The steps of one key are one
    task's work, and appending them moves as many references as the square of their number."""
    step = F.struct(order, "z", "f", "q", "h", "r", "x0", "p0")
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(step)).alias("s"))
    kept = f"array<struct<{order}:{dict(rows.dtypes)[order]},x:array<double>,p:{MATRIX},d:double,x_before:array<double>,p_before:{MATRIX},f:{MATRIX},q:{MATRIX}>>"

    def measured(s: Column, e: Column) -> Column:
        stays = F.struct(s["x"].alias("x"), s["p"].alias("p"), F.lit(None).cast("double").alias("d"))
        return F.when(e["z"].isNull(), stays).otherwise(corrected(*_of(s, n), tall(e["z"], m), grid(e["h"], m, n), grid(e["r"], m, m)))

    def predicted(s: Column, e: Column) -> Column:
        return ahead(*_of(s, n), grid(e["f"], n, n), grid(e["q"], n, n), alpha)

    def grown(acc: Column, e: Column, after: Column, before: Column) -> Column:
        last = before if update_first else after
        seen = F.struct(e[order].alias(order), after["x"].alias("x"), after["p"].alias("p"), after["d"].alias("d"), before["x"].alias("x_before"), before["p"].alias("p_before"), e["f"].alias("f"), e["q"].alias("q"))
        return F.struct(last["x"].alias("x"), last["p"].alias("p"), F.concat(acc["out"], F.array(seen)).alias("out"))

    def forward(acc: Column, e: Column) -> Column:
        if update_first:
            return _once(lambda a: _once(lambda b: grown(acc, e, a, b), predicted(a, e)), measured(acc, e))
        return _once(lambda b: _once(lambda a: grown(acc, e, a, b), measured(b, e)), predicted(acc, e))

    first = F.get("s", F.lit(0))
    begin = F.struct(first["x0"].cast("array<double>").alias("x"), first["p0"].cast(MATRIX).alias("p"), F.array().cast(kept).alias("out"))
    return listed.select(*keys, F.aggregate("s", begin, forward, lambda acc: acc["out"]).alias("steps"))


def smoothed(steps: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """:func:`filtered` -> a row for each step with x and p after Rauch-Tung-Striebel smoothing, for
    which a step takes its successor's F and Q (the fold goes from the last step to the first)."""
    kept = f"array<struct<{order}:{dict(steps.selectExpr('inline(steps)').dtypes)[order]},x:array<double>,p:{MATRIX}>>"

    def back(acc: Column, e: Column) -> Column:
        """acc has the smoothed state of the step behind, and that step's F and Q."""
        (x, p), (x1, p1) = _of(e, n), _of(acc, n)
        f, q = grid(acc["f"], n, n), grid(acc["q"], n, n)

        def known(next_p: Grid, pf: Grid) -> Column:
            def gained(turn: Grid) -> Column:
                def with_gain(gain: Grid) -> Column:
                    return bound(lambda part: _state(plus(x, product(gain, plus(x1, product(f, x), -1.0))), plus(p, product(part, turned(gain)))), product(gain, plus(p1, next_p, -1.0)))

                return bound(with_gain, product(pf, turn))

            return with_inverse(next_p, gained)

        corrected_back = bound(lambda pf: bound(known, plus(q, product(f, pf)), pf), product(p, turned(f)))
        own = F.struct(e["x"].alias("x"), e["p"].alias("p"), F.lit(None).cast("double").alias("d"))
        return _once(
            lambda s: F.struct(s["x"].alias("x"), s["p"].alias("p"), e["f"].alias("f"), e["q"].alias("q"), F.concat(acc["out"], F.array(F.struct(e[order].alias(order), s["x"].alias("x"), s["p"].alias("p")))).alias("out")),
            F.when(acc["f"].isNull(), own).otherwise(corrected_back),
        )

    none = F.lit(None)
    begin = F.struct(none.cast("array<double>").alias("x"), none.cast(MATRIX).alias("p"), none.cast(MATRIX).alias("f"), none.cast(MATRIX).alias("q"), F.array().cast(kept).alias("out"))
    folded = F.aggregate(F.reverse("steps"), begin, back, lambda acc: acc["out"])
    return steps.select(*keys, F.explode(folded).alias("e")).select(*keys, "e.*")


#: Rows of whole keys that a task filters and smooths together.
_AT_ONCE = 1 << 14


def smoothed_means(rows: DataFrame, keys: list[str], order: str, n: int, m: int) -> DataFrame:
    """keys, order, x: what :func:`smoothed` makes of :func:`filtered` with a measurement at every
    step, for ``rows`` that are already dealt to the tasks by their keys. A task works through
    its keys in order, many at a time: step k of all of them is one product of stacked matrices.
    It holds ``_AT_ONCE`` rows and the rows of one key."""
    parts = ("z", "f", "q", "h", "r", "x0", "p0")
    shapes = {"z": (m, 1), "f": (n, n), "q": (n, n), "h": (m, n), "r": (m, m), "x0": (n, 1), "p0": (n, n)}
    schema = T.StructType([*[rows.schema[c] for c in (*keys, order)], T.StructField("x", T.ArrayType(T.DoubleType()))])
    types = to_arrow_schema(schema)

    def solved(t: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
        size = np.diff(np.append(begin, len(t)))
        cells = {}
        for c in parts:
            col = t.column(c).combine_chunks()
            while pa.types.is_list(col.type):
                col = col.flatten()
            cells[c] = col.to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shapes[c])
        z, f, q, h, r = (cells[c] for c in parts[:5])
        turn = lambda a: a.transpose(0, 2, 1)
        longest = np.argsort(-size, kind="stable")
        begin, size = begin[longest], size[longest]
        running = [int(np.searchsorted(-size, -k, side="left")) for k in range(int(size[0]) + 1)]  # keys with more than k steps
        x, p, before = np.zeros((len(t), n, 1)), np.zeros((len(t), n, n)), np.zeros((len(t), n, n))
        now_x, now_p, one = cells["x0"][begin], cells["p0"][begin], np.eye(n)
        for k in range(int(size[0])):
            at = begin[: running[k]] + k
            fk, hk = f[at], h[at]
            now_x, now_p = fk @ now_x[: len(at)], fk @ now_p[: len(at)] @ turn(fk) + q[at]
            before[at] = now_p
            cross = now_p @ turn(hk)
            gain = cross @ np.linalg.inv(hk @ cross + r[at])
            keep = one - gain @ hk
            now_x = now_x + gain @ (z[at] - hk @ now_x)
            now_p = keep @ now_p @ turn(keep) + gain @ r[at] @ turn(gain)
            x[at], p[at] = now_x, now_p
        for k in range(int(size[0]) - 2, -1, -1):
            at = begin[: running[k + 1]] + k
            fk = f[at + 1]
            gain = p[at] @ turn(fk) @ np.linalg.inv(before[at + 1])
            x[at] += gain @ (x[at + 1] - fk @ x[at])
        means = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), n).cast(types.field("x").type)
        return pa.RecordBatch.from_arrays([*[t.column(c).combine_chunks() for c in (*keys, order)], means], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            ids = np.stack([t.column(c).to_numpy() for c in keys], 1)
            begin = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(1)]))
            end = len(t) if last else int(begin[-1])
            if end < len(t):
                held.extend(t.slice(end).to_batches())
            if end:
                yield solved(t.slice(0, end), begin[begin < end])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= _AT_ONCE:
                yield from whole(False)
        if held:
            yield from whole(True)

    return rows.select(*keys, order, *parts).sortWithinPartitions(*keys, order, "z").mapInArrow(run, schema)
