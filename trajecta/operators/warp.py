"""Warps between frames from matched points: translation, Euclidean and affine, by least squares.

Everything a Gauss-Newton step needs of the points are sums of products, so the points are read
once: one grouped sum for each frame pair, then the steps are a fold over those sums inside the
JVM. (Translation and affine warps are linear, so their first step is the last.)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least number of points that determine a warp.
LEAST = {"translation": 1, "euclidean": 2, "affine": 3}


def _sums(matches: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Moments about the means, times the number of points (exact for whole numbers)."""
    x, y, u, v = (F.col(c) * F.lit(float(scale)) for c in ("ax", "ay", "bx", "by"))
    whole = {"x": x, "y": y, "u": u, "v": v, "xx": x * x, "xy": x * y, "yy": y * y, "xu": x * u, "yu": y * u, "xv": x * v, "yv": y * v}
    s = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{name}") for name, c in whole.items()])
    about = {a + b: F.col("n") * F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") for a, b in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")}
    return s.select(*keys, "n", *[(F.col(f"s{c}") / F.col("n")).alias(f"m{c}") for c in "xyuv"], *[c.alias(f"c{name}") for name, c in about.items()])


def _turned(steps: int) -> tuple[Column, Column, Column, Column]:
    """Rotation by Gauss-Newton on the angle, the translation eliminated."""
    size = F.nullif(F.col("cxx") + F.col("cyy"), F.lit(0.0))
    step = lambda t, _: t + (F.cos(t) * (F.col("cxv") - F.col("cyu")) - F.sin(t) * (F.col("cxu") + F.col("cyv"))) / size
    turn = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    return F.cos(turn), -F.sin(turn), F.sin(turn), F.cos(turn)


def _affine() -> tuple[Column, Column, Column, Column]:
    size = F.nullif(F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy"), F.lit(0.0))
    row = lambda c: ((F.col(f"cx{c}") * F.col("cyy") - F.col(f"cy{c}") * F.col("cxy")) / size, (F.col(f"cy{c}") * F.col("cxx") - F.col(f"cx{c}") * F.col("cxy")) / size)
    return (*row("u"), *row("v"))


def warps(matches: DataFrame, mode: str, keys: list[str], steps: int = 30, scale: float = 1.0) -> DataFrame:
    """matches(keys, ax, ay, bx, by) -> keys, n, w00, w01, w02, w10, w11, w12: the warp with the
    least sum of squares from the points a to the points b, for each key. ``scale`` shrinks the
    coordinates first, and the translation is given in the original ones. Null where the points
    do not determine it (too few, or all on one line or place)."""
    s = _sums(matches, keys, scale)
    one, zero = F.lit(1.0), F.lit(0.0)
    a, b, c, d = {"translation": lambda: (one, zero, zero, one), "euclidean": lambda: _turned(steps), "affine": _affine}[mode]()
    named = s.select(*keys, "n", *[F.when(F.col("n") >= LEAST[mode], x).alias(k) for k, x in (("w00", a), ("w01", b), ("w10", c), ("w11", d))], "mx", "my", "mu", "mv")
    move = lambda m, p, q: (F.col(m) - F.col(p) * F.col("mx") - F.col(q) * F.col("my")) / F.lit(float(scale))
    return named.select(*keys, "n", "w00", "w01", move("mu", "w00", "w01").alias("w02"), "w10", "w11", move("mv", "w10", "w11").alias("w12"))
