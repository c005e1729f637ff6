"""Box side of training transforms. Randomness comes from the row's keys and a seed, so a
row gets the same draw in any plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Odd factors of the columns and the prime of a draw (fixed values, the same in SQL).
FACTORS, PRIME = (73_856_093, 19_349_663, 83_492_791), 1_000_003


def whole_draw(seed: int, *keys: str | Column) -> Column:
    """An integer below the prime from integers: a sum of multiples, squared modulo the prime."""
    total = F.lit(seed * 2_654_435_761 % PRIME).cast("bigint")
    for k, factor in zip(keys, FACTORS, strict=False):
        total = total + (F.col(k) if isinstance(k, str) else k).cast("bigint") * F.lit(factor)
    mixed = F.pmod(total, F.lit(PRIME))
    return F.pmod(mixed * mixed + mixed * F.lit(7919), F.lit(PRIME))


def draw(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from integers."""
    return whole_draw(seed, *keys).cast("double") / F.lit(float(PRIME))


def move_boxes(df: DataFrame, low: float, high: float, width: float, height: float, seed: int = 26) -> DataFrame:
    """Shift each box by a fraction between ``low`` and ``high`` of its size, either way, inside
    the image. Columns x1, y1, x2, y2."""
    out = df
    for k, (a, b, top) in enumerate((("x1", "x2", width), ("y1", "y2", height))):
        far = low + (high - low) * draw(seed + 2 * k, "seq_id", "frame", "det_idx")
        way = F.when(draw(seed + 2 * k + 1, "seq_id", "frame", "det_idx") < 0.5, -1.0).otherwise(1.0)
        shift = far * way * (F.col(b) - F.col(a))
        out = out.withColumn("_s", shift).withColumn(a, F.greatest(F.lit(0.0), F.least(F.lit(top), F.col(a) + F.col("_s")))).withColumn(b, F.greatest(F.lit(0.0), F.least(F.lit(top), F.col(b) + F.col("_s")))).drop("_s")
    return out


def crop(df: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Boxes whose centre lies inside a window, clipped to it and relative to it."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = (cx > left) & (cx < right) & (cy > top) & (cy < bottom)
    clip = lambda c, lo, hi: (F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) - lo).alias(c)
    rest = [c for c in df.columns if c not in ("x1", "y1", "x2", "y2")]
    return df.where(inside).select(*rest, clip("x1", left, right), clip("y1", top, bottom), clip("x2", left, right), clip("y2", top, bottom))


def expand(df: DataFrame, left: float, top: float) -> DataFrame:
    """Boxes on a larger canvas that holds the image at (left, top)."""
    return df.withColumns({c: F.col(c) + (left if c[0] == "x" else top) for c in ("x1", "y1", "x2", "y2")})


def mirror(df: DataFrame, width: float) -> DataFrame:
    """Boxes of the mirrored image, with ordered corners."""
    return df.withColumns({"x1": F.lit(width) - F.col("x2"), "x2": F.lit(width) - F.col("x1")})


def subtract_means(vector: Column, means: list[float]) -> Column:
    return F.zip_with(vector, F.array(*[F.lit(float(m)) for m in means]), lambda x, m: x - m)


def step_rate(epoch: Column, base: float, steps: list[int], gamma: float) -> Column:
    """Learning rate that is multiplied by ``gamma`` from each step on."""
    passed = F.lit(0)
    for s in steps:
        passed = passed + F.when(epoch >= s, 1).otherwise(0)
    return F.lit(base) * F.pow(F.lit(gamma), passed)
