"""Box geometry as columns. A box is four columns ``x, y, w, h`` (top left, size); ``box("a_")``
names those with a prefix. Every function is made of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + c) for c in "xywh"))


def _intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a.right, b.right) - F.greatest(a.x, b.x))
    h = F.greatest(F.lit(0.0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))
    return w * h


def iou(a: Box, b: Box, metric: str = "origin") -> Column:
    """Overlap over union; null for two boxes without area. ``shape`` compares sizes only,
    ``position`` takes x, y as centres."""
    if metric == "shape":
        zero = F.lit(0.0)
        a, b = Box(zero, zero, a.w, a.h), Box(zero, zero, b.w, b.h)
    elif metric == "position":
        a, b = (Box(c.x - c.w / 2, c.y - c.h / 2, c.w, c.h) for c in (a, b))
    both = _intersection(a, b)
    return F.try_divide(both, a.area + b.area - both)


def signed_iou(a: Box, b: Box) -> Column:
    """IoU of boxes that overlap, 0 for touching ones, and minus the empty part of their hull
    relative to their areas for disjoint ones."""
    dx = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    dy = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    hull = (F.greatest(a.right, b.right) - F.least(a.x, b.x)) * (F.greatest(a.bottom, b.bottom) - F.least(a.y, b.y))
    total = a.area + b.area
    apart = -F.try_divide(hull - total, total)
    return F.when((dx < 0) | (dy < 0), apart).otherwise(F.try_divide(dx * dy, total - dx * dy))


def in_block(track: Box, det: Box, width: Column, height: Column) -> Column:
    """Whether a detection meets the region of a size around a track's centre with some area."""
    cx, cy = track.x + track.w / 2, track.y + track.h / 2
    x = (det.x < cx + width / 2) & (det.right > cx - width / 2)
    y = (det.y < cy + height / 2) & (det.bottom > cy - height / 2)
    return x & y & (width * height > 0) & (det.area > 0)


def too_far(a: Box, b: Box) -> Column:
    """Whether corners are farther apart than the largest side of both boxes."""
    return F.greatest(F.abs(a.x - b.x), F.abs(a.y - b.y)) > F.greatest(a.w, a.h, b.w, b.h)


def to_state(b: Box) -> list[Column]:
    """Centre (by pixel indices), aspect and height."""
    return [(b.x + b.w / 2 - 1).alias("cx"), (b.y + b.h / 2 - 1).alias("cy"), F.try_divide(b.w, b.h).alias("a"), b.h.alias("hh")]


def to_box(cx: Column, cy: Column, a: Column, h: Column) -> list[Column]:
    w = a * h
    return [(cx - w / 2 + 1).cast("int").alias("x"), (cy - h / 2 + 1).cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h")]


def warp_point(x: Column, y: Column, warp: list[list[float]], scale: float = 1.0, divide: bool = False) -> tuple[Column, Column]:
    """A point under a 2x3 or 3x3 warp, cut to integers; ``scale`` divides the translation."""
    row = lambda r, t: F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2]) / t)
    u, v = row(warp[0], scale), row(warp[1], scale)
    if divide and len(warp) == 3:
        d = row(warp[2], 1.0)
        u, v = F.try_divide(u, d), F.try_divide(v, d)
    return u.cast("int"), v.cast("int")


def warp_box(b: Box, warp: list[list[float]]) -> list[Column]:
    """A box whose two corners are moved by a warp."""
    x1, y1 = warp_point(b.x, b.y, warp)
    x2, y2 = warp_point(b.x + b.w - 1, b.y + b.h - 1, warp)
    return [x1.alias("wx"), y1.alias("wy"), (x2 - x1 + 1).alias("ww"), (y2 - y1 + 1).alias("wh")]


def epipolar_corner(b: Box, fundamental: list[list[float]]) -> list[Column]:
    """Least-squares top-left corner of a box of the same size whose four corners lie on the
    epipolar lines of the corners; null where the lines do not fix it."""
    lines, f = [], fundamental
    for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):
        px, py = (b.x + b.w if dx else b.x), (b.y + b.h if dy else b.y)
        # line l = F p, and l . (u + dx w, v + dy h, 1) = 0
        a, c, e = (F.lit(float(f[k][0])) * px + F.lit(float(f[k][1])) * py + F.lit(float(f[k][2])) for k in range(3))
        lines.append((a, c, -(a * (b.w if dx else F.lit(0.0)) + c * (b.h if dy else F.lit(0.0)) + e)))
    dot = lambda i, k: sum((row[i] * row[k] for row in lines[1:]), lines[0][i] * lines[0][k])
    aa, ac, cc, ar, cr = dot(0, 0), dot(0, 1), dot(1, 1), dot(0, 2), dot(1, 2)
    det = aa * cc - ac * ac
    return [F.try_divide(cc * ar - ac * cr, det).cast("int").alias("ex"), F.try_divide(aa * cr - ac * ar, det).cast("int").alias("ey")]


def percent(b: Box, width: float, height: float) -> list[Column]:
    return [(b.x / width).alias("px1"), (b.y / height).alias("py1"), (b.right / width).alias("px2"), (b.bottom / height).alias("py2")]


def unit_centre(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """Centres of relative boxes on [-1, 1]."""
    return [(x1 + x2 - 1).alias("ux"), (y1 + y2 - 1).alias("uy")]


def track_colour(track_id: Column) -> list[Column]:
    """red, green, blue (0-255) of a track: hue from its id by steps of 0.41, and one of four
    brightnesses."""
    step = track_id * F.lit(0.41)
    hue = step - F.floor(step)
    value = F.lit(1.0) - (F.floor(step).cast("bigint") % 4) / F.lit(5.0)
    sector = F.floor(hue * 6).cast("int") % 6
    rest = hue * 6 - F.floor(hue * 6)
    up, down, none = value * rest, value * (1 - rest), F.lit(0.0)
    order = {"red": (value, down, none, none, up, value), "green": (up, value, value, down, none, none), "blue": (none, none, up, value, value, down)}
    out = []
    for name, by in order.items():
        c = by[5]
        for k in range(5):
            c = F.when(sector == k, by[k]).otherwise(c)
        out.append(F.floor(c * 255 + F.lit(1e-9)).cast("int").alias(name))
    return out


def tail_marker(b: Box) -> list[Column]:
    """The small rectangle at a box's foot: corners cut to integers."""
    mid, part = b.x + b.w / 2, b.w / 12
    return [(mid - part).cast("int").alias("left"), (b.bottom - part).cast("int").alias("top"), (mid + part).cast("int").alias("right"), (b.bottom + part).cast("int").alias("bottom")]
