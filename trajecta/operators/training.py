"""Training samples: two frames' boxes, changed by one chain of drawn steps, in shuffled slots.

A sample is one row (seq_id, frame, next_frame) that holds the boxes of both frames as arrays, so
after the two joins that make it every step is an expression on that row: nothing is shuffled
again. All draws come from one seed and the row's keys; a lost task draws the same again.

Steps, each a function of a frame of samples: ``moved``, ``expanded``, ``cropped``, ``mirrored``,
``relative``; :func:`chain` makes the pipelines of training, validation and test of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.operators.transforms import draw, whole_draw

Step = Callable[[DataFrame], DataFrame]
CORNERS = ("x1", "y1", "x2", "y2")
SIDES = ("pre", "next")
#: Number of crop modes, of which the first keeps the whole image (fixed values).
MODES, ABSENT = 6, 1.5


def samples(pairs: DataFrame, boxes: DataFrame, width: float, height: float) -> DataFrame:
    """pairs(seq_id, frame, next_frame) and boxes(seq_id, frame, obj_id, x1, y1, x2, y2) -> samples
    with pre, next, width and height. Boxes are in order of obj_id, then corners; repeated boxes
    stay; a pair whose frames have no boxes has empty arrays."""
    box = F.struct(F.col("obj_id").cast("bigint").alias("obj_id"), *[F.col(c).cast("double").alias(c) for c in CORNERS])
    lists = boxes.groupBy("seq_id", "frame").agg(F.sort_array(F.collect_list(box)).alias("b"))
    none = F.array().cast(dict(lists.dtypes)["b"])
    out = pairs.select("seq_id", "frame", "next_frame").join(lists.withColumnRenamed("b", "pre"), ["seq_id", "frame"], "left")
    out = out.join(lists.select("seq_id", F.col("frame").alias("next_frame"), F.col("b").alias("next")), ["seq_id", "next_frame"], "left")
    return out.select("seq_id", "frame", "next_frame", *[F.coalesce(s, none).alias(s) for s in SIDES], F.lit(float(width)).alias("width"), F.lit(float(height)).alias("height"))


def _each(df: DataFrame, change: Callable[[Column], list[Column]]) -> DataFrame:
    """Both sides with changed corners."""
    of = lambda b: F.struct(b["obj_id"].alias("obj_id"), *[c.alias(n) for c, n in zip(change(b), CORNERS, strict=True)])
    return df.withColumns({s: F.transform(s, of) for s in SIDES})


def moved(low: float, high: float, seed: int) -> Step:
    """Each box by a fraction between low and high of its size, either way, inside the image."""

    def change(first: int) -> Callable[[Column], Column]:
        def one(b: Column) -> Column:
            out = {}
            for d, (lo, hi, top) in enumerate((("x1", "x2", "width"), ("y1", "y2", "height"))):
                keys = "seq_id", "frame", b["obj_id"]
                way = F.when(draw(first + 2 * d + 1, *keys) < 0.5, -1.0).otherwise(1.0)
                shift = (low + (high - low) * draw(first + 2 * d, *keys)) * way * (b[hi] - b[lo])
                for c in (lo, hi):
                    out[c] = F.greatest(F.lit(0.0), F.least(F.col(top), b[c] + shift))
            return F.struct(b["obj_id"].alias("obj_id"), *[out[c].alias(c) for c in CORNERS])

        return one

    return lambda df: df.withColumns({s: F.transform(s, change(seed + 10 * k)) for k, s in enumerate(SIDES)})


def expanded(most: float, seed: int) -> Step:
    """For half of the samples a canvas 1 to ``most`` times as large, the image anywhere on it, in
    whole pixels."""

    def step(df: DataFrame) -> DataFrame:
        keys = "seq_id", "frame"
        ratio = F.when(draw(seed, *keys) < 0.5, 1.0).otherwise(1.0 + (most - 1.0) * draw(seed + 1, *keys))
        df = df.withColumn("_r", ratio)
        df = df.withColumn("_l", F.floor(draw(seed + 2, *keys) * (F.col("width") * F.col("_r") - F.col("width"))).cast("double"))
        df = df.withColumn("_t", F.floor(draw(seed + 3, *keys) * (F.col("height") * F.col("_r") - F.col("height"))).cast("double"))
        df = _each(df, lambda b: [b["x1"] + F.col("_l"), b["y1"] + F.col("_t"), b["x2"] + F.col("_l"), b["y2"] + F.col("_t")])
        return df.withColumns({c: F.floor(F.col(c) * F.col("_r")).cast("double") for c in ("width", "height")}).drop("_r", "_l", "_t")

    return step


def cropped(seed: int, tries: int = 50, rounds: int = 8) -> Step:
    """A window of 0.8 to 1 of each side with an aspect in [0.5, 2] that holds the centre of a box
    of each frame: the first of ``tries`` seeded attempts that does. A round whose mode is the whole
    image keeps it, boxes as they are; a round without an accepted window is followed by another.
    After the last the whole image stays (so it does for a frame without boxes)."""

    def step(df: DataFrame) -> DataFrame:
        keys = "seq_id", "frame"

        def window(t: Column) -> Column:
            w, h = ((F.lit(0.8) + F.lit(0.2) * draw(seed + 1 + k, *keys, t)) * F.col(c) for k, c in enumerate(("width", "height")))
            left, top = draw(seed + 3, *keys, t) * (F.col("width") - w), draw(seed + 4, *keys, t) * (F.col("height") - h)
            cells = {"left": F.floor(left), "top": F.floor(top), "right": F.floor(left + w), "bottom": F.floor(top + h), "aspect": h / w}
            return F.struct(*[c.cast("double").alias(n) for n, c in cells.items()])

        whole = lambda t: F.floor(draw(seed, *keys, F.floor(t / tries)) * MODES) == 0
        inside = lambda b, v: ((b["x1"] + b["x2"]) / 2 > v["left"]) & ((b["x1"] + b["x2"]) / 2 < v["right"]) & ((b["y1"] + b["y2"]) / 2 > v["top"]) & ((b["y1"] + b["y2"]) / 2 < v["bottom"])
        fits = lambda v: (v["aspect"] >= 0.5) & (v["aspect"] <= 2) & F.exists("pre", lambda b: inside(b, v)) & F.exists("next", lambda b: inside(b, v))
        taken = lambda t: whole(t) | F.exists(F.array(window(t)), fits)

        # later attempts are only looked at where the earlier ones fail
        ends = [0, min(4, tries), tries, *([tries * rounds] if rounds > 1 else [])]
        first = F.coalesce(*[F.array_min(F.filter(F.sequence(F.lit(a), F.lit(b - 1)), taken)) for a, b in zip(ends, ends[1:], strict=False) if b > a])
        df = df.withColumn("_t", first).withColumn("_v", F.when(F.col("_t").isNotNull() & ~whole(F.col("_t")), window(F.col("_t"))))
        v = F.col("_v")

        def change(b: Column) -> Column:
            clip = lambda c, lo, hi: (F.least(F.greatest(b[c], v[lo]), v[hi]) - v[lo]).alias(c)
            return F.struct(b["obj_id"].alias("obj_id"), clip("x1", "left", "right"), clip("y1", "top", "bottom"), clip("x2", "left", "right"), clip("y2", "top", "bottom"))

        sides = {s: F.when(v.isNull(), F.col(s)).otherwise(F.transform(F.filter(s, lambda b: inside(b, v)), change)) for s in SIDES}
        sizes = {"width": F.coalesce(v["right"] - v["left"], "width"), "height": F.coalesce(v["bottom"] - v["top"], "height")}
        return df.withColumns(sides | sizes).drop("_t", "_v")

    return step


def mirrored(seed: int) -> Step:
    """Half of the samples mirrored, with ordered corners."""

    def step(df: DataFrame) -> DataFrame:
        turn = draw(seed, "seq_id", "frame") < 0.5
        at = lambda c, other, b: F.when(turn, F.col("width") - b[other]).otherwise(b[c])
        return _each(df, lambda b: [at("x1", "x2", b), b["y1"], at("x2", "x1", b), b["y2"]])

    return step


def relative(df: DataFrame) -> DataFrame:
    """Corners as shares of the image."""
    return _each(df, lambda b: [b["x1"] / F.col("width"), b["y1"] / F.col("height"), b["x2"] / F.col("width"), b["y2"] / F.col("height")])


def chain(kind: str, low: float = 0.0, high: float = 0.2, most: float = 1.2, seed: int = 26) -> Step:
    """The steps of ``train``; of ``valid`` and ``test``, which draw nothing."""
    drawn = [moved(low, high, seed), expanded(most, seed + 30), cropped(seed + 40), mirrored(seed + 50)] if kind == "train" else []

    def step(df: DataFrame) -> DataFrame:
        for s in (*drawn, relative):
            df = df.transform(s)
        return df

    return step


# ---- slots ------------------------------------------------------------------------------


def slotted(df: DataFrame, slots: int, seed: int, grow: bool = True) -> DataFrame:
    """``pre`` and ``next`` padded to ``slots`` places (null: no box) and shuffled. A sample with
    more boxes than places has as many places as boxes; without ``grow`` there are ``slots``
    places, and the first boxes (in order of obj_id) get one."""
    n = F.greatest(F.lit(slots), F.size("pre"), F.size("next")) if grow else F.lit(slots)

    def shuffled(k: int, side: str) -> Column:
        at = F.sequence(F.lit(0), n - 1)
        keyed = F.transform(at, lambda i: F.struct(whole_draw(seed + k, "seq_id", "frame", i).alias("d"), i.alias("i")))
        return F.transform(F.sort_array(keyed), lambda e: F.get(F.col(side), e["i"]))

    return df.withColumns({s: shuffled(k, s) for k, s in enumerate(SIDES)})


def slot_rows(df: DataFrame) -> DataFrame:
    """A row for each place: seq_id, frame, side, slot, obj_id, present (the mask), and the centre
    in [-1, 1], or 1.5 where there is no box."""
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("b")) for s in SIDES]))
    out = df.select("seq_id", "frame", both.alias("e")).select("seq_id", "frame", "e.side", F.posexplode("e.b").alias("slot", "box"))
    centre = lambda a, b: F.coalesce(F.col(f"box.{a}") + F.col(f"box.{b}") - 1, F.lit(ABSENT))
    return out.select("seq_id", "frame", "side", "slot", "box.obj_id", F.col("box").isNotNull().cast("int").alias("present"), centre("x1", "x2").alias("cx"), centre("y1", "y2").alias("cy"))


def label_rows(df: DataFrame) -> DataFrame:
    """The ones of the label matrix with its additional row and column: seq_id, frame, row, col. An
    object of one frame that the other does not have is in the additional column or row."""
    ids = {s: F.transform(s, lambda b: b["obj_id"]) for s in SIDES}
    at = F.sequence(F.lit(0), F.size("pre") - 1)
    here = F.filter(F.transform(at, lambda i: F.struct(i.alias("row"), F.get(F.col("_pre"), i).alias("id"))), lambda e: e["id"].isNotNull())

    def met(e: Column) -> Column:
        same = F.filter(at, lambda j: F.get(F.col("_next"), j) == e["id"])
        cols = F.when(F.size(same) > 0, same).otherwise(F.array(F.size("pre")))
        return F.transform(cols, lambda j: F.struct(e["row"].alias("row"), j.alias("col")))

    other = lambda j: F.get(F.col("_next"), j)
    new = F.filter(at, lambda j: other(j).isNotNull() & ~F.exists("_pre", lambda x: x.eqNullSafe(other(j))))
    ones = F.concat(F.flatten(F.transform(here, met)), F.transform(new, lambda j: F.struct(F.size("pre").alias("row"), j.alias("col"))))
    return df.withColumns({f"_{s}": c for s, c in ids.items()}).select("seq_id", "frame", F.explode(ones).alias("e")).select("seq_id", "frame", "e.row", "e.col")


# ---- samples that have nothing to learn from ----------------------------------------------


def redrawn(items: DataFrame, filled: DataFrame, gap: int, tries: int = 20, seed: int = 26) -> DataFrame:
    """items(item) and filled(item) -> item and the item that stands for it: itself if it is filled,
    else the first of ``tries`` draws of up to ``gap`` away, either way, that is; beyond these, the
    nearest filled one within the gap (the smaller of two). Items without any in reach are left
    out, as drawing on would never end."""
    has = filled.select("item").distinct()
    own = items.select("item").distinct()
    empty = own.join(has, "item", "left_anti")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: F.struct(t.alias("rank"), (F.pmod(whole_draw(seed, "item", t), F.lit(2 * gap + 1)) - gap).alias("by")))
    near = F.transform(F.sequence(F.lit(1), F.lit(2 * gap)), lambda k: F.struct((k + tries).alias("rank"), F.when(k % 2 == 1, -F.floor((k + 1) / 2)).otherwise(F.floor(k / 2)).alias("by")))
    ways = empty.select("item", F.inline(F.concat(drawn, near))).select(F.col("item").alias("_item"), "rank", (F.col("item") + F.col("by")).alias("item"))
    found = ways.join(has, "item").groupBy("_item").agg(F.min_by("item", "rank").alias("taken"))
    return own.join(has, "item", "left_semi").select("item", F.col("item").alias("taken")).unionByName(found.select(F.col("_item").alias("item"), "taken"))
