"""MOT text files, folders and sequence information as DataFrames, and the result sink."""

from __future__ import annotations

import os
import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _I = T.DoubleType(), T.IntegerType()
DETECTION_FILE = T.StructType([T.StructField(n, t) for n, t in [("frame", _D), ("id", _D), ("x", _D), ("y", _D), ("w", _D), ("h", _D), ("score", _D)]])
TRUTH_FILE = T.StructType([T.StructField(n, t) for n, t in [("frame", _D), ("id", _D), ("x", _D), ("y", _D), ("w", _D), ("h", _D), ("active", _D), ("class", _D), ("visibility", _D)]])


def _sequence(level: int) -> Column:
    """Name of the folder ``level`` above a file."""
    parts = F.split(F.input_file_name(), "/")
    return F.element_at(parts, F.lit(-level))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """``.../<sequence>/det/det.txt``: sequence, frame, x, y, w, h, score; positions in a file's
    frame (``det_idx``) follow the order of its lines."""
    rows = spark.read.schema(DETECTION_FILE).csv(path)
    place = [F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")]
    named = rows.select(_sequence(3).alias("sequence"), F.col("frame").cast("int").alias("frame"), "x", "y", "w", "h", "score", *place)
    order = Window.partitionBy("sequence", "frame").orderBy("_block", "_row")
    return named.withColumn("det_idx", F.row_number().over(order)).drop("_block", "_row")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(TRUTH_FILE).csv(path)
    return rows.select(_sequence(3).alias("sequence"), F.col("frame").cast("int").alias("frame"), F.col("id").cast("bigint").alias("obj_id"), "x", "y", "w", "h", F.col("active").cast("int").alias("active"), F.col("class").cast("int").alias("class"), F.col("visibility"))


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per ``seqinfo.ini``: sequence, name, width, height, length, frame_rate (30 where
    the file has none)."""
    of = lambda key: F.trim(F.regexp_extract("value", rf"(?im)^[ \t]*{key}[ \t]*=([^\r\n]*)", 1))
    number = lambda key: of(key).try_cast("int")
    files = spark.read.text(paths, wholetext=True)
    return files.select(_sequence(2).alias("sequence"), of("name").alias("name"), number("imWidth").alias("width"), number("imHeight").alias("height"), number("seqLength").alias("length"), F.coalesce(number("frameRate"), F.lit(30)).alias("frame_rate"))


def image_path(frame: Column, suffix: str = ".jpg") -> Column:
    return F.format_string("%06d" + suffix, frame)


def list_images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("jpg", "png", "bmp")) -> DataFrame:
    """Image files below a folder, without their bytes (nothing but the listing is read)."""
    glob = "*.{" + ",".join(suffixes) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def scan_files(spark: SparkSession, folder: str, suffix: str | tuple[str, ...] = "", without: tuple[str, ...] = (), recursive: bool = False) -> DataFrame:
    """Paths relative to ``folder``, in any store that Spark reads, with a suffix and without any
    of the strings in ``without``; names that begin with a dot are left out. No bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length")
    base = folder.rstrip("/").split(":", 1)[-1].replace("//", "/").rstrip("/")
    found = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("file", F.substring_index("path", base + "/", -1))
    ends = F.lit(False)
    for x in (suffix,) if isinstance(suffix, str) else suffix:
        ends = ends | F.col("file").endswith(x)
    for x in without:
        ends = ends & ~F.col("file").contains(x)
    return found.where(ends & ~F.col("name").startswith(".")).select("file", "length")


def folder_information(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("jpg", "png", "bmp")) -> dict:
    """name, length, width and height of a sequence without ``seqinfo.ini``, from its images: the
    name of the folder (of the one above, where it is ``img1``), their number, and the size that
    the first one's header states."""
    files = list_images(spark, folder, suffixes)
    first = files.agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).first()
    parts = folder.rstrip("/").split("/")
    out = {"name": parts[-2] if parts[-1] == "img1" and len(parts) > 1 else parts[-1], "length": first["n"], "width": None, "height": None}
    if first["path"]:
        head = spark.read.format("binaryFile").load(first["path"]).select(F.expr("substring(content, 1, 1048576)").alias("head")).first()["head"]
        out["width"], out["height"] = image_size(bytes(head))
    return out


def image_size(head: bytes) -> tuple[int | None, int | None]:
    """Width and height from the header of a PNG, BMP or JPEG file."""
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", head[16:24])
    if head[:2] == b"BM":
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    at = 2
    while head[:2] == b"\xff\xd8" and at + 9 < len(head):
        kind, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
            h, w = struct.unpack(">HH", head[at + 5 : at + 9])
            return w, h
        at += 2 + size
    return None, None


def write_results(tracks: DataFrame, path: str) -> None:
    """``frame, id, x, y, w, h, -1, -1, -1, -1`` as integers, a folder for each sequence."""
    result_rows(tracks).write.partitionBy("seq_id").mode("errorifexists").csv(path)


def result_rows(tracks: DataFrame, id_column: str = "track_id") -> DataFrame:
    ints = [F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")]
    return tracks.select("seq_id", "frame", F.col(id_column).cast("int").alias("id"), *ints, *[F.lit(-1).alias(c) for c in ("c7", "c8", "c9", "c10")])


# ---- filters and catalogues -----------------------------------------------------------


def filter_ground_truth(gt: DataFrame, length: int, visible: float | None = None) -> DataFrame:
    """Active rows of class 1 or -1 up to ``length``. With a threshold, and if any row of the
    sequence states a visibility, rows must reach it."""
    rows = gt.where((F.col("frame") <= length) & (F.col("active") == 1) & F.col("class").isin(1, -1))
    if visible is None:
        return rows
    states = F.max(F.col("visibility") >= 0).over(Window.partitionBy("seq_id"))
    return rows.withColumn("_s", states).where(~F.col("_s") | (F.col("visibility") >= visible)).drop("_s")


def filter_detections(det: DataFrame, length: int, threshold: float = 0.0) -> DataFrame:
    """Scores at or above the threshold up to ``length``; boxes cut to integers."""
    boxes = [F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")]
    return det.where((F.col("frame") <= length) & (F.col("score") >= threshold)).select("seq_id", "frame", "det_idx", *boxes, "score")


def frame_lists(det: DataFrame, length: int) -> DataFrame:
    """Every frame from 1 on, those without detections too, with its number of boxes and the
    positions of its detections in order."""
    frames = det.select("seq_id").distinct().select("seq_id", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("frame"))
    lists = det.groupBy("seq_id", "frame").agg(F.sort_array(F.collect_list("det_idx")).alias("ids"))
    return frames.join(lists, ["seq_id", "frame"], "left").select("seq_id", "frame", F.coalesce(F.size("ids"), F.lit(0)).alias("n_boxes"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("det_ids"))


def next_frames(gt: DataFrame, visible: float) -> DataFrame:
    """Training boxes (visibility above, not at, the least) as corners with the frame in which
    their object is seen next, or -1."""
    rows = gt.where((F.col("active") == 1) & (F.col("visibility") > visible))
    nxt = F.lead("frame").over(Window.partitionBy("seq_id", "obj_id").orderBy("frame"))
    return rows.select("seq_id", "obj_id", "frame", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.coalesce(nxt, F.lit(-1)).alias("next_frame"))


def split_sequences(names: DataFrame, detector: str, valid: list[str], training: bool) -> DataFrame:
    """Sequences of a detector; those that contain a validation name are left out in training
    and are the only ones otherwise."""
    held = F.lit(False)
    for v in valid:
        held = held | F.col("name").contains(v)
    return names.where(F.col("name").contains(detector)).where(~held if training else held)


def global_items(lengths: DataFrame) -> DataFrame:
    """item -> name and frame (from 1) for every global item, counted over all sequences."""
    ranges = global_index(lengths).where("length > 0")
    items = ranges.select("name", "first_item", F.explode(F.sequence(F.col("first_item"), F.col("end_item") - 1)).alias("item"))
    return items.select("item", "name", (F.col("item") - F.col("first_item") + 1).alias("frame"))


def sampled_pairs(boxes: DataFrame, least: int, most: int, seed: int = 26) -> DataFrame:
    """``next_frames`` -> a training pair for each frame with a box that is seen again: with even
    odds the farthest of its boxes' next frames, else any of them and from there a frame that
    exists, ``least`` to ``most`` frames on. Draws are integers from the keys."""
    frames = boxes.select("seq_id", "frame").distinct()
    own = boxes.where("next_frame > 0").groupBy("seq_id", "frame").agg(F.sort_array(F.collect_list("next_frame")).alias("after"))
    number = lambda k: F.pmod(F.col("seq_id") * 31 * k + F.col("frame") * 17 * (k + 2) + seed * k, F.lit(10_007))
    pick = F.element_at("after", (F.pmod(number(3), F.size("after")) + 1).cast("int"))
    own = own.select("seq_id", "frame", F.array_max("after").alias("farthest"), (number(1) % 2 == 0).alias("far"), F.size("after").alias("n"), pick.alias("pick"))
    steps = F.explode(F.sequence(F.col("pick") + least, F.col("pick") + most)).alias("at")
    there = own.select("seq_id", "frame", steps).join(frames.select("seq_id", F.col("frame").alias("at")), ["seq_id", "at"])
    choice = there.groupBy("seq_id", "frame").agg(F.sort_array(F.collect_list("at")).alias("open"))
    some = F.element_at("open", (F.pmod(number(5), F.size("open")) + 1).cast("int"))
    got = own.join(choice, ["seq_id", "frame"], "left")
    return got.select("seq_id", "frame", F.when(F.col("far") | (F.col("n") == 1), F.col("farthest")).otherwise(F.coalesce(some, F.col("pick"))).alias("next_frame"))


def global_index(lengths: DataFrame) -> DataFrame:
    """name, length -> the half-open range of global items of each sequence."""
    total = F.sum("length").over(Window.orderBy("name"))  # one row per sequence
    return lengths.select("name", "length", (total - F.col("length")).alias("first_item"), total.alias("end_item"))


# ---- normalisation of numeric arrays --------------------------------------------------


def normalised(vector: Column, kind: str) -> Column:
    """minmax, l1, l2, meanstd or default (1/255) of an array of numbers; where the divisor is
    zero, null elements."""
    v = F.transform(vector, lambda x: x.cast("double"))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    bound = lambda body: F.get(F.transform(F.array(v), body), F.lit(0))
    scale = lambda a, low, by: F.get(F.transform(F.array(F.struct(low.alias("low"), by.alias("by"))), lambda s: F.transform(a, lambda x: F.try_divide(x - s["low"], s["by"]))), F.lit(0))
    zero = F.lit(0.0)
    if kind == "minmax":
        return bound(lambda a: scale(a, F.array_min(a), F.array_max(a) - F.array_min(a)))
    if kind == "l1":
        return bound(lambda a: scale(a, zero, total(a, F.abs)))
    if kind == "l2":
        return bound(lambda a: scale(a, zero, F.sqrt(total(a, lambda x: x * x))))
    if kind == "meanstd":
        n = lambda a: F.size(a).cast("double")
        mean = lambda a: F.try_divide(total(a, lambda x: x), n(a))
        var = lambda a: F.try_divide(total(a, lambda x: x * x), n(a)) - mean(a) * mean(a)
        return bound(lambda a: scale(a, mean(a), F.sqrt(F.greatest(var(a), zero))))
    return F.transform(v, lambda x: x / F.lit(255.0))


def check_paths(folder: str, *files: str) -> None:
    """Raise FileNotFoundError for a local folder or file that is not there."""
    for p in (folder, *files):
        if not os.path.exists(p):
            raise FileNotFoundError(p)
