"""Detections in ``.npy`` files as a Spark data source (``format("mot_npy")``).

A file ``.../<sequence>/<name>.npy`` is a matrix with a row for each detection: frame, id, x, y, w,
h, score, three unused columns, then the feature, whose length is the number of columns less ten.

Reading: a file is cut into tasks by its size; each task reads the header and then only its own
rows' bytes, a block at a time, from any store that pyarrow's file systems know. Conditions on
``sequence`` choose files before anything is opened; conditions on ``frame`` choose rows before
they become Spark rows. Without features (option ``features`` = "false") the column is null and
its bytes are read but not converted. C and Fortran order, any integer or floating type.

Defined results: a file without rows gives none; a matrix of fewer than ten columns, of another
number of dimensions or of Python objects is an error that names the file; a frame or id that is
not a whole number is cut; NaN and infinite values come as they are; more than one file of a
sequence are read one after another, ``row`` counts within each (``file``)."""

from __future__ import annotations

import ast
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

FIXED = 10  # columns before the feature (fixed value of the layout)
SCHEMA = "sequence string, file string, row long, frame int, id long, x double, y double, w double, h double, score double, feature array<double>"
SPLIT = 64 << 20
BLOCK = 4 << 20
MOST_ROWS = 200_000


def _store(path: str):
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(f, path: str) -> tuple[int, tuple[int, int], np.dtype, bool]:
    """Where the values begin, the shape, the type and whether columns are contiguous."""
    magic = f.read(8)
    if magic[:6] != b"\x93NUMPY" or len(magic) < 8:
        raise ValueError(f"{path} is not an .npy file")
    wide = magic[6] >= 2
    (size,) = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))
    told = ast.literal_eval(f.read(size).decode("utf-8" if magic[6] >= 3 else "latin1"))
    kind, shape = np.dtype(told["descr"]), tuple(told["shape"])
    if kind.kind not in "iuf" or len(shape) != 2 or shape[1] < FIXED:
        raise ValueError(f"{path}: wanted numbers in rows of {FIXED} or more columns, not {kind} {shape}")
    return 8 + (4 if wide else 2) + size, shape, kind, told["fortran_order"]


def _blocks(f, path: str, part: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first row, rows) of one of ``parts`` equal shares of a file."""
    start, (n, wide), kind, turned = _header(f, path)
    first, end = n * part // parts, n * (part + 1) // parts
    step = max(1, BLOCK // (wide * kind.itemsize))
    for at in range(first, end, step):
        count = min(step, end - at)
        if turned:
            cols = []
            for c in range(wide):
                f.seek(start + (c * n + at) * kind.itemsize)
                cols.append(np.frombuffer(f.read(count * kind.itemsize), kind))
            yield at, np.stack(cols, 1)
        else:
            f.seek(start + at * wide * kind.itemsize)
            yield at, np.frombuffer(f.read(count * wide * kind.itemsize), kind).reshape(count, wide)


@dataclass
class Share(D.InputPartition):
    path: str
    sequence: str
    part: int
    parts: int


class NpyReader(D.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.features = str(options.get("features", "true")).lower() != "false"
        self.split = int(options.get("splitbytes", SPLIT))
        self.sequences: set[str] | None = None
        self.low, self.high = -np.inf, np.inf

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Narrows what is read; every condition goes back to Spark, which applies it again."""
        for f in filters:
            at, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if at == ("sequence",) and isinstance(f, (D.EqualTo, D.EqualNullSafe, D.In)) and value is not None:
                some = {v for v in value if v is not None} if isinstance(f, D.In) else {value}
                self.sequences = some if self.sequences is None else self.sequences & some
            elif at == ("frame",) and value is not None:
                if isinstance(f, (D.EqualTo, D.EqualNullSafe, D.GreaterThan, D.GreaterThanOrEqual)):
                    self.low = max(self.low, value)
                if isinstance(f, (D.EqualTo, D.EqualNullSafe, D.LessThan, D.LessThanOrEqual)):
                    self.high = min(self.high, value)
            yield f

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        store, base = _store(self.path)
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        prefix = self.path[: len(self.path) - len(base)] if self.path.endswith(base) else self.path.split("://")[0] + "://"
        out = []
        for f in sorted(found, key=lambda f: f.path):
            hidden = any(p.startswith(("_", ".")) for p in f.path[len(base) :].split("/"))
            sequence = f.path.rsplit("/", 2)[-2] if "/" in f.path else ""
            if f.type == fs.FileType.File and f.path.endswith(".npy") and not hidden and (self.sequences is None or sequence in self.sequences):
                parts = max(1, -(-f.size // self.split))
                out += [Share(prefix + f.path, sequence, k, parts) for k in range(parts)]
        return out

    def read(self, share: Share) -> Iterator[tuple]:
        if share is None:  # a plan without files has one empty task
            return
        store, path = _store(share.path)
        name = path.rsplit("/", 1)[-1]
        with store.open_input_file(path) as f:
            for at, rows in _blocks(f, share.path, share.part, share.parts):
                frames = rows[:, 0].astype(np.int64)
                for k in np.flatnonzero((frames >= self.low) & (frames <= self.high)).tolist():
                    r = rows[k]
                    feature = r[FIXED:].astype(float).tolist() if self.features else None
                    yield (share.sequence, name, at + k, int(frames[k]), int(r[1]), *(float(v) for v in r[2:7]), feature)


@dataclass
class Files(D.WriterCommitMessage):
    """Finished files of a task: (where they wait, where they go)."""

    moves: list[tuple[str, str]]


class NpyWriter(D.DataSourceWriter):
    """A file for each sequence that a task holds, of ``MOST_ROWS`` rows at most; files become
    visible when the whole job is done, so a repeated task leaves nothing twice."""

    def __init__(self, options: dict, schema) -> None:
        self.path, self.names = options["path"].rstrip("/"), schema.names
        missing = {"sequence", "frame", "x", "y", "w", "h", "score", "feature"} - set(self.names)
        if missing:
            raise ValueError(f"to write detections, columns are missing: {sorted(missing)}")
        self.most = int(options.get("mostrows", MOST_ROWS))

    def write(self, iterator: Iterator) -> Files:
        store, base = _store(self.path)
        moves: list[tuple[str, str]] = []

        def flush(sequence: str, rows: list[tuple]) -> None:
            name = f"part-{uuid.uuid4().hex}.npy"
            store.create_dir(f"{base}/_pending", recursive=True)
            with store.open_output_stream(f"{base}/_pending/{name}") as f:
                np.lib.format.write_array(f, np.array(rows, float), allow_pickle=False)
            moves.append((f"{base}/_pending/{name}", f"{base}/{sequence}/{name}"))

        now, rows = None, []
        for row in iterator:
            r = dict(zip(self.names, row, strict=True))
            if rows and (r["sequence"] != now or len(rows) == self.most or len(r["feature"] or []) != len(rows[0]) - FIXED):
                flush(now, rows)
                rows = []
            now = r["sequence"]
            rows.append((r["frame"], -1 if r.get("id") is None else r["id"], r["x"], r["y"], r["w"], r["h"], r["score"], -1, -1, -1, *(r["feature"] or [])))
        if rows:
            flush(now, rows)
        return Files(moves)

    def commit(self, messages: list[Files | None]) -> None:
        store, base = _store(self.path)
        for m in messages:
            for waits, goes in m.moves if m else ():
                store.create_dir(goes.rsplit("/", 1)[0], recursive=True)
                store.move(waits, goes)
        self._clear(store, base)

    def abort(self, messages: list[Files | None]) -> None:
        self._clear(*_store(self.path))

    @staticmethod
    def _clear(store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{base}/_pending").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_pending")


class NpyDetections(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "mot_npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, schema)


def read_npy(spark: SparkSession, path: str, features: bool = True) -> DataFrame:
    """Detections below a folder; ``det_idx`` would be ``row`` within a frame and file."""
    spark.dataSource.register(NpyDetections)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("mot_npy").option("features", str(features).lower()).load(path)


def write_npy(df: DataFrame, path: str, tasks: int | None = None) -> None:
    """Rows with sequence, frame, x, y, w, h, score and feature (and id) as ``.npy`` files in a
    folder for each sequence, in order of frames. Large sequences are spread over tasks by ranges
    of frames."""
    df.sparkSession.dataSource.register(NpyDetections)
    keys = ["sequence", "frame"]
    spread = df.repartitionByRange(tasks, *keys) if tasks else df.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).write.format("mot_npy").mode("append").save(path)


def gathered(detections: DataFrame, sequences: DataFrame) -> DataFrame:
    """What a viewer wants of each sequence with detections: first and last frame, number of rows,
    length of the features, and milliseconds between frames (null without a rate)."""
    sizes = detections.groupBy("sequence").agg(F.min("frame").alias("min_frame"), F.max("frame").alias("max_frame"), F.count(F.lit(1)).alias("n_detections"), F.max(F.size("feature")).alias("feature_dim"))
    rates = sequences.select("sequence", "name", F.try_divide(F.lit(1000.0), F.col("frame_rate")).alias("update_ms"))
    return sizes.join(rates, "sequence", "left").select("sequence", F.coalesce("name", "sequence").alias("name"), "min_frame", "max_frame", "n_detections", "feature_dim", "update_ms")
