"""Small helpers that every training-data operator shares.

Nothing here depends on the machine: intermediate tables go to the folder that the
cluster names in ``spark.checkpoint.dir`` and are read again by path, so a lost
executor costs a re-read and never a recomputation of everything before it.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers receive at most this many rows, and about this many bytes, at once.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1024, 1 << 22
#: Longest key (bytes, or characters of a string) that a worker's cache keeps beyond the step that
#: needs it: text without blanks is one key of any length, so entries alone bound nothing.
KEPT = 64
#: Vectorised code handles about this many bytes of text at once.
BYTES_PER_STEP = 1 << 21
_WRITTEN: list[str] = []


def configure(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Bound the memory of Arrow batches (long texts) for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set (tests on one machine) an own one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="trajecta-")
        atexit.register(shutil.rmtree, own, True)
        named = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/trajecta/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def saved(df: DataFrame, label: str, rows: int = ROWS_PER_BATCH) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage for good. Python
    workers get ``rows`` rows at once meanwhile (many where rows are a few numbers)."""
    spark = df.sparkSession
    path = new_path(spark, label)
    configure(spark, rows)
    df.write.parquet(path)
    configure(spark)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables :func:`saved` has written so far and nobody has deleted."""
    return len(_WRITTEN)


def clean(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that :func:`saved` has written in this session, from number ``since`` on
    and but for the last ``keep`` ones."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for name in gone:
        at = jvm.org.apache.hadoop.fs.Path(name)
        at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(name: str = "text") -> Column:
    """UTF-8 of a text column, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields dicts of columns."""
    configure(df.sparkSession)
    types = pa.schema([pa.field(n, _ARROW[t]) for n, t in (x.strip().split(" ", 1) for x in re.split(r",\s*(?![^<]*>)", schema))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in types], schema=types)

    return df.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


def fresh(columns: list[str]) -> str:
    """A prefix that none of the columns begins with."""
    out = "__"
    while any(c.lower().startswith(out) for c in columns):
        out += "_"
    return out


def steps(texts: list[bytes], most: int = BYTES_PER_STEP) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about ``most`` bytes, one document at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def crc_mod(name: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def size_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, read no further than needed."""
    return df.limit(rows + 1).count() <= rows
