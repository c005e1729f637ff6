"""Image files as a stream of bounded batches: what a loader with a queue of limited length does,
with backlog kept by the source's own log instead of a thread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_images(spark: SparkSession, folder: str, per_batch: int = 8, suffixes: tuple[str, ...] = ("jpg", "png", "bmp"), content: bool = True) -> DataFrame:
    """path, name, frame (the number that is the name, else null), length and, if wanted, content
    of image files; a batch has at most ``per_batch`` files, the earliest written first."""
    if per_batch < 1:
        raise ValueError("a batch needs a file")
    glob = "*.{" + ",".join(suffixes) + "}"
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).option("latestFirst", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_extract(name, r"^(\d+)\.[^.]*$", 1)
    out = files.select("path", name.alias("name"), stem.try_cast("int").alias("frame"), "length", "modificationTime", "content")
    return out if content else out.drop("content")


def each_batch(images: DataFrame, use: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``use`` on batches (in order of time and name) until the present files are done; a later
    run with the same checkpoint goes on behind them."""

    def ordered(batch: DataFrame, number: int) -> None:
        use(batch.orderBy("modificationTime", "name"), number)

    return images.writeStream.foreachBatch(ordered).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
