"""Token ids as length-delimited binary records with masked checksums and an offset index.

A file is a row of records. A record is

    length  u64 | masked crc32 of these 8 bytes  u32 | payload | masked crc32 of the payload  u32

all little-endian; the mask rotates the checksum right by 15 bits and adds 0xA282EAD8. A
payload is one byte of flags (1: no doc_id, 2: 4-byte ids), the doc_id (i64), then the ids.
A record of length 0 closes a block of records and carries nothing. Spark's own writer
commits the files (so a lost executor leaves no half file and any Hadoop store will do): a
block is one row, and the empty record is the writer's line separator.

The index is a table beside the files (file, doc_id, offset, length, n_tokens, ...), made
from the files' own bytes, so that a reader can fetch records in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.bpe import VOCABULARY, encoded, encoder
from trajecta.llm.common import arrow_map, as_bytes, new_path

BLOCK = 1 << 20
#: Text bytes that one file is made from, about.
FILE_TEXT = 24 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


EMPTY = framed(b"")


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<Bq", (doc_id is None) | (2 * (width == 4)), doc_id or 0) + ids


def parsed(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """offset, payload length, doc_id and ids of each record; raises where a checksum differs."""
    at, n = 0, len(data)
    while at < n:
        head = data[at : at + 8]
        size, check = struct.unpack_from("<QI", data, at)
        if check != masked(head):
            raise ValueError(f"damaged length at byte {at}")
        payload = data[at + 12 : at + 12 + size]
        if len(payload) != size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        if size:
            flags, doc_id = struct.unpack_from("<Bq", payload)
            yield at, size, None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)
        at += 16 + size


def write_records(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int | None = 2) -> None:
    """Encode every text and write records in ascending doc_id order over all files (nulls first;
    rows with the same doc_id in the order of a hash of the text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_TEXT))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = encoder(vocabulary)
        end = np.array([end_id] if end_id is not None else [], enc.dtype).tobytes()
        block: list[bytes] = []
        size = 0
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoded(b.column("text").to_pylist(), vocabulary), strict=True):
                block.append(framed(payload_of(doc_id, ids.tobytes() + end, enc.dtype.itemsize)))
                size += len(block[-1])
                if size >= BLOCK:
                    yield {"block": [b"".join(block)]}
                    block, size = [], 0
        if block:
            yield {"block": [b"".join(block)]}

    order = ["doc_id", F.xxhash64("text")]  # a doc_id with many rows is dealt to several files
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    arrow_map(ordered, blocks, "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files with its place: file, offset, length, doc_id, n_tokens,
    first (ids before it in its file), ids_crc32 (of its ids as little-endian u32)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for name, data in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                out: dict[str, list] = {k: [] for k in ("file", "doc_id", "offset", "length", "n_tokens", "first", "ids_crc32")}
                first = 0
                for at, size, doc_id, ids in parsed(data.as_py()):
                    for k, v in (("file", name), ("doc_id", doc_id), ("offset", at), ("length", size), ("n_tokens", len(ids)), ("first", first), ("ids_crc32", zlib.crc32(ids.astype("<u4").tobytes()))):
                        out[k].append(v)
                    first += len(ids)
                if out["file"]:
                    yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return arrow_map(named, rows, "file string, doc_id long, offset long, length long, n_tokens long, first long, ids_crc32 long")


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Make the offset index of the files at ``path`` from their bytes and read it back."""
    read_records(spark, path).write.parquet(index)
    return spark.read.parquet(index)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Records by place, in any order: ``wanted`` has file, offset and length of index rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content"))
    cut = F.expr("substring(content, CAST(offset + 13 AS INT), CAST(length AS INT))")
    return wanted.join(named, "file").select(*wanted.columns, cut.alias("payload"))


def before_files(index: DataFrame) -> DataFrame:
    """file, before: the ids of all files before each one, by the files' numbers (which have more
    digits from the hundred thousandth on, so names would not do)."""
    # One row per file; a file holds tens of MB, so this window is small beside the data.
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = F.sum("in_file").over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("file", F.coalesce(before, F.lit(0)).alias("before"))


def token_records(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int | None = 2, path: str | None = None) -> DataFrame:
    """Write, index and read back: doc_id, start, n_tokens, ids_crc32, file, offset, length.

    Null text: only the end id. Repeated or null doc_ids each give a record (nulls first).
    An empty table gives no record.
    """
    spark = docs.sparkSession
    at = path or new_path(spark, "records")
    write_records(docs, f"{at}/data", vocabulary, end_id)
    index = write_index(spark, f"{at}/data", f"{at}/index")
    return index.join(before_files(index), "file").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "length")
