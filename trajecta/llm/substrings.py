"""Removal of long spans of words that an earlier document has too.

A window is ``length`` consecutive words of one document. Windows are the edges of a token
de Bruijn graph (k = ``length`` words). Consecutive windows that share a minimizer (the
smallest hash among their runs of ``seed`` words) make a *path*: each of its windows has one
successor inside it, so a path is a piece without branches and one row stands for all of its
windows. Paths meet by their seeds, which are grouped with partial sums before any shuffle.

* A seed of one document alone has no repeats and goes no further.
* A seed whose paths all have the same content: every window of it is repeated; in all
  documents but the first the whole path goes, by its source coordinates.
* A seed with several different paths is a branch of the graph. Equal paths there compact into
  one again; and only the first document of each takes its path apart into single windows,
  digested from the source text at their coordinates, and these are joined.

All equal windows have equal minimizers, so no repeat can be missed. Whether two paths or
windows are equal is judged by a cryptographic digest of the words themselves, read at their
source coordinates (128 bits of BLAKE2b over the words joined by one space), so words that
were chosen to collide in a hash do no harm. Adjacent windows are glued to spans only when
words are removed.

Rows are matched by doc_id and a hash of the text, so repeated doc_ids with different texts
do not mix; a null doc_id is later than any other. Null text has no words. No rows: no rows.
Equal rows are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import arrow_map, as_bytes, fresh, saved, steps
from trajecta.llm.wordhash import digests, run_hashes, word_hashes

LENGTH, SEED = 50, 16
#: Words of one document that are handled at once; longer ones go in overlapping parts.
PART = 1 << 18
#: Digests that are made at once.
AT_ONCE = 1 << 14
_LAST = (1 << 63) - 1


def _paths(words: np.ndarray, owner: np.ndarray, begin: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths of the windows that begin at ``begin`` (positions in the hashes ``words``,
    ascending): first window, number of windows, hash of the seed."""
    n = len(words)
    at = np.arange(n - seed + 1)
    mers = run_hashes(words, seed)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (mers >> bits << bits) | at.astype(np.uint64)  # the leftmost of equal hashes
    span, have = length - seed + 1, 1
    low = key
    while have < span:  # minimum over ``span`` positions by doubling
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    where = (low[begin] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(begin), bool)
    new[1:] = (where[1:] != where[:-1]) | (begin[1:] != begin[:-1] + 1) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(begin))), mers[where[first]].view(np.int64)


def _placed(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space; where each begins and ends."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return b" ".join(words), end - size, end


def _doc_windows(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of documents: their words, then for each window its document, its position in
    the words and in the document. A very long document comes in parts that overlap."""
    for i, j in steps(texts):
        split = [t.split() for t in texts[i:j]]
        if j - i == 1 and len(split[0]) > PART:
            n = len(split[0])
            for a in range(0, n - length + 1, PART):
                b = min(n, a + PART + length - 1)
                begin = np.arange(b - a - length + 1)
                yield split[0][a:b], np.full(len(begin), i), begin, begin + a
            continue
        sizes = np.array([len(x) for x in split])
        windows = np.maximum(sizes - length + 1, 0)
        if windows.sum() == 0:
            continue
        local = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        yield [w for x in split for w in x], np.repeat(np.arange(i, j), windows), local + np.repeat(np.cumsum(sizes) - sizes, windows), local


def paths(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc, text_key, start, windows, seed, c1, c2: the paths of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            doc, key = b.column("doc").to_numpy(), b.column("text_key").to_numpy()
            for words, owner, begin, local in _doc_windows(b.column("text").to_pylist(), length):
                first, count, seeds = _paths(word_hashes(words), owner, begin, length, seed)
                line, low, high = _placed(words)
                for k in range(0, len(first), AT_ONCE):
                    f, c = first[k : k + AT_ONCE], count[k : k + AT_ONCE]
                    made, own = digests(line, low[begin[f]], high[begin[f] + c - 1 + length - 1]), owner[f]
                    yield {"doc": doc[own], "text_key": key[own], "start": local[f], "windows": c, "seed": seeds[k : k + AT_ONCE], "c1": made[:, 0], "c2": made[:, 1]}

    return arrow_map(docs, run, "doc long, text_key long, start int, windows int, seed long, c1 long, c2 long")


def _ranges(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """start and windows of each row's list."""
    at, values = column.offsets.to_numpy(), column.values
    start, count = values.field("start").to_numpy().astype(np.int64), values.field("windows").to_numpy().astype(np.int64)
    return [(start[a:b], count[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """doc, text_key, start, w1, w2: single windows of the paths listed in ``paths``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            doc, key, texts = b.column("doc").to_numpy(), b.column("text_key").to_numpy(), b.column("text")
            for i, (start, count) in enumerate(_ranges(b.column("paths"))):
                line, low, high = _placed(texts[i].as_py().split())
                at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
                for k in range(0, len(at), AT_ONCE):
                    s = at[k : k + AT_ONCE]
                    made = digests(line, low[s], high[s + length - 1])
                    yield {"doc": np.full(len(s), doc[i]), "text_key": np.full(len(s), key[i]), "start": s, "w1": made[:, 0], "w2": made[:, 1]}

    return arrow_map(docs, run, "doc long, text_key long, start int, w1 long, w2 long")


def _rows(docs: DataFrame) -> DataFrame:
    text = as_bytes()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc, text_key, ranges: per document the windows to remove, as (start, windows)."""
    rows = _rows(docs)
    found = saved(paths(rows, length, seed), "paths")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("c1", "c2") for f in (F.min, F.max)]
    seeds = found.groupBy("seed").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), *ends).where("first < last")
    seeds = seeds.select("seed", "first", F.expr("min_c1 < max_c1 OR min_c2 < max_c2").alias("branch"))
    listed = saved(found.join(seeds.hint("merge"), "seed").drop("seed"), "listed")
    later = listed.where("NOT branch AND doc > first").select("doc", "text_key", "start", "windows")
    parted = listed.where("branch").drop("branch", "first")
    nodes = parted.groupBy("c1", "c2").agg(F.min("doc").alias("first"))
    parted = parted.join(nodes.hint("merge"), ["c1", "c2"])
    equal = parted.where(F.col("doc") > F.col("first")).select("doc", "text_key", "start", "windows")
    apart = parted.where(F.col("doc") == F.col("first")).groupBy("doc", "text_key").agg(F.collect_set(F.struct("start", "windows")).alias("paths"))
    single = saved(_windows(rows.join(apart.hint("merge"), ["doc", "text_key"]), length), "windows")
    least = single.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    again = single.join(least.hint("merge"), ["w1", "w2"]).where(F.col("doc") > F.col("first")).select("doc", "text_key", "start", F.lit(1).alias("windows"))
    every = later.unionByName(equal).unionByName(again)
    return every.groupBy("doc", "text_key").agg(F.collect_set(F.struct("start", "windows")).alias("ranges"))


def _covered(n: int, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + count - 1 + length, n), -1)
    return np.cumsum(edge)[:n] > 0


def without_repeats(docs: DataFrame, keep: list[str], length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with the columns ``keep``, then n_words, n_removed and kept (the
    words that stay, joined by one space), whose names begin with ``fresh(keep)``."""
    p = fresh(keep)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias(f"{p}doc"), F.xxhash64(as_bytes()).alias(f"{p}key"), as_bytes().alias(f"{p}text")]
    ranges = repeated_ranges(docs, length, seed).toDF(f"{p}doc", f"{p}key", f"{p}ranges").hint("merge")
    cols = docs.select(*keep, *key).join(ranges, [f"{p}doc", f"{p}key"], "left").select(*keep, f"{p}text", f"{p}ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, (start, count) in zip(b.column(f"{p}text"), _ranges(b.column(f"{p}ranges")), strict=True):
                words = text.as_py().split()
                n_words.append(len(words))
                if len(start):
                    gone = _covered(len(words), start, count, length)
                    n_removed.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone)]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=[*keep, f"{p}n_words", f"{p}n_removed", f"{p}kept"])

    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{p}n_words long, {p}n_removed long, {p}kept binary"])
    return cols.mapInArrow(run, schema)


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text`` (texts without any stay as they
    are) and ``n_chars`` counted again. Null texts stay null, repeated rows stay, an empty table
    gives an empty one, and no name of a further column clashes."""
    out, p = without_repeats(docs, docs.columns), fresh(docs.columns)
    some = F.col(f"{p}n_removed") > 0
    out = out.withColumn("text", F.when(some, F.col(f"{p}kept").cast("string")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def removal_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    out = without_repeats(plain, ["doc_id"])
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))
