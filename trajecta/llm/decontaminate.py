"""Benchmark decontamination in DataFrame operations alone.

Item-sized windows of the documents are compared with the items of a benchmark by SimHash
and then exactly, by the weighted Jaccard similarity of their ``WIDTH``-word shingles
(weights are the numbers of occurrences).

1. Words are runs of letters and digits in lower case; a shingle is one 64-bit hash.
2. A window as similar as ``SIMILARITY`` shares at least ``need`` shingles with its item, so an
   index of the items' shingles gives the candidates: only documents with that many hits on an
   item's shingles go on, and only windows that begin or end at a hit, or are the first or the
   last of the document (a best window is one of these), and hold ``need`` hits. A document
   shorter than the item is one window. Nothing similar enough is lost here; what has no part
   of the benchmark costs one look-up per word.
3. The 64-bit SimHash fingerprints of a candidate window and its item must agree within
   ``RADIUS`` bits.
4. Pairs within the radius are verified by the exact similarity.

A shingle that a similar pair does not share moves a fingerprint's bit by one vote of n, so
a similarity of 0.8 or more leaves about 10 differing bits on average and hardly ever more
than 20; ``RADIUS`` is 26. A multi-index that is sure to find this radius would need 27 blocks
of 2 or 3 bits, that is, nearly all windows would meet all items of their length; the index of
shingles finds the same pairs without that join.

An item of fewer than ``WIDTH`` words has no shingle: it matches documents that consist of
its words and nothing else. Items without words match nothing. Items with equal words are one
item (the smallest item_id). Null texts have no words. Rows with the same doc_id are told apart
by a hash of the text; equal rows give one result. No documents or no items: no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.common import saved, size_at_most, table

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 26
#: Benchmark shingles that are sent to all executors at most (16 bytes each); more are shuffled.
BROADCAST_SHINGLES = 1_000_000


def words(text: str = "text") -> Column:
    cleaned = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(cleaned, " ", -1), lambda w: w != "")


def hashed(df: DataFrame, *keep: str, width: int = WIDTH) -> DataFrame:
    """``keep`` and hs, the hashes of all shingles of ``text`` in order. Intermediate arrays are
    bound as lambda variables: a column would be copied into each of its uses by the optimiser
    and computed again for every word."""

    def of(wh: Column) -> Column:
        last = F.size(wh) - F.lit(width)
        at = lambda i, k: F.get(wh, i + F.lit(k))
        return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[at(i, k) for k in range(width)])))

    return df.select(*keep, F.get(F.transform(F.array(F.transform(words(), lambda w: F.xxhash64(w))), of), F.lit(0)).alias("hs"))


def fingerprint(hs: str) -> Column:
    """Majority bits of an array of hashes, as a long."""
    return F.expr(
        f"get(transform(array({hs}), a -> aggregate(sequence(0, 63), 0L, (acc, b) -> acc | CASE WHEN 2 * aggregate(a, 0L, (n, h) -> n + (shiftright(h, b) & 1L)) > size(a) THEN shiftleft(1L, b) ELSE 0L END)), 0)"
    )


def overlap(a: str, b: str) -> Column:
    """Shared shingles of two arrays with their numbers of occurrences."""
    return F.expr(f"aggregate(array_intersect({a}, {b}), 0L, (n, h) -> n + least(size(filter({a}, x -> x = h)), size(filter({b}, x -> x = h))))")


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, ihs, n (shingles), ifp of the items that have shingles."""
    made = hashed(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id").withColumnRenamed("hs", "ihs")
    one = made.groupBy("ihs").agg(F.min("item_id").alias("item_id")).withColumn("n", F.size("ihs")).where("n > 0")
    return one.withColumn("ifp", fingerprint("ihs"))


def _short(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are a short item, word for word."""
    few = F.size("w").between(1, WIDTH - 1)
    mine = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words().alias("w")).where(few)
    mine = mine.groupBy("w").agg(F.min("item_id").alias("item_id"))
    brief = rows.select("doc_id", "text_key", words().alias("w")).where(few)
    return brief.join(mine, "w").select("doc_id", "text_key", "item_id", F.lit(0).alias("start"), F.lit(1.0).alias("similarity")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_key, item_id, start (word), similarity: the best window of each document
    for each item that it holds; of equally good ones the first that begins or ends at a hit."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    known = saved(items(benchmark), "items")
    marks = known.select(F.explode(F.array_distinct("ihs")).alias("h"), "item_id", "n")
    each = hashed(rows, "doc_id", "text_key").select("doc_id", "text_key", F.size("hs").alias("size"), F.posexplode_outer("hs").alias("p", "h"))
    few = size_at_most(marks, BROADCAST_SHINGLES)
    marks = F.broadcast(marks) if few else marks
    # overlap / (n + m - overlap) >= s with m shingles in the window; a little less for rounding
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.least("n", "size")) - F.lit(1e-9)).cast("int")
    # hits of a document on an item: at most as many as it has words, in one row of theirs
    hits = each.join(marks, "h").groupBy("doc_id", "text_key", "size", "item_id", "n").agg(F.collect_set("p").alias("at")).withColumn("need", need).where(F.size("at") >= F.col("need"))
    holds = "size(filter(at, p -> p >= s AND p < s + n)) >= need"
    hits = hits.withColumn("edges", F.expr(f"filter(array_distinct(concat(at, transform(at, p -> p - n + 1))), s -> s >= 0 AND s + n <= size AND {holds})"))
    ends = F.expr(f"filter(array_except(array(0, greatest(0, size - n)), edges), s -> {holds})")
    starts = F.concat(F.transform("edges", lambda s: F.struct(s.alias("s"), F.lit(1).alias("edge"))), F.transform(ends, lambda s: F.struct(s.alias("s"), F.lit(0).alias("edge"))))
    starts = hits.select("doc_id", "text_key", "item_id", "n", F.explode(starts).alias("w")).select("doc_id", "text_key", F.struct("item_id", "n", "w.s", "w.edge").alias("w")).distinct()
    asked = saved(starts.groupBy(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key")).agg(F.collect_list("w").alias("asked")), "asked")
    # doc_ids can be null
    mine = rows.join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")))
    full = saved(hashed(mine, "doc_id", "text_key", "asked"), "full")
    windows = full.select("doc_id", "text_key", "hs", F.explode("asked").alias("w"))
    windows = windows.select("doc_id", "text_key", "w.item_id", F.col("w.s").alias("start"), "w.edge", F.expr("slice(hs, w.s + 1, w.n)").alias("whs"))
    # equal windows of an item are compared once
    prints = saved(windows.groupBy("whs", "item_id").agg(F.count(F.lit(1)).alias("uses")).withColumn("fp", fingerprint("whs")), "prints")
    kept = known.select("item_id", "n", "ihs", "ifp")
    kept = F.broadcast(kept) if few else kept
    near = prints.join(kept, "item_id").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    shared = overlap("whs", "ihs")
    similar = near.select("whs", "item_id", (shared / (F.col("n") + F.size("whs") - shared)).alias("similarity")).where(F.col("similarity") >= F.lit(similarity) - F.lit(1e-9))
    found = windows.join(similar.hint("merge"), ["whs", "item_id"])
    best = found.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("similarity", "edge", (-F.col("start")).alias("back"))).alias("m"))
    best = best.select("doc_id", "text_key", "item_id", (-F.col("m.back")).cast("int").alias("start"), F.col("m.similarity").alias("similarity"))
    return best.unionByName(_short(rows, benchmark))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with benchmark items in them: doc_id, item_id, start, similarity."""
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).distinct().hint("merge")
    match = docs["doc_id"].cast("long").eqNullSafe(bad["__doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["__key"])
    return docs.join(bad, match, "left_anti")
