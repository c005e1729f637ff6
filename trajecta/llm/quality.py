"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

For each language, character grams of order ``ORDER`` are counted over the documents that
``labels`` marks as good, but for one in ``HELD`` of them (a pooled model serves languages
without any). The grams of all documents, distinct per task, then meet these counts, their
contexts and their shorter versions in joins sharded by (language, gram), which gives each
gram's log-probability with all shorter versions mixed in. Documents sum the log-probabilities
of their grams on the map side, so no text is shuffled for it: the joined table goes to the
workers in shards of at most ``SHARD`` entries, each entry with its whole key (no two grams
share a value), and each shard is one pass over the texts; passes meet by row number.

A document stays if its perplexity is at most the ``QUANTILE`` quantile of the held-out
trusted documents of its language, which the model has not seen. Null or empty text has no
perplexity and does not stay; a language without held-out documents uses the quantile of all
held-out ones. Without any trusted text nothing stays. Labels tell which text is trusted and
nothing else. Every row gives a row, repeated ones too; no rows: no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.common import arrow_map, as_bytes, crc_mod, saved, steps, table
from trajecta.llm.kneser import BITS, Counter, Model, grams
from trajecta.llm.wordhash import Finder

ORDER, QUANTILE = 4, 0.99
#: One trusted document in so many sets the thresholds and is not counted.
HELD = 10
#: Entries of the table that a pass over the texts holds (16 bytes each).
SHARD = 4_000_000
#: The name of the pooled model.
POOLED = ""


def _grams(rows: DataFrame) -> DataFrame:
    """lang, gram, c: grams of each task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = Counter()
        for b in batches:
            texts, langs = b.column("text").to_pylist(), np.array(b.column("lang").to_pylist(), dtype=object)
            for i, j in steps(texts):
                for lang in set(langs[i:j]):
                    seen.add(lang, grams([t.decode() for t, x in zip(texts[i:j], langs[i:j], strict=True) if x == lang], ORDER, False)[0])
        for lang in list(seen.parts):
            codes, n = seen.merged(lang)
            yield {"lang": [lang] * len(codes), "gram": codes, "c": n}

    return arrow_map(rows, run, "lang string, gram long, c long")


def perplexities(docs: DataFrame, trusted: DataFrame, shard: int = SHARD) -> DataFrame:
    """trusted(doc_id) -> doc_id, lang, n_symbols and perplexity of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit(POOLED)).alias("lang"), as_bytes().alias("text"))
    good = rows.join(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().hint("merge"), "doc_id", "left_semi")
    own = saved(_grams(good.select("lang", "text")), "trusted")
    langs = sorted(r["lang"] for r in own.select("lang").distinct().collect() if r["lang"] != POOLED)  # a row for each language
    pooled = own.groupBy("gram").agg(F.sum("c").alias("c")).select(F.lit(POOLED).alias("lang"), "gram", "c")
    model = Model(own.where(F.col("lang") != POOLED).unionByName(pooled), ORDER, modified=True)
    used = F.when(F.col("lang").isin(langs), F.col("lang")).otherwise(F.lit(POOLED)) if langs else F.lit(POOLED)
    wanted = saved(_grams(rows.select(used.alias("lang"), "text")).select("lang", "gram"), "asked").distinct()
    index = {x: k for k, x in enumerate([POOLED, *langs])}
    number = F.element_at(F.create_map(*[F.lit(x) for pair in index.items() for x in pair]), F.col("lang"))
    key = F.shiftleft(number.cast("long"), BITS * ORDER).bitwiseOR(F.col("gram"))
    values = model.probabilities(wanted)[-1].select(key.alias("key"), F.log("p").alias("value"))
    values = saved(values, "values")
    shards = max(1, -(-values.count() // shard))
    if shards > 1:
        rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    parts = []
    for k in range(shards):
        part = values.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == k).toPandas()
        held = docs.sparkSession.sparkContext.broadcast((Finder(part["key"].to_numpy(np.int64)), np.append(part["value"].to_numpy(np.float64), 0.0)))
        parts.append(_sums(rows, index, held, ["doc_id", "lang"] if shards == 1 else ["row"]))
    if shards == 1:
        total = parts[0]
    else:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        sums = saved(every, "sums").groupBy("row").agg(F.max("n").alias("n"), F.sum("total").alias("total"))
        total = rows.select("row", "doc_id", "lang").join(sums.hint("merge"), "row")
    return total.select("doc_id", "lang", F.col("n").alias("n_symbols"), F.when(F.col("n") > 0, F.exp(-F.col("total") / F.col("n"))).alias("perplexity"))


def _sums(rows: DataFrame, index: dict[str, int], held, keep: list[str]) -> DataFrame:
    """The columns ``keep``, n (symbols) and total (of the log-probabilities in the table held)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        find, values = held.value
        for b in batches:
            texts = b.column("text").to_pylist()
            langs = np.array([index.get(x, 0) for x in b.column("lang").to_pylist()], np.int64)
            for i, j in steps(texts, 1 << 20):
                codes, owner = grams([t.decode() for t in texts[i:j]], ORDER, False)
                logs = values[find(langs[i:j][owner] << BITS * ORDER | codes)]
                yield {c: b.column(c)[i:j] for c in keep} | {"n": np.bincount(owner, minlength=j - i), "total": np.bincount(owner, logs, j - i)}

    kinds = {"doc_id": "long", "lang": "string", "row": "long"}
    return arrow_map(rows.select(*dict.fromkeys([*keep, "lang", "text"])), score, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "n long, total double"]))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and keep of every row."""
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    aside = crc_mod("doc_id", HELD) == 0
    scored = saved(perplexities(docs, trusted.where(~aside)), "perplexities")
    good = scored.join(trusted.where(aside).hint("merge"), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    limits = good.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"))  # a row for each language
    every = good.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    out = scored.join(F.broadcast(limits), "lang", "left")
    limit = F.coalesce(F.col("own"), F.lit(every).cast("double"))
    return out.select("doc_id", F.nullif(F.col("lang"), F.lit(POOLED)).alias("lang"), "n_symbols", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("keep"))


def quality_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
