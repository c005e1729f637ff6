"""Interpolated Kneser-Ney models of characters, counted and joined on the cluster.

A symbol has 12 bits: 0 is the edge of a text, 1 white space (or any non-letter), letters
below U+0800 stand for themselves and others are folded into the upper half. A gram of up to
five symbols is one long, the newest symbol in the low bits; so ``gram >> 12`` is its context
and ``gram & mask`` its shorter version, in numpy and in SQL alike.

The grams of a batch of texts are counted before they leave the task. Everything after that
is grouped counts and equi-joins on (lang, gram), so a model may be as large as it likes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import saved

BITS = 12


def mask(order: int) -> int:
    return (1 << BITS * order) - 1


@lru_cache(maxsize=2)
def _symbols(letters_only: bool) -> np.ndarray:
    """Symbol of each code point."""
    code = np.arange(0x110000, dtype=np.uint64)
    folded = (0x800 + ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53))).astype(np.uint16)
    out = np.where(code < 0x800, code, folded).astype(np.uint16)
    out[2:32] = 1
    plain = (lambda c: c.isalpha()) if letters_only else (lambda c: not c.isspace())
    out[np.fromiter((not plain(chr(c)) for c in range(0x110000)), bool, 0x110000)] = 1
    out[0] = 0
    return out


def grams(texts: list[str], order: int, letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each symbol of the texts, and the text it is in. Runs of symbol 1
    count once. A zero character in a text counts as white space."""
    edge = "\0" * (order - 1)
    sizes = np.array([len(t) for t in texts])
    line = edge + edge.join(t.replace("\0", " ") if "\0" in t else t for t in texts)
    s = _symbols(letters_only)[np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32)]
    if len(texts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + order - 1)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 1) | (s[:-1] != 1)
    s, owner = s[keep], owner[keep]
    out = s.astype(np.int64)
    wide = out.copy()
    for k in range(1, order):
        wide[k:] |= out[:-k] << (BITS * k)
    real = s != 0
    return wide[real], owner[real]


class Counter:
    """Counts of (key, gram) with a bounded number of entries in memory between merges."""

    def __init__(self) -> None:
        self.parts: dict = {}

    def add(self, key, codes: np.ndarray, weights: np.ndarray | None = None) -> None:
        if not len(codes):
            return
        if weights is None:
            codes, weights = np.unique(codes, return_counts=True)
        parts = self.parts.setdefault(key, [])
        parts.append((codes, weights))
        if len(parts) > 8:
            self.parts[key] = [self.merged(key)]

    def merged(self, key) -> tuple[np.ndarray, np.ndarray]:
        parts = self.parts[key]
        if len(parts) == 1:
            return parts[0]
        codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


class Model:
    """Tables of a model by order: grams(lang, gram, c), contexts(lang, ctx, total, g) and the
    discounts, where g is the weight of the shorter version in that context."""

    def __init__(self, counts: DataFrame, order: int, modified: bool) -> None:
        """counts: lang, gram of ``order`` symbols, c (occurrences)."""
        self.order, self.grams, self.contexts = order, {}, {}
        table = saved(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")
        for m in range(order, 0, -1):
            if m < order:  # how many symbols come before it
                table = saved(table.groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask(m))).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "grams")
            of = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
            n = table.groupBy("lang").agg(*of)  # a row for each language
            y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
            d = [F.lit(1.0) * y] if not modified else [F.lit(k) - F.coalesce((k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(k * 0.5)) for k in (1, 2, 3)]
            # discounts lie between 0 and the count that they are taken from
            d = [F.greatest(F.lit(0.05), F.least(x, F.lit(0.95 * (k + 1)))) for k, x in enumerate(d)]
            d = d if modified else d * 3
            low = n.select("lang", *[x.alias(f"d{k + 1}") for k, x in enumerate(d)])
            table_d = table.join(F.broadcast(low), "lang")
            self.grams[m] = table_d.select("lang", "gram", (F.col("c") - _discount()).alias("rest"))
            context = table_d.groupBy("lang", F.shiftright("gram", BITS).alias("ctx")).agg(F.sum("c").alias("total"), F.sum(_discount()).alias("taken"))
            self.contexts[m] = saved(context.select("lang", "ctx", F.col("total").cast("double").alias("total"), (F.col("taken") / F.col("total")).alias("g")), "contexts")

    def probabilities(self, wanted: DataFrame, keep: bool = False) -> list[DataFrame]:
        """wanted(lang, gram), distinct -> tables (lang, gram, p) of each order from 1 on; p has
        all shorter versions mixed in, so it is positive for any gram."""
        wanted = saved(wanted.select("lang", "gram"), "wanted")
        out, lower = [], None
        for m in range(1, self.order + 1):
            at = wanted.select("lang", F.col("gram").bitwiseAND(F.lit(mask(m))).alias("gram"))
            at = at.distinct() if m < self.order else at
            at = at.withColumn("ctx", F.shiftright("gram", BITS)).withColumn("short", F.col("gram").bitwiseAND(F.lit(mask(m - 1))))
            q = at.join(self.grams[m], ["lang", "gram"], "left").join(self.contexts[m], ["lang", "ctx"], "left")
            base = F.lit(1.0 / (1 << BITS))
            if lower is not None:
                q = q.join(lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("less")), ["lang", "short"])
                base = F.col("less")
            p = F.when(F.col("total").isNull(), base).otherwise(F.coalesce(F.col("rest"), F.lit(0.0)) / F.col("total") + F.col("g") * base)
            lower = saved(q.select("lang", "gram", p.alias("p")), "p")
            out.append(lower)
        return out


def _discount() -> Column:
    return F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
