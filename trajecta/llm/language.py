"""Language identification by character models in sorted arrays.

An interpolated Kneser-Ney model (order 4, letters only, everything else is one blank) is
counted for each language over all training documents. For every gram that any language has
seen, all languages' log-probabilities are computed by joins; they are stored as arrays in the
order of the grams with one column per language, and found by hashing (the gram itself is
compared, so no two share a value). The tables of the longest grams go to the workers in shards
of at most ``SHARD`` values, each of which is one pass over the texts; passes meet by row
number. Grams that no language has seen use the shorter version and the weights of their
contexts.

The lowest cross-entropy per symbol wins. ``score`` is the share of the winner among the
languages' likelihoods over ``EVIDENCE`` symbols of that cross-entropy (neighbouring grams
are not independent, so longer texts are not counted as more evidence). A document is
*rejected* where its cross-entropy lies above the ``REJECT`` quantile of the training documents
of the predicted language.

Every row gives a row, repeated ones too; no rows: no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import arrow_map, as_bytes, crc_mod, saved, steps
from trajecta.llm.kneser import BITS, Counter, Model, grams, mask
from trajecta.llm.wordhash import Finder, mixed

ORDER = 4
#: Values of the longest grams' table that a pass over the texts holds (4 bytes each).
SHARD = 24_000_000
#: Quantile of training documents' cross-entropy beyond which a prediction is rejected.
REJECT = 0.999
UNKNOWN = "und"
#: Symbols that count as independent evidence in the score, at most.
EVIDENCE = 40


def _counts(docs: DataFrame) -> DataFrame:
    """lang, gram, c of all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = Counter()
        for b in batches:
            texts, langs = b.column("text").to_pylist(), np.array(b.column("lang").to_pylist(), dtype=object)
            for i, j in steps(texts):
                for lang in set(langs[i:j]):
                    mine = [t.decode().lower() for t, x in zip(texts[i:j], langs[i:j], strict=True) if x == lang]
                    seen.add(lang, grams(mine, ORDER, True)[0])
        for lang in list(seen.parts):
            codes, n = seen.merged(lang)
            yield {"lang": [lang] * len(codes), "gram": codes, "c": n}

    rows = docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", 4) != 2)).select("lang", as_bytes().alias("text"))
    return arrow_map(rows, run, "lang string, gram long, c long")


@dataclass
class Arrays:
    """One order's grams, ascending, and a row of values for each; the last row holds the value
    of grams that are not there."""

    find: Finder
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray, missing: float) -> Arrays:
        order = np.argsort(keys)
        return cls(Finder(keys[order]), np.concatenate([values[order], np.full((1, values.shape[1]), missing)]).astype(np.float32))


def _shard(grams_: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(grams_.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % shards


@dataclass
class LanguageModel:
    """grams: log-probabilities by order; contexts: log-weights of contexts of grams. The longest
    grams' table is the one of a shard at a time."""

    langs: list[str]
    grams: dict[int, Arrays]
    contexts: dict[int, Arrays]
    shards: int = 1
    shard: int = 0

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """(symbols, languages) log-probabilities; 0 for grams of other shards."""
        if self.shards == 1:
            return self._logs(codes, ORDER)
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        mine = np.flatnonzero(_shard(codes, self.shards) == self.shard)
        out[mine] = self._logs(codes[mine], ORDER)
        return out

    def _logs(self, codes: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full((len(codes), len(self.langs)), -BITS * np.log(2), np.float32)
        table = self.grams[order]
        row = table.find(codes)
        out = table.values[row]
        lost = np.flatnonzero(row == len(table.find.keys))
        if len(lost):
            c, ctx = codes[lost], self.contexts[order]
            out[lost] = ctx.values[ctx.find(c >> BITS)] + self._logs(c & mask(order - 1), order - 1)
        return out


def _arrays(df: DataFrame, langs: list[str], missing: float) -> Arrays:
    """df(lang, gram, value) -> arrays."""
    wide = df.groupBy("gram").pivot("lang", langs).agg(F.first("value").cast("float")).fillna(missing).toPandas()
    return Arrays.of(wide["gram"].to_numpy(np.int64), wide[langs].to_numpy(np.float32).reshape(len(wide), len(langs)), missing)


def train(docs: DataFrame, most: int = SHARD) -> tuple[LanguageModel, DataFrame | None]:
    """The model without the longest grams, and those as a table: lang, gram, value, shard."""
    counts = saved(_counts(docs), "counts", 1 << 14)
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # one row per language
    if not langs:
        return LanguageModel([], {}, {}), None
    model = Model(counts, ORDER, modified=False)
    every = F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang")
    wanted = counts.select("gram").distinct().select(every, "gram")
    found = model.probabilities(wanted)
    by_gram = {m: _arrays(p.select("lang", "gram", F.log("p").alias("value")), langs, 0.0) for m, p in enumerate(found[:-1], 1)}
    by_context = {m: _arrays(c.select("lang", F.col("ctx").alias("gram"), F.log("g").alias("value")), langs, 0.0) for m, c in model.contexts.items()}
    shards = max(1, -(-found[-1].count() // most))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"lang": b.column("lang"), "gram": b.column("gram"), "value": b.column("value"), "shard": _shard(b.column("gram").to_numpy(), shards)}

    longest = found[-1].select("lang", "gram", F.log("p").alias("value"))
    longest = longest.withColumn("shard", F.lit(0)) if shards == 1 else saved(arrow_map(longest, placed, "lang string, gram long, value double, shard int"), "longest", 1 << 14)
    return LanguageModel(langs, by_gram, by_context, shards), longest


def _entropies(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns ``keep``, letters and symbols of each text, and for each language the sum of
    its log-probabilities in the model's shard."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = held.value
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in steps(texts, 1 << 20):
                n = j - i
                codes, owner = grams([t.decode().lower() for t in texts[i:j]], ORDER, True)
                letters = np.bincount(owner, (codes & mask(1)) != 1, n).astype(np.int64)
                logs = m.logs(codes) if m.langs else np.zeros((len(codes), 0), np.float32)
                sums = np.stack([np.bincount(owner, logs[:, k], n) for k in range(len(m.langs))], 1) if m.langs else np.zeros((n, 0))
                yield {c: b.column(c)[i:j] for c in keep} | {"letters": letters, "size": np.bincount(owner, minlength=n), "sums": list(sums)}

    kinds = {"doc_id": "long", "held_out": "boolean", "true": "string", "row": "long"}
    return arrow_map(docs.select(*keep, "text"), run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "letters long, size long, sums array<double>"]))


def predict(docs: DataFrame, model: LanguageModel, longest: DataFrame | None) -> DataFrame:
    """doc_id, held_out, true (the given language), lang_pred, score, entropy of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("lang").cast("string").alias("true"), as_bytes().alias("text"))
    own, langs = ["doc_id", "held_out", "true"], model.langs
    if not langs:
        got = _entropies(rows, model, own)
    elif model.shards == 1:
        got = _entropies(rows, replace(model, grams=model.grams | {ORDER: _arrays(longest, langs, 0.0)}), own)
    else:
        rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        parts = None
        for k in range(model.shards):
            one = replace(model, shard=k, grams=model.grams | {ORDER: _arrays(longest.where(F.col("shard") == k), langs, 0.0)})
            part = _entropies(rows, one, ["row"])
            parts = part if parts is None else parts.unionByName(part)
        sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(len(langs))]
        total = saved(parts, "sums").groupBy("row").agg(F.max("letters").alias("letters"), F.max("size").alias("size"), *sums)
        total = total.select("row", "letters", "size", F.array(*[F.col(f"s{k}") for k in range(len(langs))]).alias("sums"))
        got = rows.select("row", *own).join(total.hint("merge"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            n = b.num_rows
            size = np.maximum(1, b.column("size").to_numpy())
            entropy = -np.array(b.column("sums").to_pylist(), float).reshape(n, -1) / size[:, None] if langs else np.zeros((n, 1))
            best = entropy.argmin(1)
            low = entropy[np.arange(n), best]
            odds = np.exp(-(entropy - low[:, None]) * np.minimum(size, EVIDENCE)[:, None])
            known = (b.column("letters").to_numpy() > 0) & bool(langs)
            yield {
                "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "true": b.column("true"),
                "lang_pred": [langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)],
                "score": np.where(known, 1 / odds.sum(1), 0.0), "entropy": np.where(known, low, 0.0),
            }

    return arrow_map(got, run, "doc_id long, held_out boolean, true string, lang_pred string, score double, entropy double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for every row.

    Null text or text without letters: ``und`` with score 0, rejected. Without any training
    language every row is ``und``.
    """
    scored = saved(predict(docs, *train(docs)), "scored")
    own = scored.where((~F.col("held_out")) & (F.col("true") == F.col("lang_pred")))
    limits = own.groupBy("lang_pred").agg(F.percentile_approx("entropy", REJECT, 10_000).alias("most"))  # a row for each language
    out = scored.join(F.broadcast(limits), "lang_pred", "left")
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("entropy") > F.coalesce("most", F.lit(float("inf"))))
    return out.select("doc_id", "held_out", "lang_pred", "score", "entropy", rejected.alias("rejected"))
