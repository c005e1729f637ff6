"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon of words and of word beginnings, second
persons near lexicon words, capitals, punctuation, and signs of obfuscation (digits and
marks inside words, letters set apart, stretched letters). The lexicon is learned from the
labelled training rows; the trees and the calibration are fitted on the driver from at most
``MOST_ROWS`` training rows (a bound on the fit only: every document is scored).

Scores see the text alone. Null text counts as empty and gets a score like any other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import KEPT, arrow_map, as_bytes, configure, crc_mod, table

#: Labelled rows that the fit takes at most, spread evenly over all of them by a hash.
MOST_ROWS = 8_000
#: Lexicon entries of each kind, and the rows that must hold an entry.
ENTRIES, SUPPORT = 400, 5
#: Characters of word beginnings.
STEMS = (3, 4, 5, 6)
#: Words on either side in which a second person counts as near.
NEAR = 5
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo tus usted ustedes vosotros".split())
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\W\d_][0-9@$!*#]+[^\W_]")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_APART = re.compile(r"[^\W\d_](?:[.\-_*][^\W\d_]){2,}\W?")
_SEPARATED = re.compile(r"[.\-_*'’]")
#: Entries of a worker's cache of words, each of ``KEPT`` bytes at most (about 150 bytes each).
CACHED = 150_000


def word(chunk: bytes) -> str:
    """The word in a run of characters that are not white space: lower case, bare edges."""
    s = chunk.decode().lower()
    return s if s.isalnum() else _EDGES.sub("", s)


def plain(w: str) -> str:
    """A word without the usual disguises."""
    return _SEPARATED.sub("", w).translate(_LEET)


class Words(dict):
    """Cache from chunks to words."""

    def __missing__(self, chunk: bytes) -> str:
        if len(self) > CACHED:
            self.clear()
        w = word(chunk)
        if len(chunk) <= KEPT:
            self[chunk] = w
        return w


class Kinds(dict):
    """Cache from chunks to rows of ``table``; row 0 is a word that tells nothing."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.rows, self.table = lexicon, {(0.0,) * 7: 0}, np.zeros((1, 7))
        self.begins = {x[: STEMS[0]] for x in lexicon.stems}

    def __missing__(self, chunk: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        raw, lex = chunk.decode(), self.lexicon
        bare = raw.rstrip(".,;:!?")
        if bare.isalpha() and len(bare) > 1:  # most words: only letters
            w = bare.lower()
            if w not in lex.words and w[: STEMS[0]] not in self.begins and w not in SECOND_PERSON and not _STRETCH.search(w):
                if len(chunk) <= KEPT:
                    self[chunk] = 0
                return 0
        w, weight = word(chunk), 0.0
        for x in {w, plain(w)}:
            weight = max(weight, lex.words.get(x, 0.0), *(lex.stems.get(x[:n], 0.0) for n in STEMS if len(x) > n)) if x else weight
        odd = not raw.isalpha()
        row = (weight, float(w in lex.words), float(w in SECOND_PERSON), float(odd and bool(_INNER.search(raw))), float(odd and bool(_APART.fullmatch(raw))), float(bool(_STRETCH.search(raw))), float(len(w) == 1 and w.isalpha()))
        if row not in self.rows:
            if len(self.rows) > 100_000:  # as many as there are kinds of words at all, in practice a few hundred
                self.rows, self.table = {(0.0,) * 7: 0}, np.zeros((1, 7))
                self.clear()
            self.rows[row] = len(self.rows)
            self.table = np.array(list(self.rows))
        k = self.rows[row]
        if len(chunk) <= KEPT:
            self[chunk] = k
        return k


@dataclass
class Lexicon:
    """Words and word beginnings with their log-odds of the toxic label."""

    words: dict[str, float]
    stems: dict[str, float]

    @classmethod
    def learn(cls, texts: list[bytes], toxic: np.ndarray) -> Lexicon:
        counts, cache = [(Counter(), Counter()), (Counter(), Counter())], Words()
        for t, y in zip(texts, toxic, strict=True):
            seen = set(map(cache.__getitem__, set(t.split())))
            counts[0][not y].update(seen)
            counts[1][not y].update({w[:n] for w in seen if w[:1].isalpha() for n in STEMS if len(w) > n})
        n_yes, n_no = max(1, int(toxic.sum())), max(1, len(toxic) - int(toxic.sum()))
        found: list[dict[str, float]] = []
        for yes, no in counts:
            odds = {w: v for w, c in yes.items() if w and c >= SUPPORT and (v := math.log((c + 0.5) / n_yes) - math.log((no[w] + 0.5) / n_no)) > 1.5}
            best = sorted(odds, key=lambda w: (-odds[w] * math.sqrt(yes[w]), w))[:ENTRIES]
            found.append({w: odds[w] for w in best})
        return cls(*found)


NAMES = ("hits", "hit_density", "strong", "strong_density", "best", "weight", "weight_density", "own_words", "person_density", "near", "near_density", "capitals", "shouting", "marks", "exclaiming", "inner", "apart", "stretched", "length")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: bytes, kinds: Kinds) -> list[float]:
    """One row of ``NAMES``. Few words tell anything, so only those are looked at again."""
    chunks = text.split()
    n, size = max(1, len(chunks)), max(1, len(text))
    codes = list(map(kinds.__getitem__, chunks))
    if any(codes):
        c = np.array(codes)
        at = np.flatnonzero(c)
        rows = kinds.table[c[at]]
    else:
        at, rows = np.zeros(0, int), np.zeros((0, 7))
    weight = rows[:, 0]
    hit = weight > 0
    places, persons = at[hit], at[rows[:, 2] > 0]
    near = 0
    if len(places) and len(persons):
        gap = np.searchsorted(persons, places)
        near = int((np.minimum(np.abs(persons[np.minimum(gap, len(persons) - 1)] - places), np.abs(persons[np.maximum(gap - 1, 0)] - places)) <= NEAR).sum())
    letters = at[rows[:, 6] > 0]
    apart = rows[:, 4].sum() + (int(((letters[2:] - letters[:-2]) == 2).sum()) if len(letters) > 2 else 0)
    hits, strong, total = int(hit.sum()), int((weight > 4).sum()), float(weight.sum())
    upper = size - len(text.translate(None, _CAPITALS)) if text else 0
    marks = size - len(text.translate(None, _MARKS)) if text else 0
    return [
        hits, hits / n, strong, strong / n, float(weight.max(initial=0.0)), total, total / n,
        float(rows[:, 1].sum()), len(persons) / n, near, near / n,
        upper / size, float(upper > 0.5 * size), marks / size, text.count(b"!") / size,
        float(rows[:, 3].sum()) / n, float(apart) / n, float(rows[:, 5].sum()) / n, math.log1p(n),
    ]


# ---- trees ----------------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted trees of a fixed depth as arrays: a node's children are 2i+1 and 2i+2."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
        n, k = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], 1)
        rate0 = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        start = math.log(rate0 / (1 - rate0))
        score = np.full(n, start)
        inner, leaves = 2**depth - 1, 2**depth
        feature, cut, leaf = np.zeros((rounds, inner), int), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
        for r in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, int)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                local = node - first
                best = np.zeros(count)
                for j in range(k):
                    size = bins + 1
                    at = local * size + binned[:, j]
                    gs = np.bincount(at, g, count * size).reshape(count, size).cumsum(1)
                    hs = np.bincount(at, h, count * size).reshape(count, size).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    gain = gain[:, : len(cuts[j])]
                    if not gain.shape[1]:
                        continue
                    where = gain.argmax(1)
                    value = gain[np.arange(count), where]
                    for c in np.flatnonzero(value > best + 1e-9):
                        best[c], feature[r, first + c], cut[r, first + c] = value[c], j, cuts[j][where[c]]
                node = 2 * node + 1 + (x[np.arange(n), feature[r, node]] > cut[r, node])
            local = node - inner
            value = rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + ridge)
            leaf[r], score = value, score + value[local]
        return cls(start, feature, cut, leaf)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a rising curve through the means of y."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, least x, greatest x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, top = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = top
    xs = [v for p in pools for v in (p[2], p[3])]
    ys = [p[0] / p[1] for p in pools for _ in range(2)]
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: np.ndarray
    levels: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        kinds = self.__dict__.setdefault("_kinds", Kinds(self.lexicon))
        x = np.array([features(t, kinds) for t in texts], float).reshape(len(texts), len(NAMES))
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.levels), 0.0, 1.0)


def fit(texts: list[bytes], toxic: np.ndarray, fold: np.ndarray) -> Model:
    """Lexicon and trees from four fifths of the rows, calibration from the rest (``fold`` 0);
    without both classes on both sides, one side serves for both."""
    if not len(texts) or len(set(toxic.tolist())) < 2:
        level = float(toxic.mean()) if len(texts) else 0.0
        none = np.zeros((1, 7), int)
        return Model(Lexicon({}, {}), Trees(0.0, none, np.full((1, 7), np.inf), np.zeros((1, 8))), np.array([0.0]), np.array([level]))
    held = fold == 0
    if any(len(set(toxic[m].tolist())) < 2 for m in (held, ~held)):
        held = np.ones(len(texts), bool)
        train = held
    else:
        train = ~held
    own = [t for t, m in zip(texts, train, strict=True) if m]
    lexicon = Lexicon.learn(own, toxic[train])
    # Entries are chosen by the very labels that the trees fit; in two halves, each half's
    # features come from the other half's lexicon, so that the trees see honest densities.
    half = np.arange(len(own)) % 2
    x = np.zeros((len(own), len(NAMES)))
    for h in (0, 1):
        other = Lexicon.learn([t for t, m in zip(own, half, strict=True) if m != h], toxic[train][half != h])
        kinds = Kinds(other)
        x[half == h] = [features(t, kinds) for t, m in zip(own, half, strict=True) if m == h]
    trees = Trees.fit(x, toxic[train].astype(float))
    kinds = Kinds(lexicon)
    margin = trees.margin(np.array([features(t, kinds) for t, m in zip(texts, held, strict=True) if m]))
    return Model(lexicon, trees, *isotonic(margin, toxic[held].astype(float)))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0; at most ``most`` of them, those
    with the least hashes of their ids. Rows with the same doc_id count once, with their least
    text; labels that contradict each other count as toxic. Null texts are empty. Without labels
    of both classes the score is their share of toxic ones (0 without any)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL AND toxic IN (0, 1)")
    marked = marked.where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id")
    # one text of each id, however many rows repeat it
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", as_bytes().alias("text"), "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(5))).alias("fold")).toPandas()
    rows = rows.sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)
    return fit([bytes(t) for t in rows["text"]], rows["toxic"].to_numpy(), rows["fold"].to_numpy())


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), score and predicted for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = b.column("text").to_pylist()
            s = held.value.scores(texts)
            yield {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out"), as_bytes().alias("text"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(held.value.scores(texts) < 0.5, pa.bool_()))

    configure(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, train(docs, labels))


def toxicity_of(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
