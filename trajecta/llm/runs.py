"""Periodic runs of words: maximal stretches that repeat with a period, found by the runs theorem.

Every run contains, for one of the two orders of the alphabet, a root that is a longest Lyndon
word: it starts at some word i and ends at the next suffix that is smaller, so the roots are the
next-smaller values of the inverse suffix array, once for each order. A root [i, j) is extended
to the right by the common prefix of the suffixes i and j and to the left by the common suffix
of what ends before them; both come from LCP arrays by range minima (a sparse table over blocks).

The work of a document is one worker's, many documents at a time by arrays: suffix arrays by
doubling (only groups that still tie are sorted again), LCP by Kasai's pass. Before that, words
are left out that cannot lie in a run: with length >= max(least, times * q), the words that are
``least - least // times`` before the end of a run's overlap with itself start again q words
later. So a run lies wholly within words that are covered by sequences of that many words which
occur twice, and it is as maximal there as in the whole document. Nothing else is left out, and
all words of all documents go through that test.

Null text: no words, no runs. Empty and blank texts: the same. A text of one word that repeats
is one run of period 1. Repeated rows are rows of their own. Null ids keep their row (the
query's rewriting leaves their words as they are). An empty table gives an empty result. Extra
columns are not read, so their names cannot clash. Memory of a worker grows with the largest
single document (about 150 bytes for each word that may lie in a run).
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import arrow_map, as_bytes, steps
from trajecta.llm.wordhash import mixed, run_hashes

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 24, 3
_BLOCK = 16


class RangeMin:
    """Minima of ranges of an array: scans of ``_BLOCK`` at both ends, a sparse table between."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        blocks = np.minimum.reduceat(values, np.arange(0, len(values), _BLOCK)) if len(values) else values
        self.levels = [blocks]
        while 2 << len(self.levels) - 1 <= len(blocks):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest of values[low..high], both ends included, low <= high."""
        out = self.values[low]
        for t in range(_BLOCK):
            np.minimum(out, self.values[np.minimum(low + t, high)], out=out)
            np.minimum(out, self.values[np.maximum(high - t, low)], out=out)
        first, last = low // _BLOCK + 1, high // _BLOCK - 1
        far = np.flatnonzero(first <= last)
        if len(far):
            a, b = first[far], last[far]
            level = np.frexp(b - a + 1)[1] - 1
            for k in np.unique(level):
                at = level == k
                table = self.levels[k]
                out[far[at]] = np.minimum(out[far[at]], np.minimum(table[a[at]], table[b[at] - (1 << int(k)) + 1]))
        return out


def suffix_order(letters: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse for stretches in a row; ``end`` is where each place's stretch
    ends and letters of different stretches differ. A suffix is smaller than what it begins."""
    n = len(letters)
    place = np.argsort(letters, kind="stable")
    got = letters[place]
    new = np.concatenate([[True], got[1:] != got[:-1]])
    rank = np.empty(n, np.int64)
    rank[place] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = np.concatenate([new[1:], [True]]) & new
    open_ = np.sort(place[~alone])
    width = 1
    while len(open_):
        after = open_ + width
        inside = after < end[open_]
        then = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        key = rank[open_] * (n + 1) + then
        by = np.argsort(key)
        key, at = key[by], open_[by]
        group = rank[at]
        index = np.arange(len(at))
        begins = np.concatenate([[True], group[1:] != group[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = group + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(begins, index, 0))
        alone = np.concatenate([new[1:], [True]]) & new
        open_ = at[~alone]
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, rank


def common_prefixes(letters: np.ndarray, order: np.ndarray, rank: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place of the suffix array, how much its suffix shares with the one before."""
    x, sa, at, stop = letters.tolist(), order.tolist(), rank.tolist(), end.tolist()
    out, h = [0] * len(x), 0
    for i, r in enumerate(at):
        if not r:
            h = 0
            continue
        j = sa[r - 1]
        most = min(stop[i] - i, stop[j] - j)
        while h < most and x[i + h] == x[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return np.array(out, np.int64)


def next_smaller(rank: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word of each place ends."""
    value, stop = rank.tolist(), end.tolist()
    out = [0] * len(value)
    for i in range(len(value) - 1, -1, -1):
        j, e, v = i + 1, stop[i], value[i]
        while j < e and value[j] > v:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


class Extender:
    """Common prefixes of suffixes, by range minima over the LCP array."""

    def __init__(self, letters: np.ndarray, end: np.ndarray) -> None:
        order, self.rank = suffix_order(letters, end)
        self.least = RangeMin(common_prefixes(letters, order, self.rank, end))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.rank[a], self.rank[b]
        return self.least(np.minimum(x, y) + 1, np.maximum(x, y))


def _covered(words: np.ndarray, part: np.ndarray, width: int) -> np.ndarray:
    """Which places lie in a sequence of ``width`` words that occurs twice within its part."""
    out = np.zeros(len(words), bool)
    if len(words) < width:
        return out
    h = run_hashes(words.astype(np.uint64), width)
    inside = np.flatnonzero(part[: len(h)] == part[width - 1 :])
    h = h[inside] ^ mixed(part[inside].astype(np.uint64))
    by = np.argsort(h)
    same = h[by[1:]] == h[by[:-1]]
    twice = inside[by[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(by) else inside
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return np.cumsum(edge[:-1]) > 0


def find_runs(words: np.ndarray, part: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first word, length and period of all runs, by place and then period; ``words``
    are numbers (equal for equal words) and ``part`` ascending numbers of the documents."""
    if times < 3:
        raise ValueError("a run must go on for three periods at least")
    place = np.arange(len(words))
    width = max(1, least - least // times)
    for _ in range(4):  # what occurs twice in a document need not do so within its stretch
        keep = _covered(words, part, width)
        if keep.all():
            break
        place, words, part = place[keep], words[keep], part[keep]
        if len(place):
            part = np.cumsum(np.concatenate([[0], (np.diff(place) != 1) | (np.diff(part) != 0)]))
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none, none
    n = len(place)
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(part) != 0)]))
    size = np.diff(np.append(begins, n))
    which = np.repeat(np.arange(len(begins)), size)
    begin, end = begins[which], (begins + size)[which]
    letter = np.unique(words, return_inverse=True)[1].astype(np.int64)
    kinds = int(letter.max()) + 1
    upward, downward = which * kinds + letter, which * kinds + (kinds - 1 - letter)
    right = Extender(upward, end)
    left = Extender(upward[::-1], (n - begin)[::-1])
    roots = []
    for rank in (right.rank, suffix_order(downward, end)[1]):
        stop = next_smaller(rank, end)
        i = np.flatnonzero((stop < end) & (times * (stop - np.arange(n)) <= end - begin))
        i = i[upward[i] == upward[stop[i]]]  # the leftmost root in a run of three periods goes on
        roots.append(np.stack([i, stop[i]]))
    i, j = np.concatenate(roots, axis=1)
    if not len(i):
        return none, none, none
    more = right(i, j)
    before = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > begin[i])
    before[inner] = left(n - i[inner], n - j[inner])
    period, start = j - i, i - before
    length = j + more - start
    good = length >= np.maximum(least, times * period)
    found = np.unique(np.stack([place[start[good]], period[good], length[good]]), axis=1)
    return found[0], found[2], found[1]


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's words: one document in ten goes on periodically from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def _batches(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[tuple[list, list[list[bytes]], np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Ids and words of some documents, where each begins, and all their runs."""
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        for low, high in steps(texts):
            docs = [t.split() for t in texts[low:high]]
            if rewrite:
                docs = [rewrite(i, w) for i, w in zip(ids[low:high], docs, strict=True)]
            sizes = np.fromiter(map(len, docs), np.int64, len(docs))
            known: defaultdict[bytes, int] = defaultdict(count().__next__)
            number = np.fromiter((n for w in docs for n in map(known.__getitem__, w)), np.int64, int(sizes.sum()))
            yield ids[low:high], docs, np.concatenate([[0], np.cumsum(sizes)]), find_runs(number, np.repeat(np.arange(len(docs)), sizes))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, start (number of the first word), length, period of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, _, begin, (at, length, period) in _batches(batches, rewrite):
            doc = np.searchsorted(begin, at, "right") - 1
            yield {"doc_id": [ids[d] for d in doc], "start": at - begin[doc], "length": length, "period": period}

    return arrow_map(_rows(docs), run, "doc_id long, start long, length long, period long")


def collapsed(words: list[bytes], start: list[int], length: list[int], period: list[int]) -> bytes:
    """The text without what repeats: of each run only its first period stays."""
    if not start:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.add(start, period), 1)
    np.add.at(edge, np.add(start, length), -1)
    return b" ".join([w for w, off in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not off])


def without_repeats(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id and text of every document with each run cut to its first period (words joined by
    one space; null text becomes empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, words, begin, found in _batches(batches, rewrite):
            cut = _by_document(begin, found)
            yield {"doc_id": ids, "text": [collapsed(w, *cut[k]).decode() for k, w in enumerate(words)]}

    return arrow_map(_rows(docs), run, "doc_id long, text string")


def _by_document(begin: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[list[int], list[int], list[int]]]:
    at, length, period = found
    edge = np.searchsorted(at, begin)
    return [((at[a:b] - o).tolist(), length[a:b].tolist(), period[a:b].tolist()) for a, b, o in zip(edge[:-1].tolist(), edge[1:].tolist(), begin[:-1].tolist(), strict=True)]


def run_digest(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row for each document: how many runs, the one with the greatest exponent, digests of
    all runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, docs_, begin, found in _batches(batches, rewrite):
            out: dict[str, list] = {n: [] for n in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
            for words, (s, l, p) in zip(docs_, _by_document(begin, found), strict=True):
                best = max(zip(s, l, p, strict=True), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
                out["n_runs"].append(len(s))
                for name, value in zip(("start", "length", "period"), best, strict=True):
                    out[name].append(value)
                out["exponent_milli"].append(None if best[0] is None else 1000 * best[1] // best[2])
                out["runs_sha256"].append(hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in zip(s, l, p, strict=True)).encode()).hexdigest())
                out["collapsed_sha256"].append(hashlib.sha256(collapsed(words, s, l, p)).hexdigest())
            yield {"doc_id": ids} | out

    return arrow_map(_rows(docs), run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
