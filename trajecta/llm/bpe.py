"""Token counts and token ids of a word-level BPE vocabulary, without a shuffle of pre-tokens.

The library splits a text at white space before it merges anything, so a text's ids are
the ids of its white-space-separated chunks, one after the other. Merges are made for many
words at a time by arrays (:class:`ChunkEncoder`). To count tokens, a chunk's number is looked
up

1. in a broadcast table of the corpus's frequent chunks (bounded by ``FREQUENT`` entries),
2. in the worker's own cache (bounded by ``CACHED`` entries),
3. and only then the chunk is encoded, many missed ones at a time.

Nulls count as the empty text; rows keep their number and order; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import BYTES_PER_STEP, KEPT, arrow_map, as_bytes, steps

VOCABULARY = "word_bpe_49k.json"
#: Entries of the broadcast table, and of one task's summary for it.
FREQUENT, SUMMARY = 16_384, 8_192
#: Entries of a worker's cache of chunks; each has ``KEPT`` bytes at most.
CACHED = 400_000
#: Hard chunks in one call of the library.
_JOINED = 200


def place(name: str) -> str:
    """A vocabulary's file: a path, or the name of a public vocabulary."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """Byte-pair merges of many words at once, by arrays. Each round takes, in every word, the
    pair of the least rank (the leftmost of equal ones), as a queue would, one after the other."""

    NONE, BITS = np.int64((1 << 31) - 1), 18

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        sign = dict(zip(plain, map(chr, plain), strict=True)) | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(plain)))}
        self.first = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[sign[b] + end] for b in range(256)], np.int64)
        pair = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.keys, self.ranks = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, self.NONE)
        rank, at = np.arange(len(pair)), self._slot(pair)
        while len(rank):  # whoever comes first in a slot stays, the others go on
            free = self.keys[at] < 0
            _, one = np.unique(np.where(free, at, -1 - at), return_index=True)
            one = one[free[one]]
            self.keys[at[one]], self.ranks[at[one]] = pair[rank[one]], rank[one]
            rank, at = np.delete(rank, one), np.delete(at + 1 & (1 << self.BITS) - 1, one)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _rank(self, pair: np.ndarray) -> np.ndarray:
        at = self._slot(pair)
        got = self.keys[at]
        out = np.where(got == pair, self.ranks[at], self.NONE)
        on = np.flatnonzero((got != pair) & (got >= 0))
        while len(on):
            at[on] = at[on] + 1 & (1 << self.BITS) - 1
            got = self.keys[at[on]]
            hit = got == pair[on]
            out[on[hit]] = self.ranks[at[on[hit]]]
            on = on[~hit & (got >= 0)]
        return out

    def encode(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words in order, and how many each word has. ``raw`` has the words' bytes, one
        after the other, ``size`` their lengths; no word is empty."""
        ends = np.cumsum(size)
        t = self.first[raw]
        t[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(size)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(t):
            edge = np.append(np.flatnonzero(owner[1:] != owner[:-1]), len(t) - 1)
            rank = np.append(self._rank(t[:-1] << 32 | t[1:]), self.NONE)
            rank[edge] = self.NONE  # no pair goes across words
            begin = np.append(0, edge[:-1] + 1)
            best = np.minimum.reduceat(rank << 31 | np.arange(len(t)), begin)
            more = best >> 31 != self.NONE
            at = best[more] & (1 << 31) - 1
            t[at] = self.made[best[more] >> 31]
            stay = np.repeat(more, edge + 1 - begin)
            done.append((owner[~stay], t[~stay]))
            stay[at + 1] = False
            t, owner = t[stay], owner[stay]
        owner, t = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        return t[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(size))


#: Kinds of bytes: white space, letter, mark, digit, and what only the library can judge.
SPACE, LETTER, MARK, DIGIT, HARD = range(5)
#: Longer runs are left to the library.
LONG = 32


def _kinds() -> np.ndarray:
    """The kind of each byte alone: ASCII but for the apostrophe (it joins letters), the sign
    that special tokens begin with and controls. All else is hard until seen with its lead."""
    out = np.full(256, HARD, np.int8)
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    for b in range(33, 127):
        out[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
    out[list(b"'<")] = HARD
    return out


_KIND = _kinds()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class ChunkEncoder:
    """Token ids of texts. White space ends a chunk. A chunk of ASCII and Latin-1 letters, marks
    and digits is cut into its pre-tokens (a run of letters, a run of marks, or one digit),
    all by arrays; any other goes to the library whole. Of equal pre-tokens of a step, one is
    merged; the chunks that went to the library are kept in a bounded cache."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(place(name))
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        model = json.loads(self.tok.to_str())["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.chunks: dict[bytes, np.ndarray] = {}

    def learn(self, chunks: set[bytes]) -> None:
        """Put hard chunks into the cache: many to a call, with a special token of known id
        between them."""
        if len(self.chunks) + len(chunks) > CACHED:
            self.chunks.clear()
        listed = sorted(chunks)
        name, cut = next(((t.content, i) for i, t in self.tok.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip)), (None, None))
        texts = [c.decode() for c in listed]
        joined = [k for k, t in enumerate(texts) if name and "<|" not in t and "|>" not in t]
        for i in range(0, len(joined), _JOINED):
            group = joined[i : i + _JOINED]
            ids = np.array(self.tok.encode_batch_fast([f" {name} ".join(texts[k] for k in group)], add_special_tokens=False)[0].ids, self.dtype)
            edge = [-1, *np.flatnonzero(ids == cut).tolist(), len(ids)]
            assert len(edge) == len(group) + 1
            for n, k in enumerate(group):
                self.chunks[listed[k]] = ids[edge[n] + 1 : edge[n + 1]].copy()  # a view would keep the others' ids too
        for k in sorted(set(range(len(texts))).difference(joined)):
            self.chunks[listed[k]] = np.array(self.tok.encode(texts[k], add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in order, and the number of ids of each text."""
        at, owner, ids, begin, count = self._units(texts)
        size = count[at]
        total = np.bincount(owner, size, len(texts)).astype(np.int64)
        where = np.repeat(begin[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return ids[where], total

    def counts(self, texts: list[bytes]) -> np.ndarray:
        at, owner, _, _, count = self._units(texts)
        return np.bincount(owner, count[at], len(texts)).astype(np.int64)

    def _units(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """The pre-tokens and hard chunks of all texts in order: which different one each is, and
        its text; then the ids of the different ones, where each one's begin, and how many."""
        line = b" ".join([*texts, b" " * (LONG + 8)])
        raw = _LOWER[np.frombuffer(line, np.uint8)]
        kind = _KIND[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)  # U+00C0 to U+00FF: two bytes, the second from 0x80 on
        if len(lead):
            second = raw[lead + 1]
            lead, second = lead[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
            kind[lead] = kind[lead + 1] = LETTER
            raw[lead + 1] = second + np.where(second < 0x9F, 0x20, 0).astype(np.uint8)
        full = kind != SPACE
        edge = np.flatnonzero(full[1:] != full[:-1]) + 1
        edge = np.concatenate([[0], edge]) if full[0] else edge
        chunk = edge[::2], edge[1::2]  # begin and end of each chunk; the line ends in spaces
        hard = np.flatnonzero(kind == HARD)
        split = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        starts = np.flatnonzero(np.concatenate([[True], split]) & full)
        ends = np.flatnonzero(np.concatenate([split, [True]]) & full) + 1
        tough = np.zeros(len(chunk[0]), bool)
        tough[np.searchsorted(chunk[0], hard, "right") - 1] = True
        long = starts[ends - starts > LONG]
        tough[np.searchsorted(chunk[0], long, "right") - 1] = True
        if tough.any():
            plain = ~tough[np.searchsorted(chunk[0], starts, "right") - 1]
            starts, ends = starts[plain], ends[plain]
        one, at = self._different(raw, starts, ends)
        ids, begin, count = self._merged(raw, starts[one], ends[one])
        where = starts
        if tough.any():
            a, b = chunk[0][tough], chunk[1][tough]
            listed = [line[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            every = set(listed)
            missing = every.difference(self.chunks)
            if len(self.chunks) + len(missing) > CACHED:
                missing = every
            if missing:
                self.learn(missing)
            index = {c: k for k, c in enumerate(every)}
            each = [self.chunks[c] for c in index]
            for c in missing:
                if len(c) > KEPT:
                    del self.chunks[c]
            size = np.fromiter(map(len, each), np.int64, len(each))
            at = np.concatenate([at, len(count) + np.fromiter(map(index.__getitem__, listed), np.int64, len(listed))])
            begin = np.concatenate([begin, len(ids) + np.cumsum(size) - size])
            ids, count, where = np.concatenate([ids, *each]), np.concatenate([count, size]), np.concatenate([where, a])
            order = np.argsort(where, kind="stable")
            at, where = at[order], where[order]
        bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return at, np.searchsorted(bounds, where, "right"), ids, begin, count

    @staticmethod
    def _different(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each different run (runs are their bytes, as four numbers); for each run,
        which one it is."""
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        size = ends - starts
        at, short = np.empty(len(starts), np.int64), np.flatnonzero(size <= 8)
        first = words[starts[short]] & _MASK[size[short]]
        order = np.argsort(first)
        ordered = first[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(order)]
        at[short[order]] = np.cumsum(new) - 1
        one = short[order[new]]
        wide = np.flatnonzero(size > 8)
        if not len(wide):
            return one, at
        key = [words[starts[wide] + 8 * k] & _MASK[np.clip(size[wide] - 8 * k, 0, 8)] for k in range(LONG // 8)]
        mix = key[0].copy()
        for x in key[1:]:
            mix = (mix ^ mix >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + x
        order = np.argsort(mix)
        same = mix[order[1:]] == mix[order[:-1]]
        if any(bool((x[order[1:]] != x[order[:-1]])[same].any()) for x in key):  # two runs with one mix: the plain way
            order = np.lexsort(key)
            same = np.all([x[order[1:]] == x[order[:-1]] for x in key], 0)
        new = np.concatenate([[True], ~same])
        at[wide[order]] = len(one) + np.cumsum(new) - 1
        return np.concatenate([one, wide[order[new]]]), at

    def _merged(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """ids of the runs, where each one's begin, and how many they are."""
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = ends - starts
        flat = raw[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())]
        ids, count = self.merges.encode(flat, size)
        return ids.astype(self.dtype), np.cumsum(count) - count, count


@lru_cache(maxsize=2)
def encoder(name: str) -> ChunkEncoder:
    return ChunkEncoder(name)


def encoded(texts: list[bytes], name: str) -> Iterator[np.ndarray]:
    """ids of each text."""
    enc = encoder(name)
    for i, j in steps(texts):
        ids, count = enc.encode(texts[i:j])
        yield from np.split(ids, np.cumsum(count)[:-1])


def _merge(a: bytes, b: bytes) -> bytes:
    import pickle

    total = Counter(pickle.loads(a))
    total.update(pickle.loads(b))
    return pickle.dumps(dict(total.most_common(2 * SUMMARY)))


def frequent_chunks(docs: DataFrame, entries: int = FREQUENT) -> list[bytes]:
    """The corpus's frequent chunks, from all texts: every task sums up its own chunks in a
    bounded summary, and summaries are merged by a tree, so the driver gets one of them. Chunks
    over ``KEPT`` bytes are left out, so summaries and the broadcast are bounded in bytes."""
    import pickle

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                chunks = t.split()
                if max(map(len, chunks), default=0) > KEPT:  # long ones are misses wherever they occur
                    chunks = [c for c in chunks if len(c) <= KEPT]
                seen.update(chunks)
                if len(seen) > 40 * SUMMARY:
                    seen = Counter(dict(seen.most_common(10 * SUMMARY)))
        yield {"part": [pickle.dumps(dict(seen.most_common(SUMMARY)))]}

    parts = arrow_map(docs.select(as_bytes().alias("text")), summary, "part binary").rdd.map(lambda r: bytes(r["part"]))
    found = pickle.loads(parts.treeReduce(_merge, depth=2)) if parts.getNumPartitions() else {}
    return [c for c, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:entries]]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Empty table: empty result. Null or empty text: zero bytes, zero tokens. Repeated rows
    each give a row. Long texts are split by chunks only, so nothing is truncated.
    """
    common = frequent_chunks(docs)
    lengths = docs.sparkSession.sparkContext.broadcast(dict(zip(common, ChunkEncoder(vocabulary).counts(common).tolist(), strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, frequent = encoder(vocabulary), lengths.value
        cache: dict[bytes, int] = dict(frequent)
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            n_tokens = []
            for i, j in steps(texts, BYTES_PER_STEP // 2):
                split = [t.split() for t in texts[i:j]]
                missing = set().union(*split).difference(cache)
                if len(cache) + len(missing) > CACHED:
                    cache = dict(frequent)
                    missing = set().union(*split).difference(cache)
                listed = list(missing)
                for k, m in steps(listed):
                    cache.update(zip(listed[k:m], own.counts(listed[k:m]).tolist(), strict=True))
                n_tokens += [sum(map(cache.__getitem__, chunks)) for chunks in split]
                for c in listed:
                    if len(c) > KEPT:
                        del cache[c]
            yield {"doc_id": ids, "n_bytes": [len(t) for t in texts], "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens]}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
