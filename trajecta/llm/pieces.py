"""SentencePiece encoding and decoding, with giant documents as a max-plus parallel scan.

The model is a BPE model: a text's pieces are its one path through the positions of the
normalised text in which every two neighbours are *compatible*, that is, encoding the two
strings together gives these two pieces again. With weight 0 for a compatible step and minus
infinity for any other, the path is the best path in the max-plus semiring, so a text can be
cut anywhere:

* the state at a cut is the piece that reaches or crosses it (and where it ends);
* a chunk gives a *transfer matrix* from the states at its left cut to those at its right
  cut, made without knowledge of the other chunks; matrices are sparse, with a few rows;
* matrices are combined associatively (a product of matrices, in a tree) to give the state at
  every cut, and then each chunk is traced back for itself from its two states.

No piece goes across the beginning of a word (a blank after something else); there, one state
remains. So a chunk's matrix is made by two short searches, from its left cut to its first
word beginning and from its last one to its right cut, and the part between is the same for
any state. A chunk inside one endless word has no such place and is searched through.

Texts up to ``GIANT`` characters are one chunk. Null text counts as empty and has no ids.
Decoding joins the pieces, bytes for byte pieces, and takes off the blank that encoding put
in front.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.bpe import place
from trajecta.llm.common import KEPT, arrow_map, saved, table

MODEL = "piece_bpe_32k.model"
#: Characters of a text that is cut, and of a chunk.
GIANT, CHUNK = 1 << 15, 1 << 14
#: Characters that a chunk sees of its neighbours; no piece may be longer.
MARGIN = 64
#: Words in a worker's cache, each of ``KEPT`` characters at most (about 200 bytes each).
CACHED = 150_000
BLANK = "▁"


class Pieces:
    """The model's pieces, words' ids, and which pieces may follow which."""

    def __init__(self, name: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=name if os.path.exists(name) else place(name))
        n = self.sp.vocab_size()
        text = [self.sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i)}
        self.text = text
        self.ids = {t: i for i, t in enumerate(text) if i not in special}
        self.longest = max(map(len, self.ids))
        if self.longest > MARGIN:
            raise ValueError(f"a piece of {self.longest} characters is longer than a chunk's margin of {MARGIN}")
        self.bytes = {int(text[i][3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        self.raw = [bytes([int(t[3:5], 16)]) if self.sp.is_byte(i) else b"" if self.sp.is_control(i) else t.replace(BLANK, " ").encode() for i, t in enumerate(text)]
        if any(BLANK in t.lstrip(BLANK) for t in self.ids):
            raise ValueError("a piece goes across the beginning of a word")
        self.words: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def encode_words(self, words: list[str]) -> None:
        """Learn words, given without the blank in front, which the library puts there."""
        if len(self.words) > CACHED:
            self.words.clear()
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            self.words.update((w, np.array(i, np.int32).tobytes()) for w, i in zip(part, self.sp.encode(part, num_threads=1), strict=True))
        if "" in self.words:  # a last blank alone, which the library cannot be asked for
            self.words[""] = np.array(self.emit(BLANK), np.int32).tobytes()

    def compatible(self, a: str, b: str) -> bool:
        """Whether the strings of two pieces, side by side, encode to these two pieces."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 1 << 20:
                self.fits.clear()
            got = self.fits[a, b] = self._split(a + b) == [x for x in (a, b) if x]
        return got

    def _split(self, s: str) -> list[str]:
        """Merges of a short string: always the best-scored neighbours, leftmost first."""
        parts = list(s)
        while True:
            best = None
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.sp.get_score(k) > best[0]):
                    best = (self.sp.get_score(k), i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def unit(self, s: str) -> bool:
        """A state's string: a piece that encodes to itself, or a character that has none."""
        if len(s) == 1:
            return True
        return s in self.ids and self.compatible("", s)

    def emit(self, unit: str) -> list[int]:
        k = self.ids.get(unit)
        return [k] if k is not None else [self.bytes[b] for b in unit.encode()]


@lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    return Pieces(name)


def normal(text: str) -> str:
    """The text as the model sees it: blanks made visible, one in front."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def plain_ids(texts: list[str], name: str) -> list[bytes]:
    """ids (packed int32) of texts that begin a word and are not cut: their words' ids.

    A word is one blank, or none in front, and all up to the next blank; runs of blanks are
    left to the library as part of the word that they lead.
    """
    p = pieces(name)
    out = []
    for i in range(0, len(texts), 64):
        split = [_words(t) for t in texts[i : i + 64]]
        missing = set().union(*split).difference(p.words)
        if len(p.words) + len(missing) > CACHED:
            p.words.clear()
            missing = set().union(*split)
        p.encode_words(list(missing))
        out += [b"".join(map(p.words.__getitem__, w)) for w in split]
        for w in missing:
            if len(w) > KEPT:
                del p.words[w]
    return out


def _words(text: str) -> list[str]:
    """Words of a raw text without the blank that leads each; extra blanks stay in front. The
    visible blank is a blank like the other."""
    if not text:
        return []
    parts = text.replace(BLANK, " ").split(" ")
    if "" not in parts:
        return parts
    out, blanks = [], 0
    for i, w in enumerate(parts):
        if w == "":
            blanks += 1
        else:
            out.append(" " * blanks + w)
            blanks = 0
    if blanks:
        out.append(" " * (blanks - 1))
    return out


# ---- max-plus scan --------------------------------------------------------------------
#
# A state is (end, string): the piece that ends at position ``end`` of the normalised text and
# reaches or crosses the cut. Matrices are dicts {left state: {right state: weight}}; weights
# are 0, so only the entries that are not minus infinity are kept.


def states_at(p: Pieces, text: str, cut: int) -> list[tuple[int, str]]:
    """Units of ``text`` that begin before the cut and end at it or after it."""
    out = []
    for begin in range(max(0, cut - p.longest), cut):
        for end in range(cut, min(len(text), begin + p.longest) + 1):
            if p.unit(s := text[begin:end]):
                out.append((end, s))
    return out


def forward(p: Pieces, text: str, start: tuple[int, str] | None, stop: int) -> dict[int, dict[str, tuple[int, str] | None]]:
    """All units reachable from the state ``start`` (None: the text's begin) with ends up to the
    first at or after ``stop``: by end, each unit with the state before it."""
    first = 0 if start is None else start[0]
    reach: dict[int, dict[str, tuple[int, str] | None]] = {first: {"" if start is None or start[1] == ANY else start[1]: None}}
    for at in range(first, stop):
        here = reach.get(at)
        if not here:
            continue
        for end in range(at + 1, min(len(text), at + p.longest) + 1):
            s = text[at:end]
            if not p.unit(s):
                continue
            for before in here:
                if before == "" or p.compatible(before, s):
                    reach.setdefault(end, {}).setdefault(s, (at, before))
                    break
    return reach


def word_begins(text: str, a: int, b: int) -> tuple[int, int] | None:
    """First and last position in [a, b] where a word begins (a blank after something else)."""
    first = next((i for i in range(max(a, 1), b + 1) if i < len(text) and text[i] == BLANK and text[i - 1] != BLANK), None)
    if first is None:
        return None
    last = next(i for i in range(b, first - 1, -1) if i < len(text) and text[i] == BLANK and text[i - 1] != BLANK)
    return first, last


#: The one state at a word's beginning, whatever the piece before it is.
ANY = ""


def transfer(p: Pieces, text: str, a: int, b: int, lefts: list, rights: list) -> dict:
    """The chunk's matrix between its cuts at ``a`` and ``b`` (positions in ``text``, which
    goes ``longest`` characters beyond both where the document does)."""
    rights_by = set(rights)
    inner = word_begins(text, a, b)
    out: dict = {}
    if inner is None:
        for left in lefts:
            ends = _ends(p, text, left, b, rights_by)
            if ends:
                out[left] = dict.fromkeys(ends, 0.0)
        return out
    first, last = inner
    tail = dict.fromkeys(_ends(p, text, (last, ANY), b, rights_by), 0.0)
    for left in lefts:  # reaches the word's beginning exactly, or not at all
        if left[0] <= first and (left[0] == first or first in forward(p, text, left, first)):
            out[left] = dict(tail)
    return out


def _ends(p: Pieces, text: str, left, b: int, rights: set) -> list:
    if left[0] >= b:
        return [left] if left in rights or left[1] == ANY else []
    start = (left[0], "") if left[1] == ANY else left
    got = forward(p, text, start, b)
    return [(end, s) for end, units in got.items() if end >= b for s in units if (end, s) in rights]


def product(x: dict, y: dict) -> dict:
    """Max-plus product of two matrices."""
    out: dict = {}
    for i, row in x.items():
        for k, w in row.items():
            for j, v in y.get(k, {}).items():
                best = out.setdefault(i, {})
                best[j] = max(best.get(j, float("-inf")), w + v)
    return out


def scan(matrices: list[dict]) -> list[dict]:
    """Products of the first 1, 2, ... matrices, by doubling: any grouping gives the same."""
    out, step = list(matrices), 1
    while step < len(out):
        out = [out[i] if i < step else product(out[i - step], out[i]) for i in range(len(out))]
        step *= 2
    return out


def traced(p: Pieces, text: str, a: int, b: int, left, right, name: str) -> list[int]:
    """ids of the units that end in (a, b], or beyond b for the unit that crosses b; the unit
    that crosses a belongs to the chunk before."""
    inner = word_begins(text, a, b)
    if inner is None or left[0] > inner[0]:
        return _path(p, text, left, right, b)
    first, last = inner
    head = _path(p, text, left, (first, None), first)
    middle = np.frombuffer(plain_ids([text[first + 1 : last].replace(BLANK, " ")], name)[0], np.int32).tolist() if last > first else []
    return head + middle + _path(p, text, (last, ""), right, b)


def _path(p: Pieces, text: str, left, right, stop: int) -> list[int]:
    if left[0] >= right[0]:
        return []
    got = forward(p, text, (left[0], "") if left[1] == ANY else left, stop)
    unit = right[1] if right[1] is not None else next(iter(got[right[0]]))
    state, out = (right[0], unit), []
    while state is not None and state[0] > left[0]:
        out.append(state[1])
        state = got[state[0]][state[1]]
    return [i for u in reversed(out) for i in p.emit(u)]


# ---- documents ------------------------------------------------------------------------


def _chunks(row_text: str) -> list[tuple[int, int]]:
    n = len(row_text)
    return [(a, min(n, a + CHUNK)) for a in range(0, n, CHUNK)]


def _rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and text of the documents of one chunk, and of those beyond ``GIANT`` characters."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where(F.length("text") <= GIANT), rows.where(F.length("text") > GIANT)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids (packed little-endian int32) of each row. Documents beyond ``GIANT``
    characters are cut and scanned. No rows: no rows. Equal rows each give a row."""
    small, giant = _rows(docs)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "ids": plain_ids(b.column("text").to_pylist(), model)}

    return arrow_map(small, whole, "doc_id long, ids binary").unionByName(_giant(giant, model))


def _giant(giant: DataFrame, model: str) -> DataFrame:
    # Each chunk is a row with a margin on both sides, so that tasks share a document's work.
    text = F.concat(F.lit(BLANK), F.translate("text", " ", BLANK))
    begin = F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(CHUNK))).alias("a")
    cut = giant.select("doc_id", F.expr("uuid()").alias("rid"), text.alias("text"))
    cut = saved(cut, "giant")  # the ids of rows must not change when a task runs again
    chunks = cut.select("doc_id", "rid", F.length("text").alias("n"), "text", begin).where("a < n")
    low = F.greatest(F.col("a") - MARGIN, F.lit(0))
    high = F.least(F.col("a") + CHUNK, F.col("n"))
    chunks = chunks.select("doc_id", "rid", "a", low.alias("low"), high.alias("b"), "n", F.col("text").substr(low + 1, high - low + MARGIN).alias("part"))
    chunks = saved(chunks.repartition("rid", "a"), "chunks", 32)

    def states(p: Pieces, part: str, low: int, at: int, n: int) -> list:
        if at == 0:
            return [(0, ANY)]
        local = at - low
        if part[local] == BLANK and part[local - 1] != BLANK if at < n else True:
            return [(local, ANY)]
        return states_at(p, part, local)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        p = pieces(model)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lefts, rights = states(p, r["part"], r["low"], r["a"], r["n"]), states(p, r["part"], r["low"], r["b"], r["n"])
                m = chunk_matrix(p, r["part"], r["a"] - r["low"], r["b"] - r["low"], lefts, rights)
                out.append(_packed(m, r["low"]))
            yield {"rid": batch.column("rid"), "a": batch.column("a"), "matrix": out}

    found = saved(arrow_map(chunks, matrices, "rid string, a long, matrix binary"), "matrices", 32)

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import pickle

        for batch in batches:
            for r in batch.to_pylist():
                listed = sorted(r["m"], key=lambda x: x["a"])
                each = [pickle.loads(x["matrix"]) for x in listed]
                done, start = scan(each), (0, ANY)
                ends = [next(iter(m[start])) for m in done]  # from the begin, one path is left
                # a state is final only where the rest can follow it: go back from the end
                state, path = ends[-1], [ends[-1]]
                for k in range(len(each) - 1, 0, -1):
                    state = next(i for i in done[k - 1][start] if state in each[k].get(i, {}))
                    path.append(state)
                path.reverse()
                yield {"rid": [r["rid"]] * len(each), "a": [x["a"] for x in listed], "left": [pickle.dumps(s) for s in [start, *path[:-1]]], "right": [pickle.dumps(s) for s in path]}

    by_doc = found.groupBy("rid").agg(F.collect_list(F.struct("a", "matrix")).alias("m"))  # less than the document's own text
    ends = saved(arrow_map(by_doc, combined, "rid string, a long, left binary, right binary"), "states", 32)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import pickle

        p = pieces(model)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                (le, ls), (re, rs), low = pickle.loads(r["left"]), pickle.loads(r["right"]), r["low"]
                right = (re - low, None if rs == ANY else rs)
                out.append(np.array(traced(p, r["part"], r["a"] - low, r["b"] - low, (le - low, ls), right, model), np.int32).tobytes())
            yield {"doc_id": batch.column("doc_id"), "rid": batch.column("rid"), "a": batch.column("a"), "ids": out}

    parts = saved(arrow_map(chunks.join(ends, ["rid", "a"]), trace, "doc_id long, rid string, a long, ids binary"), "traced", 32)
    whole = parts.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("a", "ids"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "ids": [b"".join(x["ids"] for x in r) for r in b.column("parts").to_pylist()]}

    return arrow_map(whole.select("doc_id", "parts"), joined, "doc_id long, ids binary")


def chunk_matrix(p: Pieces, part: str, a: int, b: int, lefts: list, rights: list) -> dict:
    """``transfer`` where a cut at a word's beginning has the one state ``ANY``."""
    exact = rights[0][1] == ANY
    if not exact:
        return transfer(p, part, a, b, lefts, rights)
    out = {}
    for left in lefts:
        inner = word_begins(part, a, b)
        if inner is not None and left[0] <= inner[0]:
            ok = left[0] == inner[0] or inner[0] in forward(p, part, (left[0], "") if left[1] == ANY else left, inner[0])
            ok = ok and (inner[1] == b or b in forward(p, part, (inner[1], ""), b))
        else:
            ok = left[0] == b or b in forward(p, part, (left[0], "") if left[1] == ANY else left, b)
        if ok:
            out[left] = {rights[0]: 0.0}
    return out


def _packed(m: dict, low: int) -> bytes:
    """A matrix with positions of the document instead of the part's."""
    import pickle

    return pickle.dumps({(i[0] + low, i[1]): {(j[0] + low, j[1]): w for j, w in row.items()} for i, row in m.items()})


def decode_ids(ids: bytes, model: str = MODEL) -> str:
    p = pieces(model)
    raw = b"".join(map(p.raw.__getitem__, np.frombuffer(ids, np.int32).tolist()))
    return raw[1:].decode("utf-8", "replace") if raw.startswith(b" ") else raw.decode("utf-8", "replace")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Encode, decode: doc_id, n_pieces, ids_crc32 (of the ids as little-endian u32),
    decoded_bytes and decoded_crc32 (of the decoded text's UTF-8)."""

    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_bytes long, decoded_crc32 long"
    small, giant = _rows(docs)

    def told(doc_id: pa.Array, ids: list[bytes]) -> dict:
        text = [decode_ids(i, model).encode() for i in ids]
        return {"doc_id": doc_id, "n_pieces": [len(i) // 4 for i in ids], "ids_crc32": list(map(zlib.crc32, ids)), "decoded_bytes": list(map(len, text)), "decoded_crc32": list(map(zlib.crc32, text))}

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:  # in one worker: a second one would hold the model again
        for b in batches:
            yield told(b.column("doc_id"), plain_ids(b.column("text").to_pylist(), model))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield told(b.column("doc_id"), b.column("ids").to_pylist())

    return arrow_map(small, both, schema).unionByName(arrow_map(_giant(giant, model), back, schema))


def pieces_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
