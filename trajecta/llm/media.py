"""GIF columns: code streams, palettes, disposal, transparency, timed frames, colour histograms.

``encode_gif`` stores bytes as the 8-bit colour indices of an animation (24 x 24 pixels a
frame, LZW compressed, a palette of 3, 3 and 2 bits of red, green and blue; index 255, which
also fills the last frame, is transparent). ``decode_gif`` is a decoder for any GIF: it reads
global and local palettes, interlacing, transparency, the disposal methods and delays, and it
expands LZW code streams of many frames together, by pointer doubling over arrays instead of a
loop over codes; tables that stay full for long are followed. Colour histograms are those of
the frames as a viewer shows them. Nulls count as the empty payload; damaged files raise
ValueError. No rows: no rows; equal rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import arrow_map, as_bytes, steps

SIDE = 24
FRAME = SIDE * SIDE
#: Colours of a histogram: the two upper bits of red, green and blue.
COLOURS = 64
#: Bytes of code streams that are laid side by side at once.
STREAMS = 1 << 21


# ---- code streams ---------------------------------------------------------------------


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of the first ``n`` codes after a clear code: entry clear + 2 + (j - 1) exists when
    code j is read, and no code has more than 12 bits."""
    filled = (1 << size) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(12, np.maximum(size + 1, np.ceil(np.log2(filled + 1)).astype(int)))


def _codes(frame: bytes) -> list[int]:
    """A frame's codes between the clear and the end code; the table never fills up in one."""
    known: dict[int, int] = {}
    out, find, free, now = [], known.get, 258, frame[0]
    for pixel in frame[1:]:
        key = now << 8 | pixel
        code = find(key)
        if code is None:
            out.append(now)
            known[key] = free
            free += 1
            now = pixel
        else:
            now = code
    out.append(now)
    return out


_WIDTHS = _widths(FRAME + 1, 8)


def lzw_encode(frames: list[bytes]) -> list[bytes]:
    """Code streams of whole frames: a clear code, the frame's codes, the end code."""
    each = [_codes(f) for f in frames]
    count = np.fromiter(map(len, each), np.int64, len(each)) + 2
    codes = np.fromiter((c for x in each for c in (256, *x, 257)), np.int64, int(count.sum()))
    first = np.cumsum(count) - count
    place = np.arange(len(codes)) - np.repeat(first, count) - 1
    bits = np.where(place < 0, 9, _WIDTHS[np.maximum(place, 0)])
    size = -(-np.add.reduceat(bits, first) // 8)
    begin = np.cumsum(size) - size
    total = np.cumsum(bits) - bits
    at = total - np.repeat(total[first], count) + 8 * np.repeat(begin, count)
    out = np.zeros(int(size.sum()) + 3, np.uint8)
    shifted = codes << (at & 7)
    for k in range(3):  # bits of different codes do not meet, so adding is setting
        np.add.at(out, (at >> 3) + k, (shifted >> 8 * k & 255).astype(np.uint8))
    raw = out.tobytes()
    return [raw[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]


def _expand(codes: np.ndarray, count: np.ndarray, clear: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of segments between clear codes: (s, k) codes, of which count[s] are real.

    Entry clear + 2 + j is the string of code j and one more pixel, the next one in the
    output; so it is a copy of the output from where code j begins. Lengths and pixels both
    follow by jumping along these pointers until all point at literals.
    """
    s = len(codes)
    k = int(count.max(initial=0))
    codes = codes[:, :k].astype(np.int64) if (codes[:, :k] >= clear).any() else codes[:, :k]
    real = np.arange(k) < count[:, None]
    literal = codes < clear
    if codes.dtype != np.int64 or bool(np.all(literal | ~real)):
        return codes.astype(np.uint8), count.copy()
    parent = np.where(literal | ~real, np.arange(k), codes - clear - 2)
    if bool(np.any(real & ~literal & ((parent < 0) | (parent >= np.arange(k))))):
        raise ValueError("a code refers to an entry that does not exist")
    length, up = np.where(literal | ~real, 0, 1), parent
    while True:
        more = np.take_along_axis(length, up, 1)
        if not more.any():
            break
        length, up = length + more, np.take_along_axis(up, up, 1)
    length = np.where(real, length + 1, 0)
    ends = np.cumsum(length, 1)
    begin, total = ends - length, ends[:, -1]
    width = int(total.max(initial=0))
    row = np.repeat(np.repeat(np.arange(s), k), length.ravel())
    code = np.repeat(np.tile(np.arange(k), s), length.ravel())
    within = np.arange(len(row)) - np.repeat(begin.ravel() + np.repeat(np.cumsum(total) - total, k), length.ravel())
    at = row * width + begin[row, code] + within
    source = np.where(literal[row, code], at, row * width + begin[row, parent[row, code]] + within)
    # the last pixel of an entry is the pixel after its prefix, which is in the output too
    flat = np.arange(s * width)
    flat[at] = source
    value = np.zeros(s * width, np.uint8)
    lit = literal[row, code]
    value[at[lit]] = codes[row[lit], code[lit]]
    while True:
        nxt = flat[flat]
        if np.array_equal(nxt, flat):
            break
        flat = nxt
    return value[flat].reshape(s, width), total


def lzw_decode(streams: list[bytes], size: int, pixels: list[int]) -> list[np.ndarray]:
    """Pixels of many code streams with the same minimum code size, segment by segment in step."""
    clear, out = 1 << size, [[] for _ in streams]
    longest = max((len(x) for x in streams), default=0) + 16
    data = np.zeros((len(streams), longest), np.uint8)
    for i, x in enumerate(streams):
        data[i, : len(x)] = np.frombuffer(x, np.uint8)
    limit = longest * 8 // (size + 1) + 1  # a full table may stay until the stream ends
    width = _widths(limit, size)
    offset = np.concatenate([[0], np.cumsum(width)])
    bit, open_ = np.zeros(len(streams), np.int64), np.arange(len(streams))
    # the three bytes from each byte on: a code has 12 bits at most and begins in the first
    words = data[:, :-2].astype(np.int32) | data[:, 1:-1].astype(np.int32) << 8 | data[:, 2:].astype(np.int32) << 16
    sizes = np.array([len(x) * 8 for x in streams])
    while len(open_):
        window = 256
        while True:
            w = min(window, limit)
            if len(open_) == len(streams) and bool((bit == bit[0]).all()):  # all in step: plain columns
                pos = (bit[0] + offset[:w])[None, :]
                word = words[:, np.minimum(pos[0] >> 3, longest - 4)]
            else:
                pos = bit[open_, None] + offset[:w]
                word = words[open_[:, None], np.minimum(pos >> 3, longest - 4)]
            inside = pos + width[:w] <= (longest - 4) * 8
            codes = (word >> (pos & 7).astype(np.int32)) & ((1 << width[:w]) - 1).astype(np.int32)
            stop = (codes == clear) | (codes == clear + 1) | ~inside
            if w == limit or bool(stop.any(1).all()):
                break
            window *= 4
        n = np.where(stop.any(1), stop.argmax(1), w)
        values, total = _expand(codes, n, clear)
        for r, i in enumerate(open_):
            if total[r]:
                out[i].append(values[r, : total[r]])
        last = np.where(n < w, codes[np.arange(len(open_)), np.minimum(n, w - 1)], clear + 1)
        bit[open_] += offset[np.minimum(n + 1, len(offset) - 1)]
        more = (last == clear) & (bit[open_] < sizes[open_])
        open_ = open_[more]
    joined = [np.concatenate(x) if x else np.zeros(0, np.uint8) for x in out]
    if any(len(x) < n for x, n in zip(joined, pixels, strict=True)):
        raise ValueError("a code stream ends before its frame is full")
    return [x[:n] for x, n in zip(joined, pixels, strict=True)]


# ---- the container --------------------------------------------------------------------

CLEAR = 255
_PALETTE = bytes(v for i in range(256) for v in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85))
_HEAD = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + _PALETTE
_LOOP = b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
_BEFORE = b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2 | 1, 10, CLEAR) + b"\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"


def encode_gif(payloads: list[bytes]) -> list[bytes]:
    """Animations whose pixels are the payloads' bytes; each a positive multiple of 576."""
    streams = iter(lzw_encode([p[k : k + FRAME] for p in payloads for k in range(0, len(p), FRAME)]))
    out = []
    for p in payloads:
        parts = [_HEAD, _LOOP]
        for _ in range(0, len(p), FRAME):
            x = next(streams)
            parts.append(_BEFORE)
            parts += [bytes((len(b),)) + b for b in (x[k : k + 255] for k in range(0, len(x), 255))]
            parts.append(b"\x00")
        out.append(b"".join([*parts, b"\x3b"]))
    return out


@dataclass
class Frame:
    """A frame as stored: where it lies, its colours, and how long it stays."""

    left: int
    top: int
    width: int
    height: int
    palette: bytes
    delay: int
    disposal: int
    transparent: int | None
    interlaced: bool
    size: int
    stream: bytes
    indices: np.ndarray | None = None


def parse_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Screen size and frames, whose code streams are still packed."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    at = 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    shared, frames, control = data[13:at], [], (0, 0, None)
    while data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            if data[at] == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", data, at + 2)
                control = (bits >> 2 & 7, delay, index if bits & 1 else None)
            at += 1
            while data[at]:
                at += data[at] + 1
            at += 1
        elif kind == 0x2C:
            left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at)
            at += 9
            own = 3 << ((bits & 7) + 1) if bits & 128 else 0
            palette, at = data[at : at + own] or shared, at + own
            size, at, blocks = data[at], at + 1, []
            while n := data[at]:
                blocks.append(data[at + 1 : at + 1 + n])
                at += n + 1
            at += 1
            frames.append(Frame(left, top, w, h, palette, control[1], control[0], control[2], bool(bits & 64), size, b"".join(blocks)))
            control = (0, 0, None)
        else:
            raise ValueError(f"unknown block {kind}")
    return wide, high, frames


def unpack(frames: list[Frame]) -> None:
    """Fill in ``indices`` of all frames, in groups of one code size."""
    for size in {f.size for f in frames}:
        mine = sorted((f for f in frames if f.size == size), key=lambda f: len(f.stream))
        while mine:
            n = max(1, min(512, STREAMS // max(1, len(mine[-1].stream))))
            mine, part = mine[:-n], mine[-n:]
            for f, x in zip(part, lzw_decode([f.stream for f in part], size, [f.width * f.height for f in part]), strict=True):
                x = x.reshape(f.height, f.width)
                if f.interlaced:
                    rows = [*range(0, f.height, 8), *range(4, f.height, 8), *range(2, f.height, 4), *range(1, f.height, 2)]
                    x = x[np.argsort(rows)]
                f.indices = x


def shown(wide: int, high: int, frames: list[Frame]) -> Iterator[tuple[int, int, np.ndarray]]:
    """start (1/100 s), delay and RGBA picture of each frame as a viewer shows it."""
    screen, start = np.zeros((high, wide, 4), np.uint8), 0
    for f in frames:
        before = screen.copy() if f.disposal == 3 else None
        colours = np.zeros((256, 4), np.uint8)
        rgb = np.frombuffer(f.palette, np.uint8).reshape(-1, 3)
        colours[: len(rgb), :3], colours[:, 3] = rgb, 255
        y, x = slice(f.top, f.top + f.height), slice(f.left, f.left + f.width)
        drawn = colours[f.indices]
        screen[y, x] = drawn if f.transparent is None else np.where((f.indices == f.transparent)[..., None], screen[y, x], drawn)
        yield start, f.delay, screen.copy()
        start += f.delay
        if f.disposal == 2:
            screen[y, x] = 0
        elif before is not None:
            screen = before


def histograms(pictures: list[np.ndarray]) -> np.ndarray:
    """(pictures, COLOURS) numbers of visible pixels by colour."""
    if not pictures:
        return np.zeros((0, COLOURS), np.int64)
    p = np.stack(pictures).reshape(len(pictures), -1, 4) >> 6
    bins = p[..., 0].astype(np.int64) << 4 | p[..., 1] << 2 | p[..., 2]
    bins[p[..., 3] == 0] = COLOURS
    bins += (COLOURS + 1) * np.arange(len(pictures))[:, None]
    return np.bincount(bins.ravel(), minlength=(COLOURS + 1) * len(pictures)).reshape(-1, COLOURS + 1)[:, :COLOURS]


def seen(wide: int, high: int, frames: list[Frame], at_once: int = 256) -> Iterator[tuple[list[tuple[int, int, np.ndarray]], np.ndarray]]:
    """Groups of the frames as shown, and their colour histograms."""
    rows = shown(wide, high, frames)
    while group := list(islice(rows, at_once)):
        yield group, histograms([r[2] for r in group])


# ---- columns --------------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def store_gif(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as an animation, stored as a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            for i, j in steps(texts):
                yield {"doc_id": ids[i:j], "n_bytes": [len(t) for t in texts[i:j]], "media": encode_gif([padded(t) for t in texts[i:j]])}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")), run, "doc_id long, n_bytes long, media binary")


def read_gif(stored: DataFrame) -> DataFrame:
    """Decode ``media`` and derive columns: payload digests, frames, duration, colour histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            media, ids, n_bytes = b.column("media").to_pylist(), b.column("doc_id"), b.column("n_bytes")
            for i, j in steps(media):
                parsed = [parse_gif(m) for m in media[i:j]]
                unpack([f for _, _, frames in parsed for f in frames])
                payloads = [b"".join(f.indices.tobytes() for f in frames) for _, _, frames in parsed]
                colours = [sum((h.sum(0) for _, h in seen(*x)), np.zeros(COLOURS, np.int64)) for x in parsed]
                yield {
                    "doc_id": ids[i:j], "n_bytes": n_bytes[i:j], "payload_bytes": [len(p) for p in payloads],
                    "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads], "tail_crc32": [zlib.crc32(p[-32:]) for p in payloads],
                    "media_bytes": [len(m) for m in media[i:j]], "media_sha256": [hashlib.sha256(m).hexdigest() for m in media[i:j]],
                    "feature": [f"hist{COLOURS}={','.join(map(str, c.tolist()))}" for c in colours],
                    "n_frames": [len(x[2]) for x in parsed], "duration_cs": [sum(f.delay for f in x[2]) for x in parsed],
                }

    return arrow_map(stored.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_cs long")


def frame_table(stored: DataFrame) -> DataFrame:
    """One row per timed frame as shown: doc_id, frame, start_cs, delay_cs, rgba, colours (its
    histogram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for doc_id, m in zip(b.column("doc_id").to_pylist(), b.column("media"), strict=True):
                wide, high, frames = parse_gif(m.as_py())
                unpack(frames)
                at = 0
                for rows, colours in seen(wide, high, frames):
                    yield {"doc_id": [doc_id] * len(rows), "frame": range(at, at + len(rows)), "start_cs": [r[0] for r in rows], "delay_cs": [r[1] for r in rows], "rgba": [r[2].tobytes() for r in rows], "colours": colours.tolist()}
                    at += len(rows)

    return arrow_map(stored.select("doc_id", "media"), run, "doc_id long, frame int, start_cs long, delay_cs int, rgba binary, colours array<long>")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as a GIF, read it back, compute features; one row per document."""
    return read_gif(store_gif(docs))
