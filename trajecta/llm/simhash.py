"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a point between them that is within half the
radius of both. So every fingerprint emits its variants within half the radius, equal
variants meet in a shuffle, and colliding pairs are verified.

The ball around all 64 bits has 2081 points for a radius of 4. It is made in two tiers, with
the same pairs in the end:

1. The bits are cut into three blocks. Two fingerprints with at most 4 differing bits have
   two blocks with at most 2 of them (leave out the block with most). So each fingerprint
   emits, for each choice of two blocks, the variants of these blocks within 1 bit: 132 rows
   with keys of 42 or 43 bits, which chance collisions of even 10^10 texts leave sparse.
2. Where up to ``MANY`` fingerprints meet, all pairs are verified inside the task, in tiles, and
   only as many links as join them leave it. Where more meet, each also emits the points of the
   third block that its remaining half radius allows; now the whole 64-bit point is fixed, all
   that share it are within the radius of each other by the triangle inequality, and links to
   the smallest of them suffice; a task lets out a forest of the links that it has seen. So no
   group's pairs are listed, however large it is, and no link between components is lost.

Equal fingerprints are one node from the start. Links become components on the cluster.

``one_of_each`` wants five-word shingles that agree to 0.8 or more. Such a pair's fingerprints
of five-word shingles differ in about 10 of 64 bits, which no ball of a usable size covers. But
it differs in few single words: fingerprints of the *set of words* are mostly within 4 bits
(of the set, because repeated common words would give long texts of a language one and the
same fingerprint). So candidates are the links of three such fingerprints, by the same ball
hashing, and each is verified by the exact similarity of the sets of five-word shingles.

Candidates are not listed as pairs, for a family of near copies would make a row for each pair
of its members. Contents that links of any of the fingerprints chain together are a cluster, and
all contents of a cluster are compared with each other, exactly, inside the tasks: a cluster is
dealt into blocks of ``BLOCK`` shingles, two blocks meet in a matrix product that counts common
shingles, and only as many similar pairs leave the task as join what is similar. A cluster of
more than ``FEW`` blocks is compared exactly by prefixes: of two sets that agree to 0.8, the
rarest 0.2 of the one's shingles hold one of the other's rarest. Pairs that share such a shingle
and are not in one group yet are verified, all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.llm.common import arrow_map, as_bytes, fresh, saved
from trajecta.llm.components import components

RADIUS, WIDTH, SEED = 4, 4, 42
#: Words of a shingle and least similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of one key whose pairs are verified together with those of other keys, and blocks
#: of one cluster.
FEW = 32
#: Fingerprints of one key whose pairs are verified in tiles of ``_TILE`` rows, and links that a
#: task holds before it lets out a forest of them.
MANY, _TILE, _HELD = 1 << 12, 1 << 7, 1 << 18
#: Shingles of a block of a cluster, and those that a matrix has columns for at once.
BLOCK, _COLUMNS = 1 << 18, 1 << 11
_BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Shingles whose bits are summed at once.
_AT_ONCE = 1 << 14
_LAST = (1 << 63) - 1


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Majority bits of the XXH64 of all ``width``-word shingles, repeats included; 0 for no words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - width + 1)
    first, last = begin[:n].tolist(), (ends[width - 1 :] - 1 if len(words) >= width else ends[-1:] - 1).tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, _AT_ONCE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(first[k : k + _AT_ONCE], last[k : k + _AT_ONCE], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp (the 64 bits as a signed long) of every row;
    null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64)
            yield {"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "fp": fps.view(np.int64)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(as_bytes()).alias("text_key"), as_bytes().alias("text"))
    return arrow_map(rows, run, "doc_id long, text_key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(radius: int) -> list[tuple[int, int, list[int]]]:
    """For each left-out block: its bits, and the flips of the other bits within half of what
    those can differ in."""
    out = []
    for at, n in _BLOCKS:
        gap = ((1 << n) - 1) << at
        rest = [1 << i for i in range(64) if not gap >> i & 1]
        most = 2 * radius // 3
        flips = [sum(c) for k in range((most + 1) // 2 + 1) for c in combinations(rest, k)]
        out.append((gap, n, flips))
    return out


def _joined(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that the links u, v reach."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def _forest(pairs: np.ndarray) -> np.ndarray:
    """(n, 2) links -> as few as have the same components: each node with the smallest one."""
    each, at = np.unique(pairs, return_inverse=True)
    root = _joined(*at.reshape(-1, 2).T, len(each))
    more = np.flatnonzero(root != np.arange(len(each)))
    return np.stack([each[root[more]], each[more]], 1)


def _near(fp: np.ndarray, radius: int) -> np.ndarray:
    """A forest (m, 2) of all pairs of ``fp`` within ``radius`` bits. Pairs that are joined already
    are left out, so one tile's pairs are held at once."""
    root = np.arange(len(fp))
    for k in range(0, len(fp), _TILE):
        bits = np.bitwise_count((fp[k : k + _TILE, None] ^ fp[None, k:]).view(np.uint64))
        u, v = np.nonzero((bits <= radius) & (root[k : k + _TILE, None] != root[None, k:]))
        if len(u):
            root = _joined(np.concatenate([root, u + k]), np.concatenate([np.arange(len(fp)), v + k]), len(fp))
    more = np.flatnonzero(root != np.arange(len(fp)))
    return np.stack([fp[root[more]], fp[more]], 1)


def _slimmer(pairs: DataFrame) -> DataFrame:
    """pairs(a, b), a < b -> links with the same components, about one for each node: all smaller
    ones that a node is linked with are linked with the smallest of them instead, twice."""
    for _ in range(2):
        least = pairs.distinct().withColumn("m", F.min("a").over(Window.partitionBy("b")))
        pairs = least.select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
    return pairs.distinct()


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps(fp), distinct -> (a, b), a < b: enough links for the same components as all pairs
    within ``radius`` bits have."""
    masks = _masks(radius)
    emitted = None
    for which, (gap, _, flips) in enumerate(masks):
        variants = F.array(*[F.lit(_signed(f)).cast("long") for f in flips])
        base = F.col("fp").bitwiseAND(F.lit(_signed(~gap & (1 << 64) - 1)).cast("long"))
        part = fps.select("fp", base.alias("base"), F.explode(variants).alias("flip")).select(F.lit(which).alias("which"), F.col("base").bitwiseXOR(F.col("flip")).alias("key"), "fp")
        emitted = part if emitted is None else emitted.unionByName(part)
    met = emitted.repartition("which", "key").sortWithinPartitions("which", "key", "fp")
    few, many, held, gaps = FEW, max(FEW, MANY), _HELD, [g for g, _, _ in masks]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Runs of equal keys: links of short runs, members of long ones. A run may go on in
        the next batches; up to ``many`` members wait, those of longer runs go on alone."""
        carry = None  # which, key and members of the run that may go on
        for b in batches:
            which, key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("which", "key", "fp"))
            if carry is not None:
                w, k, members = carry
                which, key, fp = np.concatenate([np.full(len(members), w, which.dtype), which]), np.concatenate([np.full(len(members), k), key]), np.concatenate([members, fp])
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (which[1:] != which[:-1])]))
            size = np.diff(np.append(edge, len(key)))
            tail = edge[-1]
            # the last run waits whole until it is long; then enough members wait to tell that it is
            if size[-1] > many:
                done, carry = len(key), (which[-1], key[-1], fp[-(many + 1) :])
            else:
                done, carry = tail, (which[tail], key[tail], fp[tail:])
            keep = edge < done
            yield from _resolved(which[:done], key[:done], fp[:done], edge[keep], size[keep])
        if carry is not None:
            w, k, members = carry
            yield from _resolved(np.full(len(members), w), np.full(len(members), k), members, np.array([0]), np.array([len(members)]))

    def _resolved(which: np.ndarray, key: np.ndarray, fp: np.ndarray, edge: np.ndarray, size: np.ndarray) -> Iterator[dict]:
        if not len(edge) or size.max() < 2:
            return
        run = np.repeat(np.arange(len(edge)), size)
        short = np.repeat((size > 1) & (size <= few), size)
        a, r = fp[short], run[short]
        pairs = []
        for off in range(1, min(few, len(a))):
            same = np.flatnonzero(r[off:] == r[:-off])
            if not len(same):
                break
            x, y = a[same], a[same + off]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
            pairs.append(np.stack([x[near], y[near]], 1))
        for k in np.flatnonzero((size > few) & (size <= many)):
            pairs.append(_near(fp[edge[k] : edge[k] + size[k]], radius))
        if pairs and len(found := np.concatenate(pairs)):
            found = _forest(found)
            yield {"which": np.full(len(found), -1, np.int32), "key": found[:, 0], "fp": found[:, 1]}
        long = np.repeat(size > many, size)
        if long.any():
            yield {"which": which[long].astype(np.int32), "key": key[long], "fp": fp[long]}

    resolved = saved(arrow_map(met, meet, "which int, key long, fp long"), "met", 1 << 15)
    pairs = resolved.where("which < 0").select(F.col("key").alias("a"), F.col("fp").alias("b"))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """All 64-bit points within half the radius whose two chosen blocks are the key's."""
        for b in batches:
            which, key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("which", "key", "fp"))
            for w, gap in enumerate(gaps):
                bits = [1 << i for i in range(64) if gap >> i & 1]
                mine = which == w
                used = np.bitwise_count(((fp[mine] ^ key[mine]) & np.int64(_signed(~gap & (1 << 64) - 1))).view(np.uint64))
                for spent in range(radius // 2 + 1):
                    f, k = fp[mine][used == spent], key[mine][used == spent]
                    if not len(f):
                        continue
                    flips = np.array([sum(c) for n in range(radius // 2 - spent + 1) for c in combinations(bits, n)], np.uint64).view(np.int64)
                    for i in range(0, len(f), 256):
                        g = f[i : i + 256]
                        at = (k[i : i + 256] | (g & np.int64(_signed(gap))))[:, None] ^ flips[None, :]
                        yield {"point": at.ravel(), "fp": np.repeat(g, len(flips))}

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Rows by point, then fp: each fingerprint with the smallest one of its point, as a forest
        of what the task has seen."""
        last = head = None  # the point that may go on, and its smallest fingerprint
        seen = np.zeros((0, 2), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            point, fp = (b.column(c).to_numpy() for c in ("point", "fp"))
            new = np.concatenate([[last is None or point[0] != last], point[1:] != point[:-1]])
            heads = np.concatenate([[fp[0] if head is None else head], fp[new]])
            least = heads[np.cumsum(new)]
            last, head = point[-1], least[-1]
            seen = np.concatenate([seen, np.stack([least, fp], 1)[least != fp]])
            if len(seen) > held and 2 * len(seen := _forest(seen)) > held:  # what does not get smaller goes out at once
                yield {"a": seen[:, 0], "b": seen[:, 1]}
                seen = seen[:0]
        if len(seen := _forest(seen)):
            yield {"a": seen[:, 0], "b": seen[:, 1]}

    long = resolved.where("which >= 0").distinct()
    if long.isEmpty():
        return _slimmer(pairs)
    ball = arrow_map(long, points, "point long, fp long").repartition("point").sortWithinPartitions("point", "fp")
    return _slimmer(pairs.unionByName(saved(arrow_map(ball, stars, "a long, b long"), "stars", 1 << 15)))


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_key, fp, root (a fingerprint that names the component) and component_id
    (the smallest doc_id that links reach) for every row.

    Texts without words share the fingerprint 0 and link like any other. A null doc_id keeps
    its row; it is never a component's id unless the component has no other.
    """
    prints = saved(fingerprints(docs, width), "prints")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    joined = nodes.join(roots.toDF("fp", "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    joined = saved(joined, "joined")
    groups = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(groups, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


# ---- near copies by the similarity of five-word shingles --------------------------------


#: Independent fingerprints of the words.
PRINTS = ("f1", "f2", "f3")


def _word_prints(words: list[bytes]) -> list[int]:
    """Fingerprints of the set of words, 64 bits each, by hashes with different seeds."""
    each = set(words)
    if not each:
        return [0] * len(PRINTS)
    out: list[int] = []
    for seed in range(-(-len(PRINTS) // 2)):
        raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w, seed) for w in each]), np.uint8).reshape(-1, 16)
        ones = np.zeros(128, np.int64)
        for k in range(0, len(raw), _AT_ONCE):
            ones += np.unpackbits(raw[k : k + _AT_ONCE], axis=1).sum(0, dtype=np.int64)
        bits = np.packbits((2 * ones > len(each)).astype(np.uint8)).tobytes()
        out += [int.from_bytes(bits[k : k + 8], "big", signed=True) for k in (0, 8)]
    return out[: len(PRINTS)]


def _word_rows(docs: DataFrame) -> DataFrame:
    """doc (null: after all), text_key, content (a digest of the words) and ``PRINTS`` of every
    row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            content, made = [], []
            for t in b.column("text"):
                words = t.as_py().lower().split()
                content.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                made.append(_word_prints(words))
            yield {"doc": b.column("doc"), "text_key": b.column("text_key"), "content": content} | dict(zip(PRINTS, zip(*made, strict=True), strict=True))

    return arrow_map(_keyed(docs), run, "doc long, text_key long, content binary, " + ", ".join(f"{f} long" for f in PRINTS))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(as_bytes()).alias("text_key"), as_bytes().alias("text"))


def _shingles(words: list[bytes], width: int) -> bytes:
    """The set of hashes of all shingles, ascending; fewer words are one shingle."""
    each = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, each), np.uint32, len(each))).tobytes()


def _agreement(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets, 1 for two empty ones."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    total = len(x) + len(y) - both
    return both / total if total else 1.0


def _chained(contents: DataFrame, of: str, radius: int) -> DataFrame:
    """contents(content, ...) -> (a, b): enough links to chain all contents whose fingerprints
    ``of`` are equal or within ``radius`` bits."""
    named = contents.select("content", F.col(of).alias("fp"))
    classes = named.groupBy("fp").agg(F.min("content").alias("head"), F.count(F.lit(1)).alias("n"))
    own = named.join(classes.where("n > 1").hint("merge"), "fp").where(F.col("content") != F.col("head")).select(F.col("head").alias("a"), F.col("content").alias("b"))
    head = lambda p: classes.select(F.col("fp").alias(p), F.col("head").alias(f"h{p}")).hint("merge")
    across = links(classes.select("fp"), radius).join(head("a"), "a").join(head("b"), "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    return own.unionByName(across)


def _similar(x: list[np.ndarray], y: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs of sets of x and y that agree to ``similarity``."""
    sets = [*x, *y]
    n = np.array([len(s) for s in sets])
    value, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1  # the others are in one set only
    column = np.cumsum(shared) - 1
    rows, keep = np.repeat(np.arange(len(sets)), n), shared[at]
    rows, column = rows[keep], column[at[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(x), len(y)), np.float32)  # whole numbers far below 2^24
    cuts = np.searchsorted(column, np.arange(0, int(shared.sum()) + _COLUMNS, _COLUMNS))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[rows[lo:hi], column[lo:hi] - k * _COLUMNS] = 1
        both += has[: len(x)] @ has[len(x) :].T
    total = n[: len(x), None] + n[len(x) :] - both.astype(float)
    return np.nonzero(np.divide(both, total, out=np.ones(both.shape), where=total > 0) >= similarity - 1e-9)


def _inside(dealt: DataFrame, similarity: float) -> DataFrame:
    """dealt(cluster, block, blocks, content, shingles) -> (a, b): similar contents of a cluster,
    enough to join all that are similar. Each two blocks of a cluster meet in one group of rows,
    which goes through the worker as a whole."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    met = dealt.select("cluster", "block", other, "content", "shingles").select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "content", "shingles")
    met = met.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def group(i: int, j: int, block: list[int], content: list[bytes], raw: list[bytes]) -> dict:
        sets = [np.frombuffer(s, np.uint32) for s in raw]
        x, y = (np.array([k for k, b in enumerate(block) if b == at], np.int64) for at in (i, j))
        u, v = _similar([sets[k] for k in x], [sets[k] for k in y], similarity) if len(x) and len(y) else (x[:0], y[:0])
        root = _joined(x[u], y[v], len(sets))
        more = np.flatnonzero(root != np.arange(len(sets)))
        return {"a": [content[k] for k in root[more]], "b": [content[k] for k in more]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last, held = None, ([], [], [])
        for b in batches:
            for cluster, i, j, *row in zip(*(b.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "content", "shingles")), strict=True):
                if (cluster, i, j) != last:
                    if len(held[0]) > 1:
                        yield group(*last[1:], *held)
                    last, held = (cluster, i, j), ([], [], [])
                for part, value in zip(held, row, strict=True):
                    part.append(value)
        if len(held[0]) > 1:
            yield group(*last[1:], *held)

    return arrow_map(met, run, "a binary, b binary")


def _candidates(contents: DataFrame, of: str, radius: int) -> DataFrame:
    """contents(content, ...) -> (a, b): all pairs that are compared because of the one
    fingerprint ``of``, a row for each; ``similar_groups`` does not list them."""
    clusters = components(_chained(contents, of, radius))
    side = lambda p: clusters.select("root", F.col("node").alias(p))
    return side("a").join(side("b"), "root").where("a < b").select("a", "b")


def _rest(unsure: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """unsure(content), sets(content, shingles), roots(content, root) -> (a, b): all pairs of
    unsure contents of different roots that may agree to ``similarity``.

    Shingles are in order of their number among the unsure contents, the rarest first. Of n
    shingles, all but the first n - similarity * n + 1 are too few for the agreement, so a pair
    shares one of the first ones of both. The first one that they share leaves at most the
    shingles after it to agree on, so pairs that meet too late in both orders are left out.
    Shingles whose contents are of one root join nothing new."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            values = [np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in b.column("shingles")]
            n = np.array([len(v) for v in values], np.int64)
            yield {"content": b.column("content").take(pa.array(np.repeat(np.arange(len(n)), n))), "n": np.repeat(n, n), "shingle": np.concatenate([*values, np.zeros(0, np.int64)])}

    held = sets.join(unsure.hint("merge"), "content", "left_semi")
    rows = saved(arrow_map(held, each, "content binary, n long, shingle long"), "shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    order = F.sort_array(F.collect_list(F.struct("often", "shingle")))
    # shingles of one content only come first and meet nothing, so their number is enough
    listed = rows.join(often.hint("merge"), "shingle").groupBy("content", "n").agg(order.alias("s"))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-6)) + 1 - (F.col("n") - F.size("s"))
    prefix = listed.where(first > 0).select("content", "n", (F.col("n") - F.size("s")).alias("alone"), F.posexplode(F.slice("s", F.lit(1), first.cast("int"))).alias("at", "s"))
    # how many shingles of the content are left from this one on
    prefix = prefix.select("content", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), "s.shingle")
    rooted = prefix.join(roots.hint("merge"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    mixed = saved(rooted.repartition("shingle"), "prefixes")
    several = mixed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    left = mixed.join(several.hint("merge"), "shingle", "left_semi")
    side = lambda p: left.select("shingle", F.col("content").alias(p), F.col("root").alias(f"r{p}"), F.col("n").alias(f"n{p}"), F.col("left").alias(f"l{p}"))
    met = side("a").join(side("b").hint("merge"), "shingle").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")))
    enough = F.least("la", "lb") >= (F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    return met.where((F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity) - F.lit(1e-6)) & enough).select("a", "b").distinct()


def similar_groups(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, text_key, content) of all documents, and (content, root) of the contents that
    have a near copy; see the module's text."""
    rows = saved(_word_rows(docs), "words")
    contents = saved(rows.groupBy("content").agg(F.min("doc").alias("doc"), *[F.first(f).alias(f) for f in PRINTS]), "contents")
    chains = [_chained(contents, f, radius) for f in PRINTS]
    clusters = components(chains[0].unionByName(chains[1]).unionByName(chains[2])).toDF("content", "cluster")
    # one row of each content, and its text
    first = rows.join(contents.join(clusters.hint("merge"), "content").select("content", "doc", "cluster").hint("merge"), ["content", "doc"]).groupBy("content", "doc", "cluster").agg(F.min("text_key").alias("text_key"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"content": b.column("content"), "cluster": b.column("cluster"), "shingles": [_shingles(t.as_py().lower().split(), width) for t in b.column("text")]}

    texts = _keyed(docs).join(first.hint("merge"), ["doc", "text_key"]).select("content", "cluster", "text")
    known = saved(arrow_map(texts, sets, "content binary, cluster binary, shingles binary").dropDuplicates(["content"]), "sets")
    # clusters of more than one block are few
    blocks = F.ceil(F.sum(F.length("shingles")) / F.lit(4 * block)).alias("blocks")
    several = known.groupBy("cluster").agg(blocks).where("blocks > 1")
    dealt = known.join(F.broadcast(several), "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("content"), "blocks"))
    found = saved(_inside(dealt.where(F.col("blocks") <= FEW), similarity), "links")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [_agreement(x.as_py(), y.as_py()) >= similarity - 1e-9 for x, y in zip(b.column("sa"), b.column("sb"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        plain = known.select("content", "shingles")
        both = pairs.join(plain.toDF("b", "sb").hint("merge"), "b").join(plain.toDF("a", "sa").hint("merge"), "a").select("a", "b", "sa", "sb")
        return saved(both.mapInArrow(verified, "a binary, b binary"), "links")

    large = saved(dealt.where(F.col("blocks") > FEW).select("content"), "large")
    if not large.isEmpty():
        none = large.select("content", F.col("content").alias("root")).where("false")
        found = found.unionByName(linked(_rest(large, known.select("content", "shingles"), none, similarity)))
    return rows.select("doc", "text_key", "content"), components(found).toDF("content", "root")


def one_of_each(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group (equal words, or linked by a
    similarity of ``similarity`` or more) the row with the smallest doc_id stays (null ids last,
    then by a hash of the text; of rows with equal id and text one).

    Null text has no words and is a copy of any other text without words. No rows: no rows. No
    name of a further column clashes.
    """
    rows, roots = similar_groups(docs, width, similarity, radius)
    grouped = rows.join(roots.hint("merge"), "content", "left").select("doc", "text_key", F.coalesce("root", "content").alias("root"))
    grouped = saved(grouped, "grouped")
    least = grouped.groupBy("root").agg(F.min("doc").alias("doc"))
    stay = grouped.join(least.hint("merge"), ["root", "doc"]).groupBy("root", "doc").agg(F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("n"))
    p = fresh(docs.columns)
    stay = saved(stay.select(F.col("doc").alias(f"{p}id"), F.col("text_key").alias(f"{p}key"), (F.col("n") > 1).alias(f"{p}many")), "stay")
    keyed = docs.withColumn(f"{p}id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(f"{p}key", F.xxhash64(as_bytes()))
    kept = keyed.join(stay.hint("merge"), [f"{p}id", f"{p}key"])
    lone = kept.where(f"NOT {p}many").select(*docs.columns)
    # repeated ids: partial sums leave one row of each task before any shuffle
    more = kept.where(f"{p}many").groupBy(f"{p}id", f"{p}key").agg(F.first(F.struct(*docs.columns)).alias(f"{p}row")).select(f"{p}row.*")
    return lone.unionByName(more)


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
