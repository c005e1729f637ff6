"""Hard negatives by exact inner products of integer vectors, with pruning in a rotated space.

All vectors are rotated by the orthogonal matrix of principal axes (of second moments, because
inner products are not centred), so most of a product comes from few leading components. A block
of anchors and a block of rows form the partial products of the leading components; what the
others can add is bounded by the norms of the residuals (Cauchy and Schwarz) and by slack for
rounding. Pairs whose bound misses what is wanted go at once, the others get more components,
and those left are judged by the integer product itself, so the result is exact.

Two rounds: the positives (best rows of the anchor's label), then for each of an anchor and
positive the best rows of other labels within a band of the positive's score. Anchors are a
stated query set; they meet all rows in blocks. A block of rows stays with its task and anchors
come by; a task keeps only the best lists of the anchors at work, and its partial lists are
merged by a window over at most (list length x tasks) rows of an anchor.

Rows with a null id or label, a null vector, or a null or non-finite component take no part. Of
rows with the same id the smallest by (label, vector) does. Shorter vectors count as filled up
with zeros. Scores are 64-bit integers (sums beyond wrap around). Fewer positives or negatives than asked for: all of
them. Empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.llm.common import arrow_map, saved
from trajecta.llm.vectors import matrix, whole

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 512, 2048
#: Relative and absolute rounding slack of partial products; floats err by some 1e-13.
SLACK = 1e-9
#: Survivors beyond this share of a block are worked on as whole matrices.
DENSE = 1 / 8
_LEAST = np.iinfo(np.int64).min


class Side:
    """A block of vectors: ids, labels, integers, and what pruning needs."""

    def __init__(self, ids: bytes, labels: bytes, values: bytes, axes: np.ndarray) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.v = np.frombuffer(values, np.int64).reshape(len(self.ids), -1)
        self.y = self.v.astype(np.float64) @ axes
        left = np.cumsum(self.y[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = np.sqrt(np.concatenate([left, np.zeros((len(left), 1))], axis=1))  # norm from a component on

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def _slack(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    return SLACK * (a * r + 1)


def survivors(a: Side, ai: slice, r: Side, rj: slice, wanted: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and integer products of the pairs of a[ai] and r[rj] whose bounds stay wanted.
    ``wanted(i, lower, upper)`` gets places of anchors within ``ai`` that broadcast."""
    av, rv, ay, ry, arest, rrest = a.v[ai], r.v[rj], a.y[ai], r.y[rj], a.rest[ai], r.rest[rj]
    m, n, d = len(av), len(rv), av.shape[1]
    none = np.zeros(0, np.int64)
    if not (m and n and d):
        i, j = (x.ravel() for x in np.mgrid[:m, :n])
        return i, j, np.zeros(m * n, np.int64)
    done = 0
    part = np.zeros((m, n))
    i = j = p = None  # the pairs left, once they are few
    for upto in sorted({max(1, d // 4), max(1, d // 2)}):
        if i is None:
            part += ay[:, done:upto] @ ry[:, done:upto].T
            gap = np.outer(arest[:, upto], rrest[:, upto]) + _slack(arest[:, :1], rrest[None, :, 0])
            keep = wanted(np.arange(m)[:, None], part - gap, part + gap)
            if keep.sum() <= DENSE * m * n:
                i, j = np.nonzero(keep)
                p = part[i, j]
        else:
            p = p + np.concatenate([np.einsum("ij,ij->i", ay[i[k : k + 65536], done:upto], ry[j[k : k + 65536], done:upto]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
            gap = arest[i, upto] * rrest[j, upto] + _slack(arest[i, 0], rrest[j, 0])
            keep = wanted(i, p - gap, p + gap)
            i, j, p = i[keep], j[keep], p[keep]
        done = upto
    if i is None:  # too many: all integer products of the block
        small = float(np.abs(av).max()) * float(np.abs(rv).max()) * d < 2.0**52
        exact = np.rint(av.astype(np.float64) @ rv.T.astype(np.float64)).astype(np.int64) if small else av @ rv.T
        i, j = np.nonzero(keep)
        return i, j, exact[i, j]
    exact = [np.einsum("ij,ij->i", av[i[k : k + 65536]], rv[j[k : k + 65536]]) for k in range(0, len(i), 65536)]
    return i, j, np.concatenate(exact) if exact else none


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group by higher score, then smaller id; by group."""
    by = np.lexsort((ids, ~score, group))
    g = group[by]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0)) if len(g) else g
    return by[rank < most]


class Lists:
    """The best rows so far of each of some groups."""

    def __init__(self, groups: int, most: int) -> None:
        self.most = most
        self.group, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(groups, _LEAST)  # a lower score can't get in

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        at = best(group, score, ids, self.most)
        self.group, self.score, self.ids = group[at], score[at], ids[at]
        full = np.bincount(self.group, minlength=len(self.least)) == self.most
        last = np.zeros(len(self.least), np.int64)
        last[self.group] = self.score  # by group and falling score: the last one stays
        self.least = np.where(full, last, _LEAST)


def bands(score: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integers within score * low and score * high, without overflow."""
    down = lambda x, q: q[0] * (x // q[1]) + q[0] * (x % q[1]) // q[1]
    return -down(-score, low), down(score, high)


def _positives(a: Side, r: Side, lists: Lists) -> None:
    for label in np.intersect1d(a.labels, r.labels).tolist():
        ai, rj = a.of_label(label), r.of_label(label)
        n = rj.stop - rj.start
        floor = lists.least[ai].astype(np.float64)

        def wanted(i: np.ndarray, lower: np.ndarray, upper: np.ndarray, floor: np.ndarray = floor, n: int = n) -> np.ndarray:
            if lower.ndim == 2 and n > lists.most:  # one of them may be the anchor itself
                floor = np.maximum(floor, np.partition(lower, n - lists.most - 1, axis=1)[:, n - lists.most - 1])
            return upper >= floor[i]

        i, j, score = survivors(a, ai, r, rj, wanted)
        other = a.ids[ai][i] != r.ids[rj][j]
        lists.add(i[other] + ai.start, score[other], r.ids[rj][j[other]])


def _negatives(a: Side, r: Side, lists: Lists, low: np.ndarray, high: np.ndarray) -> None:
    """low, high: the bands of each anchor's positives."""
    k = low.shape[1]
    floor = np.maximum(low, lists.least.reshape(low.shape)).astype(np.float64)
    top = high.astype(np.float64)
    closed = low > high

    def wanted(i: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        out = np.zeros(lower.shape, bool)
        for c in range(k):
            out |= (upper >= floor[i, c]) & (lower <= top[i, c]) & ~closed[i, c]
        return out

    i, j, score = survivors(a, slice(0, len(a.ids)), r, slice(0, len(r.ids)), wanted)
    other = a.labels[i] != r.labels[j]
    i, j, score = i[other], j[other], score[other]
    for c in range(k):
        fits = np.flatnonzero((score >= low[i, c]) & (score <= high[i, c]) & ~closed[i, c])
        lists.add(i[fits] * k + c, score[fits], r.ids[j[fits]])


def axes_of(rows: DataFrame, width: int) -> np.ndarray:
    """Principal axes as columns, the one with most energy first. Only width x width sums come
    to the driver; any orthogonal matrix gives right results, a good one prunes more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((width, width))
        for b in batches:
            v = matrix(b.column("v"), width, np.float64)
            v /= np.maximum(1, np.abs(v).max(axis=1, keepdims=True, initial=0))
            total += v.T @ v
        i, j = np.indices(total.shape)
        yield {"i": i.ravel(), "j": j.ravel(), "s": total.ravel()}

    total = np.zeros((width, width))
    for x in arrow_map(rows.select("v"), run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[x.i, x.j] = x.s
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _blocks(rows: DataFrame, width: int, size: int, label: str, extra: bool = False) -> DataFrame:
    """Rows packed by ``size``, sorted by label within a block; extra: with positives."""
    names = ["block", "ids", "labels", "v"] + ["scores", "positives"] * extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        block, wait, have = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> dict:
            t = pa.Table.from_batches(wait).combine_chunks().sort_by([("label", "ascending"), ("vec_id", "ascending")]).combine_chunks()
            out = {"block": [block], "ids": [t.column("vec_id").to_numpy().tobytes()], "labels": [t.column("label").to_numpy().tobytes()]}
            out["v"] = [matrix(t.column("v").combine_chunks(), width, np.int64).tobytes()]
            for name in names[4:]:
                out[name] = [matrix(t.column(name).combine_chunks(), POSITIVES, np.int64).tobytes()]
            return out

        for b in batches:
            for low in range(0, b.num_rows, size):
                part = b.slice(low, size)
                if have + part.num_rows > size:
                    yield packed()
                    block, wait, have = block + 1, [], 0
                wait.append(part)
                have += part.num_rows
        if wait:
            yield packed()

    kinds = "block long, ids binary, labels binary, v binary" + ", scores binary, positives binary" * extra
    return saved(arrow_map(rows, run, kinds), label)


def _met(anchors: DataFrame, rows: DataFrame, cells: int) -> DataFrame:
    """Each block of anchors with each block of rows; a block of rows is in one cell only. (Both
    sides are dealt to ``cells`` partitions here, so the join adds no shuffle.)"""
    a = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    r = rows.select(F.pmod(F.xxhash64("block"), F.lit(cells).cast("long")).cast("int").alias("cell"), *[F.col(c).alias(f"r_{c}") for c in rows.columns])
    return a.repartition(cells, "cell").hint("merge").join(r.repartition(cells, "cell"), "cell")


def _streamed(batches: Iterator[pa.RecordBatch], axes: np.ndarray, begin: Callable, step: Callable, end: Callable) -> Iterator[dict]:
    """The pairs of blocks that come by; lists live as long as the block of anchors stays."""
    at = a = state = None
    for b in batches:
        for x in b.to_pylist():
            if x["a_block"] != at:
                if a is not None:
                    yield end(a, state)
                at, a = x["a_block"], Side(x["a_ids"], x["a_labels"], x["a_v"], axes)
                state = begin(a, x)
            step(a, Side(x["r_ids"], x["r_labels"], x["r_v"], axes), state)
    if a is not None:
        yield end(a, state)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20)) -> DataFrame:
    """vectors(vec_id long, label long, v array<long>, without nulls) -> anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score: for each row that ``is_anchor`` holds for
    and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of
    other labels whose score is between ``low`` and ``high`` of the positive's score."""
    spark = vectors.sparkSession
    rows = vectors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", F.col("x.label").cast("long").alias("label"), F.col("x.v").alias("v"))
    rows = saved(rows, "integers")
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    axes = axes_of(rows, width)
    asked = saved(rows.where(is_anchor), "anchors")
    packs = lambda n, size: max(1, -(-n // size))
    blocks = _blocks(rows, width, ROWS_AT_ONCE, "row-blocks")
    cells = max(1, min(blocks.count(), max(64, 3 * spark.sparkContext.defaultParallelism)))
    few = packs(asked.count(), ANCHORS_AT_ONCE)

    def positives_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        done = lambda a, s: {"anchor_id": a.ids[s.group], "positive_id": s.ids, "positive_score": s.score}
        yield from _streamed(batches, axes, lambda a, x: Lists(len(a.ids), positives), lambda a, r, s: _positives(a, r, s), done)

    near = arrow_map(_met(_blocks(asked.repartition(few), width, ANCHORS_AT_ONCE, "anchor-blocks"), blocks, cells), positives_of, "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = saved(near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives), "positives")

    gathered = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("k", "positive_score", "positive_id"))).alias("p"))  # no more than ``positives``
    known = asked.join(gathered.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "v", F.col("p.positive_score").alias("scores"), F.col("p.positive_id").alias("positives"), F.size("p").cast("long").alias("n"))
    # filled up with a score of -1, whose band is empty
    filled = lambda c, x: F.concat(F.col(c), F.array_repeat(F.lit(x).cast("long"), (F.lit(positives) - F.col("n")).cast("int")))
    known = known.select("vec_id", "label", "v", filled("scores", -1).alias("scores"), filled("positives", 0).alias("positives"))

    def negatives_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def begin(a: Side, x: dict) -> tuple:
            score, ids = (np.frombuffer(x[c], np.int64).reshape(len(a.ids), -1) for c in ("a_scores", "a_positives"))
            return (Lists(len(a.ids) * positives, negatives), score, ids, *bands(score, low, high))

        def end(a: Side, s: tuple) -> dict:
            lists, score, ids = s[:3]
            i, k = lists.group // positives, lists.group % positives
            return {"anchor_id": a.ids[i], "k": k + 1, "positive_id": ids[i, k], "positive_score": score[i, k], "negative_id": lists.ids, "negative_score": lists.score}

        yield from _streamed(batches, axes, begin, lambda a, r, s: _negatives(a, r, s[0], s[3], s[4]), end)

    met = _met(_blocks(known.repartition(few), width, ANCHORS_AT_ONCE, "positive-blocks", True), blocks, cells)
    hard = arrow_map(met, negatives_of, "anchor_id long, k long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "k", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    out = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def integers(embeddings: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label and floor(scale * x) of every component, of the rows that take part."""
    taken = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole())
    return taken.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def negatives_digest(embeddings: DataFrame) -> DataFrame:
    """The query's rows: labels of ids divisible by 7 shifted, anchors are ids divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(integers(embeddings, label), F.col("vec_id") % 50 == 0)
