"""Near-duplicates of vectors by sorted projection passes.

Each pass cuts space by random planes; the signs of a vector, one after the other, are its key,
and the rows are sorted by it, so close vectors mostly lie close to each other. Every vector is
compared with its ``WINDOW`` followers by the cosine in double precision. The passes' verified
pairs are united. How many passes there are follows from the number of vectors, such that a pair
at the least cosine is met with probability ``RECALL`` at least at every size: two vectors must
agree in as many signs as leave ``WINDOW`` vectors together (closer pairs agree more often).

Windows are bounded, so in a dense group a pass sees only some of the links. They are enough to
join the group; what the windows left out is counted afterwards by matrix products within each
component, in pieces of bounded size that are dealt over the cluster, so no link between two
members of a component is lost. No pair is written in either step: a task gives each row's
root among the rows it has just compared, or each row's number of links. Equal vectors are one
node with a number of rows from the start, however many there are; different vectors of one
dense group are compared in pieces, which takes the square of the group's size in arithmetic,
but neither in rows nor in memory.

Vectors that are null, zero, or hold a null or a component that is not finite link with nothing
and keep their row, their own component. Shorter vectors count as filled up with zeros. Rows
that repeat a vec_id are rows of their own; a null vec_id is never a component's id unless the
component has no other, and such a row is not kept. No rows: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import arrow_map, saved
from trajecta.llm.components import components
from trajecta.llm.vectors import longest, matrix, whole

COSINE, WINDOW, RECALL, BITS = 0.95, 64, 0.98, 60
#: Members of a component that are compared at once with as many others; rows of a product.
PIECE, _AT_ONCE = 2048, 256


def passes_for(rows: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at ``cosine`` has been in one window with probability ``recall``."""
    agree = 1 - math.acos(cosine) / math.pi
    once = agree ** max(1.0, math.log2(max(rows, 2) / (window / 2)))
    return max(8, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def _units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares stay finite."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that links reach, for each of n places."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows (vec_id, digest; null if it takes no part) and distinct vectors (node, digest, unit
    vector, number of rows, smallest vec_id)."""
    width = longest(vectors.where(whole()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            v = matrix(b.column("v"), width, np.float64) + 0.0  # no negative zeros
            some = np.abs(v).max(axis=1, initial=0) > 0
            u = np.zeros_like(v)
            u[some] = _units(v[some])
            yield {"vec_id": b.column("vec_id"), "digest": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if s else None for x, s in zip(v, some, strict=True)], "unit": [x.tobytes() if s else None for x, s in zip(u, some, strict=True)]}

    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(whole(), F.transform("embedding", lambda x: x.cast("double"))).otherwise(F.array().cast("array<double>")).alias("v"))
    rows = saved(arrow_map(read, run, "vec_id long, digest binary, unit binary"), "units")
    alike = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    return rows.select("vec_id", "digest"), saved(alike.select(F.monotonically_increasing_id().alias("node"), "digest", "unit", "n", "least"), "nodes"), width


def _passes(nodes: DataFrame, width: int, passes: int, seed: int) -> DataFrame:
    """Every vector once for each pass, with its key there."""
    bits = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        planes = np.random.default_rng(seed).standard_normal((width, passes * BITS))
        for b in batches:
            for low in range(0, b.num_rows, _AT_ONCE):
                part = b.slice(low, _AT_ONCE)
                u = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64).reshape(-1, width)
                key = ((u @ planes).reshape(len(u), passes, BITS) > 0) @ bits
                again = np.repeat(np.arange(len(u)), passes)
                yield {"which": np.tile(np.arange(passes, dtype=np.int32), len(u)), "key": key.ravel(), "node": part.column("node").to_numpy()[again], "unit": part.column("unit").take(pa.array(again))}

    return arrow_map(nodes.select("node", "unit"), run, "which int, key long, node long, unit binary")


def neighbours(nodes: DataFrame, width: int, cosine: float = COSINE, window: int = WINDOW, passes: int | None = None, seed: int = 13) -> DataFrame:
    """nodes(node, unit) -> (a, b): each row of a pass with its root among those compared with
    it, for the same components as the verified pairs of all windows have."""
    passes = passes or passes_for(nodes.count(), cosine, window)

    def compared(which: np.ndarray, node: np.ndarray, u: np.ndarray, done: int) -> dict:
        """Links between rows of which the second is one from ``done`` on."""
        pairs = []
        for low in range(max(0, done - window), len(u), _AT_ONCE):
            high = min(len(u), low + _AT_ONCE + window)
            i, j = np.nonzero(u[low : low + _AT_ONCE] @ u[low:high].T >= cosine)
            i, j = i + low, j + low
            good = (j > i) & (j <= i + window) & (j >= done) & (which[i] == which[j])
            pairs.append(np.stack([i[good], j[good]]))
        a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        root = _roots(len(u), a, b)
        new = np.flatnonzero(root != np.arange(len(u)))
        return {"kind": np.zeros(len(new), np.int32), "a": node[root[new]], "b": node[new]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows stream by; the last ``window`` stay. The first and last ones of the task
        also go out, because their windows reach into the next task's rows."""
        from pyspark import TaskContext

        task, head, tail = TaskContext.get().partitionId(), 0, None
        names = ("kind", "a", "b", "task", "which", "unit")
        kinds = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("task", pa.int64()), ("which", pa.int32()), ("unit", pa.binary())])

        def links(x: dict) -> pa.RecordBatch:
            n = len(x["a"])
            return pa.record_batch([pa.array(x["kind"], pa.int32()), pa.array(x["a"]), pa.array(x["b"]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=kinds)

        def edge(kind: int, which: np.ndarray, node: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
            n = len(node)
            columns = [np.full(n, kind, np.int32), node, np.arange(n), np.full(n, task, np.int64), which]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([x.tobytes() for x in u], pa.binary())], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            which, node = b.column("which").to_numpy(), b.column("node").to_numpy()
            u = np.frombuffer(b"".join(b.column("unit").to_pylist()), np.float64).reshape(-1, width)
            if head < window:
                yield edge(1, which[: window - head], node[: window - head], u[: window - head])
                head += min(window - head, len(node))
            done = 0
            if tail is not None:
                done = len(tail[0])
                which, node, u = (np.concatenate([x, y]) for x, y in zip(tail, (which, node, u), strict=True))
            yield links(compared(which, node, u, done))
            tail = which[-window:], node[-window:], u[-window:]
        if tail is not None:
            yield edge(2, *tail)

    sorted_ = _passes(nodes, width, passes, seed).repartitionByRange("which", "key", "node").sortWithinPartitions("which", "key", "node")
    out = saved(sorted_.mapInArrow(run, "kind int, a long, b long, task long, which int, unit binary"), "windows")
    # the end of a task's rows meets the beginning of the next task that has any
    tasks = [r.task for r in out.where("kind = 1").select("task").distinct().orderBy("task").collect()]
    follows = nodes.sparkSession.createDataFrame(list(zip(tasks[:-1], tasks[1:], strict=True)), "task long, next long")
    ends = out.where("kind = 2").select("task", "which", F.col("a").alias("node"), F.col("b").alias("at"), "unit", F.lit(0).alias("side"))
    begins = out.where("kind = 1").join(F.broadcast(follows.withColumnsRenamed({"task": "before", "next": "task"})), "task").select(F.col("before").alias("task"), "which", F.col("a").alias("node"), F.col("b").alias("at"), "unit", F.lit(1).alias("side"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for task in runs_of(batches, "task"):
            t = task.sort_by([("side", "ascending"), ("at", "ascending")]).combine_chunks()
            u = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(-1, width)
            found = compared(t.column("which").to_numpy(), t.column("node").to_numpy(), u, int((t.column("side").to_numpy() == 0).sum()))
            yield {"a": found["a"], "b": found["b"]}

    seams = ends.unionByName(begins).repartition("task").sortWithinPartitions("task")
    return out.where("kind = 0").select("a", "b").unionByName(arrow_map(seams, across, "a long, b long"))


def runs_of(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows of one key after the other, from rows that are sorted by key."""
    wait: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if wait is None else pa.concat_tables([wait, t])
        values = [t.column(k).to_numpy() for k in keys]
        edge = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        low = 0
        for high in edge.tolist():
            yield t.slice(low, high - low)
            low = high
        wait = t.slice(low)
    if wait is not None and wait.num_rows:
        yield wait


def links_within(nodes: DataFrame, roots: DataFrame, width: int, cosine: float = COSINE, piece: int = PIECE) -> DataFrame:
    """nodes(node, unit, n), roots(node, root) -> (node, others): the rows of other vectors that
    a vector links with, over all members of its component. Components beyond ``piece`` members
    are cut into pieces; each two pieces meet once."""
    sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces"))
    members = roots.join(sizes, "root").join(nodes.select("node", "unit", "n"), "node")
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces").cast("long")).cast("int"))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = met.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "n", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        nodes_, counts = [], []
        for t in runs_of(batches, "root", "low", "high"):
            node, n, own, low, high = (t.column(c).to_numpy() for c in ("node", "n", "own", "low", "high"))
            u = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(-1, width)
            n = n.astype(np.float64)  # exact up to 2 ** 53 rows
            if low[0] == high[0]:
                sides = [(np.arange(len(u)), np.arange(len(u)))]
            else:
                x, y = np.flatnonzero(own == low[0]), np.flatnonzero(own == high[0])
                sides = [(x, y), (y, x)]
            for x, y in sides:
                for k in range(0, len(x), _AT_ONCE):
                    at = x[k : k + _AT_ONCE]
                    near = u[at] @ u[y].T >= cosine
                    if low[0] == high[0]:
                        near[np.arange(len(at)), at] = False
                    nodes_.append(node[at])
                    counts.append((near @ n[y]).astype(np.int64))
            if len(nodes_) > 512:
                yield {"node": np.concatenate(nodes_), "others": np.concatenate(counts)}
                nodes_, counts = [], []
        if nodes_:
            yield {"node": np.concatenate(nodes_), "others": np.concatenate(counts)}

    dealt = met.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    return arrow_map(dealt, run, "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id that links
    reach, the row's own included) and kept for every row of vectors(vec_id, embedding)."""
    rows, nodes, width = _nodes(vectors)
    found = saved(neighbours(nodes, width, cosine, window, passes).distinct(), "neighbours")
    roots = components(found)
    others = links_within(nodes, roots, width, cosine)
    classes = nodes.select("node", "digest", "n", "least").join(roots, "node", "left").join(others, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = saved(classes, "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = classes.join(least, "root").select("digest", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(known, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
