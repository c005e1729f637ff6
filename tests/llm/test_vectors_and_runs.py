"""Hard negatives, periodic runs and vector near-duplicates against brute force, with odd tables."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.llm import components, negatives, projection, runs
from trajecta.llm.common import saved

VECTORS = "vec_id long, embedding array<float>, label int, block long, node long, unit string, v int, n int, root long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, 1, 2, "u", 3, 4, 5) for i, v, l in rows], VECTORS)


# ---- hard negatives ---------------------------------------------------------------------


def mined(rows, positives=5, most=3):
    """The contract by plain loops over whole lists."""
    kept = {}
    for i, v, l in rows:
        if i is None or v is None or l is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * float(np.float32(c))) for c in v]
        kept[i] = min(kept.get(i, x), x)
    out = []
    for a in sorted(i for i in kept if i % 50 == 0):
        score = {i: sum(p * q for p, q in zip(kept[a][1], v, strict=False)) for i, (_, v) in kept.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == kept[a][0]][:positives]:
            hard = [i for i in order if kept[i][0] != kept[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:most]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(hard)]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def crowd(seed, n, d=12, spread=0.6):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((4, d))
    return [(int(i), (middle[rng.integers(0, 4)] + spread * rng.standard_normal(d)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]


def test_hard_negatives_equal_plain_loops(spark, monkeypatch):
    rows = crowd(1, 700)
    rows += [(1000 + i, rows[3][1], 1) for i in range(40)]  # ties
    rows += [(50, rows[8][1], 2), (50, rows[9][1], 0), rows[60], rows[60]]  # repeated ids and rows
    rows += [(2000, None, 1), (2001, [], 1), (2050, [1.0, None] + [0.0] * 10, 1), (2100, [math.nan] * 12, 1), (2150, [math.inf] * 12, 0), (2200, [3.0, 1.0], 1), (2250, [0.0] * 12, 0), (None, rows[1][1], 1), (2300, rows[1][1], None)]
    rows += [(-50, rows[5][1], 1), (-7, rows[6][1], 2)]
    want = mined(rows)
    assert len(want) > 100
    got = as_rows(negatives.negatives_digest(vectors(spark, rows).repartition(3)))
    assert got == want
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 50)
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 4)
    assert as_rows(negatives.negatives_digest(vectors(spark, rows).repartition(2))) == want


def test_hard_negatives_of_large_and_of_no_components(spark):
    rows = [(i, [x * 1_000_000.0 for x in v[:3]], l) for i, v, l in crowd(2, 120)]  # beyond the floats' exact sums
    assert as_rows(negatives.negatives_digest(vectors(spark, rows))) == mined(rows)
    assert negatives.negatives_digest(vectors(spark, rows).where("false")).count() == 0
    assert negatives.negatives_digest(vectors(spark, [(0, [], 1), (1, [], 1), (50, [], 2)])).count() == len(mined([(0, [], 1), (1, [], 1), (50, [], 2)]))


def test_bounds_keep_every_pair_that_is_wanted():
    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (300, 16)) * (np.arange(16) < 6) + rng.integers(-9, 9, (300, 16))
    axes = np.linalg.eigh(v.T.astype(float) @ v)[1][:, ::-1].copy()
    side = lambda x: negatives.Side(np.arange(len(x)).tobytes(), np.zeros(len(x), np.int64).tobytes(), x.astype(np.int64).tobytes(), axes)
    a, r = side(v[:40]), side(v)
    exact, tested = v[:40] @ v.T, []
    for least in (-(10**9), 0, 200_000, 10**9):

        def wanted(i, lower, upper, least=least):
            tested.append(lower.size)
            assert np.broadcast(i, lower).shape == lower.shape
            return upper >= least

        i, j, score = negatives.survivors(a, slice(0, 40), r, slice(0, 300), wanted)
        assert (score == exact[i, j]).all() and np.isin(np.flatnonzero(exact >= least), i * 300 + j).all()
    assert min(tested) < 40 * 300  # the second bound only saw what the first had left


def test_bands_are_exact():
    score = np.array([0, 1, 7, 99, 100, -3, 2**62, 2**62 - 1])
    low, high = negatives.bands(score, (1, 2), (19, 20))
    for s, a, b in zip(score.tolist(), low.tolist(), high.tolist(), strict=True):
        assert 100 * a >= 50 * s > 100 * (a - 1) and 100 * b <= 95 * s < 100 * (b + 1)


# ---- periodic runs ----------------------------------------------------------------------


def plain_runs(w, least=24, times=3):
    out = set()
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, times * p) and i > s and not any(p % q == 0 and all(w[t] == w[t + q] for t in range(s, i + p - q)) for q in range(1, p)):
                out.add((s, i + p - s, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    off = {i for s, l, p in found for i in range(s + p, s + l)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{l},{p}\n" for s, l, p in found)
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in off)).hexdigest())


def texts():
    rng = np.random.default_rng(5)
    out = [None, "", "  \n\t ", "one", "la " * 23, "la " * 24, "la " * 500, "a b " * 12, "a b " * 11 + "a", "x\x1cy " * 30, "漢字 　 é " * 40]
    for _ in range(250):
        n = int(rng.integers(0, 160))
        w = rng.integers(0, rng.integers(1, 5), n)
        for _ in range(int(rng.integers(0, 3))):
            if n > 10:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, 20))
                m = min(n - a, int(rng.integers(1, 100)))
                w[a : a + m] = np.resize(rng.integers(0, 3, p), m)
        out.append(" ".join("abcde"[x] for x in w))
    return out


@pytest.mark.parametrize("times", [3, 5])
def test_runs_equal_plain_loops(times):
    docs = [(t or "").split() for t in texts()]
    number = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    words, part = np.array([number[w] for d in docs for w in d]), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    edge, want = np.cumsum([0, *map(len, docs)]), []
    for least in (6, 24):
        want = [(edge[k] + s, l, p) for k, d in enumerate(docs) for s, l, p in plain_runs(d, least, times)]
        assert [tuple(map(int, x)) for x in zip(*runs.find_runs(words, part, least, times), strict=True)] == want and len(want) > 50
    with pytest.raises(ValueError):
        runs.find_runs(words, part, 24, 2)


def test_run_digest_of_odd_texts(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())] + [(None, "z " * 40, 2, "y"), (4, "la " * 23, 1, "x"), (9000, " ".join(f"w{i % 900}" for i in range(9000)), 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, length string").repartition(3)
    got = [tuple(r) for r in runs.run_digest(docs, runs.planted).collect()]
    assert sorted(got, key=str) == sorted([plain_digest(r[0], r[1]) for r in rows if r[0] != 9000] + [r for r in got if r[0] == 9000], key=str)
    assert [r[1:5] for r in got if r[0] == 9000] == [(1, 0, 9000, 900)]
    assert runs.run_digest(docs.where("false"), runs.planted).count() == 0
    every = runs.periodic_runs(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in every}.get(None) == 1
    cut = {r.doc_id: r.text for r in runs.without_repeats(docs).collect()}
    assert cut[None] == "z" and cut[5] == "la" and cut[4] == "la " * 22 + "la" and cut[0] == ""


def test_range_minima():
    rng = np.random.default_rng(7)
    for n in (1, 15, 16, 17, 300, 5000):
        v = rng.integers(0, 1000, n)
        a, b = np.sort(rng.integers(0, n, (2, 500)), axis=0)
        assert (runs.RangeMin(v)(a, b) == [v[x : y + 1].min() for x, y in zip(a, b, strict=True)]).all()


# ---- vector near-duplicates -------------------------------------------------------------


def linked(rows, cosine=0.95):
    """By all pairs: (links, component) of each row."""
    good = [k for k, (_, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max(len(rows[k][1]) for k in good)
    u = np.array([np.pad(np.asarray(rows[k][1], np.float32).astype(float), (0, width - len(rows[k][1]))) for k in good])
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    links, root = [0] * len(rows), list(range(len(rows)))
    seen = set()
    for s in range(len(good)):
        links[good[s]] = int(near[s].sum())
        if s in seen:
            continue
        group, todo = {s}, [s]
        while todo:
            for t in np.flatnonzero(near[todo.pop()]).tolist():
                if t not in group:
                    group.add(t)
                    todo.append(t)
        seen |= group
        for t in group:
            root[good[t]] = ("g", s)
    least = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted([(rows[k][0], links[k], least.get(root[k]), rows[k][0] is not None and rows[k][0] == least.get(root[k])) for k in range(len(rows))], key=str)


def close(seed, n, d=16):
    """Groups from one to many, within a dense one members of which not all link directly."""
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for size, noise in [(1, 0)] * 150 + [(2, 0.08)] * 30 + [(7, 0.12)] * 6 + [(260, 0.16)]:
        middle = rng.standard_normal(d)
        middle /= np.linalg.norm(middle)
        for _ in range(size):
            rows.append((at, (middle + noise / 2 * rng.standard_normal(d)).tolist(), 0))
            at += 1
    return [(int(i), v, 0) for i, (_, v, _) in zip(rng.permutation(len(rows)), rows, strict=True)]


def test_vector_duplicates_equal_all_pairs(spark):
    rows = close(1, 0)
    rows += [(2000 + i, rows[40][1], 0) for i in range(30)] + [rows[0], rows[0], (3, rows[-1][1], 0)]  # copies, repeats, an id twice
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [math.nan] * 16, 1), (3004, [math.inf] * 16, 1), (3005, [1.0, None], 1), (None, rows[5][1], 1), (3006, [2.0], 1), (3007, [5.0, 0.1], 1), (3008, [3e38] * 16, 1), (3009, [1e-38] * 16, 1)]
    got = sorted([tuple(r) for r in projection.near_duplicate_vectors(vectors(spark, rows).repartition(3)).collect()], key=str)
    want = linked(rows)
    assert max(r[1] for r in want) > 100
    assert got == want
    assert projection.near_duplicate_vectors(vectors(spark, rows).where("false")).count() == 0
    assert projection.near_duplicate_vectors(vectors(spark, [(1, None, 0), (2, [0.0], 1)])).count() == 2


def test_windows_go_on_over_tasks_and_pieces_lose_nothing(spark):
    rows = close(2, 0)
    _, nodes, width = projection._nodes(vectors(spark, rows))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = saved(projection.neighbours(nodes, width, window=40, passes=1), "found")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # the same by one sorted list
    plain = projection._passes(nodes, width, 1, 13).orderBy("which", "key", "node").toPandas()
    u = np.stack([np.frombuffer(bytes(x)) for x in plain.unit])
    i, j = np.nonzero(u @ u.T >= 0.95)
    near = (j > i) & (j <= i + 40)
    one = projection._roots(len(u), i[near], j[near])
    roots = {r.node: r.root for r in components.components(found).collect()}
    groups = lambda pairs: sorted(sorted(n for n, r in pairs if r == root) for root in {r for _, r in pairs})
    assert groups([(int(n), roots.get(n, n)) for n in plain.node]) == groups(list(zip(map(int, plain.node), one.tolist(), strict=True)))
    everyone = nodes.select("node", F.lit(0).cast("long").alias("root"))
    counts = {r.node: r.others for r in projection.links_within(nodes, everyone, width, piece=50).collect()}
    near = u @ u.T >= 0.95
    assert counts == dict(zip(map(int, plain.node), (near.sum(1) - 1).tolist(), strict=True))


def test_passes_follow_the_number_of_vectors():
    few, many = projection.passes_for(1000), projection.passes_for(10**9)
    assert 8 <= few < many < 200
