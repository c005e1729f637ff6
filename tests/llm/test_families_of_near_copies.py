"""A family of near copies makes no row for each pair of its members (the pipeline's failure in the
check of round 3)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.llm import simhash
from trajecta.llm.common import saved


def family(n, words=120, seed=7):
    """Texts of one set of words in which a few words are exchanged, so that most pairs are candidates
    and only a part of them is similar."""
    r = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(words)]
    out = []
    for k in range(n):
        t = list(base)
        for at in r.choice(words, 1 + k % 3, replace=False):
            t[at] = f"x{k % 40}"
        out.append(" ".join(t))
    return out


def groups(texts):
    sets = [simhash._shingles(t.encode().split(), simhash.SHINGLE) for t in texts]
    root = list(range(len(sets)))
    for j, y in enumerate(sets):
        for i in range(j):
            if root[i] != root[j] and simhash._agreement(sets[i], y) >= 0.8 - 1e-9:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


@pytest.mark.parametrize("few", [32, 1])
def test_a_family_in_blocks_and_by_prefixes(spark, few, monkeypatch):
    """Blocks of a cluster, and a cluster of too many blocks, give the groups of all pairs."""
    texts = family(150) + [" ".join(f"lone{k}_{i}" for i in range(30)) for k in range(5)]
    want = groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "FEW", few)
    rows, roots = simhash.similar_groups(docs, block=4000)
    got = {}
    for r in rows.join(roots, "content", "left").select("doc", F.coalesce("root", "content").alias("root")).collect():
        got.setdefault(bytes(r.root), set()).add(r.doc)
    apart = {}
    for k, r in enumerate(want):
        apart.setdefault(r, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, apart.values()))
    assert 1 < len(apart) < len(texts)


def test_links_of_a_family_grow_with_its_members(spark):
    texts = family(400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    contents = saved(simhash._word_rows(docs).dropDuplicates(["content"]), "contents")
    n = contents.count()
    for f in simhash.PRINTS:
        assert simhash._chained(contents, f, simhash.RADIUS).count() <= 2 * n
    rows = contents.withColumn("cluster", F.lit(b"c")).withColumn("block", F.lit(0).cast("long")).withColumn("blocks", F.lit(1).cast("long"))
    same = np.arange(50, dtype=np.uint32).tobytes()
    alike = rows.select("cluster", "block", "blocks", "content", F.lit(same).alias("shingles"))
    assert simhash._inside(alike, 0.8).count() == n - 1


def test_common_shingles_are_counted_by_matrices(monkeypatch):
    monkeypatch.setattr(simhash, "_COLUMNS", 16)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 50))).astype(np.uint32) for _ in range(80)]
    sets += [np.zeros(0, np.uint32), sets[3], np.array([999], np.uint32)]
    for x, y in ((sets, sets), (sets[:30], sets[30:]), (sets[-1:], sets[-3:-2])):
        got = set(zip(*(k.tolist() for k in simhash._similar(x, y, 0.6)), strict=True))
        assert got == {(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if simhash._agreement(a.tobytes(), b.tobytes()) >= 0.6 - 1e-9}
