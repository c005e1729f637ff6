"""Exact candidates of crowded contents (the pipeline's second failure in the check of round 3)."""

import numpy as np

from trajecta.llm import simhash


def test_pairs_that_meet_too_late_are_no_candidates(spark):
    """All similar pairs are found; contents that share the common shingles only do not meet as pairs."""
    r = np.random.default_rng(5)
    sets = []
    for k in range(60):  # 40 shingles: the first of the common ones is the last that is looked at
        sets.append(np.concatenate([1000 + 100 * k + np.arange(8), np.arange(32)]))
    for k in range(20):  # near copies of the first ones, and copies that are just not near
        sets.append(np.concatenate([sets[k][r.permutation(40)[: 37 if k % 2 else 33]], 90_000 + 10 * k + np.arange(2)]))
    rows = [(bytes([k]), np.unique(s.astype(np.uint32)).tobytes()) for k, s in enumerate(sets)]
    known = spark.createDataFrame(rows, "content binary, shingles binary")
    want = {(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if simhash._agreement(x, y) >= 0.8}
    roots = spark.createDataFrame([], "content binary, root binary")
    got = {(bytes(p.a), bytes(p.b)) for p in simhash._rest(known.select("content"), known, roots, 0.8).collect()}
    assert len(want) >= 8 and want <= got and len(got) <= 200
