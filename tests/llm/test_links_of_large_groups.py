"""Fingerprints that meet in large groups make links in proportion to their number (the pipeline's
second failure in the check of round 3)."""

import numpy as np
import pytest

from trajecta.llm import simhash
from trajecta.llm.components import components


def crowd(n, seed=3):
    """Fingerprints around a few centres that are near each other, and some far ones."""
    r = np.random.default_rng(seed)
    centres = [0, 0b111111, 0b111111 << 40, *r.integers(0, 1 << 62, 4).tolist()]
    out = set(centres)
    while len(out) < n:
        x = centres[int(r.integers(len(centres)))]
        for at in r.choice(63, int(r.integers(1, 6)), replace=False):
            x ^= 1 << int(at)
        out.add(x)
    return sorted(out)


def roots_of_all_pairs(fps, radius):
    x = np.array(fps, np.int64)
    u, v = np.nonzero(np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius)
    root = x[simhash._joined(u, v, len(x))]
    return {int(a): int(b) for a, b in zip(x, root, strict=True) if (root == b).sum() > 1}


def counted(spark, fps, monkeypatch):
    """Roots by links, and how many rows each step of the links wrote."""
    made, saved = {}, simhash.saved

    def counting(df, label, *rest):
        out = saved(df, label, *rest)
        made[label] = out.count()
        return out

    monkeypatch.setattr(simhash, "saved", counting)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    return {r.node: r.root for r in components(simhash.links(df)).collect()}, made


@pytest.mark.parametrize("many, held", [(4096, 1 << 18), (8, 1 << 18), (3, 40)])
def test_tiles_and_points_give_the_components_of_all_pairs(spark, many, held, monkeypatch):
    monkeypatch.setattr(simhash, "MANY", many)
    monkeypatch.setattr(simhash, "FEW", min(many, 32))
    monkeypatch.setattr(simhash, "_HELD", held)
    fps = crowd(300)
    got, made = counted(spark, fps, monkeypatch)
    assert got == roots_of_all_pairs(fps, simhash.RADIUS)
    assert ("stars" in made) == (many < 300)


def test_a_crowd_makes_no_row_for_each_point(spark, monkeypatch):
    fps = crowd(1500)
    got, made = counted(spark, fps, monkeypatch)
    assert got == roots_of_all_pairs(fps, simhash.RADIUS)
    assert "stars" not in made
    monkeypatch.setattr(simhash, "MANY", 64)
    got, made = counted(spark, fps, monkeypatch)
    assert got == roots_of_all_pairs(fps, simhash.RADIUS)
    # a forest for each of four tasks, where each point made a row before
    assert made["stars"] <= 4 * len(fps)
