"""Metrics of crowded frames without a sequence's pairs in one task."""

import itertools

import numpy as np
import pytest

from tests.test_larger_tables import _crowd, _plan, _rows, _want
from trajecta.operators import evaluate
from trajecta.plans import catalog


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("crowd"))
    _crowd(path)
    return path


@pytest.mark.parametrize("name", ["eval_pairs", "id_cooccurrence"])
def test_pairs_are_made_in_the_task_of_their_frame(spark, crowd, name):
    """Findings 34 and 35."""
    df = catalog.QUERIES[name](spark, crowd)
    assert "Join" not in _plan(df) and _rows(df.toPandas()) == _rows(_want(crowd, name))


def test_clear_mot_holds_a_frame_not_a_sequence(spark, crowd):
    """Finding 4."""
    plan = _plan(evaluate.clear_mot(catalog.gt(spark, crowd), catalog._as_tracks(spark, crowd)))
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan


def test_earlier_matches_stay_and_switches_count():
    m = evaluate._Matches()
    m.step(np.array([1, 1, 2]), np.array([7, 8, 8]), np.array([0.1, 0.2, 0.3]))
    m.step(np.array([1, 1, 2, 2]), np.array([7, 8, 7, 8]), np.array([0.4, 0.0, 0.0, 0.4]))  # 1-7, 2-8 stay
    m.step(np.array([1]), np.array([8]), np.array([0.25]))  # 1 switches
    m.step(np.array([1, 2]), np.array([8, 8]), np.array([0.5, 0.5]))  # both had 8: the later object keeps it
    assert (m.matches, m.switches) == (6, 1) and m.kept == {1: 8, 2: 8} and m.total == pytest.approx(1.95)


def test_pairs_that_cannot_be_in_the_best_pairing_are_left_out(spark):
    """Finding 6: the best total stays, for any counts; with clear ones hardly a pair is left."""
    r = np.random.default_rng(1)
    rows = [(s, o, t, int(r.integers(1, 9))) for s in range(12) for o, t in itertools.product(range(4), range(4)) if r.uniform() < 0.7]
    rows += [(99, o, t, 20 if o == t else 1) for o in range(10) for t in range(10)]
    left = evaluate._possible(spark.createDataFrame(rows, "seq_id int, obj_id long, track_id int, frames long")).collect()
    best = lambda e: max(sum(e.get((o, t), 0) for o, t in enumerate(p)) for p in itertools.permutations(range(4)))
    for s in range(12):
        assert best({(o, t): n for q, o, t, n in rows if q == s}) == best({(x.obj_id, x.track_id): x.frames for x in left if x.seq_id == s})
    assert sum(x.seq_id == 99 for x in left) == 10
