"""Faults that the small tables do not show: crowded frames, full slots, many rows of one group."""

import duckdb
import pytest
from pyspark.sql import functions as F

from trajecta.plans import catalog


def _crowd(path, objects=450, frames=3, sequences=5, vectors=60):
    """Tables with ``objects`` over ``frames`` events each, and vectors with repeated ones."""
    c = duckdb.connect()
    c.sql(f"COPY (SELECT CAST(f * {objects} + (u * 7919) % {objects} AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (f * {objects} + u) AS ts, CAST(u AS BIGINT) AS user_id FROM range({objects}) o(u), range({frames}) r(f)) TO '{path}/events.parquet' (FORMAT parquet)")
    c.sql(f"COPY (SELECT CAST(v AS BIGINT) AS vec_id, list_transform(range(8), lambda k: CAST(sin((v % {vectors - 7}) * 12.9898 + k * 78.233) AS FLOAT)) AS embedding, CAST(v % 3 AS INT) AS label FROM range({vectors}) r(v)) TO '{path}/embeddings.parquet' (FORMAT parquet)")


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("crowd"))
    _crowd(path)
    return path


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


def _want(path, name):
    c = duckdb.connect()
    for t in ("events", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return c.sql(catalog.SQL[name]).df()


@pytest.mark.parametrize("name", ["training_slots", "training_labels"])
def test_slots_of_frames_with_more_boxes_than_places(spark, crowd, name):
    """Findings 25 and 26: the SQL has 80 places, however many boxes there are."""
    assert catalog.det(spark, crowd).groupBy("seq_id", "frame").count().agg(F.max("count")).first()[0] > 80
    assert _rows(catalog.QUERIES[name](spark, crowd).toPandas()) == _rows(_want(crowd, name))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_descriptors_do_not_go_through_the_driver(spark, crowd):
    """Findings 10 and 11: the planner takes the exploded blocks for a small table."""
    assert "BroadcastHashJoin" not in _plan(catalog.QUERIES["descriptor_matches"](spark, crowd))


def test_fundamental_matrices_of_many_matches_take_little_memory():
    """Finding 33: no square of the matches, and draws in pieces."""
    import tracemalloc

    import numpy as np

    from trajecta.operators import epipolar

    r = np.random.default_rng(1)
    a = r.uniform(0, 1000, (20_000, 2))
    b = a + r.normal(0, 5, a.shape)
    tracemalloc.start()
    f, inside = epipolar.ransac(a, b, draws=60)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert f.shape == (3, 3) and inside.sum() >= 8 and top < 400e6


def test_history_similarity_sends_a_vector_once(spark, crowd):
    """Finding 36: rows are not repeated for each gap before they are dealt out."""
    assert "Generate" not in _plan(catalog.QUERIES["history_similarity"](spark, crowd))
    assert _rows(catalog.QUERIES["history_similarity"](spark, crowd).toPandas()) == _rows(_want(crowd, "history_similarity"))


@pytest.mark.parametrize("name", ["kf_smooth", "kf_smooth_varying"])
def test_smoothing_many_objects_at_once_equals_the_folds(spark, crowd, name):
    """Findings 35 and 37: stacked matrices, with the same means as one fold for each object."""
    df = catalog.QUERIES[name](spark, crowd)
    assert "MapInArrow" in _plan(df)
    assert _rows(df.toPandas()) == _rows(_want(crowd, name))


def test_stacked_smoother_equals_the_folds_for_any_model(spark, monkeypatch):
    import numpy as np

    from trajecta.operators import matrices

    r = np.random.default_rng(3)
    spd = lambda n: (lambda a: (a @ a.T + np.eye(n)).tolist())(r.normal(size=(n, n)))
    rows = [(k, t, r.normal(size=2).tolist(), r.normal(size=(3, 3)).tolist(), spd(3), r.normal(size=(2, 3)).tolist(), spd(2), r.normal(size=3).tolist(), spd(3)) for k in range(9) for t in range(1 + k % 4)]
    m = matrices.MATRIX
    df = spark.createDataFrame(rows, f"k long, t int, z array<double>, f {m}, q {m}, h {m}, r {m}, x0 array<double>, p0 {m}").repartition(2, "k")
    monkeypatch.setattr(matrices, "_AT_ONCE", 3)
    got = {(x["k"], x["t"]): x["x"] for x in matrices.smoothed_means(df, ["k"], "t", 3, 2).collect()}
    want = {(x["k"], x["t"]): x["x"] for x in matrices.smoothed(matrices.filtered(df, ["k"], "t", 3, 2), ["k"], "t", 3).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_trackers_hold_a_frame_and_not_a_sequence(spark, crowd):
    """Finding 34: frames come in order, so no sequence is gathered as a group."""
    for name in ("dan_tracks", "kalman_tracks"):
        assert "FlatMapGroups" not in _plan(catalog.QUERIES[name](spark, crowd))


def test_streamed_frames_equal_whole_sequences(spark):
    from trajecta.operators import tracker

    rows = [(s, f, k, 100.0 * k + f, 50.0, 40.0, 80.0) for s in (0, 1, 2) for f in (2, 3, 7, 8) for k in (1, 2, 3)]
    d = spark.createDataFrame(rows, "seq_id int, frame int, det_idx int, x double, y double, w double, h double")
    want = []
    for s in (0, 1, 2):
        machine, pdf = tracker.KalmanTracker(), d.where(f"seq_id = {s}").toPandas()
        for f, part in tracker.frames_of(pdf):
            want += tracker._rows(s, f, part["det_idx"].to_numpy(), machine.step(part[["x", "y", "w", "h"]].to_numpy()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [tuple(r) for r in tracker.kalman_tracks(d).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["eval_pairs", "id_cooccurrence", "greedy_global", "greedy_local", "mcf_edges"])
def test_gated_pairs_come_from_a_grid(spark, crowd, name):
    """Findings 5, 21, 23, 24, 31 and 32: no list of all pairs of a frame."""
    assert "cx" in _plan(catalog.QUERIES[name](spark, crowd))
    assert _rows(catalog.QUERIES[name](spark, crowd).toPandas()) == _rows(_want(crowd, name))


def test_loss_in_blocks_equals_the_loss_of_all_cells(spark, crowd, monkeypatch):
    """Finding 17: no row for each cell of a frame's matrix, which is made in blocks."""
    from trajecta.operators import affinity

    d = catalog._featured(spark, crowd)
    want = affinity.association_loss(affinity.frame_affinities(d, 80, 10.0)).toPandas().set_index("seq_id").sort_index()
    monkeypatch.setattr(affinity, "_CELLS", 1000)
    got = affinity.frame_losses(d, 80, 10.0).toPandas().set_index("seq_id").sort_index()
    assert len(got) == 5 and (abs(got - want[got.columns]) < 1e-9).all().all()
    assert _rows(catalog.QUERIES["dan_loss"](spark, crowd).toPandas()) == _rows(_want(crowd, "dan_loss"))


def test_links_in_pieces_equal_the_sql(spark, crowd, monkeypatch):
    """Findings 6 and 19: a frame's pairs are looked at in pieces."""
    from trajecta.operators import flow

    monkeypatch.setattr(flow, "_CELLS", 500)
    assert _rows(catalog.QUERIES["transition_cost"](spark, crowd).toPandas()) == _rows(_want(crowd, "transition_cost"))


def test_mutual_nearest_vectors_come_from_matrix_products(spark, crowd):
    """Finding 29: the rows of a part do not meet as pairs; equal vectors are ties."""
    df = catalog.QUERIES["mutual_nn"](spark, crowd)
    assert "FlatMapCoGroupsInPandas" in _plan(df) and _rows(df.toPandas()) == _rows(_want(crowd, "mutual_nn"))
