"""History of a stream in keyed state against the batch of the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.operators import affinity, pairs
from trajecta.streaming import online, recorder

KIND = "seq_id int, frame int, det_idx int, x double, y double, w double, h double, feature array<double>"


@pytest.fixture
def rows():
    rng = np.random.default_rng(0)
    out = [(s, f, k, *map(float, rng.integers(0, 90, 2)), 40.0, 30.0, rng.standard_normal(6).tolist()) for s in range(3) for f in range(1, 25) if (s, f) not in {(0, 7), (1, 8), (1, 9)} for k in range(1, 4)]
    rng.shuffle(out)
    # micro-batches of eight frames whose rows are in any order, and a late one of another sequence
    parts = [[r for r in out if (r[1] - 1) // 8 == b] for b in range(3)]
    return [tuple(r) for p in parts for r in p], [*parts, [(99, 100_000, 1, 0.0, 0.0, 1.0, 1.0, [1.0] * 6)], [(99, 200_000, 1, 0.0, 0.0, 1.0, 1.0, [1.0] * 6)]]


def streamed(spark, tmp_path, parts, make, name):
    for k, p in enumerate(parts):
        df = spark.createDataFrame([(int(r[0]), int(r[1]), int(r[2]), *map(float, r[3:7]), list(map(float, r[7]))) for r in p], KIND)
        df.withColumn("event_time", online.event_time(F.col("frame"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    got = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in")))
    q = got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    states = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    return spark.read.schema(got.schema).parquet(str(tmp_path / "out")), states


def test_stream_of_histories_equals_the_batch(spark, tmp_path, rows):
    every, parts = rows
    got, states = streamed(spark, tmp_path, parts, lambda s: recorder.recorded(s, 5, 0.9, idle_ms=10_000), "r")
    d = spark.createDataFrame([(int(r[0]), int(r[1]), int(r[2]), *map(float, r[3:7]), list(map(float, r[7]))) for r in every], KIND)
    p = pairs.frame_pairs(d, d, 5).withColumn("similarity", affinity.cosine(F.col("a_feature"), F.col("b_feature")) * F.pow(F.lit(0.9), F.col("gap")))
    h = pairs.history(d, 5, 0.9).select("seq_id", "a_frame", "a_det_idx", F.col("b_frame").alias("frame"), F.col("b_det_idx").alias("det_idx"), "overlap")
    want = p.select("seq_id", "a_frame", "a_det_idx", F.col("b_frame").alias("frame"), F.col("b_det_idx").alias("det_idx"), "similarity").join(h, ["seq_id", "a_frame", "a_det_idx", "frame", "det_idx"])
    as_dict = lambda df: {tuple(r)[:5]: tuple(round(x, 9) for x in tuple(r)[5:]) for r in df.select("seq_id", "a_frame", "a_det_idx", "frame", "det_idx", "similarity", "overlap").collect()}
    one, other = as_dict(got), as_dict(want)
    assert one.keys() == other.keys() and len(other) > 2000
    assert all(np.allclose(one[k], other[k]) for k in other)
    assert got.count() == len(one)
    # the sequences that are over have left nothing; the last one's few rows remain
    assert max(states) > 12 and states[-1] <= 6


def test_ended_sequences_of_the_trackers_leave_no_state(spark, tmp_path, rows):
    _, parts = rows
    got, states = streamed(spark, tmp_path, parts, lambda s: online.online_tracks(s, idle_ms=10_000), "t")
    assert got.where("seq_id < 99").select("seq_id", "frame").distinct().count() >= 3 * 22
    assert max(states) >= 3 and states[-1] == 1
