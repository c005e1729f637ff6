"""Detections in .npy files, and image listings as bounded batches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.sources import mot, npy
from trajecta.streaming import images


def _matrix(n, dim, seed):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, 10 + dim))
    m[:, 0], m[:, 1] = np.sort(r.integers(1, 20, n)), -1
    return m


@pytest.fixture
def folder(tmp_path):
    made = {"A": _matrix(500, 4, 1), "B": np.asfortranarray(_matrix(300, 4, 2)), "C": _matrix(40, 0, 3).astype(np.float32), "D": _matrix(0, 4, 4)}
    for k, m in made.items():
        os.makedirs(f"{tmp_path}/{k}")
        np.save(f"{tmp_path}/{k}/det.npy", m)
    return str(tmp_path), made


def test_every_row_of_every_layout(spark, folder):
    path, made = folder
    df = npy.read_npy(spark, path)
    got = df.toPandas()
    for k, m in made.items():
        mine = got[got["sequence"] == k].sort_values("row")
        assert mine["row"].tolist() == list(range(len(m)))
        if len(m):
            assert np.array_equal(mine[["x", "y", "w", "h", "score"]].to_numpy(), np.asarray(m[:, 2:7], float))
            assert np.array_equal(np.array(mine["feature"].tolist()).reshape(len(m), -1), np.asarray(m[:, 10:], float))


def test_small_shares_and_blocks_read_the_same(spark, folder, monkeypatch):
    path, _ = folder
    whole = npy.read_npy(spark, path)
    cut = spark.read.format("mot_npy").option("splitBytes", "3000").load(path)
    assert cut.rdd.getNumPartitions() > 10
    assert cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0
    monkeypatch.setattr(npy, "BLOCK", 1000)
    reader = npy.NpyReader({"path": path})
    rows = [r for s in reader.partitions() for r in reader.read(s)]
    assert len(rows) == whole.count()


def test_filters_choose_files_and_rows(spark, folder):
    path, made = folder
    one = npy.read_npy(spark, path).where("sequence = 'A' AND frame BETWEEN 5 AND 9")
    assert one.rdd.getNumPartitions() == 1
    assert one.count() == int(((made["A"][:, 0] >= 5) & (made["A"][:, 0] <= 9)).sum())
    assert npy.read_npy(spark, path).where("sequence IN ('A', 'C') AND frame > 9").count() == sum(int((made[k][:, 0] > 9).sum()) for k in "AC")
    assert npy.read_npy(spark, path).where("sequence = 'none'").count() == 0


def test_features_can_be_left_out(spark, folder):
    assert npy.read_npy(spark, folder[0], features=False).where("feature IS NOT NULL").count() == 0


def test_round_trip(spark, folder, tmp_path):
    path, made = folder
    df = npy.read_npy(spark, path)
    to = f"{tmp_path}/out/again"
    npy.write_npy(df, to, 3)
    again = npy.read_npy(spark, to)
    cols = ["sequence", "frame", "id", "x", "y", "w", "h", "score", "feature"]
    assert again.select(cols).exceptAll(df.select(cols)).count() == 0 and again.count() == df.count()
    assert not os.path.exists(f"{to}/_pending")
    frames = again.where("sequence = 'A'").orderBy("file", "row").toPandas()
    assert all((np.diff(g["frame"]) >= 0).all() for _, g in frames.groupby("file"))


def test_wrong_files_are_named(spark, tmp_path):
    os.makedirs(f"{tmp_path}/S")
    np.save(f"{tmp_path}/S/bad.npy", np.zeros((3, 4)))
    with pytest.raises(Exception, match="bad.npy"):
        npy.read_npy(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="nowhere"):
        npy.read_npy(spark, f"{tmp_path}/nowhere").count()


def test_gathered(spark, folder):
    path, made = folder
    for k, rate in (("A", "frameRate=25\n"), ("B", "")):
        with open(f"{path}/{k}/seqinfo.ini", "w") as f:
            f.write(f"[Sequence]\nname={k}1\n{rate}seqLength=20\n")
    got = {r["sequence"]: r for r in npy.gathered(npy.read_npy(spark, path), mot.read_sequences(spark, [f"{path}/*/seqinfo.ini"])).collect()}
    assert set(got) == {"A", "B", "C"}
    assert (got["A"]["name"], got["A"]["feature_dim"], got["A"]["update_ms"], got["A"]["n_detections"]) == ("A1", 4, 40.0, 500)
    assert (got["A"]["min_frame"], got["A"]["max_frame"]) == (made["A"][:, 0].min(), made["A"][:, 0].max())
    assert (got["C"]["name"], got["C"]["feature_dim"], got["C"]["update_ms"]) == ("C", 0, None)


def test_batches_of_images_are_bounded_and_in_order(spark, tmp_path):
    seen = []

    def write(names, since):
        for k, n in enumerate(names):
            with open(f"{tmp_path}/img/{n}", "wb") as f:
                f.write(n.encode())
            os.utime(f"{tmp_path}/img/{n}", (since + k, since + k))

    os.makedirs(f"{tmp_path}/img")
    write([f"{n:06d}.jpg" for n in range(1, 12)] + ["cover.png", "notes.txt"], 1_000_000_000)

    def run():
        stream = images.stream_images(spark, f"{tmp_path}/img", 4)
        images.each_batch(stream, lambda df, n: seen.append([(r["name"], r["frame"], bytes(r["content"])) for r in df.collect()]), f"{tmp_path}/log").awaitTermination()

    run()
    assert [len(b) for b in seen] == [4, 4, 4]
    assert [r[0] for b in seen for r in b] == [f"{n:06d}.jpg" for n in range(1, 12)] + ["cover.png"]
    assert seen[0][0] == ("000001.jpg", 1, b"000001.jpg") and seen[2][3][1] is None
    write(["000012.jpg"], 1_000_000_100)
    run()
    assert [r[0] for r in seen[3]] == ["000012.jpg"] and len(seen) == 4
