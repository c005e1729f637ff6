import numpy as np
import pytest

from trajecta.operators import tracker
from trajecta.plans import config
from trajecta.sources import mot
from trajecta.streaming.online import event_time, online_tracks


@pytest.fixture()
def folder(tmp_path):
    s = tmp_path / "MOT-01"
    (s / "det").mkdir(parents=True)
    (s / "gt").mkdir()
    (s / "det/det.txt").write_text("1,-1,10.7,20.2,30,40,0.9\n2,-1,11,21,30,40,0.2\n")
    (s / "gt/gt.txt").write_text("1,3,10,20,30,40,1,1,0.8\n2,3,11,21,30,40,0,1,0.8\n")
    (s / "seqinfo.ini").write_text("[Sequence]\nname=MOT-01\nimWidth=1920\nimHeight=1080\nseqLength=2\nframeRate=30\n")
    return tmp_path


def test_mot_files(spark, folder):
    d = mot.read_detections(spark, f"{folder}/*/det/det.txt").orderBy("frame").collect()
    assert [(r.sequence, r.frame, r.det_idx, r.x) for r in d] == [("MOT-01", 1, 1, 10.7), ("MOT-01", 2, 1, 11.0)]
    g = mot.read_ground_truth(spark, f"{folder}/*/gt/gt.txt").collect()
    assert len(g) == 2 and g[0].obj_id == 3
    s = mot.read_sequences(spark, [f"{folder}/MOT-01/seqinfo.ini"]).first()
    assert (s.name, s.width, s.length, s.frame_rate) == ("MOT-01", 1920, 2, 30)
    with pytest.raises(FileNotFoundError):
        mot.check_paths(str(folder / "none"))


def test_results_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(0, 1, 5, 1.9, 2.9, 3.0, 4.0)], "seq_id int, frame int, track_id int, x double, y double, w double, h double")
    mot.write_results(t, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/seq_id=0")).first()[:6] == ("1", "5", "1", "2", "3", "4")


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(s, f, k, 100.0 * k + 3 * f, 50.0 + 2 * f, 40.0, 80.0) for s in range(2) for f in range(1, 25) for k in range(3) if rng.random() > 0.1]
    schema = "seq_id int, frame int, det_idx int, x double, y double, w double, h double"
    batch = spark.createDataFrame(rows, schema)
    want = {(r.seq_id, r.frame, r.track_id, r.det_idx) for r in tracker.kalman_tracks(batch).collect()}
    for part in range(4):  # each file holds some frames in a mixed order; the last one moves the watermark on
        mine = [rows[i] for i in rng.permutation(len(rows)) if (rows[i][1] - 1) // 6 == part]
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(0, 999, 0, 0.0, 0.0, 1.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online_tracks(live.withColumn("event_time", event_time(live["frame"])), "2 seconds").writeStream.format("memory").queryName("released").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.seq_id, r.frame, r.track_id, r.det_idx) for r in spark.table("released").where("observed >= 0 AND frame <= 24").collect()}
    assert got and {r for r in got if r[1] <= 20} == {r for r in want if r[1] <= 20}


def test_settings(tmp_path):
    (tmp_path / "base.yaml").write_text("track: {age: 3, sizes: '(1, 2)', deep: {a: 1}}\nname: x\n")
    (tmp_path / "own.yaml").write_text("_base_: base.yaml\ntrack: {age: 5, deep: {_delete_: true, b: 2}}\n")
    c = config.load(str(tmp_path / "own.yaml"))
    assert c.track.age == 5 and c.track.sizes == (1, 2) and c.track.deep == {"b": 2} and c.name == "x"
    assert c.with_options({"track.age": 9}).track.age == 9
    with pytest.raises(AttributeError):
        c.missing
    assert config.parser_for(c).parse_args(["--track.age", "4"])


def test_runtime_helpers(spark):
    from trajecta.plans import runtime

    with runtime.Timer() as t:
        pass
    assert t.since_start() >= 0 and t.since_last() >= 0
    m = runtime.Meters()
    m.add({"loss": 2.0}, 3)
    m.add({"loss": 6.0})
    assert m.mean("loss") == 3.0
    assert runtime.seed_everything(1).integers(100) == runtime.seed_everything(1).integers(100)
    assert len(runtime.logger("t").handlers) == len(runtime.logger("t").handlers) == 1
    assert runtime.compose(lambda d: d.where("id > 3"), lambda d: d.limit(2))(spark.range(9)).count() == 2


def test_detections_keep_the_order_of_the_file(spark, tmp_path):
    from trajecta.sources import mot

    at = tmp_path / "SEQ" / "det"
    at.mkdir(parents=True)
    (at / "det.txt").write_text("1,-1,9,0,5,5,0.1\n1,-1,1,0,5,5,0.9\n2,-1,3,0,5,5,0.5\n1,-1,5,0,5,5,0.9\n")
    got = mot.read_detections(spark, str(at / "det.txt")).where("frame = 1").orderBy("det_idx").collect()
    assert [(r.det_idx, r.x) for r in got] == [(1, 9.0), (2, 1.0), (3, 5.0)]


def test_folders_without_sequence_information(spark, tmp_path):
    import struct

    from trajecta.sources import mot

    at = tmp_path / "S-01" / "img1"
    at.mkdir(parents=True)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    for n in ("000001.png", "000002.png", ".hidden.png", "note.txt"):
        (at / n).write_bytes(png)
    (at / "sub").mkdir()
    (at / "sub" / "000009.png").write_bytes(png)
    files = lambda **k: sorted(r.file for r in mot.scan_files(spark, str(at), **k).collect())
    assert files(suffix="png") == ["000001.png", "000002.png"]
    assert files(suffix=("png", "txt"), without=("0002",), recursive=True) == ["000001.png", "note.txt", "sub/000009.png"]
    got = mot.folder_information(spark, str(tmp_path / "S-01" / "img1"), ("png",))
    assert (got["name"], got["width"], got["height"]) == ("S-01", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 50) + b"\0" * 9
    assert mot.image_size(jpeg) == (50, 30) and mot.image_size(b"??") == (None, None)
