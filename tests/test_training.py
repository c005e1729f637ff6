"""Drawn steps of training samples, slots with labels, and stand-ins for empty samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.operators import training
from trajecta.operators.transforms import FACTORS, PRIME

BOXES = "seq_id int, frame int, obj_id long, x1 double, y1 double, x2 double, y2 double"


def number(seed, *keys):
    m = (seed * 2_654_435_761 % PRIME + sum(k * f for k, f in zip(keys, FACTORS, strict=False))) % PRIME
    return (m * m + m * 7919) % PRIME


def unit(seed, *keys):
    return number(seed, *keys) / PRIME


def _boxes(frames=30, objects=6):
    r = np.random.default_rng(7)
    out = []
    for f in range(1, frames + 1):
        for o in range(objects):
            if r.random() < 0.8:
                x, y, w, h = r.uniform(0, 1800), r.uniform(0, 900), r.uniform(20, 100), r.uniform(50, 170)
                out.append((f % 2, f, o, x, y, x + w, y + h))
    return out


def _samples(spark, boxes, gap=2):
    pairs = sorted({(b[0], b[1], b[1] + gap) for b in boxes})
    return training.samples(spark.createDataFrame(pairs, "seq_id int, frame int, next_frame int"), spark.createDataFrame(boxes, BOXES), 1920, 1080)


def _as(rows):
    return [(b["obj_id"], b["x1"], b["y1"], b["x2"], b["y2"]) for b in rows]


def _cropped(pre, nxt, w0, h0, seed, seq, frame, tries, rounds):
    inside = lambda b, v: v[0] < (b[1] + b[3]) / 2 < v[2] and v[1] < (b[2] + b[4]) / 2 < v[3]
    for t in range(tries * rounds):
        if int(unit(seed, seq, frame, t // tries) * 6) == 0:
            return pre, nxt, w0, h0
        w, h = (0.8 + 0.2 * unit(seed + 1, seq, frame, t)) * w0, (0.8 + 0.2 * unit(seed + 2, seq, frame, t)) * h0
        left, top = unit(seed + 3, seq, frame, t) * (w0 - w), unit(seed + 4, seq, frame, t) * (h0 - h)
        v = int(left), int(top), int(left + w), int(top + h)
        if not 0.5 <= h / w <= 2:
            continue
        kept = [[(b[0], max(b[1], v[0]) - v[0], max(b[2], v[1]) - v[1], min(b[3], v[2]) - v[0], min(b[4], v[3]) - v[1]) for b in side if inside(b, v)] for side in (pre, nxt)]
        if all(kept):
            return *kept, v[2] - v[0], v[3] - v[1]
    return pre, nxt, w0, h0


@pytest.mark.parametrize(("tries", "rounds"), [(50, 8), (1, 1), (3, 2)])
def test_crops_equal_a_plain_loop(spark, tries, rounds):
    df = _samples(spark, _boxes())
    before = {(r["seq_id"], r["frame"]): r for r in df.collect()}
    got = df.transform(training.cropped(5, tries, rounds)).collect()
    assert len(got) == len(before)
    changed = 0
    for r in got:
        b = before[r["seq_id"], r["frame"]]
        pre, nxt, w, h = _cropped(_as(b["pre"]), _as(b["next"]), 1920, 1080, 5, r["seq_id"], r["frame"], tries, rounds)
        assert np.allclose(_as(r["pre"]), pre) and len(r["next"]) == len(nxt)
        assert not nxt or np.allclose(_as(r["next"]), nxt)
        assert (r["width"], r["height"]) == (w, h)
        changed += (w, h) != (1920, 1080)
    assert changed


def test_moves_stay_inside_and_expansions_keep_sizes(spark):
    df = _samples(spark, _boxes())
    before = {(r["seq_id"], r["frame"]): r for r in df.collect()}
    for r in df.transform(training.moved(0.0, 0.2, 3)).collect():
        for side in training.SIDES:
            for a, b in zip(_as(before[r["seq_id"], r["frame"]][side]), _as(r[side]), strict=True):
                assert 0 <= b[1] <= b[3] <= 1920 and 0 <= b[2] <= b[4] <= 1080
                assert abs(b[1] - a[1]) <= 0.2 * (a[3] - a[1]) + 1e-9
    grown = df.transform(training.expanded(1.5, 8)).collect()
    assert {r["width"] == 1920 for r in grown} == {True, False}
    for r in grown:
        assert 1920 <= r["width"] <= 2880 and 1080 <= r["height"] <= 1620
        for a, b in zip(_as(before[r["seq_id"], r["frame"]]["pre"]), _as(r["pre"]), strict=True):
            assert np.isclose(b[3] - b[1], a[3] - a[1]) and b[3] <= r["width"] + 101 and b[1] >= a[1]
            assert float(b[1] - a[1]).is_integer() or np.isclose((b[1] - a[1]) % 1, 0) or np.isclose((b[1] - a[1]) % 1, 1)


def test_validation_draws_nothing(spark):
    df = _samples(spark, _boxes())
    plain = df.transform(training.chain("valid")).collect()
    before = {(r["seq_id"], r["frame"]): r for r in df.collect()}
    for r in plain:
        assert np.allclose(_as(r["pre"]), [(o, a / 1920, b / 1080, c / 1920, d / 1080) for o, a, b, c, d in _as(before[r["seq_id"], r["frame"]]["pre"])])


def test_same_seed_same_samples_in_any_plan(spark):
    boxes = _boxes()
    one = _samples(spark, boxes).transform(training.chain("train", seed=4))
    two = _samples(spark, boxes[::-1]).repartition(7).transform(training.chain("train", seed=4))
    other = _samples(spark, boxes).transform(training.chain("train", seed=5))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one) == key(two) != key(other)


def test_steps_after_the_joins_shuffle_nothing(spark):
    df = _samples(spark, _boxes())
    count = lambda d: d._jdf.queryExecution().sparkPlan().toString().count("Exchange")
    assert count(training.slot_rows(training.slotted(df.transform(training.chain("train")), 8, 1))) == count(df)


def test_slots_and_labels(spark):
    slots = 8
    df = training.slotted(_samples(spark, _boxes()), slots, 2)
    rows, ones = training.slot_rows(df).collect(), training.label_rows(df).collect()
    before = {(r["seq_id"], r["frame"]): r for r in _samples(spark, _boxes()).collect()}
    place = {}
    for r in rows:
        place.setdefault((r["seq_id"], r["frame"], r["side"]), {})[r["slot"]] = r
    for (seq, frame, side), got in place.items():
        mine = before[seq, frame][side]
        order = sorted(range(slots), key=lambda i: (number(2 + (side == "next"), seq, frame, i), i))
        assert sorted(got) == list(range(slots))
        for slot, i in enumerate(order):
            r = got[slot]
            if i < len(mine):
                assert r["obj_id"] == mine[i]["obj_id"] and r["present"] == 1 and np.isclose(r["cx"], mine[i]["x1"] + mine[i]["x2"] - 1)
            else:
                assert r["obj_id"] is None and r["present"] == 0 and (r["cx"], r["cy"]) == (1.5, 1.5)
    for key in before:
        ids = [{s: r["obj_id"] for s, r in place[(*key, side)].items() if r["present"]} for side in training.SIDES]
        want = {(a, b) for a, x in ids[0].items() for b, y in ids[1].items() if x == y}
        want |= {(a, slots) for a, x in ids[0].items() if x not in ids[1].values()} | {(slots, b) for b, y in ids[1].items() if y not in ids[0].values()}
        assert {(r["row"], r["col"]) for r in ones if (r["seq_id"], r["frame"]) == key} == want


def test_more_boxes_than_places_and_frames_without_boxes(spark):
    boxes = [(0, 1, k, 1.0, 1.0, 5.0, 5.0) for k in range(5)]
    df = _samples(spark, boxes)
    out = df.transform(training.chain("train"))
    assert out.count() == 1 and out.first()["next"] == []
    rows = training.slot_rows(training.slotted(df, 3, 1))
    assert rows.where("side = 'pre' AND present = 1").count() == 5 and rows.where("side = 'next' AND present = 0").count() == 5
    assert {(r["col"]) for r in training.label_rows(training.slotted(df, 3, 1)).collect()} == {5}
    assert training.slot_rows(training.slotted(_samples(spark, boxes).where("false"), 3, 1)).count() == 0


def test_stand_ins_for_empty_samples(spark):
    items, filled = [*range(40), 90, 100], [*range(0, 12), 30, 31, 105]
    got = dict(training.redrawn(spark.createDataFrame([(i,) for i in items], "item long"), spark.createDataFrame([(i,) for i in filled], "item long"), 5, 4, 3).collect())
    want = {}
    for i in items:
        ways = [i] if i in filled else []
        ways += [i + number(3, i, t) % 11 - 5 for t in range(4)]
        ways += [i + s * k for k in range(1, 6) for s in (-1, 1)]
        hit = [w for w in ways if w in filled]
        if hit:
            want[i] = hit[0]
    assert got == want and 20 not in got and got[100] == 105 and 90 not in got
