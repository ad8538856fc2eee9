"""Pixels and models' answers, against plain loops."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import model_calls, pixels, records


def test_colours(spark):
    r = np.random.default_rng(1)
    cmyk = r.integers(0, 256, 4 * 60, np.uint8)
    want = bytearray()
    for i in range(0, len(cmyk), 4):
        c, m, y, k = (np.float32(v) / np.float32(255) for v in cmyk[i : i + 4])
        want += bytes(int(np.float32(255) * (np.float32(1) - v) * (np.float32(1) - k)) for v in (c, m, y))
    rows = [
        (1, bytes(cmyk), 10, 6, "DeviceCMYK"), (2, bytes(range(7)), 2, 1, "DeviceRGB"), (3, bytes(range(3)), 3, 1, "DeviceGray"), (4, bytes(5), 2, 1, "DeviceRGB"), (5, None, 1, 1, "DeviceGray"),
        (6, bytes(9), 0, 3, "DeviceGray"), (7, bytes(9), 1, 1, "Lab"), (8, bytes(9), 1, None, "DeviceRGB"), (9, b"", 1, 1, None),
    ]
    df = spark.createDataFrame(rows, "id int, content binary, width int, height int, space string")
    got = {x.id: None if x.rgb is None else bytes(x.rgb) for x in pixels.coloured(df, "id").collect()}
    assert got == {1: bytes(want), 2: bytes(range(6)), 3: bytes([0, 0, 0, 1, 1, 1, 2, 2, 2])} | dict.fromkeys(range(4, 10))
    assert pixels.coloured(df.limit(0), "id").count() == 0
    assert sorted(x.id for x in pixels.model_inputs(df, "id", 4).collect()) == [1, 2, 3]


@pytest.mark.parametrize("h,w,side", [(5, 3, 8), (13, 29, 6), (1, 7, 4), (8, 8, 8)])
def test_resampling_is_a_plain_loop(h, w, side):
    rgb = np.random.default_rng(h).integers(0, 256, (h, w, 3)).astype(np.uint8)

    def along(line, target):
        ratio = len(line) / target
        wide, out = max(ratio, 1.0), []
        for t in range(target):
            centre = (t + 0.5) * ratio
            weights = [max(0.0, 1 - abs(i + 0.5 - centre) / wide) for i in range(len(line))]
            out.append(sum(x * v for x, v in zip(weights, line)) / sum(weights))
        return out

    want = np.zeros((3, side, side))
    for c in range(3):
        down = np.array([along(rgb[:, x, c].astype(float), side) for x in range(w)]).T
        both = np.array([along(row, side) for row in down])
        want[c] = (np.floor(both + 0.5) / 255 - pixels.MEAN[c]) / pixels.DEVIATION[c]
    got = pixels.tensor(rgb, side)
    assert got.shape == (3, side, side) and got.dtype == np.float32
    # a value just at a half may be rounded either way
    assert np.abs(got - want).max() < 0.02 and np.mean(np.abs(got - want) < 1e-4) > 0.95


def test_calls_that_fail_hang_or_are_cancelled(spark):
    def client():
        def call(given):
            word = given["user_prompt"].split()[-1]
            if word == "hang":
                time.sleep(20)
            if word == "fail":
                raise RuntimeError("no")
            return f"{given['system_prompt']}/{given['temperature']}/{given['user_prompt']}"

        return call

    hooks = model_calls.Interceptors(
        [("x", lambda c: None if c["user_prompt"] == "stop" else c), ("y", lambda c: 1 / 0), ("me", lambda c: None), ("z", lambda c: c | {"temperature": 0.1})],
        [("y", lambda a: 1 / 0), ("z", lambda a: {"response": a["response"].upper()}), ("w", lambda a: None)],
    )
    prompts = spark.createDataFrame([(1, "go"), (2, "stop"), (3, "fail"), (4, "hang"), (5, None), (6, "")], "id int, user_prompt string").coalesce(1)
    begun = time.monotonic()
    got = {r.id: (r.answer, r.outcome) for r in model_calls.answered(prompts, "id", client, hooks, "me", "s", seconds=2).collect()}
    assert got == {1: ("S/0.1/GO", "answered"), 2: (None, "cancelled"), 3: (None, "failed: no"), 4: (None, "late"), 5: (None, "cancelled"), 6: (None, "failed: list index out of range")}
    assert time.monotonic() - begun < 60
    assert model_calls.answered(prompts.where("id = 1"), "id").first().answer == "offline: go"


def test_classified_images(spark):
    item = lambda **k: json.dumps([k], ensure_ascii=False)
    rows = [
        (1, "x " + item(pageIndex=3, category="flowchart", caption="c") + " y"), (2, item(category="other")), (3, item(pageIndex=0, category="chart", caption="")), (4, "[1, 2"), (5, "[not json]"), (6, None),
        (7, "[]"), (8, "a [1] b " + item(pageIndex=2)), (9, item(pageIndex=None, category=5, caption=None)),
    ]
    df = spark.createDataFrame(rows, "id int, answer string").select("id", model_calls.classified_images(F.col("answer"), F.array(F.lit(4), F.lit(9))).alias("x"))
    got = {r.id: [tuple(x) for x in r.x] for r in df.collect()}
    plain = [(4, "other", "第5页的图片"), (9, "other", "第10页的图片")]
    assert got == {1: [(3, "flowchart", "c")], 2: [], 3: [(0, "other", "未命名图片")], 4: plain, 5: plain, 6: plain, 7: [], 8: [], 9: [(None, "other", "未命名图片")]}


def test_rankings_of_files(spark, tmp_path):
    entries = [{"journal": "Nature", "zone": 1, "is_top": True}, {"journal": "nature!"}, {"journal": "Loom", "zone": "2", "is_top": 1}, {"zone": 1}, {"journal": "!"}, {"journal": "Web", "is_oa": True}]
    for name, text in (("a", json.dumps(entries, indent=2)), ("b", "[{"), ("c", "{}")):
        (tmp_path / f"file={name}").mkdir()
        (tmp_path / f"file={name}" / "r.json").write_text(text)
    got = sorted(tuple(r) for r in records.rankings_read(spark, str(tmp_path), "file").collect())
    assert got == [("a", "loom", "Loom", 4, False, False), ("a", "nature", "Nature", 1, True, False), ("a", "web", "Web", 4, False, True)]


def test_eraser_takes_the_topmost_stroke(spark):
    line = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    rows = [
        (1, 1, "pen", line((0, 0), (1, 1))), (1, 2, "marker", line((0, 1), (1, 0))), (1, 3, "rect", line((0, 0), (1, 1))), (1, 4, "pen", line((0.9, 0), (0.9, 1))), (2, 1, "pen", line((0.5, 0.51))), (2, 2, "pen", []),
        (3, 1, "pen", line((0.5, 0.53), (0.6, 0.9))), (4, 1, "text", line((0.5, 0.5))),
    ]
    df = spark.createDataFrame(rows, "page int, ord int, kind string, points array<struct<x double, y double>>")
    assert sorted(tuple(r) for r in records.erased(df, ["page"], F.lit(0.5), F.lit(0.5)).collect()) == [(1, 2), (2, 1)]
