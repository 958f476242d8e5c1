"""Nested documents: a round trip, corners, sidecars, errors, and a failed task that leaves nothing."""

import json
import math
import os

import pytest
from millwright.sources import documents as d
from pyspark.sql import functions as F


def tables(spark):
    stamps = [("scan one.png", 100.0, k, "ok", 12.5 + k, 13.0, 400.0, 300.0 if k > 1 else float("nan")) for k in (2, 1, 3)] + [("two", 200.0, 1, "review", None, 12.0, None, None), (None, 1.0, 1, "ok", 1.0, 1.0, 1.0, 1.0)]
    lines = {"top": [[0.0, 0.0], [100.0, 0.0]], "bottom": [[0.0, 80.0], [100.0, 80.0]], "left": [[0.0, 0.0], [0.0, 80.0]], "right": [[100.0, 0.0], [100.0, 80.0]]}
    sides = [("scan one.png", 1, s, "ok", 10.0, i, lines[s]) for i, s in enumerate(lines)] + [("scan one.png", 2, "top", "ok", float("inf"), 2, None)]
    holes = [("scan one.png", 1, "top", 95.0 - 10 * i, i != 4, "circle" if i < 9 else "parabola", 95.0 - 10 * i, 0.0) for i in range(10)] + [("scan one.png", 1, s, 4.0 + 10 * i, True, "circle", x, 4.0 + 10 * i) for s, x in (("left", 0.0), ("right", 100.0)) for i in range(8)]
    holes += [("scan one.png", 1, "bottom", None, True, None, None, None)]
    return (
        spark.createDataFrame(stamps, "source string, dpi double, stamp int, status string, horizontal double, vertical double, valley_width_px double, valley_height_px double"),
        spark.createDataFrame(sides, "source string, stamp int, side string, status string, pitch_px double, phase int, line_image array<array<double>>"),
        spark.createDataFrame(holes, "source string, stamp int, side string, position double, accepted boolean, model string, x double, y double"),
    )


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    d.write_documents(*tables(spark), path)
    assert sorted(os.listdir(path)) == ["data_scan_one.png_perf.json", "data_two_perf.json"]
    whole = json.loads((tmp_path / "out" / "data_scan_one.png_perf.json").read_text())
    assert [s["stamp"] for s in whole["stamps"]] == [1, 2, 3] and whole["stamps"][0]["measurement"]["valley_height_px"] is None
    assert set(whole["stamps"][2]["measurement"]["sides"]) == set(d.SIDES) and whole["stamps"][2]["measurement"]["sides"]["left"] == {"status": "unavailable", "reason": "no orientation", "pitch_px": None, "phase": None, "line_image": None, "holes": []}
    top = whole["stamps"][0]["measurement"]["sides"]["top"]["holes"]
    assert [h["id"] for h in top] == list(range(1, 11)) and [h["point_image"][0] for h in top] == [5.0 + 10 * i for i in range(10)]
    assert [h["category"] for h in top] == ["approximation"] + ["perforation"] * 4 + ["ignored_perforation"] + ["perforation"] * 4
    got = d.read_documents(spark, [path])
    rows = {(r.source, r.stamp): r for r in got.stamps.collect()}
    assert set(rows) == {("scan one.png", "1"), ("scan one.png", "2"), ("scan one.png", "3"), ("two", "1")}
    one = rows["scan one.png", "1"]
    assert (one.horizontal, one.vertical, one.status, one.worst_phase, one.reason, one.height_mm) == (13.5, 13.0, "ok", 3, None, None)
    assert one.width_mm == pytest.approx(101.6) and one.width_holes == math.ceil(101.6 / (20 / 13.5)) + 1 and one.height_holes is None
    assert rows["two", "1"].reason == "incomplete gauge pair" and rows["two", "1"].width_mm is None
    assert {(r.side, r.pitch_px, r.x2) for r in got.sides.where("source = 'scan one.png' and stamp = '1'").collect()} == {("top", 10.0, 100.0), ("bottom", 10.0, 100.0), ("left", 10.0, 0.0), ("right", 10.0, 100.0)}
    assert got.holes.count() == 27 and got.errors.count() == 0
    corners = {r.corner: r for r in got.corners.collect()}
    # the nearest circles are 5 and 4 from the upper right corner; the upper left has one 15 away, beyond 1.25 pitches
    assert set(corners) == {"top-right"}
    c = corners["top-right"]
    assert (c.horizontal_phase, c.vertical_phase, c.phase_mismatch) == pytest.approx((0.5, 0.4, 0.1)) and c.center_separation == pytest.approx(math.hypot(5, 4) / 10)


def test_sidecars_and_errors(spark, tmp_path):
    path = tmp_path / "in"
    d.write_documents(*tables(spark), str(path))
    write = lambda name, **doc: (path / name).write_text(json.dumps({"format": d.DESIGN_FORMAT, **doc}))
    write("data_two_design.json", stamps=[{"stamp": 1, "design_width_mm": 20.5, "design_height_mm": "30", "registration_status": "review", "registration_reasons": ["a", "b"]}, {"stamp": 2, "design_width_mm": 0, "design_height_mm": 3}])
    write("data_alone_design.json", stamps=[{"stamp": 1, "design_width_mm": 1, "design_height_mm": 1}])
    write("data_bad_design.json", stamps=3)
    (path / "data_cut_perf.json").write_text('{"format": "x')
    got = d.read_documents(spark, [str(path)])
    assert [(r.source, r.stamp, r.design_width_mm, r.design_height_mm, r.registration_status, r.registration_reasons, r.file.rsplit("/", 1)[1]) for r in got.designs.collect()] == [("two", "1", 20.5, 30.0, "review", "a; b", "data_two_perf.json")]
    assert {(r.file.rsplit("/", 1)[1], r.reason) for r in got.errors.collect()} == {("data_bad_design.json", "stamps is not a list"), ("data_cut_perf.json", "not valid JSON")}


def documents_in(path):
    """Documents a reader would see: a task that is killed late may leave a part in the staging folder, which no reader opens."""
    return [f for at, _, files in os.walk(path) if "_staged-" not in at for f in files]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(d.MeasurementDocuments)
    docs = spark.range(6).select(F.concat(F.lit("data_"), "id", F.lit("_perf.json")).alias("name"), F.when(F.col("id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.lit("{}")).alias("document"))
    with pytest.raises(Exception, match="broken"):
        docs.write.format("measurement_documents").mode("append").save(str(tmp_path / "out"))
    assert not documents_in(tmp_path)
    twice = spark.range(2).select(F.lit("data_a_perf.json").alias("name"), F.lit("{}").alias("document"))
    with pytest.raises(Exception, match="one name"):
        twice.write.format("measurement_documents").mode("append").save(str(tmp_path / "out"))
    assert not documents_in(tmp_path)
