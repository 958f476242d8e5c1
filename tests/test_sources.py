import json

import numpy as np
from millwright.operators import consensus, kmeans, resample
from millwright.sources import measurements as ms


def document(**changes):
    summary = {"stamp": 7, "width_px": 100, "height_px": 200, "width_mm": 25.4, "height_mm": 50.8, "horizontal_perforation_per_20mm": 12.25, "vertical_perforation_per_20mm": 12.5}
    stamps = [{"stamp": 7, "summary": summary, "measurement": {"status": "ok"}}, {"stamp": 8}, {"stamp": 9, "summary": {**summary, "vertical_perforation_per_20mm": "(12/13)"}}]
    return json.dumps({"format": ms.FORMAT, "version": 1, "source": "a", "dpi": 100, "stamps": stamps, **changes}, indent=1)


def test_documents(spark, tmp_path):
    texts = {"good": document(), "format": document(format="other"), "list": document(stamps=3), "cut": document()[:-30], "none": document(stamps=[])}
    for name, text in texts.items():
        (tmp_path / f"data_{name}_perf.json").write_text(text)
    (tmp_path / "other.json").write_text("{")
    found = [r.path.rsplit("/", 1)[1] for r in ms.find_inputs(spark, [str(tmp_path)]).collect()]
    assert found == [f"data_{n}_perf.json" for n in sorted(texts)]
    got = ms.read_measurements(spark, [str(tmp_path)])
    assert [(r.stamp, r.horizontal, r.vertical, r.status, r.dpi) for r in got.rows.collect()] == [(7, 12.25, 12.5, "ok", 100.0)]
    assert {(r.stamp, r.reason) for r in got.incomplete.collect()} == {(8, "missing summary"), (9, "incomplete gauge pair")}
    errors = {r.file.rsplit("/", 1)[1].split("_")[1]: r.reason for r in got.errors.collect()}
    assert errors == {"format": "unexpected format", "list": "stamps is not a list", "cut": "not valid JSON"}
    ms.write_summary(got.rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert len(back) == 1 and back[0].horizontal == "12.25"
    ms.write_json(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a int, x double"), str(tmp_path / "json"))
    assert {(r.a, r.x) for r in spark.read.schema("a int, x double").json(str(tmp_path / "json")).collect()} == {(1, None), (2, 0.5)}


def test_gap(spark):
    rng = np.random.default_rng(3)
    two = np.vstack([rng.normal(-2, 0.15, (35, 2)), rng.normal(2, 0.15, (35, 2))])
    chosen = lambda p, **k: [r.k for r in kmeans.gap_statistic(spark.createDataFrame([tuple(map(float, x)) for x in p], "a double, b double"), ["a", "b"], **k).collect() if r.chosen]
    assert chosen(two, max_k=4, references=40) == [2]
    assert chosen([(3, 4)] * 4, references=5) == [1]


def test_bootstrap_covers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(10, 2, 400)
    r = resample.bootstrap_mean(spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], "g string, u int, x double"), ["g"], "u", "x", 400).first()
    half = 1.96 * x.std(ddof=1) / 20
    assert abs(r["mean"] - x.mean()) < 1e-9 and abs(r.low - (x.mean() - half)) < 0.08 and abs(r.high - (x.mean() + half)) < 0.08


def test_reading_order(spark):
    boxes = spark.createDataFrame([(0, "a", 50.0, 10.0), (0, "b", 10.0, 14.0), (0, "c", 30.0, 100.0), (0, "d", 5.0, 108.0)], "g int, k string, x double, y double")
    got = {r.k: (r.line, r.place) for r in consensus.reading_order(boxes, ["g"], "x", "y", 20).collect()}
    assert got == {"b": (0, 0), "a": (0, 1), "d": (1, 2), "c": (1, 3)}
