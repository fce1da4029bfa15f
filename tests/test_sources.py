"""Readers of names, manifests and labels; tile starts."""

import json

from pyspark.sql import functions as F

from hazeline.functions import geometry
from hazeline.sources import files


def test_offsets(spark):
    d = spark.createDataFrame([("a/1465063200_-02400.jpg",), ("a/1465067760_+02160.JPG",), ("b/y.png",), ("b/x.png",), ("b/notes.txt",)], "path string")
    assert {(r.path, r.offset_s) for r in files.timed(d).collect()} == {("a/1465063200_-02400.jpg", -2400.0), ("a/1465067760_+02160.JPG", 2160.0), ("b/x.png", 0.0), ("b/y.png", 1.0)}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"sequence": "a", "frames": [{"file": "x", "offset_s": -60}, {"file": "y", "offset_s": 60}]}, {"sequence": "b", "frames": [{"file": "z", "offset_s": 0}]}, {"sequence": "c", "frames": []}]))
    m = files.manifest(spark, str(tmp_path / "m.json"))
    assert m.count() == 3
    assert {r.file for r in files.pre_ignition(m).collect()} == {"x", "y"}


def test_label_lines(spark):
    d = spark.createDataFrame([("0 0.5 0.5 0.2 0.4",), ("0 1 2",), ("",)], "value string")
    assert [tuple(r) for r in files.boxes(d, 100, 200).collect()] == [(40.0, 60.0, 60.0, 140.0)]


def test_tiles_cover_the_side(spark):
    d = spark.createDataFrame([(500,), (1024,), (1920,), (4000,)], "side int")
    for r in d.select("side", geometry.tile_starts(F.col("side"), 1024, 0.2).alias("at")).collect():
        assert r["at"][0] == 0 and (r.side <= 1024 or r["at"][-1] == r.side - 1024)
        assert all(0 < b - a <= 1024 for a, b in zip(r["at"], r["at"][1:], strict=False))
