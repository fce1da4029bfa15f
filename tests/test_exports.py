"""Metric files and the report made of them, snapshots, frames of events, site listings, and the dashboard's folder."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from hazeline.operators import exports
from hazeline.sources import config

ALARMS = "frames_before long, fpr_single double, fpr_sequence double, latency_median double, latency_p95 double, dedup_per_hour double, verified_per_hour double, median_time_to_flare double, detection_rate double, more string"


def test_metrics_are_saved_loaded_and_reported(spark, tmp_path):
    folder, to = str(tmp_path / "m"), str(tmp_path / "report")
    with pytest.raises(FileNotFoundError):
        exports.claims_of(spark, folder)
    exports.save_metrics(spark.createDataFrame([(100, 0.2, 0.02, None, None, 3.0, 0.75, 120.0, 0.9, "x")], ALARMS), folder, "alarms")
    exports.save_metrics(spark.createDataFrame([(0.5, 0.25)], "ap50 double, alarm_rate double"), folder, "detector")
    exports.save_metrics(spark.createDataFrame([(10.0, 4, 80.0), (30.0, 4, 40.0), (50.0, 4, 20.0)], "depression double, n_solved long, cep50_m double"), folder, "sweep")
    got = {r["item"]: (r["measured"], r["verdict"]) for r in exports.write_report(spark, folder, to).collect()}
    assert got == {"place within metres": (40.0, "conditional"), "frame false alarm rate": (0.02, "met"), "false alarms an hour": (0.75, "not met"), "seconds to find": (120.0, "not measurable"), "detector ap50": (0.5, "for reference")}
    text = "".join(r.value + "\n" for r in spark.read.text(to).collect())
    assert text.startswith("# Measured\n") and all(f"- **{item}** ({verdict}): " in text for item, (_, verdict) in got.items()) and text.count("| place within metres |") == 1


def test_saving_again_replaces(spark, tmp_path):
    for v in (0.1, 0.2):
        exports.save_metrics(spark.createDataFrame([(v, 0.0)], "ap50 double, alarm_rate double"), str(tmp_path), "detector")
    assert [tuple(r) for r in exports.load_metrics(spark, str(tmp_path), "detector").collect()] == [(0.2, 0.0)]


@pytest.mark.parametrize("text", [None, "", "\n \n", '{"ap50": 0.5', '{"ap50": 0.5}\nnot json\n'])
def test_files_that_tell_nothing(spark, tmp_path, text):
    if text is not None:
        (tmp_path / "detector").mkdir()
        (tmp_path / "detector" / "part.json").write_text(text)
    assert exports.load_metrics(spark, str(tmp_path), "detector") is None


def test_held_out_figures_stand_in(spark, tmp_path):
    exports.save_metrics(spark.createDataFrame([(100, 0.2, 0.05, None, None, 3.0, 0.25, None, None, "x")], ALARMS), str(tmp_path), "alarms_holdout")
    assert {r["item"]: r["verdict"] for r in exports.claims_of(spark, str(tmp_path)).collect()} == {"frame false alarm rate": "not met", "false alarms an hour": "met"}


def test_frames_of_events(spark):
    e = spark.createDataFrame([(1, "a-t1-f3.jpg"), (2, "a-t1-f9.jpg"), (3, "a-b-t2-f3"), (4, "poster.jpg"), (5, None), (6, "a-t1-f3.jpg"), (7, "")], "id long, snapshot string").withColumn("path", F.lit("own"))
    f = spark.createDataFrame([("a", 3, "x/3"), ("a-b", 3, "y/3"), ("a", None, "z")], "site string, frame_index long, path string")
    assert {(r.id, r.path, r.frame_path) for r in exports.event_frames(e, f).collect()} == {(1, "own", "x/3"), (6, "own", "x/3"), (3, "own", "y/3")}
    assert exports.event_frames(e.limit(0), f).count() == 0


def test_snapshots_inside_events(spark):
    e = spark.createDataFrame([(1, "a.jpg"), (2, "gone.jpg"), (3, None), (4, "../a.jpg"), (5, "a.jpg"), (6, "")], "id long, snapshot string").withColumn("content", F.lit("own"))
    body = bytes(range(256)) * 3
    i = spark.createDataFrame([("s/a.jpg", bytearray(body)), ("t/a.jpg", bytearray(b"later")), ("s/b.jpg", bytearray(b"b"))], "path string, content binary")
    got = {r.id: (r.snapshot_name, r.snapshot, r["content"]) for r in exports.embedded(e, i).collect()}
    uri = "data:image/jpeg;base64," + base64.b64encode(body).decode()
    assert got == {1: ("a.jpg", uri, "own"), 2: ("gone.jpg", None, "own"), 3: (None, None, "own"), 4: ("../a.jpg", None, "own"), 5: ("a.jpg", uri, "own"), 6: ("", None, "own")}


def test_subset(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "seq_id long, v string")
    names = spark.createDataFrame([(1,), (1,), (9,), (None,)], "seq_id long")
    assert sorted(r.v for r in exports.subset(d, names).collect()) == ["a", "b"]


def test_sites_and_their_terrain(spark, tmp_path):
    """From configuration files to the listing."""
    folder = tmp_path / "root" / "configs" / "sites"
    folder.mkdir(parents=True)
    for name, box in (("a", [128.2, 36.2, 128.8, 36.8]), ("b", [128.2, 36.2, 129.8, 36.8]), ("c", None)):
        (folder / f"{name}.json").write_text(json.dumps({"name": name, "lat": 36.5, "lon": 128.5, "bbox": box, "dem": {"cache_dir": "/dem"}}))
    sites = config.sites(spark, str(folder))
    there = config.terrain_tiles(sites).where("west = 128").select("path")
    assert [tuple(r) for r in exports.site_listing(sites, there).select("name", "label", "n_tiles", "n_missing", "ready").orderBy("name").collect()] == [("a", "a", 1, 0, True), ("b", "b", 2, 1, False), ("c", "c", 0, 0, False)]


def test_dashboard_folder(spark, tmp_path):
    e = spark.createDataFrame([(k, ("FLARE", "GLOW", "SPARK")[k % 3], "none", "unlabelled", 36.0 + k, 128.0 + k, k > 1, f"s-t1-f{k}.jpg") for k in range(5)], "id long, tier string, response string, label string, lat double, lon double, geo_ok boolean, snapshot string")
    site = spark.createDataFrame([("home", [("u", 36.0, 120.0)])], "name string, units array<struct<name string, lat double, lon double>>")
    images = spark.createDataFrame([("x/s-t1-f4.jpg", bytearray(b"pic"))], "path string, content binary")
    for _ in range(2):
        exports.dashboard(e, site, str(tmp_path), images, newest=4)
    read = lambda name: [json.loads(r.value) for r in spark.read.text(str(tmp_path / name)).collect()]
    events = {x["id"]: x for x in read("events")}
    assert sorted(events) == [1, 2, 3, 4] and events[4]["snapshot"] == "data:image/jpeg;base64,cGlj" and "snapshot" not in events[3] and events[3]["snapshot_name"] == "s-t1-f3.jpg"
    assert read("bounds") == [{"west": 119.988, "south": 35.988, "east": 132.012, "north": 40.012}]
    (s,) = read("summary")
    assert (s["total"], s["flare"], s["queue"], s["scorer"]["tau_high"]) == (5, 2, 2, 0.7) and read("site")[0]["name"] == "home"
