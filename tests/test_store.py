"""The event store, configuration, weather, detectors, dense features and reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.functions import rules
from hazeline.operators import detect, evaluate, learn, solve, store
from hazeline.sources import config, files, weather


def event(spark, n):
    rows = [(k, "FLARE" if k % 3 == 0 else "GLOW", 0.5, float(100 - k), "a" if k % 2 else "b") for k in range(n)]
    return store.migrated(spark.createDataFrame(rows, "track_id long, tier string, score double, timestamp double, site string"))


def test_store(spark, tmp_path):
    s = store.EventStore(spark, f"file://{tmp_path}/events")
    assert s.events().count() == 0 and s.events().schema == store.EVENT
    added = s.add(event(spark, 30))
    assert sorted(r.id for r in added.collect()) == list(range(1, 31))
    assert [r.track_id for r in added.orderBy("id").collect()] == list(range(29, -1, -1))
    assert sorted(r.id for r in s.add(event(spark, 5)).collect()) == list(range(31, 36))
    assert s.get(31).first().track_id == 4 and s.get(99).count() == 0
    assert s.latest_for_track("b", 4).first().id == 31
    assert [r.id for r in store.listed(s.events(), tier="FLARE", limit=2).collect()] == [35, 32]
    label = spark.createDataFrame([(31, "confirmed", 1.0), (99, "confirmed", 1.0)], "id long, value string, at double")
    assert [r.id for r in s.set_labels(label).collect()] == [31]
    s.set_labels(spark.createDataFrame([(31, "false_positive", 2.0), (3, "confirmed", 2.0)], "id long, value string, at double"))
    assert [(r.id, r.label) for r in s.labelled().collect()] == [(3, "confirmed"), (31, "false_positive")]
    with pytest.raises(ValueError, match="label"):
        s.set_labels(label.withColumn("value", F.lit("maybe")))
    response = lambda *rows: spark.createDataFrame(list(rows), "id long, value string, at double")
    assert [(r.id, r.value) for r in s.set_responses(response((31, "received", 1.0), (31, "none", 2.0), (31, "dispatched", 3.0), (98, "received", 1.0))).orderBy("at").collect()] == [(31, "received"), (31, "dispatched")]
    assert s.set_responses(response((31, "received", 9.0))).count() == 0
    s.set_responses(response((31, "suppressed", 10.0)))
    r = s.get(31).first()
    assert r.response == "suppressed" and [(h.status, h.at) for h in r.response_history] == [("received", 1.0), ("dispatched", 3.0), ("suppressed", 10.0)]
    with pytest.raises(ValueError, match="response"):
        s.set_responses(response((31, "gone", 9.0)))
    with pytest.raises(ValueError, match="response"):
        s.set_responses(response((31, None, 9.0)))
    counts = store.summary(s.events(), "a").first()
    assert counts.total == 17 and counts.labelled == 2
    s.clear()
    assert s.events().count() == 0 and s.add(event(spark, 1)).first().id == 1


def test_two_writers_of_responses(spark, tmp_path):
    """Both saw no response yet: the one that comes second in the log and is lower doesn't take the event back."""
    s = store.EventStore(spark, f"file://{tmp_path}/events")
    s.add(event(spark, 3))
    entry = lambda value, at: spark.createDataFrame([(2, value, at)], "id long, value string, at double")
    s._append("responses", entry("dispatched", 5.0))
    s._append("responses", entry("received", 6.0))
    s._append("responses", entry("suppressed", 7.0))
    r = s.get(2).first()
    assert r.response == "suppressed" and [h.status for h in r.response_history] == ["dispatched", "suppressed"]
    assert [x.response for x in s.events().where("id <> 2").collect()] == ["none", "none"]


def test_feed_of_changes(spark, tmp_path):
    s = store.EventStore(spark, f"file://{tmp_path}/events")
    s.add(event(spark, 10))
    entry = lambda i, value: spark.createDataFrame([(i, value, 1.0)], "id long, value string, at double")
    asked = lambda name="map": {r.site: (r.what, r.largest, r.events) for r in s.feed(name)[0].collect()}
    changes, snapshot = s.feed("map", limit=3)
    assert {r.site: r.events for r in changes.collect()} == {"a": 5, "b": 5}
    ids = sorted(r.id for r in s.events().where("site = 'a'").collect())
    assert sorted(r.id for r in snapshot.collect() if r.site == "a") == ids[-3:]
    assert asked() == {} and s.feed("map")[1].count() == 0
    s.set_labels(entry(ids[0], "confirmed"))
    assert asked() == {"a": (["labels"], ids[-1], 5)}
    s.set_responses(entry(ids[0], "received"))
    s.set_labels(entry(ids[1], "confirmed"))
    assert asked() == {"a": (["labels", "responses"], ids[-1], 5)}
    s.add(event(spark, 2))
    assert asked() == {"a": (["events"], 12 if s.get(12).first().site == "a" else 11, 6), "b": (["events"], 12 if s.get(12).first().site == "b" else 11, 6)}
    assert asked() == {} and set(asked("other")) == {"a", "b"}


class Killed(Exception):
    pass


def test_a_batch_is_written_once(spark, tmp_path, monkeypatch):
    """Killed before the ledger, between ids and data, and between data and ledger: added again, each event is there once, under
    the ids of the first attempt, whatever was added meanwhile."""
    s = store.EventStore(spark, f"file://{tmp_path}/events")
    s.add(event(spark, 4), "q/0")
    enter = s._enter

    def dies(kind, when):
        def f(batch, k, *rest):
            if k == kind and when == "before":
                raise Killed
            enter(batch, k, *rest)
            if k == kind:
                raise Killed
        return f

    for n, (kind, when) in enumerate([("reserved", "before"), ("reserved", "after"), ("stored", "before"), ("stored", "after")], 1):
        before = s.events().count()
        monkeypatch.setattr(s, "_enter", dies(kind, when))
        with pytest.raises(Killed):
            s.add(event(spark, 3), f"q/{n}")
        monkeypatch.setattr(s, "_enter", enter)
        assert s.events().count() == before + 3 * ((kind, when) == ("stored", "after"))
        s.add(event(spark, 2), f"other/{n}")
        for _ in range(2):
            ids = sorted(r.id for r in s.add(event(spark, 3), f"q/{n}").collect())
        first = {1: 7, 2: 10, 3: 15, 4: 20}[n]
        assert ids == [first, first + 1, first + 2]
    got = [r.id for r in s.events().collect()]
    assert len(got) == len(set(got)) == 4 + 4 * 5
    monkeypatch.setattr(s, "_enter", dies("stored", "before"))
    with pytest.raises(Killed):
        s.add(event(spark, 3), "q/9")
    with pytest.raises(ValueError, match="q/9"):
        s.add(event(spark, 4), "q/9")


def test_a_stream_into_the_store(spark, tmp_path, monkeypatch):
    """A query that dies between data and ledger and starts again stores each event once."""
    s = store.EventStore(spark, f"file://{tmp_path}/store")
    for k in range(3):
        event(spark, 5).withColumn("site", F.lit(f"s{k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    enter, left = s._enter, [3]

    def dies(batch, kind, *rest):
        left[0] -= 1
        if left[0] == 0:
            raise Killed
        enter(batch, kind, *rest)

    def run():
        stream = spark.readStream.schema(store.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = s.sink(stream, "judge", str(tmp_path / "state")).trigger(availableNow=True).start()
        return q.awaitTermination(120)

    monkeypatch.setattr(s, "_enter", dies)
    with pytest.raises(Exception, match="Killed"):
        run()
    monkeypatch.setattr(s, "_enter", enter)
    assert run()
    got = s.events().collect()
    assert sorted(r.id for r in got) == list(range(1, 16)) and len({(r.site, r.track_id) for r in got}) == 15


def test_older_tables(spark):
    old = spark.createDataFrame([(7, "GLOW")], "id long, tier string")
    r = store.migrated(old).first()
    assert (r.id, r.tier, r.response, r.label, r.flow_ok, r.lat) == (7, "GLOW", "none", "unlabelled", False, None)
    back = store.decoded(store.encoded(store.migrated(old)).drop("features").withColumn("features", F.lit(None).cast("string"))).first()
    assert back.features == {} and back.bbox == [] and back.response_history == [] and back.site == ""


def test_configuration(spark, tmp_path):
    (tmp_path / "configs" / "sites").mkdir(parents=True)
    sites = tmp_path / "configs" / "sites"
    (sites / "hill.json").write_text(json.dumps({"name": "hill", "lat": 36.4, "lon": 128.7, "bbox": [128.35, 36.06, 129.05, 36.76], "response_units": [{"name": "n", "lat": 1, "lon": 2}]}))
    (sites / "shore.json").write_text(json.dumps({"name": "the shore", "label": "Shore", "lat": 1, "lon": 2, "bbox": [0, 0, 1, 1], "patrol_altitude_agl_m": 80, "dem": {"cache_dir": "/c", "local_dir": "own", "geoid_offset_m": 25.5}}))
    (sites / "notes.txt").write_text("no configuration")
    s = config.site(spark, "hill", str(sites))
    assert (s.terrain_dir, s.patrol_m, s.label, s.local_dir, s.geoid_offset_m) == (f"{tmp_path}/data/dem/hill", 300.0, "hill", None, 0.0) and [tuple(u) for u in s.units] == [("n", 1.0, 2.0)]
    for name in ("shore", "the shore"):
        c = config.site(spark, name, str(sites))
        assert (c.terrain_dir, c.local_dir, c.patrol_m, c.label, c.geoid_offset_m, list(c.units)) == ("/c", f"{tmp_path}/own", 80.0, "Shore", 25.5, [])
    assert sorted(r.stem for r in config.sites(spark, str(sites)).collect()) == ["hill", "shore"]
    with pytest.raises(FileNotFoundError, match="hill, shore"):
        config.site(spark, "valley", str(sites))
    tiles = config.terrain_tiles(config.sites(spark, str(sites)).where("name = 'hill'"))
    assert sorted((r.south, r.west) for r in tiles.collect()) == [(36, 128), (36, 129)]
    there = tiles.where("west = 128").select("path")
    assert [r.west for r in config.missing_tiles(tiles, there).collect()] == [129]
    with pytest.raises(FileNotFoundError, match="E129"):
        config.terrain_files("hill", None, there, tiles)
    assert config.terrain_files("hill", None, tiles.select("path"), tiles).count() == 2
    local = spark.createDataFrame([("/l/b.TIF",), ("/l/a.tif",), ("/l/a.txt",), ("/m/c.tif",)], "path string")
    assert [r.path for r in config.terrain_files("hill", "/l", local, tiles).collect()] == ["/l/a.tif", "/l/b.TIF"]
    with pytest.raises(FileNotFoundError, match="/x"):
        config.terrain_files("hill", "/x", local, tiles)
    lenses = tmp_path / "cameras"
    lenses.mkdir()
    for name, body in (("view", {"hfov_deg": 73.7}), ("sensor", {"focal_mm": 4.5, "sensor_width_mm": 6.4, "sensor_height_mm": 3.6, "dist": [0, -0.3, 0, 0, 0]}), ("none", {})):
        (lenses / f"{name}.json").write_text(json.dumps({"name": name, "width": 1920, "height": 1080, **body}))
    view, lens = config.camera(spark, "view", str(lenses))
    wide = solve.Camera.from_fov(1920, 1080, 73.7).fx
    assert (view.fx, view.fy, view.cx, view.cy) == pytest.approx((wide, wide, 960.0, 540.0)) and lens == (0.0,) * 5
    sensor, lens = config.camera(spark, "sensor", str(lenses))
    own = solve.Camera.from_sensor(1920, 1080, 4.5, 6.4, 3.6)
    assert (sensor.fx, sensor.fy) == pytest.approx((own.fx, own.fy)) and lens == (0.0, -0.3, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError, match="hfov_deg or focal_mm"):
        config.camera(spark, "none", str(lenses))
    assert {r.stem: r.distorted for r in config.cameras(spark, str(lenses)).collect()} == {"view": False, "sensor": True, "none": False}


def test_wind(spark):
    item = lambda **kw: json.dumps({"response": {"body": {"items": {"item": [{"category": c, "obsrValue": v} for c, v in kw.items()]}}}})
    d = spark.createDataFrame([(1, item(VEC="90", WSD="2.5")), (2, item(VEC="90")), (3, None), (4, "<html>"), (5, item(VEC="x", WSD="1")), (6, "{}")], "k int, body string")
    assert {r.k: (r.wind_speed, r.wind_from, r.source) for r in weather.winds(d, ["k"]).collect()} == {1: (2.5, 90.0, "kma"), **{k: (None, None, "unavailable") for k in (2, 3, 4, 5, 6)}}
    assert {r.source for r in weather.winds(d, ["k"], (1.0, 2.0)).collect()} == {"kma", "fallback"}


def test_detector_callback(spark):
    d = spark.createDataFrame([(1, 0, bytearray(b"ab")), (1, 1, bytearray(b"")), (2, 0, bytearray(b"c"))], "seq_id long, frame_index int, content binary")
    load = lambda: lambda content: [(float(c), 0.0, float(c) + 10, 10.0, 0.1 if c == ord("c") else 0.9) for c in content]
    assert sorted((r.seq_id, r.frame_index, r.x1) for r in detect.detected(d, load).collect()) == [(1, 0, 97.0), (1, 0, 98.0)]
    tiles = spark.createDataFrame([(1, 0, 100.0, 0.0, 5.0, 5.0, 15.0, 15.0, 0.5), (1, 0, 0.0, 0.0, 104.0, 5.0, 114.0, 15.0, 0.9), (1, 0, 0.0, 50.0, 0.0, 0.0, 10.0, 10.0, 0.4)], "seq_id long, frame_index int, tile_x double, tile_y double, x1 double, y1 double, x2 double, y2 double, confidence double")
    whole = spark.createDataFrame([(1, 0, 300.0, 300.0, 310.0, 310.0, 0.3)], "seq_id long, frame_index int, x1 double, y1 double, x2 double, y2 double, confidence double")
    assert sorted((r.x1, r.y1) for r in detect.merged(tiles, whole).collect()) == [(0.0, 50.0), (104.0, 5.0), (300.0, 300.0)]


def test_softness_and_flicker(spark):
    rng = np.random.default_rng(0)
    side = 6
    patches = [rng.uniform(0, 1, (side, side)) for _ in range(7)] + [np.full((side, side), 0.5)]
    rows = [(1, "x", float(k), k, p.ravel().tolist()) for k, p in enumerate(patches)] + [(1, "x", 99.0, 99, None), (2, "x", 0.0, 100, patches[0].ravel().tolist())]
    d = spark.createDataFrame(rows, "seq_id long, lane string, offset_s double, det_id long, patch array<double>")
    got = {r.seq_id: r for r in rules.appearance(d, ("seq_id", "lane"), side).collect()}

    def soft(p):
        if p.max() - p.min() < 1e-6:
            return 1.0
        gy, gx = np.gradient(p)
        return float(np.clip(1 - np.percentile(np.hypot(gx, gy), 99) / (p.max() - p.min()), 0, 1))

    means = np.array([p.mean() for p in patches])
    assert got[1].intensity_flicker == pytest.approx(means.std() / means.mean()) and got[1].edge_softness == pytest.approx(np.mean([soft(p) for p in patches[-5:]]))
    assert (got[2].intensity_flicker, got[2].edge_softness) == (0.0, pytest.approx(soft(patches[0])))


def test_modes(spark):
    d = spark.createDataFrame([(0.04, 0.6, 0.03, 12), (1.0, 0.6, 0.01, 12)], "interval double, flow_upward_ratio double, flow_divergence double, n int").withColumns({"centroid_rise_rate": F.lit(0.0), "area_growth_rate": F.lit(0.0), "area_monotonicity": F.lit(0.0)})
    rows = d.select(rules.mode_of(F.col("interval")).alias("mode"), rules.evidence("dense").alias("e")).collect()
    assert [(r.mode, r.e.flow_ok, r.e.enough_frames, r.e.flow_from_proxy) for r in rows] == [("dense", True, True, False), ("sparse", False, True, False)]
    assert "대용값" not in "".join(rows[0].e.reasons) and len(rules.feature_names("dense")) == 13 and rules.feature_names("sparse") == rules.DENSE[:10]
    v = spark.range(1).select(*(F.lit(float(k)).alias(f) for k, f in enumerate(rules.DENSE))).select(rules.feature_vector("dense").alias("v")).first().v
    assert v == [float(k) for k in range(13)]


def test_rollup_of_nothing_and_latencies(spark):
    frames = spark.createDataFrame([], "seq_id long, frame_index int, offset_s double, hits long")
    judged = spark.createDataFrame([], "seq_id long, track long, frame_index int, offset_s double, tier string")
    r = evaluate.rollup(evaluate.outcomes(frames, judged), latencies=spark.createDataFrame([(float(k),) for k in range(101)], "ms double")).first()
    assert (r.n_sequences, r.raw_per_hour, r.fpr_reduction, r.detection_rate, r.median_time_to_flare) == (0, 0.0, 0.0, 0.0, None)
    assert (r.latency_median, r.latency_p95, r.latency_max) == (50.0, 95.0, 100.0)


def test_claims(spark):
    frames = spark.createDataFrame([(1, k, 60.0 * (k - 2), 1) for k in range(5)], "seq_id long, frame_index int, offset_s double, hits long")
    judged = spark.createDataFrame([(1, 0, k, 60.0 * (k - 2), "FLARE" if k == 4 else "GLOW") for k in range(5)], "seq_id long, track long, frame_index int, offset_s double, tier string")
    sweep = spark.createDataFrame([(5.0, 8, 200.0), (15.0, 8, 45.0), (20.0, 8, 30.0), (90.0, 0, None)], "depression double, n_solved long, cep50_m double")
    devices = evaluate.device_bench(spark.createDataFrame([("cpu", 0, k, 100.0) for k in range(1, 9)] + [("gpu", 1, k, 900.0 if k < 4 else 20.0) for k in range(1, 9)], "device string, rank int, nth int, ms double"))
    assert [(r.device, r.fps, r.speedup, r.place) for r in devices.orderBy("place").collect()] == [("gpu", 50.0, 5.0, 1), ("cpu", 10.0, 1.0, 2)]
    table = evaluate.claims(evaluate.rollup(evaluate.outcomes(frames, judged)), sweep=sweep, devices=devices)
    got = {r.item: (r.measured, r.detail, r.verdict) for r in table.collect()}
    assert got == {"place within metres": (45.0, 15.0, "conditional"), "frame false alarm rate": (0.0, 1.0, "met"), "false alarms an hour": (0.0, 30.0, "met"), "seconds to find": (120.0, 1.0, "not measurable"), "frames a second": (50.0, 20.0, "met")}
    assert evaluate.markdown(table).count("\n") == 6


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("1465063200_-02400.jpg", "1465063260_-02340.jpg", "1465067760_+02160.jpg"):
        (tmp_path / "a" / name).write_bytes(name.encode())
    seq = files.sources(spark, str(tmp_path)).collect()
    assert {(r.offset_s, bytes(r.content)[:10]) for r in seq} == {(-2400.0, b"1465063200"), (-2340.0, b"1465063260"), (2160.0, b"1465067760")}
    assert sorted(r.offset_s for r in files.image_sequences(spark, str(tmp_path), cap=2).collect()) == [-2400.0, -2340.0]
    (tmp_path / "m.json").write_text(json.dumps([{"sequence": "a", "frames": [{"file": "gone.jpg", "offset_s": -9}, {"file": "1465067760_+02160.jpg", "offset_s": 2160}, {"file": "1465063200_-02400.jpg", "offset_s": -2400}]}]))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jpg").load(str(tmp_path)).select("path")
    m = files.manifest(spark, f"{tmp_path}/m.json", there)
    assert [(r.frame_index, r.offset_s) for r in m.orderBy("frame_index").collect()] == [(0, -2400), (1, 2160)]
    assert files.sources(spark, f"{tmp_path}/m.json").count() == 3
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "x.txt").write_text("0 0.5 0.5 0.2 0.4\n0 1\n")
    images = spark.createDataFrame([("x", "x.txt", 100, 200), ("y", "y.txt", 100, 200)], "image string, label string, width int, height int")
    assert {(r.image, r.x1, r.y2) for r in files.labelled_images(spark, images, f"{tmp_path}/labels").collect()} == {("x", 40.0, 140.0), ("y", None, None)}
    (tmp_path / "i.json").write_text(json.dumps([{"name": "n", "image": "i", "label": "l", "partner": "p", "camera": "c", "date": "d"}]))
    assert files.image_manifest(spark, f"{tmp_path}/i.json").first().camera == "c"
    names = spark.createDataFrame([("a.jpg",), ("../a",), ("a/b",), ("a\\b",), ("",), (None,)], "n string")
    assert [r.ok for r in names.select(files.safe_name(F.col("n")).alias("ok")).collect()] == [True, False, False, False, False, False]


def test_retraining_from_stored_labels(spark, tmp_path):
    s = store.EventStore(spark, f"file://{tmp_path}/events")
    rng = np.random.default_rng(3)
    rows = [(k, {"persistence": float(rng.uniform()), "confidence_mean": float(rng.uniform())}, float(k)) for k in range(40)]
    s.add(store.migrated(spark.createDataFrame(rows, "track_id long, features map<string,double>, timestamp double")))
    said = lambda ids: spark.createDataFrame([(i, "confirmed" if i % 3 else "false_positive", 1.0) for i in ids], "id long, value string, at double")
    s.set_labels(said(range(1, 10)))
    with pytest.raises(ValueError, match="8 labels"):
        learn.retrained(s.events(), str(tmp_path / "scorer"))
    assert not (tmp_path / "scorer").exists()
    s.set_labels(said(range(10, 36)))
    got = {r.feature: r.weight for r in learn.retrained(s.events(), str(tmp_path / "scorer")).collect()}
    assert learn.load(spark, str(tmp_path / "scorer")) == got
    own = spark.createDataFrame([(f["persistence"], f["confidence_mean"], "confirmed" if (k + 1) % 3 else "false_positive") for k, f, _ in rows[:35]], "persistence double, confidence_mean double, label string")
    want = {r.feature: r.weight for r in learn.fitted(own).collect()}
    assert {f: got[f] for f in want} == pytest.approx(want, abs=1e-6)
    assert all(abs(w) < 1e-9 for f, w in got.items() if f not in want)
