"""Runs by tables of sites and cameras, read from files, and by the cadence of each sequence."""

import json

import pytest
from pyspark.sql import functions as F

from hazeline.functions import geodesy as geo
from hazeline.operators import crossing
from hazeline.plans import flights, run
from hazeline.session import materialize
from hazeline.sources import config
from hazeline.sources.detections import detections
from hazeline.streaming import alerts

SF = "/root/testdata/sf0.001"
LENS = [-0.12, 0.03, 0.001, -0.002, 0.0]


@pytest.fixture(scope="module")
def ground(spark):
    heights, grid = crossing.synthetic_heights(spark, half=0.1)
    return materialize(crossing.cells_of(heights), "cells"), grid


def test_heights_under_points(spark, ground):
    cells, grid = ground
    p = spark.createDataFrame([(36.4127, 128.7043), (36.45, 128.65), (36.40, 128.79), (10.0, 10.0), (None, 128.7)], "lat double, lon double").withColumn("i", F.lit("own"))
    got = {r.lat: r.ground for r in crossing.heights_at(p, cells, grid).collect()}
    i = lambda v: (v - (grid.north - grid.cell / 2)) / -grid.cell
    for lat, lon in ((36.4127, 128.7043), (36.45, 128.65), (36.40, 128.79)):
        r, c = i(lat), (lon - grid.west) / grid.cell - 0.5
        a, b = int(r), int(c)
        z = {(x, y): h for x, y, h in ((q.i, q.j, q.a) for q in cells.where((F.col("i").between(a, a + 1)) & (F.col("j").between(b, b + 1))).collect())}
        want = (1 - r + a) * ((1 - c + b) * z[a, b] + (c - b) * z[a, b + 1]) + (r - a) * ((1 - c + b) * z[a + 1, b] + (c - b) * z[a + 1, b + 1])
        assert got[lat] == pytest.approx(want, abs=1e-6) and 200 <= got[lat] <= 800
    assert got[10.0] is None and got[None] is None


def test_units_of_a_row_and_of_a_list(spark):
    units = [("north", 36.4420, 128.6900), ("south", 36.3850, 128.7480)]
    p = spark.createDataFrame([(36.4, 128.7), (36.5, 128.5)], "lat double, lon double")
    p = p.withColumn("units", F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("lat"), F.lit(b).alias("lon")) for n, a, b in units)))
    for r in p.select(alerts.nearest_km(units).alias("a"), alerts.nearest_of(F.col("units")).alias("b"), alerts.nearest_of(F.array().cast("array<struct<name:string,lat:double,lon:double>>")).alias("none")).collect():
        assert r.a == pytest.approx(r.b) and r["none"] is None


def test_a_run_by_files(spark, ground, tmp_path):
    """A lens that bends, a site off the terrain, a camera without a focal length, sequences of none."""
    folder = tmp_path / "root" / "configs"
    for kind in ("sites", "cameras"):
        (folder / kind).mkdir(parents=True)
    for name, lat in (("here", 36.4127), ("far", 20.0)):
        (folder / "sites" / f"{name}.json").write_text(json.dumps({"name": name, "lat": lat, "lon": 128.7043, "patrol_altitude_agl_m": 400, "response_units": [{"name": "u", "lat": 36.42, "lon": 128.70}]}))
    for name, more in (("straight", {"hfov_deg": 73.7}), ("bent", {"hfov_deg": 73.7, "dist": LENS}), ("blind", {})):
        (folder / "cameras" / f"{name}.json").write_text(json.dumps({"name": name, "width": 1920, "height": 1080, **more}))
    sites, cameras = config.sites(spark, str(folder / "sites")), config.cameras(spark, str(folder / "cameras"))
    # one scene seen through both lenses: the bent one shows the point elsewhere
    x, y = 0.31, 0.22
    at = spark.range(1).select(*(c.alias(k) for k, c in zip("xy", geo.distort(F.lit(x), F.lit(y), *LENS), strict=True))).first()
    f = cameras.where("name = 'bent'").first().fx
    spots = {1: (x, y), 2: (at.x, at.y), 3: (x, y), 4: (x, y), 5: (x, y), 6: (x, y)}
    rows = [(s, s, 0, 0.0, 960 + f * u - 20, 540 + f * v - 20, 960 + f * u + 20, 540 + f * v + 20, 0.5, 40.0, -25.0 if s != 6 else None, 2.0) for s, (u, v) in spots.items()]
    d = spark.createDataFrame(rows, "det_id long, seq_id long, frame_index int, offset_s double, x1 double, y1 double, x2 double, y2 double, confidence double, yaw double, pitch double, roll double").withColumn("site", F.lit("own"))
    flown = spark.createDataFrame([(1, "here", "straight"), (2, "here", "bent"), (3, "far", "straight"), (4, "here", "blind"), (6, "here", "straight"), (7, "here", "bent")], "seq_id long, site string, camera string")
    v = materialize(run.configured(d.drop("site"), flown, sites, cameras, *ground), "verdicts")
    got = {r.seq_id: r for r in v.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    a, b = got[1], got[2]
    assert a.geo_ok and b.geo_ok and (a.lat, a.lon, a.range_m) == pytest.approx((b.lat, b.lon, b.range_m), rel=1e-9) and a.nearest_unit_km == pytest.approx(b.nearest_unit_km, rel=1e-6) and 0 < a.nearest_unit_km < 15
    assert all(not got[s].geo_ok and got[s].nearest_unit_km is None and got[s].lat is None for s in (3, 4, 5, 6))
    assert (got[5].site, got[5].camera, got[3].site, got[4].camera, got[6].reason) == (None, None, "far", "blind", "grazing")
    e = run.events(v.withColumns({"timestamp": F.lit(0.0)}), F.col("camera")).collect()
    assert {(r.site, r.camera, r.geo_ok) for r in e} == {("here", "straight", True), ("here", "bent", True), ("far", "straight", False), ("here", "blind", False), (None, None, False), ("here", "straight", False)}


def test_sparse_sequences_alone_are_as_without_cadence(spark):
    d = materialize(detections(spark, SF).where("seq_id < 5").drop("lat", "lon").withColumns({c: F.lit(0.5) for c in ("divergence", "upward_ratio", "translation_mag")}), "some")
    places = d.select(F.col("det_id").alias("row_id"), F.lit("grazing").alias("reason"), *(F.lit(None).cast("double").alias(c) for c in ("depression", "lat", "lon", "elevation_m", "range_m", "cep50_m", "cep90_m")))
    shown = ["seq_id", "track_id", "frame_index", "score", "tier"]
    a, b = run.verdicts_by_cadence(d, places), run.verdicts(d, places)
    assert sorted(map(tuple, a.select(*shown).collect())) == sorted(map(tuple, b.select(*shown).collect()))
    assert {tuple(r) for r in a.select("mode", "interval", "flow_upward_ratio").distinct().collect()} == {("sparse", 60.0, 0.0)}


def test_plans_of_flights_keep_the_poses(spark):
    flown, sites, cameras = flights.configuration(spark, SF)
    assert sites.count() == 5 and cameras.count() == 3 and flown.where("seq_id % 7 = 6").isEmpty()


def test_verdicts_deal_rows_by_track_once(spark):
    """Every window of a track works on one shuffle of its detections and one of the frames that it misses."""
    d = materialize(detections(spark, SF), "detections")
    places = d.select(F.col("det_id").alias("row_id"), F.lit(None).cast("string").alias("reason"), *(F.lit(0.0).alias(c) for c in ("depression", "lat", "lon", "elevation_m", "range_m", "cep50_m", "cep90_m")))
    plan = run.verdicts(d, places)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(seq_id") == 2
