"""Places of pixels: exact marches, the curvature of the earth, gates, error radii and the round trip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.operators import solve
from hazeline.plans import run
from hazeline.session import materialize

LAT, LON = 36.4127, 128.7043
CAMERA = solve.Camera.from_fov(1920, 1080, 73.7)
SF = "/root/testdata/sf0.001"


def origin(n, alt):
    return solve.Origin(np.full(n, LAT), np.full(n, LON), np.full(n, float(alt)))


def march(terrain, alt, d, step=20.0):
    """One ray, every sample, exact heights."""
    t = np.linspace(0, 15_000, int(15_000 / step) + 1)
    lat, lon, h = solve.exact(origin(len(t), alt), *(d[c] * t for c in range(3)))
    gap = h - terrain.at(lat, lon)
    low, gone = np.flatnonzero(gap <= 0), np.flatnonzero(~np.isfinite(gap))
    if len(low) and low[0] == 0 or len(gone) and (not len(low) or gone[0] < low[0]):
        return np.nan, True
    if not len(low):
        return np.nan, False
    lo, hi = t[low[0] - 1], t[low[0]]
    for _ in range(20):
        mid = (lo + hi) / 2
        lat, lon, h = solve.exact(origin(1, alt), *(np.array([d[c] * mid]) for c in range(3)))
        lo, hi = (mid, hi) if h[0] - terrain.at(lat, lon)[0] > 0 else (lo, mid)
    return (lo + hi) / 2, False


@pytest.mark.parametrize(("half", "alt", "void"), [(0.35, 1500, False), (0.05, 1500, False), (0.35, 1500, True), (0.35, 300, False)])
def test_crossings_are_those_of_an_exact_march(half, alt, void):
    terrain = solve.synthetic(half=half)
    if void:
        terrain.z[300:340, 300:600] = np.nan
    rng = np.random.default_rng(1)
    n = 120
    d = solve.rays(CAMERA, *(rng.uniform(0, s, n) for s in (1920, 1080)), rng.uniform(0, 360, n), -rng.uniform(0, 60, n), rng.uniform(-5, 5, n))
    t, left = solve.crossing(terrain, origin(n, alt), np.zeros((n, 3)), d)
    want = [march(terrain, alt, x) for x in d]
    assert t == pytest.approx([w[0] for w in want], abs=1e-3, nan_ok=True)
    assert left.tolist() == [w[1] for w in want]
    coarse, _ = solve.crossing(terrain, origin(n, alt), np.zeros((n, 3)), d, fine=False)
    assert np.nanmax(np.abs(coarse - t), initial=0) < 2


def test_the_earth_falls_away():
    sea = solve.Terrain(np.zeros((400, 400)), LON - 0.4, LAT + 0.4, 0.002)
    one = lambda pitch: solve.rays(CAMERA, np.array([960.0]), np.array([540.0]), np.array([0.0]), np.array([pitch]), np.array([0.0]))
    assert solve.crossing(sea, origin(1, 900), np.zeros((1, 3)), one(-8.0))[0][0] == pytest.approx(6490, abs=1)
    assert solve.crossing(sea, origin(1, 1400), np.zeros((1, 3)), one(-6.0))[0][0] == pytest.approx(13529, abs=1)


def test_perturbed_rays_meet_a_narrow_crest():
    z = np.zeros((2000, 600))
    z[880] = 500.0  # a ridge one cell wide, north of the camera
    crest = solve.Terrain(z, LON - 0.06, LAT + 0.2, 0.0002)
    aim = {k: np.array([v]) for k, v in {"u": 960.0, "v": 540.0, "yaw": 0.0, "pitch": -14.0, "roll": 0.0}.items()}
    d = solve.rays(CAMERA, *aim.values())
    t, _ = solve.crossing(crest, origin(1, 700), np.zeros((1, 3)), d)
    s = solve.Solver()
    found = solve.spread(crest, CAMERA, s, s.noise, origin(1, 700), aim, np.array([1]), t[:, None] * d)
    assert t[0] < 3000 and found["hit_rate"][0] == 1 and 0 < found["cep50_m"][0] < found["cep90_m"][0]
    again = solve.spread(crest, CAMERA, s, s.noise, origin(2, 700), {k: np.repeat(v, 2) for k, v in aim.items()}, np.array([7, 1]), np.repeat(t[:, None] * d, 2, axis=0))
    assert again["cep90_m"][1] == found["cep90_m"][0]


def test_radii_are_percentiles_over_hits():
    terrain, s = solve.synthetic(), solve.Solver(trials=40)
    aim = {k: np.array([v]) for k, v in {"u": 960.0, "v": 540.0, "yaw": 30.0, "pitch": -9.0, "roll": 0.0}.items()}
    noise = solve.Noise(5.0, 2.0, 6.0, 0.5, 2.0, 3.0, 4.0)
    d = solve.rays(CAMERA, *aim.values())
    t, _ = solve.crossing(terrain, origin(1, 1200), np.zeros((1, 3)), d)
    found = solve.spread(terrain, CAMERA, s, noise, origin(1, 1200), aim, np.array([3]), t[:, None] * d)
    z = np.random.default_rng(3).standard_normal((9, 40))
    own = solve.rays(CAMERA, 960 + 5 * z[0], 540 + 5 * z[1], 30 + 2 * z[2], -9 + 6 * z[3], 0.5 * z[4])
    off = np.stack([2 * z[5], 2 * z[6], 3 * z[7] - 4 * z[8]], -1)
    tt, _ = solve.crossing(terrain, origin(40, 1200), off, own, fine=False)
    ok = np.isfinite(tt)
    away = (off + tt[:, None] * own)[ok, :2] - (t[:, None] * d)[0, :2]
    assert 0 < ok.sum() < 40
    assert found["cep50_m"][0] == pytest.approx(np.percentile(np.hypot(*away.T), 50)) and found["cep90_m"][0] == pytest.approx(np.percentile(np.hypot(*away.T), 90))
    assert found["hit_rate"][0] == ok.mean() and found["bias_m"][0] == pytest.approx(np.hypot(*away.mean(0)))


def poses(spark, rows):
    return spark.createDataFrame([(k, 960.0, 540.0, LAT, LON, *r) for k, r in enumerate(rows)], "row_id long, u double, v double, cam_lat double, cam_lon double, cam_alt double, yaw double, pitch double, roll double, wind_speed double, wind_from double")


def test_gates(spark):
    rows = [(1500.0, 0.0, -30.0, 0.0, 3.0, 270.0), (1500.0, 0.0, -2.0, 0.0, 3.0, 270.0), (9000.0, 0.0, -20.0, 0.0, None, None), (1500.0, 47.0, -30.0, 0.0, 0.0, 10.0)]
    d = poses(spark, rows)
    got = {r.row_id: r for r in solve.solved(d, solve.synthetic(), CAMERA, solve.Solver(drift_s=30.0)).collect()}
    assert [got[k].reason for k in range(4)] == [None, "grazing", "no_intersection", None]
    assert got[1].lat is None and got[1].depression == pytest.approx(2.0)
    assert got[0].lon < got[0].lon_uncorrected and got[0].lat == pytest.approx(got[0].lat_uncorrected, abs=1e-6)
    assert got[3].lat_uncorrected is None and got[3].hit_rate == 1.0
    sloppy = solve.Solver(noise=solve.Noise(20.0, 15.0, 8.0, 8.0, 5.0, 10.0, 15.0), cep_max=50.0)
    r = solve.solved(d.where("row_id = 0"), solve.synthetic(), CAMERA, sloppy).first()
    assert (r.reason, r.lat, r.range_m) == ("cep_too_large", None, None) and r.cep90_m > 50
    assert solve.solved(d.where("row_id = 0"), solve.synthetic(half=0.01), CAMERA).first().reason == "out_of_dem"
    assert solve.solved(d.limit(0), solve.synthetic(), CAMERA).collect() == []


def test_anchors(spark):
    d = spark.createDataFrame([(0.0, 10.0, 20.0, 50.0)], "x1 double, y1 double, x2 double, y2 double")
    assert [tuple(solve.aimed(d, solve.Solver(anchor=a)).select("u", "v").first()) for a in ("centre", "base")] == [(10.0, 30.0), (10.0, 50.0)]


def test_round_trip_and_sweep(spark):
    sites = spark.createDataFrame([("a", LAT, LON), ("b", LAT + 0.1, LON - 0.05), ("off", 0.0, 0.0)], "site string, lat double, lon double")
    r = solve.round_trip(sites, solve.synthetic(), CAMERA).first()
    assert r.n_samples > 150 and r.max_m < 1e-3 and r.pixel_residual_px < 1e-6
    sweep = {g: {r.depression: r for r in solve.swept(sites, solve.synthetic(), CAMERA, n, solve.Solver(trials=60)).collect()} for g, n in (("consumer", solve.CONSUMER), ("rtk", solve.RTK))}
    assert sorted(sweep["rtk"]) == solve.SWEEP and all(r.n_attempted == 16 for r in sweep["rtk"].values())
    assert sweep["consumer"][90.0].cep50_m < sweep["consumer"][30.0].cep50_m < sweep["consumer"][15.0].cep50_m
    assert all(sweep["rtk"][k].cep50_m < sweep["consumer"][k].cep50_m for k in (15.0, 30.0, 60.0)) and sweep["consumer"][90.0].publish_rate == 1


def test_cameras():
    a, b = solve.Camera.from_fov(1920, 1080, 73.7, 45.0), solve.Camera.from_sensor(1920, 1080, 4.5, 6.4, 3.6)
    assert a.fov() == pytest.approx((73.7, 45.0)) and (b.fx, b.fy) == pytest.approx((1350.0, 1350.0))
    assert a.matrix() == [[a.fx, 0.0, 960.0], [0.0, a.fy, 540.0], [0.0, 0.0, 1.0]]


def test_terrain():
    z = np.arange(12.0).reshape(3, 4)
    t = solve.Terrain(z, 10.0, 50.0, 1.0, geoid=100.0)
    assert t.at(np.array([49.5, 49.0, 47.5, 49.6, 49.5]), np.array([10.5, 11.0, 13.5, 10.5, 13.6])) == pytest.approx([100.0, 102.5, 111.0, np.nan, np.nan], nan_ok=True)
    assert t.bounds() == {"west": 10.0, "south": 47.0, "east": 14.0, "north": 50.0}
    t.z[0, 0] = np.nan
    assert t.stats()["valid"] == pytest.approx(11 / 12) and t.stats()["lowest"] == 1.0


def test_geographic_distances_of_the_approximation():
    rng = np.random.default_rng(3)
    e, n, u = rng.uniform(-10_000, 10_000, 500), rng.uniform(-10_000, 10_000, 500), rng.uniform(-1500, 0, 500)
    a, b = solve.exact(origin(500, 1500), e, n, u), solve.Nearby(origin(500, 1500)).at(slice(None), e, n, u)
    assert np.abs(a[0] - b[0]).max() * 111_000 < 0.2 and np.abs(a[1] - b[1]).max() * 90_000 < 0.2 and np.abs(a[2] - b[2]).max() < 0.05


def test_whole_run(spark):
    out = run.whole_run(spark, SF, [("north", 36.4420, 128.6900)]).cache()
    rows = out.collect()
    assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1))
    ordered = sorted(rows, key=lambda r: r.id)
    assert [(r.timestamp, r.site, r.track_id) for r in ordered] == sorted((r.timestamp, r.site, r.track_id) for r in rows)
    for r in rows:
        assert r.geo_ok == (r.lat is not None) and (r.geo_ok or r.geo_reject_reason)
        met = r.flow_ok + r.area_ok
        assert r.tier == ("FLARE" if met == 2 and r.geo_ok and r.criteria.enough_frames else "GLOW" if met else "SPARK")
        assert (r.nearest_unit_km is not None) == r.geo_ok and (r.text is not None) == (r.decision == "sent")
        assert r.decision != "stored" or r.tier == "SPARK"
    assert {r.tier for r in rows} == {"FLARE", "GLOW", "SPARK"} and any(r.n_observations >= 3 for r in rows)
    assert out.where(F.col("text").contains("경보")).count() == sum(r.decision == "sent" for r in rows)


@pytest.mark.parametrize("rough", [0.0, 25.0])
def test_perturbed_rays_skip_only_samples_above_ground(rough, monkeypatch):
    rng = np.random.default_rng(4)
    terrain = solve.synthetic(half=0.1)
    terrain.z[:] += rng.uniform(0, rough, terrain.z.shape)
    n, seen = 400, []
    o = solve.Origin(np.full(n, LAT), np.full(n, LON), rng.uniform(700, 1800, n))
    d = solve.rays(CAMERA, *(rng.uniform(0, s, n) for s in (1920, 1080)), rng.uniform(0, 360, n), -rng.uniform(2, 60, n), rng.uniform(-5, 5, n))
    f = rng.normal(0, 5, (n, 3))
    at, t = solve.Nearby(o), np.linspace(0, 15_000, 751)
    lat, lon, h = at.at(slice(None), *(f[:, c, None] + t * d[:, c, None] for c in range(3)))
    gap = h - terrain.at(lat, lon)
    low, gone = gap <= 0, np.isnan(gap)
    first, out = np.where(low.any(1), low.argmax(1), 751), np.where(gone.any(1), gone.argmax(1), 751)
    if hasattr(solve, "_Descent"):
        real = solve._Descent.gap
        monkeypatch.setattr(solve._Descent, "gap", lambda self, parts, x: seen.append(len(x)) or real(self, parts, x))
    else:
        real = solve.Terrain.at
        monkeypatch.setattr(solve.Terrain, "at", lambda self, a, b: seen.append(a.size) or real(self, a, b))
    got, left = solve.crossing(terrain, o, f, d, fine=False)
    hit = (first > 0) & (first < out)
    assert hit.sum() > 100 and np.array_equal(np.isfinite(got), hit) and np.array_equal(left, ~hit & ((first == 0) | (out < 751)))
    assert ((got[hit] >= t[first[hit] - 1]) & (got[hit] <= t[first[hit]])).all()
    assert sum(seen) < 45 * n


def test_whole_run_writes_no_column_that_follows_from_its_row(spark, monkeypatch):
    written = {}
    for module in (run, run.store):
        monkeypatch.setattr(module, "materialize", lambda d, name: (written.setdefault(name, d.columns), materialize(d, name))[1])
    run.whole_run(spark, SF, [("north", 36.4420, 128.6900)])
    assert written and not {"criteria", "features", "explanation"} & {c for columns in written.values() for c in columns}
