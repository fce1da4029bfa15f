"""Crossings by joins against the march of the kernel, and terrain tiles against a single grid."""

import struct
import zlib

import numpy as np
import pytest

from hazeline.operators import crossing, solve
from hazeline.session import materialize
from hazeline.sources import terrain

CELL = 1 / 1200


def table(spark, z):
    rows = [(i, j, float(v)) for i, line in enumerate(z) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "i int, j int, z double").repartition(4)


def poses(spark, n=150, half=0.03):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(n):
        alt = float(rng.choice([rng.uniform(500, 1500), 150.0, 3000.0], p=[0.8, 0.1, 0.1]))
        rows.append((k, float(rng.uniform(100, 1800)), float(rng.uniform(100, 1000)), 36.0 + float(rng.uniform(-half, half)), 128.0 + float(rng.uniform(-half, half)), alt, float(rng.uniform(0, 360)), float(rng.uniform(-80, 10)), float(rng.uniform(-20, 20))))
    return spark.createDataFrame(rows, "row_id long, u double, v double, cam_lat double, cam_lon double, cam_alt double, yaw double, pitch double, roll double")


@pytest.mark.parametrize("voids, few", [(False, 100_000), (False, 0), (True, 100_000)])
def test_places_of_the_march(spark, voids, few):
    rng = np.random.default_rng(5)
    n = 150
    x = np.linspace(0, 12, n)
    z = 300 + 120 * np.sin(x)[:, None] * np.cos(1.3 * x) + rng.uniform(0, 15, (n, n))
    if voids:
        z[40:48, 60:75] = np.nan
        z[100, 20] = np.nan
    grid = crossing.Grid(128.0 - n / 2 * CELL, 36.0 + n / 2 * CELL, CELL)
    camera, d = solve.Camera.from_fov(1920, 1080, 73.7), poses(spark)
    cells = materialize(crossing.cells_of(table(spark, z)), "cells")
    assert cells.count() == int((~np.isnan(z[:-1, :-1] + z[1:, :-1] + z[:-1, 1:] + z[1:, 1:])).sum())
    got = {r.row_id: r for r in crossing.crossings(d, cells, grid, camera, voids=voids, few=few).collect()}
    want = {r.row_id: r for r in solve.solved(d, solve.Terrain(z, grid.west, grid.north, CELL), camera, solve.Solver(grazing=-90.0), uncertain=False).collect()}
    odd = [(got[k], want[k]) for k in want if got[k].reason != want[k].reason]
    assert not odd, odd[:3]
    assert len({r.reason for r in want.values()}) >= 2
    for k, r in want.items():
        if r.range_m is not None:
            assert got[k].range_m == pytest.approx(r.range_m, abs=1e-3)
            assert (got[k].lat, got[k].lon) == pytest.approx((r.lat, r.lon), abs=1e-8) and got[k].elevation_m == pytest.approx(r.elevation_m, abs=1e-3)


def test_no_terrain_and_no_rays(spark):
    camera, grid = solve.Camera.from_fov(1920, 1080, 73.7), crossing.Grid(128.0, 36.0, CELL)
    none = materialize(crossing.cells_of(spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "i int, j int, z double")), "cells")
    assert {r.reason for r in crossing.crossings(poses(spark, 3), none, grid, camera).collect()} == {"out_of_dem"}
    some = materialize(crossing.cells_of(table(spark, np.zeros((5, 5)))), "cells")
    assert crossing.crossings(poses(spark, 3).limit(0), some, grid, camera).collect() == []


def test_synthetic_heights_are_those_of_the_grid(spark):
    whole = solve.synthetic(half=0.05)
    d, grid = crossing.synthetic_heights(spark, half=0.05)
    z = np.empty(whole.z.shape)
    for r in d.collect():
        z[r.i, r.j] = r.z
    assert np.abs(z - whole.z).max() < 1e-9 and (grid.west, grid.north, grid.cell) == (whole.west, whole.north, whole.cell)


def tiff(path, z, west, north, end="<", deflate=False, blocks=False, predictor=1, nodata=None, rotated=False):
    """Writes a tile: strips of seven rows, or blocks of 16 x 16."""
    kind = {"f": 3, "i": 2, "u": 1}[z.dtype.kind]
    h, w = z.shape
    parts = []
    if blocks:
        for a in range(0, h, 16):
            for b in range(0, w, 16):
                p = np.zeros((16, 16), z.dtype)
                own = z[a : a + 16, b : b + 16]
                p[: own.shape[0], : own.shape[1]] = own
                parts.append(p)
    else:
        parts = [z[a : a + 7] for a in range(0, h, 7)]
    if predictor == 2:
        parts = [np.diff(p, axis=1, prepend=np.zeros((len(p), 1), p.dtype)).astype(p.dtype) for p in parts]
    raw = [p.astype(p.dtype.newbyteorder(end)).tobytes() for p in parts]
    raw = [zlib.compress(r) for r in raw] if deflate else raw
    at, offsets = 8, []
    for r in raw:
        offsets.append(at)
        at += len(r)
    lengths = [len(r) for r in raw]
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [z.dtype.itemsize * 8]), (259, "H", [8 if deflate else 1]), (277, "H", [1]), (317, "H", [predictor]), (339, "H", [kind])]
    tags += [(322, "I", [16]), (323, "I", [16]), (324, "I", offsets), (325, "I", lengths)] if blocks else [(273, "I", offsets), (278, "I", [7]), (279, "I", lengths)]
    tags += [(34264, "d", [0.0] * 16)] if rotated else [(33550, "d", [CELL, CELL, 0.0]), (33922, "d", [0.0, 0.0, 0.0, west, north, 0.0])]
    if nodata is not None:
        tags.append((42113, "s", nodata))
    head, more = b"", b""
    start = at + 2 + 12 * len(tags) + 4
    for tag, k, values in sorted(tags):
        body = values.encode() + b"\0" if k == "s" else struct.pack(f"{end}{len(values)}{k}", *values)
        code, n = {"I": 4, "H": 3, "d": 12, "s": 2}[k], len(body) if k == "s" else len(values)
        if len(body) <= 4:
            head += struct.pack(f"{end}HHI", tag, code, n) + body.ljust(4, b"\0")
        else:
            head += struct.pack(f"{end}HHII", tag, code, n, start + len(more))
            more += body
    path.write_bytes((b"II" if end == "<" else b"MM") + struct.pack(f"{end}HI", 42, at) + b"".join(raw) + struct.pack(f"{end}H", len(tags)) + head + b"\0" * 4 + more)


@pytest.mark.parametrize("kind, options", [("f4", {}), ("f4", {"deflate": True, "blocks": True, "nodata": "-9999"}), ("i2", {"end": ">", "deflate": True, "predictor": 2, "nodata": "-32768"}), ("i2", {"blocks": True})])
def test_a_mosaic_is_the_single_grid(spark, tmp_path, kind, options):
    rng = np.random.default_rng(2)
    whole = rng.uniform(0, 900, (40, 64)).astype(kind)
    none = {"-9999": -9999, "-32768": -32768}.get(options.get("nodata"), -5000)
    whole[3, 5] = whole[30, 40] = none
    (tmp_path / "b").mkdir()
    tiff(tmp_path / "a.tif", whole[:, :30], 128.0, 36.5, **options)
    tiff(tmp_path / "b" / "b.TIF", whole[:, 30:], 128.0 + 30 * CELL, 36.5, **options)
    tiff(tmp_path / "far.tiff", whole[:10, :10], 10.0, 10.0, **options)
    spark.dataSource.register(terrain.Tiles)
    d = spark.read.format("terrain").option("box", "127.9,36.4,128.2,36.6").load(str(tmp_path))
    rows = d.collect()
    top, left = round((90 - 36.5) / CELL), round((128 + 180) / CELL)
    got = {(r.i - top, r.j - left): r.z for r in rows}
    assert got == {(i, j): None if whole[i, j] == none else float(whole[i, j]) for i in range(40) for j in range(64)}
    assert all(r.lat == pytest.approx(36.5 - (r.i - top + 0.5) * CELL) and r.lon == pytest.approx(128 + (r.j - left + 0.5) * CELL) for r in rows)
    assert d.rdd.getNumPartitions() == 2 and spark.read.format("terrain").load(str(tmp_path)).rdd.getNumPartitions() == 3
    joined = {(r.i, r.j): r for r in crossing.cells_of(d).collect()}
    one = {(r.i + top, r.j + left): r for r in crossing.cells_of(table(spark, np.where(whole == none, np.nan, whole.astype(float)))).collect()}
    assert {k: (r.a, r.b, r.c, r.d) for k, r in joined.items()} == {k: (r.a, r.b, r.c, r.d) for k, r in one.items()}


def test_box_from_filters(spark, tmp_path):
    for k in range(4):
        tiff(tmp_path / f"{k}.tif", np.full((20, 20), k, "f4"), 128.0 + k, 36.5)
    reader = terrain.FilteringReader(str(tmp_path), (-180.0, -90.0, 180.0, 90.0))
    from pyspark.sql.datasource import GreaterThan, IsNotNull, LessThanOrEqual

    asked = [GreaterThan(("lon",), 129.0), LessThanOrEqual(("lon",), 130.01), IsNotNull(("z",))]
    assert list(reader.pushFilters(asked)) == asked
    assert [p.path[-5:] for p in reader.partitions()] == ["1.tif", "2.tif"]
    spark.dataSource.register(terrain.Tiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        d = spark.read.format("terrain").option("filters", "true").load(str(tmp_path)).where("lon > 129.0 AND lon <= 129.005")
        assert {r.z for r in d.select("z").distinct().collect()} == {1.0} and d.count() == 6 * 20
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_other_grids_are_refused(spark, tmp_path):
    tiff(tmp_path / "r.tif", np.zeros((4, 4), "f4"), 0.0, 0.0, rotated=True)
    with pytest.raises(ValueError, match="north-up"):
        terrain.header(str(tmp_path / "r.tif"))
    (tmp_path / "x.tif").write_bytes(b"PNG")
    with pytest.raises(ValueError, match="not a TIFF"):
        terrain.header(str(tmp_path / "x.tif"))
    with pytest.raises(FileNotFoundError):
        terrain.TileReader(str(tmp_path / "none"), (0, 0, 1, 1)).partitions()
    tiff(tmp_path / "p.tif", np.zeros((4, 4), "f4"), 0.0, 0.0, predictor=2)
    with pytest.raises(ValueError, match="packed"):
        terrain.heights(str(tmp_path / "p.tif"))


def test_a_far_peak_keeps_no_samples(spark):
    """Only tiles near a peak are as high as it, so a ray elsewhere needs few samples looked up."""
    flat = spark.range(289 * 289).selectExpr("cast(id div 289 as int) AS i", "cast(id % 289 as int) AS j", "if(id = 40 * 289 + 40, 500D, 0D) AS z")
    tiles = crossing._tiles(crossing.cells_of(flat)).collect()
    high = [t for t in tiles if t.top > 0]
    assert len(tiles) > len(high) and len(high) * crossing.TILE**2 <= 60**2


def test_samples_are_neither_written_nor_shuffled(spark, monkeypatch):
    """Over terrain that is broadcast, rays are dealt once and their samples stay in that task."""
    names = []
    monkeypatch.setattr(crossing, "materialize", lambda d, name: (names.append(name), materialize(d, name))[1])
    cells = materialize(crossing.cells_of(table(spark, np.zeros((40, 40)))), "cells")
    out = crossing.crossings(poses(spark, 20), cells, crossing.Grid(128.0 - 20 * CELL, 36.0 + 20 * CELL, CELL), solve.Camera.from_fov(1920, 1080, 73.7))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert names == ["tiles"] and plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert len(out.collect()) == 20
