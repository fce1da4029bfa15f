"""Where rays meet the ground, by joins with a terrain that is a table of cells: a small one is broadcast, a larger one shuffled.

A ray is a line in earth-centred coordinates, sampled in steps of its length. Blocks of samples are joined with coarse tiles and go
where they stay above the highest ground around; the samples of the others are joined with the cells that they are over, and the
first at or below ground is a grouped minimum. The crossing is then halved in within the few cells between the two samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.functions import geodesy as geo
from hazeline.operators.solve import GRAZING, NO_INTERSECTION, OUT_OF_DEM, Camera, Solver
from hazeline.session import materialize, task_count

#: Samples in a block, and cells along a tile. A block is shorter than a tile, so it is over the tile where it begins or one beside.
BLOCK, TILE = 8, 16
#: Metres that a ray can sink below the ends of a block or above a straight line, by the curvature of the earth within 15 km.
SAG, CURVE = 0.05, 20.0


@dataclass(frozen=True)
class Grid:
    """Where the cells of a terrain are: west and north edges of its first pixel and the size of a pixel, in degrees. Cell (i, j)
    is between the centres of four pixels, of which (i, j) is the north-west one."""

    west: float
    north: float
    cell: float


def phases(seed: int) -> list[float]:
    return np.random.default_rng(seed).uniform(0, 2 * np.pi, 6).tolist()


def synthetic_heights(spark: SparkSession, lat: float = 36.4127, lon: float = 128.7043, seed: int = 7, half: float = 0.35, cell: float = 1 / 1200, base: float = 200.0, relief: float = 600.0) -> tuple[DataFrame, Grid]:
    """(i, j, z) of the terrain of solve.synthetic, made by all tasks, and its grid."""
    p, n = phases(seed), round(2 * half / cell)
    x = lambda k: (F.col(k) + 0.5) * cell * 100
    d = spark.range(n * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    raw = sum((w * F.sin(f * x("i") + p[2 * k]) * F.cos(f * x("j") + p[2 * k + 1]) for k, (w, f) in enumerate(((1.0, 0.3), (0.5, 0.7), (0.25, 1.5)))), F.lit(0.0))
    d = materialize(d.withColumn("z", raw), "heights")
    low, high = d.agg(F.min("z"), F.max("z")).first()
    return d.withColumn("z", base + relief * (F.col("z") - low) / (high - low)), Grid(lon - half, lat + half, cell)


def cells_of(heights: DataFrame) -> DataFrame:
    """(i, j, a, b, c, d): the heights at the north-west, north-east, south-west and south-east corner of each cell of
    heights(i, j, z). A cell with a corner that is null or missing isn't there. One shuffle: each pixel goes to its four cells."""
    to = F.explode(F.array(*(F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(2 * di + dj).alias("corner")) for di in (0, 1) for dj in (0, 1))))
    x = heights.where(F.col("z").isNotNull() & ~F.isnan("z")).select("z", to.alias("t")).select("z", "t.*")
    x = x.groupBy("i", "j").agg(*(F.max(F.when(F.col("corner") == k, F.col("z"))).alias(c) for k, c in enumerate("abcd")))
    return x.where(" AND ".join(f"{c} IS NOT NULL" for c in "abcd"))


def _tiles(cells: DataFrame) -> DataFrame:
    """(ti, tj, top): the highest corner in a tile of cells and the eight around it, for tiles that have all cells of these nine.
    Elsewhere a ray may be over no cell, which its samples have to find."""
    top = cells.groupBy(F.floor(F.col("i") / TILE).alias("ti"), F.floor(F.col("j") / TILE).alias("tj")).agg(F.max(F.greatest(*"abcd")).alias("top"), F.count("*").alias("n"))
    near = F.explode(F.array(*(F.struct((F.col("ti") + a).alias("ti"), (F.col("tj") + b).alias("tj")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    near = top.select("top", "n", near.alias("t")).groupBy("t.ti", "t.tj").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    return near.where(F.col("n") == 9 * TILE * TILE).drop("n")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _row(lat: Column, grid: Grid) -> Column:
    return (grid.north - lat) / grid.cell - 0.5


def _column(lon: Column, grid: Grid) -> Column:
    return (lon - grid.west) / grid.cell - 0.5


def _on_earth(d: DataFrame) -> DataFrame:
    """d(_x, _y, _z) with _lat, _lon in radians and _h, the closed form a step at a time, so that no step is written out twice."""
    d = d.withColumn("_r", F.hypot("_x", "_y"))
    d = d.withColumn("_t", F.atan2(F.col("_z") * geo.A, F.col("_r") * geo.B)).withColumns({"_s": F.sin("_t"), "_c": F.cos("_t")})
    d = d.withColumn("_lat", F.atan2(F.col("_z") + geo.EP2 * geo.B * F.pow("_s", 3), F.col("_r") - geo.E2 * geo.A * F.pow("_c", 3))).withColumn("_s", F.sin("_lat"))
    h = F.col("_r") / F.cos("_lat") - geo.A / F.sqrt(1 - geo.E2 * F.col("_s") * F.col("_s"))
    return d.withColumns({"_lon": F.atan2("_y", "_x"), "_h": h}).drop("_r", "_t", "_s", "_c")


def _placed(d: DataFrame, k: Column, dt: float, grid: Grid, tag: str = "") -> DataFrame:
    """d with h, row and col (height, and fractional row and column) at the k-th sample of each ray."""
    d = _on_earth(d.withColumns({f"_{x}": F.col(f"o{x}") + k * dt * F.col(f"d{x}") for x in "xyz"}))
    place = {f"h{tag}": F.col("_h"), f"row{tag}": _row(F.degrees("_lat"), grid), f"col{tag}": _column(F.degrees("_lon"), grid)}
    return d.withColumns(place).drop("_x", "_y", "_z", "_lat", "_lon", "_h")


def _height(r: Column, c: Column, q) -> Column:
    """Bilinear height over cell q, a struct or row of i, j and its corners."""
    a, b = r - q["i"], c - q["j"]
    north, south = q["a"] + b * (q["b"] - q["a"]), q["c"] + b * (q["d"] - q["c"])
    return north + a * (south - north)


def heights_at(points: DataFrame, cells: DataFrame, grid: Grid, to: str = "ground") -> DataFrame:
    """points(lat, lon, ...) with the bilinear height of the terrain under each; null where there is no cell."""
    x = points.withColumns({"_row": _row(F.col("lat"), grid), "_col": _column(F.col("lon"), grid)})
    q = cells.select(F.struct(*"ijabcd").alias("_q"), F.col("i").alias("_i"), F.col("j").alias("_j"))
    x = x.join(q, (F.floor("_row") == F.col("_i")) & (F.floor("_col") == F.col("_j")), "left")
    return x.withColumn(to, _height(F.col("_row"), F.col("_col"), F.col("_q"))).drop("_row", "_col", "_q", "_i", "_j")


def direction(camera: Camera | None = None) -> tuple[Column, Column, Column]:
    """East, north and up of the rays of pixels u, v under yaw, pitch, roll. Without a camera each row brings its own: fx, fy, cx,
    cy, and lens, of which distorted says whether it does anything, as sources.config.cameras has them."""
    c = F.col
    if camera is not None:
        ray = geo.pixel_ray(c("u"), c("v"), camera.fx, camera.cx, camera.cy, camera.fy)
    else:
        x, y = (c("u") - c("cx")) / c("fx"), (c("v") - c("cy")) / c("fy")
        straight = geo.undistort(x, y, *(F.get("lens", F.lit(k)) for k in range(5)))
        at = F.when(c("distorted"), straight).otherwise(F.struct(x.alias("x"), y.alias("y")))
        ray = geo.pixel_ray(at["x"], at["y"], 1.0, 0.0, 0.0)
    return geo.rotate(ray, c("yaw"), c("pitch"), c("roll"))


def fixed(rays: DataFrame, cells: DataFrame, grid: Grid, camera: Camera | None = None, solver: Solver | None = None, voids: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, depression, reason, lat, lon, elevation_m, range_m, cep50_m, cep90_m, *keep) of rays, as solve.solved has them, with the
    places of crossings() and null radii: what can be said without noise. Rays below the least depression, or without one, are
    grazing and meet no terrain."""
    solver = solver or Solver()
    x = rays.withColumns({f"_{k}": v for k, v in zip("enu", direction(camera), strict=True)})
    x = x.withColumn("depression", geo.depression(tuple(F.col(f"_{k}") for k in "enu"))).drop("_e", "_n", "_u")
    fine = F.col("depression") >= solver.grazing
    out = crossings(x, cells, grid, camera, solver, voids, where=fine, keep=["depression", *keep])
    fine = F.coalesce(fine, F.lit(False))
    out = out.withColumns({"reason": F.when(fine, F.col("reason")).otherwise(GRAZING), **{k: F.when(fine, F.col(k)) for k in ("lat", "lon", "elevation_m", "range_m")}})
    none = F.lit(None).cast("double")
    return out.select("row_id", "depression", "reason", "lat", "lon", "elevation_m", "range_m", none.alias("cep50_m"), none.alias("cep90_m"), *keep)


def _halved(grid: Grid, dt: float):
    """Arrow batches of rays with hit and their cells (i, j and corners), with range_m for cells: the middle between the samples
    hit - 1 and hit after twenty halvings, null where hit is. Over none of its cells a ray isn't above ground."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met, held = b.column("hit").is_valid().to_numpy(zero_copy_only=False), b.column("cells")
            sizes = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            own, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            around = np.full((6, len(sizes), max(sizes.max(initial=0), 1)), np.nan)
            for k, part in enumerate(held.flatten().flatten()):
                around[k, own, place] = part.to_numpy(zero_copy_only=False)
            around = around[:, met]
            o, d = (np.stack([b.column(f"{a}{x}").to_numpy(zero_copy_only=False)[met] for x in "xyz"]) for a in "od")
            hit = b.column("hit").fill_null(0).to_numpy(zero_copy_only=False)[met]
            lo, hi, rows = (hit - 1) * dt, hit * dt, np.arange(len(hit))
            for _ in range(20):
                mid = (lo + hi) / 2
                x, y, z = o + mid * d
                r = np.hypot(x, y)
                t = np.arctan2(z * geo.A, r * geo.B)
                lat = np.arctan2(z + geo.EP2 * geo.B * np.sin(t) ** 3, r - geo.E2 * geo.A * np.cos(t) ** 3)
                h = r / np.cos(lat) - geo.A / np.sqrt(1 - geo.E2 * np.sin(lat) ** 2)
                row, col = _row(np.degrees(lat), grid), _column(np.degrees(np.arctan2(y, x)), grid)
                q = (around[0] == np.floor(row)[:, None]) & (around[1] == np.floor(col)[:, None])
                up = q.any(1) & (h - _height(row, col, dict(zip("ijabcd", around[:, rows, q.argmax(1)], strict=True))) > 0)
                lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
            out = np.full(len(met), np.nan)
            out[met] = (lo + hi) / 2
            keep = [k for k, name in enumerate(b.schema.names) if name != "cells"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out, mask=~met)], [*(b.schema.names[k] for k in keep), "range_m"])

    return run


def crossings(rays: DataFrame, cells: DataFrame, grid: Grid, camera: Camera | None = None, solver: Solver | None = None, voids: bool = False, few: int = 1_000_000, where: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, *keep, reason, lat, lon, elevation_m, range_m) of rays(row_id, u, v, cam_lat, cam_lon, cam_alt, yaw, pitch, roll): the first
    sample at or below ground, then twenty halvings. cells is a written table of cells_of().

    A ray that starts at or below ground, or is over no cell before it meets the ground, is out_of_dem; one that meets nothing
    within its range is no_intersection. With voids every sample counts, so a ray high above a hole in the terrain is over no cell
    there; without, samples above all terrain are passed over. Where `where` doesn't hold a ray stays where it starts. A row_id is one ray.

    Cells are broadcast if a count finds at most `few` (some 100 bytes each), and tiles likewise. Rays are then dealt once by row_id, and
    no sample is written or shuffled. Else samples are shuffled to their cells.
    """
    solver = solver or Solver()
    steps = max(2, math.ceil(solver.range_m / solver.step_m) + 1)
    dt = solver.range_m / (steps - 1)
    d = rays.withColumns({**{f"_{k}": v for k, v in zip("enu", direction(camera), strict=True)}, "_p": F.radians("cam_lat"), "_q": F.radians("cam_lon")})
    d = d.withColumn("_len", F.sqrt(F.col("_e") ** 2 + F.col("_n") ** 2 + F.col("_u") ** 2))
    e, n, u = (F.col(f"_{k}") / F.col("_len") for k in "enu")
    s, c, v, w = F.sin("_p"), F.cos("_p"), F.sin("_q"), F.cos("_q")
    origin = geo.ecef(F.col("cam_lat"), F.col("cam_lon"), F.col("cam_alt"))
    line = {"ox": origin[0], "oy": origin[1], "oz": origin[2], "dx": -v * e - s * w * n + c * w * u, "dy": w * e - s * v * n + c * v * u, "dz": c * n + s * u}
    d = d.withColumns({"down": -u, "alt": F.col("cam_alt"), "on": F.lit(True) if where is None else F.coalesce(where, F.lit(False))})
    d = d.select("row_id", *keep, "down", "alt", "on", *(x.alias(k) for k, x in line.items()))

    low, high = cells.agg(F.min(F.least(*"abcd")), F.max(F.greatest(*"abcd"))).first()
    places = ("lat", "lon", "elevation_m", "range_m")
    if high is None:
        return d.select("row_id", *keep, F.lit(OUT_OF_DEM).alias("reason"), *(F.lit(None).cast("double").alias(k) for k in places))
    reach = lambda metres: F.when(F.col("down") > 1e-9, metres / F.col("down") / dt)
    first = F.when(F.col("down") > 0, reach(F.col("alt") - high)).when(F.col("alt") > high, F.lit(float(steps - 1))).otherwise(0.0)
    first = F.lit(1.0) if voids else first
    d = d.withColumns({
        "k0": F.least(F.greatest(F.floor(F.coalesce(first, F.lit(0.0))), F.lit(1)), F.lit(steps - 1)).cast("int"),
        "k1": F.least(F.greatest(F.ceil(F.coalesce(reach(F.col("alt") - low + CURVE), F.lit(float(steps)))) + 1, F.lit(1)), F.lit(steps - 1)).cast("int"),
    }).withColumn("k1", F.greatest("k0", "k1")).drop("down", "alt")
    ray = ["row_id", *keep, *line]
    near = cells.count() <= few
    d = d.repartition(task_count(d.sparkSession), "row_id") if near else materialize(d, "rays")
    # sample 0 is a block of its own, which stays
    start, end = ((F.col(k) / BLOCK).cast("int") for k in ("k0", "k1"))
    b = d.withColumn("block", F.explode(F.concat(F.array(F.lit(-1)), F.when(F.col("on"), F.sequence(start, end)).otherwise(F.array().cast("array<int>")))))
    own = lambda x: F.when(F.col("block") < 0, 0).otherwise(x)
    b = b.withColumns({"ka": own(F.greatest("k0", F.col("block") * BLOCK)), "kb": own(F.least("k1", F.col("block") * BLOCK + BLOCK - 1))})
    b = _placed(_placed(b.select(*ray, "block", "ka", "kb"), F.col("ka"), dt, grid), F.col("kb"), dt, grid, "2")
    tiles = materialize(_tiles(cells), "tiles")
    b = b.withColumns({"ti": F.floor(F.floor("row") / TILE), "tj": F.floor(F.floor("col") / TILE)}).join(F.broadcast(tiles) if tiles.count() <= few else tiles, ["ti", "tj"], "left")
    b = b.where((F.col("block") < 0) | F.col("top").isNull() | (F.least("h", "h2") - SAG <= F.col("top")))
    k = _placed(b.select(*ray, F.explode(F.sequence("ka", "kb")).alias("k")), F.col("k"), dt, grid)
    k = k.withColumns({"i": F.floor("row").cast("int"), "j": F.floor("col").cast("int")})
    by = ray if near else ["row_id"]
    over = k.select(*by, "k", "h", "row", "col", "i", "j").join(F.broadcast(cells) if near else cells, ["i", "j"], "left")
    over = over.withColumn("z", _height(F.col("row"), F.col("col"), {x: F.col(x) for x in "ijabcd"}))
    met = F.col("h") - F.col("z") <= 0
    x = over.groupBy(*by).agg(F.min(F.when(met, F.col("k"))).alias("hit"), F.min(F.when(F.col("z").isNull(), F.col("k"))).alias("gone"))
    x = x if near else d.select(*ray).join(x, "row_id", "left")
    ok = F.coalesce((F.col("hit") >= 1) & (F.col("gone").isNull() | (F.col("hit") < F.col("gone"))), F.lit(False))
    out = F.col("gone").isNotNull() | (F.col("hit") == 0)
    x = x.withColumn("reason", F.when(~ok, F.when(out, OUT_OF_DEM).otherwise(NO_INTERSECTION))).withColumn("hit", F.when(ok, F.col("hit"))).drop("gone")

    # the cells between the sample above and the one below ground
    h = _placed(_placed(x, F.col("hit") - 1, dt, grid), F.col("hit"), dt, grid, "2")
    span = lambda p: F.sequence(F.floor(F.least(p, f"{p}2")).cast("int"), F.floor(F.greatest(p, f"{p}2")).cast("int"))
    known = [*ray, "hit", "reason"]
    need = h.select(*known, F.explode_outer(F.when(F.col("hit").isNotNull(), span("row"))).alias("i"), span("col").alias("js")).select(*known, "i", F.explode_outer(F.when(F.col("i").isNotNull(), F.col("js"))).alias("j"))
    around = need.join(F.broadcast(cells) if near else cells, ["i", "j"], "left")
    around = around.groupBy(*known).agg(F.collect_list(F.when(F.col("a").isNotNull(), F.struct(*"ijabcd"))).alias("cells"))
    h = around.mapInArrow(_halved(grid, dt), T.StructType([*around.drop("cells").schema, T.StructField("range_m", T.DoubleType())]))
    h = _on_earth(h.withColumns({f"_{p}": F.col(f"o{p}") + F.col("range_m") * F.col(f"d{p}") for p in "xyz"}))
    return h.select("row_id", *keep, "reason", F.degrees("_lat").alias("lat"), F.degrees("_lon").alias("lon"), F.col("_h").alias("elevation_m"), "range_m")
