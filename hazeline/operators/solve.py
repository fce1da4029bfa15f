"""From pixels to ground: terrain grid, ray crossing, and the error radius by perturbation, in Arrow batches.

Columns decide what columns can (rays, depression, the grazing gate, wind); the crossing is a numpy kernel over all rays of
a batch at once. A ray is marched in steps from where it sinks below the highest terrain, a few samples at a time, and only
rays that have not met the ground go on. Perturbed rays pass over samples that the steepest slope around can't reach. Heights follow the ellipsoid, so the curvature of the earth is in every sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions import geodesy as geo
from hazeline.operators.ranges import quantiles
from hazeline.session import materialize, task_count


@dataclass(frozen=True)
class Noise:
    """One sigma of pixel, yaw, pitch, roll (degrees), horizontal, vertical position and terrain height (metres)."""

    pixel: float
    yaw: float
    pitch: float
    roll: float
    horizontal: float
    vertical: float
    terrain: float


#: Grades of positioning.
CONSUMER, RTK, PERFECT = Noise(5.0, 2.0, 0.5, 0.5, 2.0, 3.0, 4.0), Noise(3.0, 0.5, 0.2, 0.2, 0.10, 0.15, 4.0), Noise(*[0.0] * 7)


@dataclass(frozen=True)
class Solver:
    """Range and step of the march, gates, number of trials, seconds of wind drift and the anchor of a box."""

    range_m: float = 15_000.0
    step_m: float = 20.0
    grazing: float = 8.0
    cep_max: float = 150.0
    trials: int = 200
    drift_s: float = 0.0
    anchor: str = "centre"
    noise: Noise = field(default_factory=lambda: CONSUMER)


@dataclass(frozen=True)
class Camera:
    width: int
    height: int
    fx: float
    fy: float
    cx: float
    cy: float

    @staticmethod
    def from_fov(width: int, height: int, hfov: float, vfov: float | None = None) -> Camera:
        fx = width / 2 / math.tan(math.radians(hfov) / 2)
        return Camera(width, height, fx, fx if vfov is None else height / 2 / math.tan(math.radians(vfov) / 2), width / 2, height / 2)

    @staticmethod
    def from_sensor(width: int, height: int, focal_mm: float, sensor_mm: float, sensor_height_mm: float | None = None) -> Camera:
        fx = focal_mm * width / sensor_mm
        return Camera(width, height, fx, fx if sensor_height_mm is None else focal_mm * height / sensor_height_mm, width / 2, height / 2)

    def matrix(self) -> list[list[float]]:
        return [[self.fx, 0.0, self.cx], [0.0, self.fy, self.cy], [0.0, 0.0, 1.0]]

    def fov(self) -> tuple[float, float]:
        """Horizontal and vertical field of view in degrees."""
        return math.degrees(2 * math.atan(self.width / (2 * self.fx))), math.degrees(2 * math.atan(self.height / (2 * self.fy)))


#: Fixed value: cells along a tile of the terrain's slopes.
LEAP = 16


@dataclass(frozen=True)
class Terrain:
    """Heights at pixel centres of a north-up grid in degrees; z[0, 0] is the north-west pixel. geoid is added to all."""

    z: np.ndarray
    west: float
    north: float
    cell: float
    geoid: float = 0.0

    def at(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Bilinear height of the four pixel centres around; NaN outside them."""
        c, r = (lon - self.west) / self.cell - 0.5, (self.north - lat) / self.cell - 0.5
        rows, columns = self.z.shape
        inside = (c >= 0) & (c <= columns - 1) & (r >= 0) & (r <= rows - 1)
        c, r = np.where(inside, c, 0.0), np.where(inside, r, 0.0)
        i, j = np.minimum(r.astype(np.int32), rows - 2), np.minimum(c.astype(np.int32), columns - 2)
        a, b = r - i, c - j
        flat, k = self.z.ravel(), i * columns + j
        top = flat[k] + b * (flat[k + 1] - flat[k])
        low = flat[k + columns] + b * (flat[k + columns + 1] - flat[k + columns])
        return np.where(inside, top + a * (low - top) + self.geoid, np.nan)

    @cached_property
    def highest(self) -> float:
        """The highest pixel, infinite where there are voids; z must not change after."""
        return float(self.z.max()) if np.isfinite(self.z).all() else np.inf

    @cached_property
    def steepest(self) -> tuple[np.ndarray, float]:
        """(greatest slope in a tile of LEAP x LEAP cells and the eight around it, metres from any point of a tile to the end of
        these nine); z must not change after."""
        edge = self.bounds()
        lat = max(abs(edge["south"]), abs(edge["north"]))
        tall, wide = self.cell * 110_500, self.cell * 110_500 * math.cos(math.radians(min(lat, 89.9)))
        down, across = np.abs(np.diff(self.z, axis=0)) / tall, np.abs(np.diff(self.z, axis=1)) / wide
        slope = np.hypot(np.maximum(down[:, 1:], down[:, :-1]), np.maximum(across[1:], across[:-1]))
        if lat > 75:  # the meridians close up too fast for the bound
            slope = np.full(slope.shape, np.inf)
        slope = np.pad(slope, [(0, -n % LEAP) for n in slope.shape])
        tiles = slope.reshape(slope.shape[0] // LEAP, LEAP, -1, LEAP).max(axis=(1, 3))
        wider = np.pad(tiles, 1)
        around = np.max([wider[a : a + tiles.shape[0], b : b + tiles.shape[1]] for a in range(3) for b in range(3)], axis=0)
        return around, LEAP * wide

    def stats(self) -> dict[str, float]:
        rows, columns = self.z.shape
        ok = np.isfinite(self.z)
        return {"rows": rows, "columns": columns, **self.bounds(), "valid": float(ok.mean()), "lowest": float(np.nanmin(self.z)), "highest": float(np.nanmax(self.z))}

    def bounds(self) -> dict[str, float]:
        rows, columns = self.z.shape
        return {"west": self.west, "south": self.north - rows * self.cell, "east": self.west + columns * self.cell, "north": self.north}


def synthetic(lat: float = 36.4127, lon: float = 128.7043, seed: int = 7, half: float = 0.35, cell: float = 1 / 1200, base: float = 200.0, relief: float = 600.0) -> Terrain:
    """Three products of sines with seeded phases around a place, stretched to base .. base + relief."""
    phase = np.random.default_rng(seed).uniform(0, 2 * np.pi, 6)
    n = round(2 * half / cell)
    x = (np.arange(n) + 0.5) * cell * 100  # about kilometres
    z = sum(w * np.outer(np.sin(f * x + phase[2 * k]), np.cos(f * x + phase[2 * k + 1])) for k, (w, f) in enumerate(((1.0, 0.3), (0.5, 0.7), (0.25, 1.5))))
    return Terrain(base + relief * (z - z.min()) / (z.max() - z.min()), lon - half, lat + half, cell)


@dataclass(frozen=True)
class Origin:
    """Camera places, arrays of one length: degrees and metres above the ellipsoid."""

    lat: np.ndarray
    lon: np.ndarray
    alt: np.ndarray

    def take(self, at: np.ndarray) -> Origin:
        return Origin(self.lat[at], self.lon[at], self.alt[at])


def exact(o: Origin, e: np.ndarray, n: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latitude, longitude and height of points east, north and up of their origins."""
    p, q = np.radians(o.lat), np.radians(o.lon)
    s, c, sq, cq = np.sin(p), np.cos(p), np.sin(q), np.cos(q)
    nu = geo.A / np.sqrt(1 - geo.E2 * s * s)
    x = (nu + o.alt) * c * cq - sq * e - s * cq * n + c * cq * u
    y = (nu + o.alt) * c * sq + cq * e - s * sq * n + c * sq * u
    z = (nu * (1 - geo.E2) + o.alt) * s + c * n + s * u
    r = np.hypot(x, y)
    t = np.arctan2(z * geo.A, r * geo.B)
    lat = np.arctan2(z + geo.EP2 * geo.B * np.sin(t) ** 3, r - geo.E2 * geo.A * np.cos(t) ** 3)
    return np.degrees(lat), np.degrees(np.arctan2(y, x)), r / np.cos(lat) - geo.A / np.sqrt(1 - geo.E2 * np.sin(lat) ** 2)


class Nearby:
    """The same to second order in distance over the earth's radius, at a fraction of the cost; a few centimetres at 15 km.
    Used for perturbed rays."""

    def __init__(self, o: Origin):
        p = np.radians(o.lat)
        w = 1 - geo.E2 * np.sin(p) ** 2
        self.parts = [geo.A / np.sqrt(w) + o.alt, geo.A * (1 - geo.E2) / w**1.5 + o.alt, np.tan(p), np.cos(p), o.lat, o.lon, o.alt]

    def at(self, rows, e: np.ndarray, n: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nu, mu, tan, cos, lat0, lon0, alt0 = (a[rows] if e.ndim == 1 else a[rows][:, None] for a in self.parts)
        ne, me = e / (nu + u), n / (mu + u)
        lat, lon = lat0 + np.degrees(me - 0.5 * tan * ne * ne), lon0 + np.degrees(ne / cos * (1 + tan * me))
        return lat, lon, alt0 + u + 0.5 * (e * ne + n * me)


class _Descent:
    """Gaps between rays and whole terrain to second order, for arrays of distances of some rays."""

    def __init__(self, terrain: Terrain, place: Nearby, offset: np.ndarray, ray: np.ndarray):
        nu, mu, tan, cos, lat, lon, alt = place.parts
        self.terrain, self.turn, self.flat = terrain, math.degrees(1) / terrain.cell, terrain.z.ravel()
        self.parts = [*offset.T, *ray.T, nu, mu, tan, cos, (terrain.north - lat) / terrain.cell - 0.5, (lon - terrain.west) / terrain.cell - 0.5, alt - terrain.geoid]

    def of(self, rows: np.ndarray) -> list[np.ndarray]:
        return [a[rows] for a in self.parts]

    def gap(self, parts: list[np.ndarray], t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Metres above ground, NaN outside the grid, and the cell below."""
        fe, fn, fu, de, dn, du, nu, mu, tan, cos, row, column, alt = parts
        e, n, u = fe + t * de, fn + t * dn, fu + t * du
        ne, me = e / (nu + u), n / (mu + u)
        r, c = row - self.turn * (me - 0.5 * tan * ne * ne), column + self.turn * (ne / cos * (1 + tan * me))
        rows, columns = self.terrain.z.shape
        inside = (c >= 0) & (c <= columns - 1) & (r >= 0) & (r <= rows - 1)
        i, j = (np.clip(x, 0, most - 2).astype(np.int32) for x, most in ((r, rows), (c, columns)))
        a, b, k = r - i, c - j, i * columns + j
        z, low = self.flat[k], self.flat[k + columns]
        z = z + b * (self.flat[k + 1] - z)
        z += a * (low + b * (self.flat[k + columns + 1] - low) - z)
        return np.where(inside, alt + u + 0.5 * (e * ne + n * me) - z, np.nan), i, j

    def first_low(self, rows: np.ndarray, first: np.ndarray, steps: int, dt: float) -> tuple[np.ndarray, np.ndarray]:
        """(first sample at or below ground or -1, left the grid first) of the rays rows. The gap closes no faster than the ray
        sinks and the steepest ground around rises, so the samples before it can be closed are above ground."""
        hit, gone = np.full(len(rows), -1), np.zeros(len(rows), bool)
        steep, reach = self.terrain.steepest
        own, parts, k = np.arange(len(rows)), self.of(rows), first.copy()
        while len(own):
            g, i, j = self.gap(parts, k * dt)
            low, out = g <= 0, np.isnan(g)
            hit[own[low]], gone[own[out]] = k[low], True
            sink = np.maximum(-parts[5], 0.0) + np.sqrt(np.maximum(1 - parts[5] * parts[5], 0.0)) * steep[i // LEAP, j // LEAP] + 1e-3
            far = np.minimum(0.98 * g / sink, 0.98 * reach)
            on = ~low & ~out & (k < steps - 1)
            own, parts, k = own[on], [a[on] for a in parts], np.minimum(k[on] + 1 + (far[on] / dt).astype(np.int64), steps - 1)
        return hit, gone

    def root(self, rows: np.ndarray, hit: np.ndarray, dt: float) -> np.ndarray:
        """Where the rays meet the ground between samples hit - 1 and hit: the middle of the 2^-20 of a step that a bisection
        ends in, found by false position, and by halves where that is slow."""
        parts, own, out = self.of(rows), np.arange(len(rows)), np.empty(len(rows))
        start, part = (hit - 1) * dt, dt / 2**20
        lo, hi = start.copy(), hit * dt
        glo, ghi = self.gap(parts, lo)[0], self.gap(parts, hi)[0]
        side = np.zeros(len(rows), np.int8)
        for k in range(40):
            at = lo + (hi - lo) * np.where((k < 16) & (glo > 0), glo / (glo - ghi), 0.5)
            g = self.gap(parts, at)[0]
            up = g > 0
            # of an end that stays twice the gap counts half
            glo, ghi = np.where(up, g, np.where(side == -1, glo / 2, glo)), np.where(up, np.where(side == 1, ghi / 2, ghi), g)
            lo, hi, side = np.where(up, at, lo), np.where(up, hi, at), np.where(up, 1, -1).astype(np.int8)
            done = (np.abs(g) < 1e-8) | (hi - lo < part / 4)
            out[own[done]] = at[done]
            on = ~done
            own, parts, lo, hi, glo, ghi, side = own[on], [a[on] for a in parts], lo[on], hi[on], glo[on], ghi[on], side[on]
            if not len(own):
                break
        out[own] = (lo + hi) / 2
        return start + (np.clip(np.floor((out - start) / part), 0, 2**20 - 1) + 0.5) * part


def crossing(terrain: Terrain, o: Origin, offset: np.ndarray, ray: np.ndarray, range_m: float = 15_000.0, step_m: float = 20.0, fine: bool = True, block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(distance or NaN, left the grid first) of rays (n, 3) from offsets (n, 3) east, north and up of their origins: the
    first sample at or below ground, then 20 bisections. A ray that starts at or below ground, or leaves the grid before it
    meets the ground, has left. Samples above the highest terrain can't meet it and are passed over where the grid has no
    voids; a straight ray that is inside the grid later was inside before."""
    n, steps = len(ray), max(2, math.ceil(range_m / step_m) + 1)
    dt = range_m / (steps - 1)
    out, left = np.full(n, np.nan), np.zeros(n, bool)
    if not n:
        return out, left
    highest = terrain.highest + terrain.geoid
    whole = np.isfinite(highest)
    place = Nearby(o)

    def gap(rows: np.ndarray, t: np.ndarray) -> np.ndarray:
        point = [offset[rows, c, None] + t * ray[rows, c, None] for c in range(3)]
        wide = Origin(*(a[rows, None] for a in (o.lat, o.lon, o.alt)))
        lat, lon, h = exact(wide, *point) if fine else place.at(rows, *point)
        return h - terrain.at(lat, lon)

    lat, lon, h = place.at(slice(None), offset[:, 0], offset[:, 1], offset[:, 2])
    start = h - terrain.at(lat, lon)
    left |= ~(start > 0)
    # the earth falls away below a ray, so this is never past the sample where it can first meet the ground
    down = -ray[:, 2]
    skip = np.where(down > 0, (h - highest) / np.maximum(down, 1e-12), np.where(h > highest, range_m, 0.0)) if np.isfinite(highest) else np.zeros(n)
    first = np.clip(np.floor(skip / dt).astype(np.int64), 1, steps - 1)
    rows = np.flatnonzero(~left)
    hit_at = np.full(n, -1)
    if whole and not fine:
        sinking = _Descent(terrain, place, offset, ray)
        hit_at[rows], left[rows] = sinking.first_low(rows, first[rows], steps, dt)
        rows = np.flatnonzero(hit_at > 0)
        out[rows] = sinking.root(rows, hit_at[rows], dt)
        return out, left
    at = first.copy()
    while len(rows):
        k = np.minimum(at[rows][:, None] + np.arange(block), steps - 1)
        g = gap(rows, k * dt)
        low, gone = g <= 0, ~np.isfinite(g)
        first_low = np.where(low.any(1), low.argmax(1), block)
        first_gone = np.where(gone.any(1), gone.argmax(1), block)
        hit = first_low < first_gone
        hit_at[rows[hit]] = k[hit, first_low[hit]]
        left[rows[~hit & (first_gone < block)]] = True
        at[rows] += block
        rows = rows[~hit & (first_gone == block) & (at[rows] < steps)]
    rows = np.flatnonzero(hit_at > 0)
    if len(rows):
        lo, hi = (hit_at[rows] - 1) * dt, hit_at[rows] * dt
        d, f, own = ray[rows], offset[rows], o.take(rows)
        convert = (lambda e, n_, u: exact(own, e, n_, u)) if fine else (lambda e, n_, u: place.at(rows, e, n_, u))
        for _ in range(20):
            mid = (lo + hi) / 2
            lat, lon, h = convert(*(f[:, c] + mid * d[:, c] for c in range(3)))
            above = h - terrain.at(lat, lon) > 0
            lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
        out[rows] = (lo + hi) / 2
    return out, left


def rays(camera: Camera, u, v, yaw, pitch, roll) -> np.ndarray:
    """Unit rays in east, north, up; arrays of one length."""
    y, p, r = map(np.radians, (yaw, pitch, roll))
    zero = np.zeros_like(y)
    forward = np.stack([np.sin(y) * np.cos(p), np.cos(y) * np.cos(p), np.sin(p)], -1)
    right, down = np.stack([np.cos(y), -np.sin(y), zero], -1), np.stack([np.sin(y) * np.sin(p), np.cos(y) * np.sin(p), -np.cos(p)], -1)
    c, s = np.cos(r)[:, None], np.sin(r)[:, None]
    d = ((u - camera.cx) / camera.fx)[:, None] * (c * right + s * down) + ((v - camera.cy) / camera.fy)[:, None] * (c * down - s * right) + forward
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def spread(terrain: Terrain, camera: Camera, solver: Solver, noise: Noise, o: Origin, aim: dict[str, np.ndarray], seed: np.ndarray, hit: np.ndarray) -> dict[str, np.ndarray]:
    """Median and 90 % radius of the ground points of perturbed rays around hit (n, 3), over the rays that meet the ground;
    the share that does; and the distance of their mean. Infinite (and NaN) without any. Each row has its own seed, so that
    it gets the same figures in any batch."""
    n, trials = len(hit), solver.trials
    noises = np.empty((n, 9, trials))
    for i, s in enumerate(seed.tolist()):
        noises[i] = np.random.default_rng(s % 2**63).standard_normal((9, trials))
    flat = lambda k, sigma: noises[:, k].ravel() * sigma
    each = lambda a: np.repeat(a, trials)
    d = rays(camera, each(aim["u"]) + flat(0, noise.pixel), each(aim["v"]) + flat(1, noise.pixel), each(aim["yaw"]) + flat(2, noise.yaw), each(aim["pitch"]) + flat(3, noise.pitch), each(aim["roll"]) + flat(4, noise.roll))
    f = np.stack([flat(5, noise.horizontal), flat(6, noise.horizontal), flat(7, noise.vertical) - flat(8, noise.terrain)], -1)
    t, _ = crossing(terrain, Origin(each(o.lat), each(o.lon), each(o.alt)), f, d, solver.range_m, solver.step_m, fine=False)
    away = (f[:, :2] + t[:, None] * d[:, :2]).reshape(n, trials, 2) - hit[:, None, :2]
    far = np.sort(np.hypot(away[..., 0], away[..., 1]), axis=1)  # NaN last
    hits = np.isfinite(far).sum(1)

    def percentile(q: float) -> np.ndarray:
        at = np.maximum(hits - 1, 0) * q
        i = np.floor(at).astype(int)
        rows = np.arange(n)
        a, b = far[rows, i], far[rows, np.minimum(i + 1, np.maximum(hits - 1, 0))]
        return np.where(hits > 0, a + (at - i) * (b - a), np.inf)

    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.nansum(away, axis=1) / hits[:, None]
    return {"cep50_m": percentile(0.5), "cep90_m": percentile(0.9), "hit_rate": hits / trials, "bias_m": np.where(hits > 0, np.hypot(mean[:, 0], mean[:, 1]), np.nan)}


_POSE = ["cam_lat", "cam_lon", "cam_alt", "yaw", "pitch", "roll"]
_OUT = "row_id long, reason string, lat double, lon double, elevation_m double, range_m double, cep50_m double, cep90_m double, hit_rate double, bias_m double"
#: Reasons for refusing a place.
GRAZING, OUT_OF_DEM, NO_INTERSECTION, CEP_TOO_LARGE = "grazing", "out_of_dem", "no_intersection", "cep_too_large"


def _kernel(ground, camera: Camera, solver: Solver, uncertain: bool, slice_rows: int = 128):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terrain = ground.value
        for pdf in batches:
            for a in range(0, len(pdf), slice_rows if uncertain else 4096):
                own = pdf.iloc[a : a + (slice_rows if uncertain else 4096)]
                aim = {c: own[c].to_numpy(float) for c in ("u", "v", "yaw", "pitch", "roll")}
                o = Origin(*(own[c].to_numpy(float) for c in ("cam_lat", "cam_lon", "cam_alt")))
                n = len(own)
                d, zero = rays(camera, *aim.values()), np.zeros((n, 3))
                t, left = crossing(terrain, o, zero, d, solver.range_m, solver.step_m)
                p = t[:, None] * d
                lat, lon, h = exact(o, p[:, 0], p[:, 1], p[:, 2])
                hit = np.isfinite(t)
                reason = np.where(hit, "", np.where(left, OUT_OF_DEM, NO_INTERSECTION)).astype(object)
                figures = {k: np.full(n, np.nan) for k in ("cep50_m", "cep90_m", "hit_rate", "bias_m")}
                if uncertain and hit.any():
                    at = np.flatnonzero(hit)
                    for k, x in spread(terrain, camera, solver, solver.noise, o.take(at), {c: x[at] for c, x in aim.items()}, own["row_id"].to_numpy()[at], p[at]).items():
                        figures[k][at] = x
                    reason[at[~(figures["cep90_m"][at] <= solver.cep_max)]] = CEP_TOO_LARGE
                ok = reason == ""
                blank = lambda x, ok=ok: np.where(ok, x, np.nan)
                yield pd.DataFrame({"row_id": own["row_id"].to_numpy(), "reason": np.where(ok, None, reason), "lat": blank(lat), "lon": blank(lon), "elevation_m": blank(h), "range_m": blank(t), **figures})

    return run


def aimed(d: DataFrame, solver: Solver | None = None) -> DataFrame:
    """d(x1, y1, x2, y2, ...) with the pixel u, v of each box: its centre, or the middle of its lower edge."""
    low = F.greatest("y1", "y2") if (solver or Solver()).anchor == "base" else (F.col("y1") + F.col("y2")) / 2
    return d.withColumns({"u": (F.col("x1") + F.col("x2")) / 2, "v": low})


def solved(d: DataFrame, terrain: Terrain, camera: Camera, solver: Solver | None = None, uncertain: bool = True) -> DataFrame:
    """(row_id, depression, reason, lat, lon, elevation_m, range_m, cep50_m, cep90_m, hit_rate, bias_m, lat_uncorrected,
    lon_uncorrected) of d(row_id, u, v, cam_lat, cam_lon, cam_alt, yaw, pitch, roll, and wind_speed, wind_from if there is wind).

    reason says why there is no place: grazing (depression below the gate, or none), out_of_dem, no_intersection or
    cep_too_large; the radii stay. The gate on depression is a column ahead of the kernel, so grazing rays skip it. A place
    is moved upwind by wind speed times drift; the uncorrected one is kept then. The terrain goes to every task: its size
    is that of one site's grid, and bigger areas are solved site by site.
    """
    solver = solver or Solver()
    ray = geo.rotate(geo.pixel_ray(F.col("u"), F.col("v"), camera.fx, camera.cx, camera.cy, camera.fy), F.col("yaw"), F.col("pitch"), F.col("roll"))
    x = d.withColumns({"_x": ray[0], "_y": ray[1], "_z": ray[2]})
    x = x.withColumn("depression", geo.depression((F.col("_x"), F.col("_y"), F.col("_z")))).drop("_x", "_y", "_z")
    fine = F.col("depression") >= solver.grazing
    ground = d.sparkSession.sparkContext.broadcast(terrain)
    places = x.where(fine).select("row_id", "u", "v", *_POSE).repartition(task_count(d.sparkSession), "row_id").mapInPandas(_kernel(ground, camera, solver, uncertain), _OUT)
    number = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c)
    places = places.select("row_id", "reason", *(number(c) for c in ("lat", "lon", "elevation_m", "range_m", "cep50_m", "cep90_m", "hit_rate", "bias_m")))
    extra = [c for c in ("wind_speed", "wind_from") if c in d.columns]
    out = x.select("row_id", "depression", *extra).join(places, "row_id", "left").withColumn("reason", F.when(fine, F.col("reason")).otherwise(GRAZING))
    if solver.drift_s <= 0 or len(extra) < 2:
        return out.drop(*extra).withColumns({"lat_uncorrected": F.lit(None).cast("double"), "lon_uncorrected": F.lit(None).cast("double")})
    return drifted(out, solver.drift_s).drop(*extra)


def drifted(fixes: DataFrame, seconds: float) -> DataFrame:
    """fixes with places moved upwind, and the places before where they were."""
    e, n, far = geo.wind_shift(F.col("wind_speed"), F.col("wind_from"), seconds)
    moved = F.coalesce(F.col("lat").isNotNull() & (far > 0), F.lit(False))
    x = geo.from_enu_at(fixes.withColumns({"lat_uncorrected": F.col("lat"), "lon_uncorrected": F.col("lon")}), F.coalesce(e, F.lit(0.0)), F.coalesce(n, F.lit(0.0)), "lat", "lon")
    keep = lambda a, b: F.when(moved, F.col(a)).otherwise(F.col(b))
    x = x.withColumns({"lat": keep("_lat", "lat_uncorrected"), "lon": keep("_lon", "lon_uncorrected")}).drop("_lat", "_lon")
    return x.withColumns({c: F.when(moved, F.col(c)) for c in ("lat_uncorrected", "lon_uncorrected")})


def projected(d: DataFrame, lat: str, lon: str, h: Column, camera: Camera) -> DataFrame:
    """d with pu, pv: the pixel of a ground point seen from cam_lat, cam_lon, cam_alt, yaw, pitch, roll; null behind the camera
    or outside the image. Steps of the way are columns of their own, so that none is written out many times."""
    e, n, u = geo.to_enu_at(F.col(lat), F.col(lon), h, F.col("cam_lat"), F.col("cam_lon"), F.col("cam_alt"))
    d = d.withColumns({"_e": e, "_n": n, "_u": u})
    x, y = geo.ray_pixel((F.col("_e"), F.col("_n"), F.col("_u")), F.col("yaw"), F.col("pitch"), F.col("roll"), camera.fx, camera.cx, camera.cy, camera.fy)
    d = d.withColumns({"_x": x, "_y": y})
    seen = (F.col("_x") >= 0) & (F.col("_x") < camera.width) & (F.col("_y") >= 0) & (F.col("_y") < camera.height)
    return d.withColumns({"pu": F.when(seen, F.col("_x")), "pv": F.when(seen, F.col("_y"))}).drop("_e", "_n", "_u", "_x", "_y")


#: Azimuths and depressions of the self tests, and the pixels of the round trip as shares of the image.
AZIMUTHS = [0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0]
SWEEP, TRIP, PIXELS = [5.0, 8.0, 10.0, 15.0, 20.0, 30.0, 45.0, 60.0, 90.0], [15.0, 25.0, 40.0, 60.0, 85.0], [(0.5, 0.5), (0.25, 0.7), (0.75, 0.35)]


def _standing(sites: DataFrame, terrain: Terrain, above: float) -> DataFrame:
    """sites(site, lat, lon) with cam_lat, cam_lon and cam_alt, so many metres above the ground there; sites off the grid go."""
    ground = sites.sparkSession.sparkContext.broadcast(terrain)

    def run(batches):
        for pdf in batches:
            z = ground.value.at(pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float))
            yield pdf.assign(cam_alt=z + above)[np.isfinite(z)]

    out = sites.select(F.col("site").cast("string").alias("site"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return out.mapInPandas(run, "site string, lat double, lon double, cam_alt double").withColumnsRenamed({"lat": "cam_lat", "lon": "cam_lon"})


def _fan(x: DataFrame, depressions: list[float]) -> DataFrame:
    grid = F.array(*(F.struct(F.lit(a).alias("yaw"), F.lit(p).alias("down")) for a in AZIMUTHS for p in depressions))
    return x.withColumn("_g", F.explode(grid)).select("*", "_g.yaw", "_g.down", (-F.col("_g.down")).alias("pitch"), F.lit(0.0).alias("roll")).drop("_g")


def swept(sites: DataFrame, terrain: Terrain, camera: Camera, noise: Noise, solver: Solver | None = None, above: float = 300.0) -> DataFrame:
    """(depression, n_attempted, n_solved, solve_rate, median_range_m, cep50_m, cep90_m, publish_rate) over every site and
    azimuth. The gates are off, since bad angles are what it shows; publish_rate counts what the last gate would let pass."""
    base = solver or Solver()
    open_ = replace(base, noise=noise, step_m=10.0, grazing=0.0, cep_max=math.inf)
    poses = _fan(_standing(sites, terrain, above), SWEEP).withColumns({"u": F.lit(camera.cx), "v": F.lit(camera.cy), "row_id": F.xxhash64("site", "yaw", "down")})
    poses = materialize(poses, "sweep-poses")
    x = poses.select("row_id", "down").join(solved(poses, terrain, camera, open_), "row_id")
    fine = F.col("reason").isNull() & F.col("cep90_m").isNotNull()
    x = materialize(x.select(F.col("down").alias("depression"), fine.alias("fine"), "range_m", "cep50_m", "cep90_m"), "sweep-fixes")
    share = lambda c: F.count_if(c) / F.count("*")
    out = x.groupBy("depression").agg(F.count("*").alias("n_attempted"), F.count_if("fine").alias("n_solved"), share(F.col("fine")).alias("solve_rate"), share(F.col("fine") & (F.col("cep90_m") <= base.cep_max)).alias("publish_rate"))
    for c, named in (("range_m", "median_range_m"), ("cep50_m", "cep50_m"), ("cep90_m", "cep90_m")):
        out = out.join(quantiles(x.where("fine"), ["depression"], c, {named: 0.5}, named), "depression", "left")
    return out.select("depression", "n_attempted", "n_solved", "solve_rate", "median_range_m", "cep50_m", "cep90_m", "publish_rate")


def round_trip(sites: DataFrame, terrain: Terrain, camera: Camera, above: float = 300.0) -> DataFrame:
    """(n_samples, median_m, p95_m, max_m, pixel_residual_px): pixels solved to the ground, projected back, solved again."""
    still = Solver(noise=PERFECT, step_m=5.0, cep_max=math.inf)
    pixels = F.array(*(F.struct(F.lit(a * camera.width).alias("u"), F.lit(b * camera.height).alias("v")) for a, b in PIXELS))
    poses = _fan(_standing(sites, terrain, above), TRIP).withColumn("_p", F.explode(pixels)).select("*", "_p.u", "_p.v").withColumn("row_id", F.xxhash64("site", "yaw", "down", "u"))
    poses = materialize(poses, "trip-poses")
    there = solved(poses, terrain, camera, still, uncertain=False).select("row_id", "lat", "lon", "elevation_m")
    there = materialize(poses.join(there, "row_id").where("lat IS NOT NULL"), "trip-there")
    seen = materialize(projected(there, "lat", "lon", F.col("elevation_m"), camera), "trip-seen").where("pu IS NOT NULL")
    back = solved(seen.select("row_id", F.col("pu").alias("u"), F.col("pv").alias("v"), *_POSE), terrain, camera, still, uncertain=False)
    x = seen.withColumn("residual", F.hypot(F.col("pu") - F.col("u"), F.col("pv") - F.col("v"))).select("row_id", "lat", "lon", "residual")
    x = materialize(x.join(back.select("row_id", F.col("lat").alias("blat"), F.col("lon").alias("blon")), "row_id"), "trip-back")
    e, n, _ = geo.to_enu_at(F.col("blat"), F.col("blon"), F.lit(0.0), F.col("lat"), F.col("lon"), F.lit(0.0))
    x = x.withColumn("error", F.hypot(e, n))
    x = materialize(x, "trip-errors")
    figures = x.agg(F.count("error").alias("n_samples"), F.max("error").alias("max_m"), F.max("residual").alias("pixel_residual_px")).withColumn("_one", F.lit(1))
    middle = quantiles(x, [], "error", {"median_m": 0.5, "p95_m": 0.95}, "trip").withColumn("_one", F.lit(1))
    return figures.join(F.broadcast(middle), "_one", "left").select("n_samples", "median_m", "p95_m", "max_m", "pixel_residual_px")


def cep_by_depression(fixes: DataFrame) -> DataFrame:
    """Median radii over solved rays, and the share published of all tried, by depression in steps of five degrees."""
    step = (F.floor(F.col("depression") / 5) * 5).cast("int")
    x = materialize(fixes.select(step.alias("depression"), "reason", "cep50_m", "cep90_m"), "radii")
    out = x.groupBy("depression").agg(F.count("*").alias("tried"), F.count("cep50_m").alias("solved"), (F.count_if(F.col("reason").isNull()) / F.count("*")).alias("publish_rate"))
    for c in ("cep50_m", "cep90_m"):
        out = out.join(quantiles(x.where("depression IS NOT NULL"), ["depression"], c, {c: 0.5}, c), "depression", "left")
    return out.select("depression", "tried", "solved", "cep50_m", "cep90_m", "publish_rate")
