"""WGS84, camera rays, wind and the forecast grid as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84.
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
B = A * (1 - FLAT)
EP2 = (A * A - B * B) / (B * B)
#: The forecast grid (Lambert conformal conic, km and degrees).
RE, GRID, SLAT1, SLAT2, OLON, OLAT, XO, YO = 6371.00877, 5.0, 30.0, 60.0, 126.0, 38.0, 43, 136


def ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + h) * F.cos(p) * F.cos(q), (n + h) * F.cos(p) * F.sin(q), (n * (1 - E2) + h) * F.sin(p)


def geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and height by the closed form."""
    r = F.hypot(x, y)
    t = F.atan2(z * A, r * B)
    lat = F.atan2(z + EP2 * B * F.pow(F.sin(t), 3), r - E2 * A * F.pow(F.cos(t), 3))
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), r / F.cos(lat) - n


def to_enu(lat: Column, lon: Column, h: Column, lat0: float, lon0: float, h0: float) -> tuple[Column, Column, Column]:
    """East, north, up in metres from an origin."""
    x0, y0, z0 = _origin(lat0, lon0, h0)
    x, y, z = ecef(lat, lon, h)
    dx, dy, dz = x - x0, y - y0, z - z0
    s, c, u, v = math.sin(math.radians(lat0)), math.cos(math.radians(lat0)), math.sin(math.radians(lon0)), math.cos(math.radians(lon0))
    return -u * dx + v * dy, -s * v * dx - s * u * dy + c * dz, c * v * dx + c * u * dy + s * dz


def enu_to_ecef(e: Column, n: Column, up: Column, lat0: float, lon0: float, h0: float) -> tuple[Column, Column, Column]:
    x0, y0, z0 = _origin(lat0, lon0, h0)
    s, c, u, v = math.sin(math.radians(lat0)), math.cos(math.radians(lat0)), math.sin(math.radians(lon0)), math.cos(math.radians(lon0))
    return x0 - u * e - s * v * n + c * v * up, y0 + v * e - s * u * n + c * u * up, z0 + c * n + s * up


def from_enu(d: DataFrame, e: Column, n: Column, up: Column, lat0: float, lon0: float, h0: float) -> DataFrame:
    """d with lat and lon of a point in east, north, up. Earth-centred coordinates are columns of their own on the way, so
    that the closed form doesn't repeat them."""
    x, y, z = enu_to_ecef(e, n, up, lat0, lon0, h0)
    d = d.withColumns({"_x": x, "_y": y, "_z": z})
    lat, lon, _ = geodetic(F.col("_x"), F.col("_y"), F.col("_z"))
    return d.withColumns({"lat": lat, "lon": lon}).drop("_x", "_y", "_z")


def to_enu_at(lat: Column, lon: Column, h: Column, lat0: Column, lon0: Column, h0: Column) -> tuple[Column, Column, Column]:
    """East, north, up in metres from an origin that each row has of its own."""
    x, y, z = (a - b for a, b in zip(ecef(lat, lon, h), ecef(lat0, lon0, h0), strict=True))
    p, q = F.radians(lat0), F.radians(lon0)
    s, c, u, v = F.sin(p), F.cos(p), F.sin(q), F.cos(q)
    return -u * x + v * y, -s * v * x - s * u * y + c * z, c * v * x + c * u * y + s * z


def from_enu_at(d: DataFrame, e: Column, n: Column, lat0: str, lon0: str) -> DataFrame:
    """d with _lat and _lon of the point east and north of each row's own place on the ellipsoid."""
    p, q = F.radians(lat0), F.radians(lon0)
    s, c, u, v = F.sin(p), F.cos(p), F.sin(q), F.cos(q)
    x0, y0, z0 = ecef(F.col(lat0), F.col(lon0), F.lit(0.0))
    d = d.withColumns({"_x": x0 - u * e - s * v * n, "_y": y0 + v * e - s * u * n, "_z": z0 + c * n})
    lat, lon, _ = geodetic(F.col("_x"), F.col("_y"), F.col("_z"))
    return d.withColumns({"_lat": lat, "_lon": lon}).drop("_x", "_y", "_z")


def _origin(lat: float, lon: float, h: float) -> tuple[float, float, float]:
    p, q = math.radians(lat), math.radians(lon)
    n = A / math.sqrt(1 - E2 * math.sin(p) ** 2)
    return (n + h) * math.cos(p) * math.cos(q), (n + h) * math.cos(p) * math.sin(q), (n * (1 - E2) + h) * math.sin(p)


def focal(width: float, hfov: float) -> float:
    return width / 2 / math.tan(math.radians(hfov) / 2)


def focal_of(width: Column, hfov: Column) -> Column:
    return width / 2 / F.tan(F.radians(hfov) / 2)


def focal_of_sensor(focal_mm: Column, width: Column, sensor_mm: Column) -> Column:
    return focal_mm * width / sensor_mm


def fov_of(f: Column, width: Column) -> Column:
    """Degrees that an image of that width sees at a focal length in pixels."""
    return F.degrees(2 * F.atan(width / (2 * f)))


def pixel_ray(u: Column, v: Column, f: float, cx: float, cy: float, fy: float | None = None) -> tuple[Column, Column, Column]:
    """Unit ray in camera axes: right, down, forward."""
    x, y = (u - cx) / f, (v - cy) / (f if fy is None else fy)
    n = F.sqrt(x * x + y * y + 1)
    return x / n, y / n, 1 / n


def distort(x: Column, y: Column, k1: float, k2: float, p1: float, p2: float, k3: float) -> tuple[Column, Column]:
    """Normalised camera coordinates through a lens: radial k1, k2, k3 and tangential p1, p2."""
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def undistort(x: Column, y: Column, k1: float, k2: float, p1: float, p2: float, k3: float, rounds: int = 40) -> Column:
    """struct(x, y) whose distortion is (x, y), by fixed point; the start is the distorted point. The rounds run over whole
    Arrow batches, by the operations of distort() in their order; a null among the values gives nulls."""

    @F.pandas_udf("x double, y double")
    def straight(x: pd.Series, y: pd.Series, k1: pd.Series, k2: pd.Series, p1: pd.Series, p2: pd.Series, k3: pd.Series) -> pd.DataFrame:
        x, y, *lens = (s.to_numpy(float, na_value=np.nan) for s in (x, y, k1, k2, p1, p2, k3))
        u, v = x, y
        with np.errstate(all="ignore"):
            for _ in range(rounds):
                a, b = distort(u, v, *lens)
                u, v = u + x - a, v + y - b
        return pd.DataFrame({"x": u, "y": v})

    values = [v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y, k1, k2, p1, p2, k3)]
    whole = F.coalesce(*(F.when(v.isNull(), True) for v in values)).isNull()
    at = straight(*(v.cast("double") for v in values))
    # Arrow takes NaN, where the rounds run off, for null
    return F.struct(*(F.when(whole, F.coalesce(at[c], F.lit(math.nan))).alias(c) for c in ("x", "y")))


def axes(yaw: Column, pitch: Column, roll: Column) -> tuple[list[Column], list[Column], list[Column]]:
    """Right, down and forward of a camera in east, north, up; yaw from north clockwise, pitch up, roll about the forward axis."""
    y, p, r = F.radians(yaw), F.radians(pitch), F.radians(roll)
    forward = [F.sin(y) * F.cos(p), F.cos(y) * F.cos(p), F.sin(p)]
    right0 = F.cos(y), -F.sin(y), F.lit(0.0)
    down0 = F.sin(y) * F.sin(p), F.cos(y) * F.sin(p), -F.cos(p)
    right = [F.cos(r) * a + F.sin(r) * b for a, b in zip(right0, down0, strict=True)]
    down = [F.cos(r) * b - F.sin(r) * a for a, b in zip(right0, down0, strict=True)]
    return right, down, forward


def rotate(ray: tuple[Column, Column, Column], yaw: Column, pitch: Column, roll: Column) -> tuple[Column, Column, Column]:
    """A camera ray in east, north, up."""
    right, down, forward = axes(yaw, pitch, roll)
    return tuple(ray[0] * right[k] + ray[1] * down[k] + ray[2] * forward[k] for k in range(3))


def ray_pixel(ray: tuple[Column, Column, Column], yaw: Column, pitch: Column, roll: Column, f: float, cx: float, cy: float, fy: float | None = None) -> tuple[Column, Column]:
    """Pixel of a ray in east, north, up; null where it points behind the camera."""
    x, y, z = (sum((ray[k] * axis[k] for k in range(3)), F.lit(0.0)) for axis in axes(yaw, pitch, roll))
    return F.when(z > 0, f * x / z + cx), F.when(z > 0, (fy or f) * y / z + cy)


def depression(ray: tuple[Column, Column, Column]) -> Column:
    """Degrees below the horizon."""
    n = F.sqrt(ray[0] * ray[0] + ray[1] * ray[1] + ray[2] * ray[2])
    return F.degrees(F.asin(F.least(F.greatest(-ray[2] / n, F.lit(-1.0)), F.lit(1.0))))


def wind_shift(speed: Column, from_deg: Column, drift: float) -> tuple[Column, Column, Column]:
    """(east, north, distance) of the correction: upwind by speed times drift seconds, nothing without wind or drift."""
    far = F.when((speed > 0) & (F.lit(drift) > 0), speed * drift).otherwise(0.0)
    toward = F.radians(from_deg + 180)
    return -far * F.sin(toward), -far * F.cos(toward), far


def forecast_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Grid cell numbers; adding one half and cutting, as int() does."""
    re, s1, s2, lon0, lat0 = RE / GRID, *map(math.radians, (SLAT1, SLAT2, OLON, OLAT))
    t = lambda x: math.tan(math.pi / 4 + x / 2)
    sn = math.log(math.cos(s1) / math.cos(s2)) / math.log(t(s2) / t(s1))
    sf = t(s1) ** sn * math.cos(s1) / sn
    ro = re * sf / t(lat0) ** sn
    ra = re * sf / F.pow(F.tan(math.pi / 4 + F.radians(lat) / 2), F.lit(sn))
    turn = F.radians(lon) - lon0
    turn = F.when(turn > math.pi, turn - 2 * math.pi).when(turn < -math.pi, turn + 2 * math.pi).otherwise(turn) * sn
    return (ra * F.sin(turn) + XO + 0.5).cast("int"), (ro - ra * F.cos(turn) + YO + 0.5).cast("int")


def forecast_base(utc: Column) -> Column:
    """Base date and hour, Korean time, of a time without zone in UTC; the session's zone plays no part. Before minute 40
    the hour before."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), utc.cast("timestamp_ntz"))
    return F.date_format(F.when(F.minute(local) < 40, local - F.expr("INTERVAL 1 HOUR")).otherwise(local), "yyyyMMdd HH00")


def tiles_of_box(south: Column, west: Column, north: Column, east: Column) -> Column:
    """Array of (south, west) corners of the one-degree tiles that a box touches."""
    rows, columns = F.sequence(F.floor(south), F.floor(north)), F.sequence(F.floor(west), F.floor(east))
    return F.flatten(F.transform(rows, lambda s: F.transform(columns, lambda w: F.struct(s.alias("south"), w.alias("west")))))


def tile_name(south: Column, west: Column) -> Column:
    """File name of the one-degree elevation tile with this south-west corner; the format is fixed by the public data set."""
    ns, ew = F.when(south >= 0, "N").otherwise("S"), F.when(west >= 0, "E").otherwise("W")
    return F.format_string("Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM", ns, F.abs(south), ew, F.abs(west))


def tile_url(south: Column, west: Column, base: str) -> Column:
    """Address of a terrain tile below base: each lies in a folder of its own name."""
    name = tile_name(south, west)
    return F.concat(F.lit(base.rstrip("/") + "/"), name, F.lit("/"), name, F.lit(".tif"))
