"""Terrain from GeoTIFF tiles as a data source: one partition a tile, rows of pixels, and a box that chooses the tiles.

    spark.dataSource.register(Tiles)
    spark.read.format("terrain").option("box", "128.3,36.0,129.1,36.8").load("/shared/dem")

A tile is north-up, in degrees, without rotation; others are refused. Samples are 16 or 32 bit integers or floats, in strips or
blocks, plain or deflated, with the horizontal predictor or none.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: i and j number pixels from 90 degrees north and 180 west, so tiles of one pixel size share them. z is null where there is no height.
SCHEMA = "tile string, i int, j int, lat double, lon double, z double"
#: Heights below this aren't heights.
LOWEST = -1000.0
#: Fixed values of the format: sizes of field types, and the tags that are read.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}
_KINDS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, LENGTHS, PREDICTOR, BLOCK_W, BLOCK_H, BLOCKS, BLOCK_LENGTHS, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
PIXEL, TIE, ROTATED, NODATA = 33550, 33922, 34264, 42113


@dataclass
class Tile(InputPartition):
    path: str
    box: tuple[float, float, float, float]


@dataclass(frozen=True)
class Header:
    end: str
    tags: dict
    west: float
    north: float
    cell: float

    def one(self, tag: int, default=None):
        return self.tags.get(tag, (default,))[0]

    def bounds(self) -> tuple[float, float, float, float]:
        return self.west, self.north - self.one(HEIGHT) * self.cell, self.west + self.one(WIDTH) * self.cell, self.north


def header(path: str) -> Header:
    """Size and place of a tile, from its tags alone."""
    with open(path, "rb") as f:
        end = {b"II": "<", b"MM": ">"}.get(f.read(2))
        if end is None or struct.unpack(f"{end}H", f.read(2))[0] != 42:
            raise ValueError(f"{path}: not a TIFF file")
        f.seek(struct.unpack(f"{end}I", f.read(4))[0])
        fields = f.read(12 * struct.unpack(f"{end}H", f.read(2))[0])
        tags = {}
        for k in range(0, len(fields), 12):
            tag, kind, n = struct.unpack(f"{end}HHI", fields[k : k + 8])
            size = _SIZES.get(kind, 0) * n
            if size > 4:
                f.seek(struct.unpack(f"{end}I", fields[k + 8 : k + 12])[0])
                raw = f.read(size)
            else:
                raw = fields[k + 8 : k + 8 + size]
            if kind == 2:
                tags[tag] = (raw.split(b"\0")[0].decode("ascii", "replace"),)
            elif kind in _KINDS:
                tags[tag] = struct.unpack(f"{end}{n}{_KINDS[kind]}", raw)
    if ROTATED in tags or PIXEL not in tags or TIE not in tags:
        raise ValueError(f"{path}: not a north-up grid in degrees")
    (dx, dy), tie = tags[PIXEL][:2], tags[TIE]
    if dx <= 0 or abs(dx - dy) > 1e-9 * dx:
        raise ValueError(f"{path}: pixels aren't squares in degrees")
    return Header(end, tags, tie[3] - tie[0] * dx, tie[4] + tie[1] * dy, dx)


def heights(path: str) -> tuple[Header, np.ndarray]:
    """A tile's heights, NaN where there are none."""
    h = header(path)
    width, height, bits = h.one(WIDTH), h.one(HEIGHT), h.one(BITS, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(h.one(FORMAT, 1))
    packing, predictor = h.one(COMPRESSION, 1), h.one(PREDICTOR, 1)
    if kind is None or bits not in (16, 32) or h.one(SAMPLES, 1) != 1 or packing not in (1, 8, 32946) or predictor not in (1, 2) or (predictor == 2 and kind == "f"):
        raise ValueError(f"{path}: samples are packed in a way that isn't read")
    dtype = np.dtype(f"{h.end}{kind}{bits // 8}")
    blocks = BLOCKS in h.tags
    w, rows = (h.one(BLOCK_W), h.one(BLOCK_H)) if blocks else (width, min(h.one(ROWS, height), height))
    z, across = np.empty((height, width)), -(-width // w)
    with open(path, "rb") as f:
        for k, (at, size) in enumerate(zip(h.tags[BLOCKS if blocks else STRIPS], h.tags[BLOCK_LENGTHS if blocks else LENGTHS], strict=True)):
            f.seek(at)
            raw = f.read(size)
            part = np.frombuffer(raw if packing == 1 else zlib.decompress(raw), dtype)
            part = part.reshape(-1, w)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=dtype.newbyteorder("="))
            top, left = k // across * rows, k % across * w
            own = z[top : top + rows, left : left + w]
            own[:] = part[: own.shape[0], : own.shape[1]]
    none = h.one(NODATA)
    if none not in (None, "") and none.strip().lower() != "nan":
        z[z == float(none)] = np.nan
    z[~(z >= LOWEST)] = np.nan
    return h, z


class Tiles(DataSource):
    """options: path, a folder below which all .tif and .tiff files are tiles, or one file; box, the west, south, east and north of
    what is wanted; filters, true to narrow the box by a query's comparisons of lat and lon."""

    @classmethod
    def name(cls) -> str:
        return "terrain"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        box = self.options.get("box")
        kind = FilteringReader if self.options.get("filters") == "true" else TileReader
        return kind(self.options["path"], tuple(float(v) for v in box.split(",")) if box else (-180.0, -90.0, 180.0, 90.0))


class TileReader(DataSourceReader):
    def __init__(self, path: str, box: tuple[float, float, float, float]):
        self.path, self.box = path.removeprefix("file://"), box

    def partitions(self) -> list[Tile]:
        """Only headers are read here, and tiles outside the box get no task."""
        found = [self.path] if os.path.isfile(self.path) else sorted(p for end in ("tif", "tiff", "TIF", "TIFF") for p in glob.glob(f"{self.path}/**/*.{end}", recursive=True))
        if not found:
            raise FileNotFoundError(f"no terrain below {self.path}")
        w, s, e, n = self.box
        met = [p for p in found if (b := header(p).bounds())[0] <= e and b[2] >= w and b[1] <= n and b[3] >= s]
        return [Tile(p, self.box) for p in met]

    def read(self, partition: Tile) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        h, z = heights(partition.path)
        w, s, e, n = partition.box
        top, left = round((90 - h.north) / h.cell), round((h.west + 180) / h.cell)
        lat, lon = h.north - (np.arange(z.shape[0]) + 0.5) * h.cell, h.west + (np.arange(z.shape[1]) + 0.5) * h.cell
        columns = np.flatnonzero((lon >= w) & (lon <= e))
        name = os.path.basename(partition.path)
        for i in np.flatnonzero((lat >= s) & (lat <= n)):
            k = len(columns)
            if k:
                own = [pa.array([name] * k), pa.array(np.full(k, top + i, np.int32)), pa.array((left + columns).astype(np.int32)), pa.array(np.full(k, lat[i])), pa.array(lon[columns]), pa.array(z[i, columns], from_pandas=True)]
                yield pa.RecordBatch.from_arrays(own, ["tile", "i", "j", "lat", "lon", "z"])


class FilteringReader(TileReader):
    """Takes the box from comparisons as well. Spark asks for filters only where spark.sql.python.filterPushdown.enabled is true."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of lat and lon narrow the box; Spark still tests every row."""
        w, s, e, n = self.box
        for f in filters:
            column, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if column in ("lat", "lon") and isinstance(value, float):
                low, high = isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)), isinstance(f, (LessThan, LessThanOrEqual, EqualTo))
                if column == "lon":
                    w, e = max(w, value) if low else w, min(e, value) if high else e
                else:
                    s, n = max(s, value) if low else s, min(n, value) if high else n
            yield f
        self.box = (w, s, e, n)
