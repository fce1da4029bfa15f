"""Places as cells of a space-filling curve, and as the binary points of spatial databases.

A cell's number interleaves the bits of longitude and latitude, so the points of a square share a range of numbers. A circle is
covered by ranges: squares are halved until they lie within its box or the number of ranges is reached. Tables written by cell
are read by range: folders of coarse cells that no range meets aren't listed, and row groups are passed over by their bounds.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.functions import geodesy

#: Bits of each axis: 360 / 2**20 degrees are 38 m.
BITS = 20


def _spread(v: Column) -> Column:
    """A zero between each two bits of a number below 2**32."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v.bitwiseOR(F.shiftleft(v, shift))).bitwiseAND(F.lit(mask))
    return v


def _steps(degrees: Column, low: float, whole: float, bits: int) -> Column:
    return F.least(F.greatest(F.floor((degrees - low) / whole * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")


def cell(lat: Column, lon: Column, bits: int = BITS) -> Column:
    """The cell of a place; null without one."""
    wrapped = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    number = _spread(_steps(wrapped, -180.0, 360.0, bits)).bitwiseOR(F.shiftleft(_spread(_steps(lat, -90.0, 180.0, bits)), 1))
    return F.when(lat.between(-90, 90) & lon.isNotNull() & ~F.isnan(lon), number)


def boxes(lat: float, lon: float, metres: float) -> list[tuple[float, float, float, float]]:
    """(south, north, west, east) of one or two boxes that hold the circle; two where it crosses 180 degrees."""
    dlat = math.degrees(metres / 6_335_000)
    south, north = max(lat - dlat, -90.0), min(lat + dlat, 90.0)
    flat = math.cos(math.radians(max(abs(south), abs(north))))
    dlon = math.degrees(metres / (6_378_000 * flat)) if flat > 1e-9 else 180.0
    if dlon >= 180 or north >= 90 or south <= -90:
        return [(south, north, -180.0, 180.0)]
    west, east = lon - dlon, lon + dlon
    if west < -180:
        return [(south, north, -180.0, east), (south, north, west + 360, 180.0)]
    if east > 180:
        return [(south, north, west, 180.0), (south, north, -180.0, east - 360)]
    return [(south, north, west, east)]


def cover(lat: float, lon: float, metres: float, bits: int = BITS, most: int = 64) -> list[tuple[int, int]]:
    """At most `most` ranges of cells, ends included, that hold every place within the distance. The largest square that isn't
    within the boxes is halved first, so ranges are spent where they save most. It takes a number of steps, not of rows."""
    around, n = boxes(lat, lon, metres), 1 << bits
    edges = [[math.floor((v - low) / whole * n) for v, low, whole in ((s, -90, 180), (t, -90, 180), (w, -180, 360), (e, -180, 360))] for s, t, w, e in around]

    def meets(x: int, y: int, side: int) -> bool | None:
        """None: within a box. False: outside all of them."""
        out = False
        for s, t, w, e in edges:
            if x >= w and x + side - 1 <= e and y >= s and y + side - 1 <= t:
                return None
            out |= x <= e and x + side > w and y <= t and y + side > s
        return out

    open_, done = [(-n, 0, 0, 0)], []
    while open_ and len(open_) + len(done) + 3 <= most:
        side, first, x, y = heapq.heappop(open_)
        half = -side // 2
        if half == 0:
            done.append((first, first))
            continue
        for k in range(4):
            dx, dy = x + half * (k & 1), y + half * (k >> 1)
            at = first + k * half * half
            inside = meets(dx, dy, half)
            if inside is None:
                done.append((at, at + half * half - 1))
            elif inside:
                heapq.heappush(open_, (-half, at, dx, dy))
    done += [(first, first + side * side - 1) for side, first, _, _ in open_]
    out: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if out and out[-1][1] + 1 >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def write(places: DataFrame, path: str, coarse: int = 10, mode: str = "append") -> None:
    """places(lat, lon, ...) in order of their cells, in a folder for each coarse cell (2 * coarse bits). Rows without a place
    are in one of their own. A cell that holds many rows is cut by the ranges' second column."""
    x = places.withColumn("cell", cell(F.col("lat"), F.col("lon")))
    x = x.withColumn("coarse", F.shiftright("cell", 2 * (BITS - coarse)))
    own = F.xxhash64(*(c for c in places.columns if not dict(places.dtypes)[c].startswith("map")))
    x = x.withColumn("_own", own).repartitionByRange("cell", "_own").sortWithinPartitions("cell").drop("_own")
    x.write.mode(mode).partitionBy("coarse").parquet(path)


def within(located: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Rows of a table with cell within a distance on the plane at (lat, lon), with metres. Ranges of cells come first, as plain
    comparisons that a scan prunes by; where there is a column coarse, its folders are chosen by them too."""
    ranges = cover(lat, lon, metres)
    x = located.where(reduce(Column.__or__, (F.col("cell").between(a, b) for a, b in ranges)))
    if "coarse" in located.columns:
        shift = 2 * BITS - _coarse_bits(located)
        x = x.where(F.col("coarse").isin(sorted({c for a, b in ranges for c in range(a >> shift, (b >> shift) + 1)})) if (ranges[-1][1] >> shift) - (ranges[0][0] >> shift) < 10_000 else reduce(Column.__or__, (F.col("coarse").between(a >> shift, b >> shift) for a, b in ranges)))
    e, n, up = geodesy.to_enu(F.col("lat"), F.col("lon"), F.lit(0.0), lat, lon, 0.0)
    return x.withColumns({"metres": F.hypot(e, n), "_up": up}).where((F.col("metres") <= metres) & (F.col("_up") > -6_378_137.0)).drop("_up")


def _coarse_bits(located: DataFrame) -> int:
    return int(located.schema["coarse"].metadata.get("bits", 20))


def read(spark: SparkSession, path: str, coarse: int = 10) -> DataFrame:
    x = spark.read.parquet(path)
    return x.withColumn("coarse", F.col("coarse").cast("long").alias("coarse", metadata={"bits": 2 * coarse}))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bits_of(x: Column) -> Column:
    """The 64 bits of a double as 16 hexadecimal digits. Scaling by powers of two is exact."""
    word = lambda v: F.lpad(F.hex(v), 8, "0")
    two = lambda p: F.pow(F.lit(2.0), p)

    def packed(size: Column, low: Column) -> Column:
        def whole(mantissa: Column) -> Column:
            return F.when(mantissa >= F.lit(1 << 52), F.shiftleft((low + 1023).cast("long"), 52) + mantissa - F.lit(1 << 52)).otherwise(mantissa)

        return _let((size / two(low) * F.lit(2.0**52)).cast("long"), whole)

    def of(size: Column) -> Column:
        near = F.floor(F.log2(F.greatest(size, F.lit(2.0**-1074)))).cast("int")
        exact = _let(near, lambda p: F.when(two(p) > size, p - 1).when(two(p + 1) <= size, p + 1).otherwise(p))
        return _let(F.greatest(exact, F.lit(-1022)), lambda low: packed(size, low))

    sign = F.when(x < 0, F.lit(1 << 31)).otherwise(F.lit(0).cast("long"))
    return _let(_let(F.abs(x), of), lambda w: F.concat(word(F.shiftright(w, 32) + sign), word(w.bitwiseAND(F.lit(0xFFFFFFFF)))))


def _turned(digits: Column, size: int) -> Column:
    """Bytes of a hexadecimal text in reverse."""
    return F.concat(*(F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)))


def _double(digits: Column) -> Column:
    """The double of 16 hexadecimal digits; null for NaN and infinities, which no place has."""
    word = lambda d, a: F.conv(F.substring(d, a, 8), 16, 10).cast("long")

    def of(high: Column, low: Column) -> Column:
        mantissa = F.shiftleft(high.bitwiseAND(F.lit((1 << 20) - 1)), 32) + low

        def size(power: Column) -> Column:
            x = F.when(power == 0, mantissa * F.lit(2.0**-1074)).otherwise((1 + mantissa / F.lit(2.0**52)) * F.pow(F.lit(2.0), power - 1023))
            return F.when(power < 2047, F.when(high >= F.lit(1 << 31), -x).otherwise(x))

        return _let(F.shiftright(high, 20).bitwiseAND(F.lit(2047)), size)

    return _let(digits, lambda d: _let(word(d, 1), lambda high: _let(word(d, 9), lambda low: of(high, low))))


#: Kind of a point, the flag that an SRID follows, and the SRID of WGS84.
POINT, HAS_SRID, WGS84 = 1, 0x20000000, 4326


def to_ewkb(lat: Column, lon: Column, little: bool = True, srid: int | None = WGS84) -> Column:
    """A point as EWKB, null without a place: byte order, kind and flags, SRID, longitude, latitude."""
    order = lambda digits, size: _turned(digits, size) if little else digits
    word = lambda v: order(F.lit(f"{v:08X}"), 4)
    head = [word(POINT | HAS_SRID), word(srid)] if srid is not None else [word(POINT)]
    return F.unhex(F.concat(F.lit("01" if little else "00"), *head, *(order(_bits_of(v), 8) for v in (lon, lat))))


def from_ewkb(point: Column) -> dict[str, Column]:
    """srid (null where none is given), lat and lon of a binary point in either byte order. Null for null, for what isn't a
    two-dimensional point, and for bytes that are too few or too many."""
    digits = F.hex(point)
    little = F.substring(digits, 1, 2) == "01"
    at = lambda first, size: F.when(little, _turned(F.substring(digits, 2 * first + 1, 2 * size), size)).otherwise(F.substring(digits, 2 * first + 1, 2 * size))
    kind = F.conv(at(1, 4), 16, 10).cast("long")
    flagged = kind == F.lit(POINT | HAS_SRID)
    ok = F.substring(digits, 1, 2).isin("00", "01") & ((flagged & (F.length(digits) == 50)) | ((kind == F.lit(POINT)) & (F.length(digits) == 42)))
    x, y = (F.when(ok, _double(F.when(flagged, at(9 + k, 8)).otherwise(at(5 + k, 8)))) for k in (0, 8))
    there = x.isNotNull() & y.isNotNull()
    return {"srid": F.when(ok & flagged, F.conv(at(5, 4), 16, 10).cast("int")), "lat": F.when(there, y), "lon": F.when(there, x)}
