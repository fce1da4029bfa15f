"""Covers, layout by cells, radius search, and binary points."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.functions import cells
from hazeline.operators import store


def plain_cell(lat, lon, bits=cells.BITS):
    x = min(max(int((lon + 180) % 360 / 360 * 2**bits), 0), 2**bits - 1)
    y = min(max(int((lat + 90) / 180 * 2**bits), 0), 2**bits - 1)
    return sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(bits))


PLACES = [(36.4, 128.7, 15_000.0), (-31.95, 115.86, 300.0), (0.001, 179.999, 40_000.0), (-17.0, -179.99, 90_000.0), (89.5, 10.0, 100_000.0), (60.0, 0.0, 1.0), (10.0, 20.0, 3_000_000.0)]


def test_cells_are_those_of_the_plain_version(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (None, 1.0)]
    got = spark.createDataFrame(rows, "lat double, lon double").withColumn("c", cells.cell(F.col("lat"), F.col("lon"))).collect()
    assert all(r.c == (None if r.lat is None else plain_cell(r.lat, r.lon)) for r in got)


@pytest.mark.parametrize("lat, lon, metres", PLACES)
def test_cover_misses_nothing(lat, lon, metres):
    ranges = cells.cover(lat, lon, metres)
    assert len(ranges) <= 64 and all(a <= b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))
    rng = random.Random(2)
    for _ in range(2000):
        far, way = metres * math.sqrt(rng.random()), rng.uniform(0, 2 * math.pi)
        p, q, d = math.radians(lat), math.radians(lon), far / 6_371_000 * 0.98
        y = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(way))
        x = q + math.atan2(math.sin(way) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(y))
        c = plain_cell(math.degrees(y), math.degrees(x))
        assert any(a <= c <= b for a, b in ranges)
    # the cover is not much larger than the circle's box
    if metres < 100_000 and abs(lat) < 80:
        area = sum(b - a + 1 for a, b in ranges)
        box = sum((t - s) / 180 * (e - w) / 360 for s, t, w, e in cells.boxes(lat, lon, metres)) * 4**cells.BITS
        assert area < 3 * box + 16


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_search_reads_covering_files_only(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-60, 60, 3000), rng.uniform(-180, 180, 3000), strict=True))]
    rows += [(5000 + k, 36.4 + float(a), 128.7 + float(b)) for k, (a, b) in enumerate(rng.uniform(-0.5, 0.5, (3000, 2)))]
    rows += [(9000 + k, -17.0 + float(a), (179.95 + float(b) + 180) % 360 - 180) for k, (a, b) in enumerate(rng.uniform(-0.4, 0.4, (500, 2)))] + [(99_999, None, None)]
    d = spark.createDataFrame(rows, "id long, lat double, lon double")
    path = str(tmp_path / "cells")
    cells.write(d, path, coarse=6)
    table = cells.read(spark, path, coarse=6)
    assert table.count() == len(rows)
    every = files_read(spark.read.parquet(path))
    for lat, lon, metres in PLACES[:4]:
        found = cells.within(table, lat, lon, metres)
        e = d.withColumn("lon", F.when(F.lit(lon) - F.col("lon") > 180, F.col("lon") + 360).when(F.col("lon") - F.lit(lon) > 180, F.col("lon") - 360).otherwise(F.col("lon")))
        scan = {r.id: r.metres for r in store.within(e, lat, lon, metres).collect()}
        assert {r.id: pytest.approx(r.metres) for r in found.collect()} == scan
        assert files_read(found) <= 6 < every / 20
    assert len({r.id for r in cells.within(table, 36.4, 128.7, 15_000.0).collect()}) > 50


def test_store_finds_by_cell(spark, tmp_path):
    s = store.EventStore(spark, f"file://{tmp_path}/events")
    rows = [(k, 36.4 + k / 1000, 128.7 + k / 500, "a", float(k)) for k in range(60)] + [(99, None, None, "a", 1.0)]
    for part in (rows[:30], rows[30:]):
        s.add(store.migrated(spark.createDataFrame(part, "track_id long, lat double, lon double, site string, timestamp double")))
    want = {r.id for r in store.within(s.events(), 36.41, 128.72, 1500.0).collect()}
    assert {r.id for r in s.near(36.41, 128.72, 1500.0).collect()} == want and len(want) > 5
    before = sorted(map(str, s.events().collect()))
    s.compact()
    assert sorted(map(str, s.events().collect())) == before
    assert {r.id for r in s.near(36.41, 128.72, 1500.0).collect()} == want
    s.add(store.migrated(spark.createDataFrame([(500, 36.41, 128.72, "a", 5.0)], "track_id long, lat double, lon double, site string, timestamp double")))
    s.compact()
    assert s.events().count() == 62 and len(s.near(36.41, 128.72, 1500.0).collect()) == len(want) + 1 and len({r.id for r in s.events().collect()}) == 62


def ewkb(lat, lon, little=True, srid=4326):
    end = "<" if little else ">"
    head = struct.pack(f"{end}BI", little, 1 | 0x20000000) + struct.pack(f"{end}I", srid) if srid else struct.pack(f"{end}BI", little, 1)
    return head + struct.pack(f"{end}dd", lon, lat)


def test_binary_points(spark):
    rng = random.Random(6)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(0.0, -0.5), (1e-300, 2.0**-1074), (90.0, -180.0), (1.0, 0.9999999999999999), (8.0, 7.999999999999999), (2.0**-1022, -(2.0**-1030))]
    rows = [(k, a, b, bytearray(ewkb(a, b, k % 2 == 0, 4326 if k % 3 else None)), k % 2 == 0, bool(k % 3)) for k, (a, b) in enumerate(places)]
    d = spark.createDataFrame(rows, "k int, lat double, lon double, point binary, little boolean, srid boolean")
    got = {r.k: (r.a, r.b, r.s) for r in d.select("k", *(c.alias(n) for n, c in zip("sab", cells.from_ewkb(F.col("point")).values()))).collect()}
    assert got == {k: (a, b, 4326 if k % 3 else None) for k, (a, b) in enumerate(places)}
    for little in (True, False):
        for srid in (4326, None):
            own = d.where(f"little = {little} AND srid = {srid is not None}")
            made = own.select("point", cells.to_ewkb(F.col("lat"), F.col("lon"), little, srid).alias("own")).collect()
            assert made and all(bytes(r.point) == bytes(r.own) for r in made)
    good = ewkb(1.0, 2.0)
    broken = [None, b"", b"\x01", good[:-1], good + b"\x00", b"\x02" + good[1:], good[:1] + b"\x02" + good[2:], ewkb(1.0, 2.0, srid=None)[:-8], ewkb(float("nan"), 1.0), ewkb(1.0, float("inf"))]
    d = spark.createDataFrame([(None if b is None else bytearray(b),) for b in broken], "point binary")
    assert all((r.lat, r.lon) == (None, None) for r in d.select(*(c.alias(n) for n, c in cells.from_ewkb(F.col("point")).items())).collect())
