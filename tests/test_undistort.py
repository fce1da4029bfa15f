"""Lenses taken out of points in Arrow batches."""

import pytest
from pyspark.sql import functions as F

from hazeline.functions import geodesy as geo

LENS = (-0.28, 0.07, 0.001, 0.0005, -0.01)


def plain(x, y, lens, rounds=40):
    u, v = x, y
    for _ in range(rounds):
        a, b = geo.distort(u, v, *lens)
        u, v = u + x - a, v + y - b
    return u, v


def test_same_as_forty_rounds_of_a_row(spark):
    points = [(x / 7 - 0.6, y / 9 - 0.4) for x in range(9) for y in range(8)]
    d = spark.createDataFrame([(*p, [v * k / 2 for v in LENS]) for k, p in enumerate(points) if k < 3 or k % 5 == 0], "x double, y double, lens array<double>")
    by_row = d.withColumn("p", geo.undistort(F.col("x"), F.col("y"), *(F.get("lens", F.lit(k)) for k in range(5)), rounds=12)).collect()
    assert all((r.p.x, r.p.y) == pytest.approx(plain(r.x, r.y, r.lens, 12), rel=1e-12, nan_ok=True) for r in by_row)
    fixed = d.withColumn("p", geo.undistort(F.col("x"), F.col("y"), *LENS))
    assert all((r.p.x, r.p.y) == pytest.approx(plain(r.x, r.y, LENS), rel=1e-12) for r in fixed.collect())
    assert "ArrowEvalPython" in fixed._jdf.queryExecution().executedPlan().toString()


def test_nulls(spark):
    d = spark.createDataFrame([(0.1, None, LENS), (0.1, 0.2, None), (0.1, 0.2, LENS)], "x double, y double, lens array<double>")
    got = d.withColumn("p", geo.undistort(F.col("x"), F.col("y"), *(F.get("lens", F.lit(k)) for k in range(5)))).collect()
    assert [r.p.x is None for r in got] == [True, True, False] and got[1].p.y is None
