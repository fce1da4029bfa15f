"""Quantiles and running sums of groups of any size against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.operators import ranges


def test_quantiles(spark):
    rng = random.Random(1)
    rows = [("a", 5.0)] * 3000 + [("a", float(rng.randrange(40))) for _ in range(1500)] + [("b", rng.uniform(0, 1)) for _ in range(700)] + [("c", 3.5), ("d", None), ("b", None), ("b", float("nan"))]
    d = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = {"low": 0.0, "mid": 0.5, "p95": 0.95, "high": 1.0}
    got = {r.k: [r[c] for c in probs] for r in ranges.quantiles(d, ["k"], "v", probs).collect()}
    own = {k: [v for g, v in rows if g == k and v is not None and v == v] for k in "abc"}
    assert got.keys() == own.keys()
    for k, v in own.items():
        assert got[k] == pytest.approx(np.quantile(v, list(probs.values())))
    every = ranges.quantiles(d, [], "v", probs).first()
    assert list(every) == pytest.approx(np.quantile(sum(own.values(), []), list(probs.values())))
    assert ranges.quantiles(d.limit(0), ["k"], "v", probs).collect() == ranges.quantiles(d.limit(0), [], "v", probs).collect() == []
    # groups by shuffle instead of broadcast
    assert {r.k: r.mid for r in ranges.quantiles(d, ["k"], "v", {"mid": 0.5}, most=0).collect()} == {k: v[1] for k, v in got.items()}


def test_running_sums_over_ranges(spark):
    rows = [(g, k, float(k % 7)) for g, n in ((1, 900), (2, 3), (3, 400)) for k in range(n)]
    d = spark.createDataFrame(rows, "g long, k long, v double").repartition(5)
    x = ranges.carried(ranges.parted(d, ["g"], ["k"], "t"), ["g"], ["k"], {"nth": F.lit(1), "sum": F.col("v")}, "t-spans")
    got = {(r.g, r.k): (r.nth, r.sum) for r in x.collect()}
    total = {}
    for g, k, v in rows:
        n, s = total.get(g, (0, 0.0))
        total[g] = (n + 1, s + v)
        assert got[g, k] == total[g]
    assert x.select("_part").distinct().count() > 2
