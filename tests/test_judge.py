"""The stream of verdicts and events against the batch, and the size of its state."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.functions import rules
from hazeline.operators import store
from hazeline.plans import run
from hazeline.sources.detections import detections
from hazeline.streaming import judge

SF = "/root/testdata/sf0.001"
SHOWN = ["site", "track_id", "tier", "score", "timestamp", "bbox", "confidence", "n_observations", "geo_ok", "lat", "lon", "cep50_m", "geo_reject_reason", "flow_ok", "area_ok", "criteria", "snapshot", "features", "explanation"]


def rounded(v):
    if isinstance(v, float):
        return float(f"{v:.8g}") if abs(v) > 1e-9 else 0.0
    if isinstance(v, dict):
        return sorted((k, rounded(x)) for k, x in v.items())
    return [rounded(x) for x in v] if isinstance(v, (list, tuple)) else v


def shown(events):
    return sorted((rounded([*r]) for r in events.select(*SHOWN).collect()), key=str)


def named(v):
    return v.withColumns({"site": F.concat(F.lit("s"), F.col("seq_id")), "timestamp": ((F.col("frame_index") - 16) * 60).cast("double")})


def placed(d):
    """Places without solving: some detections have none, for one reason or another."""
    k = F.col("det_id") % 5
    return d.select(F.col("det_id").alias("row_id"), (k * 7.0).alias("depression"), F.when(k == 1, "grazing").alias("reason"), F.when(k > 1, F.col("lat")).alias("lat"), F.when(k > 1, F.col("lon")).alias("lon"), F.lit(300.0).alias("elevation_m"), (1000.0 + k).alias("range_m"), F.when(k > 1, 90.0 + k).alias("cep50_m"), F.when(k > 1, 200.0).alias("cep90_m"))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, judge.ROCKSDB)
    yield
    spark.conf.set(key, before)


def test_stream_gives_the_events_of_the_batch(spark, tmp_path, rocks):
    """Detections in five files that split frames, frames without detections as rows of their own, and a sink into the store."""
    d = detections(spark, SF).where("seq_id < 12 AND frame_index NOT IN (7, 8)").drop("lat", "lon", "k", "lane").withColumns({"lat": F.lit(36.4), "lon": F.lit(128.7) + F.col("det_id") / 1e4})
    fixes = placed(d)
    want = run.events(named(run.verdicts(d.drop("lat", "lon"), fixes)), "wide")
    full = d.drop("lat", "lon").join(fixes.withColumnRenamed("row_id", "det_id"), "det_id").withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("frame_index") * 60))
    rows = full.orderBy("frame_index", "det_id").collect()
    cut = len(rows) // 5 + 1
    frames = sorted({r.frame_index for r in rows})
    assert rows[cut].frame_index == rows[cut - 1].frame_index
    for k in range(5):
        spark.createDataFrame(rows[k * cut : (k + 1) * cut], full.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    empty = [{"seq_id": s, "frame_index": f, "at": r} for s in {r.seq_id for r in rows} for f, r in ((frames[-1] + 60, None),)]
    late = spark.createDataFrame([(e["seq_id"], e["frame_index"]) for e in empty], "seq_id long, frame_index int").withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("frame_index") * 60))
    for c in full.columns:
        if c not in late.columns:
            late = late.withColumn(c, F.lit(None).cast(full.schema[c].dataType))
    late.select(*full.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run.events(named(judge.verdicts_stream(stream, delay="120 seconds")), "wide")
    s = store.EventStore(spark, f"file://{tmp_path}/store")
    q = s.sink(out, "judge", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert len(q.recentProgress) >= 6
    got = s.events()
    assert shown(got) == shown(want)
    ids = [r.id for r in got.collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_sums_are_those_of_windows(spark):
    """Flow and patches too; and the state has one length for any track."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        patch = rng.uniform(0, 1, 36).tolist() if k % 3 else None
        flow = [float(v) for v in rng.uniform(0, 1, 3)] if k % 4 else [None] * 3
        x, y, w, h = rng.uniform(0, 900, 4)
        rows.append((1, 0, k, k, 60.0 * k, float(x), float(y), float(x + w), float(y + h), float(rng.uniform()), *flow, patch))
    d = spark.createDataFrame(rows, "seq_id long, track_id long, frame_index int, det_id long, offset_s double, x1 double, y1 double, x2 double, y2 double, confidence double, divergence double, upward_ratio double, translation_mag double, patch array<double>")
    from pyspark.sql.window import Window

    past = Window.partitionBy("seq_id").orderBy("offset_s").rowsBetween(Window.unboundedPreceding, 0)
    o = rules.observations(d, ("seq_id",)).withColumns({**rules.features(60.0, past), **rules.flow_features(past), **rules.looks(F.col("patch"), 6)})
    f = rules.appearance_so_far(o.drop("brightness", "softness"), ("seq_id",), 6).orderBy("offset_s").collect()
    whole = rules.appearance(d, ("seq_id",), 6).first()
    assert (f[-1].intensity_flicker, f[-1].edge_softness) == pytest.approx((whole.intensity_flicker, whole.edge_softness))
    looks = {r.det_id: (r.brightness, r.softness) for r in o.collect()}
    sums = judge.Sums()
    for r, want in zip(rows, f, strict=True):
        more = dict(zip(["divergence", "upward_ratio", "translation_mag"], r[10:13], strict=True)) | dict(zip(["brightness", "softness"], looks[r[3]], strict=True))
        sums.add(r[4], r[5:9], r[9], more)
        got = sums.features(60.0)
        assert got == pytest.approx({k: want[k] for k in got}, rel=1e-8, abs=1e-11)
        assert len(sums.v) == 38


def test_patches_count_in_events(spark):
    d = detections(spark, SF).where("seq_id < 3").drop("lat", "lon").withColumn("patch", F.transform(F.sequence(F.lit(0), F.lit(35)), lambda k: (k * (F.col("k") + 1) % 7) / 7.0))
    bare, seen = (run.verdicts(x, placed(detections(spark, SF)), side=6) for x in (d.drop("patch"), d))
    x = run.events(named(seen), "wide").where("n_observations > 3").first()
    assert x.features["edge_softness"] > 0 and x.explanation["edge_softness"] == pytest.approx(0.3 * (x.features["edge_softness"] - 0.5) / 0.2)
    assert "edge_softness" not in run.events(named(bare), "wide").first().features
    assert seen.count() == bare.count()
