"""Suppression, matching, tracking, routing and georeferencing against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.functions import geodesy, rules
from hazeline.operators import learn, matching
from hazeline.plans import catalog
from hazeline.sources.detections import detections
from hazeline.streaming import alerts, tracks

SF = "/root/testdata/sf0.001"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    x = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - x
    return x / union if union > 0 else 0.0


def test_suppression(spark):
    rng = random.Random(3)
    rows = [(k, k % 5, 0, "x", *(lambda x, y: (x, y, x + 40.0, y + 40.0))(rng.uniform(0, 120), rng.uniform(0, 120)), rng.choice([0.2, 0.5, 0.9])) for k in range(80)]
    d = spark.createDataFrame(rows, "det_id long, seq_id long, frame_index int, lane string, x1 double, y1 double, x2 double, y2 double, confidence double")
    want = set()
    for s in range(5):
        kept = []
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[8], r[0])):
            if all(overlap(r[4:8], q[4:8]) <= 0.2 for q in kept):
                kept.append(r)
        want |= {r[0] for r in kept}
    once = matching.suppressed(d)
    assert {r.det_id for r in once.collect()} == want
    assert {r.det_id for r in matching.suppressed(once).collect()} == want


def test_matching_is_one_to_one(spark):
    rng = random.Random(5)
    box = lambda: (x := rng.uniform(0, 60), y := rng.uniform(0, 60), x + 30.0, y + 30.0)
    preds = [(k, k % 7, k % 2, rng.choice([0.3, 0.6, 0.9]), *box()) for k in range(150)]
    boxes = [(1000 + k, k % 8, k % 2, *box()) for k in range(90)]
    d = spark.createDataFrame(preds, "det_id long, seq_id long, frame_index int, confidence double, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame(boxes, "truth_id long, seq_id long, frame_index int, x1 double, y1 double, x2 double, y2 double")
    want = {}
    for frame in {p[1:3] for p in preds}:
        free = sorted(b for b in boxes if b[1:3] == frame)
        for p in sorted((p for p in preds if p[1:3] == frame), key=lambda p: (-p[3], p[0])):
            best = max(free, key=lambda b: (overlap(p[4:], b[3:]), -b[0]), default=None)
            hit = best is not None and overlap(p[4:], best[3:]) >= 0.5
            want[p[0]] = best[0] if hit else None
            if hit:
                free.remove(best)
    assert {r.det_id: r.truth_id for r in matching.matched(d, t).collect()} == want
    assert sum(v is not None for v in want.values()) > 20


def test_average_precision(spark):
    m, truth = catalog._matches(spark, SF)
    rows = sorted(((r.confidence, r.det_id, r.truth_id is not None) for r in m.collect()), key=lambda r: (-r[0], r[1]))
    n = truth.count()
    tp = np.cumsum([r[2] for r in rows])
    p = np.maximum.accumulate((tp / np.arange(1, len(rows) + 1))[::-1])[::-1]
    assert matching.average_precision(m, truth).first().ap == pytest.approx(sum(x for x, r in zip(p, rows, strict=True) if r[2]) / n)
    empty = matching.average_precision(m.limit(0), truth.limit(0)).first()
    assert (empty.ap, empty.n, empty.n_truth) == (0.0, 0, 0)


def test_track_ends_after_three_misses_and_is_reported_until_then():
    s = tracks.Sequence()
    assert s.frame([(5, (0.0, 0.0, 10.0, 10.0))]) == [(0, 5, 0)]
    assert [s.frame([]), s.frame([]), s.frame([])] == [[(0, None, 1)], [(0, None, 2)], []]
    assert s.frame([(6, (0.0, 0.0, 10.0, 10.0))]) == [(1, 6, 0)]


def linked_plainly(rows):
    """Greedy linking with a full table of scores, frame by frame."""
    out = []
    for seq in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == seq]
        open_, next_id = [], 0
        for f in range(min(r[1] for r in own), max(r[1] for r in own) + 1):
            dets = sorted((r[2], r[3:]) for r in own if r[1] == f)
            scores = {(i, j): tracks.affinity(t[1], dets[j][1]) for i, t in enumerate(open_) for j in range(len(dets))}
            got = {}
            while scores and max(scores.values()) > 0:
                i, j = max(scores, key=lambda k: (scores[k], k))
                got[i] = j
                scores = {k: v for k, v in scores.items() if k[0] != i and k[1] != j}
            for i, t in enumerate(open_):
                t[1], t[2], t[3] = (dets[got[i]][1], 0, dets[got[i]][0]) if i in got else (t[1], t[2] + 1, None)
            open_ = [t for t in open_ if t[2] <= 2]
            for j in range(len(dets)):
                if j not in got.values():
                    open_.append([next_id, dets[j][1], 0, dets[j][0]])
                    next_id += 1
            out += [(seq, f, t[0], t[3], t[2]) for t in open_]
    return out


def test_linking_is_that_of_the_plain_version(spark):
    d = detections(spark, SF)
    rows = [tuple(r) for r in d.select("seq_id", "frame_index", "det_id", "x1", "y1", "x2", "y2").collect()]
    rng = random.Random(2)
    rows = [r for r in rows if rng.random() < 0.7 or r[1] < 3]
    frame = spark.createDataFrame(rows, "seq_id long, frame_index int, det_id long, x1 double, y1 double, x2 double, y2 double").repartition(3)
    links = tracks.linked(frame)
    want = sorted(linked_plainly(rows), key=str)
    assert sorted((tuple(r) for r in links.collect()), key=str) == want
    every = {(r.seq_id, r.track_id): r for r in tracks.all_tracks(links).collect()}
    assert len(every) == len({w[:1] + w[2:3] for w in want})
    end = {}
    for w in want:
        end[w[0]] = max(end.get(w[0], 0), w[1])
    for (seq, t), r in every.items():
        own = [w for w in want if w[0] == seq and w[2] == t]
        assert (r.hits, r.first_frame, r.finished) == (sum(w[3] is not None for w in own), min(w[1] for w in own), max(w[1] for w in own) < end[seq])


def test_a_long_sequence_is_cut_where_no_track_goes_on(spark):
    """One sequence of many runs, with pauses of two frames (no cut), three (cut) and more, over blocks of few frames."""
    rng = random.Random(8)
    rows, f, det = [], 0, 0
    for _ in range(120):
        for _ in range(rng.randrange(1, 3)):
            x, y = 300.0 * rng.randrange(2), 5.0 * rng.randrange(3)
            rows.append((7, f, det, x, y, x + 40, y + 40))
            det += 1
        f += rng.choice([1, 1, 2, 3, 4, 9])
    frame = spark.createDataFrame(rows, "seq_id long, frame_index int, det_id long, x1 double, y1 double, x2 double, y2 double").repartition(3)
    cut = {r.frame_index: r.run for r in tracks.runs(frame, block=8).collect()}
    frames, run, want = sorted(cut), None, {}
    for a, b in zip([None, *frames], frames, strict=False):
        run = b if a is None or b - a > 3 else run
        want[b] = run
    assert cut == want and len(set(cut.values())) > 20
    plain = sorted(linked_plainly(rows), key=str)
    for few in (0, 100_000):
        assert sorted((tuple(r) for r in tracks.linked(frame, few).collect()), key=str) == plain


def test_stream_of_split_frames_gives_the_batch_rows(spark, tmp_path):
    d = detections(spark, SF).select("seq_id", "frame_index", "det_id", "x1", "y1", "x2", "y2")
    rows = sorted(map(tuple, d.collect()), key=lambda r: (r[1], r[2] % 2, r[0]))
    cut = len(rows) // 5
    late = (rows[0][0], 0, 999_999, 0.0, 0.0, 1.0, 1.0)
    ends = [(s, None, None, None, None, None, None) for s in {r[0] for r in rows}]
    parts = [rows[k * cut : (k + 1) * cut if k < 4 else None] + ([late] if k == 4 else []) for k in range(5)] + [ends]
    for k, part in enumerate(parts):
        frame = spark.createDataFrame(part, d.schema).coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = tracks.linked_stream(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("linked").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = [tuple(r) for r in spark.table("linked").collect()]
    assert len(q.recentProgress) >= 6
    assert [r[:4] for r in got if r[5] == "late"] == [(late[0], 0, None, 999_999)]
    assert sorted((r[:5] for r in got if r[5] == "linked"), key=str) == sorted((tuple(r) for r in tracks.linked(d).collect()), key=str)


def route_plainly(rows):
    best, sent, out = {}, [], []
    for id_, at, tier, track, e, n in sorted(rows, key=lambda r: (r[1], r[0])):
        rank = rules.TIERS.index(tier)
        if rank == 0:
            out.append((id_, "stored", None))
        elif track in best and rank <= best[track]:
            out.append((id_, "not risen", None))
        else:
            reason = "escalated" if track in best else "new"
            best[track] = rank
            rival = next((s for s in sent if at - s[2] <= 600 and plain_metres(s[0], s[1], e, n) <= 300), None) if e is not None else None
            if rival and rank <= rival[3]:
                out.append((id_, "suppressed", None))
                continue
            if e is not None:
                sent.append((e, n, at, rank))
            out.append((id_, "sent", reason))
    return out


def plain_metres(lat0, lon0, lat, lon):
    """Distance on the tangent plane at the first place, with matrices."""
    p, q = np.radians([lat0, lat]), np.radians([lon0, lon])
    e2 = 1 / 298.257223563 * (2 - 1 / 298.257223563)
    n = 6378137.0 / np.sqrt(1 - e2 * np.sin(p) ** 2)
    xyz = np.array([n * np.cos(p) * np.cos(q), n * np.cos(p) * np.sin(q), n * (1 - e2) * np.sin(p)])
    east = [-np.sin(q[0]), np.cos(q[0]), 0.0]
    north = [-np.sin(p[0]) * np.cos(q[0]), -np.sin(p[0]) * np.sin(q[0]), np.cos(p[0])]
    return float(np.hypot(*(np.array([east, north]) @ (xyz[:, 1] - xyz[:, 0]))))


#: on three continents
PLACES = [(36.4127, 128.7043), (-31.95, 115.86), (38.72, -9.14)]


def alerts_table(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        south, west = PLACES[k % 3]
        lat, lon = (south + rng.choice([0, 0.001, 0.002, 0.02]), west + rng.choice([0, 0.001, 0.003, 0.0036, 0.02])) if rng.random() < 0.9 else (None, None)
        rows.append((k % 3, k, float(rng.randrange(6000)), rng.choice(rules.TIERS), f"t{rng.randrange(60)}", lat, lon))
    return rows, spark.createDataFrame(rows, "site long, id long, at double, tier string, track string, lat double, lon double")


def test_routing_is_that_of_the_plain_version(spark):
    rows, d = alerts_table(spark)
    want = {id_: x for s in range(3) for id_, *x in route_plainly([r[1:] for r in rows if r[0] == s])}
    assert {r.id: [r.decision, r.reason] for r in alerts.routed(d.repartition(5)).collect()} == want
    assert {x[0] for x in want.values()} == {"stored", "not risen", "suppressed", "sent"}
    summary = alerts.router_summary(alerts.routed(d), d).first()
    assert summary.notifications == sum(x[0] == "sent" for x in want.values()) and summary.tracks_seen == len({(r[0], r[4]) for r in rows if r[3] != "SPARK"})
    assert alerts.routed(d.limit(0)).collect() == []


def test_routing_of_a_stream(spark, tmp_path):
    rows, d = alerts_table(spark)
    for part in ("at < 2000", "at >= 2000 AND at < 4000", "at >= 4000"):
        d.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = alerts.routed_stream(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("routed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("routed").collect()), key=str) == sorted(map(tuple, alerts.routed(d).collect()), key=str)


def test_suppression_is_of_the_first_recent_alert_and_ends(spark):
    rows = [(1, 0.0, "SPARK", "a", 0.0), (2, 0.0, "GLOW", "a", 0.0), (3, 10.0, "GLOW", "b", 0.0009), (4, 20.0, "FLARE", "b", 0.0009), (5, 30.0, "GLOW", "c", 0.01), (6, 100.0, "GLOW", "e", 0.0), (7, 700.0, "GLOW", "d", 0.0), (8, 701.0, "GLOW", "d", 0.0), (9, 702.0, "GLOW", "f", None)]
    d = spark.createDataFrame([(1, i, at, tier, t, None if x is None else 36.4127 + x, 128.7043) for i, at, tier, t, x in rows], "site long, id long, at double, tier string, track string, lat double, lon double")
    assert [r.decision for r in sorted(alerts.routed(d).collect())] == ["stored", "sent", "suppressed", "sent", "sent", "suppressed", "sent", "not risen", "sent"]


def test_distances_hold_anywhere(spark):
    """998 m are 998 m at every site, and 290 m suppress at every site."""
    for lat, lon in PLACES:
        near, far = 290 / 111_320 / np.cos(np.radians(lat)), 998 / 111_320 / np.cos(np.radians(lat))
        rows = [(1, 0.0, "a", lon), (2, 1.0, "b", float(lon + far)), (3, 2.0, "c", float(lon + near))]
        d = spark.createDataFrame([(1, i, at, "GLOW", t, lat, x) for i, at, t, x in rows], "site long, id long, at double, tier string, track string, lat double, lon double")
        assert [r.decision for r in sorted(alerts.routed(d).collect())] == ["sent", "sent", "suppressed"]


def test_forecast_cells(spark):
    d = spark.createDataFrame([(37.5665, 126.978, 60, 127), (35.1796, 129.0756, 98, 76), (33.4996, 126.5312, 53, 38)], "lat double, lon double, nx int, ny int")
    x, y = geodesy.forecast_cell(F.col("lat"), F.col("lon"))
    for r in d.select("nx", "ny", x.alias("x"), y.alias("y")).collect():
        assert (r.nx, r.ny) == (r.x, r.y)


def test_fit_refuses_few_labels(spark):
    t = spark.createDataFrame([(0.1, "confirmed"), (0.2, "false_positive")], "persistence double, label string")
    with pytest.raises(ValueError, match="8 labels"):
        learn.fitted(t)


def test_saved_weights(spark, tmp_path):
    w = spark.createDataFrame([("persistence", 2.5), ("intercept", 0.25)], "feature string, weight double")
    learn.save(w, str(tmp_path / "scorer"))
    weights = learn.load(spark, str(tmp_path / "scorer"))
    assert weights == {"persistence": 2.5, "intercept": 0.25}
    zero = spark.range(1).select(*(F.lit(c).alias(f) for f, _, c, _ in rules.SCORER))
    x = zero.withColumn("persistence", F.lit(0.8)).select(rules.score(patches=True, weights=weights).alias("s")).first().s
    assert x == pytest.approx(1 / (1 + np.exp(-2.75)))


def test_split_of_sparse_keys(spark):
    keys = [k * k * 7919 for k in range(300)]
    got = {r.k: r.part for r in learn.split(spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)).collect()}
    assert got == {k: ("train", "test")[i % 2] for i, k in enumerate(sorted(keys))}


def test_single_observation(spark):
    row = [(1, "x", 0.0, 1, 0.0, 0.0, 50.0, 50.0, 0.5)]
    d = spark.createDataFrame(row, "seq_id long, lane string, offset_s double, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double")
    f = rules.observations(d).groupBy("seq_id").agg(*(c.alias(k) for k, c in rules.features().items())).first()
    assert (f.n, f.persistence, f.confidence_mean, f.area_growth_rate, f.area_monotonicity, f.translation_over_growth) == (1, 1.0, 0.5, 0.0, 0.0, 0.0)


def test_fit_is_where_the_penalised_gradient_vanishes(spark):
    rng = np.random.default_rng(0)
    rows = [(float(rng.uniform()), float(rng.uniform()), "confirmed" if rng.uniform() < 0.3 else "false_positive") for _ in range(60)]
    w = {r.feature: r.weight for r in learn.fitted(spark.createDataFrame(rows, "persistence double, confidence_mean double, label string")).collect()}
    x = np.array([[(a - 0.5) / 0.3, (b - 0.4) / 0.2, 1.0] for a, b, _ in rows])
    y = np.array([c == "confirmed" for *_, c in rows], float)
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    v = np.array([w["persistence"], w["confidence_mean"], w["intercept"]])
    assert x.T @ (s * (1 / (1 + np.exp(-x @ v)) - y)) + v * [1, 1, 0] == pytest.approx([0, 0, 0], abs=1e-5)


def test_points_behind_the_camera_have_no_pixel(spark):
    rows = [(0.0, 1.0, 0.0), (0.0, -1.0, 0.0), (0.1, 1.0, -0.2)]
    u, v = geodesy.ray_pixel((F.col("e"), F.col("n"), F.col("up")), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1000.0, 960, 540)
    got = spark.createDataFrame(rows, "e double, n double, up double").select(u.alias("u"), v.alias("v")).collect()
    assert [tuple(r) for r in got][:2] == [(960.0, 540.0), (None, None)]
    assert tuple(got[2]) == pytest.approx((1060.0, 740.0))


def test_tile_names(spark):
    d = spark.createDataFrame([(36, 128), (-3, -71)], "s long, w long")
    assert [r[0][22:34] for r in d.select(geodesy.tile_name(F.col("s"), F.col("w"))).collect()] == ["N36_00_E128_", "S03_00_W071_"]
