"""More registered queries: measured reports, event-store reads, and the smaller columns, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazeline.functions import cells
from hazeline.functions import geodesy as geo
from hazeline.functions import geometry as g
from hazeline.functions import rules
from hazeline.operators import crossing, evaluate, matching, solve, store
from hazeline.plans import run
from hazeline.plans.catalog import _AP, _CURVE, _EVENTS, _LINKS, _MATCH, _MET, _OBS, _SQL, _RISEN, LAT0, LON0, _at_sites, _enu_sql, _features_sql, _matches, _r, query, stored_events
from hazeline.session import materialize, table
from hazeline.sources import files, weather
from hazeline.sources.detections import SQL, detections
from hazeline.streaming import alerts

_JUDGED = f"""{_OBS}, t AS (SELECT seq_id, lane, frame_index, offset_s, {_features_sql(' OVER (PARTITION BY seq_id, lane ORDER BY offset_s, det_id ROWS UNBOUNDED PRECEDING)')} FROM w),
v AS (SELECT *, growth AS area_growth_rate, mono AS area_monotonicity, -dy / greatest(side, 1) AS centroid_rise_rate FROM t),
j AS MATERIALIZED (SELECT seq_id, lane, frame_index, offset_s, n >= 3 AND {_MET} = 2 AS flare FROM v),
frm AS (SELECT seq_id, frame_index, any_value(offset_s) AS offset_s, count(*) AS hits FROM d GROUP BY seq_id, frame_index),
s1 AS (SELECT seq_id, count(*) FILTER (WHERE offset_s < 0) AS frames_before, count(*) FILTER (WHERE offset_s >= 0) AS frames_after, CAST(coalesce(sum(hits) FILTER (WHERE offset_s < 0), 0) AS BIGINT) AS raw, count(*) FILTER (WHERE offset_s < 0 AND hits > 0) AS alarmed_single FROM frm GROUP BY seq_id),
s2 AS (SELECT seq_id, count(*) FILTER (WHERE born < 0) AS dedup, count(*) FILTER (WHERE flare_at < 0) AS verified, min(flare_at) FILTER (WHERE flare_at >= 0) AS time_to_flare FROM (SELECT seq_id, lane, min(offset_s) AS born, min(offset_s) FILTER (WHERE flare) AS flare_at FROM j GROUP BY seq_id, lane) GROUP BY seq_id),
s3 AS (SELECT seq_id, count(DISTINCT frame_index) AS alarmed_sequence FROM j WHERE flare AND offset_s < 0 GROUP BY seq_id),
outcome AS (SELECT seq_id, frames_before, frames_after, raw, alarmed_single, dedup, verified, coalesce(alarmed_sequence, 0) AS alarmed_sequence, time_to_flare FROM s1 JOIN s2 USING (seq_id) LEFT JOIN s3 USING (seq_id))"""


def _frames(d: DataFrame) -> DataFrame:
    return d.groupBy("seq_id", "frame_index").agg(F.first("offset_s").alias("offset_s"), F.count("*").alias("hits"))


def _keyed_outcomes(spark, sf_dir) -> DataFrame:
    past = Window.partitionBy("seq_id", "lane").orderBy("offset_s", "det_id").rowsBetween(Window.unboundedPreceding, 0)
    d = detections(spark, sf_dir)
    t = rules.observations(d).select("seq_id", F.col("lane").alias("track"), "frame_index", "offset_s", *(c.alias(k) for k, c in rules.features(over=past).items()))
    return evaluate.outcomes(_frames(d), t.withColumn("tier", rules.tier(*rules.criteria(), F.lit(True))))


@query(f"WITH {_JUDGED} SELECT * FROM outcome")
def sequence_counters(spark, sf_dir):
    """All counters of each sequence, for tracks keyed by lane."""
    return _keyed_outcomes(spark, sf_dir)


_ROLL = """roll AS (SELECT count(*) AS n_sequences, CAST(sum(frames_before) AS BIGINT) AS frames_before, CAST(sum(frames_after) AS BIGINT) AS frames_after, CAST(sum(raw) AS DOUBLE) AS raw, CAST(sum(dedup) AS DOUBLE) AS dedup, CAST(sum(verified) AS DOUBLE) AS verified,
 CAST(sum(alarmed_single) AS DOUBLE) AS single, CAST(sum(alarmed_sequence) AS DOUBLE) AS seqs, count(time_to_flare) AS found, median(time_to_flare) AS ttf, sum(frames_before) / 60e0 AS hours FROM outcome)"""
_ROLLED = ["negative_hours", "positive_hours", "raw_per_hour", "dedup_per_hour", "verified_per_hour", "fpr_single", "fpr_sequence", "detection_rate", "reduction_vs_raw", "reduction_vs_dedup", "fpr_reduction", "median_time_to_flare"]


@query(f"WITH {_JUDGED}, {_ROLL} SELECT n_sequences, frames_before, frames_after, round(hours, 9) AS negative_hours, round(frames_after / 60e0, 9) AS positive_hours, round(raw / hours, 9) AS raw_per_hour, round(dedup / hours, 9) AS dedup_per_hour, round(verified / hours, 9) AS verified_per_hour, round(single / frames_before, 9) AS fpr_single, round(seqs / frames_before, 9) AS fpr_sequence, round(found / CAST(n_sequences AS DOUBLE), 9) AS detection_rate, round(1 - verified / raw, 9) AS reduction_vs_raw, round(1 - verified / dedup, 9) AS reduction_vs_dedup, round(1 - seqs / single, 9) AS fpr_reduction, round(ttf, 9) AS median_time_to_flare FROM roll")
def false_alarm_report(spark, sf_dir):
    """Rates, reductions and shares of alarmed frames over all sequences, for tracks keyed by lane."""
    x = evaluate.rollup(_keyed_outcomes(spark, sf_dir))
    return x.select("n_sequences", "frames_before", "frames_after", *(_r(F.col(c), 9).alias(c) for c in _ROLLED))


#: Verdicts of linked tracks: a frame that a track misses has that of its last detection.
_LINKED_JUDGED = f"""{_LINKS}, ld AS (SELECT d.seq_id, l.track_id AS lane, d.frame_index, d.offset_s, d.det_id, d.confidence, x1, y1, x2, y2 FROM links l JOIN d ON d.det_id = l.det_id),
{_OBS.replace(SQL + ',', '', 1).strip().replace('o AS (', 'lo AS (', 1).replace('FROM d)', 'FROM ld)', 1).replace('FROM o WINDOW', 'FROM lo WINDOW', 1)},
t AS (SELECT seq_id, lane, frame_index, offset_s, {_features_sql(' OVER (PARTITION BY seq_id, lane ORDER BY offset_s, det_id ROWS UNBOUNDED PRECEDING)')} FROM w),
v AS (SELECT *, growth AS area_growth_rate, mono AS area_monotonicity, -dy / greatest(side, 1) AS centroid_rise_rate FROM t),
j AS MATERIALIZED (SELECT l.seq_id, l.track_id AS lane, l.frame_index, CAST((l.frame_index - 16) * 60 AS DOUBLE) AS offset_s, last_value(n >= 3 AND {_MET} = 2 IGNORE NULLS) OVER (PARTITION BY l.seq_id, l.track_id ORDER BY l.frame_index ROWS UNBOUNDED PRECEDING) AS flare
  FROM links l LEFT JOIN v ON v.seq_id = l.seq_id AND v.lane = l.track_id AND v.frame_index = l.frame_index),
{_JUDGED[_JUDGED.index('frm AS ('):]}"""


@query("WITH RECURSIVE " + _LINKED_JUDGED + _SQL["false_alarm_report"][_SQL["false_alarm_report"].index(f", {_ROLL}"):])
def linked_false_alarms(spark, sf_dir):
    """The same for linked tracks, which also live through missed frames."""
    d = detections(spark, sf_dir)
    none = d.select(F.col("det_id").alias("row_id"), F.lit(None).cast("string").alias("reason"), *(F.lit(0.0).alias(c) for c in ("depression", "lat", "lon", "elevation_m", "range_m", "cep50_m", "cep90_m")))
    v = run.verdicts(d, none).select("seq_id", F.col("track_id").alias("track"), "frame_index", ((F.col("frame_index") - 16) * 60).cast("double").alias("offset_s"), "tier")
    x = evaluate.rollup(evaluate.outcomes(_frames(d), v))
    return x.select("n_sequences", "frames_before", "frames_after", *(_r(F.col(c), 9).alias(c) for c in _ROLLED))


@query(f"WITH RECURSIVE {_MATCH}, {_CURVE}, {_AP}, {_JUDGED.replace(SQL + ',', '', 1).replace('o AS (', 'ob AS (', 1).replace('FROM o WINDOW', 'FROM ob WINDOW', 1)}, {_ROLL}, al AS (SELECT CAST(count(*) FILTER (WHERE boxes = 0) AS DOUBLE) AS bare FROM (SELECT f.seq_id, f.frame_index, count(t.truth_id) AS boxes FROM (SELECT DISTINCT seq_id, frame_index FROM d) f LEFT JOIN tr t ON t.seq_id = f.seq_id AND t.frame_index = f.frame_index GROUP BY ALL)) SELECT 'frame false alarm rate' AS item, 3e-2 AS target, round(seqs / frames_before, 9) AS measured, round(single / frames_before, 9) AS detail, CASE WHEN seqs / frames_before <= 3e-2 THEN 'met' ELSE 'not met' END AS verdict FROM roll UNION ALL SELECT 'false alarms an hour', 5e-1, round(verified / hours, 9), round(dedup / hours, 9), CASE WHEN verified / hours <= 5e-1 THEN 'met' ELSE 'not met' END FROM roll UNION ALL SELECT 'seconds to find', 30e0, round(ttf, 9), round(found / CAST(n_sequences AS DOUBLE), 9), 'not measurable' FROM roll WHERE ttf IS NOT NULL UNION ALL SELECT 'detector ap50', NULL, round(ap, 9), CASE WHEN bare > 0 THEN 1e0 ELSE 0e0 END, 'for reference' FROM ap, al")
def claims(spark, sf_dir):
    """What the false-alarm report and the detector baseline say of the targets."""
    m, truth = _matches(spark, sf_dir)
    x = evaluate.claims(evaluate.rollup(_keyed_outcomes(spark, sf_dir)), matching.baseline(m, truth, detections(spark, sf_dir)))
    return x.withColumns({c: _r(F.col(c), 9) for c in ("measured", "detail")})


@query("WITH s AS (SELECT event_type AS device, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS rank, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth, value AS ms FROM events), x AS (SELECT device, any_value(rank) AS rank, count(*) AS n, median(ms) AS med, min(ms) AS lo, max(ms) AS hi FROM s WHERE nth > 3 GROUP BY device) SELECT device, n, round(med, 6) AS median_ms, lo AS min_ms, hi AS max_ms, round(1000 / med, 6) AS fps, round(first_value(med) OVER (ORDER BY rank) / med, 6) AS speedup, row_number() OVER (ORDER BY med, rank) AS place FROM x")
def device_bench(spark, sf_dir):
    """Latencies by device: event values stand for milliseconds, event types for devices."""
    rank = F.lit(4)
    for i, name in enumerate(("click", "error", "purchase", "signup")):
        rank = F.when(F.col("event_type") == name, i).otherwise(rank)
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("device"), rank.alias("rank"), "event_id", F.col("value").alias("ms"))
    # a device's first three samples warm it up; they are found without ordering the rest
    x = e.join(F.broadcast(_first_three(e)), "device").withColumn("nth", F.when(F.array_contains("warm", F.col("event_id")), 1).otherwise(4))
    return evaluate.device_bench(x.select("device", "rank", "nth", "ms")).withColumns({c: _r(F.col(c)) for c in ("median_ms", "fps", "speedup")})


def _first_three(e: DataFrame) -> DataFrame:
    """(device, warm): the three smallest event ids of each of the five devices."""
    dealt = e.groupBy("device", F.pmod(F.xxhash64("event_id"), F.lit(64))).agg(F.slice(F.array_sort(F.collect_list("event_id")), 1, 3).alias("w"))
    return dealt.groupBy("device").agg(F.slice(F.array_sort(F.flatten(F.collect_list("w"))), 1, 3).alias("warm"))


@query(f"WITH RECURSIVE {_RISEN} SELECT count(*) FILTER (WHERE NOT gone) AS notifications, count(*) FILTER (WHERE NOT gone AND tier = 'GLOW') AS glow, count(*) FILTER (WHERE NOT gone AND tier = 'FLARE') AS flare, (SELECT count(*) FROM (SELECT DISTINCT site, seq_id, lane FROM x WHERE rank > 0)) AS tracks_seen FROM z JOIN x ON z.id = x.id")
def router_summary(spark, sf_dir):
    """Notifications sent, by tier, and tracks ever above SPARK."""
    e = _at_sites(stored_events(spark, sf_dir))
    return alerts.router_summary(alerts.routed(e), e)


@query(f"WITH {_EVENTS} SELECT id, tier, CASE tier WHEN 'FLARE' THEN '#E63946' WHEN 'GLOW' THEN '#F4A261' ELSE '#8D99AE' END AS tier_colour, CASE tier WHEN 'FLARE' THEN '타오름' WHEN 'GLOW' THEN '어른거림' ELSE '스침' END AS tier_label, CASE k % 4 WHEN 0 THEN '미대응' WHEN 1 THEN '접수' WHEN 2 THEN '출동' ELSE '진화' END AS response_label FROM e WHERE score >= 5e-1 OR tier <> 'SPARK'")
def public_events(spark, sf_dir):
    """Events with the words and colours that a client shows."""
    e = stored_events(spark, sf_dir).withColumn("response", F.get(F.array(*map(F.lit, store.RESPONSES)), F.col("k") % 4))
    return store.public(e).where("score >= 0.5 OR tier <> 'SPARK'").select("id", "tier", "tier_colour", "tier_label", "response_label")


@query(f"WITH {_EVENTS} SELECT id, tier, round(lat, 6) AS lat, seq_id % 3 = 0 AS geo_ok, CAST(list_sum([k, k + 1]) AS DOUBLE) AS both, k / 2e0 AS feature FROM e")
def event_codec(spark, sf_dir):
    """Events to flat rows with JSON text and back."""
    e = stored_events(spark, sf_dir)
    full = store.migrated(e.select("id", "tier", "score", "lat", "lon", (F.col("seq_id") % 3 == 0).alias("geo_ok"), F.array(F.col("k").cast("double"), (F.col("k") + 1).cast("double")).alias("bbox"), F.create_map(F.lit("half"), F.col("k") / 2.0).alias("features")))
    back = store.decoded(store.encoded(full))
    return back.select("id", "tier", _r(F.col("lat")).alias("lat"), "geo_ok", (F.col("bbox")[0] + F.col("bbox")[1]).alias("both"), F.col("features")["half"].alias("feature"))


@query(f"WITH {SQL}, l AS (SELECT seq_id, lane, det_id, k % 4 AS status, offset_s + 30 * (k % 4) AS said FROM d), m AS (SELECT *, max(status) OVER (PARTITION BY seq_id, lane ORDER BY said, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM l) SELECT seq_id, lane, coalesce(string_agg(status || '@' || CAST(said AS BIGINT), ',' ORDER BY said, det_id) FILTER (WHERE status > coalesce(best, 0)), '') AS history FROM m GROUP BY seq_id, lane")
def response_history(spark, sf_dir):
    """The entries that moved each track's response forward, in order."""
    log = detections(spark, sf_dir).select("seq_id", "lane", "det_id", (F.col("k") % 4).alias("status"), (F.col("offset_s") + 30 * (F.col("k") % 4)).alias("at"))
    entry = lambda h: F.concat_ws("@", h["status"], h["at"].cast("long"))
    return store.responses(log, ["seq_id", "lane"]).select("seq_id", "lane", F.array_join(F.transform("history", entry), ",").alias("history"))


@query(f"WITH {_EVENTS}, s AS (SELECT count(*) FILTER (WHERE seq_id % 20 = 3) AS total, count(*) FILTER (WHERE seq_id % 20 = 3 AND tier = 'FLARE') AS flare, count(*) FILTER (WHERE seq_id % 20 = 3 AND tier = 'GLOW') AS glow, count(*) FILTER (WHERE seq_id % 20 = 3 AND tier = 'SPARK') AS spark, count(*) FILTER (WHERE label <> 'unlabelled') AS labelled, count(*) FILTER (WHERE seq_id % 20 = 3 AND tier = 'GLOW' AND label = 'unlabelled') AS queue FROM e) SELECT * FROM s")
def site_summary(spark, sf_dir):
    """Counts of one site; labelled counts all sites."""
    return store.summary(stored_events(spark, sf_dir).withColumn("site", (F.col("seq_id") % 20).cast("string")), "3")


@query(f"WITH {_EVENTS} SELECT seq_id % 20 AS site, lane, max(id) AS id FROM e GROUP BY 1, 2")
def latest_for_track(spark, sf_dir):
    """The newest event of each track key of a site."""
    return store.latest(stored_events(spark, sf_dir).select("id", (F.col("seq_id") % 20).alias("site"), "lane"), ["site", "lane"])


@query(f"WITH {SQL}, p AS (SELECT det_id, (x1 + x2) / 2 * 5e-1 + 12 AS cx, (y1 + y2) / 2 * 5e-1 + 40 AS cy, (x2 - x1) * 5e-1 AS w, (y2 - y1) * 5e-1 AS h FROM d WHERE confidence >= 2e-1 + 10 * 78e-4) SELECT det_id, round((cx - w / 2 - 12) / 5e-1, 6) AS x1, round((cy - h / 2 - 40) / 5e-1, 6) AS y1, round((cx + w / 2 - 12) / 5e-1, 6) AS x2, round((cy + h / 2 - 40) / 5e-1, 6) AS y2 FROM p")
def decoded_predictions(spark, sf_dir):
    """Raw model output, boxes by centre and size in a letterboxed image, above the confidence threshold, in source pixels."""
    x, y = g.center()
    p = detections(spark, sf_dir).where(F.col("confidence") >= 0.20 + 10 * 0.0078).select("det_id", (x * 0.5 + 12).alias("cx"), (y * 0.5 + 40).alias("cy"), (g.width() * 0.5).alias("w"), (g.height() * 0.5).alias("h"))
    corners = g.decoded(*(F.col(c) for c in ("cx", "cy", "w", "h")), F.lit(0.5), F.lit(12.0), F.lit(40.0))
    return p.select("det_id", *(_r(c).alias(k) for k, c in corners.items()))


_SPAN = "CASE WHEN {0} <= 640 THEN [0] ELSE list_distinct(list_transform(range(0, CAST(ceil(({0} - 640) / 512e0) AS BIGINT) + 1), lambda i: CAST(round_even(i * ({0} - 640) / ceil(({0} - 640) / 512e0), 0) AS BIGINT))) END"


@query(f"WITH {SQL}, s AS (SELECT seq_id, 600 + 97 * (seq_id % 17) AS w, 500 + 61 * (seq_id % 13) AS h FROM d GROUP BY seq_id), x AS (SELECT seq_id, unnest({_SPAN.format('w')}) AS x FROM s), y AS (SELECT seq_id, unnest({_SPAN.format('h')}) AS y FROM s) SELECT seq_id, x, y FROM x JOIN y USING (seq_id)")
def frame_tiles(spark, sf_dir):
    """Corners of the overlapping tiles that cover each sequence's frames, whose sizes differ."""
    s = detections(spark, sf_dir).select("seq_id").distinct().select("seq_id", (600 + 97 * (F.col("seq_id") % 17)).alias("w"), (500 + 61 * (F.col("seq_id") % 13)).alias("h"))
    return s.select("seq_id", F.explode(g.tiles(F.col("w"), F.col("h"), 640, 0.2)).alias("t")).select("seq_id", "t.x", "t.y")


_CROP = "least(greatest(greatest(x2 - x1, y2 - y1, 1) * 38e-1, 160), 1080)"


@query(f"WITH {SQL}, s AS (SELECT *, {_CROP} AS side FROM d) SELECT det_id, CAST(round_even(least(greatest((x1 + x2) / 2 - side / 2, 0), 1920 - side), 0) AS BIGINT) AS \"left\", CAST(round_even(least(greatest((y1 + y2) / 2 - side / 2, 0), 1080 - side), 0) AS BIGINT) AS top, CAST(round_even(side, 0) AS BIGINT) AS size FROM s")
def snapshot_crops(spark, sf_dir):
    """The square of each detection's snapshot."""
    c = g.crop(*(F.col(k) for k in ("x1", "y1", "x2", "y2")), F.lit(1920), F.lit(1080))
    return detections(spark, sf_dir).select("det_id", *(v.alias(k) for k, v in c.items()))


@query(f"WITH {SQL}, u AS (SELECT seq_id, lane, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM d GROUP BY seq_id, lane HAVING count(*) >= 2), s AS (SELECT *, least(greatest(greatest(x2 - x1, y2 - y1, 1) * 28e-1, 120), 1080) AS side FROM u) SELECT seq_id, lane, CAST(round_even(least(greatest((x1 + x2) / 2 - side / 2, 0), 1920 - side), 0) AS BIGINT) AS \"left\", CAST(round_even(least(greatest((y1 + y2) / 2 - side / 2, 0), 1080 - side), 0) AS BIGINT) AS top, CAST(round_even(side, 0) AS BIGINT) AS size FROM s")
def track_crops(spark, sf_dir):
    """One fixed square around all boxes of a track, for its animation; tracks of one frame have none."""
    u = detections(spark, sf_dir).groupBy("seq_id", "lane").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n")).where("n >= 2")
    c = g.crop(*(F.col(k) for k in ("x1", "y1", "x2", "y2")), F.lit(1920), F.lit(1080), 0.9, 120.0)
    return u.select("seq_id", "lane", *(v.alias(k) for k, v in c.items()))


@query(f"WITH {SQL} SELECT det_id, round((4 + k / 1e1) * 1920 / 64e-1, 6) AS fx, round(degrees(2 * atan(1920 / (2 * ((4 + k / 1e1) * 1920 / 64e-1)))), 6) AS hfov, round(960 / tan(radians(40 + k / 2e0) / 2), 6) AS fov_fx FROM d")
def camera_intrinsics(spark, sf_dir):
    """Focal lengths in pixels from focal length and sensor, the field of view that they give, and from a field of view."""
    fx = geo.focal_of_sensor(4 + F.col("k") / 10.0, F.lit(1920), F.lit(6.4))
    return detections(spark, sf_dir).select("det_id", _r(fx).alias("fx"), _r(geo.fov_of(fx, F.lit(1920))).alias("hfov"), _r(geo.focal_of(F.lit(1920), 40 + F.col("k") / 2.0)).alias("fov_fx"))


_CAM = "east * cos(yw) - north * sin(yw) AS rx, east * sin(yw) * sin(pt) + north * cos(yw) * sin(pt) - up * cos(pt) AS ry, east * sin(yw) * cos(pt) + north * cos(yw) * cos(pt) + up * sin(pt) AS rz"


@query(f"WITH {SQL}, a AS (SELECT det_id, east, north, up, radians(k * 36e-1) AS yw, radians(-k * 5e-1) AS pt FROM {_enu_sql('d', '1300e0')}), b AS (SELECT det_id, {_CAM} FROM a), c2 AS (SELECT det_id, 960 / tan(radians(737e-1) / 2) * rx / rz + 960 AS u, 960 / tan(radians(737e-1) / 2) * ry / rz + 540 AS v FROM b WHERE rz > 0) SELECT det_id, round(u, 3) AS u, round(v, 3) AS v FROM c2 WHERE u >= 0 AND u < 1920 AND v >= 0 AND v < 1080")
def projected_points(spark, sf_dir):
    """Pixels of the detections' places as each one's camera sees them, where it does."""
    camera = solve.Camera.from_fov(1920, 1080, 73.7)
    d = detections(spark, sf_dir).select("det_id", "lat", "lon", F.lit(LAT0).alias("cam_lat"), F.lit(LON0).alias("cam_lon"), F.lit(1300.0).alias("cam_alt"), (F.col("k") * 3.6).alias("yaw"), (-F.col("k") * 0.5).alias("pitch"), F.lit(0.0).alias("roll"))
    p = solve.projected(d, "lat", "lon", F.lit(0.0), camera)
    return p.select("det_id", _r(F.col("pu"), 3).alias("u"), _r(F.col("pv"), 3).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")


@query(f"WITH {SQL}, r AS (SELECT det_id, ((y1 + y2) / 2 - 540) / (960 / tan(radians(737e-1) / 2)) AS b, ((x1 + x2) / 2 - 960) / (960 / tan(radians(737e-1) / 2)) AS a, radians(-k * 5e-1 - 2) AS p FROM d), z AS (SELECT det_id, degrees(asin(least(1, greatest(-1, (b * cos(p) - sin(p)) / sqrt(a * a + b * b + 1))))) AS dep FROM r) SELECT det_id, round(dep, 6) AS depression, dep < 8 AS grazing FROM z")
def grazing_gate(spark, sf_dir):
    """Depression of every aimed detection, and whether it is too flat to be placed."""
    camera, (_, aimed) = solve.Camera.from_fov(1920, 1080, 73.7), run.posed(spark, sf_dir)
    ray = geo.rotate(geo.pixel_ray(F.col("u"), F.col("v"), camera.fx, camera.cx, camera.cy), F.col("yaw"), F.col("pitch"), F.col("roll"))
    d = geo.depression(ray)
    return aimed.select("det_id", _r(d).alias("depression"), (d < solve.Solver().grazing).alias("grazing"))


@query("WITH s AS (SELECT DISTINCT user_id AS seq_id FROM events) SELECT seq_id, CASE WHEN seq_id % 4 < 2 THEN 1 + (seq_id % 7) / 2e0 ELSE 25e-1 END AS wind_speed, CASE WHEN seq_id % 4 < 2 THEN CAST(seq_id * 13 % 360 AS DOUBLE) ELSE 270e0 END AS wind_from, CASE WHEN seq_id % 4 < 2 THEN 'kma' ELSE 'fallback' END AS source FROM s")
def site_winds(spark, sf_dir):
    """Wind of each sequence from a weather answer: some lack a category, some are missing or no JSON."""
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id")).distinct()
    item = lambda c, v: F.concat(F.lit('{"category":"' + c + '","obsrValue":"'), v.cast("string"), F.lit('"}'))
    vec, wsd = item("VEC", (F.col("seq_id") * 13) % 360), item("WSD", 1 + (F.col("seq_id") % 7) / 2.0)
    body = lambda *i: F.concat(F.lit('{"response":{"body":{"items":{"item":['), F.concat_ws(",", *i), F.lit("]}}}}"))
    text = F.when(F.col("seq_id") % 4 < 2, body(item("T1H", F.lit(20)), vec, wsd)).when(F.col("seq_id") % 4 == 2, body(vec)).when(F.col("seq_id") % 8 == 3, "no json")
    return weather.winds(s.withColumn("body", text), ["seq_id"], (2.5, 270.0))


_NAME = "printf('%d_%+05d.jpg', 1465063200 + 60 * frame_index, CAST(offset_s AS BIGINT))"


@query(f"WITH {SQL} SELECT DISTINCT seq_id, frame_index, {_NAME} AS file, CAST(offset_s AS INT) AS offset_s FROM d")
def frame_names(spark, sf_dir):
    """File names of the frames and the seconds that they tell."""
    d = detections(spark, sf_dir).select("seq_id", "frame_index", F.format_string("%d_%+05d.jpg", 1465063200 + 60 * F.col("frame_index"), F.col("offset_s").cast("long")).alias("file")).distinct()
    return d.withColumn("offset_s", files.offset_of(F.col("file")))


@query(f"WITH {SQL}, f2 AS (SELECT DISTINCT seq_id, frame_index, offset_s FROM d WHERE frame_index >= seq_id % 20) SELECT seq_id, frame_index, offset_s FROM f2 WHERE seq_id IN (SELECT seq_id FROM f2 WHERE offset_s < 0)")
def rebuilt_manifest(spark, sf_dir):
    """Frames of the sequences that have one before ignition; some sequences start late."""
    d = detections(spark, sf_dir).where("frame_index >= seq_id % 20").select("seq_id", "frame_index", "offset_s").distinct()
    return files.pre_ignition(d.withColumnRenamed("seq_id", "sequence")).withColumnRenamed("sequence", "seq_id")


@query(f"WITH {SQL}, l AS (SELECT det_id, '0 ' || (k / 1e2) || ' ' || (5e-1) || ' ' || (25e-2) || CASE WHEN k % 5 = 0 THEN '' ELSE ' ' || (125e-3) END AS line, k FROM d) SELECT det_id, round((k / 1e2 - 125e-3) * 1280, 6) AS x1, round((5e-1 - 625e-4) * 720, 6) AS y1, round((k / 1e2 + 125e-3) * 1280, 6) AS x2, round((5e-1 + 625e-4) * 720, 6) AS y2 FROM l WHERE k % 5 > 0")
def label_boxes(spark, sf_dir):
    """Boxes from label lines in shares of the image; lines with fewer than five tokens have none."""
    line = F.concat_ws(" ", F.lit("0"), (F.col("k") / 100.0).cast("string"), F.lit("0.5"), F.lit("0.25"), F.when(F.col("k") % 5 > 0, F.lit("0.125")))
    b = files.boxes(detections(spark, sf_dir).select("det_id", line.alias("value")), 1280.0, 720.0, keep=["det_id"])
    return b.withColumns({c: _r(F.col(c)) for c in ("x1", "y1", "x2", "y2")})


@query(f"WITH {_EVENTS}, n AS (SELECT id, 's' || seq_id || '-t' || (id % 9) || '-f' || (k % 40) AS snapshot FROM e), gif AS (SELECT DISTINCT regexp_extract(snapshot, '^(.+-t[0-9]+)-f[0-9]+$', 1) AS key FROM n WHERE id % 3 > 0) SELECT id, snapshot, key AS gif_key FROM n LEFT JOIN gif ON key = regexp_extract(snapshot, '^(.+-t[0-9]+)-f[0-9]+$', 1)")
def gif_keys(spark, sf_dir):
    """The animation that each event's snapshot belongs to, if it has been made."""
    n = stored_events(spark, sf_dir).select("id", F.concat(F.lit("s"), "seq_id", F.format_string("-t%d-f%d", F.col("id") % 9, F.col("k") % 40)).alias("snapshot"))
    key = F.regexp_extract("snapshot", r"^(.+-t[0-9]+)-f[0-9]+$", 1)
    made = n.where("id % 3 > 0").select(key.alias("gif_key")).distinct()
    return n.join(made, key == made["gif_key"], "left").select("id", "snapshot", "gif_key")


@query(f"WITH {SQL}, t AS (SELECT seq_id % 7 AS site, min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e FROM d GROUP BY 1), x AS (SELECT site, unnest(range(CAST(floor(s) AS BIGINT), CAST(floor(n) AS BIGINT) + 1)) AS south, w, e FROM t), y AS (SELECT site, south, unnest(range(CAST(floor(w) AS BIGINT), CAST(floor(e) AS BIGINT) + 1)) AS west FROM x) SELECT site, south, west, printf('https://tiles.example/%s/%s.tif', name, name) AS url FROM (SELECT *, printf('Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM', CASE WHEN south >= 0 THEN 'N' ELSE 'S' END, abs(south), CASE WHEN west >= 0 THEN 'E' ELSE 'W' END, abs(west)) AS name FROM y) WHERE (site + west) % 2 = 0")
def missing_tiles(spark, sf_dir):
    """Terrain tiles that each site's box needs and that are not there, with their addresses; every other one is there."""
    t = detections(spark, sf_dir).groupBy((F.col("seq_id") % 7).alias("site")).agg(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"))
    x = t.select("site", F.explode(geo.tiles_of_box(F.col("s"), F.col("w"), F.col("n"), F.col("e"))).alias("t")).select("site", "t.south", "t.west")
    x = x.withColumn("path", F.concat_ws("/", "site", geo.tile_name(F.col("south"), F.col("west"))))
    there = x.where("(site + west) % 2 <> 0").select("path")
    return x.join(there, "path", "left_anti").select("site", "south", "west", geo.tile_url(F.col("south"), F.col("west"), "https://tiles.example").alias("url"))


@query(f"WITH {_EVENTS} SELECT id FROM e WHERE k % 3 < 2 AND lat IS NOT NULL AND id % 4 > 0")
def located_events(spark, sf_dir):
    """Events that a map can show."""
    e = stored_events(spark, sf_dir).withColumn("geo_ok", F.col("k") % 3 < 2).withColumn("lon", F.when(F.col("id") % 4 > 0, F.col("lon")))
    return store.place_of(e).select("id")


@query("WITH n AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || '.jpg' WHEN 1 THEN '../' || event_type WHEN 2 THEN 'a/' || event_type WHEN 3 THEN 'a\\' || event_type ELSE event_type || '..png' END AS name FROM events) SELECT event_id, event_id % 5 IN (0) AS ok FROM n")
def safe_names(spark, sf_dir):
    """Which file names stay within their folder: no separators and no dots in a row."""
    t = F.col("event_type")
    name = F.when(F.col("event_id") % 5 == 0, F.concat(t, F.lit(".jpg"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("../"), t)).when(F.col("event_id") % 5 == 2, F.concat(F.lit("a/"), t)).when(F.col("event_id") % 5 == 3, F.concat(F.lit("a\\"), t)).otherwise(F.concat(t, F.lit("..png")))
    return table(spark, sf_dir, "events").select("event_id", files.safe_name(name).alias("ok"))


@query(f"WITH {_OBS}, fl AS (SELECT seq_id, lane, count(*) FILTER (WHERE k % 4 > 0) AS some, avg(CASE WHEN k % 4 > 0 THEN (k % 7) / 1e2 END) AS dv, avg(CASE WHEN k % 4 > 0 THEN k / 1e2 END) AS ur, avg(CASE WHEN k % 4 > 0 THEN CAST(k % 5 AS DOUBLE) END) AS tm FROM d GROUP BY seq_id, lane), t AS (SELECT seq_id, lane, {_features_sql()} FROM w GROUP BY seq_id, lane), y AS (SELECT seq_id, lane, n, coalesce(dv, 0) AS dv, coalesce(ur, 0) AS ur, coalesce(tm, 0) AS tm, growth >= 1e-4 AND mono >= 55e-2 AS area_ok FROM t JOIN fl USING (seq_id, lane)) SELECT seq_id, lane, round(dv, 9) AS flow_divergence, round(ur, 9) AS flow_upward_ratio, round(tm, 9) AS flow_translation_mag, CASE WHEN ur >= 55e-2 AND dv >= 2e-2 AND area_ok AND n >= 12 THEN 'FLARE' WHEN ur >= 55e-2 AND dv >= 2e-2 OR area_ok THEN 'GLOW' ELSE 'SPARK' END AS tier FROM y")
def dense_tracks(spark, sf_dir):
    """Tracks judged by flow, as sequences with many frames a second are."""
    flow = lambda c: F.when(F.col("k") % 4 > 0, c)
    d = detections(spark, sf_dir, numbered=True).withColumns({"divergence": flow((F.col("k") % 7) / 100.0), "upward_ratio": flow(F.col("k") / 100.0), "translation_mag": flow((F.col("k") % 5).cast("double"))})
    # a mean that is the threshold falls on either side by the order of its sum, so that order is stated: the events' own, as in SQL
    so_far = Window.partitionBy("seq_id", "lane").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    means = {f: F.max_by(f, "place") for f in rules.flow_features()}
    t = rules.observations(d.withColumns(rules.flow_features(so_far))).groupBy("seq_id", "lane").agg(*(c.alias(k) for k, c in {**rules.features(), **means}.items()))
    x = t.withColumn("tier", rules.tier(*rules.criteria("dense"), F.lit(True)))
    return x.select("seq_id", "lane", *(_r(F.col(c), 9).alias(c) for c in ("flow_divergence", "flow_upward_ratio", "flow_translation_mag")), "tier")


@query(f"WITH {SQL}, b AS (SELECT seq_id, lane, (k + (k * 3) % 17 + (k * 5) % 23 + (k * 7) % 11) / 4e0 / 255 AS bright FROM d WHERE k % 6 > 0) SELECT seq_id, lane, CASE WHEN count(*) >= 2 AND avg(bright) > 1e-6 THEN round(stddev_pop(bright) / avg(bright), 9) ELSE 0 END AS intensity_flicker FROM b GROUP BY seq_id, lane")
def patch_flicker(spark, sf_dir):
    """How much the brightness of a track's image patches changes; some detections have no patch."""
    cells = [F.col("k"), F.col("k") * 3 % 17, F.col("k") * 5 % 23, F.col("k") * 7 % 11]
    patch = F.when(F.col("k") % 6 > 0, F.array(*((c / 255.0) for c in cells)))
    return rules.appearance(detections(spark, sf_dir).withColumn("patch", patch), ("seq_id", "lane"), 2).select("seq_id", "lane", _r(F.col("intensity_flicker"), 9).alias("intensity_flicker"))


@query(f"WITH {_EVENTS}, x AS (SELECT id, tier, seq_id, lane, k, lat, lon FROM e WHERE tier <> 'SPARK') SELECT id, '▲ ' || tier || ' 경보 — ' || CASE WHEN seq_id % 5 = 0 THEN '현장' ELSE 's' || seq_id END || chr(10) || '  ' || CASE WHEN k % 4 > 0 THEN printf('%.4fN %.4fE (오차반경 %.0fm, 사거리 %sm)', round(lat, 4), round(lon, 4), CAST(k AS DOUBLE), CASE WHEN k >= 1 THEN (k * 37 + 1000) // 1000 || ',' || lpad(CAST((k * 37 + 1000) % 1000 AS VARCHAR), 3, '0') END) ELSE '좌표 미발행 (grazing) — 영상 확인 필요' END || CASE WHEN k % 4 > 0 THEN printf(' / 최근접 진화대 %.1fkm', k / 2e0) ELSE '' END AS text FROM x WHERE k > 0")
def alert_texts(spark, sf_dir):
    """The two lines that go out with an event."""
    e = stored_events(spark, sf_dir).where("tier <> 'SPARK' AND k > 0")
    ok = F.col("k") % 4 > 0
    x = e.select("id", "tier", F.when(F.col("seq_id") % 5 == 0, "").otherwise(F.concat(F.lit("s"), "seq_id")).alias("site"), ok.alias("geo_ok"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.col("k").cast("double").alias("cep50_m"), (F.col("k") * 37 + 1000).cast("double").alias("range_m"), F.lit("grazing").alias("geo_reject_reason"), F.when(ok, F.col("k") / 2.0).alias("nearest_unit_km"))
    return x.select("id", alerts.alert_text().alias("text"))


@query(f"WITH {SQL} SELECT det_id, round(lat, 12) AS lat, round(lon, 12) AS lon, CASE WHEN det_id % 3 > 0 THEN 4326 END AS srid, TRUE AS exact FROM d")
def point_codec(spark, sf_dir):
    """Places as binary points of either byte order, with and without SRID, and back: not a bit is lost."""
    d = detections(spark, sf_dir).select("det_id", "lat", "lon")
    made = [cells.to_ewkb(F.col("lat"), F.col("lon"), little, srid) for little in (True, False) for srid in (None, cells.WGS84)]
    pick = F.when(F.col("det_id") % 3 > 0, F.when(F.col("det_id") % 2 == 0, made[1]).otherwise(made[3])).otherwise(F.when(F.col("det_id") % 2 == 0, made[0]).otherwise(made[2]))
    back = d.withColumn("point", pick).select("det_id", F.col("lat").alias("a"), F.col("lon").alias("b"), *(c.alias(n) for n, c in cells.from_ewkb(F.col("point")).items()))
    return back.select("det_id", _r(F.col("lat"), 12).alias("lat"), _r(F.col("lon"), 12).alias("lon"), "srid", ((F.col("a") == F.col("lat")) & (F.col("b") == F.col("lon"))).alias("exact"))


_CHANGES = f"""{_EVENTS}, now AS (SELECT CAST(seq_id AS VARCHAR) AS site, max(id) AS largest, count(*) AS events, count(*) FILTER (WHERE label <> 'unlabelled') AS labels, count(*) FILTER (WHERE id % 5 = 0 AND seq_id % 2 = 0) AS responses FROM e GROUP BY seq_id),
seen AS (SELECT CAST(seq_id AS VARCHAR) AS site, max(id) AS largest, count(*) AS events, count(*) FILTER (WHERE label <> 'unlabelled' AND id % 2 = 0) AS labels, count(*) FILTER (WHERE id % 5 = 0 AND seq_id % 2 = 0) AS responses FROM e WHERE seq_id % 4 > 0 OR id % 7 > 0 GROUP BY seq_id),
chg AS (SELECT now.*, now.largest <> coalesce(seen.largest, 0) OR now.events <> coalesce(seen.events, 0) AS a, now.labels <> coalesce(seen.labels, 0) AS b, now.responses <> coalesce(seen.responses, 0) AS c FROM now LEFT JOIN seen USING (site))"""


@query(f"WITH {_CHANGES} SELECT site, array_to_string(list_filter([CASE WHEN a THEN 'events' END, CASE WHEN b THEN 'labels' END, CASE WHEN c THEN 'responses' END], lambda x: x IS NOT NULL), ',') AS what, largest, events, labels, responses FROM chg WHERE a OR b OR c")
def site_changes(spark, sf_dir):
    """What a feed sends: sites whose events, labels or responses aren't as they were when it was last asked."""
    e = stored_events(spark, sf_dir).withColumn("site", F.col("seq_id").cast("string"))
    labelled, answered = e.where("label <> 'unlabelled'"), e.where("id % 5 = 0 AND seq_id % 2 = 0")
    seen = store.site_state(e.where("seq_id % 4 > 0 OR id % 7 > 0"), labelled.where("id % 2 = 0"), answered)
    return store.changed(store.site_state(e, labelled, answered), seen).withColumn("what", F.array_join("what", ","))


_E2, _EP2 = repr(geo.E2), repr(geo.EP2)
_LINE = "ox + {k} * dx AS x, oy + {k} * dy AS y, oz + {k} * dz AS z"


def _on_earth_sql(source: str) -> str:
    """source(..., x, y, z) with h, row and col on the grid of the terrain."""
    return f"""(SELECT *, rr / cos(la) - 6378137e0 / sqrt(1 - {_E2} * sin(la) * sin(la)) AS h, (36412700e-6 + 35e-2 - degrees(la)) / (1e0 / 1200) - 5e-1 AS r, (degrees(atan2(y, x)) - (128704300e-6 - 35e-2)) / (1e0 / 1200) - 5e-1 AS c
  FROM (SELECT *, atan2(z + {_EP2} * {geo.B!r} * power(sin(tt), 3), rr - {_E2} * 6378137e0 * power(cos(tt), 3)) AS la FROM (SELECT *, sqrt(x * x + y * y) AS rr, atan2(z * 6378137e0, sqrt(x * x + y * y) * {geo.B!r}) AS tt FROM {source})))"""


_P = crossing.phases(7)
_RAW = " + ".join(f"{w!r} * sin({f!r} * ((i + 5e-1) * (1e0 / 1200) * 100) + {_P[2 * k]!r}) * cos({f!r} * ((j + 5e-1) * (1e0 / 1200) * 100) + {_P[2 * k + 1]!r})" for k, (w, f) in enumerate(((1.0, 0.3), (0.5, 0.7), (0.25, 1.5))))
_OVER = "q.a + (p.c - q.j) * (q.b - q.a) + (p.r - q.i) * ((q.cc + (p.c - q.j) * (q.dd - q.cc)) - (q.a + (p.c - q.j) * (q.b - q.a)))"
def crossing_sql(aim: str, where: str = "TRUE") -> str:
    """Tables up to seen and spot of the rays that aim gives: det_id, p and q (radians), alt, a and b (the pixel over the focal
    length), yw and pt (radians). The terrain is there before aim, as quad."""
    return f"""raw AS (SELECT CAST(g // 840 AS INT) AS i, CAST(g % 840 AS INT) AS j, 0e0 + {_RAW} AS z FROM (SELECT n // 840 * 840 + n % 840 AS g, n // 840 AS i, n % 840 AS j FROM range(705600) t(n))),
bound AS (SELECT min(z) AS lo, max(z) AS hi FROM raw), hgt AS (SELECT i, j, 200e0 + 600e0 * (z - lo) / (hi - lo) AS z FROM raw, bound),
half AS (SELECT i, j, z AS a, lead(z) OVER (PARTITION BY i ORDER BY j) AS b FROM hgt),
quad AS MATERIALIZED (SELECT * FROM (SELECT i, j, a, b, lead(a) OVER (PARTITION BY j ORDER BY i) AS cc, lead(b) OVER (PARTITION BY j ORDER BY i) AS dd FROM half) WHERE b IS NOT NULL AND cc IS NOT NULL),
aim AS ({aim}),
unit AS (SELECT *, (a * cos(yw) + b * sin(yw) * sin(pt) + sin(yw) * cos(pt)) / sqrt(a * a + b * b + 1) AS e, (-a * sin(yw) + b * cos(yw) * sin(pt) + cos(yw) * cos(pt)) / sqrt(a * a + b * b + 1) AS n, (sin(pt) - b * cos(pt)) / sqrt(a * a + b * b + 1) AS u, 6378137e0 / sqrt(1 - {_E2} * sin(p) * sin(p)) AS nn FROM aim),
ray AS MATERIALIZED (SELECT det_id, alt, -u AS down, (nn + alt) * cos(p) * cos(q) AS ox, (nn + alt) * cos(p) * sin(q) AS oy, (nn * (1 - {_E2}) + alt) * sin(p) AS oz, -sin(q) * e - sin(p) * cos(q) * n + cos(p) * cos(q) * u AS dx, cos(q) * e - sin(p) * sin(q) * n + cos(p) * sin(q) * u AS dy, cos(p) * n + sin(p) * u AS dz FROM unit WHERE {where}),
smp AS (SELECT *, {_LINE.format(k='k * 2e1')} FROM (SELECT *, unnest(range(0, 751)) AS k FROM ray) WHERE k = 0 OR down <= 1e-3 OR (k * 2e1 * down >= alt - 801 - 20 AND k * 2e1 * down <= alt - 199 + 40)),
seen AS MATERIALIZED (SELECT det_id, min(k) FILTER (WHERE p.h - ({_OVER}) <= 0) AS hit, min(k) FILTER (WHERE q.a IS NULL) AS gone FROM {_on_earth_sql('smp')} p LEFT JOIN quad q ON q.i = CAST(floor(p.r) AS INT) AND q.j = CAST(floor(p.c) AS INT) GROUP BY det_id),
bis AS (SELECT ray.*, (hit - 1) * 2e1 AS lo, hit * 2e1 AS hi, 0 AS step FROM ray JOIN seen USING (det_id) WHERE hit >= 1 AND (gone IS NULL OR hit < gone)
  UNION ALL SELECT det_id, alt, down, ox, oy, oz, dx, dy, dz, CASE WHEN coalesce(p.h - ({_OVER}) > 0, FALSE) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN coalesce(p.h - ({_OVER}) > 0, FALSE) THEN hi ELSE (lo + hi) / 2 END, step + 1
  FROM {_on_earth_sql(f"(SELECT *, {_LINE.format(k='((lo + hi) / 2)')} FROM bis WHERE step < 20)")} p LEFT JOIN quad q ON q.i = CAST(floor(p.r) AS INT) AND q.j = CAST(floor(p.c) AS INT)),
spot AS (SELECT det_id, (lo + hi) / 2 AS far, degrees(la) AS lat, degrees(atan2(y, x)) AS lon, h FROM {_on_earth_sql(f"(SELECT *, {_LINE.format(k='((lo + hi) / 2)')} FROM bis WHERE step = 20)")})"""


_AIM = "SELECT det_id, radians(36412700e-6) AS p, radians(128704300e-6) AS q, 1300e0 + 25e0 * (seq_id % 8) AS alt, ((x1 + x2) / 2 - 960) / (960 / tan(radians(737e-1) / 2)) AS a, ((y1 + y2) / 2 - 540) / (960 / tan(radians(737e-1) / 2)) AS b, radians(k * 36e-1) AS yw, radians(-k * 5e-1 - 2) AS pt FROM d"
_CROSS = f"{SQL}, {crossing_sql(_AIM)}"


@query(f"WITH RECURSIVE {_CROSS} SELECT det_id, CASE WHEN far IS NULL THEN CASE WHEN gone IS NOT NULL OR hit = 0 THEN 'out_of_dem' ELSE 'no_intersection' END END AS reason, round(lat, 7) AS lat, round(lon, 7) AS lon, round(h, 2) AS elevation_m, round(far, 3) AS range_m FROM seen LEFT JOIN spot USING (det_id)")
def ground_crossings(spark, sf_dir):
    """Where the ray of each detection meets the ground, by joins with a terrain that is a table."""
    heights, grid = crossing.synthetic_heights(spark)
    ground = materialize(crossing.cells_of(heights), "cells")
    x = crossing.crossings(run.posed(spark, sf_dir)[1], ground, grid, solve.Camera.from_fov(1920, 1080, 73.7))
    return x.select(F.col("row_id").alias("det_id"), "reason", _r(F.col("lat"), 7).alias("lat"), _r(F.col("lon"), 7).alias("lon"), _r(F.col("elevation_m"), 2).alias("elevation_m"), _r(F.col("range_m"), 3).alias("range_m"))
