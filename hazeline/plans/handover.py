"""Queries of what leaves the engine, each with the SQL of the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hazeline.operators import evaluate, exports, matching
from hazeline.plans.catalog import _EVENTS, _SQL, LAT0, LON0, _matches, _r, query, stored_events
from hazeline.plans.reports import _JUDGED, _keyed_outcomes
from hazeline.session import shared_dir
from hazeline.sources.detections import SQL, detections

_NAMED_EVENTS = "n AS (SELECT id, seq_id, k, CASE WHEN id % 10 = 0 THEN 'poster.jpg' ELSE 's' || seq_id || '-t' || id || '-f' || (k % 40) || '.jpg' END AS snapshot FROM e)"


def _snapshots(spark, sf_dir):
    name = F.concat(F.lit("s"), "seq_id", F.format_string("-t%d-f%d.jpg", "id", F.col("k") % 40))
    return stored_events(spark, sf_dir).select("id", "seq_id", "k", F.when(F.col("id") % 10 == 0, "poster.jpg").otherwise(name).alias("snapshot"))


@query(f"WITH {_EVENTS}, {_NAMED_EVENTS}, fp AS (SELECT DISTINCT 's' || seq_id AS site, frame_index, 'in/s' || seq_id || '/' || frame_index || '.jpg' AS path FROM d) SELECT id, snapshot, path AS frame_path FROM n JOIN fp ON id % 10 > 0 AND site = 's' || seq_id AND frame_index = k % 40")
def event_frames(spark, sf_dir):
    """The frame that each event's snapshot was cut from; events of frames that aren't there fall away."""
    site = F.concat(F.lit("s"), F.col("seq_id").cast("string"))
    f = detections(spark, sf_dir).select(site.alias("site"), "frame_index").distinct().withColumn("path", F.concat(F.lit("in/"), "site", F.lit("/"), F.col("frame_index").cast("string"), F.lit(".jpg")))
    return exports.event_frames(_snapshots(spark, sf_dir), f).select("id", "snapshot", "frame_path")


@query(f"WITH {_EVENTS}, {_NAMED_EVENTS} SELECT id, snapshot AS snapshot_name, CASE WHEN id % 10 > 0 AND id % 3 > 0 THEN 'data:image/jpeg;base64,' || base64(encode('seen at ' || k || repeat('.', CAST(k AS INT)))) END AS snapshot FROM n")
def embedded_snapshots(spark, sf_dir):
    """Events with their snapshots inside; one image in three is missing."""
    n = _snapshots(spark, sf_dir)
    content = F.encode(F.concat(F.lit("seen at "), F.col("k").cast("string"), F.expr("repeat('.', k)")), "utf-8")
    images = n.where("id % 10 > 0 AND id % 3 > 0").select(F.concat(F.lit("shots/"), "snapshot").alias("path"), content.alias("content"))
    return exports.embedded(n.select("id", "snapshot"), images).select("id", "snapshot_name", "snapshot")


@query(f"WITH {_JUDGED} SELECT * FROM outcome WHERE seq_id % 3 = 1")
def subset_counters(spark, sf_dir):
    """The counters of the sequences of a list, which names some twice."""
    names = detections(spark, sf_dir).where("seq_id % 3 = 1").select("seq_id")
    return exports.subset(_keyed_outcomes(spark, sf_dir), names)


@query(_SQL["claims"])
def reported_claims(spark, sf_dir):
    """The claims that saved metric files support: figures are measured, saved, loaded and judged."""
    folder = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    m, truth = _matches(spark, sf_dir)
    exports.save_metrics(evaluate.rollup(_keyed_outcomes(spark, sf_dir)), folder, "alarms")
    exports.save_metrics(matching.baseline(m, truth, detections(spark, sf_dir)), folder, "detector")
    return exports.claims_of(spark, folder).withColumns({c: _r(F.col(c), 9) for c in ("measured", "detail")})


@query(f"WITH {SQL}, t AS (SELECT seq_id % 7 AS s, min(lat) AS lo, min(lon) AS w, max(lat) AS hi, max(lon) AS e FROM d GROUP BY 1), x AS (SELECT *, unnest(range(CAST(floor(lo) AS BIGINT), CAST(floor(hi) AS BIGINT) + 1)) AS south FROM t), y AS (SELECT *, unnest(range(CAST(floor(w) AS BIGINT), CAST(floor(e) AS BIGINT) + 1)) AS west FROM x) SELECT 'site' || s AS name, 'Site ' || s AS label, round(any_value(lo + hi) / 2, 6) AS lat, round(any_value(w + e) / 2, 6) AS lon, count(*) AS n_tiles, count(*) FILTER (WHERE west % 2 = 1 AND s % 2 = 0) AS n_missing, count(*) FILTER (WHERE west % 2 = 1 AND s % 2 = 0) = 0 AS ready FROM y GROUP BY s")
def site_listing(spark, sf_dir):
    """Sites, and whether the terrain of each is there."""
    s, c = (F.col("seq_id") % 7).cast("string"), F.col
    x = detections(spark, sf_dir).groupBy(s.alias("s")).agg(F.min("lat").alias("lo"), F.min("lon").alias("w"), F.max("lat").alias("hi"), F.max("lon").alias("e"))
    sites = x.select(F.concat(F.lit("site"), "s").alias("name"), F.concat(F.lit("Site "), "s").alias("label"), ((c("lo") + c("hi")) / 2).alias("lat"), ((c("w") + c("e")) / 2).alias("lon"), F.array("w", "lo", "e", "hi").alias("bbox"), F.concat(F.lit("dem/"), "s").alias("terrain_dir"))
    there = exports.config.terrain_tiles(sites).where("west % 2 = 0 OR cast(substring(site, 5) AS int) % 2 = 1").select("path")
    return exports.site_listing(sites, there).withColumns({k: _r(c(k)) for k in ("lat", "lon")})


@query(f"WITH {_EVENTS}, sm AS (SELECT count(*) AS total, count(*) FILTER (WHERE tier = 'GLOW' AND label = 'unlabelled') AS queue FROM e), nw AS (SELECT * FROM e ORDER BY id DESC LIMIT 300), bd AS (SELECT min(lon) - 12e-3 AS west, max(lat) + 12e-3 AS north FROM (SELECT lat, lon FROM nw UNION ALL VALUES (36442e-3, 12869e-2))) SELECT id, tier, CASE tier WHEN 'FLARE' THEN '타오름' WHEN 'GLOW' THEN '어른거림' ELSE '스침' END AS tier_label, round(lat, 6) AS lat, total, queue, round(west, 6) AS west, round(north, 6) AS north FROM nw, sm, bd")
def dashboard(spark, sf_dir):
    """The folder that a dashboard shows, written and read: its events beside the summary and the bounds of the map."""
    folder = f"{shared_dir(spark)}/dashboard-{uuid.uuid4().hex}"
    e = stored_events(spark, sf_dir).withColumns({"geo_ok": F.lit(True), "response": F.lit("none")})
    site = spark.createDataFrame([("home", LAT0, LON0, [("north", 36.4420, 128.6900)])], "name string, lat double, lon double, units array<struct<name string, lat double, lon double>>")
    exports.dashboard(e, site, folder)
    read = lambda name, schema: spark.read.schema(schema).json(f"{folder}/{name}").withColumn("_one", F.lit(1))
    x = read("events", "id long, tier string, tier_label string, lat double")
    for row in (read("summary", "total long, queue long"), read("bounds", "west double, north double")):  # a row each
        x = x.join(F.broadcast(row), "_one")
    return x.drop("_one").withColumns({k: _r(F.col(k)) for k in ("lat", "west", "north")})
