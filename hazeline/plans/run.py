"""The whole run as one job: detections, linked tracks, features, tier, place, event, alert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hazeline.functions import rules
from hazeline.operators import crossing, solve, store
from hazeline.session import materialize, task_count
from hazeline.sources.detections import detections
from hazeline.streaming import alerts, tracks

KEYS = ("seq_id", "track_id")
_FEATURES = ["persistence", "duration", "n", "area_growth_rate", "area_monotonicity", "centroid_rise_rate", "drift_rate", "translation_over_growth", "aspect_growth_rate", "confidence_mean", "confidence_slope"]
_PLACE = ["depression", "reason", "lat", "lon", "elevation_m", "range_m", "cep50_m", "cep90_m"]


def verdicts(d: DataFrame, fixes: DataFrame, interval: float | Column = 60.0, mode: str = "sparse", weights: dict[str, float] | None = None, links: DataFrame | None = None, side: int = 48) -> DataFrame:
    """One row for every open track at every frame of its sequence: features of its detections so far, criteria, score, the
    place of its last detection, and the tier: what tracked() has, judged."""
    return judged(tracked(d, fixes, interval, mode, links, side), mode, weights, "patch" in d.columns)


def tracked(d: DataFrame, fixes: DataFrame, interval: float | Column = 60.0, mode: str = "sparse", links: DataFrame | None = None, side: int = 48) -> DataFrame:
    """One row for every open track at every frame of its sequence: features of its detections so far, and the place of the last.

    d holds detections with offset_s, fixes their places by row_id; frames are interval seconds apart. A track that misses a
    frame has again what it had. interval may be a column of d, each sequence's own. links are the rows of tracks.linked, if they
    are there already; further columns of theirs stay. Where d has patch, an array of side x side grey values or null, flicker and
    softness of the patches so far are features too. Detections meet their links and places by id; after that rows are dealt by
    track once, which serves every window.
    """
    links = tracks.linked(d) if links is None else links
    more = [c for c in links.columns if c not in (*KEYS, "frame_index", "det_id", "missed")]
    places = fixes.select(F.col("row_id").alias("det_id"), *_PLACE)
    seen, n = F.col("det_id").isNotNull(), task_count(d.sparkSession)
    x = links.where(seen).join(d.drop("seq_id", "frame_index", *_PLACE), "det_id").join(places, "det_id", "left").repartition(n, *KEYS)
    past = Window.partitionBy(*KEYS).orderBy("offset_s", "det_id").rowsBetween(Window.unboundedPreceding, 0)
    flows = rules.flow_features(past) if mode == "dense" else {}
    x = rules.observations(x, KEYS).withColumns({**rules.features(interval, past), **flows})
    looks = []
    if "patch" in d.columns:
        x, looks = rules.appearance_so_far(x, KEYS, side), ["intensity_flicker", "edge_softness"]
    own = [*KEYS, "frame_index", "missed", *more]
    x = x.select(*own, F.struct("det_id", "x1", "y1", "x2", "y2", "confidence", *_FEATURES, *flows, *looks, *_PLACE).alias("v"))
    x = x.unionByName(links.where(~seen).select(*own).repartition(n, *KEYS), allowMissingColumns=True)
    so_far = Window.partitionBy(*KEYS).orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("v", F.last("v", ignorenulls=True).over(so_far)).select(*own, "v.*")


def verdicts_by_cadence(d: DataFrame, fixes: DataFrame, weights: dict[str, dict[str, float]] | None = None, side: int = 48) -> DataFrame:
    """verdicts(), each sequence in the mode and with the interval that its own frames have, as columns mode and interval.

    Sequences with frames at most a fifth of a second apart are dense: d has divergence, upward_ratio and translation_mag of their
    detections, as flow.residual_flow gives them: zeros of a box that is too small count, nulls don't. Sparse ones have flow features of 0, as they
    count for nothing there. weights are by mode.
    """
    pace = rules.cadence(d).withColumnRenamed("cadence_s", "interval")
    d = d.join(pace, "seq_id").withColumn("mode", rules.mode_of(F.col("interval")))
    links = materialize(tracks.linked(d.drop("interval", "mode")), "links")
    kinds = d.select("seq_id", "interval", "mode").distinct()
    both = [verdicts(d.where(F.col("mode") == m).drop("mode"), fixes, F.col("interval"), m, (weights or {}).get(m), links.join(kinds.where(F.col("mode") == m).select("seq_id"), "seq_id", "left_semi"), side) for m in ("sparse", "dense")]
    v = both[0].unionByName(both[1], allowMissingColumns=True)
    return v.fillna(0.0, ["flow_divergence", "flow_upward_ratio", "flow_translation_mag"]).join(kinds, "seq_id")


def judged(x: DataFrame, mode: str = "sparse", weights: dict[str, float] | None = None, patches: bool = False) -> DataFrame:
    """x, which has a track's features and place, with criteria, score, explanation and tier: columns of a row, in a batch as in
    a stream. Without a place a track with both conditions is GLOW. With patches, flicker and softness count in the score."""
    x = x.withColumn("geo_ok", F.col("lat").isNotNull() & F.col("reason").isNull())
    x = x.withColumn("criteria", rules.evidence(mode)).withColumn("score", rules.score(mode, patches, weights))
    x = x.withColumn("explanation", F.create_map(*(c for k, part in rules.contributions(mode, patches, weights).items() for c in (F.lit(k), part))))
    return x.withColumn("tier", rules.tier(F.col("criteria.flow_ok"), F.col("criteria.area_ok"), F.col("criteria.enough_frames"), F.col("geo_ok")))


def events(v: DataFrame, camera: str | Column, site: str = "site", timestamp: str = "timestamp", also: Sequence[str] = ()) -> DataFrame:
    """Verdicts (with a column for site and timestamp) as events of the 29 columns; ids come when they are stored, if they aren't
    there already. camera is a name, or the column that has it. Columns named in also come after the 29."""
    place = lambda c: F.when(F.col("geo_ok"), F.col(c)).alias(c)
    extra = [c for c in ("flow_divergence", "flow_upward_ratio", "flow_translation_mag", "intensity_flicker", "edge_softness") if c in v.columns]
    return v.select(
        (F.col("id") if "id" in v.columns else F.lit(None).cast("long")).alias("id"), "track_id", "tier", "score", F.col(timestamp).cast("double").alias("timestamp"), F.col(site).cast("string").alias("site"), F.lit(camera).alias("camera"),
        F.array("x1", "y1", "x2", "y2").alias("bbox"), "confidence", F.col("n").cast("long").alias("n_observations"), "geo_ok", *map(place, ("lat", "lon", "elevation_m", "range_m")),
        F.col("depression").alias("depression_deg"), "cep50_m", "cep90_m", F.when(~F.col("geo_ok") & F.col("depression").isNotNull(), F.coalesce("reason", F.lit("unknown"))).alias("geo_reject_reason"),
        F.col("criteria.flow_ok").alias("flow_ok"), F.col("criteria.area_ok").alias("area_ok"), F.col("criteria").cast(store.CRITERIA).alias("criteria"), F.concat(F.col(site).cast("string"), F.format_string("-t%d-f%d", "track_id", "frame_index")).alias("snapshot"),
        F.lit("none").alias("response"), F.array().cast("array<struct<status:string,at:double>>").alias("response_history"), F.lit("unlabelled").alias("label"),
        F.create_map(*(c for k in (*_FEATURES, *extra) for c in (F.lit(k), F.col(k).cast("double")))).alias("features"), "explanation", F.col(timestamp).cast("double").alias("created_at"), *also,
    )


def notified(decided: DataFrame, units: list[tuple[str, float, float]]) -> DataFrame:
    """Events with the decision on each, with the distance to the nearest unit, and the text of what is sent."""
    x = decided.withColumn("nearest_unit_km", F.when(F.col("geo_ok"), alerts.nearest_km(units)))
    return x.withColumn("text", F.when(F.col("decision") == "sent", alerts.alert_text()))


def posed(spark: SparkSession, sf_dir: str, d: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(detections, the same aimed from a camera each): yaw and pitch follow k, and sequences fly at eight heights. d are the
    detections, if they are there already."""
    d = detections(spark, sf_dir) if d is None else d
    pose = {"row_id": F.col("det_id"), "cam_lat": F.lit(36.4127), "cam_lon": F.lit(128.7043), "cam_alt": 1300.0 + 25.0 * (F.col("seq_id") % 8), "yaw": F.col("k") * 3.6, "pitch": -F.col("k") * 0.5 - 2, "roll": F.lit(0.0)}
    return d, solve.aimed(d).withColumns({**pose, "wind_speed": (F.col("k") % 5).cast("double"), "wind_from": F.col("k") * 3.6})


def fixes(spark: SparkSession, sf_dir: str, drift_s: float = 30.0, d: DataFrame | None = None) -> DataFrame:
    camera = solve.Camera.from_fov(1920, 1080, 73.7)
    return solve.solved(posed(spark, sf_dir, d)[1], solve.synthetic(), camera, solve.Solver(drift_s=drift_s))


def whole_run(spark: SparkSession, sf_dir: str, units: list[tuple[str, float, float]]) -> DataFrame:
    """Every event of the table's sequences with the decision on it, its reason, the distance to the nearest unit, and the text of
    what is sent. Tracks are told apart within their site.

    An id follows from time, site and track, so links are numbered while they are narrow. Rows with features are dealt by track once and
    written once; what is a column of a row (criteria, explanation, features as a map, text) is made after the last shuffle, and
    only events that rise meet what suppresses them."""
    d = materialize(detections(spark, sf_dir), "detections")
    named = {"site": F.concat(F.lit("s"), F.col("seq_id")), "timestamp": ((F.col("frame_index") - 16) * 60).cast("double")}
    links = store.numbered(tracks.linked(d).withColumns(named), 0)
    x = tracked(d, materialize(fixes(spark, sf_dir, d=d), "fixes"), links=links)
    tier = judged(x).withColumn("rank", alerts.rank_of("tier"))
    x = materialize(alerts.escalated(tier, KEYS, ("timestamp", "id")).select(*x.columns, "rank", "before"), "tracked")
    rises = alerts.rises()
    up = x.where(rises)
    risen = judged(up).select(F.col("seq_id").alias("site"), "id", F.col("timestamp").alias("at"), "rank", *(F.when(F.col("geo_ok"), F.col(c)).alias(c) for c in ("lat", "lon")))
    up = up.join(alerts.suppressed(alerts.placed(risen)).select("id", "suppressed"), "id", "left")
    decision, why = alerts.decided()
    x = x.where(~rises).unionByName(up, allowMissingColumns=True).withColumns({"decision": decision, "why": why})
    said = [T.StructField(c, T.StringType()) for c in ("decision", "why")]
    e = store.migrated(events(judged(x), "wide", also=("decision", "why")), T.StructType([*store.EVENT, *said]))
    return notified(e.withColumnRenamed("why", "reason"), units)


def configured(d: DataFrame, flown: DataFrame, sites: DataFrame, cameras: DataFrame, cells: DataFrame, grid: crossing.Grid, solver: solve.Solver | None = None, drift_s: float = 0.0, voids: bool = False, **how) -> DataFrame:
    """The verdicts of detections by configuration, with site, camera, units of the site, and nearest_unit_km where there is a place.

    d has yaw, pitch and roll of each detection, and wind_speed, wind_from if drift_s says to move places upwind. flown(seq_id,
    site, camera) says by name which site and camera a sequence is of; sites and cameras are tables as sources.config reads them.
    A camera hangs over its site's point, patrol_m above the ground there. A sequence that flown lacks, or whose site or camera
    isn't configured, stands outside the terrain, or has no focal length, is judged without places, so at most GLOW; so is a
    detection without a pose, as grazing. how goes to verdicts().
    """
    s = crossing.heights_at(sites.select(F.col("name").alias("site"), "lat", "lon", "patrol_m", "units"), cells, grid)
    s = s.select("site", F.col("lat").alias("cam_lat"), F.col("lon").alias("cam_lon"), (F.col("ground") + F.col("patrol_m")).alias("cam_alt"), "units")
    c = cameras.select(F.col("name").alias("camera"), "fx", "fy", "cx", "cy", "lens", "distorted")
    f = materialize(flown.join(s, "site", "left").join(c, "camera", "left"), "flown")
    optics = ["cam_lat", "cam_lon", "cam_alt", "fx", "fy", "cx", "cy", "lens", "distorted"]
    wind = [w for w in ("wind_speed", "wind_from") if w in d.columns]
    rays = solve.aimed(d.select("det_id", "seq_id", "x1", "y1", "x2", "y2", "yaw", "pitch", "roll", *wind), solver).join(f.where("cam_alt IS NOT NULL AND fx IS NOT NULL").select("seq_id", *optics), "seq_id")
    places = crossing.fixed(rays.withColumnRenamed("det_id", "row_id"), cells, grid, None, solver, voids, wind)
    if drift_s > 0 and len(wind) == 2:
        places = solve.drifted(places, drift_s)
    v = verdicts(d.drop("yaw", "pitch", "roll", "lat", "lon", *wind), materialize(places, "fixes"), **how)
    v = v.join(f.select("seq_id", "site", "camera", "units"), "seq_id", "left")
    return v.withColumn("nearest_unit_km", F.when(F.col("geo_ok"), alerts.nearest_of(F.col("units"))))
