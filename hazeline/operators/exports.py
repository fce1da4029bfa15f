"""What leaves the engine: metric files and the report made of them, snapshots in events, and the folder a dashboard shows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.functions import rules
from hazeline.operators import evaluate, store
from hazeline.sources import config, files

#: The columns that claims are made of, by the metric file that has them.
METRICS = {
    "alarms": "frames_before long, fpr_single double, fpr_sequence double, latency_median double, latency_p95 double, dedup_per_hour double, verified_per_hour double, median_time_to_flare double, detection_rate double",
    "detector": "ap50 double, alarm_rate double",
    "sweep": "depression double, n_solved long, cep50_m double",
    "devices": "device string, median_ms double, fps double, place long",
}
#: What stands in for figures that aren't there: those of the sequences held out.
STAND_INS = {"alarms": "alarms_holdout"}
#: Degrees around what a map shows; the newest events that a dashboard gets.
BORDER, NEWEST = 0.012, 300
_BASIS = {
    "place within metres": "perturbed rays over the terrain of a site, 200 a place; the detail is the least depression that meets the target",
    "frame false alarm rate": "frames before ignition, where there is no fire; the detail is the rate of single frames",
    "latency ms": "from detections to tier; neither the reception of the stream nor the network is in it; the detail is the 95th percentile",
    "false alarms an hour": "hours before ignition; the detail is what counting tracks alone would give",
    "seconds to find": "frames a minute apart can't show less than a minute; the detail is the share of sequences found",
    "detector ap50": "labelled images; the detail is the share of images without smoke that it fires on",
    "frames a second": "the fastest device; the detail is its median in milliseconds",
}
_VERDICTS = {"met": "measured, and the target is met", "conditional": "measured, and met under the condition that stands with it", "not met": "measured, and the target isn't met", "not measurable": "these data can't settle it", "for reference": "no target was set"}


def save_metrics(figures: DataFrame, folder: str, name: str) -> None:
    """Figures, a few rows, as the JSON lines of one metric file, in place of what was there."""
    figures.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")


def load_metrics(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame | None:
    """The figures of a metric file; None if it is missing, empty or has a line that isn't JSON. Keys that the schema lacks are
    left, absent ones are null."""
    try:
        lines = spark.read.text(f"{folder}/{name}").where("length(trim(value)) > 0")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    x = lines.select(F.from_json("value", f"{schema or METRICS[name]}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("m"))
    whole, broken = x.agg(F.count("*"), F.count("m._broken")).first()
    return x.select("m.*").drop("_broken") if whole and not broken else None


def claims_of(spark: SparkSession, folder: str) -> DataFrame:
    """The claims that the metric files of a folder support; an error if there are none."""
    found = {}
    for name in METRICS:
        found[name] = load_metrics(spark, folder, name)
        if found[name] is None and name in STAND_INS:
            found[name] = load_metrics(spark, folder, STAND_INS[name], METRICS[name])
    if not any(x is not None for x in found.values()):
        raise FileNotFoundError(f"no metric files below {folder}: measure first, and save_metrics()")
    return evaluate.claims(found["alarms"], found["detector"], found["sweep"], found["devices"])


def document(claims: DataFrame) -> str:
    """The claims, seven rows at most, as a text: a table, what each rests on, and what the verdicts mean."""
    rows = claims.limit(len(_BASIS)).collect()
    out = ["# Measured", "", evaluate.markdown(claims), "", "## What each rests on", ""]
    for r in rows:
        out += [f"- **{r['item']}** ({r['verdict']}): {_BASIS.get(r['item'], '')}"]
    out += ["", "## Verdicts", ""] + [f"- **{k}**: {v}" for k, v in _VERDICTS.items()]
    return "\n".join(out)


def write_report(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """The claims of a folder's metric files, which are also written as a text of one file below `to`."""
    claims = claims_of(spark, folder)
    spark.createDataFrame([(document(claims),)], "value string").coalesce(1).write.mode("overwrite").text(to)
    return claims


def site_listing(sites: DataFrame, there: DataFrame) -> DataFrame:
    """(name, label, lat, lon, n_tiles, n_missing, ready) of sites as sources.config has them: how many terrain tiles the box of
    each needs, and how many aren't among the files there(path). A site without a box needs none, and isn't ready."""
    needed = config.terrain_tiles(sites)
    gone = config.missing_tiles(needed, there).groupBy("site").agg(F.count("*").alias("n_missing"))
    n = needed.groupBy("site").agg(F.count("*").alias("n_tiles")).join(gone, "site", "left").withColumnRenamed("site", "name")
    x = sites.select("name", "label", "lat", "lon").join(n, "name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_tiles", "n_missing")})
    return x.withColumn("ready", (F.col("n_tiles") > 0) & (F.col("n_missing") == 0))


def snapshot_key(snapshot: Column) -> Column:
    """struct(site, track, frame) of a name like s12-t3-f40.jpg; null if it isn't one."""
    pattern = r"^(.+)-t(\d+)-f(\d+)(?:\.[^.]*)?$"
    part = lambda k: F.regexp_extract(snapshot, pattern, k)
    return F.when(snapshot.rlike(pattern), F.struct(part(1).alias("site"), part(2).try_cast("long").alias("track"), part(3).try_cast("long").alias("frame")))


def event_frames(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Events with the path of the frame that their snapshot was cut from, by frames(site, frame_index, path). One whose name
    isn't a snapshot's, or whose frame isn't there, has no row."""
    x = events.withColumn("_key", snapshot_key(F.col("snapshot"))).where("_key IS NOT NULL")
    f = frames.select(F.col("site").alias("_site"), F.col("frame_index").alias("_frame"), F.col("path").alias("frame_path"))
    return x.join(f, (F.col("_key.site") == F.col("_site")) & (F.col("_key.frame") == F.col("_frame"))).drop("_key", "_site", "_frame")


def embedded(events: DataFrame, images: DataFrame, kind: str = "image/jpeg") -> DataFrame:
    """Events whose snapshot, a file name, is replaced by the data URI of the image of that name among images(path, content); null
    where there is no such image, or the name leaves its folder. The name stays as snapshot_name. Of images of one name the
    first by path counts. Images meet the events by a join, so only those that are asked for are encoded."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    asked = events.where(files.safe_name(F.col("snapshot"))).select(F.col("snapshot").alias("_name")).distinct()
    i = images.withColumn("_name", name).join(asked, "_name", "left_semi").groupBy("_name").agg(F.min_by("content", "path").alias("_content"))
    x = events.withColumnRenamed("snapshot", "snapshot_name").join(i, F.col("snapshot_name") == F.col("_name"), "left")
    return x.withColumn("snapshot", F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64("_content"), r"\s", ""))).drop("_name", "_content")


def subset(d: DataFrame, names: DataFrame, key: str = "seq_id") -> DataFrame:
    """Rows of the sequences that names(key) lists; a name that is listed twice counts once."""
    return d.join(names.select(key), key, "left_semi")


def bounds(events: DataFrame, units: DataFrame, border: float = BORDER) -> DataFrame:
    """(west, south, east, north) around the events with a place and the units(lat, lon); nulls without any."""
    at = events.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon").unionByName(units.select("lat", "lon"))
    return at.agg((F.min("lon") - border).alias("west"), (F.min("lat") - border).alias("south"), (F.max("lon") + border).alias("east"), (F.max("lat") + border).alias("north"))


def dashboard(events: DataFrame, site: DataFrame, folder: str, images: DataFrame | None = None, animations: DataFrame | None = None, newest: int = NEWEST) -> None:
    """Writes what a dashboard without a server shows: below the folder, JSON lines in events (the newest, with words, colours and
    snapshots), summary (counts over all events, and the scorer's gates), site, bounds and, if there are any, animations.

    events are those of the store; site is one row of sources.config.sites; images(path, content) are the snapshots' files.
    """
    shown = store.public(store.listed(events, limit=newest))
    if images is not None:
        shown = embedded(shown, images)
    out = {
        "events": shown, "site": site, "bounds": bounds(shown.where("geo_ok"), site.select(F.explode("units").alias("u")).select("u.lat", "u.lon")),
        "summary": store.summary(events).withColumn("scorer", F.struct(F.lit(False).alias("fitted"), F.lit("sparse").alias("mode"), F.lit(rules.FLARE_SCORE).alias("tau_high"), F.lit(rules.GLOW_SCORE).alias("tau_low"))),
    }
    if animations is not None:
        out["animations"] = animations
    for name, x in out.items():
        x.write.mode("overwrite").json(f"{folder}/{name}")
