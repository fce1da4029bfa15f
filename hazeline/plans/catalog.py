"""The registered queries over detections, tracks and stored events, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazeline.functions import cells
from hazeline.functions import geodesy as geo
from hazeline.functions import geometry as g
from hazeline.functions import rules
from hazeline.operators import learn, matching, solve, store
from hazeline.plans import run
from hazeline.session import materialize, shared_dir
from hazeline.sources.detections import SQL, detections
from hazeline.streaming import alerts, tracks

_SQL: dict[str, str] = {}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LAT0, LON0, H0 = 36.4127, 128.7043, 620.0
UNITS = [("north", 36.4420, 128.6900), ("south", 36.3850, 128.7480)]
SLOPES = ["area_growth_rate", "centroid_rise_rate", "drift_rate", "aspect_growth_rate", "confidence_slope"]


def query(sql: str | None = None):
    def take(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return take


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _rounded(t: DataFrame, columns: list[str]) -> DataFrame:
    """Slopes are scaled before rounding, so that the last bits of two engines don't show."""
    return t.withColumns({c: _r(F.col(c) * 1e4) if c in SLOPES else _r(F.col(c), 9 if c == "confidence_mean" else 6) for c in columns})


@query(f"WITH {SQL} SELECT det_id, round(x2 - x1, 6) AS width, round(y2 - y1, 6) AS height, round((x2 - x1) * (y2 - y1), 6) AS area, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(y2, 6) AS base_y FROM d")
def box_algebra(spark, sf_dir):
    x, y = g.center()
    return detections(spark, sf_dir).select("det_id", _r(g.width()).alias("width"), _r(g.height()).alias("height"), _r(g.area()).alias("area"), _r(x).alias("cx"), _r(y).alias("cy"), _r(F.col("y2")).alias("base_y"))


@query(f"WITH {SQL} SELECT lane, count(*) AS n, round(avg(confidence), 6) AS mean FROM d WHERE confidence >= 2e-1 + 30 * 78e-4 GROUP BY lane")
def confidence_filter(spark, sf_dir):
    return detections(spark, sf_dir).where(F.col("confidence") >= 0.20 + 30 * 0.0078).groupBy("lane").agg(F.count("*").alias("n"), _r(F.avg("confidence")).alias("mean"))


_PAIR = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"


@query(f"WITH {SQL}, p AS (SELECT a.det_id AS left_id, b.det_id AS right_id, {_PAIR} AS x, {_AREA.format('a')} AS m, {_AREA.format('b')} AS n FROM d a JOIN d b ON a.seq_id = b.seq_id AND a.frame_index = b.frame_index AND a.det_id < b.det_id) SELECT left_id, right_id, round(CASE WHEN m + n - x > 0 THEN x / (m + n - x) ELSE 0 END, 6) AS iou FROM p")
def iou_pairs(spark, sf_dir):
    d = detections(spark, sf_dir)
    box = lambda p: d.select("seq_id", "frame_index", *(F.col(c).alias(p + c) for c in ("det_id", "x1", "y1", "x2", "y2")))
    pairs = box("a_").join(box("b_"), ["seq_id", "frame_index"]).where("a_det_id < b_det_id")
    return pairs.select(F.col("a_det_id").alias("left_id"), F.col("b_det_id").alias("right_id"), _r(g.iou("a_", "b_")).alias("iou"))


_AFF = "CASE WHEN iou >= 1e-1 THEN 1 + iou WHEN far <= 15e-1 * greatest(sqrt(m), 1) THEN 1 - far / (15e-1 * greatest(sqrt(m), 1)) ELSE 0 END"


@query(f"WITH {SQL}, p AS (SELECT a.det_id AS from_id, b.det_id AS to_id, {_PAIR} AS x, {_AREA.format('a')} AS m, {_AREA.format('b')} AS n, sqrt(power((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + power((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) AS far FROM d a JOIN d b ON a.seq_id = b.seq_id AND a.frame_index + 1 = b.frame_index), q AS (SELECT *, x / (m + n - x) AS iou FROM p), r AS (SELECT from_id, to_id, round({_AFF}, 6) AS affinity FROM q) SELECT * FROM r WHERE affinity > 0")
def frame_affinity(spark, sf_dir):
    d = detections(spark, sf_dir)
    box = lambda p, shift: d.select("seq_id", (F.col("frame_index") + shift).alias("frame"), *(F.col(c).alias(p + c) for c in ("det_id", "x1", "y1", "x2", "y2")))
    pairs = box("a_", 1).join(box("b_", 0), ["seq_id", "frame"])
    return pairs.select(F.col("a_det_id").alias("from_id"), F.col("b_det_id").alias("to_id"), _r(g.affinity("a_", "b_")).alias("affinity")).where("affinity > 0")


@query(f"WITH {SQL}, s AS (SELECT det_id, x2 - x1 AS w, y2 - y1 AS h, least(1024e0 / ((x2 - x1) * 4), 1024e0 / ((y2 - y1) * 3)) AS k FROM d) SELECT det_id, round(k, 6) AS scale, CAST(floor((1024 - round_even(w * 4 * k, 0)) / 2) AS BIGINT) AS pad_x, CAST(floor((1024 - round_even(h * 3 * k, 0)) / 2) AS BIGINT) AS pad_y FROM s")
def letterbox(spark, sf_dir):
    k, x, y = g.letterbox(g.width() * 4, g.height() * 3)
    return detections(spark, sf_dir).select("det_id", _r(k).alias("scale"), x.cast("long").alias("pad_x"), y.cast("long").alias("pad_y"))


@query(f"WITH {SQL}, tm AS (SELECT DISTINCT seq_id, offset_s FROM d), st AS (SELECT seq_id, offset_s - lag(offset_s) OVER (PARTITION BY seq_id ORDER BY offset_s) AS step FROM tm), m AS (SELECT *, min(step) OVER (PARTITION BY seq_id) AS least FROM st WHERE step > 0) SELECT t.seq_id, coalesce(max(c), 1) AS cadence_s FROM (SELECT DISTINCT seq_id FROM tm) t LEFT JOIN (SELECT seq_id, quantile_cont(step, 0.5) AS c FROM m WHERE step <= 2 * least GROUP BY seq_id) USING (seq_id) GROUP BY t.seq_id")
def cadence(spark, sf_dir):
    """Median of the positive steps of at most twice the least; 1 where there is none."""
    return rules.cadence(detections(spark, sf_dir))


_OBS = f"""{SQL},
o AS (SELECT *, greatest((x2 - x1) * (y2 - y1), 1) AS area, (x1 + x2) / 2 AS ox, (y1 + y2) / 2 AS oy, ln(greatest(y2 - y1, 1) / greatest(x2 - x1, 1)) AS aspect FROM d),
w AS (SELECT *, CASE WHEN lag(area) OVER q IS NULL THEN NULL WHEN area > lag(area) OVER q THEN 1e0 ELSE 0e0 END AS grew FROM o WINDOW q AS (PARTITION BY seq_id, lane ORDER BY offset_s, det_id))"""


def _features_sql(over: str = "") -> str:
    s = lambda y: f"CASE WHEN count(*){over} >= 2 AND var_pop(offset_s){over} * count(*){over} >= 1e-12 THEN regr_slope({y}, offset_s){over} ELSE 0 END"
    return f"""count(*){over} AS n, max(offset_s){over} - min(offset_s){over} AS duration, avg(sqrt(area)){over} AS side, {s('ln(area)')} AS growth, {s('ox')} AS dx, {s('oy')} AS dy,
 {s('aspect')} AS asp, {s('confidence')} AS cs, avg(confidence){over} AS cm, coalesce(avg(grew){over}, 0) AS mono"""


_NAMED = """SELECT {key}, n, duration, least(1, n / greatest(1, duration / 60 + 1)) AS persistence, growth AS area_growth_rate, mono AS area_monotonicity, -dy / greatest(side, 1) AS centroid_rise_rate,
 abs(dx) / greatest(side, 1) AS drift_rate, sqrt(dx * dx + dy * dy) / greatest(side, 1) / (abs(growth) + 1e-3) AS translation_over_growth, asp AS aspect_growth_rate, cm AS confidence_mean, cs AS confidence_slope FROM {source}"""
_OUT = """n, round(duration, 6) + 0e0 AS duration, round(persistence, 6) + 0e0 AS persistence, round(area_growth_rate * 1e4, 6) + 0e0 AS area_growth_rate, round(area_monotonicity, 6) + 0e0 AS area_monotonicity,
 round(centroid_rise_rate * 1e4, 6) + 0e0 AS centroid_rise_rate, round(drift_rate * 1e4, 6) + 0e0 AS drift_rate, round(CASE WHEN n >= 2 THEN translation_over_growth ELSE 0 END, 6) + 0e0 AS translation_over_growth,
 round(aspect_growth_rate * 1e4, 6) + 0e0 AS aspect_growth_rate, round(confidence_mean, 9) + 0e0 AS confidence_mean, round(confidence_slope * 1e4, 6) + 0e0 AS confidence_slope"""
_MET = "CAST(centroid_rise_rate >= 1e-4 AS INT) + CAST(area_growth_rate >= 1e-4 AND area_monotonicity >= 55e-2 AS INT)"
_LOGIT = "-5e-1 + 12e-1 * (persistence - 5e-1) / 3e-1 + area_growth_rate / 1e-3 + 8e-1 * (area_monotonicity - 5e-1) / 25e-2 + 8e-1 * centroid_rise_rate / 1e-3 - 7e-1 * CASE WHEN n >= 2 THEN translation_over_growth ELSE 0 END / 50 + 3e-1 * aspect_growth_rate / 1e-3 - 4e-1 - 3e-1 * 5e-1 / 2e-1 + 8e-1 * (confidence_mean - 4e-1) / 2e-1 + 3e-1 * confidence_slope / 1e-3"
_TRACKS = f"""{_OBS}, t AS (SELECT seq_id, lane, {_features_sql()} FROM w GROUP BY seq_id, lane), v AS ({_NAMED.format(key='seq_id, lane', source='t')}),
u AS (SELECT *, {_MET} AS met, 1 / (1 + exp(-least(greatest({_LOGIT}, -50), 50))) AS score, CASE WHEN {_MET} = 2 AND n >= 3 THEN 'FLARE' WHEN {_MET} >= 1 THEN 'GLOW' ELSE 'SPARK' END AS tier FROM v)"""


def _tracks(spark, sf_dir) -> DataFrame:
    t = rules.observations(detections(spark, sf_dir)).groupBy("seq_id", "lane").agg(*(c.alias(k) for k, c in rules.features().items()))
    motion, area, enough = rules.criteria()
    return t.withColumns({"score": rules.score(), "tier": rules.tier(motion, area, enough, F.lit(True)), "met": motion.cast("int") + area.cast("int")})


@query(f"WITH {_TRACKS} SELECT seq_id, lane, {_OUT}, met, round(score, 6) AS score, tier FROM u")
def keyed_tracks(spark, sf_dir):
    """Features, rule, score and tier of every track."""
    t = _tracks(spark, sf_dir)
    return _rounded(t, [c for c in t.columns if c not in ("seq_id", "lane", "n", "tier", "met")])


@query(f"WITH {_OBS}, t AS (SELECT det_id, {_features_sql(' OVER (PARTITION BY seq_id, lane ORDER BY offset_s, det_id ROWS UNBOUNDED PRECEDING)')} FROM w), v AS ({_NAMED.format(key='det_id', source='t')}) SELECT det_id, {_OUT}, CASE WHEN {_MET} = 2 AND n >= 3 THEN 'FLARE' WHEN {_MET} >= 1 THEN 'GLOW' ELSE 'SPARK' END AS tier FROM v")
def prefix_features(spark, sf_dir):
    """Features at every observation from those so far, as an online run sees them."""
    past = Window.partitionBy("seq_id", "lane").orderBy("offset_s", "det_id").rowsBetween(Window.unboundedPreceding, 0)
    t = rules.observations(detections(spark, sf_dir)).select("det_id", *(c.alias(k) for k, c in rules.features(over=past).items()))
    return _rounded(t.withColumn("tier", rules.tier(*rules.criteria(), F.lit(True))), [c for c in t.columns if c not in ("det_id", "n")])


@query(f"WITH {_OBS}, l AS (SELECT *, max(offset_s) OVER (PARTITION BY seq_id, lane) AS latest FROM w) SELECT seq_id, lane, count(*) AS n, round(avg(confidence), 6) AS confidence_mean, round(max(area), 6) AS peak_area FROM l WHERE offset_s >= latest - 300 GROUP BY seq_id, lane")
def trailing_window(spark, sf_dir):
    """The last 300 seconds of each track, counted from its last observation, inclusive."""
    o = rules.observations(detections(spark, sf_dir)).withColumn("latest", F.max("offset_s").over(Window.partitionBy("seq_id", "lane")))
    return o.where(F.col("offset_s") >= F.col("latest") - 300).groupBy("seq_id", "lane").agg(F.count("*").alias("n"), _r(F.avg("confidence")).alias("confidence_mean"), _r(F.max("area")).alias("peak_area"))


@query(f"WITH {_TRACKS}, parts AS (SELECT unnest(['persistence', 'area_growth_rate', 'area_monotonicity', 'centroid_rise_rate', 'translation_over_growth', 'aspect_growth_rate', 'confidence_mean', 'confidence_slope']) AS feature, unnest([12e-1 * (persistence - 5e-1) / 3e-1, area_growth_rate / 1e-3, 8e-1 * (area_monotonicity - 5e-1) / 25e-2, 8e-1 * centroid_rise_rate / 1e-3, -7e-1 * CASE WHEN n >= 2 THEN translation_over_growth ELSE 0 END / 50, 3e-1 * aspect_growth_rate / 1e-3, 8e-1 * (confidence_mean - 4e-1) / 2e-1, 3e-1 * confidence_slope / 1e-3]) AS part, seq_id, lane FROM u), ranked AS (SELECT *, row_number() OVER (PARTITION BY seq_id, lane ORDER BY round(abs(part), 6) DESC, feature) AS place FROM parts) SELECT seq_id, lane, feature, round(part, 6) + 0e0 AS part, place FROM ranked WHERE place <= 3")
def top_contributions(spark, sf_dir):
    """The three features that move each track's score most."""
    parts = {k: c for k, c in rules.contributions().items() if k not in ("intensity_flicker", "edge_softness")}
    x = _tracks(spark, sf_dir).select("seq_id", "lane", F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), c.alias("part")) for k, c in parts.items()))).alias("x")).select("seq_id", "lane", "x.*")
    place = F.row_number().over(Window.partitionBy("seq_id", "lane").orderBy(_r(F.abs("part")).desc(), "feature"))
    return x.withColumn("place", place.cast("long")).where("place <= 3").withColumn("part", _r(F.col("part")))


_EVENTS = f"""{_TRACKS}, e AS (SELECT last.det_id AS id, u.seq_id, u.lane, tier, round(score, 6) AS score, last.offset_s AS at, last.lat, last.lon, last.k, CASE WHEN last.k % 10 < 3 THEN 'confirmed' WHEN last.k % 10 < 6 THEN 'false_positive' ELSE 'unlabelled' END AS label
  FROM u JOIN (SELECT *, row_number() OVER (PARTITION BY seq_id, lane ORDER BY offset_s DESC, det_id DESC) AS nth FROM d) last ON u.seq_id = last.seq_id AND u.lane = last.lane AND nth = 1)"""


def stored_events(spark, sf_dir) -> DataFrame:
    """One stored event a track: its last detection, tier, score and operator label."""
    d = detections(spark, sf_dir)
    last = d.groupBy("seq_id", "lane").agg(F.max_by(F.struct("det_id", "offset_s", "lat", "lon", "k"), F.struct("offset_s", "det_id")).alias("x")).select("seq_id", "lane", "x.*")
    t = _tracks(spark, sf_dir).select("seq_id", "lane", "tier", _r(F.col("score")).alias("score"))
    mark = F.col("k") % 10
    label = F.when(mark < 3, "confirmed").when(mark < 6, "false_positive").otherwise("unlabelled")
    return t.join(last, ["seq_id", "lane"]).select(F.col("det_id").alias("id"), "seq_id", "lane", "tier", "score", F.col("offset_s").alias("at"), "lat", "lon", "k", label.alias("label"))


@query(f"WITH {_EVENTS} SELECT id, tier, score, label FROM e WHERE tier = 'FLARE' ORDER BY id DESC LIMIT 200")
def event_list(spark, sf_dir):
    return store.listed(stored_events(spark, sf_dir), tier="FLARE").select("id", "tier", "score", "label")


@query(f"WITH {_EVENTS} SELECT tier, count(*) AS n FROM e GROUP BY tier")
def counts_by_tier(spark, sf_dir):
    return store.counts_by_tier(stored_events(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT seq_id, id, lane, tier FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY id DESC) AS nth FROM e) WHERE nth = 1")
def latest_for_sequence(spark, sf_dir):
    return store.latest(stored_events(spark, sf_dir), ["seq_id"]).select("seq_id", "id", "lane", "tier")


@query(f"WITH {_EVENTS} SELECT id, label, tier, score FROM e WHERE label <> 'unlabelled'")
def labelled_events(spark, sf_dir):
    return stored_events(spark, sf_dir).where("label <> 'unlabelled'").select("id", "label", "tier", "score")


@query(f"WITH {SQL} SELECT seq_id, lane, label, n_changes FROM (SELECT seq_id, lane, CASE WHEN k % 10 < 3 THEN 'confirmed' WHEN k % 10 < 6 THEN 'false_positive' ELSE 'unlabelled' END AS label, count(*) OVER (PARTITION BY seq_id, lane) AS n_changes, row_number() OVER (PARTITION BY seq_id, lane ORDER BY offset_s DESC, det_id DESC) AS nth FROM d) WHERE nth = 1")
def label_overlay(spark, sf_dir):
    """The current label of each track from an append-only label log: the last entry stands."""
    d = detections(spark, sf_dir)
    log = d.select("seq_id", "lane", F.when(F.col("k") % 10 < 3, "confirmed").when(F.col("k") % 10 < 6, "false_positive").otherwise("unlabelled").alias("label"), F.struct("offset_s", "det_id").alias("seq"))
    return store.current(log, ["seq_id", "lane"], "label", "seq")


@query(f"WITH {SQL}, l AS (SELECT seq_id, lane, det_id, k % 4 AS status, offset_s + 30 * (k % 4) AS said FROM d), m AS (SELECT *, max(status) OVER (PARTITION BY seq_id, lane ORDER BY said, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM l) SELECT seq_id, lane, max(status) AS status, count(*) FILTER (WHERE status > coalesce(best, 0)) AS n_changes, max(said) FILTER (WHERE status > coalesce(best, 0)) AS changed_at FROM m GROUP BY seq_id, lane")
def response_log(spark, sf_dir):
    """Responses only move forward: entries that don't raise the status are refused."""
    log = detections(spark, sf_dir).select("seq_id", "lane", "det_id", (F.col("k") % 4).alias("status"), (F.col("offset_s") + 30 * (F.col("k") % 4)).alias("at"))
    return store.responses(log, ["seq_id", "lane"]).drop("history")


_ENU = """(SELECT *, radians(lat) AS p, radians(lon) AS q, radians(3641270e-5) AS p0, radians(12870430e-5) AS q0 FROM {src})"""
_ECEF = """(SELECT *, 6378137e0 / sqrt(1 - 6694379990141317e-18 * sin(p) * sin(p)) AS nn, 6378137e0 / sqrt(1 - 6694379990141317e-18 * sin(p0) * sin(p0)) AS n0 FROM {src})"""
_DELTA = """(SELECT *, nn * cos(p) * cos(q) - (n0 + {h}) * cos(p0) * cos(q0) AS gx, nn * cos(p) * sin(q) - (n0 + {h}) * cos(p0) * sin(q0) AS gy, nn * (1 - 6694379990141317e-18) * sin(p) - (n0 * (1 - 6694379990141317e-18) + {h}) * sin(p0) AS gz FROM {src})"""


def _enu_sql(src: str, h: str) -> str:
    inner = _DELTA.format(h=h, src=_ECEF.format(src=_ENU.format(src=src)))
    return f"(SELECT *, -sin(q0) * gx + cos(q0) * gy AS east, -sin(p0) * cos(q0) * gx - sin(p0) * sin(q0) * gy + cos(p0) * gz AS north, cos(p0) * cos(q0) * gx + cos(p0) * sin(q0) * gy + sin(p0) * gz AS up FROM {inner})"


@query(f"WITH {SQL} SELECT det_id, round(east, 3) AS east, round(north, 3) AS north, round(up, 3) AS up FROM {_enu_sql('d', '620e0')}")
def ground_enu(spark, sf_dir):
    e, n, u = geo.to_enu(F.col("lat"), F.col("lon"), F.lit(0.0), LAT0, LON0, H0)
    return detections(spark, sf_dir).select("det_id", _r(e, 3).alias("east"), _r(n, 3).alias("north"), _r(u, 3).alias("up"))


@query(f"WITH {SQL} SELECT det_id, round(lat, 8) AS lat, round(lon, 8) AS lon FROM d")
def enu_round_trip(spark, sf_dir):
    """Geodetic to east-north-up and back."""
    d = detections(spark, sf_dir)
    d = d.withColumns(dict(zip(("e", "n", "u"), geo.to_enu(F.col("lat"), F.col("lon"), F.lit(0.0), LAT0, LON0, H0), strict=True)))
    back = geo.from_enu(d.select("det_id", "e", "n", "u"), F.col("e"), F.col("n"), F.col("u"), LAT0, LON0, H0)
    return back.select("det_id", _r(F.col("lat"), 8).alias("lat"), _r(F.col("lon"), 8).alias("lon"))


@query(f"WITH {SQL} SELECT det_id, round(sqrt(east * east + north * north) / 1000, 3) AS km FROM {_enu_sql('d', '0e0')} WHERE sqrt(east * east + north * north) <= 15000")
def radius_search(spark, sf_dir):
    """Within 15 km of the site, from a table that is laid out by cells: only folders and row groups that the circle's cover meets
    are read."""
    where = f"{shared_dir(spark)}/places-{uuid.uuid4().hex}"
    cells.write(detections(spark, sf_dir).select("det_id", "lat", "lon"), where)
    return cells.within(cells.read(spark, where), LAT0, LON0, 15_000.0).select("det_id", _r(F.col("metres") / 1000, 3).alias("km"))


@query(f"""WITH {SQL}, p AS (SELECT det_id, d.lat, d.lon, unit, ulat, ulon, 6378137e0 / sqrt(1 - 6694379990141317e-18 * sin(radians(d.lat)) * sin(radians(d.lat))) AS n, 6378137e0 / sqrt(1 - 6694379990141317e-18 * sin(radians(ulat)) * sin(radians(ulat))) AS m FROM d, (VALUES ('north', 36442e-3, 12869e-2), ('south', 36385e-3, 128748e-3)) t(unit, ulat, ulon)),
x AS (SELECT det_id, unit, radians(ulat) AS p0, radians(ulon) AS q0, n * cos(radians(lat)) * cos(radians(lon)) - m * cos(radians(ulat)) * cos(radians(ulon)) AS gx, n * cos(radians(lat)) * sin(radians(lon)) - m * cos(radians(ulat)) * sin(radians(ulon)) AS gy, (1 - 6694379990141317e-18) * (n * sin(radians(lat)) - m * sin(radians(ulat))) AS gz FROM p),
k AS (SELECT det_id, unit, sqrt(power(-sin(q0) * gx + cos(q0) * gy, 2) + power(-sin(p0) * cos(q0) * gx - sin(p0) * sin(q0) * gy + cos(p0) * gz, 2)) / 1000 AS km FROM x)
SELECT det_id, unit, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY km, unit) AS nth FROM k) WHERE nth = 1""")
def nearest_unit(spark, sf_dir):
    """The nearest of the site's response units: two literals, so the distance to each is a column and no join is needed."""
    d = detections(spark, sf_dir)
    far = [F.struct((F.hypot(*geo.to_enu(F.col("lat"), F.col("lon"), F.lit(0.0), lat, lon, 0.0)[:2]) / 1000).alias("km"), F.lit(name).alias("unit")) for name, lat, lon in UNITS]
    return d.select("det_id", F.least(*far).alias("x")).select("det_id", "x.unit", _r(F.col("x.km"), 3).alias("km"))


@query(f"WITH {SQL} SELECT round(min(lat) - 12e-3, 6) AS south, round(max(lat) + 12e-3, 6) AS north, round(min(lon) - 12e-3, 6) AS west, round(max(lon) + 12e-3, 6) AS east FROM (SELECT lat, lon FROM d UNION ALL VALUES (36442e-3, 12869e-2), (36385e-3, 128748e-3))")
def map_bounds(spark, sf_dir):
    d = detections(spark, sf_dir).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    lats, lons = [F.lit(u[1]) for u in UNITS], [F.lit(u[2]) for u in UNITS]
    return d.select(_r(F.least("s", *lats) - 0.012).alias("south"), _r(F.greatest("n", *lats) + 0.012).alias("north"), _r(F.least("w", *lons) - 0.012).alias("west"), _r(F.greatest("e", *lons) + 0.012).alias("east"))


@query(f"WITH {SQL}, r AS (SELECT det_id, ((x1 + x2) / 2 - 960) / (960 / tan(radians(737e-1) / 2)) AS a, ((y1 + y2) / 2 - 540) / (960 / tan(radians(737e-1) / 2)) AS b, radians(k * 36e-1) AS y, radians(-k * 5e-1) AS p FROM d), s AS (SELECT *, sqrt(a * a + b * b + 1) AS n FROM r) SELECT det_id, round((a * cos(y) + b * sin(y) * sin(p) + sin(y) * cos(p)) / n, 6) AS east, round((-a * sin(y) + b * cos(y) * sin(p) + cos(y) * cos(p)) / n, 6) AS north, round(degrees(asin(least(1, greatest(-1, (b * cos(p) - sin(p)) / n)))), 6) AS depression FROM s")
def pixel_rays(spark, sf_dir):
    """Box centres as rays in east-north-up, and their depression."""
    x, y = g.center()
    ray = geo.rotate(geo.pixel_ray(x, y, geo.focal(1920, 73.7), 960, 540), F.col("k") * 3.6, -F.col("k") * 0.5, F.lit(0.0))
    return detections(spark, sf_dir).select("det_id", _r(ray[0]).alias("east"), _r(ray[1]).alias("north"), _r(geo.depression(ray)).alias("depression"))


@query(f"WITH {SQL} SELECT det_id, round(CASE WHEN k % 5 > 0 THEN (k % 5) * 30e0 ELSE 0 END * -sin(radians(k * 36e-1 + 180)), 6) + 0e0 AS east, round(CASE WHEN k % 5 > 0 THEN (k % 5) * 30e0 ELSE 0 END * -cos(radians(k * 36e-1 + 180)), 6) + 0e0 AS north, round(CASE WHEN k % 5 > 0 THEN (k % 5) * 30e0 ELSE 0 END, 6) + 0e0 AS metres FROM d")
def wind_correction(spark, sf_dir):
    e, n, m = geo.wind_shift((F.col("k") % 5).cast("double"), F.col("k") * 3.6, 30.0)
    return detections(spark, sf_dir).select("det_id", _r(e).alias("east"), _r(n).alias("north"), _r(m).alias("metres"))


_SN = "(ln(cos(radians(30)) / cos(radians(60))) / ln(tan(pi() / 4 + radians(60) / 2) / tan(pi() / 4 + radians(30) / 2)))"


@query(f"WITH {SQL}, cone AS (SELECT {_SN} AS sn), s AS (SELECT sn, 637100877e-5 / 5 * power(tan(pi() / 4 + radians(30) / 2), sn) * cos(radians(30)) / sn AS f FROM cone), x AS (SELECT det_id, f / power(tan(pi() / 4 + radians(lat) / 2), sn) AS ra, f / power(tan(pi() / 4 + radians(38) / 2), sn) AS ro, (radians(lon) - radians(126)) * sn AS turn FROM d, s) SELECT det_id, CAST(trunc(ra * sin(turn) + 43 + 5e-1) AS INT) AS nx, CAST(trunc(ro - ra * cos(turn) + 136 + 5e-1) AS INT) AS ny FROM x")
def forecast_grid(spark, sf_dir):
    nx, ny = geo.forecast_cell(F.col("lat"), F.col("lon"))
    return detections(spark, sf_dir).select("det_id", nx.alias("nx"), ny.alias("ny"))


@query("SELECT strftime(CASE WHEN minute(ts) < 40 THEN ts + INTERVAL 8 HOUR ELSE ts + INTERVAL 9 HOUR END, '%Y%m%d %H00') AS base, count(*) AS n FROM events GROUP BY 1")
def forecast_base_hours(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(geo.forecast_base(F.col("ts")).alias("base")).agg(F.count("*").alias("n"))


@query(f"WITH {_TRACKS}, p AS (SELECT seq_id, count(*) AS frames, count(*) FILTER (WHERE hits > 0) AS hit_frames, sum(hits) AS raw FROM (SELECT seq_id, frame_index, count(*) AS hits FROM d WHERE offset_s < 0 GROUP BY seq_id, frame_index) GROUP BY seq_id), b AS (SELECT seq_id, count(*) FILTER (WHERE born < 0) AS dedup FROM (SELECT seq_id, lane, min(offset_s) AS born FROM d GROUP BY seq_id, lane) GROUP BY seq_id) SELECT b.seq_id, coalesce(frames, 0) AS frames, CAST(coalesce(raw, 0) AS BIGINT) AS raw, dedup FROM b LEFT JOIN p USING (seq_id)")
def sequence_outcomes(spark, sf_dir):
    """Before ignition: frames, raw detections, and tracks born."""
    d = detections(spark, sf_dir)
    pre = d.groupBy("seq_id").agg(F.count_distinct(F.when(F.col("offset_s") < 0, F.col("frame_index"))).alias("frames"), F.count_if(F.col("offset_s") < 0).alias("raw"))
    born = d.groupBy("seq_id", "lane").agg(F.min("offset_s").alias("born")).groupBy("seq_id").agg(F.count_if(F.col("born") < 0).alias("dedup"))
    return pre.join(born, "seq_id")


_FIRST = f"""{_OBS}, t AS (SELECT seq_id, lane, offset_s, {_features_sql(' OVER (PARTITION BY seq_id, lane ORDER BY offset_s, det_id ROWS UNBOUNDED PRECEDING)')} FROM w),
v AS (SELECT seq_id, lane, offset_s, n, growth AS area_growth_rate, mono AS area_monotonicity, -dy / greatest(side, 1) AS centroid_rise_rate FROM t),
first AS (SELECT seq_id, lane, min(offset_s) AS flare FROM v WHERE n >= 3 AND {_MET} = 2 GROUP BY seq_id, lane)"""


@query(f"WITH {_FIRST}, pre AS (SELECT count(*) AS raw, (SELECT count(*) FROM (SELECT DISTINCT seq_id, frame_index FROM d WHERE offset_s < 0)) AS frames FROM d WHERE offset_s < 0), s AS (SELECT (SELECT count(DISTINCT seq_id) FROM d) AS sequences, (SELECT count(*) FROM (SELECT seq_id, lane, min(offset_s) AS b FROM d GROUP BY seq_id, lane) WHERE b < 0) AS dedup, (SELECT count(*) FROM first WHERE flare < 0) AS verified, (SELECT count(DISTINCT seq_id) FROM first WHERE flare >= 0) AS detected, (SELECT median(m) FROM (SELECT min(flare) AS m FROM first WHERE flare >= 0 GROUP BY seq_id)) AS ttf) SELECT frames, round(frames / 60e0, 6) AS hours, round(raw / (frames / 60e0), 6) AS raw_per_hour, round(dedup / (frames / 60e0), 6) AS dedup_per_hour, round(verified / (frames / 60e0), 6) AS verified_per_hour, round(detected / CAST(sequences AS DOUBLE), 6) AS detection_rate, round(ttf, 6) AS median_time_to_flare FROM pre, s")
def false_alarm_rates(spark, sf_dir):
    """False alarms an hour before ignition under three policies, and the share of sequences found after it."""
    past = Window.partitionBy("seq_id", "lane").orderBy("offset_s", "det_id").rowsBetween(Window.unboundedPreceding, 0)
    d = detections(spark, sf_dir)
    t = rules.observations(d).select("seq_id", "lane", "offset_s", *(c.alias(k) for k, c in rules.features(over=past).items()))
    flare = t.withColumn("tier", rules.tier(*rules.criteria(), F.lit(True)))
    track = flare.groupBy("seq_id", "lane").agg(F.min("offset_s").alias("born"), F.min(F.when(F.col("tier") == "FLARE", F.col("offset_s"))).alias("flare"))
    seq = track.groupBy("seq_id").agg(F.count_if(F.col("born") < 0).alias("dedup"), F.count_if(F.col("flare") < 0).alias("verified"), F.min(F.when(F.col("flare") >= 0, F.col("flare"))).alias("ttf"))
    pre = d.groupBy("seq_id").agg(F.count_if(F.col("offset_s") < 0).alias("raw"), F.count_distinct(F.when(F.col("offset_s") < 0, F.col("frame_index"))).alias("frames"))
    a = seq.join(pre, "seq_id").agg(F.sum("frames").alias("frames"), F.sum("raw").alias("raw"), F.sum("dedup").alias("dedup"), F.sum("verified").alias("verified"), F.count("ttf").alias("detected"), F.count("*").alias("sequences"), F.percentile("ttf", 0.5).alias("ttf"))
    hours = F.col("frames") / 60.0
    rate = lambda c: _r(F.coalesce(F.try_divide(F.col(c), hours), F.lit(0.0))).alias(f"{c}_per_hour")
    return a.select("frames", _r(hours).alias("hours"), rate("raw"), rate("dedup"), rate("verified"), _r(F.col("detected") / F.col("sequences")).alias("detection_rate"), _r(F.col("ttf")).alias("median_time_to_flare"))


@query(f"WITH {SQL} SELECT seq_id, CASE WHEN (dense_rank() OVER (ORDER BY seq_id) - 1) % 2 = 0 THEN 'train' ELSE 'test' END AS part FROM (SELECT DISTINCT seq_id FROM d)")
def holdout_split(spark, sf_dir):
    """Sequences in order, every other one for testing: even places train, odd ones test."""
    return learn.split(detections(spark, sf_dir).select("seq_id").distinct())


@query(f"WITH {_TRACKS} SELECT seq_id, lane, concat_ws('; ', CASE WHEN n < 3 THEN printf('{rules.REASONS[0]}', n) END, CASE WHEN centroid_rise_rate >= 1e-4 THEN '{rules.REASONS[1]}' ELSE '{rules.REASONS[2]}' END || '{rules.PROXY}', CASE WHEN area_growth_rate >= 1e-4 AND area_monotonicity >= 55e-2 THEN '{rules.REASONS[3]}' ELSE '{rules.REASONS[4]}' END) AS reasons FROM u")
def verdict_reasons(spark, sf_dir):
    """Why each track got its tier, in words."""
    return _tracks(spark, sf_dir).select("seq_id", "lane", F.array_join(rules.reasons(*rules.criteria()), "; ").alias("reasons"))


@query(f"WITH {_TRACKS} SELECT seq_id, lane, CASE WHEN score >= 7e-1 AND n >= 3 THEN 'FLARE' WHEN score >= 35e-2 THEN 'GLOW' ELSE 'SPARK' END AS tier FROM u")
def score_tiers(spark, sf_dir):
    """Tiers by the score alone, the auxiliary grading; every place counts as located."""
    return _tracks(spark, sf_dir).select("seq_id", "lane", rules.tier_from_score(F.lit(True)).alias("tier"))


@query(f"WITH {_EVENTS} SELECT count(*) AS total, count(*) FILTER (WHERE tier = 'FLARE') AS flare, count(*) FILTER (WHERE tier = 'GLOW') AS glow, count(*) FILTER (WHERE tier = 'SPARK') AS spark, count(*) FILTER (WHERE label <> 'unlabelled') AS labelled, count(*) FILTER (WHERE tier = 'GLOW' AND label = 'unlabelled') AS queue FROM e")
def event_summary(spark, sf_dir):
    """Stored events by tier, those with a label, and the GLOW ones that wait for a label."""
    is_ = lambda t: F.col("tier") == t
    bare = F.col("label") == "unlabelled"
    return stored_events(spark, sf_dir).agg(F.count("*").alias("total"), *(F.count_if(is_(t)).alias(t.lower()) for t in rules.TIERS), F.count_if(~bare).alias("labelled"), F.count_if(is_("GLOW") & bare).alias("queue"))


@query(f"WITH {SQL}, l AS (SELECT seq_id, lane, k % 4 AS status, offset_s + 30 * (k % 4) AS said, min(offset_s) OVER (PARTITION BY seq_id, lane) AS born FROM d) SELECT seq_id, lane, status, min(said) - min(born) AS delay_s FROM l WHERE status > 0 GROUP BY seq_id, lane, status")
def response_delays(spark, sf_dir):
    """Seconds from a track's first detection to the first entry of each response status."""
    d = detections(spark, sf_dir).groupBy("seq_id", "lane", (F.col("k") % 4).alias("status")).agg(F.min("offset_s").alias("first"))
    born = F.min("first").over(Window.partitionBy("seq_id", "lane"))
    return d.withColumn("delay_s", F.col("first") + 30 * F.col("status") - born).where("status > 0").select("seq_id", "lane", "status", "delay_s")


@query(f"WITH {SQL}, t AS (SELECT seq_id, lane, count(*) FILTER (WHERE offset_s < 0) AS pre, count(*) FILTER (WHERE offset_s >= 0) AS post, min(offset_s) AS born FROM d GROUP BY seq_id, lane) SELECT seq_id, lane, 0 AS label, pre AS n FROM t WHERE pre >= 2 UNION ALL SELECT seq_id, lane, 1, post FROM t WHERE post >= 2 AND born >= 0")
def training_tracks(spark, sf_dir):
    """Rows to fit the scorer on: the part of a track before ignition counts as false, a track born after it as true."""
    late = F.col("offset_s") >= 0
    t = detections(spark, sf_dir).groupBy("seq_id", "lane").agg(F.count_if(~late).alias("pre"), F.count_if(late).alias("post"), F.min("offset_s").alias("born"))
    false = t.where("pre >= 2").select("seq_id", "lane", F.lit(0).alias("label"), F.col("pre").alias("n"))
    return false.union(t.where("post >= 2 AND born >= 0").select("seq_id", "lane", F.lit(1), "post"))


@query(f"WITH {SQL}, o AS (SELECT seq_id, lane, det_id, row_number() OVER (PARTITION BY seq_id, lane ORDER BY offset_s, det_id) - 1 AS nth, count(*) OVER (PARTITION BY seq_id, lane) AS n FROM d), s AS (SELECT DISTINCT seq_id, lane, CAST(round_even(i * (n - 1) / CAST(13 AS DOUBLE), 0) AS BIGINT) AS nth FROM (SELECT DISTINCT seq_id, lane, n FROM o WHERE n > 14), range(14) r(i)) SELECT seq_id, lane, det_id, nth FROM o WHERE n <= 14 UNION ALL SELECT o.seq_id, o.lane, det_id, o.nth FROM o JOIN s ON o.seq_id = s.seq_id AND o.lane = s.lane AND o.nth = s.nth")
def evenly_sampled(spark, sf_dir):
    """At most 14 evenly spaced detections of each track, as its animation shows them."""
    own = Window.partitionBy("seq_id", "lane")
    x = detections(spark, sf_dir).select("seq_id", "lane", "det_id", (F.row_number().over(own.orderBy("offset_s", "det_id")) - 1).cast("long").alias("nth"), F.count("*").over(own).alias("n"))
    places = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.rint(i * (F.col("n") - 1) / 13.0).cast("long"))
    return x.where((F.col("n") <= 14) | F.array_contains(places, F.col("nth"))).select("seq_id", "lane", "det_id", "nth")


_R2 = "(a * a + b * b)"
_RADIAL = f"(1 - 28e-2 * {_R2} + 7e-2 * {_R2} * {_R2} - 1e-2 * {_R2} * {_R2} * {_R2})"


@query(f"WITH {SQL}, r AS (SELECT det_id, ((x1 + x2) / 2 - 960) / (960 / tan(radians(737e-1) / 2)) AS a, ((y1 + y2) / 2 - 540) / (960 / tan(radians(737e-1) / 2)) AS b FROM d) SELECT det_id, round(a * {_RADIAL} + 2e-3 * a * b + 5e-4 * ({_R2} + 2 * a * a), 6) + 0e0 AS x, round(b * {_RADIAL} + 1e-3 * ({_R2} + 2 * b * b) + 1e-3 * a * b, 6) + 0e0 AS y FROM r")
def lens_distortion(spark, sf_dir):
    """Box centres through a lens with radial and tangential distortion, in normalised camera coordinates."""
    x, y = g.center()
    f = geo.focal(1920, 73.7)
    d = detections(spark, sf_dir).select("det_id", ((x - 960) / f).alias("a"), ((y - 540) / f).alias("b"))
    u, v = geo.distort(F.col("a"), F.col("b"), -0.28, 0.07, 0.001, 0.0005, -0.01)
    return d.select("det_id", (_r(u) + 0.0).alias("x"), (_r(v) + 0.0).alias("y"))


@query(f"WITH {SQL} SELECT det_id, round(((x1 + x2) / 2 - 960) / (960 / tan(radians(737e-1) / 2)), 6) + 0e0 AS x, round(((y1 + y2) / 2 - 540) / (960 / tan(radians(737e-1) / 2)), 6) + 0e0 AS y FROM d")
def lens_round_trip(spark, sf_dir):
    """Box centres through the lens and back."""
    x, y = g.center()
    f, lens = geo.focal(1920, 73.7), (-0.28, 0.07, 0.001, 0.0005, -0.01)
    d = detections(spark, sf_dir).select("det_id", ((x - 960) / f).alias("a"), ((y - 540) / f).alias("b"))
    d = d.withColumns(dict(zip(("u", "v"), geo.distort(F.col("a"), F.col("b"), *lens), strict=True)))
    back = d.select("det_id", geo.undistort(F.col("u"), F.col("v"), *lens).alias("p"))
    return back.select("det_id", (_r(F.col("p.x")) + 0.0).alias("x"), (_r(F.col("p.y")) + 0.0).alias("y"))


@query(f"WITH {SQL}, p AS (SELECT det_id, round((x1 + x2) / 2, 6) + 0e0 AS u, round((y1 + y2) / 2, 6) + 0e0 AS v FROM d) SELECT det_id, u, v, u >= 0 AND u < 1920 AND v >= 0 AND v < 1080 AS inside FROM p")
def pixel_round_trip(spark, sf_dir):
    """Box centres as rays in east-north-up and projected back, and whether they lie in the image."""
    x, y = g.center()
    f, pose = geo.focal(1920, 73.7), (F.col("k") * 3.6, -F.col("k") * 0.5, F.col("k") * 0.1)
    d = detections(spark, sf_dir)
    d = d.select("det_id", "k", *(c.alias(n) for n, c in zip(("e", "n", "up"), geo.rotate(geo.pixel_ray(x, y, f, 960, 540), *pose), strict=True)))
    u, v = geo.ray_pixel((F.col("e"), F.col("n"), F.col("up")), *pose, f, 960, 540)
    d = d.select("det_id", (_r(u) + 0.0).alias("u"), (_r(v) + 0.0).alias("v"))
    return d.withColumn("inside", (F.col("u") >= 0) & (F.col("u") < 1920) & (F.col("v") >= 0) & (F.col("v") < 1080))


@query(f"WITH {SQL}, t AS (SELECT CAST(floor(lat) AS BIGINT) AS south, CAST(floor(lon) AS BIGINT) AS west, count(*) AS n FROM d GROUP BY 1, 2) SELECT south, west, n, printf('Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM', CASE WHEN south >= 0 THEN 'N' ELSE 'S' END, abs(south), CASE WHEN west >= 0 THEN 'E' ELSE 'W' END, abs(west)) AS name FROM t")
def terrain_cells(spark, sf_dir):
    """The one-degree terrain tiles that detections need, and the names of their files."""
    t = detections(spark, sf_dir).groupBy(F.floor("lat").alias("south"), F.floor("lon").alias("west")).agg(F.count("*").alias("n"))
    return t.withColumn("name", geo.tile_name(F.col("south"), F.col("west")))


def _box(id_: str, p: str) -> str:
    return f"{{'id': {id_}, 'x1': {p}x1, 'y1': {p}y1, 'x2': {p}x2, 'y2': {p}y2}}"


def _iou(a: str, b: str) -> str:
    common = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"
    return f"({common}) / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {common})"


_RANKED = "o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seq_id, frame_index ORDER BY confidence DESC, det_id) AS nth FROM d)"
_NMS = f"""{SQL}, {_RANKED},
r AS (SELECT seq_id, frame_index, nth, [{_box('det_id', '')}] AS kept FROM o WHERE nth = 1
  UNION ALL SELECT r.seq_id, r.frame_index, o.nth, CASE WHEN len(list_filter(r.kept, lambda a: {_iou('a', 'o')} > 2e-1)) = 0 THEN list_append(r.kept, {_box('o.det_id', 'o.')}) ELSE r.kept END
  FROM r JOIN o ON o.seq_id = r.seq_id AND o.frame_index = r.frame_index AND o.nth = r.nth + 1)
SELECT d.seq_id, d.frame_index, d.det_id, d.lane, d.x1, d.y1, d.x2, d.y2, d.confidence FROM (SELECT unnest(kept).id AS det_id FROM (SELECT kept, row_number() OVER (PARTITION BY seq_id, frame_index ORDER BY nth DESC) AS back FROM r) WHERE back = 1) k JOIN d USING (det_id)"""


@query(f"WITH RECURSIVE {_NMS}")
def nms(spark, sf_dir):
    return matching.suppressed(detections(spark, sf_dir))


def truths(d: DataFrame) -> DataFrame:
    """A third of the boxes, shifted, stand as ground truth."""
    shift = (F.col("k") % 11) - 5
    return d.where("k % 3 = 0").select("seq_id", "frame_index", F.col("det_id").alias("truth_id"), *((F.col(c) + shift).alias(c) for c in ("x1", "y1", "x2", "y2")))


_BEST = f"list_sort(list_transform(list_filter(r.free, lambda t: NOT list_contains(r.used, t.id)), lambda t: {{'iou': {_iou('o', 't')}, 'id': -t.id}}), 'DESC')[1]"
_MATCH = f"""{SQL}, {_RANKED}, tr AS (SELECT seq_id, frame_index, det_id AS truth_id, x1 + (k % 11 - 5) AS x1, y1 + (k % 11 - 5) AS y1, x2 + (k % 11 - 5) AS x2, y2 + (k % 11 - 5) AS y2 FROM d WHERE k % 3 = 0),
b AS (SELECT seq_id, frame_index, list({_box('truth_id', '')}) AS free FROM tr GROUP BY seq_id, frame_index),
fr AS MATERIALIZED (SELECT o.*, coalesce(free, []) AS free FROM o LEFT JOIN b USING (seq_id, frame_index)),
r AS (SELECT seq_id, frame_index, CAST(0 AS BIGINT) AS nth, free, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS DOUBLE) AS confidence, {{'iou': CAST(NULL AS DOUBLE), 'id': CAST(NULL AS BIGINT)}} AS best FROM fr WHERE nth = 1
  UNION ALL SELECT seq_id, frame_index, nth, free, CASE WHEN best.iou >= 5e-1 THEN list_append(used, -best.id) ELSE used END, det_id, confidence, best
  FROM (SELECT o.seq_id, o.frame_index, o.nth, r.free, r.used, o.det_id, o.confidence, {_BEST} AS best FROM r JOIN fr o ON o.seq_id = r.seq_id AND o.frame_index = r.frame_index AND o.nth = r.nth + 1)),
m AS MATERIALIZED (SELECT det_id, seq_id, frame_index, confidence, CASE WHEN best.iou >= 5e-1 THEN -best.id END AS truth_id, CASE WHEN best.iou >= 5e-1 THEN best.iou ELSE 0 END AS iou FROM r WHERE nth > 0)"""


def _matches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = detections(spark, sf_dir)
    return materialize(matching.matched(d, truths(d)), "matches"), truths(d)


@query(f"WITH RECURSIVE {_MATCH} SELECT det_id, seq_id, frame_index, round(confidence, 9) AS confidence, truth_id, round(iou, 9) AS iou FROM m")
def ground_truth_match(spark, sf_dir):
    """Detections against boxes a third of which stand shifted as ground truth."""
    d = detections(spark, sf_dir)
    return matching.matched(d, truths(d)).withColumns({"confidence": _r(F.col("confidence"), 9), "iou": _r(F.col("iou"), 9)})


_CURVE = """cv AS (SELECT threshold, n, tp, CASE WHEN n > 0 THEN CAST(tp AS DOUBLE) / n ELSE 0 END AS p, CAST(tp AS DOUBLE) / (SELECT count(*) FROM tr) AS q FROM (
  SELECT threshold, count(*) FILTER (WHERE confidence >= threshold) AS n, count(*) FILTER (WHERE confidence >= threshold AND truth_id IS NOT NULL) AS tp FROM m, (SELECT unnest([5e-2, 1e-1, 15e-2, 2e-1, 25e-2, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1]) AS threshold) GROUP BY threshold)),
curve AS (SELECT threshold, n, tp, p, q, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f FROM cv)"""


@query(f"WITH RECURSIVE {_MATCH}, {_CURVE} SELECT threshold, n, tp, round(p, 9) AS precision, round(q, 9) AS recall, round(f, 9) AS f1 FROM curve")
def pr_curve(spark, sf_dir):
    return matching.pr_curve(*_matches(spark, sf_dir)).withColumns({c: _r(F.col(c), 9) for c in ("precision", "recall", "f1")})


_AP = """k AS (SELECT det_id, truth_id IS NOT NULL AS hit, row_number() OVER w AS r, sum(CASE WHEN truth_id IS NOT NULL THEN 1 ELSE 0 END) OVER w AS t FROM m WINDOW w AS (ORDER BY confidence DESC, det_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT hit, max(CAST(t AS DOUBLE) / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS env FROM k),
ap AS (SELECT coalesce(sum(env) FILTER (WHERE hit), 0) / (SELECT count(*) FROM tr) AS ap, count(*) AS n, count(*) FILTER (WHERE hit) AS tp FROM e)"""


@query(f"WITH RECURSIVE {_MATCH}, {_AP} SELECT round(ap, 9) AS ap, n, tp, (SELECT count(*) FROM tr) AS n_truth FROM ap")
def average_precision(spark, sf_dir):
    return matching.average_precision(*_matches(spark, sf_dir)).withColumn("ap", _r(F.col("ap"), 9))


@query(f"WITH RECURSIVE {_MATCH}, {_CURVE}, {_AP}, i AS (SELECT f.seq_id, f.frame_index, count(t.truth_id) AS boxes, any_value(n) AS found FROM (SELECT seq_id, frame_index, count(*) AS n FROM d GROUP BY ALL) f LEFT JOIN tr t ON t.seq_id = f.seq_id AND t.frame_index = f.frame_index GROUP BY ALL), best AS (SELECT * FROM curve ORDER BY round(f, 12) DESC, threshold LIMIT 1) SELECT count(*) AS n_images, count(*) FILTER (WHERE boxes > 0) AS n_with, count(*) FILTER (WHERE boxes = 0) AS n_without, CAST(sum(found) AS BIGINT) AS n_predictions, round(sum(found) FILTER (WHERE boxes = 0) / CAST(count(*) FILTER (WHERE boxes = 0) AS DOUBLE), 9) AS fp_per_negative, round(count(*) FILTER (WHERE boxes = 0 AND found > 0) / CAST(count(*) FILTER (WHERE boxes = 0) AS DOUBLE), 9) AS alarm_rate, round((SELECT ap FROM ap), 9) AS ap50, (SELECT count(*) FROM tr) AS n_truth, (SELECT threshold FROM best) AS best_threshold, round((SELECT p FROM best), 9) AS precision, round((SELECT q FROM best), 9) AS recall, round((SELECT f FROM best), 9) AS f1 FROM i")
def detector_baseline(spark, sf_dir):
    """Images with and without smoke, their false alarms, average precision and the best threshold."""
    m, truth = _matches(spark, sf_dir)
    b = matching.baseline(m, truth, detections(spark, sf_dir))
    return b.withColumns({c: _r(F.col(c), 9) for c in ("fp_per_negative", "alarm_rate", "ap50", "precision", "recall", "f1")})


_SIDE = "greatest({0}.{1}2 - {0}.{1}1, 0)"
_BOTH = "greatest(least({0}.{2}2, {1}.{2}2) - greatest({0}.{2}1, {1}.{2}1), 0)"


def _affinity_sql(a: str, b: str) -> str:
    """Affinity of a track a and a detection b, structs with a box."""
    size, other = (f"{_SIDE.format(v, 'x')} * {_SIDE.format(v, 'y')}" for v in (a, b))
    common = f"{_BOTH.format(a, b, 'x')} * {_BOTH.format(a, b, 'y')}"
    union = f"({size} + {other} - {common})"
    limit = f"(15e-1 * greatest(sqrt({size}), 1))"
    far = f"sqrt(power(({a}.x1 + {a}.x2 - {b}.x1 - {b}.x2) / 2, 2) + power(({a}.y1 + {a}.y2 - {b}.y1 - {b}.y2) / 2, 2))"
    return f"CASE WHEN {union} > 0 AND {common} / {union} >= 1e-1 THEN 1 + {common} / {union} WHEN {far} <= {limit} THEN 1 - {far} / {limit} ELSE 0 END"


#: Linking as a recursion: a row is a sequence's open tracks and the free detections of its frame; a step takes the best pair, or
#: where none is left ends the frame (done, out) and goes on to the next.
_BOXED = "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
_LINKS = f"""{SQL}, fr AS MATERIALIZED (SELECT seq_id, frame_index, list({{'d': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY det_id) AS dets FROM d GROUP BY seq_id, frame_index),
span AS (SELECT seq_id, min(frame_index) AS f, max(frame_index) AS last FROM fr GROUP BY seq_id),
z AS (SELECT seq_id, f, last, CAST([] AS STRUCT(t BIGINT, {_BOXED}, m INT, d BIGINT)[]) AS tracks, dets, CAST(0 AS BIGINT) AS made, -1 AS done, CAST([] AS STRUCT(t BIGINT, {_BOXED}, m INT, d BIGINT)[]) AS out FROM span JOIN fr USING (seq_id) WHERE frame_index = f
  UNION ALL
  SELECT p.seq_id, CASE WHEN best IS NULL THEN f + 1 ELSE f END, last,
    CASE WHEN best IS NULL THEN list_transform(fin, lambda x: {{'t': x.t, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2, 'm': x.m, 'd': -1}})
         ELSE list_transform(range(1, len(tracks) + 1), lambda i: CASE WHEN i = best.i THEN {{'t': tracks[i].t, 'x1': p.dets[best.j].x1, 'y1': p.dets[best.j].y1, 'x2': p.dets[best.j].x2, 'y2': p.dets[best.j].y2, 'm': 0, 'd': p.dets[best.j].d}} ELSE tracks[i] END) END,
    CASE WHEN best IS NULL THEN coalesce(n.dets, []) ELSE list_concat(p.dets[:best.j - 1], p.dets[best.j + 1:]) END,
    CASE WHEN best IS NULL THEN made + len(p.dets) ELSE made END, CASE WHEN best IS NULL THEN f ELSE -1 END, CASE WHEN best IS NULL THEN fin ELSE [] END
  FROM (SELECT *, list_reverse_sort(list_filter(flatten(list_transform(range(1, len(tracks) + 1), lambda i: list_transform(range(1, len(dets) + 1), lambda j: {{'a': CASE WHEN tracks[i].d < 0 THEN {_affinity_sql('tracks[i]', 'dets[j]')} ELSE 0 END, 'i': i, 'j': j}}))), lambda c: c.a > 0))[1] AS best,
          list_concat(list_filter(list_transform(tracks, lambda x: {{'t': x.t, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2, 'm': CASE WHEN x.d < 0 THEN x.m + 1 ELSE x.m END, 'd': x.d}}), lambda x: x.m <= 2),
                      list_transform(range(1, len(dets) + 1), lambda j: {{'t': made + j - 1, 'x1': dets[j].x1, 'y1': dets[j].y1, 'x2': dets[j].x2, 'y2': dets[j].y2, 'm': 0, 'd': dets[j].d}})) AS fin
        FROM z WHERE f <= last) p LEFT JOIN fr n ON n.seq_id = p.seq_id AND n.frame_index = p.f + 1),
links AS MATERIALIZED (SELECT seq_id, done AS frame_index, u.t AS track_id, CASE WHEN u.d >= 0 THEN u.d END AS det_id, u.m AS missed FROM (SELECT seq_id, done, unnest(out) AS u FROM z WHERE done >= 0))"""


@query(f"WITH RECURSIVE {_LINKS} SELECT * FROM links")
def linked_tracks(spark, sf_dir):
    return tracks.linked(detections(spark, sf_dir))


@query(f"WITH RECURSIVE {_LINKS}, ends AS (SELECT seq_id, max(frame_index) AS last_of_all FROM links GROUP BY seq_id) SELECT seq_id, track_id, count(det_id) AS hits, min(frame_index) AS first_frame, max(frame_index) FILTER (WHERE det_id IS NOT NULL) AS last_frame, max(frame_index) FILTER (WHERE det_id IS NOT NULL) - min(frame_index) + 1 AS frame_span, any_value(last_of_all) > max(frame_index) AS finished FROM links JOIN ends USING (seq_id) GROUP BY seq_id, track_id")
def all_tracks(spark, sf_dir):
    """Every linked track, ended or open at the end of its sequence."""
    return tracks.all_tracks(tracks.linked(detections(spark, sf_dir)))


_RISEN = f"""{_EVENTS}, far AS (SELECT *, CAST(seq_id // 4 AS BIGINT) AS site, radians(lat - 25 * (seq_id // 4 % 4)) AS p, radians(lon - 70 * (seq_id // 4 % 3)) AS q FROM e),
pe AS (SELECT id, site, lane, seq_id, "at" AS said, tier, CASE tier WHEN 'FLARE' THEN 2 WHEN 'GLOW' THEN 1 ELSE 0 END AS rank, p, q, nn * cos(p) * cos(q) AS gx, nn * cos(p) * sin(q) AS gy, nn * (1 - 6694379990141317e-18) * sin(p) AS gz
      FROM (SELECT *, 6378137e0 / sqrt(1 - 6694379990141317e-18 * sin(p) * sin(p)) AS nn FROM far)),
x AS (SELECT *, max(CASE WHEN rank > 0 THEN rank END) OVER (PARTITION BY site, seq_id, lane ORDER BY said, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pe),
y AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY site ORDER BY said, id) AS nth FROM x WHERE rank > coalesce(before, 0)),
z AS (SELECT site, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS id, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, z DOUBLE, p DOUBLE, q DOUBLE, w DOUBLE, rank INT)[]) AS sent, FALSE AS gone FROM (SELECT DISTINCT site FROM y)
  UNION ALL SELECT site, nth, id, CASE WHEN gone THEN sent ELSE list_append(sent, {{'x': gx, 'y': gy, 'z': gz, 'p': p, 'q': q, 'w': said, 'rank': rank}}) END, gone
  FROM (SELECT y.site, y.nth, y.id, y.said, y.rank, y.gx, y.gy, y.gz, y.p, y.q, list_filter(z.sent, lambda s: y.said - s.w <= 600) AS sent,
        coalesce(y.rank <= list_filter(z.sent, lambda s: y.said - s.w <= 600 AND sqrt(pow(cos(s.q) * (y.gy - s.y) - sin(s.q) * (y.gx - s.x), 2) + pow(cos(s.p) * (y.gz - s.z) - sin(s.p) * (cos(s.q) * (y.gx - s.x) + sin(s.q) * (y.gy - s.y)), 2)) <= 300)[1].rank, FALSE) AS gone FROM z JOIN y ON y.site = z.site AND y.nth = z.nth + 1))"""


def _at_sites(e: DataFrame) -> DataFrame:
    """Stored events at a site for each four sequences, spread over twelve regions of the earth."""
    site = F.floor(F.col("seq_id") / 4).cast("long")
    return e.withColumns({"site": site, "track": F.concat_ws("/", "seq_id", "lane"), "lat": F.col("lat") - 25 * (site % 4), "lon": F.col("lon") - 70 * (site % 3)})


@query(f"WITH RECURSIVE {_RISEN} SELECT x.site, x.id, x.said AS \"at\", x.tier, CASE WHEN rank = 0 THEN 'stored' WHEN rank <= coalesce(before, 0) THEN 'not risen' WHEN gone THEN 'suppressed' ELSE 'sent' END AS decision, CASE WHEN rank > coalesce(before, 0) AND NOT gone THEN CASE WHEN before IS NULL THEN 'new' ELSE 'escalated' END END AS reason FROM x LEFT JOIN z ON z.id = x.id")
def routed_alerts(spark, sf_dir):
    return alerts.routed(_at_sites(stored_events(spark, sf_dir)))


@query()
def scorer_fit(spark, sf_dir):
    return learn.fitted(_tracks(spark, sf_dir).join(stored_events(spark, sf_dir).select("seq_id", "lane", "label"), ["seq_id", "lane"]))


@query()
def georeference(spark, sf_dir):
    """The place of every detection, or the reason there is none."""
    return run.fixes(spark, sf_dir).withColumnRenamed("row_id", "det_id")


@query()
def cep_sweep(spark, sf_dir):
    return solve.cep_by_depression(run.fixes(spark, sf_dir))


def _sites(spark, sf_dir) -> DataFrame:
    """A site for each cell of the forecast grid that has detections, at their mean place."""
    nx, ny = geo.forecast_cell(F.col("lat"), F.col("lon"))
    return detections(spark, sf_dir).groupBy(F.concat_ws(",", nx, ny).alias("site")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


@query()
def site_accuracy(spark, sf_dir):
    """Error radii by depression over all sites and eight azimuths, for both grades of positioning."""
    wide, ground, camera = _sites(spark, sf_dir), solve.synthetic(half=0.5), solve.Camera.from_fov(1920, 1080, 73.7)
    both = [solve.swept(wide, ground, camera, n).withColumn("grade", F.lit(g)) for g, n in (("consumer", solve.CONSUMER), ("rtk", solve.RTK))]
    return both[0].unionByName(both[1])


@query()
def site_round_trip(spark, sf_dir):
    """Pixels to the ground, back to pixels, and to the ground again, at all sites."""
    return solve.round_trip(_sites(spark, sf_dir), solve.synthetic(half=0.5), solve.Camera.from_fov(1920, 1080, 73.7))


@query()
def whole_run(spark, sf_dir):
    """Detections to alerts in one job: id, place, tier, decision and text of every event."""
    return run.whole_run(spark, sf_dir, UNITS)


def queries() -> dict:
    from hazeline.plans import flights, handover, reports  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: _SQL[k] for k in queries() if k in _SQL}
