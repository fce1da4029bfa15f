"""Queries of a run as it is configured, and of the motion of cameras, each with the SQL of the same rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions import geodesy as geo
from hazeline.functions import rules
from hazeline.operators import crossing, flow
from hazeline.plans import run
from hazeline.plans.catalog import _LINKS, _LOGIT, _MET, _NAMED, _OBS, _features_sql, _r, query
from hazeline.plans.reports import crossing_sql
from hazeline.session import materialize
from hazeline.sources.detections import SQL, detections


def matched_points(spark, sf_dir: str) -> DataFrame:
    """Points that moved with a camera: the centres of a sequence's detections, three in ten of which go their own way."""
    d, c = detections(spark, sf_dir), F.col
    d = d.select("seq_id", c("det_id").alias("point_id"), ((c("x1") + c("x2")) / 2).alias("x"), ((c("y1") + c("y2")) / 2).alias("y"), "k")
    own = c("k") % 10 < 3
    dx = (c("seq_id") % 7 - 3) + (c("seq_id") % 5 - 2) / 1000 * c("x") + (c("seq_id") % 3 - 1) / 1000 * c("y") + ((c("point_id") * 13) % 11 - 5) / 50
    dy = ((c("seq_id") % 11) / 2 - 2) + (c("seq_id") % 4 - 1) / 1000 * c("x") + (c("seq_id") % 6 - 3) / 1000 * c("y") + ((c("point_id") * 17) % 13 - 6) / 50
    return d.select("seq_id", "point_id", "x", "y", (dx + F.when(own, 20 + c("k") % 9).otherwise(0)).alias("dx"), (dy - F.when(own, 15 + c("k") % 7).otherwise(0)).alias("dy"))


def _off_sql(m: str) -> str:
    return f"sqrt(power(p.dx - ({m}.ax + {m}.bx * p.x + {m}.cx * p.y), 2) + power(p.dy - ({m}.ay + {m}.by_ * p.x + {m}.cy * p.y), 2))"


def _fit_sql(before: str) -> str:
    """A fit by least squares to the points that agree with the motion before."""
    s = "xx * yy - xy * xy"
    slopes = ", ".join(f"(x{v} * yy - y{v} * xy) / ({s}) AS {b}, (y{v} * xx - x{v} * xy) / ({s}) AS {c}" for v, b, c in (("u", "bx", "cx"), ("v", "by_", "cy")))
    sums = "var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, dx) AS xu, covar_pop(y, dx) AS yu, covar_pop(x, dy) AS xv, covar_pop(y, dy) AS yv, avg(x) AS mx, avg(y) AS my, avg(dx) AS mu, avg(dy) AS mv"
    near = f"(SELECT p.* FROM pt p JOIN {before} m ON p.seq_id = m.seq_id WHERE {_off_sql('m')} <= 3)"
    return f"(SELECT seq_id, n, mu - bx * mx - cx * my AS ax, bx, cx, mv - by_ * mx - cy * my AS ay, by_, cy FROM (SELECT *, {slopes} FROM (SELECT seq_id, count(*) AS n, {sums} FROM {near} GROUP BY seq_id) WHERE {s} > 1e-6))"


_MOTION = f"""{SQL}, mid AS (SELECT seq_id, det_id AS point_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, k FROM d),
pt AS MATERIALIZED (SELECT seq_id, point_id, x, y, (seq_id % 7 - 3) + (seq_id % 5 - 2) / 1e3 * x + (seq_id % 3 - 1) / 1e3 * y + ((point_id * 13) % 11 - 5) / 5e1 + CASE WHEN k % 10 < 3 THEN 20 + k % 9 ELSE 0 END AS dx,
  ((seq_id % 11) / 2e0 - 2) + (seq_id % 4 - 1) / 1e3 * x + (seq_id % 6 - 3) / 1e3 * y + ((point_id * 17) % 13 - 6) / 5e1 - CASE WHEN k % 10 < 3 THEN 15 + k % 7 ELSE 0 END AS dy, row_number() OVER (PARTITION BY seq_id ORDER BY point_id) - 1 AS place FROM mid),
fs AS (SELECT seq_id, count(*) AS n FROM pt GROUP BY seq_id),
hy AS (SELECT seq_id, h, {', '.join(f'CAST(floor((h * {m}) % 10000000 * n / 1e7) AS BIGINT) AS p{i}' for i, m in enumerate(flow.DEAL))} FROM fs, range(1, {flow.TRIPLES + 1}) t(h) WHERE n >= 12),
tri AS (SELECT hy.seq_id, h, a.x AS x0, a.y AS y0, a.dx AS u0, a.dy AS v0, b.x - a.x AS x1, b.y - a.y AS y1, b.dx - a.dx AS u1, b.dy - a.dy AS v1, g.x - a.x AS x2, g.y - a.y AS y2, g.dx - a.dx AS u2, g.dy - a.dy AS v2
  FROM hy JOIN pt a ON a.seq_id = hy.seq_id AND a.place = p0 JOIN pt b ON b.seq_id = hy.seq_id AND b.place = p1 JOIN pt g ON g.seq_id = hy.seq_id AND g.place = p2),
sl AS (SELECT *, (u1 * y2 - u2 * y1) / det AS bx, (x1 * u2 - x2 * u1) / det AS cx, (v1 * y2 - v2 * y1) / det AS by_, (x1 * v2 - x2 * v1) / det AS cy FROM (SELECT *, x1 * y2 - x2 * y1 AS det FROM tri) WHERE abs(det) > 1),
mo AS (SELECT *, u0 - bx * x0 - cx * y0 AS ax, v0 - by_ * x0 - cy * y0 AS ay FROM sl),
vo AS (SELECT mo.seq_id, h, any_value(struct_pack(ax := ax, bx := bx, cx := cx, ay := ay, by_ := by_, cy := cy)) AS m, count(*) FILTER (WHERE {_off_sql('mo')} <= 3) AS votes FROM pt p JOIN mo ON p.seq_id = mo.seq_id GROUP BY mo.seq_id, h),
b0 AS MATERIALIZED (SELECT seq_id, unnest(m) FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY votes DESC, h) AS nth FROM vo) WHERE nth = 1),
b1 AS MATERIALIZED {_fit_sql('b0')}, b2 AS MATERIALIZED (SELECT * FROM {_fit_sql('b1')} WHERE n >= 12)"""


@query(f"WITH {_MOTION} SELECT fs.seq_id, fs.n AS n_points, coalesce(b2.n, 0) AS n_inliers, round(ax, 6) + 0e0 AS ax, round(bx * 1e4, 6) + 0e0 AS bx, round(cx * 1e4, 6) + 0e0 AS cx, round(ay, 6) + 0e0 AS ay, round(by_ * 1e4, 6) + 0e0 AS \"by\", round(cy * 1e4, 6) + 0e0 AS cy FROM fs LEFT JOIN b2 USING (seq_id)")
def camera_motion(spark, sf_dir):
    """The motion that the matched points of each sequence share, three in ten of them astray."""
    m = flow.camera_motion(matched_points(spark, sf_dir), ["seq_id"])
    return m.select("seq_id", "n_points", "n_inliers", *(_r(F.col(c) * (1.0 if c[0] == "a" else 1e4)).alias(c) for c in flow.MOTION))


def _flow(*of: pa.Array) -> pa.Array:
    """The arrays of boxes of det_id, seq_id, k, width and tall; null where one of these is."""
    known = np.all([a.is_valid().to_numpy(zero_copy_only=False) for a in of], axis=0)
    d, s, k, w, tall = (a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in of)
    n = np.where(known, w * tall, 0)
    ends = np.cumsum(n)
    i = np.arange(n.sum()) - np.repeat(ends - n, n)
    d, s, k, w = (np.repeat(a, n) for a in (d, s, k, w))
    vx = np.fmod(i * 7919 + d * 31, 1009) / 1009 - 0.4 + np.fmod(k, 4) / 20 * (i % w) + np.fmod(s, 7)
    vy = np.fmod(i * 104729 + d * 17, 997) / 997 - 0.7 + 0.03 * (i // w) - np.fmod(s, 3)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(v), mask=pa.array(~known)) for v in (vx, vy)], ["vx", "vy"])


def fields(spark, sf_dir: str, motion: DataFrame | None = None) -> DataFrame:
    """The flow in the box of each detection, as a camera in motion sees it; some boxes are too narrow. The motion of each sequence
    is joined ahead of the arrays, which no shuffle carries then."""
    c = F.col
    d = detections(spark, sf_dir).select("det_id", "seq_id", "k", F.floor("x1").alias("x0"), F.floor("y1").alias("y0"))
    d = d if motion is None else d.join(motion, "seq_id", "left")
    d = d.withColumns({"width": F.when(c("k") % 11 == 0, 6).otherwise(8 + c("k") % 5), "tall": 8 + c("k") % 3})
    flow_ = F.arrow_udf(_flow, "vx array<double>, vy array<double>")
    d = d.withColumn("_f", flow_("det_id", "seq_id", "k", "width", "tall"))
    return d.withColumns({"vx": c("_f.vx"), "vy": c("_f.vy")}).drop("k", "tall", "_f")


_FIELD = f"""{_MOTION}, bx AS (SELECT det_id, seq_id, k, floor(x1) AS x0, floor(y1) AS y0, CASE WHEN k % 11 = 0 THEN 6 ELSE 8 + k % 5 END AS width, 8 + k % 3 AS tall FROM d),
cel AS (SELECT *, i % width AS c, i // width AS r FROM (SELECT *, unnest(range(0, width * tall)) AS i FROM bx)),
vel AS (SELECT cel.det_id, c, r, width, tall, ((i * 7919 + det_id * 31) % 1009) / 1009e0 - 4e-1 + (k % 4) / 2e1 * c + cel.seq_id % 7 - coalesce(ax + b2.bx * (x0 + c) + cx * (y0 + r), 0) AS vx, ((i * 104729 + det_id * 17) % 997) / 997e0 - 7e-1 + 3e-2 * r - cel.seq_id % 3 - coalesce(ay + by_ * (x0 + c) + cy * (y0 + r), 0) AS vy FROM cel LEFT JOIN b2 ON b2.seq_id = cel.seq_id),
gra AS (SELECT *, CASE WHEN c = 0 THEN lead(vx) OVER q - vx WHEN c = width - 1 THEN vx - lag(vx) OVER q ELSE (lead(vx) OVER q - lag(vx) OVER q) / 2 END + CASE WHEN r = 0 THEN lead(vy) OVER s - vy WHEN r = tall - 1 THEN vy - lag(vy) OVER s ELSE (lead(vy) OVER s - lag(vy) OVER s) / 2 END AS g, sqrt(vx * vx + vy * vy) AS m FROM vel WINDOW q AS (PARTITION BY det_id, r ORDER BY c), s AS (PARTITION BY det_id, c ORDER BY r)),
fig AS (SELECT det_id, avg(g) AS dv, sqrt(power(avg(vx), 2) + power(avg(vy), 2)) AS tm, greatest(2e-1, median(m)) AS half FROM gra GROUP BY det_id),
ups AS (SELECT det_id, avg(CASE WHEN vy < 0 THEN 1e0 ELSE 0e0 END) AS up FROM gra JOIN fig USING (det_id) WHERE m > half GROUP BY det_id)"""


@query(f"WITH {_FIELD} SELECT det_id, k % 11 > 0 AS valid, CASE WHEN k % 11 > 0 THEN round(dv, 6) ELSE 0 END + 0e0 AS divergence, CASE WHEN k % 11 > 0 THEN round(coalesce(up, 0), 6) ELSE 0 END + 0e0 AS upward_ratio, CASE WHEN k % 11 > 0 THEN round(tm, 6) ELSE 0 END + 0e0 AS translation_mag FROM bx JOIN fig USING (det_id) LEFT JOIN ups USING (det_id)")
def residual_flow(spark, sf_dir):
    """What the flow in each box shows without the motion that the points of its sequence share."""
    x = flow.residual_flow(fields(spark, sf_dir, flow.camera_motion(matched_points(spark, sf_dir), ["seq_id"])))
    return x.select("det_id", "valid", *(_r(F.col(c)).alias(c) for c in ("divergence", "upward_ratio", "translation_mag")))


def configuration(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flown, sites, cameras): five sites and three cameras that the sequences of the table are dealt to; one sequence in seven
    is of none."""
    n, c = detections(spark, sf_dir).select("seq_id").distinct(), F.col
    name = lambda of, m: F.concat(F.lit(of), (c("seq_id") % m).cast("string"))
    flown = n.where("seq_id % 7 < 6").select("seq_id", name("site", 5).alias("site"), name("camera", 3).alias("camera"))
    s = n.select((c("seq_id") % 5).alias("s")).distinct().withColumns({"lat": 36.4127 + 0.02 * (c("s") - 2), "lon": 128.7043 + 0.015 * (c("s") - 2)})
    unit = lambda label, north, east: F.struct(F.lit(label).alias("name"), (c("lat") + north).alias("lat"), (c("lon") + east).alias("lon"))
    sites = s.select(F.concat(F.lit("site"), c("s").cast("string")).alias("name"), "lat", "lon", (300.0 + 50 * c("s")).alias("patrol_m"), F.array(unit("north", 0.03, -0.015), unit("south", -0.027, 0.044)).alias("units"))
    m = n.select((c("seq_id") % 3).alias("m")).distinct()
    across = geo.focal_of(F.lit(1920), 60.0 + 15 * c("m"))
    upright = F.when(c("m") == 2, geo.focal_of(F.lit(1080), F.lit(60.0))).otherwise(across)
    cameras = m.select(F.concat(F.lit("camera"), c("m").cast("string")).alias("name"), across.alias("fx"), upright.alias("fy"), F.lit(960.0).alias("cx"), F.lit(540.0).alias("cy"), F.array_repeat(F.lit(0.0), 5).alias("lens"), F.lit(False).alias("distorted"))
    return flown, sites, cameras


_SITE_AT = "36412700e-6 + 2e-2 * (s - 2) AS slat, 128704300e-6 + 15e-3 * (s - 2) AS slon"
_OVER_SITE = "a + (c - j) * (b - a) + (r - i) * (cc + (c - j) * (dd - cc) - (a + (c - j) * (b - a)))"
_FLOWN = f"""SELECT det_id, radians(slat) AS p, radians(slon) AS q, ground + 300 + 50 * s AS alt, ((x1 + x2) / 2 - 960) / fx AS a, ((y1 + y2) / 2 - 540) / fy AS b, radians(k * 36e-1) AS yw, radians(-k * 5e-1 - 2) AS pt FROM d
  JOIN (SELECT *, {_OVER_SITE} AS ground FROM (SELECT *, (36412700e-6 + 35e-2 - slat) / (1e0 / 1200) - 5e-1 AS r, (slon - (128704300e-6 - 35e-2)) / (1e0 / 1200) - 5e-1 AS c FROM (SELECT s, {_SITE_AT} FROM range(5) t(s))) JOIN quad ON i = CAST(floor(r) AS INT) AND j = CAST(floor(c) AS INT)) ON s = seq_id % 5
  JOIN (SELECT m, 960 / tan(radians(60 + 15 * m) / 2) AS fx, CASE WHEN m = 2 THEN 540 / tan(radians(60) / 2) ELSE 960 / tan(radians(60 + 15 * m) / 2) END AS fy FROM range(3) t(m)) ON m = seq_id % 3 WHERE seq_id % 7 < 6"""
_N = "6378137e0 / sqrt(1 - 6694379990141317e-18 * power(sin(radians({lat})), 2))"
_PULL = "n * cos(radians(lat)) * {f}(radians(lon)) - m * cos(radians(ulat)) * {f}(radians(ulon))"
_CONFIGURED = f"""{_LINKS}, ld AS (SELECT d.seq_id, l.track_id AS lane, d.frame_index, d.offset_s, d.det_id, d.confidence, x1, y1, x2, y2 FROM links l JOIN d ON d.det_id = l.det_id),
{_OBS.replace(SQL + ',', '', 1).strip().replace('o AS (', 'lo AS (', 1).replace('FROM d)', 'FROM ld)', 1).replace('FROM o WINDOW', 'FROM lo WINDOW', 1)},
t AS (SELECT seq_id, lane, frame_index, det_id, {_features_sql(' OVER (PARTITION BY seq_id, lane ORDER BY offset_s, det_id ROWS UNBOUNDED PRECEDING)')} FROM w),
v AS ({_NAMED.format(key='seq_id, lane, frame_index, det_id', source='t')}),
vv AS (SELECT seq_id, lane, frame_index, struct_pack(det_id := det_id, n := n, flow_ok := centroid_rise_rate >= 1e-4, area_ok := area_growth_rate >= 1e-4 AND area_monotonicity >= 55e-2, met := {_MET}, score := 1 / (1 + exp(-least(greatest({_LOGIT}, -50), 50)))) AS s FROM v),
{crossing_sql(_FLOWN, 'degrees(asin(least(greatest(-u, -1), 1))) >= 8')},
pl AS (SELECT det_id, degrees(asin(least(greatest(-u, -1), 1))) AS depression, CASE WHEN seen.det_id IS NULL THEN 'grazing' WHEN far IS NULL THEN CASE WHEN gone IS NOT NULL OR hit = 0 THEN 'out_of_dem' ELSE 'no_intersection' END END AS reason, lat, lon, far FROM unit LEFT JOIN seen USING (det_id) LEFT JOIN spot USING (det_id)),
un AS (SELECT det_id, min(sqrt(power(-sin(radians(ulon)) * gx + cos(radians(ulon)) * gy, 2) + power(-sin(radians(ulat)) * (cos(radians(ulon)) * gx + sin(radians(ulon)) * gy) + cos(radians(ulat)) * gz, 2))) / 1000 AS km
  FROM (SELECT *, {_PULL.format(f='cos')} AS gx, {_PULL.format(f='sin')} AS gy, (1 - 6694379990141317e-18) * (n * sin(radians(lat)) - m * sin(radians(ulat))) AS gz FROM (SELECT *, {_N.format(lat='lat')} AS n, {_N.format(lat='ulat')} AS m FROM (SELECT det_id, pl.lat, pl.lon, slat + dn AS ulat, slon + de AS ulon FROM pl JOIN d USING (det_id) JOIN (SELECT s, {_SITE_AT} FROM range(5) t(s)) ON s = seq_id % 5, (VALUES (3e-2, -15e-3), (-27e-3, 44e-3)) u(dn, de) WHERE pl.lat IS NOT NULL))) GROUP BY det_id),
ca AS (SELECT l.seq_id, l.track_id, l.frame_index, last_value(vv.s IGNORE NULLS) OVER (PARTITION BY l.seq_id, l.track_id ORDER BY l.frame_index ROWS UNBOUNDED PRECEDING) AS s FROM links l LEFT JOIN vv ON vv.seq_id = l.seq_id AND vv.lane = l.track_id AND vv.frame_index = l.frame_index)"""


@query(f"""WITH RECURSIVE {_CONFIGURED} SELECT seq_id, track_id, frame_index, s.det_id AS det_id, CASE WHEN seq_id % 7 < 6 THEN 'site' || seq_id % 5 END AS site, CASE WHEN seq_id % 7 < 6 THEN 'camera' || seq_id % 3 END AS camera,
 CASE WHEN s.met = 2 AND s.n >= 3 AND lat IS NOT NULL THEN 'FLARE' WHEN s.met >= 1 THEN 'GLOW' ELSE 'SPARK' END AS tier, round(s.score, 6) AS score, s.flow_ok AS flow_ok, s.area_ok AS area_ok, s.n >= 3 AS enough_frames, CAST(s.met AS INT) AS n_satisfied,
 concat_ws('; ', CASE WHEN s.n < 3 THEN printf('{rules.REASONS[0]}', s.n) END, CASE WHEN s.flow_ok THEN '{rules.REASONS[1]}' ELSE '{rules.REASONS[2]}' END || '{rules.PROXY}', CASE WHEN s.area_ok THEN '{rules.REASONS[3]}' ELSE '{rules.REASONS[4]}' END) AS reasons,
 lat IS NOT NULL AS geo_ok, reason, round(depression, 6) AS depression, round(lat, 7) AS lat, round(lon, 7) AS lon, round(far, 3) AS range_m, round(km, 3) AS nearest_unit_km FROM ca LEFT JOIN pl ON pl.det_id = s.det_id LEFT JOIN un ON un.det_id = s.det_id""")
def configured_run(spark, sf_dir):
    """Detections to verdicts with places, by sites and cameras that are tables."""
    heights, grid = crossing.synthetic_heights(spark)
    ground = materialize(crossing.cells_of(heights), "cells")
    d = materialize(detections(spark, sf_dir), "detections").withColumns({"yaw": F.col("k") * 3.6, "pitch": -F.col("k") * 0.5 - 2, "roll": F.lit(0.0)})
    v = run.configured(d, *configuration(spark, sf_dir), ground, grid)
    e = F.col("criteria")
    return v.select(
        "seq_id", "track_id", "frame_index", "det_id", "site", "camera", "tier", _r(F.col("score")).alias("score"), e["flow_ok"].alias("flow_ok"), e["area_ok"].alias("area_ok"), e["enough_frames"].alias("enough_frames"), e["n_satisfied"].alias("n_satisfied"),
        F.array_join(e["reasons"], "; ").alias("reasons"), "geo_ok", "reason", _r(F.col("depression")).alias("depression"), _r(F.col("lat"), 7).alias("lat"), _r(F.col("lon"), 7).alias("lon"), _r(F.col("range_m"), 3).alias("range_m"), _r(F.col("nearest_unit_km"), 3).alias("nearest_unit_km"),
    )


_PACE = "CASE WHEN seq_id % 2 = 0 THEN 1e-1 ELSE 6e1 END"
_PACED = f"""{_FIELD}, {_LINKS.replace(SQL + ',', '', 1).strip()}, ld AS (SELECT d.seq_id, l.track_id AS lane, d.frame_index, CASE WHEN d.seq_id % 2 = 0 THEN d.offset_s / 600 ELSE d.offset_s END AS offset_s, d.det_id, d.confidence, x1, y1, x2, y2, d.k FROM links l JOIN d ON d.det_id = l.det_id),
{_OBS.replace(SQL + ',', '', 1).strip().replace('o AS (', 'lo AS (', 1).replace('FROM d)', 'FROM ld)', 1).replace('FROM o WINDOW', 'FROM lo WINDOW', 1)},
wf AS (SELECT w.*, CASE WHEN k % 11 > 0 THEN dv ELSE 0 END AS dv, CASE WHEN k % 11 > 0 THEN coalesce(up, 0) ELSE 0 END AS up, CASE WHEN k % 11 > 0 THEN tm ELSE 0 END AS tm FROM w JOIN fig USING (det_id) LEFT JOIN ups USING (det_id)),
t AS (SELECT seq_id, lane, frame_index, det_id, {', '.join(f'coalesce(avg({c}) OVER (PARTITION BY seq_id, lane ORDER BY offset_s, det_id ROWS UNBOUNDED PRECEDING), 0) AS f{c}' for c in ('dv', 'up', 'tm'))}, {_features_sql(' OVER (PARTITION BY seq_id, lane ORDER BY offset_s, det_id ROWS UNBOUNDED PRECEDING)')} FROM wf),
v AS ({_NAMED.format(key='seq_id, lane, frame_index, det_id, fdv, fup, ftm', source='t').replace('duration / 60', f'duration / ({_PACE})')}),
m AS (SELECT *, seq_id % 2 = 0 AS dense, CASE WHEN seq_id % 2 = 0 THEN fup >= 55e-2 AND fdv >= 2e-2 ELSE centroid_rise_rate >= 1e-4 END AS motion, area_growth_rate >= 1e-4 AND area_monotonicity >= 55e-2 AS grows FROM v),
vv AS (SELECT seq_id, lane, frame_index, struct_pack(det_id := det_id, n := n, motion := motion, grows := grows, dv := CASE WHEN dense THEN fdv ELSE 0 END, score := 1 / (1 + exp(-least(greatest({_LOGIT} + CASE WHEN dense THEN 9e-1 * fdv / 5e-1 + 6e-1 * (fup - 5e-1) / 25e-2 - 4e-1 * ftm / 2 ELSE 0 END, -50), 50)))) AS s FROM m),
ca AS (SELECT l.seq_id, l.track_id, l.frame_index, last_value(vv.s IGNORE NULLS) OVER (PARTITION BY l.seq_id, l.track_id ORDER BY l.frame_index ROWS UNBOUNDED PRECEDING) AS s FROM links l LEFT JOIN vv ON vv.seq_id = l.seq_id AND vv.lane = l.track_id AND vv.frame_index = l.frame_index)"""


@query(f"WITH RECURSIVE {_PACED} SELECT seq_id, track_id, frame_index, CASE WHEN seq_id % 2 = 0 THEN 'dense' ELSE 'sparse' END AS mode, s.motion AS flow_ok, s.grows AS area_ok, s.n >= CASE WHEN seq_id % 2 = 0 THEN 12 ELSE 3 END AS enough_frames, round(s.dv, 6) + 0e0 AS flow_divergence, round(s.score, 6) AS score, CASE WHEN s.motion AND s.grows AND s.n >= CASE WHEN seq_id % 2 = 0 THEN 12 ELSE 3 END AND s.det_id % 5 > 1 THEN 'FLARE' WHEN s.motion OR s.grows THEN 'GLOW' ELSE 'SPARK' END AS tier FROM ca")
def paced_run(spark, sf_dir):
    """Verdicts in the mode of each sequence's own frames: every other sequence has ten a second, and is judged by the flow that is
    left without its camera's motion."""
    d, c = detections(spark, sf_dir), F.col
    f = flow.residual_flow(fields(spark, sf_dir, flow.camera_motion(matched_points(spark, sf_dir), ["seq_id"])))
    f = f.select("det_id", "divergence", "upward_ratio", "translation_mag")
    d = d.withColumn("offset_s", F.when(c("seq_id") % 2 == 0, c("offset_s") / 600).otherwise(c("offset_s"))).join(f, "det_id", "left")
    some = lambda v: F.when(c("det_id") % 5 > 1, v)
    places = d.select(c("det_id").alias("row_id"), F.lit(30.0).alias("depression"), F.lit(None).cast("string").alias("reason"), some(c("lat")).alias("lat"), some(c("lon")).alias("lon"), *(some(F.lit(0.0)).alias(k) for k in ("elevation_m", "range_m", "cep50_m", "cep90_m")))
    v = run.verdicts_by_cadence(materialize(d.drop("lat", "lon"), "paced"), materialize(places, "fixes"))
    e = c("criteria")
    return v.select("seq_id", "track_id", "frame_index", "mode", e["flow_ok"].alias("flow_ok"), e["area_ok"].alias("area_ok"), e["enough_frames"].alias("enough_frames"), _r(c("flow_divergence")).alias("flow_divergence"), _r(c("score")).alias("score"), "tier")
