"""Detections from the events table: two a frame, five lanes, one frame a minute, ignition at frame 16."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazeline.session import table

LANES = ["click", "error", "purchase", "signup"]


def detections(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """The view; numbered, with a column place as well, the detection's place in its sequence by time."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    lane = F.lit(4)
    for i, name in enumerate(LANES):
        lane = F.when(F.col("event_type") == name, i).otherwise(lane)
    frame = F.floor(at / 2).cast("int")
    d = e.select(F.col("event_id").alias("det_id"), F.col("user_id").alias("seq_id"), F.col("event_type").alias("lane"), lane.alias("lane_idx"), frame.alias("frame_index"), "value", "k", *([at.alias("place")] if numbered else []))
    d = d.withColumns({"offset_s": ((F.col("frame_index") - 16) * 60).cast("double"), "confidence": 0.20 + F.col("k") * 0.0078})
    cx = (200 + 380 * F.col("lane_idx") + (F.col("k") - 50)).cast("double")
    cy = (540 - 3 * (F.col("lane_idx") - 1) * F.col("frame_index") + F.col("k") % 7).cast("double")
    half = (40.0 + F.col("value") * 0.5) / 2
    d = d.select("det_id", "seq_id", "lane", "frame_index", "offset_s", (cx - half).alias("x1"), (cy - half).alias("y1"), (cx + half).alias("x2"), (cy + half).alias("y2"), "confidence", "k", *(["place"] if numbered else []))
    return d.withColumns({"lat": 36.06 + 0.7 * ((F.col("det_id") * 31) % 1000) / 1000.0, "lon": 128.35 + 0.7 * ((F.col("det_id") * 37) % 1000) / 1000.0})


#: The same view for the SQL side.
SQL = """
base AS (SELECT event_id, user_id AS seq_id, event_type AS lane, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
f AS (SELECT *, CAST(floor(rn / 2.0) AS INT) AS frame_index, CASE lane WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS lane_idx FROM base),
c AS (SELECT event_id AS det_id, seq_id, lane, frame_index, CAST((frame_index - 16) * 60 AS DOUBLE) AS offset_s, CAST(200 + 380 * lane_idx + (k - 50) AS DOUBLE) AS cx,
  CAST(540 - 3 * (lane_idx - 1) * frame_index + (k % 7) AS DOUBLE) AS cy, (40e0 + value * 5e-1) / 2 AS half, 2e-1 + k * 78e-4 AS confidence, k FROM f),
d AS (SELECT det_id, seq_id, lane, frame_index, offset_s, cx - half AS x1, cy - half AS y1, cx + half AS x2, cy + half AS y2, confidence, k,
  3606e-2 + 7e-1 * ((det_id * 31) % 1000) / 1000e0 AS lat, 12835e-2 + 7e-1 * ((det_id * 37) % 1000) / 1000e0 AS lon FROM c)
"""
