"""Detectors as callbacks over image tables: no vision library is needed here, the caller brings the model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators.matching import suppressed

#: x1, y1, x2, y2, confidence of each detection
Found = list[tuple[float, float, float, float, float]]
_OUT = "seq_id long, frame_index int, x1 double, y1 double, x2 double, y2 double, confidence double"


def detected(images: DataFrame, load: Callable[[], Callable[[bytes], Found]], confidence: float = 0.20) -> DataFrame:
    """Detections of images(seq_id, frame_index, content), at least `confidence`. load makes the detector once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detect = load()
        for b in batches:
            rows = [(s, f, *map(float, d)) for s, f, c in zip(*(x.to_pylist() for x in b.columns), strict=True) for d in detect(c) if d[4] >= confidence]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[2:])], ["seq_id", "frame_index", "x1", "y1", "x2", "y2", "confidence"])

    return images.select(F.col("seq_id").cast("long"), F.col("frame_index").cast("int"), "content").mapInArrow(run, _OUT)


def merged(of_tiles: DataFrame, of_frames: DataFrame | None = None, threshold: float = 0.4) -> DataFrame:
    """Detections of tiles(seq_id, frame_index, tile_x, tile_y, x1 .. y2, confidence), moved to their place in the frame, and
    of whole frames, without those that overlap a more confident one by more than the threshold."""
    moved = of_tiles.select("seq_id", "frame_index", *((F.col(c) + F.col(t)).alias(c) for c, t in (("x1", "tile_x"), ("y1", "tile_y"), ("x2", "tile_x"), ("y2", "tile_y"))), "confidence")
    fields = ("x1", "y1", "x2", "y2", "confidence")
    every = moved if of_frames is None else moved.unionByName(of_frames.select("seq_id", "frame_index", *fields))
    return suppressed(every, threshold, fields=fields)
