"""Boxes as columns: x1, y1, x2, y2 in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(p: str = "") -> Column:
    return F.col(f"{p}x2") - F.col(f"{p}x1")


def height(p: str = "") -> Column:
    return F.col(f"{p}y2") - F.col(f"{p}y1")


def area(p: str = "") -> Column:
    return F.greatest(width(p), F.lit(0.0)) * F.greatest(height(p), F.lit(0.0))


def center(p: str = "") -> tuple[Column, Column]:
    return (F.col(f"{p}x1") + F.col(f"{p}x2")) / 2, (F.col(f"{p}y1") + F.col(f"{p}y2")) / 2


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo)), F.lit(0.0))
    common = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def affinity(a: str, b: str, iou_threshold: float = 0.10, center_factor: float = 1.5) -> Column:
    """1 + IoU of overlapping boxes, else 1 - distance / limit within the limit, else 0."""
    (ax, ay), (bx, by) = center(a), center(b)
    far, limit = F.hypot(ax - bx, ay - by), center_factor * F.greatest(F.sqrt(area(a)), F.lit(1.0))
    return F.when(iou(a, b) >= iou_threshold, 1 + iou(a, b)).when(far <= limit, 1 - far / limit).otherwise(0.0)


def letterbox(w: Column, h: Column, size: int = 1024) -> tuple[Column, Column, Column]:
    """Scale and left and top padding that fit w x h into a square; sizes round half to even."""
    scale = F.least(size / w, size / h)
    pad = lambda side: F.floor((size - F.bround(side * scale)) / 2)
    return scale, pad(w), pad(h)


def tile_starts(side: Column, tile: int, overlap: float) -> Column:
    """Ascending distinct starts of the tiles that cover a side; one tile where the side fits."""
    stride = max(1, round(tile * (1 - overlap)))
    n = F.ceil((side - tile) / stride) + 1
    spread = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.bround(i * (side - tile) / (n - 1)).cast("long"))
    return F.when(side <= tile, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(spread))


def decoded(cx: Column, cy: Column, w: Column, h: Column, scale: Column, pad_x: Column, pad_y: Column) -> dict[str, Column]:
    """Corners in the source image of a box given by its centre and size in a letterboxed one."""
    return {"x1": (cx - w / 2 - pad_x) / scale, "y1": (cy - h / 2 - pad_y) / scale, "x2": (cx + w / 2 - pad_x) / scale, "y2": (cy + h / 2 - pad_y) / scale}


def tiles(w: Column, h: Column, tile: int, overlap: float) -> Column:
    """Array of struct(x, y) corners of the tiles that cover a frame, row by row."""
    xs, ys = tile_starts(w, tile, overlap), tile_starts(h, tile, overlap)
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: float = 1.4, least: float = 160.0) -> dict[str, Column]:
    """left, top and size of a square around a box with a margin on every side, slid into the frame; whole pixels, halves to
    even. Of a whole track the box is the union of its boxes (margin 0.9, least 120)."""
    side = F.greatest(F.greatest(x2 - x1, y2 - y1, F.lit(1.0)) * (1 + 2 * margin), F.lit(least))
    side = F.least(side, F.least(width, height).cast("double"))
    at = lambda lo, hi, room: F.bround(F.least(F.greatest((lo + hi) / 2 - side / 2, F.lit(0.0)), room - side)).cast("long")
    return {"left": at(x1, x2, width), "top": at(y1, y2, height), "size": F.bround(side).cast("long")}
