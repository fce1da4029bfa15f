"""Motion of the camera between two frames from matched points, and what the flow in a box shows once that motion is taken out.

Points are rows, (*keys, point_id, x, y, dx, dy): where a point was, and how far it went. A box's field is two arrays, rows first.
The motion is affine, which far scenery under a moving camera follows: dx = ax + bx x + cx y, dy = ay + by x + cy y.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazeline.session import materialize, task_count

#: Pixels that a point may stray from the motion, points needed, the margin around a box as a share of its sides,
#: the least side of a field in pixels, and the pixels below which nothing moves.
TOLERANCE, LEAST, MARGIN, SMALL, STILL = 3.0, 12, 0.25, 8, 0.2
#: Triples of points that a frame's motion is sought with; with three points in ten astray all miss once in 10^11 frames.
TRIPLES = 64
#: Steps in ten-millionths that deal the places of a triple evenly over a frame's points.
DEAL = (4142135, 7320508, 2360679)
MOTION = ["ax", "bx", "cx", "ay", "by", "cy"]
#: What the flow in a box shows.
FIGURES = ["divergence", "upward_ratio", "translation_mag"]


def background(points: DataFrame, boxes: DataFrame, keys: list[str], margin: float = MARGIN) -> DataFrame:
    """Points outside all boxes(*keys, x1, y1, x2, y2) of their frame, each widened by a share of its sides. What burns or drifts
    says nothing of the camera. A box or point with a null holds nothing back."""
    side = {"_w": (F.col("x2") - F.col("x1")) * margin, "_h": (F.col("y2") - F.col("y1")) * margin}
    b = boxes.withColumns(side).select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col("x1") - F.col("_w")).alias("_x1"), (F.col("y1") - F.col("_h")).alias("_y1"), (F.col("x2") + F.col("_w")).alias("_x2"), (F.col("y2") + F.col("_h")).alias("_y2"))
    inside = F.col("x").between(F.col("_x1"), F.col("_x2")) & F.col("y").between(F.col("_y1"), F.col("_y2"))
    return points.join(b, reduce(lambda a, c: a & c, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), inside), "left_anti")


def _off(x: Column, y: Column, dx: Column, dy: Column) -> Column:
    """How far a point strays from the motion of its row."""
    return F.hypot(dx - (F.col("ax") + F.col("bx") * x + F.col("cx") * y), dy - (F.col("ay") + F.col("by") * x + F.col("cy") * y))


def _through_three(p: DataFrame) -> DataFrame:
    """The motion that three points a, b, c of a row share; triples on or near a line are left out."""
    d = lambda q, v: F.col(f"{q}.{v}") - F.col(f"a.{v}")
    p = p.withColumn("_det", d("b", "x") * d("c", "y") - d("c", "x") * d("b", "y")).where(F.abs("_det") > 1)
    for v, k in (("dx", "x"), ("dy", "y")):
        p = p.withColumns({f"b{k}": (d("b", v) * d("c", "y") - d("c", v) * d("b", "y")) / F.col("_det"), f"c{k}": (d("b", "x") * d("c", v) - d("c", "x") * d("b", v)) / F.col("_det")})
        p = p.withColumn(f"a{k}", F.col(f"a.{v}") - F.col(f"b{k}") * F.col("a.x") - F.col(f"c{k}") * F.col("a.y"))
    return p.drop("_det", "a", "b", "c")


def _least_squares(p: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, motion, n_inliers) of the points of each frame."""
    sums = {"xx": F.var_pop("x"), "yy": F.var_pop("y"), "xy": F.covar_pop("x", "y"), **{m + v: F.covar_pop(m, v) for m in "xy" for v in ("dx", "dy")}, **{f"m_{v}": F.avg(v) for v in ("x", "y", "dx", "dy")}}
    s = p.groupBy(*keys).agg(F.count("*").alias("n_inliers"), *(v.alias(k) for k, v in sums.items()))
    c = F.col
    s = s.withColumn("_det", c("xx") * c("yy") - c("xy") * c("xy")).where(F.col("_det") > 1e-6)
    for v, k in (("dx", "x"), ("dy", "y")):
        s = s.withColumns({f"b{k}": (c("x" + v) * c("yy") - c("y" + v) * c("xy")) / c("_det"), f"c{k}": (c("y" + v) * c("xx") - c("x" + v) * c("xy")) / c("_det")})
        s = s.withColumn(f"a{k}", c(f"m_{v}") - c(f"b{k}") * c("m_x") - c(f"c{k}") * c("m_y"))
    return s.select(*keys, *MOTION, "n_inliers")


def camera_motion(points: DataFrame, keys: list[str], tolerance: float = TOLERANCE, least: int = LEAST, triples: int = TRIPLES) -> DataFrame:
    """(*keys, n_points, n_inliers, ax, bx, cx, ay, by, cy), a row for each frame that has a point.

    Each of a fixed number of triples gives a motion; the one that most points agree with, the first of equals, picks the points
    that a fit by least squares is made of, twice. The motion is null where fewer than `least` points are there or agree, or all
    lie on a line; n_inliers is then 0. Points with a null aren't counted. A frame's points meet its triples by a join on the
    frame, and every step is a grouped sum. Keys may be null; point_id orders points, equal ones by what they hold.
    """
    p = points.dropna(subset=["x", "y", "dx", "dy"]).select(*keys, "point_id", "x", "y", "dx", "dy")
    p = p.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("point_id", "x", "y", "dx", "dy")) - 1)
    p, at = materialize(p, "points"), ["x", "y", "dx", "dy"]
    frames = p.groupBy(*keys).agg(F.count("*").alias("n_points"))
    frame = lambda a, b: reduce(lambda s, c: s & c, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))
    one = lambda a, rest=(): [*(F.col(f"{a}.{k}") for k in keys), *rest]

    # few bytes, of which many rows are made; by other columns than frames are grouped by, or the planner leaves it out
    asked = frames.where(F.col("n_points") >= least).repartition(task_count(points.sparkSession), *keys, "n_points").withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(triples))))
    nth = lambda m: F.floor(F.pmod(F.col("_h").cast("long") * m, F.lit(10_000_000)) * F.col("n_points") / 10_000_000)
    asked = asked.withColumn("_t", F.explode(F.array(*(F.struct(F.lit(c).alias("corner"), nth(m).alias("place")) for c, m in zip("abc", DEAL, strict=True))))).select(*keys, "_h", "_t.corner", "_t.place")
    # no broadcast of points or triples: rows that explode makes are many more than the planner takes them for
    three = asked.alias("q").join(p.hint("merge").alias("p"), frame("q", "p") & (F.col("q.place") == F.col("p._place"))).select(*one("q"), "_h", "corner", *at)
    three = three.groupBy(*keys, "_h").agg(*(F.max(F.when(F.col("corner") == c, F.col(v))).alias(c + v) for c in "abc" for v in at))
    motions = _through_three(three.select(*keys, "_h", *(F.struct(*(F.col(c + v).alias(v) for v in at)).alias(c) for c in "abc")))
    motions = materialize(motions.select(*keys, "_h", *MOTION), "triples")

    held = F.sum((_off(*(F.col(v) for v in at)) <= tolerance).cast("long")).alias("_n")
    votes = p.hint("merge").alias("p").join(motions.alias("m"), frame("p", "m")).select(*one("p", ["_h", *at, *MOTION])).groupBy(*keys, "_h").agg(held)
    # most votes, then the first triple, as one number
    first = votes.groupBy(*keys).agg(F.max(F.col("_n") * (triples + 1) - F.col("_h")).alias("_v")).withColumn("_h", F.pmod(-F.col("_v"), F.lit(triples + 1)))
    best = first.alias("v").join(motions.hint("merge").alias("m"), frame("v", "m") & (F.col("v._h") == F.col("m._h"))).select(*one("m"), *MOTION)
    best = materialize(best, "motions")
    for _ in range(2):
        near = p.hint("merge").alias("p").join(best.alias("m"), frame("p", "m")).select(*one("p", [*at, *MOTION]))
        best = _least_squares(near.where(_off(*(F.col(v) for v in at)) <= tolerance).drop(*MOTION), keys)
    best = best.where(F.col("n_inliers") >= least)
    x = frames.alias("f").join(best.alias("m"), frame("f", "m"), "left")
    return x.select(*one("f"), "n_points", F.coalesce("n_inliers", F.lit(0)).alias("n_inliers"), *MOTION)


def _edge(n: int) -> np.ndarray:
    """What each value in a row of n counts in the sum of the row's differences: central ones, one-sided at the ends. All but the
    two at each end cancel."""
    w = np.zeros(n)
    if n > 1:
        np.add.at(w, [0, 1, n - 2, n - 1], [-1.5, 0.5, -0.5, 1.5])
    return w


def _figures(small: int, most: int = 1 << 20):
    """The function of Arrow arrays vx, vy, width and, if a motion is to be taken out, x0, y0 and its columns. Boxes of one shape are
    worked on together, `most` values at a time."""

    def flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, where each row's begin, and their number: -1 without an array or with a null in it."""
        sizes = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values, starts = a.flatten().cast(pa.float64()), np.cumsum(sizes) - sizes
        gone = np.repeat(np.arange(len(sizes)), sizes)[values.is_null().to_numpy(zero_copy_only=False)]
        size = np.where(a.is_valid().to_numpy(zero_copy_only=False), sizes, -1)
        size[gone] = -1
        return values.to_numpy(zero_copy_only=False), starts, size

    def run(vx: pa.Array, vy: pa.Array, width: pa.Array, *motion: pa.Array) -> pa.Array:
        (fx, ax, n), (fy, ay, ny) = flat(vx), flat(vy)
        w = width.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        valid = (n == ny) & (w >= max(small, 1)) & (n >= w * small) & (n % np.maximum(w, 1) == 0)
        out = np.zeros((3, len(w)))
        if motion:
            known = [m.is_valid().to_numpy(zero_copy_only=False) for m in motion]
            moved, there = np.all(known[2:], axis=0), known[0] & known[1]
            x0, y0, *m = (m.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)[:, None] for m in motion)
        for wide, size in sorted(set(zip(w[valid].tolist(), n[valid].tolist(), strict=True))):
            rows, step = np.flatnonzero(valid & (w == wide) & (n == size)), max(most // size, 1)
            at = np.arange(size)
            i, j = at % wide, at // wide
            across, down = _edge(wide)[i], _edge(size // wide)[j]
            for own in (rows[k : k + step] for k in range(0, len(rows), step)):
                x, y = fx[ax[own, None] + at], fy[ay[own, None] + at]
                if motion:
                    t, u = x0[own] + i, y0[own] + j
                    still = [v - (a[own] + b[own] * t + c[own] * u) for v, (a, b, c) in ((x, m[:3]), (y, m[3:]))]
                    x, y = (np.where(moved[own, None], s, v) for s, v in zip(still, (x, y), strict=True))
                size_of = np.sqrt(x * x + y * y)
                order = np.sort(size_of, axis=1)
                half = np.maximum(STILL, (order[:, (size - 1) // 2] + order[:, size // 2]) / 2)[:, None]
                moving = ~(size_of <= half) & ~np.isnan(half)
                many = moving.sum(1)
                up = (moving & (y < 0)).sum(1) / np.maximum(many, 1)
                figures = np.stack([(x @ across + y @ down) / size, up, np.hypot(x.sum(1) / size, y.sum(1) / size)])
                out[:, own] = np.where(~moved[own] | there[own], figures, 0.0) if motion else figures
        return pa.StructArray.from_arrays([pa.array(valid), *map(pa.array, out)], ["valid", *FIGURES])

    return run


def residual_flow(fields: DataFrame, small: int = SMALL) -> DataFrame:
    """fields with valid, divergence, upward_ratio and translation_mag of the flow in each box.

    fields has vx and vy, arrays of a box's flow in pixels, rows first; width, the length of a row; and x0, y0, the pixel of the
    first value. Where it has the six columns of a motion that aren't null, that is taken out first. Divergence is the mean of
    both slopes, upward_ratio the share of what moves that goes up (more than 0.2 pixels and more than the median), translation
    the length of the mean. A field of fewer than `small` rows or columns, or without arrays, or whose arrays don't make whole
    rows of one size, or hold nulls, isn't valid and has zeros. No shuffle: a function of the arrays in Arrow batches.
    """
    motion = ["x0", "y0", *MOTION] if all(c in fields.columns for c in MOTION) else []
    figures = F.arrow_udf(_figures(small), f"valid boolean, {', '.join(f'{k} double' for k in FIGURES)}")
    d = fields.withColumn("_figures", figures("vx", "vy", F.col("width").cast("int"), *motion))
    return d.withColumns({k: F.col(f"_figures.{k}") for k in ("valid", *FIGURES)}).drop("_figures")
