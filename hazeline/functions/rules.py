"""Track features, the two-condition rule, scores and tiers as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from hazeline.functions import geometry as g

#: Thresholds of the rule and of the auxiliary score.
RISE, GROWTH, MONOTONE, UPWARD, DIVERGENCE, NEED_SPARSE, NEED_DENSE = 1e-4, 1e-4, 0.55, 0.55, 0.02, 3, 12
FLARE_SCORE, GLOW_SCORE, INTERCEPT = 0.70, 0.35, -0.5
#: Fixed values: (feature, weight, centre, scale), sparse ones first, then those that need optical flow.
SCORER = [
    ("persistence", 1.2, 0.5, 0.3), ("area_growth_rate", 1.0, 0.0, 1e-3), ("area_monotonicity", 0.8, 0.5, 0.25), ("centroid_rise_rate", 0.8, 0.0, 1e-3),
    ("translation_over_growth", -0.7, 0.0, 50.0), ("aspect_growth_rate", 0.3, 0.0, 1e-3), ("intensity_flicker", 0.4, 0.05, 0.05), ("edge_softness", 0.3, 0.5, 0.2),
    ("confidence_mean", 0.8, 0.4, 0.2), ("confidence_slope", 0.3, 0.0, 1e-3),
    ("flow_divergence", 0.9, 0.0, 0.5), ("flow_upward_ratio", 0.6, 0.5, 0.25), ("flow_translation_mag", -0.4, 0.0, 2.0),
]
#: Frames at most so many seconds apart are dense; sequences need so many labels of each class to learn from.
DENSE_INTERVAL = 0.2
TIERS = ["SPARK", "GLOW", "FLARE"]
SPARSE, DENSE = [f for f, *_ in SCORER[:10]], [f for f, *_ in SCORER]
#: Reasons of a verdict (too few observations; motion seen, not seen; area grows, doesn't) and the mark of sparse mode.
REASONS = ("관측 %d회 — 시퀀스 검증에 필요한 프레임 부족", "상승·확산 운동 확인", "상승·확산 운동 미확인", "면적 단조 증가 확인", "면적 증가 미확인")
PROXY = " (기하 대용값)"


def slope(y: Column, t: Column, over: WindowSpec | None = None) -> Column:
    """Least squares slope; 0 with fewer than two times or no spread in time."""
    wrap = lambda c: c.over(over) if over is not None else c
    n, spread = wrap(F.count(t)), wrap(F.var_pop(t))
    return F.when((n >= 2) & (spread * n >= 1e-12), wrap(F.regr_slope(y, t))).otherwise(0.0)


def mode_of(interval: Column) -> Column:
    return F.when(interval <= DENSE_INTERVAL, "dense").otherwise("sparse")


def feature_names(mode: str) -> list[str]:
    return DENSE if mode == "dense" else SPARSE


def feature_vector(mode: str) -> Column:
    """The features of a mode in the order of the weights."""
    return F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feature_names(mode)))


def observations(d: DataFrame, keys: tuple[str, ...] = ("seq_id", "lane")) -> DataFrame:
    """Detections with centre, area (1 at least), aspect and whether the area has grown since the observation before."""
    x, y = g.center()
    order = Window.partitionBy(*keys).orderBy("offset_s", "det_id")
    o = d.withColumns({"cx": x, "cy": y, "area": F.greatest(g.area(), F.lit(1.0)), "aspect": F.log(F.greatest(g.height(), F.lit(1.0)) / F.greatest(g.width(), F.lit(1.0)))})
    before = F.lag("area").over(order)
    return o.withColumn("grew", F.when(before.isNull(), None).when(F.col("area") > before, 1.0).otherwise(0.0))


def features(interval: float | Column = 60.0, over: WindowSpec | None = None) -> dict[str, Column]:
    """Features of a track, as aggregates or over a window of its past. One observation has persistence and confidence only. Over a
    window the seconds between frames may be a column, each sequence's own."""
    pace = F.greatest(interval, F.lit(1e-6)) if isinstance(interval, Column) else max(interval, 1e-6)
    wrap = lambda c: c.over(over) if over is not None else c
    t = F.col("offset_s")
    n, span = wrap(F.count("*")), wrap(F.max(t)) - wrap(F.min(t))
    s = lambda c: slope(c, t, over)
    scale = F.greatest(wrap(F.avg(F.sqrt("area"))), F.lit(1.0))
    growth, dx, dy = s(F.log("area")), s(F.col("cx")), s(F.col("cy"))
    many = lambda c: F.when(n >= 2, c).otherwise(0.0)
    return {
        "n": n, "duration": span, "persistence": F.least(F.lit(1.0), n / F.greatest(F.lit(1.0), span / pace + 1)),
        "area_growth_rate": many(growth), "area_monotonicity": many(F.coalesce(wrap(F.avg("grew")), F.lit(0.0))), "centroid_rise_rate": many(-dy / scale), "drift_rate": many(F.abs(dx) / scale),
        "translation_over_growth": many(F.hypot(dx, dy) / scale / (F.abs(growth) + 1e-3)), "aspect_growth_rate": many(s(F.col("aspect"))),
        "confidence_mean": wrap(F.avg("confidence")), "confidence_slope": many(s(F.col("confidence"))),
    }


def cadence(frames: DataFrame, key: str = "seq_id") -> DataFrame:
    """(key, cadence_s) of frames(key, offset_s): the median of the positive steps of at most twice the least, 1 where there is none.
    Frames without an offset say nothing."""
    t = frames.select(key, "offset_s").distinct()
    step = t.where("offset_s IS NOT NULL").withColumn("step", F.col("offset_s") - F.lag("offset_s").over(Window.partitionBy(key).orderBy("offset_s")))
    least = step.where("step > 0").withColumn("least", F.min("step").over(Window.partitionBy(key)))
    c = least.where("step <= 2 * least").groupBy(key).agg(F.percentile("step", 0.5).alias("cadence_s")).withColumnRenamed(key, "_key")
    x = t.select(key).distinct()
    return x.join(c, x[key].eqNullSafe(c["_key"]), "left").select(key, F.coalesce("cadence_s", F.lit(1.0)).alias("cadence_s"))


def flow_features(over: WindowSpec | None = None) -> dict[str, Column]:
    """Means of the flow statistics divergence, upward_ratio and translation_mag over the observations that have any; an
    absent one of those counts as 0. Without any all are 0."""
    wrap = lambda c: c.over(over) if over is not None else c
    columns = ["divergence", "upward_ratio", "translation_mag"]
    some = F.coalesce(*columns).isNotNull()
    names = ("flow_divergence", "flow_upward_ratio", "flow_translation_mag")
    return {n: F.coalesce(wrap(F.avg(F.when(some, F.coalesce(c, F.lit(0.0))))), F.lit(0.0)) for n, c in zip(names, columns, strict=True)}


def softness(patch: Column, side: int) -> Column:
    """How blurred the steepest edge of a square patch is (side x side values, rows first): 1 less the 99th percentile of the
    gradient over the contrast, between 0 and 1; 1 for a flat patch. Gradients are central differences, one-sided at the
    borders."""
    at = lambda i, j: F.get(patch, i * side + j)

    def diff(i, j, di, dj):
        k = i if di else j
        lo, hi = F.greatest(k - 1, F.lit(0)), F.least(k + 1, F.lit(side - 1))
        return ((at(hi, j) - at(lo, j)) if di else (at(i, hi) - at(i, lo))) / (hi - lo)

    cells = F.sequence(F.lit(0), F.lit(side * side - 1))
    steep = F.array_sort(F.transform(cells, lambda k: F.hypot(diff((k / side).cast("int"), (k % side).cast("int"), 1, 0), diff((k / side).cast("int"), (k % side).cast("int"), 0, 1))))
    place = 0.99 * (side * side - 1)
    low, part = int(place), place - int(place)
    p99 = F.get(steep, F.lit(low)) * (1 - part) + F.get(steep, F.lit(min(low + 1, side * side - 1))) * part
    contrast = F.array_max(patch) - F.array_min(patch)
    return F.when(contrast < 1e-6, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - p99 / contrast)))


def appearance(o: DataFrame, keys: tuple[str, ...], side: int = 48) -> DataFrame:
    """(*keys, intensity_flicker, edge_softness) of observations with patch, an array of side x side grey values, or null:
    deviation over mean of the patches' brightness (two patches at least), and the mean softness of the last five."""
    x = o.where("patch IS NOT NULL").withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("offset_s"), F.desc("det_id"))))
    bright = F.aggregate("patch", F.lit(0.0), lambda s, v: s + v) / F.size("patch")
    x = x.withColumns({"_bright": bright, "_soft": F.when((F.col("_nth") <= 5) & F.lit(side >= 4), softness(F.col("patch"), side))})
    flicker = F.when((F.count("*") >= 2) & (F.avg("_bright") > 1e-6), F.stddev_pop("_bright") / F.avg("_bright")).otherwise(0.0)
    return x.groupBy(*keys).agg(flicker.alias("intensity_flicker"), F.coalesce(F.avg("_soft"), F.lit(0.0)).alias("edge_softness"))


def looks(patch: Column, side: int = 48) -> dict[str, Column]:
    """Brightness of a patch, and how soft its edge is; null without a patch."""
    bright = F.aggregate(patch, F.lit(0.0), lambda s, v: s + v) / F.size(patch)
    return {"brightness": F.when(patch.isNotNull(), bright), "softness": F.when(patch.isNotNull(), softness(patch, side) if side >= 4 else F.lit(0.0))}


def appearance_so_far(o: DataFrame, keys: tuple[str, ...], side: int = 48) -> DataFrame:
    """Observations with patch, with intensity_flicker and edge_softness of the patches up to each of them. The last five are a
    window over the rows that have a patch, so nothing is gathered for a track."""
    o = o.withColumns(looks(F.col("patch"), side)).withColumn("_has", F.col("patch").isNotNull())
    order = ("offset_s", "det_id")
    five = F.avg("softness").over(Window.partitionBy(*keys, "_has").orderBy(*order).rowsBetween(-4, 0))
    o = o.withColumn("_five", F.when(F.col("_has"), five))
    past = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mean = F.avg("brightness").over(past)
    flicker = F.when((F.count("brightness").over(past) >= 2) & (mean > 1e-6), F.stddev_pop("brightness").over(past) / mean).otherwise(0.0)
    soft = F.coalesce(F.last("_five", ignorenulls=True).over(past), F.lit(0.0))
    return o.withColumns({"intensity_flicker": flicker, "edge_softness": soft}).drop("brightness", "softness", "_has", "_five")


def criteria(mode: str = "sparse") -> tuple[Column, Column, Column]:
    """(motion, area, enough). Dense sequences have flow to judge motion by; in sparse ones the rise of the centre stands in."""
    c = F.col
    motion = (c("flow_upward_ratio") >= UPWARD) & (c("flow_divergence") >= DIVERGENCE) if mode == "dense" else c("centroid_rise_rate") >= RISE
    return motion, (c("area_growth_rate") >= GROWTH) & (c("area_monotonicity") >= MONOTONE), c("n") >= (NEED_DENSE if mode == "dense" else NEED_SPARSE)


def evidence(mode: str = "sparse") -> Column:
    """The verdict with the figures it rests on and its reasons in words."""
    motion, area, enough = criteria(mode)
    value = lambda f: (F.col(f) if mode == "dense" else F.lit(0.0)).alias(f)
    return F.struct(
        motion.alias("flow_ok"), area.alias("area_ok"), (motion.cast("int") + area.cast("int")).alias("n_satisfied"), enough.alias("enough_frames"), F.lit(mode != "dense").alias("flow_from_proxy"),
        value("flow_upward_ratio"), value("flow_divergence"), F.col("centroid_rise_rate").alias("rise_rate"), F.col("area_growth_rate"), F.col("area_monotonicity"), reasons(motion, area, enough, mode).alias("reasons"),
    )


def tier(motion: Column, area: Column, enough: Column, located: Column) -> Column:
    met = motion.cast("int") + area.cast("int")
    return F.when((met == 2) & enough & located, "FLARE").when(met >= 1, "GLOW").otherwise("SPARK")


def contributions(mode: str = "sparse", patches: bool = False, weights: dict[str, float] | None = None) -> dict[str, Column]:
    """Weighted standardised features; flicker and softness count as 0 where there are no patches. weights, as fitted,
    replace the fixed ones."""
    value = lambda f: F.lit(0.0) if f in ("intensity_flicker", "edge_softness") and not patches else F.col(f)
    return {f: (weights or {}).get(f, w) * (value(f) - c) / s for f, w, c, s in SCORER if f in feature_names(mode)}


def score(mode: str = "sparse", patches: bool = False, weights: dict[str, float] | None = None) -> Column:
    logit = sum(contributions(mode, patches, weights).values(), F.lit((weights or {}).get("intercept", INTERCEPT)))
    return 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-50.0)), F.lit(50.0))))


def tier_from_score(located: Column) -> Column:
    high = F.col("score") >= FLARE_SCORE
    return F.when(high & located & (F.col("n") >= NEED_SPARSE), "FLARE").when(F.col("score") >= GLOW_SCORE, "GLOW").otherwise("SPARK")


def reasons(motion: Column, area: Column, enough: Column, mode: str = "sparse") -> Column:
    """Why a track got its verdict, as an array in fixed order."""
    few, seen, unseen, grows, not_ = REASONS
    proxy = "" if mode == "dense" else PROXY
    return F.array_compact(F.array(F.when(~enough, F.format_string(few, "n")), F.when(motion, seen + proxy).otherwise(unseen + proxy), F.when(area, grows).otherwise(not_)))
