"""Greedy box operators: suppression within a frame, matching with ground truth, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazeline.session import materialize

CORNERS = ["x1", "y1", "x2", "y2"]
#: The confidence thresholds of the curve.
THRESHOLDS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90]


def suppressed(d: DataFrame, threshold: float = 0.20, frame: tuple[str, ...] = ("seq_id", "frame_index"), fields: tuple[str, ...] = ("det_id", "lane", "x1", "y1", "x2", "y2", "confidence")) -> DataFrame:
    """Detections that survive suppression within their frame: by falling confidence, ties by det_id, each that overlaps
    none kept before by more than threshold. A frame's boxes are one short array, folded in the JVM."""
    box = F.struct((-F.col("confidence")).alias("o"), *fields)
    frames = d.groupBy(*frame).agg(F.array_sort(F.collect_list(box)).alias("boxes"))

    fold = lambda kept, b: F.when(F.exists(kept, lambda a: overlap(a, b) > threshold), kept).otherwise(F.concat(kept, F.array(b)))
    kept = F.aggregate("boxes", F.filter("boxes", lambda b: F.lit(False)), fold)
    return frames.select(*frame, F.explode(kept).alias("b")).select(*frame, *(f"b.{c}" for c in fields))


def overlap(a: Column, b: Column) -> Column:
    """IoU of two box structs; 0 where the union is empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    size = lambda x: F.greatest(x["x2"] - x["x1"], F.lit(0.0)) * F.greatest(x["y2"] - x["y1"], F.lit(0.0))
    union = size(a) + size(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def matched(d: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(det_id, seq_id, frame_index, confidence, truth_id, iou) of every detection; truth_id is null without a match.

    By falling confidence, ties by det_id, each detection takes the free truth of its frame that it overlaps most, of equal
    ones that with the smallest id, if the overlap is at least `least`. Frames are independent; one is two short arrays,
    folded in the JVM.
    """
    frame = ["seq_id", "frame_index"]
    preds = d.groupBy(*frame).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "det_id", *CORNERS))).alias("preds"))
    boxes = truth.groupBy(*frame).agg(F.collect_list(F.struct("truth_id", *CORNERS)).alias("free"))
    x = preds.join(boxes, frame, "left")
    found = F.array().cast("array<struct<det_id:bigint,confidence:double,truth_id:bigint,iou:double>>")

    def step(state: Column, p: Column) -> Column:
        best = F.array_max(F.transform(state["free"], lambda t: F.struct(overlap(p, t).alias("iou"), (-t["truth_id"]).alias("id"))))

        def settle(b: Column) -> Column:
            hit = F.coalesce(b["iou"] >= least, F.lit(False))
            row = F.struct(p["det_id"].cast("long").alias("det_id"), (-p["o"]).alias("confidence"), F.when(hit, -b["id"]).cast("long").alias("truth_id"), F.when(hit, b["iou"]).otherwise(0.0).alias("iou"))
            free = F.when(hit, F.filter(state["free"], lambda t: t["truth_id"] != -b["id"])).otherwise(state["free"])
            return F.struct(free.alias("free"), F.concat(state["found"], F.array(row)).alias("found"))

        # an array of one, so that the best box is found once
        return F.get(F.transform(F.array(best), settle), F.lit(0))

    start = F.struct(F.coalesce("free", F.array().cast(boxes.schema["free"].dataType)).alias("free"), found.alias("found"))
    return x.select(*frame, F.explode(F.aggregate("preds", start, step)["found"]).alias("m")).select("m.det_id", *frame, "m.confidence", "m.truth_id", "m.iou")


def _with_truths(x: DataFrame, truth: DataFrame) -> DataFrame:
    """x with n_truth, the number of truths, from the plan: one row beside every row."""
    n = truth.agg(F.count("*").alias("n_truth")).withColumn("_one", F.lit(1))
    return x.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one").drop("_one")


def pr_curve(m: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 at fixed thresholds, in one pass: a conditional count for each."""
    c, hit = F.col("confidence"), F.col("truth_id").isNotNull()
    a = m.agg(*(F.count_if(c >= t).alias(f"n{i}") for i, t in enumerate(THRESHOLDS)), *(F.count_if((c >= t) & hit).alias(f"p{i}") for i, t in enumerate(THRESHOLDS)))
    rows = _with_truths(a, truth).select("n_truth", F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("tp")) for i, t in enumerate(THRESHOLDS)))).alias("x")).select("n_truth", "x.*")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = rows.select("threshold", "n", "tp", zero(F.try_divide("tp", "n")).alias("precision"), zero(F.try_divide("tp", "n_truth")).alias("recall"))
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def average_precision(m: DataFrame, truth: DataFrame) -> DataFrame:
    """(ap, n, tp, n_truth): area under the precision envelope over all points, ties by det_id.

    Detections are dealt to ranges of (confidence, det_id) and written once. A rank is the rows of the ranges before plus the
    place in its own, and the envelope likewise takes the best precision of later ranges, so that no task orders all
    detections, however few different confidences there are.
    """
    order = [F.desc("confidence"), F.asc("det_id")]
    x = m.select("det_id", "confidence", F.col("truth_id").isNotNull().cast("int").alias("tp")).repartitionByRange(*order).sortWithinPartitions(*order)
    x = materialize(x.withColumn("at", F.monotonically_increasing_id()), "ranked").withColumn("part", F.shiftright("at", 33))
    inside = Window.partitionBy("part").orderBy("at")
    # backwards, since a frame that ends at the last row is computed anew for every row
    rest = Window.partitionBy("part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"r": F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1, "t": F.sum("tp").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    ranges = Window.orderBy("part")  # a row a range
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy("part").agg(F.count("*").alias("n"), F.sum("tp").alias("s"))
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("t0"))
    x = x.join(F.broadcast(sums), "part").withColumn("p", (F.col("t0") + F.col("t")) / (F.col("n0") + F.col("r")))
    best = x.groupBy("part").agg(F.max("p").alias("b")).withColumn("later", F.max("b").over(ranges.rowsBetween(1, Window.unboundedFollowing))).select("part", "later")
    x = x.join(F.broadcast(best), "part").withColumn("e", F.greatest(F.max("p").over(rest), F.coalesce("later", F.lit(0.0))))
    a = x.agg(F.coalesce(F.sum(F.col("e") * F.col("tp")), F.lit(0.0)).alias("area"), F.count("*").alias("n"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"))
    return _with_truths(a, truth).select(F.coalesce(F.try_divide("area", "n_truth"), F.lit(0.0)).alias("ap"), "n", "tp", "n_truth")


def baseline(m: DataFrame, truth: DataFrame, frames: DataFrame) -> DataFrame:
    """One row: images with and without truths, truths, predictions, ap50, the threshold with the best F1 (the lowest of
    equals) with its precision and recall, false positives an image without truths, and the share of such images with any
    prediction. frames(seq_id, frame_index) lists the images, those without detections too; m and truth are tables."""
    key = ["seq_id", "frame_index"]
    per = frames.select(*key).distinct().join(truth.groupBy(*key).agg(F.count("*").alias("boxes")), key, "left").join(m.groupBy(*key).agg(F.count("*").alias("found")), key, "left")
    per = per.withColumns({"boxes": F.coalesce("boxes", F.lit(0)), "found": F.coalesce("found", F.lit(0))})
    bare = F.col("boxes") == 0
    images = per.agg(
        F.count("*").alias("n_images"), F.count_if(~bare).alias("n_with"), F.count_if(bare).alias("n_without"), F.sum("found").alias("n_predictions"),
        F.coalesce(F.try_divide(F.sum(F.when(bare, F.col("found"))), F.count_if(bare)), F.lit(0.0)).alias("fp_per_negative"), F.coalesce(F.try_divide(F.count_if(bare & (F.col("found") > 0)), F.count_if(bare)), F.lit(0.0)).alias("alarm_rate"),
    )
    best = pr_curve(m, truth).agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")
    one = lambda x: x.withColumn("_one", F.lit(1))
    x = one(images).join(one(average_precision(m, truth).select(F.col("ap").alias("ap50"), F.col("n_truth"))), "_one").join(one(best), "_one").drop("_one")
    return x.withColumnRenamed("threshold", "best_threshold")
