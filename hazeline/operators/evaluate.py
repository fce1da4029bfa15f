"""Measured figures: false alarms before ignition under three policies, device latencies, and claims against their targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazeline.operators.ranges import quantiles


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def outcomes(frames: DataFrame, judged: DataFrame) -> DataFrame:
    """One row a sequence of frames(seq_id, frame_index, offset_s, hits: its detections) and judged(seq_id, frame_index,
    track, offset_s, tier), a row for every open track at a frame.

    Frames before ignition (offset below 0) and from it on, detections before it, frames with any, tracks first seen before
    it, tracks that are FLARE for the first time before it, frames with a FLARE before it, and the first time after it that a
    track is FLARE for the first time.
    """
    early = F.col("offset_s") < 0
    f = frames.groupBy("seq_id").agg(F.count_if(early).alias("frames_before"), F.count_if(~early).alias("frames_after"), F.coalesce(F.sum(F.when(early, F.col("hits"))), F.lit(0)).alias("raw"), F.count_if(early & (F.col("hits") > 0)).alias("alarmed_single"))
    flare = F.col("tier") == "FLARE"
    t = judged.groupBy("seq_id", "track").agg(F.min("offset_s").alias("born"), F.min(F.when(flare, F.col("offset_s"))).alias("flare"))
    t = t.groupBy("seq_id").agg(F.count_if(F.col("born") < 0).alias("dedup"), F.count_if(F.col("flare") < 0).alias("verified"), F.min(F.when(F.col("flare") >= 0, F.col("flare"))).alias("time_to_flare"))
    a = judged.where(flare & early).groupBy("seq_id").agg(F.count_distinct("frame_index").alias("alarmed_sequence"))
    x = f.join(t, "seq_id", "left").join(a, "seq_id", "left")
    return x.select("seq_id", "frames_before", "frames_after", "raw", "alarmed_single", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dedup", "verified", "alarmed_sequence")), "time_to_flare")


def rollup(o: DataFrame, interval: float = 60.0, latencies: DataFrame | None = None) -> DataFrame:
    """One row over all sequences of outcomes: hours, three rates an hour, reductions, detection rate and median time to
    FLARE, shares of alarmed frames and their reduction; and median, 95 % and largest latency of latencies(ms), null without."""
    names = ["frames_before", "frames_after", "raw", "dedup", "verified", "alarmed_single", "alarmed_sequence"]
    a = o.agg(F.count("*").alias("n_sequences"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), F.count("time_to_flare").alias("found"), F.percentile("time_to_flare", 0.5).alias("median_time_to_flare"))
    a = a.withColumns({"negative_hours": F.col("frames_before") * interval / 3600, "positive_hours": F.col("frames_after") * interval / 3600})
    a = a.withColumns({f"{c}_per_hour": ratio(F.col(c), F.col("negative_hours")) for c in ("raw", "dedup", "verified")})
    a = a.withColumns({"fpr_single": ratio(F.col("alarmed_single"), F.col("frames_before")), "fpr_sequence": ratio(F.col("alarmed_sequence"), F.col("frames_before")), "detection_rate": ratio(F.col("found"), F.col("n_sequences"))})
    less = lambda b, c: F.when(F.col(c) > 0, 1 - F.col(b) / F.col(c)).otherwise(0.0)
    a = a.withColumns({"reduction_vs_raw": less("verified_per_hour", "raw_per_hour"), "reduction_vs_dedup": less("verified_per_hour", "dedup_per_hour"), "fpr_reduction": less("fpr_sequence", "fpr_single")})
    one = lambda x: x.withColumn("_one", F.lit(1))
    if latencies is None:
        return a.drop("found").withColumns({c: F.lit(None).cast("double") for c in ("latency_median", "latency_p95", "latency_max")})
    a = one(a).join(F.broadcast(one(quantiles(latencies, [], "ms", {"latency_median": 0.5, "latency_p95": 0.95}, "latencies"))), "_one", "left")
    return a.join(F.broadcast(one(latencies.agg(F.max("ms").alias("latency_max")))), "_one").drop("_one", "found")


def device_bench(samples: DataFrame) -> DataFrame:
    """(device, n, median_ms, min_ms, max_ms, fps, speedup, place) of samples(device, rank, nth, ms) without the first three of
    each device: speedup over the device of the lowest rank, place by median."""
    warm = samples.where("nth > 3")
    x = warm.groupBy("device").agg(F.min("rank").alias("rank"), F.count("*").alias("n"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))
    x = x.join(quantiles(warm, ["device"], "ms", {"median_ms": 0.5}, "latencies"), "device", "left").select("device", "rank", "n", "median_ms", "min_ms", "max_ms")
    every = Window.orderBy("rank")  # a row a device
    x = x.withColumns({"fps": 1000 / F.col("median_ms"), "speedup": F.first("median_ms").over(every) / F.col("median_ms")})
    return x.withColumn("place", F.row_number().over(Window.orderBy("median_ms", "rank")).cast("long")).drop("rank")


#: Targets of the claims.
CEP_TARGET, FPR_TARGET, RATE_TARGET, DELAY_TARGET = 50.0, 0.03, 0.5, 30.0


def claims(alarms: DataFrame | None = None, detector: DataFrame | None = None, sweep: DataFrame | None = None, devices: DataFrame | None = None) -> DataFrame:
    """(item, target, measured, detail, verdict): what a rollup, a detector baseline, a sweep of one grade and a device bench
    say of the targets. A claim whose figures are missing has no row; without any figures there is nothing to say, an error. Places are met under a condition: from the least
    depression whose median radius is within the target, which detail names."""
    d = lambda c: F.col(c).cast("double") if isinstance(c, str) else F.lit(c).cast("double")
    rows = lambda x, item, target, measured, detail, verdict: x.select(F.lit(item).alias("item"), d(target).alias("target"), d(measured).alias("measured"), d(detail).alias("detail"), (verdict if isinstance(verdict, Column) else F.lit(verdict)).alias("verdict"))
    met = lambda ok: F.when(ok, "met").otherwise("not met")
    out = [] if alarms is None else [
        rows(alarms.where("frames_before > 0"), "frame false alarm rate", FPR_TARGET, "fpr_sequence", "fpr_single", met(F.col("fpr_sequence") <= FPR_TARGET)),
        rows(alarms.where("latency_median IS NOT NULL"), "latency ms", 1000 * DELAY_TARGET, "latency_median", "latency_p95", "conditional"),
        rows(alarms, "false alarms an hour", RATE_TARGET, "verified_per_hour", "dedup_per_hour", met(F.col("verified_per_hour") <= RATE_TARGET)),
        rows(alarms.where("median_time_to_flare IS NOT NULL"), "seconds to find", DELAY_TARGET, "median_time_to_flare", "detection_rate", "not measurable"),
    ]
    if sweep is not None:
        fine = sweep.where((F.col("n_solved") > 0) & (F.col("cep50_m") <= CEP_TARGET)).agg(F.min_by(F.struct("depression", "cep50_m"), "depression").alias("b"))
        out.insert(0, rows(fine.select("b.*"), "place within metres", CEP_TARGET, "cep50_m", "depression", F.when(F.col("depression").isNull(), "not met").otherwise("conditional")))
    if detector is not None:
        out.append(rows(detector, "detector ap50", None, "ap50", "alarm_rate", "for reference"))
    if devices is not None:
        out.append(rows(devices.where("place = 1"), "frames a second", None, "fps", "median_ms", "met"))
    if not out:
        raise ValueError("no figures to make claims of")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def markdown(table: DataFrame) -> str:
    """The claims (seven rows at most) as a table of text."""
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    head = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(head + ["| " + " | ".join(map(show, r)) + " |" for r in table.limit(7).collect()])
