"""Splits and the balanced logistic scorer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazeline.functions.rules import SCORER
from hazeline.session import materialize

LEAST = 8


def split(keys: DataFrame) -> DataFrame:
    """Ordered keys, alternating train and test. Keys are dealt to ranges and written once; a place is the keys of the ranges
    before plus the place in its own, so no task orders all keys and the gaps between them don't matter."""
    column = keys.columns[0]
    x = materialize(keys.repartitionByRange(column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()), "split")
    x = x.withColumn("_part", F.shiftright("_at", 33))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = x.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return x.join(F.broadcast(starts), "_part").select(column, F.when(place % 2 == 0, "train").otherwise("test").alias("part"))


def save(weights: DataFrame, folder: str, mode: str = "sparse") -> None:
    """Fitted weights as JSON, with the centre and scale of each feature and the mode."""
    scales = weights.sparkSession.createDataFrame([(f, c, s) for f, _, c, s in SCORER], "feature string, centre double, scale double")
    weights.join(F.broadcast(scales), "feature", "left").withColumn("mode", F.lit(mode)).coalesce(1).write.mode("overwrite").json(folder)


def load(spark: SparkSession, folder: str) -> dict[str, float]:
    """Weights by feature, the intercept among them, as rules.score takes them; a feature that is absent keeps its fixed weight."""
    rows = spark.read.schema("feature string, weight double").json(folder).collect()  # a row a feature
    return {r["feature"]: r["weight"] for r in rows}


def fitted(tracks: DataFrame) -> DataFrame:
    """Weights of a balanced logistic regression on standardised features of labelled tracks; refuses fewer than eight of
    either class. Returns (feature, weight) rows, the intercept among them."""
    names = [(f, c, s) for f, _, c, s in SCORER[:10] if f in tracks.columns]
    x = tracks.where(F.col("label").isin("confirmed", "false_positive")).select((F.col("label") == "confirmed").cast("double").alias("y"), *(((F.col(f) - c) / s).alias(f) for f, c, s in names))
    n, positive = x.agg(F.count("*"), F.sum("y")).first()
    if min(positive or 0, n - (positive or 0)) < LEAST:
        raise ValueError(f"{LEAST} labels of each class are needed; {positive or 0:.0f} and {n - (positive or 0):.0f} are there")
    x = x.withColumn("weight", F.when(F.col("y") == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive))))
    x = materialize(x.withColumn("one", F.lit(1.0)), "labelled")
    cols = [f for f, _, _ in names] + ["one"]
    w, k = np.zeros(len(cols)), len(cols)
    ridge = np.append(np.ones(k - 1), 1e-9)
    # Newton steps on the penalised log loss: each is one aggregate of k gradient and k (k + 1) / 2 curvature sums.
    for _ in range(25):
        logit = sum(F.col(c) * float(v) for c, v in zip(cols, w, strict=True))
        at = x.withColumn("p", 1 / (1 + F.exp(-logit)))
        slope = [F.sum(F.col("weight") * (F.col("p") - F.col("y")) * F.col(c)) for c in cols]
        curve = [F.sum(F.col("weight") * F.col("p") * (1 - F.col("p")) * F.col(cols[i]) * F.col(cols[j])) for i in range(k) for j in range(i, k)]
        sums = list(at.agg(*slope, *curve).first())
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = sums[k:]
        h = h + np.triu(h, 1).T + np.diag(ridge)
        step = np.linalg.solve(h, np.array(sums[:k]) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    rows = [(f, float(v)) for f, v in zip([*cols[:-1], "intercept"], w, strict=True)]
    return tracks.sparkSession.createDataFrame(rows, "feature string, weight double")


def retrained(events: DataFrame, folder: str, mode: str = "sparse") -> DataFrame:
    """Weights fitted to stored events by their current labels, and saved: from what operators said to what the next run scores
    with. events are those of the store; the features that each carries are the training row, and one it lacks stands at its
    centre, where it says nothing. Refuses as `fitted` does, and then nothing is saved."""
    features = [F.coalesce(F.col("features")[f], F.lit(float(c))).alias(f) for f, _, c, _ in SCORER[:10]]
    weights = fitted(events.select("label", *features))
    save(weights, folder, mode)
    return weights
