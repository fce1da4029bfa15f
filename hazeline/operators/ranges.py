"""Orders and quantiles of groups of any size: work is cut into ranges, and only totals of ranges meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazeline.session import materialize, task_count


def parted(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df as a table in ranges of (group, order), with the range's number as _part. Ranges come from a sample, so df should be a
    written table."""
    cut = df.repartitionByRange(task_count(df.sparkSession), *group, *order)
    return materialize(cut.withColumn("_part", F.spark_partition_id()), name)


def carried(x: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """x, which parted() wrote, with running sums within each group. Sums run within ranges, and a range takes over the total of
    its group in those before: at most one group a range has begun before it, so those totals are few, and are broadcast.
    Group columns aren't null."""
    own = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = x.groupBy("_part", *group).agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = ends.select("_part", *group, *(F.sum(f"_{k}").over(before).alias(f"_{k}") for k in sums)).where(F.col(f"_{next(iter(sums))}").isNotNull())
    x = x.withColumns({k: F.sum(c).over(own) for k, c in sums.items()}).join(F.broadcast(materialize(spans, name)), ["_part", *group], "left")
    return x.withColumns({k: F.col(k) + F.coalesce(F.col(f"_{k}"), F.lit(0)) for k in sums}).drop(*(f"_{k}" for k in sums))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], name: str = "quantiles", most: int = 100_000) -> DataFrame:
    """(*keys, one column for each of probs): exact quantiles, between two values in proportion, of the values that aren't null.

    Equal values are counted first, with partial sums, so one that many rows have is one row. Counts are then summed along
    ranges of (keys, value), and a value is picked where the running count passes the rank. No task holds a group's values.
    keys aren't null; without keys there is one row if there is any value. Groups are broadcast if there are at most `most`."""
    one = "_all" if not keys else None
    by = keys or ["_all"]
    df = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    df = df.withColumn("_all", F.lit(1)) if one else df
    counts = materialize(df.select(*by, F.col(value).cast("double").alias("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_n")), name)
    totals = materialize(counts.groupBy(*by).agg(F.sum("_n").alias("_total")), f"{name}-totals")
    x = carried(parted(counts, by, ["_v"], f"{name}-ranges"), by, ["_v"], {"_upto": F.col("_n")}, f"{name}-spans")
    x = x.join(F.broadcast(totals) if totals.count() <= most else totals, by)
    at = {k: F.lit(p) * (F.col("_total") - 1) for k, p in probs.items()}
    holds = lambda rank: (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
    ends = {f"_{side}_{k}": F.max(F.when(holds(f(p)), F.col("_v"))) for k, p in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    picked = x.groupBy(*by).agg(*(c.alias(k) for k, c in ends.items()), F.max("_total").alias("_total"))
    between = {k: F.col(f"_lo_{k}") + (p - F.floor(p)) * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) for k, p in at.items()}
    return picked.select(*keys, *(c.alias(k) for k, c in between.items()))
