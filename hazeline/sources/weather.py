"""Wind from stored weather answers, with its provenance; it never fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BODY = "response struct<body: struct<items: struct<item: array<struct<category: string, obsrValue: string>>>>>"


def winds(answers: DataFrame, keys: list[str], fallback: tuple[float, float] | None = None) -> DataFrame:
    """(*keys, wind_speed, wind_from, source) of answers(*keys, body), one row each. body is the JSON text of a forecast
    service: items of category and value, of which WSD is the speed and VEC the direction that wind comes from; of a category
    twice the last counts. source is kma where both are numbers; else fallback, or unavailable without one."""
    items = F.from_json("body", _BODY)["response"]["body"]["items"]["item"]
    x = answers.withColumn("_items", F.coalesce(items, F.array().cast("array<struct<category:string,obsrValue:string>>")))
    value = lambda c: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("_items", lambda i: i["category"] == c), lambda i: i["obsrValue"])), -1).try_cast("double")
    x = x.withColumns({"_speed": value("WSD"), "_from": value("VEC")})
    known = F.col("_speed").isNotNull() & F.col("_from").isNotNull()
    speed, come = (F.lit(v).cast("double") for v in (fallback or (None, None)))
    return x.select(*keys, F.when(known, F.col("_speed")).otherwise(speed).alias("wind_speed"), F.when(known, F.col("_from")).otherwise(come).alias("wind_from"), F.when(known, "kma").otherwise("fallback" if fallback else "unavailable").alias("source"))
