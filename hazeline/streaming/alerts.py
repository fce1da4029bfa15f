"""Alert routing: escalation, then suppression by place and time, with feedback from what was sent."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from hazeline.functions import geodesy
from hazeline.functions.rules import TIERS

#: Metres and seconds within which an alert is the same fire.
RADIUS, COOLDOWN = 300.0, 600.0
NOTIFY, PERSIST = TIERS[1:], TIERS
OUT = "site long, id long, at double, tier string, decision string, reason string"


PLACE = ["x", "y", "z", "p", "q"]


def metres(alert: list[float], place: list[float]) -> float:
    """Distance on the tangent plane at the alert; places are earth-centred coordinates and latitude, longitude in radians."""
    dx, dy, dz = (b - a for a, b in zip(alert[:3], place[:3], strict=True))
    s, c, u, v = math.sin(alert[3]), math.cos(alert[3]), math.sin(alert[4]), math.cos(alert[4])
    return math.hypot(-u * dx + v * dy, -s * v * dx - s * u * dy + c * dz)


class Nearby:
    """Alerts sent lately at a site, oldest first: place, time and rank."""

    def __init__(self, sent: list[list] = ()):
        self.sent = list(sent)

    def suppresses(self, at: float, rank: int, place: list[float | None]) -> bool:
        """Whether the first alert within radius and cooldown is of the same or a higher tier; if not, and there is a place,
        this one is remembered."""
        if any(v is None or v != v for v in place):
            return False
        self.sent = [s for s in self.sent if at - s[5] <= COOLDOWN]
        rival = next((s[6] for s in self.sent if metres(s, place) <= RADIUS), -1)
        if rank <= rival:
            return True
        self.sent.append([*place, at, rank])
        return False


def rank_of(tier: str) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), F.col(tier)).cast("int") - 1


def placed(events: DataFrame) -> DataFrame:
    """Events with their place on the ellipsoid, from which distances are taken at each alert."""
    place = (*geodesy.ecef(F.col("lat"), F.col("lon"), F.lit(0.0)), F.radians("lat"), F.radians("lon"))
    return events.withColumns(dict(zip(PLACE, place, strict=True)))


def escalated(events: DataFrame, keys: Sequence[str] = ("site", "track"), order: Sequence[str] = ("at", "id")) -> DataFrame:
    """events(*keys, *order, rank) with before: the best rank that the track has been notified or suppressed with, null if never.
    It doesn't depend on suppression, so it is a running maximum."""
    past = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("before", F.max(F.when(F.col("rank") > 0, F.col("rank"))).over(past))


def rises() -> Column:
    """Whether an event is above the best tier of its track so far."""
    return (F.col("rank") > 0) & (F.col("rank") > F.coalesce("before", F.lit(0)))


def _suppress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by site, run, time and id: the alerts of the cooldown are all that is held."""
    now, near = None, Nearby()
    for b in batches:
        sites, runs, _, ats, ranks, *places = (c.to_pylist() for c in b.columns)
        hit = []
        for key, at, rank, *place in zip(zip(sites, runs, strict=True), ats, ranks, *places, strict=True):
            if key != now:
                now, near = key, Nearby()
            hit.append(near.suppresses(at, rank, place))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(hit, pa.bool_())], ["site", "id", "suppressed"])


def routed(events: DataFrame) -> DataFrame:
    """events(site, id, at, tier, track, lat, lon) with the decision on each and, for sent ones, the reason: new or escalated.

    SPARK is stored only and leaves no memory. A track must rise above its best tier so far, which is remembered even if the
    alert is then suppressed. The first recent alert within radius and cooldown decides: it suppresses unless the tier is
    above its own. Distances are on the plane at that alert, so sites may lie anywhere. Events without a place skip that test. Escalation is a window; only the few events that rise go to the
    kernel, in runs: a pause longer than the cooldown starts a new one, and runs are independent of each other.
    """
    x = escalated(placed(events).withColumn("rank", rank_of("tier")))
    out = x.join(suppressed(x.where(rises())), ["site", "id"], "left")
    decision, reason = decided()
    return out.select(F.col("site").cast("long").alias("site"), F.col("id").cast("long").alias("id"), F.col("at").cast("double").alias("at"), "tier", decision.alias("decision"), reason.alias("reason"))


def suppressed(rising: DataFrame) -> DataFrame:
    """(site, id, suppressed) of the events that rise, (site, id, at, rank) and their places."""
    rising = rising.select(F.col("site").cast("long").alias("site"), "id", F.col("at").cast("double").alias("at"), "rank", *PLACE)
    order = Window.partitionBy("site").orderBy("at", "id")
    pause = F.coalesce((F.col("at") - F.lag("at").over(order) > COOLDOWN).cast("int"), F.lit(0))
    runs = rising.withColumn("pause", pause).withColumn("run", F.sum("pause").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.select("site", "run", "id", "at", "rank", *PLACE).repartition("site", "run").sortWithinPartitions("site", "run", "at", "id")
    return runs.mapInArrow(_suppress, "site long, id long, suppressed boolean")


def decided() -> tuple[Column, Column]:
    """The decision on an event of rank, before and suppressed, and the reason of a sent one."""
    decision = F.when(F.col("rank") == 0, "stored").when(~rises(), "not risen").when(F.col("suppressed"), "suppressed").otherwise("sent")
    return decision, F.when(decision == "sent", F.when(F.col("before").isNull(), "new").otherwise("escalated"))


def nearest_km(units: list[tuple[str, float, float]], lat: str = "lat", lon: str = "lon") -> Column:
    """Kilometres to the nearest response unit; null without a place or without units. Units are configuration."""
    if not units:
        return F.lit(None).cast("double")
    far = [F.hypot(*geodesy.to_enu(F.col(lat), F.col(lon), F.lit(0.0), u, v, 0.0)[:2]) / 1000 for _, u, v in units]
    return F.least(*far) if len(far) > 1 else far[0]


def nearest_of(units: Column, lat: str = "lat", lon: str = "lon") -> Column:
    """The same for units that each row brings, an array of name, lat and lon: its site's."""
    far = lambda u: F.hypot(*geodesy.to_enu_at(F.col(lat), F.col(lon), F.lit(0.0), u["lat"], u["lon"], F.lit(0.0))[:2]) / 1000
    return F.array_min(F.transform(units, far))


def routed_stream(events: DataFrame, forget_s: float = 7 * 86_400.0) -> DataFrame:
    """The same over a stream, in order of arrival and, within a micro-batch, of time and id. The state holds the best tier
    of each track, until it is unseen for forget_s, and the alerts of the cooldown."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, sent = map(json.loads, state.get) if state.exists else ({}, [])
        near, rows = Nearby(sent), []
        pdf = pd.concat(list(frames)).sort_values(["at", "id"])
        for id_, at, tier, rank, track, *place in pdf[["id", "at", "tier", "rank", "track", *PLACE]].itertuples(index=False, name=None):
            before = best[track][0] if track in best else None
            if rank == 0:
                rows.append((id_, at, tier, "stored", None))
                continue
            if rank <= (before or 0):
                best[track][1] = at
                rows.append((id_, at, tier, "not risen", None))
                continue
            best[track] = [int(rank), at]
            gone = near.suppresses(at, int(rank), place)
            rows.append((id_, at, tier, "suppressed" if gone else "sent", None if gone else "new" if before is None else "escalated"))
        latest = float(pdf["at"].max())
        state.update((json.dumps({t: b for t, b in best.items() if latest - b[1] <= forget_s}), json.dumps([s for s in near.sent if latest - s[5] <= COOLDOWN])))
        out = pd.DataFrame(rows, columns=["id", "at", "tier", "decision", "reason"])
        out.insert(0, "site", key[0])
        yield out

    columns = placed(events).withColumn("rank", rank_of("tier")).select("site", "id", "at", "tier", "rank", F.col("track").cast("string").alias("track"), *PLACE)
    return columns.groupBy("site").applyInPandasWithState(update, OUT, "best string, recent string", "append", GroupStateTimeout.NoTimeout)


def router_summary(routed_: DataFrame, events: DataFrame) -> DataFrame:
    """(notifications, flare, glow, tracks_seen): what was sent, by tier, and the tracks that were ever above SPARK."""
    sent = F.col("decision") == "sent"
    counts = routed_.agg(F.count_if(sent).alias("notifications"), *(F.count_if(sent & (F.col("tier") == t)).alias(t.lower()) for t in reversed(NOTIFY)))
    seen = events.where(F.col("tier").isin(*NOTIFY)).agg(F.count_distinct("site", "track").alias("tracks_seen"))
    return counts.withColumn("_k", F.lit(1)).join(F.broadcast(seen.withColumn("_k", F.lit(1))), "_k").drop("_k")


#: Tier names and the words of an alert.
TIER_WORDS = {"FLARE": "타오름", "GLOW": "어른거림", "SPARK": "스침"}
TIER_COLOURS = {"FLARE": "#E63946", "GLOW": "#F4A261", "SPARK": "#8D99AE"}
ALERT = ("▲ %s 경보 — %s", "현장", "%.4fN %.4fE (오차반경 %.0fm, 사거리 %sm)", "좌표 미발행 (%s) — 영상 확인 필요", " / 최근접 진화대 %.1fkm")


def alert_text() -> Column:
    """Two lines on an event(tier, site, geo_ok, lat, lon, cep50_m, range_m, geo_reject_reason, nearest_unit_km)."""
    head, field, place, none, unit = ALERT
    site = F.when(F.coalesce("site", F.lit("")) == "", field).otherwise(F.col("site"))
    body = F.when(F.col("geo_ok"), F.format_string(place, "lat", "lon", "cep50_m", F.format_number("range_m", 0))).otherwise(F.format_string(none, "geo_reject_reason"))
    tail = F.coalesce(F.when(F.col("nearest_unit_km").isNotNull(), F.format_string(unit, "nearest_unit_km")), F.lit(""))
    return F.concat(F.format_string(head, F.col("tier"), site), F.lit("\n  "), body, tail)
