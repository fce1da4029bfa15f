"""The event store: events, labels and responses as append-only tables, and the reads over them.

An update is an entry in a log; the current label of an event is that of its last entry, and its response the highest that its
entries rise to. Nothing is rewritten, so readers and those who label need no locks and a lost task only repeats its own part.
"""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from hazeline.functions import cells, geodesy
from hazeline.functions.rules import TIERS
from hazeline.session import materialize

#: States of a response in order, their words, and labels.
RESPONSES, LABELS = ["none", "received", "dispatched", "suppressed"], ["unlabelled", "confirmed", "false_positive"]
RESPONSE_WORDS = {"none": "미대응", "received": "접수", "dispatched": "출동", "suppressed": "진화"}

LONG, INT, TEXT, DOUBLE, FLAG = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


CRITERIA = _struct(
    ("flow_ok", FLAG), ("area_ok", FLAG), ("n_satisfied", INT), ("enough_frames", FLAG), ("flow_from_proxy", FLAG), ("flow_upward_ratio", DOUBLE), ("flow_divergence", DOUBLE),
    ("rise_rate", DOUBLE), ("area_growth_rate", DOUBLE), ("area_monotonicity", DOUBLE), ("reasons", T.ArrayType(TEXT)),
)
#: The 29 columns of an event.
EVENT = _struct(
    ("id", LONG), ("track_id", LONG), ("tier", TEXT), ("score", DOUBLE), ("timestamp", DOUBLE), ("site", TEXT), ("camera", TEXT), ("bbox", T.ArrayType(DOUBLE)), ("confidence", DOUBLE), ("n_observations", LONG),
    ("geo_ok", FLAG), ("lat", DOUBLE), ("lon", DOUBLE), ("elevation_m", DOUBLE), ("range_m", DOUBLE), ("depression_deg", DOUBLE), ("cep50_m", DOUBLE), ("cep90_m", DOUBLE), ("geo_reject_reason", TEXT),
    ("flow_ok", FLAG), ("area_ok", FLAG), ("criteria", CRITERIA), ("snapshot", TEXT), ("response", TEXT), ("response_history", T.ArrayType(_struct(("status", TEXT), ("at", DOUBLE)))), ("label", TEXT),
    ("features", T.MapType(TEXT, DOUBLE)), ("explanation", T.MapType(TEXT, DOUBLE)), ("created_at", DOUBLE),
)
#: Columns that older tables may lack, and what stands there then.
DEFAULTS = {"flow_ok": False, "area_ok": False, "response": "none", "label": "unlabelled", "geo_ok": False}
_JSON = {f.name: f.dataType for f in EVENT if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
_FLAGS = [f.name for f in EVENT if isinstance(f.dataType, T.BooleanType)]


def listed(events: DataFrame, tier: str = "", label: str = "", site: str = "", limit: int = 200) -> DataFrame:
    """Newest first; an empty filter is none."""
    for column, value in (("tier", tier), ("label", label), ("site", site)):
        if value:
            events = events.where(F.col(column) == value)
    return events.orderBy(F.desc("id")).limit(limit)


def counts_by_tier(events: DataFrame, site: str = "") -> DataFrame:
    return (events.where(F.col("site") == site) if site else events).groupBy("tier").agg(F.count("*").alias("n"))


def latest(events: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the greatest id of each key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), "id").alias("x")).select(*keys, "x.*")


def current(log: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The last entry of each key in an append-only log, and the number of entries."""
    return log.groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.count("*").alias("n_changes"))


def responses(log: DataFrame, keys: list[str]) -> DataFrame:
    """Status by key when only entries that raise it count; log has status, at and det_id. history lists those entries."""
    past = Window.partitionBy(*keys).orderBy("at", "det_id").rowsBetween(Window.unboundedPreceding, -1)
    raised = F.col("status") > F.coalesce(F.col("best"), F.lit(0))
    x = log.withColumn("best", F.max("status").over(past))
    history = F.array_sort(F.collect_list(F.when(raised, F.struct("at", "det_id", "status"))))
    return x.groupBy(*keys).agg(F.max("status").alias("status"), F.count_if(raised).alias("n_changes"), F.max(F.when(raised, F.col("at"))).alias("changed_at"), F.transform(history, lambda h: F.struct(h["status"].alias("status"), h["at"].alias("at"))).alias("history"))


def within(located: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Rows within a distance on the ground. The bounding box is a plain comparison that scans can prune by."""
    dlat, dlon = math.degrees(metres / 6_350_000), math.degrees(metres / (6_350_000 * math.cos(math.radians(lat))))
    box = located.where(F.col("lat").between(lat - dlat, lat + dlat) & F.col("lon").between(lon - dlon, lon + dlon))
    e, n, _ = geodesy.to_enu(F.col("lat"), F.col("lon"), F.lit(0.0), lat, lon, 0.0)
    return box.withColumn("metres", F.hypot(e, n)).where(F.col("metres") <= metres)


def migrated(rows: DataFrame, schema: T.StructType = EVENT, defaults: dict | None = None) -> DataFrame:
    """Rows of an older table in today's schema: columns that it lacks get their defaults, or null."""
    defaults = DEFAULTS if defaults is None else defaults
    have = set(rows.columns)
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema))


def encoded(events: DataFrame) -> DataFrame:
    """Flat rows: flags as 0 and 1, lists, maps and structs as JSON text."""
    return events.select(*(F.to_json(c).alias(c) if c in _JSON else F.col(c).cast("int").alias(c) if c in _FLAGS else F.col(c) for c in events.columns))


def decoded(rows: DataFrame) -> DataFrame:
    """The reverse; null text of lists and maps is an empty one, null site and camera are empty texts."""
    empty = {"bbox": F.array().cast("array<double>"), "features": F.from_json(F.lit("{}"), "map<string,double>"), "explanation": F.from_json(F.lit("{}"), "map<string,double>"), "response_history": F.from_json(F.lit("[]"), _JSON["response_history"])}

    def column(c: str) -> Column:
        if c in _JSON:
            x = F.from_json(c, _JSON[c])
            return (F.coalesce(x, empty[c]) if c in empty else x).alias(c)
        if c in ("site", "camera"):
            return F.coalesce(c, F.lit("")).alias(c)
        if c in ("response", "label"):
            return F.coalesce(c, F.lit(DEFAULTS[c])).alias(c)
        return F.col(c).cast("boolean").alias(c) if c in _FLAGS else F.col(c)

    return rows.select(*map(column, rows.columns))


def _step(status: str) -> Column:
    """Place of a response in its course."""
    return F.array_position(F.array(*map(F.lit, RESPONSES)), F.col(status)).cast("int") - 1


def words(of: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[of]


def public(events: DataFrame) -> DataFrame:
    """Events as a client sees them: with the words of tier and response and the colour of the tier."""
    from hazeline.streaming.alerts import TIER_COLOURS, TIER_WORDS

    return events.withColumns({"response_label": words(F.col("response"), RESPONSE_WORDS), "tier_colour": words(F.col("tier"), TIER_COLOURS), "tier_label": words(F.col("tier"), TIER_WORDS)})


def place_of(events: DataFrame) -> DataFrame:
    """Events that can be drawn on a map."""
    return events.where("geo_ok AND lat IS NOT NULL AND lon IS NOT NULL")


def summary(events: DataFrame, site: str = "") -> DataFrame:
    """Counts by tier, total and GLOW events that wait for a label, of a site or of all; labelled counts all sites."""
    here = F.lit(True) if not site else F.coalesce(F.col("site") == site, F.lit(False))
    is_ = lambda t: here & (F.col("tier") == t)
    bare = F.col("label") == "unlabelled"
    return events.agg(F.count_if(here).alias("total"), *(F.count_if(is_(t)).alias(t.lower()) for t in TIERS), F.count_if(~bare).alias("labelled"), F.count_if(is_("GLOW") & bare).alias("queue"))


def numbered(events: DataFrame, after: int, order: tuple[str, ...] = ("timestamp", "site", "track_id")) -> DataFrame:
    """events with ids after + 1, after + 2 and so on in the given order. Rows are dealt to ranges and written once; an id is
    the rows of the ranges before plus the place in its own, so no task orders all rows. The driver sees nothing of them."""
    x = events.drop("id").repartitionByRange(*order).sortWithinPartitions(*order)
    x = materialize(x.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = x.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    x = x.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
    return x.withColumn("id", F.lit(after) + F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_start", "_n")


#: An entry reserves a batch's ids, from `first` on, or says which folder holds its rows.
_STATE = ["largest", "events", "labels", "responses"]
_PLACED = T.StructType([*EVENT, T.StructField("cell", LONG)])
_LEDGER = "batch string, kind string, first long, rows long, folder string"


def site_state(events: DataFrame, labels: DataFrame, responses: DataFrame) -> DataFrame:
    """(site, largest, events, labels, responses): the greatest id of each site and its numbers of events and of entries in the logs
    labels(id) and responses(id). A null site is a site, the empty one."""
    x = events.select("id", F.coalesce("site", F.lit("")).alias("site"))
    for name, log in (("labels", labels), ("responses", responses)):
        x = x.join(log.groupBy("id").agg(F.count("*").alias(name)), "id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return x.groupBy("site").agg(F.max("id").alias("largest"), F.count("*").alias("events"), total("labels"), total("responses"))


def changed(now: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of now (site_state) of the sites that aren't as in seen, with what has changed: events (a new largest id or another
    number of them), labels, responses. A site that isn't in seen is new, and all that it has counts as changed."""
    was = seen.select("site", *(F.col(c).alias(f"_{c}") for c in _STATE))
    x = now.join(was, "site", "left")
    differs = lambda c: F.col(c) != F.coalesce(F.col(f"_{c}"), F.lit(0))
    what = F.array_compact(F.array(F.when(differs("largest") | differs("events"), "events"), *(F.when(differs(c), c) for c in ("labels", "responses"))))
    return x.withColumn("what", what).where(F.size("what") > 0).select("site", "what", *_STATE)


class EventStore:
    """Events below a folder that all executors share; labels and responses may come from many writers.

    A batch of events is visible by its entry in the ledger alone. Its ids are reserved by an entry before its rows are
    written to a folder of their own, and another entry after that names the folder. What broke off between the two is never
    read; a batch that is added again takes the ids that it reserved, and one that is there already isn't written twice.
    One writer at a time adds batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: T.StructType | str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _log(self, name: str) -> DataFrame:
        return self._read(name, "id long, value string, at double, seq double")

    def _entries(self, kind: str) -> DataFrame:
        return self._read("ledger", _LEDGER).where(F.col("kind") == kind)

    def _enter(self, batch: str, kind: str, first: int, rows: int, folder: str | None = None) -> None:
        """One row in one file, which appears whole or not at all."""
        self.spark.createDataFrame([(batch, kind, first, rows, folder)], _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def _folders(self) -> list[str]:
        """Where the rows of each batch are: in the last compaction that holds it, else in its own folder. The driver lists one
        folder a batch that hasn't been compacted."""
        e = self._read("ledger", _LEDGER).where("kind <> 'reserved'")
        now = e.groupBy("batch").agg(F.max_by("folder", F.when(F.col("kind") == "stored", "").otherwise(F.col("kind"))).alias("folder"))
        return sorted(r["folder"] for r in now.select("folder").distinct().collect())

    def _stored(self, schema: T.StructType = EVENT) -> DataFrame:
        """The rows of all batches that the ledger names."""
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/events/{f}" for f in folders))

    def _write(self, rows: DataFrame, folder: str) -> None:
        """Rows in the order of their cells, so that a search by place passes over row groups."""
        x = rows.withColumn("cell", cells.cell(F.col("lat"), F.col("lon")))
        x.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{self.folder}/events/{folder}")

    def near(self, lat: float, lon: float, metres: float) -> DataFrame:
        """Events within a distance, with metres. Only row groups whose cells the circle's cover meets are read."""
        place = cells.within(self._stored(_PLACED), lat, lon, metres).select("id", "metres")
        return self.events().join(place, "id")

    def compact(self) -> None:
        """Writes the rows of all batches together, in the order of their cells. One file of entries then names the new folder
        for all of them at once; readers that began before keep the old files, which aren't removed."""
        held = self._entries("stored").select("batch", "first", "rows").distinct()
        kinds = self._read("ledger", _LEDGER).where("kind LIKE 'compacted-%'").agg(F.max("kind")).first()[0]
        kind, folder = f"compacted-{int((kinds or 'compacted-0').split('-')[1]) + 1:09d}", uuid.uuid4().hex
        held = materialize(held, "compacted-batches")
        self._write(self._stored(), folder)
        held.select("batch", F.lit(kind).alias("kind"), "first", "rows", F.lit(folder).alias("folder")).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def events(self) -> DataFrame:
        """Stored events under their current labels and responses. A response only rises: of the log, which several writers may
        have added to without seeing each other, the entries that rise above all before them count."""
        e = self._stored()
        labels = self._log("labels").groupBy("id").agg(F.max_by("value", F.struct("seq", "at")).alias("_label"))
        entry = F.struct("seq", "at", _step("value").alias("step"), "value")
        log = self._log("responses").groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("_r"))
        x = e.join(labels, "id", "left").join(log, "id", "left").withColumn("_step", _step("response"))
        above = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1))["step"], F.col("_step"), F.lit(-1))
        kind = "array<struct<seq:double,at:double,step:int,value:string>>"
        x = x.withColumn("_r", F.aggregate("_r", F.array().cast(kind), lambda kept, r: F.when(r["step"] > above(kept), F.concat(kept, F.array(r).cast(kind))).otherwise(kept)))
        history = F.transform("_r", lambda r: F.struct(r["value"].alias("status"), r["at"].alias("at")))
        given = F.coalesce("response_history", F.from_json(F.lit("[]"), _JSON["response_history"]))
        x = x.withColumns({"label": F.coalesce("_label", "label"), "response_history": F.when(F.col("_r").isNull(), given).otherwise(F.concat(given, history))})
        x = x.withColumn("response", F.coalesce(F.try_element_at("_r", F.lit(-1))["value"], F.col("response")))
        return x.select(*EVENT.names)

    def add(self, events: DataFrame, batch: str | None = None) -> DataFrame:
        """Appends events of today's schema, numbered after those there, and returns them. batch names them, so that adding
        them again changes nothing; without a name they are a batch of their own."""
        batch = batch or uuid.uuid4().hex
        there = self._entries("stored").where(F.col("batch") == batch).first()
        if there:
            return self.spark.read.schema(EVENT).parquet(f"{self.folder}/events/{there['folder']}")
        rows = materialize(migrated(numbered(events, 0)), "events-added")
        n = rows.count()
        reserved = self._entries("reserved").where(F.col("batch") == batch).first()
        if reserved and reserved["rows"] != n:
            raise ValueError(f"batch {batch} had {reserved['rows']} events when its ids were reserved, and has {n} now")
        if reserved:
            first = reserved["first"]
        else:
            first = self._entries("reserved").agg(F.coalesce(F.max(F.col("first") + F.col("rows")), F.lit(1))).first()[0]
            self._enter(batch, "reserved", first, n)
        folder = uuid.uuid4().hex
        self._write(rows.withColumn("id", F.col("id") + (first - 1)), folder)
        self._enter(batch, "stored", first, n, folder)
        return self.spark.read.schema(EVENT).parquet(f"{self.folder}/events/{folder}")

    def sink(self, events: DataFrame, name: str, checkpoint: str) -> DataStreamWriter:
        """A writer of a stream of events to this store. Its batches are named by `name` and number, so one that Spark runs
        again after a failure is written once, under the same ids. Take another name with another checkpoint."""
        put = lambda rows, number: self.add(rows, f"{name}/{number}")
        return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)

    def feed(self, name: str, limit: int = 300) -> tuple[DataFrame, DataFrame]:
        """(changes, snapshot) since this feed was last asked: the sites that have changed and in what (see changed), and the newest
        `limit` events of each of them. The state that is sent is kept under the feed's name, so unchanged sites give no row."""
        kept = self._read(f"feeds/{name}", f"site string, {', '.join(f'{c} long' for c in _STATE)}, turn long")
        seen = kept.groupBy("site").agg(F.max_by(F.struct(*_STATE), "turn").alias("s"), F.max("turn").alias("turn")).select("site", "s.*", "turn")
        turn = 1 + (seen.agg(F.max("turn")).first()[0] or 0)
        new = materialize(changed(site_state(self._stored(), self._log("labels"), self._log("responses")), seen), "changes")
        new.select("site", *_STATE, F.lit(turn).cast("long").alias("turn")).write.mode("append").parquet(f"{self.folder}/feeds/{name}")
        e = self.events().withColumn("_site", F.coalesce("site", F.lit(""))).join(new.select(F.col("site").alias("_site")), "_site", "left_semi").drop("_site")
        newest = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("id")))
        return new, e.withColumn("_nth", newest).where(F.col("_nth") <= limit).drop("_nth")

    def get(self, event_id: int) -> DataFrame:
        return self.events().where(F.col("id") == event_id)

    def latest_for_track(self, site: str, track_id: int) -> DataFrame:
        return self.events().where((F.col("site") == site) & (F.col("track_id") == track_id)).orderBy(F.desc("id")).limit(1)

    def labelled(self) -> DataFrame:
        return self.events().where("label <> 'unlabelled'").orderBy("id")

    def _known(self, entries: DataFrame) -> DataFrame:
        return entries.join(self._stored().select("id"), "id", "left_semi")

    def _append(self, name: str, entries: DataFrame) -> DataFrame:
        rows = materialize(self._known(entries).select("id", "value", F.col("at").cast("double").alias("at"), F.unix_micros(F.current_timestamp()).cast("double").alias("seq")), f"{name}-added")
        rows.write.mode("append").parquet(f"{self.folder}/{name}")
        return rows.select("id", "value", "at")

    def set_labels(self, entries: DataFrame) -> DataFrame:
        """entries(id, value, at): the ones of known events are appended and returned. Unknown labels are refused."""
        if not entries.where(~F.col("value").isin(LABELS) | F.col("value").isNull()).isEmpty():
            raise ValueError(f"a label is one of {LABELS}")
        return self._append("labels", entries)

    def set_responses(self, entries: DataFrame) -> DataFrame:
        """entries(id, value, at): those of known events that raise the response are appended and returned; of several for
        one event the first to raise it counts, then the next."""
        if not entries.where(~F.col("value").isin(RESPONSES) | F.col("value").isNull()).isEmpty():
            raise ValueError(f"a response is one of {RESPONSES}")
        now = self.events().select("id", _step("response").alias("_now"))
        x = entries.withColumn("_order", _step("value")).join(now, "id")
        past = Window.partitionBy("id").orderBy("at", "_order").rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumn("_best", F.greatest(F.col("_now"), F.coalesce(F.max("_order").over(past), F.lit(-1)))).where("_order > _best")
        return self._append("responses", x)

    def clear(self) -> None:
        """Forgets all events and logs."""
        for name, schema in (("ledger", _LEDGER), ("labels", "id long, value string, at double, seq double"), ("responses", "id long, value string, at double, seq double")):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.folder}/{name}")
