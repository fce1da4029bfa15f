"""Trie of the prefixes that conversations share, with subtree totals by time-forward processing.

A prefix is known by the sums of two 64-bit hashes over (depth, role, text) of its turns, so prefixes of a conversation of any
length come from running sums over ranges, and nodes from one grouping. Totals are passed from the deepest level up: nodes are
read in reverse level order, each takes the messages of its children out of a priority queue that spills sorted runs to disk,
and sends its own total to its parent. This is done first within shards, which are whole subtrees below nodes with many members,
and then for those nodes, of which there are at most `heavy` times the mean number of turns, however large the table.
A node with a single member needs no queue: it has one leaf and saves nothing, so only the top of such a tail sends a message.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazeline.llm.common import batches_of, carried, parted, semi_by_size, with_facts
from hazeline.session import materialize, task_count

#: Key of the root, which has no turns; other keys are 32 hexadecimal digits.
ROOT = "-"
_MESSAGES = "key string, depth long, leaves long, saved decimal(38,0)"


class SpillingQueue:
    """A priority queue of tuples in bounded memory: beyond `limit` entries it writes them as a sorted run to a scratch file,
    and the least of the heap and all runs comes first. Files end with the task; a lost task starts anew."""

    def __init__(self, limit: int = 200_000):
        self.heap, self.limit, self.runs = [], limit, []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            f = tempfile.TemporaryFile(prefix="queue-")  # noqa: SIM115
            self.heap.sort()
            for x in self.heap:
                pickle.dump(x, f, protocol=5)
            f.seek(0)
            self.heap = []
            self._head(f)

    def _head(self, f) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(f), id(f), f))
        except EOFError:
            f.close()

    def least(self) -> tuple | None:
        ends = [x for x in (self.heap[:1], [r[0] for r in self.runs[:1]]) if x]
        return min(ends)[0] if ends else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, _, f = heapq.heappop(self.runs)
            self._head(f)
            return item
        return heapq.heappop(self.heap)


def forward(nodes: Iterator[tuple], limit: int) -> Iterator[tuple]:
    """Totals of nodes (depth, key, parent, leaves, saved, inside) in reverse level order, then by key: (key, depth, leaves,
    saved, sent), sent being the parent's key where the parent isn't among the nodes (inside is false)."""
    queue = SpillingQueue(limit)
    for depth, key, parent, leaves, saved, inside in nodes:
        while (m := queue.least()) is not None and m[:2] == (-depth, key):
            queue.pop()
            leaves, saved = leaves + m[2], saved + m[3]
        if inside:
            queue.push((1 - depth, parent, leaves, saved))
        yield key, depth, leaves, saved, None if inside else parent


def _totals(limit: int):
    schema = pa.schema([("key", pa.string()), ("depth", pa.int64()), ("leaves", pa.int64()), ("saved", pa.decimal128(38, 0)), ("sent", pa.string())])

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        rows = (r for cols in batches_of(batches, ["depth", "key", "parent", "leaves", "saved", "inside"]) for r in zip(*cols, strict=True))
        out: list = []
        for r in forward(rows, limit):
            out.append(r)
            if len(out) == 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return run


def _passed(nodes: DataFrame, limit: int) -> DataFrame:
    """forward() in each partition of nodes, which Spark sorts (spilling to disk) into reverse level order."""
    order = nodes.select("depth", "key", "parent", "leaves", F.col("saved").cast("decimal(38,0)").alias("saved"), "inside").sortWithinPartitions(F.desc("depth"), "key")
    return order.mapInArrow(_totals(limit), "key string, depth long, leaves long, saved decimal(38,0), sent string")


def _with_messages(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """nodes with what has been sent to them added to their own leaves and saved tokens; sums are grouped before the join."""
    sums = messages.groupBy("key").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    return nodes.join(sums, "key", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0).cast("decimal(38,0)"))}).drop("l", "s")


def _joined_ids(batches):
    """Blocks of comma-joined ids of (key, block, ids) in order, to the hash of each key's whole list, in constant memory."""
    key, h, out = None, None, []
    for keys, ids in batches_of(batches, ["key", "ids"]):
        for k, i in zip(keys, ids, strict=True):
            if k != key:
                if h:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(i.encode())
            else:
                h.update(b"," + i.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "ends"])
            out = []
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["key", "ends"])


def ends_of(last: DataFrame, name: str = "ends", block: int = 1000) -> DataFrame:
    """(key, ends): SHA-256 of the ascending ids of last(key, conv), comma-joined. Ids are numbered in ranges and joined in
    blocks of `block` by all tasks; only the blocks of a key come together, as a stream, since its hash is a sequence."""
    x = carried(parted(materialize(last, name), ["key"], ["conv"], f"{name}-ranges"), ["key"], ["conv"], {"nth": F.lit(1)}, f"{name}-spans")
    blocks = x.groupBy("key", F.expr(f"(nth - 1) DIV {block}").alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    return blocks.repartition(task_count(last.sparkSession), "key").sortWithinPartitions("key", "block").mapInArrow(_joined_ids, "key string, ends string")


def rebuilt(conversations: DataFrame, heads: int, family: int, hashes: list[Column], words: Column) -> DataFrame:
    """Turns (conv, nth, h1, h2, words, row) of rebuilt conversations: the first h turns of the conversation at the start of
    its family of `family` ids, then its own after its first h; h = crc32(id) % heads. nth orders them within a conversation."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), *(h.alias(f"h{k}") for k, h in enumerate(hashes, 1)), words.cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    turns = materialize(turns, "turns")
    first = Window.partitionBy("conv").orderBy(F.asc_nulls_first("at"), "h1", "h2", "row")
    most = heads - 1
    lead = materialize(turns.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most), "leading-turns")
    own_heads = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    gone = materialize(lead.where(F.col("nth") <= own_heads).select("row"), "replaced-turns")
    own = semi_by_size(turns, gone, "row", "left_anti").select("conv", F.lit(1).alias("part"), "at", "h1", "h2", "words", "row")
    convs = turns.select("conv").distinct().select("conv", own_heads.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    given = convs.where("h > 0").join(lead.withColumnRenamed("conv", "base"), "base").where("nth <= h")
    return own.union(given.select("conv", F.lit(0), F.col("nth").cast(turns.schema["at"].dataType), "h1", "h2", "words", "row"))


def prefix_trie(conversations: DataFrame, heads: int = 4, family: int = 20, heavy: int = 1024, queue: int = 200_000) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; turns of one number by a hash of role and text. Null role or text counts as empty.
    Rows without a conv_id belong to no conversation and are left out; a repeated row is a turn of its own. An empty table gives
    no rows, not even a root. Other columns are left out. No task holds a conversation, a node's members or children, or a level.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashes = [F.xxhash64(F.lit(seed), role, text) for seed in (1, 2)]
    turns = rebuilt(conversations, heads, family, hashes, F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")))
    order = ["part", "at", "h1", "h2", "row"]
    x = carried(parted(materialize(turns, "rebuilt"), ["conv"], order, "turn-ranges"), ["conv"], order, {"depth": F.lit(1)}, "turn-spans")
    wide = lambda seed: F.xxhash64(F.lit(seed), "depth", "h1", "h2").cast("decimal(20,0)")
    x = x.withColumns({"e1": wide(3), "e2": wide(4)})
    x = carried(x, ["conv"], ["depth"], {"s1": F.col("e1"), "s2": F.col("e2")}, "prefix-spans")
    key = lambda depth, *s: F.md5(F.concat_ws(",", depth.cast("string"), *(v.cast("string") for v in s)).cast("binary"))
    parent = F.when(F.col("depth") == 1, ROOT).otherwise(key(F.col("depth") - 1, F.col("s1") - F.col("e1"), F.col("s2") - F.col("e2")))
    x = materialize(x.select("conv", "depth", "words", key(F.col("depth"), F.col("s1"), F.col("s2")).alias("key"), parent.alias("parent")), "prefixes")

    convs = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv")).distinct()
    last = x.groupBy("conv").agg(F.max_by("key", "depth").alias("key"))
    ends = ends_of(convs.join(last, "conv", "left").select(F.coalesce("key", F.lit(ROOT)).alias("key"), "conv"))

    nodes = x.groupBy("key").agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv").alias("conv"), F.count("*").alias("n"), F.first("words").alias("words"))
    root = convs.agg(F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent"), F.min("conv").alias("conv"), F.count("*").alias("n"), F.lit(0).cast("long").alias("words")).where("n > 0")
    nodes = materialize(nodes.union(root), "nodes")
    kids = materialize(nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("n") == 1, 1)).alias("solo")), "children")
    total = nodes.count()
    parents = materialize(kids.join(nodes.select(F.col("key").alias("parent"), F.col("conv").alias("above")), "parent"), "parents")
    nodes = nodes.join(kids.select(F.col("parent").alias("key"), F.col("rows").alias("n_children"), "solo"), "key", "left")
    nodes = materialize(with_facts(nodes.fillna(0, ["n_children", "solo"]), parents.select("parent", "rows", "above"), ["parent"], total), "linked-nodes")

    # nodes with many members are settled last; what hangs below them are the shards
    members = (nodes.where(F.col("key") == ROOT).select("n").first() or [0])[0]
    many = F.col("n") > max(1000, members // heavy)
    shared = nodes.where("n > 1 OR depth = 0").withColumns({"leaves": (F.col("n_children") == 0).cast("long") + F.col("solo"), "saved": ((F.col("n") - 1) * F.col("words")).cast("decimal(38,0)"), "many": many | (F.col("depth") == 0)})
    shards = _sharded(x, shared, semi=nodes.where(many).select("key"))
    below = materialize(_passed(shards, queue), "shard-totals")
    sent = below.where("sent IS NOT NULL").select(F.col("sent").alias("key"), "leaves", "saved")
    above = _with_messages(shared.where("many").withColumn("inside", F.col("parent").isNotNull()), sent)
    above = materialize(_passed(above.coalesce(1), queue), "top-totals")
    sums = below.union(above).select("key", "leaves", "saved")

    out = nodes.join(sums, "key", "left").join(ends, "key", "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(nobody)).alias("ends_sha256"),
    )


def _sharded(x: DataFrame, shared: DataFrame, semi: DataFrame) -> DataFrame:
    """The nodes of `shared` that don't have many members, dealt by the highest such node on their way: a subtree stays whole.
    Members get fewer on the way down, so that node is the first of the smallest member's turns that isn't among `semi`."""
    few = semi_by_size(x, materialize(semi, "heavy-nodes"), "key", "left_anti")
    tops = materialize(few.groupBy("conv").agg(F.min_by("key", "depth").alias("shard"), F.count("*").alias("rows")), "shards")
    light = shared.where("NOT many")
    light = with_facts(light, tops, ["conv"], x.count())
    return light.withColumn("inside", F.col("key") != F.col("shard")).repartition(task_count(x.sparkSession), "shard")
