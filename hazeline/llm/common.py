"""What the text operators share: words, rolling hashes, components, size-checked semi joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazeline.session import materialize, task_count

#: A missing doc_id travels through packed arrays as this value, sorts last, and comes back as null.
NO_ID = 2**63 - 1
#: The white space of every contract: [\x20\x09-\x0D]. bytes.split() cuts at exactly these.
SPACE = b" \t\n\x0b\x0c\r"
_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def utf8(name: str) -> Column:
    """A text column as UTF-8 bytes; null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


class WordHashes(dict):
    """64-bit hashes by word. Memory is bounded: long words aren't kept, and a full cache starts anew."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[word] = h
        return h


def hash_words(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64; kept, and doubled when they don't suffice."""
    if len(_powers[0]) < n:
        for i, base in enumerate((int(_B), pow(int(_B), -1, 2**64))):
            _powers[i] = np.cumprod(np.append(np.uint64(1), np.full(max(n, 2 * len(_powers[0])), base, np.uint64)), dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words; empty if there are fewer. Long windows come from running sums, whose cost doesn't
    depend on k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if k >= 8:
        power, back = powers(len(h))
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power, out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * back[:n])
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _B
        acc += h[j : j + n]
    return mix(acc)


def shingle_set(text: bytes, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; with fewer than k words the whole sequence is the one shingle."""
    h = hash_words(text.split(), cache)
    if 0 < len(h) < k:
        return rolling(h, len(h))
    return np.unique(rolling(h, k))


def semi_by_size(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi", broadcast_rows: int = 500_000) -> DataFrame:
    """Rows of df whose key is (left_semi) or isn't (left_anti) in ids, which has the key columns. ids is broadcast only after a
    count has shown that it has at most broadcast_rows rows of eight bytes; beyond that both sides are shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, key, how)


def numbered_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a table with a number for each row, and that column's name, which docs doesn't have. Written once, so that a
    row keeps its number however often the table is read."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def with_facts(x: DataFrame, facts: DataFrame, on: list[str], total: int, most: int = 256, small: int = 100_000) -> DataFrame:
    """x left-joined with facts(*on, rows, ...), one row a key; rows counts the rows of x that have the key, total all rows.

    A key with more than total / most rows comes by broadcast: there are fewer than `most` of them, since their rows sum
    to no more than total. Its rows of x are dealt by a hash of theirs in the shuffle that joins all other keys, so that
    no task gets a hot host whole. Facts that have been counted to hold no more than `small` rows come by broadcast
    altogether (0 where their rows are long). Write facts as a table first: it is read more than once, and is made from x.
    """
    if small and facts.count() <= small:
        return x.join(F.broadcast(facts.drop("rows")), on, "left")
    values = [c for c in facts.columns if c not in on and c != "rows"]
    hot = facts.where(F.col("rows") > total / most).select(*on, F.lit(True).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in values))
    rest = facts.where(F.col("rows") <= total / most).select(*on, F.lit(0).cast("long").alias("_deal"), *values)
    own = F.xxhash64(*(c for c in x.columns if not c.startswith("_")))
    x = x.join(F.broadcast(hot), on, "left").withColumn("_deal", F.when(F.col("_hot"), 1 + F.pmod(own, F.lit(4096))).otherwise(0).cast("long"))
    x = x.join(rest, [*on, "_deal"], "left")
    return x.withColumns({c: F.coalesce(c, f"_hot_{c}") for c in values}).drop("_deal", "_hot", *(f"_hot_{c}" for c in values))


def dealt_join(x: DataFrame, wide: DataFrame, key: str, total: int, name: str, deal: int = 1000) -> DataFrame:
    """x inner-joined with wide, which has each key once and rows too large to broadcast. Rows of x with a common key are
    dealt to slots of about `deal` rows, and wide's row goes to each slot. x is a written table of total rows."""
    load = x.groupBy(key).agg(F.count("*").alias("rows")).withColumn("_slots", F.ceil(F.col("rows") / deal).cast("int"))
    load = materialize(load, name)
    own = F.pmod(F.xxhash64(*(c for c in x.columns if c != key)), "_slots").cast("int")
    x = with_facts(x, load, [key], total).withColumn("_slot", own).drop("_slots")
    copies = wide.join(load.select(key, "_slots"), key).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1))).drop("_slots")
    return x.join(copies, [key, "_slot"]).drop("_slot")


def parted(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df as a table in ranges of (group, order), with the range's number as _part. Take a written table with a column that
    tells rows apart as the last of the order: ranges come from a sample, and a key of any weight is cut by that column."""
    cut = df.repartitionByRange(task_count(df.sparkSession), *group, *order)
    return materialize(cut.withColumn("_part", F.spark_partition_id()), name)


def carried(x: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """x, which parted() wrote, with running sums within each group in the order. No group is gathered in one task: sums run
    within ranges, and a range takes over the total of its group in those before. At most one group a range began before it,
    so those totals are no more rows than there are ranges, and come by broadcast. Group columns aren't null."""
    own = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = x.groupBy("_part", *group).agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = ends.select("_part", *group, *(F.sum(f"_{k}").over(before).alias(f"_{k}") for k in sums)).where(F.col(f"_{next(iter(sums))}").isNotNull())
    x = x.withColumns({k: F.sum(c).over(own) for k, c in sums.items()}).join(F.broadcast(materialize(spans, name)), ["_part", *group], "left")
    return x.withColumns({k: F.col(k) + F.coalesce(F.col(f"_{k}"), F.lit(0)) for k in sums}).drop(*(f"_{k}" for k in sums))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): for each node of edges(u, v) the smallest node that it reaches.

    Alternating large-star and small-star steps, each a grouped minimum and a join on the node. Minima of hubs with a large
    share of all links come by broadcast, and their links are dealt over the tasks. The driver sees two numbers a round.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def with_least(e: DataFrame, total: int) -> DataFrame:
        return with_facts(e, materialize(e.groupBy("u").agg(F.count("*").alias("rows"), F.min("v").alias("m")), name), ["u"], total)

    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, name)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))
        seen, total = state, 2 * state[0]
        large = with_least(both(now), total).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        down = materialize(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), name)
        small = with_least(down, total).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = materialize(small.where("u <> v").distinct(), name)


def batches_of(batches: Iterator, columns: list[str]) -> Iterator[tuple]:
    """Python lists of the columns of each Arrow batch that has rows."""
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)


def id_or_none(ids: list) -> list:
    return [None if i == NO_ID else int(i) for i in ids]
