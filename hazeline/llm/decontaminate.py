"""Benchmark decontamination by greedy string tiling.

Documents and test items join on seeds, the hashes of min_match words that they share. For each pair that may reach the
asked coverage the longest common run of words that no tile covers yet is found by running Karp-Rabin hashes and compared
word by word; it becomes a tile, and so on down to min_match words. The share of an item's words that tiles cover tells a
leak, in whatever order its passages stand.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazeline.llm.common import NO_ID, WordHashes, batches_of, hash_words, mix, rolling, semi_by_size, utf8, with_facts
from hazeline.session import materialize

_EDGE = b".,;:!?\"'()[]{}<>"
_PAGE = 1 << 16


class PlainHashes(WordHashes):
    """Of words without punctuation at their edges."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word.strip(_EDGE))
        if len(word) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[word] = h
        return h


def plain_words(text: bytes) -> list[bytes]:
    return [w.strip(_EDGE) for w in text.lower().split()]


def seeds_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words; of different k they never stand for each other."""
    return mix(rolling(h, k) ^ np.uint64(k))


class Runs:
    """Hashes of all windows of any length of a word sequence, from one pass: sums of word value times B**position, shifted
    back to the window's start by the inverse of B, modulo 2**64."""

    B = 0x9E3779B97F4A7C15
    INVERSE = pow(B, -1, 2**64)

    def __init__(self, ids: np.ndarray, free: np.ndarray):
        n = len(ids)
        self.ids, self.free = ids, free
        powers = lambda base: np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)), dtype=np.uint64)
        power, self.back = powers(self.B), powers(self.INVERSE)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)))

    def windows(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of s words that are free."""
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(taken[s:] == taken[:-s]) if s <= len(self.ids) else np.empty(0, np.int64)
        return at, (self.sums[at + s] - self.sums[at]) * self.back[at]


def tiles(item: list[bytes], doc: list[bytes], k: int) -> list[tuple[int, int, int]]:
    """(length, item position, document position) of greedy tiling: longest first, ties by item, then document position."""
    known = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a = Runs(np.array([known[w] for w in item], np.int64), np.ones(len(item), bool))
    own = np.array([known.get(w, -1) for w in doc], np.int64)
    b = Runs(np.maximum(own, 0), own >= 0)

    def common(s: int) -> bool:
        return bool(np.isin(a.windows(s)[1], b.windows(s)[1]).any())

    out: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))
    while most >= k and common(k):
        low, high = k, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if common(mid) else (low, mid - 1)
        (i_at, i_hash), (j_at, j_hash) = a.windows(low), b.windows(low)
        shared = np.isin(j_hash, i_hash)
        there = defaultdict(list)
        for j, h in zip(j_at[shared][::-1].tolist(), j_hash[shared][::-1].tolist(), strict=True):
            there[h].append(j)
        for i, h in zip(i_at.tolist(), i_hash.tolist(), strict=True):
            if h not in there or not a.free[i : i + low].all():
                continue
            places = there[h]
            # places at the end of the list come first in the document; one that is taken stays taken
            while places and not b.free[places[-1] : places[-1] + low].all():
                places.pop()
            if places and np.array_equal(a.ids[i : i + low], b.ids[places[-1] : places[-1] + low]):
                j = places.pop()
                a.free[i : i + low] = b.free[j : j + low] = False
                out.append((low, i, j))
        most = low - 1
    return out


def _item_seeds(min_match: int):
    def run(batches):
        cache = PlainHashes()
        for items, tags, texts in batches_of(batches, ["item", "itag", "content"]):
            for item, tag, text in zip(items, tags, texts, strict=True):
                h = hash_words(text.lower().split(), cache)
                if len(h):
                    k = min(min_match, len(h))
                    s, times = np.unique(seeds_of(h, k), return_counts=True)
                    full = lambda v, n=len(s): pa.array(np.full(n, v, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), full(item), full(tag), full(k), full(len(h)), pa.array(times.astype(np.int64))], ["seed", "item", "itag", "k", "m", "times"])

    return run


def bitmap(seeds: DataFrame, most_bits: int) -> np.ndarray:
    """A bit for every seed, at the seed modulo the size. The size follows the counted seeds and is at most most_bits, so what
    reaches the driver is bounded; a fuller map lets more pass, which the join sorts out."""
    n = seeds.select("seed").distinct().count()
    bits = _PAGE
    while bits < min(most_bits, 256 * n):
        bits *= 2
    slot = seeds.select(F.pmod("seed", F.lit(bits)).alias("slot")).distinct().select(F.floor(F.col("slot") / _PAGE).alias("page"), (F.col("slot") % _PAGE).alias("bit"))

    def fill(key: tuple, t: pa.Table) -> pa.Table:
        own = np.zeros(_PAGE, bool)
        own[t.column("bit").to_numpy()] = True
        return pa.table({"page": [key[0].as_py()], "body": pa.array([np.packbits(own).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in slot.groupBy("page").applyInArrow(fill, "page long, body binary").toLocalIterator():
        out[r["page"] * _PAGE // 8 : (r["page"] + 1) * _PAGE // 8] = np.frombuffer(r["body"], np.uint8)
    return out


def _hits(ks: list[int], seen):
    """(seed, doc, tag) of the seeds of each document that the bitmap lets pass."""

    def run(batches):
        cache, bits = PlainHashes(), seen.value
        mask = np.int64(8 * len(bits) - 1)
        for docs, tags, texts in batches_of(batches, ["doc", "tag", "content"]):
            parts = []
            for doc, tag, text in zip(docs, tags, texts, strict=True):
                h = hash_words(text.lower().split(), cache)
                for k in ks:
                    if len(h) >= k:
                        s = seeds_of(h, k).view(np.int64)
                        slot = s & mask
                        s = np.unique(s[bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 == 1])
                        if len(s):
                            parts.append((s, np.full(len(s), doc, np.int64), np.full(len(s), tag, np.int64)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["seed", "doc", "tag"])

    return run


def candidates(hits: DataFrame, seeds: DataFrame, share: float, deal: int = 100_000) -> DataFrame:
    """Pairs (doc, tag, item, itag) that share a seed which matters.

    Tiles over a share of an item's m words hold at least need = ceil(share * m / k) of its seed positions, so the most
    frequent seeds with fewer than need positions in all can go from each item: a leak has another seed too. Of the seeds that
    are left, those that more than `deal` documents have are dealt to slots by document.
    """
    total, n_seeds = hits.count(), seeds.count()
    df = materialize(hits.groupBy("seed").agg(F.count("*").alias("df")).join(seeds.groupBy("seed").agg(F.count("*").alias("rows")), "seed"), "leak-df")
    known = with_facts(seeds, df, ["seed"], n_seeds).where("df IS NOT NULL")
    order = Window.partitionBy("item", "itag").orderBy(F.desc("df"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    kept = known.withColumn("dropped", F.sum("times").over(order)).where(F.col("dropped") >= F.ceil(share * F.col("m") / F.col("k")))
    deal = max(deal, total // 4096)
    slots = F.ceil(F.col("df") / deal).cast("int")
    kept = materialize(kept.select("seed", "item", "itag", "df", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot")), "leak-kept")
    # fewer than 4,096 seeds can have more than total / 4096 documents
    hot = kept.where(F.col("df") > deal).select("seed", slots.alias("slots")).distinct()
    h = hits.join(F.broadcast(hot), "seed", "left").withColumn("slot", F.coalesce(F.pmod(F.xxhash64("doc", "tag"), "slots"), F.lit(0)).cast("int"))
    return h.join(kept, ["seed", "slot"]).select("doc", "tag", "item", "itag").distinct()


def _tile(min_match: int, share: float):
    """Over rows sorted by (doc, tag, slot, kind): a document's text, then its items."""

    def run(batches):
        now, words = None, []
        for docs, tags, slots, kinds, items, texts in batches_of(batches, ["doc", "tag", "slot", "kind", "item", "content"]):
            rows = []
            for doc, tag, slot, kind, item, text in zip(docs, tags, slots, kinds, items, texts, strict=True):
                if kind == 0:
                    now, words = (doc, tag, slot), plain_words(text)
                elif now == (doc, tag, slot):
                    own = plain_words(text)
                    found = tiles(own, words, min(min_match, len(own)))
                    covered = sum(t[0] for t in found)
                    if covered >= share * len(own):
                        rows.append((doc, tag, item, len(own), covered, len(found)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "tag", "item", "n_words", "covered", "tiles"])

    return run


def tiled(docs: DataFrame, benchmark: DataFrame, min_match: int, share: float, filter_bits: int, broadcast_bytes: int = 8 << 20, deal: int = 1000) -> DataFrame:
    """(doc, tag, item, n_words, covered, tiles) of every leak; tag is the hash of the document's text."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(utf8("text")).alias("tag"), utf8("text").alias("content"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item"), F.xxhash64(utf8("text")).alias("itag"), utf8("text").alias("content"))
    items = materialize(items.dropDuplicates(["item", "itag"]), "leak-items")
    seeds = materialize(items.mapInArrow(_item_seeds(min_match), "seed long, item long, itag long, k long, m long, times long"), "leak-seeds")
    ks = sorted(r["k"] for r in seeds.select("k").distinct().collect())  # at most min_match
    seen = spark.sparkContext.broadcast(bitmap(seeds, filter_bits))
    hits = materialize(d.mapInArrow(_hits(ks, seen), "seed long, doc long, tag long"), "leak-hits")
    pairs = materialize(candidates(hits, seeds, share), "leak-pairs")

    # A document with many candidates is dealt to slots of about `deal` pairs, each of which gets its text.
    load = materialize(pairs.groupBy("doc", "tag").agg(F.count("*").alias("rows")).withColumn("slots", F.ceil(F.col("rows") / deal).cast("int")), "leak-load")
    asked = with_facts(pairs, load, ["doc", "tag"], pairs.count()).withColumn("slot", F.pmod(F.xxhash64("item", "itag"), "slots").cast("int"))
    size = items.agg(F.coalesce(F.sum(F.length("content") + 32), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        asked = asked.join(F.broadcast(items), ["item", "itag"])
    else:
        loads = materialize(pairs.groupBy("item", "itag").agg(F.count("*").alias("rows")).join(items, ["item", "itag"]), "leak-asked")
        asked = with_facts(asked, loads, ["item", "itag"], pairs.count(), small=0)
    texts = d.join(F.broadcast(load) if load.count() <= 200_000 else load, ["doc", "tag"]).dropDuplicates(["doc", "tag"])
    texts = texts.select("doc", "tag", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("item"), "content")
    rows = texts.union(asked.select("doc", "tag", "slot", F.lit(1), "item", "content"))
    rows = rows.repartition("doc", "tag", "slot").sortWithinPartitions("doc", "tag", "slot", "kind")
    return rows.mapInArrow(_tile(min_match, share), "doc long, tag long, item long, n_words long, covered long, tiles long")


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, share: float = 0.5, filter_bits: int = 1 << 28) -> DataFrame:
    """One row per document of docs(doc_id, text) and item of benchmark(item_id, text) that it leaks: doc_id, item_id,
    item_words, covered_words, tiles, coverage.

    Words are lower-cased (A-Z), without punctuation at the edges. A pair is a leak when tiles of at least min_match words
    cover the given share of the item. Null and empty texts, and items without words, leak nothing; an item shorter than
    min_match must stand whole. A null doc_id or item_id comes back as null. Rows that repeat both id and text count once;
    rows that repeat an id with another text are judged each. Other columns are left out whatever their names; empty tables
    give no rows. The map of all items' seeds that goes to the tasks has at most filter_bits bits, whatever the benchmark's
    size; longer texts of items are joined by shuffle.
    """
    out = tiled(docs, benchmark, min_match, share, filter_bits)
    back = lambda c, name: F.when(F.col(c) != NO_ID, F.col(c)).alias(name)
    return out.select(back("doc", "doc_id"), back("item", "item_id"), F.col("n_words").alias("item_words"), F.col("covered").alias("covered_words"), "tiles", (F.col("covered") / F.col("n_words")).alias("coverage"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak an item; rows are told by id and text together, so rows without an id are judged too."""
    gone = materialize(tiled(docs, benchmark, 5, 0.5, 1 << 28).select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).distinct(), "leaks")
    keyed = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_tag": F.xxhash64(utf8("text"))})
    return semi_by_size(keyed, gone, ["_doc", "_tag"], "left_anti").drop("_doc", "_tag")
