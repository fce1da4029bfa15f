"""Near-duplicate detection with b-bit MinHash.

Each distinct shingle set gets one minimum for every permutation. Bands of full minima give candidates; of each minimum
only the low two bits are kept, packed into three longs, and XOR and bit counts estimate the similarity of a pair,
corrected for chance collisions. Pairs whose estimate is clearly too low go; the rest are confirmed on full sets.

All pairs of a bucket are never made: every set is compared with the smallest id of each of its buckets, what links is
one component. Sets of different components that still share a bucket are compared after that, in blocks, unless too many
of their shingles are their own.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import NO_ID, WordHashes, batches_of, connected_components, dealt_join, numbered_rows, rolling, semi_by_size, shingle_set, utf8, with_facts
from hazeline.session import materialize

BANDS, ROWS, BITS = 24, 4, 2
PERMUTATIONS = BANDS * ROWS
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_X = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_C = 2.0**-BITS


def minima(s: np.ndarray) -> np.ndarray:
    """The minimum of each permutation over the set; the multiplier is odd, so each is a bijection of 32 bits."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    for i in range(0, len(h), 2048):
        m = np.multiply.outer(_A, h[i : i + 2048])
        m ^= _X[:, None]
        np.minimum(low, m.min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum, 32 to a long."""
    bits = (low & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def _sketch(k: int):
    def run(batches):
        cache = WordHashes()
        for docs, texts in batches_of(batches, ["doc", "content"]):
            n, dig, bands, sig = [], [], [], []
            for text in texts:
                s = shingle_set(text.lower(), k, cache)
                n.append(len(s))
                dig.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    low = minima(s)
                    key = rolling(np.append(low.astype(np.uint64).reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)[:, None], axis=1).ravel(), ROWS + 1)[:: ROWS + 1]
                    bands.append(key.view(np.int64).tolist())
                    sig.append(pack(low).view(np.int64).tolist())
                else:
                    bands.append([])
                    sig.append([0, 0, 0])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(dig), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))], ["doc", "n", "dig", "bands", "sig"])

    return run


def estimate(a: str, b: str) -> Column:
    """Collision-corrected similarity of two packed signatures, from the share of equal two-bit cells."""
    odd = 0
    for i in range(PERMUTATIONS * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        odd = odd + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return (1.0 - odd / PERMUTATIONS - _C) / (1.0 - _C)


def _squeeze(batches):
    z = zstandard.ZstdCompressor(level=1)
    for docs, texts in batches_of(batches, ["doc", "content"]):
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([z.compress(t) for t in texts], pa.binary())], ["doc", "z"])


def _confirm(k: int, percent: int):
    def run(batches):
        cache, sets, z = WordHashes(), OrderedDict(), zstandard.ZstdDecompressor()

        def of(doc: int, packed: bytes) -> np.ndarray:
            if doc not in sets:
                if len(sets) >= 64:
                    sets.popitem(last=False)
                sets[doc] = shingle_set(z.decompress(packed).lower(), k, cache)
            return sets[doc]

        for us, vs, uz, vz in batches_of(batches, ["u", "v", "uz", "vz"]):
            ok = []
            for u, v, a, b in zip(us, vs, uz, vz, strict=True):
                x, y = of(v, b), of(u, a)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = [i for i, yes in enumerate(ok) if yes]
            yield pa.RecordBatch.from_arrays([pa.array([us[i] for i in keep], pa.int64()), pa.array([vs[i] for i in keep], pa.int64())], ["u", "v"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of ids that link on full shingle sets. texts(doc, content) has each id once."""
    pairs = materialize(pairs, "near-pairs")
    ids = materialize(pairs.select(F.col("u").alias("doc")).union(pairs.select(F.col("v").alias("doc"))).distinct(), "near-ids")
    z = semi_by_size(texts, ids, "doc").dropDuplicates(["doc"]).mapInArrow(_squeeze, "doc long, z binary")
    z = materialize(z, "near-texts")
    # the least id of a bucket stands in the pairs of all its members
    leads = dealt_join(pairs, z.select(F.col("doc").alias("v"), F.col("z").alias("vz")), "v", pairs.count(), "near-load")
    full = leads.join(z.select(F.col("doc").alias("u"), F.col("z").alias("uz")), "u")
    return materialize(full.select("u", "v", "uz", "vz").mapInArrow(_confirm(k, percent), "u long, v long"), "near-links")


def mixed(entries: DataFrame) -> DataFrame:
    """Entries (rep, key, component) of the buckets that hold more than one component. entries is a written table."""
    keys = entries.groupBy("key").agg(F.count("*").alias("rows"), F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    return with_facts(entries, materialize(keys.select("key", "rows", F.lit(True).alias("_mixed")), "near-keys"), ["key"], entries.count()).where("_mixed").drop("_mixed")


def own_shingles(docs: DataFrame, k: int) -> DataFrame:
    """(doc, own): how many shingles of a document no other one of docs has. No link can count these as common."""

    def run(batches):
        cache = WordHashes()
        for ids, texts in batches_of(batches, ["doc", "content"]):
            for doc, text in zip(ids, texts, strict=True):
                s = shingle_set(text.lower(), k, cache)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), doc, np.int64)), pa.array(s.view(np.int64))], ["doc", "s"])

    seen = docs.dropDuplicates(["doc"]).mapInArrow(run, "doc long, s long").groupBy("s").agg(F.count("*").alias("n"), F.min("doc").alias("doc"))
    return seen.where("n = 1").groupBy("doc").agg(F.count("*").alias("own"))


def _across(k: int, percent: int, floor: float):
    """Links between components in one pair of blocks. What has linked is one component at once, so each two components
    are compared only until their first link."""

    def run(table: pa.Table) -> pa.Table:
        cache, z = WordHashes(), zstandard.ZstdDecompressor()
        rep, n, own, side = (table.column(c).to_numpy() for c in ("rep", "n", "own", "side"))
        sig = np.array(table.column("sig").to_pylist(), np.int64).view(np.uint64)
        _, comp = np.unique(table.column("component").to_numpy(), return_inverse=True)
        packed, sets = table.column("z"), {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(z.decompress(packed[i].as_py()).lower(), k, cache)
            return sets[i]

        u, v = [], []
        for i in range(len(rep)):
            other = np.flatnonzero((comp != comp[i]) & ((side != side[i]) if side.min() != side.max() else True) & (np.arange(len(rep)) > i))
            most = np.minimum(n[other] - own[other], n[i] - own[i])
            other = other[(100 + percent) * most >= percent * (n[other] + n[i])]
            x = sig[other] ^ sig[i]
            odd = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
            for j in other[(1 - odd / PERMUTATIONS - _C) / (1 - _C) >= floor].tolist():
                if comp[i] != comp[j]:
                    both = len(np.intersect1d(of(i), of(j), assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        comp[comp == comp[j]] = comp[i]
                        u.append(rep[i])
                        v.append(rep[j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def crossed(open_: DataFrame, texts: DataFrame, k: int, percent: int, floor: float, block: int = 256) -> DataFrame:
    """Links that join components within each cluster of open_(rep, cluster, component, n, own, sig).

    A cluster is dealt by hash to blocks of about `block` sets, and each pair of blocks is one group of at most about two
    blocks, whatever the cluster's size. Only links leave a group. A cluster of m blocks sends each set to m groups.
    """
    sizes = open_.groupBy("cluster").agg(F.count("*").alias("size"), F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    sizes = materialize(sizes.select("cluster", F.col("size").alias("rows"), F.ceil(F.col("size") / block).cast("int").alias("m")), "near-sizes")
    x = materialize(with_facts(open_, sizes, ["cluster"], open_.count()).where("m IS NOT NULL"), "near-blocks")
    z = semi_by_size(texts, x.select(F.col("rep").alias("doc")), "doc").dropDuplicates(["doc"]).mapInArrow(_squeeze, "doc long, z binary")
    x = x.join(z, x["rep"] == z["doc"]).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
    x = x.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("i", F.least("side", "to")).withColumn("j", F.greatest("side", "to"))
    return materialize(x.select("cluster", "i", "j", "side", "rep", "component", "n", "own", "sig", "z").groupBy("cluster", "i", "j").applyInArrow(_across(k, percent, floor), "u long, v long"), "near-links")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, margin: float = 0.22) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are what stands between white space, with A-Z lower-cased; a set is the distinct shingles of that many words.
    A text with fewer words is one shingle; a text without words, or null, has an empty set and links with nothing. Two
    documents link when 100 * |intersection| >= percent * |union|. component_id is the smallest doc_id that links lead to;
    kept marks it. Equal sets are one node, so copies cost one row each. A row without doc_id joins a group
    only through a set equal to another's, and stays alone otherwise; rows that repeat a doc_id get the same answer if
    their texts are equal. Other columns are left out whatever their
    names; an empty table gives no rows. A pair of the threshold's similarity shares no band with probability 3e-6, and
    an estimate falls margin below the truth with probability 6e-6.
    """
    floor = percent / 100 - margin
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), utf8("text").alias("content"))
    sets = materialize(d.mapInArrow(_sketch(words), "doc long, n long, dig binary, bands array<long>, sig array<long>"), "near-sets")
    least = sets.where("n > 0").groupBy("dig").agg(F.count("*").alias("rows"), F.min(F.when(F.col("doc") != NO_ID, F.col("doc"))).alias("rep"))
    least = materialize(least.where("rep IS NOT NULL"), "near-classes")
    own = least.select(F.col("dig").alias("rdig"), "rep")
    reps = materialize(sets.join(own, (F.col("doc") == F.col("rep")) & (F.col("dig") == F.col("rdig"))).dropDuplicates(["doc", "dig"]).select("rep", "n", "bands", "sig"), "near-reps")

    entries = reps.select("rep", F.explode("bands").alias("key"))
    lead = entries.groupBy("key").agg(F.count("*").alias("rows"), F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select("key", "rows", "lead")
    shared = materialize(with_facts(entries, materialize(lead, "near-leads"), ["key"], BANDS * reps.count()).where("lead IS NOT NULL"), "near-shared")
    pairs = shared.where("rep <> lead").select(F.col("rep").alias("u"), F.col("lead").alias("v")).distinct()
    one = reps.select(F.col("rep").alias("u"), F.col("n").alias("un"), F.col("sig").alias("us"))
    two = reps.select(F.col("rep").alias("v"), F.col("n").alias("vn"), F.col("sig").alias("vs"))
    sized = f"100 * least(un, vn) >= {percent} * greatest(un, vn)"
    stars = pairs.join(one, "u").join(two, "v").where(sized).where(estimate("us", "vs") >= floor).select("u", "v")
    links = confirmed(stars, d, words, percent)
    parts = materialize(connected_components(links), "near-parts")

    # What still shares a bucket across components, without the sets that can link with none.
    open_ = materialize(shared.select("rep", "key").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "near-open")
    open_ = materialize(mixed(open_), "near-open")
    alone = own_shingles(semi_by_size(d, open_.select(F.col("rep").alias("doc")).distinct(), "doc"), words)
    facts = open_.select("rep", "component").distinct().join(reps.select("rep", "n", "sig"), "rep").join(alone.withColumnRenamed("doc", "rep"), "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    facts = materialize(facts.where(f"100 * (n - own) >= {percent} * n"), "near-facts")
    open_ = materialize(mixed(materialize(open_.join(facts.select("rep"), "rep", "left_semi"), "near-open")), "near-open")
    hubs = materialize(open_.groupBy("key").agg(F.count("*").alias("rows"), F.min("rep").alias("v")), "near-hubs")
    spokes = with_facts(open_.select("key", F.col("rep").alias("u")), hubs, ["key"], open_.count())
    clusters = connected_components(spokes.select("u", "v").distinct(), "near-clusters")
    clusters = materialize(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(facts, "rep"), "near-clusters")
    more = crossed(clusters, d, words, percent, floor)
    parts = materialize(connected_components(links.union(more)), "near-parts")

    named = least.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("dig", "rows", F.coalesce("component", "rep").alias("component"))
    full = sets.where("n > 0").select("doc", "n", "dig")
    out = with_facts(full, materialize(named, "near-named"), ["dig"], sets.count()).select("doc", "n", F.coalesce("component", "doc").alias("component"))
    out = out.union(sets.where("n = 0").select("doc", "n", F.col("doc").alias("component")))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("doc").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate group, that with the smallest doc_id (null last). Rows are told apart by a
    number of their own, so rows without a doc_id, of one doc_id with other texts and repeated rows count each for itself."""
    d, row = numbered_rows(docs)
    linked = near_groups(d.select(F.col(row).alias("doc_id"), "text"), words, percent).where("NOT kept").select(F.col("doc_id").alias(row), F.col("component_id").alias("component"))
    linked = materialize(linked, "near-linked")
    members = linked.union(linked.select("component", "component").distinct())
    members = materialize(d.select(row, F.col("doc_id").cast("long").alias("_doc")).join(members, row), "near-members")
    best = members.groupBy("component").agg(F.count("*").alias("rows"), F.min(F.struct(F.col("_doc").isNull(), "_doc", row))[row].alias("_best"))
    gone = with_facts(members, materialize(best, "near-best"), ["component"], members.count()).where(F.col(row) != F.col("_best")).select(row)
    return semi_by_size(d, materialize(gone, "near-gone"), row, "left_anti").select(*docs.columns)
