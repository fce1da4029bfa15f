"""Substring deduplication with difference-cover anchors.

A word is removed if a window of consecutive words that covers it also starts earlier in the table. Anchors are hashes of
8 words at the positions whose remainder modulo 13 is in {0, 1, 3, 9}. That set is a difference cover: for any two
positions some shift below 13 brings both into it, so two equal windows of 8 + 12 words share an anchor at the same
offset, whatever their alignment. From each anchor seen twice the text is extended to every window that holds it; these windows are
matched by 128-bit hashes, made of two independent 64-bit hashes of each word, so that the chance of any false match stays
below 1e-10 at 10^14 windows.

Hashes are matched in packed blocks. A task folds the hashes of a block of documents, so a passage that stands in a third
of all documents sends one entry a block; what repeats within the block is settled there. The answers go back by document.
The number of buckets follows the counted bytes of text, and a reducer that meets a larger bucket splits it to spill files
by further hash bits.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import NO_ID, WordHashes, batches_of, hash_words, mix, rolling, utf8
from hazeline.session import materialize

PERIOD = 13
COVER = np.array([0, 1, 3, 9])
_COVERED = np.isin(np.arange(PERIOD), COVER)
#: h and g are the two halves of a hash; anchors have no second half.
_ENTRY = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<i4"), ("many", "?")])
#: Kinds of packed rows: entries to match by hash, and positions of a document that are settled already.
_ASK, _SETTLED = 0, 1
_PACKED = "kind byte, bucket int, body binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kind, bucket, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary())], ["kind", "bucket", "body"])


def _dealt(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Places packed for each bucket of documents: counts, distinct documents, positions of each in order."""
    bucket = mix(np.ascontiguousarray(doc).view(np.uint64)) % np.uint64(buckets)
    order = np.lexsort((at, tag, doc, bucket))
    doc, tag, at, bucket = doc[order], tag[order], at[order].astype(np.int32), bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(starts, [*starts[1:], len(doc)], strict=True):
        d, t = doc[a:b], tag[a:b]
        new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
        n = np.diff(np.append(new, b - a)).astype(np.int32)
        yield int(bucket[a]), b"".join(x.tobytes() for x in (np.array([b - a, len(new)]), d[new], t[new], n, at[a:b]))


def _places(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(body, np.int64, 2)
    doc, tag = np.frombuffer(body, np.int64, m, 16), np.frombuffer(body, np.int64, m, 16 + 8 * m)
    times = np.frombuffer(body, np.int32, m, 16 + 16 * m)
    return np.repeat(doc, times), np.repeat(tag, times), np.frombuffer(body, np.int32, n, 16 + 20 * m)


class OtherHashes(WordHashes):
    """A second hash of each word, independent of the first."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, 0x5EED)
        if len(word) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[word] = h
        return h


class Block:
    """Hashes with their places, gathered over documents up to a number of entries, then folded and dealt to buckets.

    places: all: every place of a repeated hash counts; or later: every place but the first in (doc, at) order.
    """

    def __init__(self, buckets: int, later: bool, most: int = 2_000_000):
        self.buckets, self.later, self.most = buckets, later, most
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, doc: int, tag: int, at: np.ndarray, h: np.ndarray, g: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.parts.append((doc, tag, at, h, np.zeros(len(h), np.uint64) if g is None else g))
        self.size += len(h)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        # in (doc, tag, at) order, so that the first of equal hashes is the earliest
        parts = sorted(self.parts, key=lambda p: p[:2])
        self.parts, self.size = [], 0
        sizes = [len(p[3]) for p in parts]
        h, g, at = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int32)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        ids = np.array([p[:2] for p in parts], np.int64).reshape(-1, 2)
        order = np.lexsort((g, h)) if self.later else np.argsort(h, kind="stable")
        hs, gs = h[order], g[order]
        first = np.append(True, (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1]))
        group = np.cumsum(first) - 1
        many = np.bincount(group) > 1
        heads = order[first]
        local = order[many[group] & (~first if self.later else True)]
        rows: list[tuple] = []
        if len(local):
            doc, tag = ids[owner[local]].T
            rows += [(_SETTLED, bucket, body) for bucket, body in _dealt(doc, tag, at[local], self.buckets)]
        e = np.empty(len(heads), _ENTRY)
        e["h"], e["g"], e["at"], e["many"] = h[heads], g[heads], at[heads], many
        e["doc"], e["tag"] = ids[owner[heads]].T
        bucket = (mix(e["h"]) >> np.uint64(20)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        e, bucket = e[order], bucket[order]
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(starts, [*starts[1:], len(e)], strict=True):
            rows.append((_ASK, int(bucket[a]), _shut(e[a:b])))
            if len(rows) >= 4000:
                yield _packed(rows)
                rows = []
        if rows:
            yield _packed(rows)


def _shut(e: np.ndarray) -> bytes:
    """Entries as bytes: hashes and positions as they are, documents as indexes into the distinct ones."""
    who, which = np.unique(e[["doc", "tag"]], return_inverse=True)
    who = np.array(who.tolist(), [("doc", "<i8"), ("tag", "<i8")])
    small = np.uint8 if len(who) < 256 else np.uint16 if len(who) < 65536 else np.uint32
    wide = np.uint16 if int(e["at"].max()) < 65536 else np.uint32
    low = int(who["doc"].min())
    doc = np.uint32 if int(who["doc"].max()) - low < 2**32 else np.uint64
    head = np.array([len(e), len(who), np.dtype(small).itemsize, np.dtype(wide).itemsize, np.dtype(doc).itemsize, e["g"].any()], np.int32)
    offset = (who["doc"].view(np.uint64) - np.int64(low).view(np.uint64)).astype(doc)
    return b"".join(x.tobytes() for x in (head, np.array([low]), e["h"], e["g"] if head[5] else e["g"][:0], who["tag"], offset, which.astype(small), e["at"].astype(wide), np.packbits(e["many"])))


def _open(body: bytes) -> np.ndarray:
    n, m, small, wide, size, second = np.frombuffer(body, np.int32, 6)
    e, p = np.empty(n, _ENTRY), 24

    def take(kind, count):
        nonlocal p
        x = np.frombuffer(body, kind, count, p)
        p += x.nbytes
        return x

    low = take(np.int64, 1)
    e["h"] = take(np.uint64, n)
    e["g"] = take(np.uint64, n) if second else 0
    tag = take(np.int64, m)
    doc = (take(f"<u{size}", m).astype(np.uint64) + low.view(np.uint64)).view(np.int64)
    which = take(f"<u{small}", n)
    e["doc"], e["tag"], e["at"] = doc[which], tag[which], take(f"<u{wide}", n)
    e["many"] = np.unpackbits(take(np.uint8, (n + 7) // 8), count=n).astype(bool)
    return e


class Bucket:
    """Entries of one bucket. Beyond limit bytes they go to spill files by further hash bits, and each file is a bucket of
    its own; entries of one hash can't be split, and there is one for each block at most."""

    def __init__(self, limit: int, level: int = 0, fan: int = 16):
        self.limit, self.level, self.fan = limit, level, fan
        self.held: list[np.ndarray] = []
        self.size, self.files, self.dir = 0, None, None

    def add(self, e: np.ndarray) -> None:
        self.size += e.nbytes
        if self.files is None:
            self.held.append(e)
            if self.size <= self.limit or self.level >= 8:
                return
            self.dir = tempfile.TemporaryDirectory(prefix="anchors-")
            self.files = [open(f"{self.dir.name}/{k}", "wb") for k in range(self.fan)]  # noqa: SIM115
            e, self.held = np.concatenate(self.held), []
        part = (mix(e["h"] + np.uint64(self.level)) % np.uint64(self.fan)).astype(int)
        for k in np.unique(part).tolist():
            self.files[k].write(e[part == k].tobytes())

    def parts(self) -> Iterator[np.ndarray]:
        if self.files is None:
            if self.held:
                yield np.concatenate(self.held)
            return
        for f in self.files:
            f.close()
        with self.dir as where:
            for k in range(self.fan):
                own = Bucket(self.limit, self.level + 1, self.fan)
                with open(f"{where}/{k}", "rb") as f:
                    while body := f.read(_ENTRY.itemsize << 16):
                        own.add(np.frombuffer(body, _ENTRY))
                yield from own.parts()


def _match(later: bool, buckets: int, limit: int, most: int = 2_000_000) -> Callable:
    """Over rows sorted by bucket: the places of each hash that more than one block has, or that are not the earliest,
    dealt to the buckets of their documents."""

    def settle(e: np.ndarray) -> tuple:
        e = e[np.lexsort((e["at"], e["tag"], e["doc"], e["g"], e["h"]))] if later else e[np.argsort(e["h"], kind="stable")]
        first = np.append(True, (e["h"][1:] != e["h"][:-1]) | (e["g"][1:] != e["g"][:-1]))
        if later:
            same = np.append(False, (e["doc"][1:] == e["doc"][:-1]) & (e["tag"][1:] == e["tag"][:-1]) & (e["at"][1:] == e["at"][:-1])) & ~first
            hit = e[~first & ~same]
        else:
            # a hash that repeats within its one block has been settled there
            group = np.cumsum(first) - 1
            hit = e[(np.bincount(group) > 1)[group] & ~e["many"]]
        return hit["doc"], hit["tag"], hit["at"]

    def run(batches):
        found: list[tuple] = []
        held = Bucket(limit)
        now, size = None, 0

        def ready():
            nonlocal size
            if size:
                rows = [(_SETTLED, *x) for x in _dealt(*(np.concatenate(x) for x in zip(*found, strict=True)), buckets)]
                found.clear()
                size = 0
                for i in range(0, len(rows), 2000):
                    yield _packed(rows[i : i + 2000])

        def add(places):
            nonlocal size
            found.append(places)
            size += len(places[0])

        for cols in batches_of(batches, ["kind", "bucket", "body"]):
            for kind, bucket, body in zip(*cols, strict=True):
                if bucket != now:
                    for e in held.parts():
                        add(settle(e))
                        if size >= most:
                            yield from ready()
                    held, now = Bucket(limit), bucket
                if kind == _SETTLED:
                    add(_places(body))
                else:
                    held.add(_open(body))
                if size >= most:
                    yield from ready()
        for e in held.parts():
            add(settle(e))
            if size >= most:
                yield from ready()
        yield from ready()

    return run


def _gather(batches):
    """Over rows sorted by bucket: one row for each document with all its places."""

    def rows(bodies: list[bytes]):
        doc, tag, at = (np.concatenate(x) for x in zip(*map(_places, bodies), strict=True))
        order = np.lexsort((at, tag, doc))
        doc, tag, at = doc[order], tag[order], at[order]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
        ends = [*new[1:].tolist(), len(doc)]
        for i in range(0, len(new), 4000):
            own = new[i : i + 4000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(tag[own]), pa.array([at[a:b].tobytes() for a, b in zip(own.tolist(), ends[i : i + 4000], strict=True)], pa.binary())], ["doc", "tag", "body"])

    held, now = [], None
    for buckets, bodies in batches_of(batches, ["bucket", "body"]):
        for bucket, body in zip(buckets, bodies, strict=True):
            if bucket != now and held:
                yield from rows(held)
                held = []
            now = bucket
            held.append(body)
    if held:
        yield from rows(held)


def _anchors(k: int, buckets: int, window: int):
    def run(batches):
        cache, block = WordHashes(), Block(buckets, later=False)
        for docs, tags, texts in batches_of(batches, ["doc", "tag", "content"]):
            for doc, tag, text in zip(docs, tags, texts, strict=True):
                h = hash_words(text.split(), cache)
                if len(h) >= window:
                    at = np.flatnonzero(_COVERED[np.arange(len(h) - k + 1) % PERIOD])
                    yield from block.add(doc, tag, at, rolling(h, k)[at])
        yield from block.flush()

    return run


def _windows(k: int, buckets: int, window: int):
    """Hashes of the windows that hold an anchor seen twice."""

    def run(batches):
        cache, other, block, z = WordHashes(), OtherHashes(), Block(buckets, later=True), zstandard.ZstdDecompressor()
        for docs, tags, texts, found in batches_of(batches, ["doc", "tag", "z", "body"]):
            for doc, tag, packed, body in zip(docs, tags, texts, found, strict=True):
                words = z.decompress(packed).split()
                h = hash_words(words, cache)
                at = np.frombuffer(body, np.int32)
                cover = np.zeros(len(h) + 1, np.int64)
                np.add.at(cover, np.maximum(at - (window - k), 0), 1)
                np.add.at(cover, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(cover)[: len(h) - window + 1] > 0)
                if len(starts):
                    yield from block.add(doc, tag, starts, rolling(h, window)[starts], rolling(hash_words(words, other), window)[starts])
        yield from block.flush()

    return run


def _squeeze(batches):
    z = zstandard.ZstdCompressor(level=1)
    for docs, tags, texts in batches_of(batches, ["doc", "tag", "content"]):
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array([z.compress(t) for t in texts], pa.binary())], ["doc", "tag", "z"])


def _keep(window: int):
    def run(batches):
        z = zstandard.ZstdDecompressor()
        for docs, texts, found in batches_of(batches, ["doc", "z", "body"]):
            n, gone, sha, left = [], [], [], []
            for packed, body in zip(texts, found, strict=True):
                words = z.decompress(packed).split()
                n.append(len(words))
                if body:
                    at = np.frombuffer(body, np.int32)
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    out = np.cumsum(cover)[: len(words)] > 0
                    gone.append(int(out.sum()))
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                else:
                    gone.append(0)
                kept = b" ".join(words)
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(left, pa.large_string()).cast(pa.string())], ["doc", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def repeated_windows(docs: DataFrame, window: int = 20, anchor: int = 8, bucket_bytes: int = 8 << 20, partition_bytes: int = 64 << 20, limit: int = 48 << 20) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text.

    A window is that many consecutive words of one document. A word goes if a window that covers it also starts earlier:
    in a smaller doc_id, or earlier in the same document. Windows are judged on the input. Null text has no words. A null
    doc_id sorts last and comes back as null; rows that repeat both doc_id and text are judged as one and get the same
    answer, and rows that repeat a doc_id with another text come in the order of the texts' hashes. Other columns are left
    out whatever their names; an empty table gives no rows. window must be at least anchor + 12. There is a bucket for
    every bucket_bytes of text, and a partition for every partition_bytes, but no fewer than
    spark.sql.shuffle.partitions; limit bounds the entries that a reducer holds.
    """
    if window < anchor + PERIOD - 1:
        raise ValueError("two equal windows need not share an anchor if window < anchor + 12")
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // partition_bytes))
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(utf8("text")).alias("tag"), utf8("text").alias("content"))
    z = d.mapInArrow(_squeeze, "doc long, tag long, z binary")

    def answers(asked: DataFrame, later: bool, name: str) -> DataFrame:
        dealt = asked.repartition(parts, "bucket").sortWithinPartitions("bucket")
        found = dealt.mapInArrow(_match(later, buckets, limit), _PACKED).repartition(parts, "bucket").sortWithinPartitions("bucket")
        return materialize(found.mapInArrow(_gather, "doc long, tag long, body binary"), name)

    seen_twice = answers(d.mapInArrow(_anchors(anchor, buckets, window), _PACKED), False, "anchors")
    candidates = z.join(seen_twice, ["doc", "tag"]).dropDuplicates(["doc", "tag"])
    later = answers(candidates.mapInArrow(_windows(anchor, buckets, window), _PACKED), True, "windows")
    out = z.join(later, ["doc", "tag"], "left").select("doc", "z", "body").mapInArrow(_keep(window), "doc long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text")
