"""Exact deduplication by Grace hash partitioning.

Spark's exchange deals distinct contents to partitions by hash; in each task the records are split on to spill files by
further hash bits until a bucket fits an open-addressing table, which compares complete contents. Before the exchange
each task folds its own copies with the same table, so a group of copies sends one record a task, however large it is.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import NO_ID, SPACE, batches_of, numbered_rows, semi_by_size, utf8, with_facts
from hazeline.session import materialize

_PART = "h long, content binary, n long, points long, doc long, row long"


class ContentTable:
    """Open addressing with linear probing; a record is (content, copies, code points, id and row number of the best copy)."""

    def __init__(self, slots: int = 1024):
        self.slots, self.hashes, self.rows, self.bytes = np.full(slots, -1, np.int64), [], [], 0

    def put(self, h: int, content: bytes, n: int, points: int, doc: int, number: int) -> None:
        mask = len(self.slots) - 1
        at = (h ^ (h >> 29)) & mask
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == h and (row := self.rows[i])[0] == content:
                row[1] += n
                if (points, -doc, -number) > (row[2], -row[3], -row[4]):
                    row[2:] = points, doc, number
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.rows)
        self.hashes.append(h)
        self.rows.append([content, n, points, doc, number])
        self.bytes += len(content) + 200
        if 2 * len(self.rows) > len(self.slots):
            self.grow()

    def grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = np.full(mask + 1, -1, np.int64)
        for i, h in enumerate(self.hashes):
            at = (h ^ (h >> 29)) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def grace(records: Iterator[tuple], limit: int, level: int = 0, fan: int = 16) -> Iterator[list]:
    """The distinct contents of (h, content, n, points, doc) records, folded. Records beyond limit bytes of distinct
    contents go to spill files by the next hash bits, and each file is folded in turn. Past the last bits (equal 64-bit
    hashes, different contents) the table takes what comes."""
    table = ContentTable()
    for record in records:
        table.put(*record)
        if table.bytes > limit and level < 12:
            break
    else:
        yield from table.rows
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as d:
        files = [open(f"{d}/{k}", "wb") for k in range(fan)]  # noqa: SIM115
        shift = 60 - 4 * level

        def spill(h: int, *rest) -> None:
            pickle.dump((h, *rest), files[(h >> shift) % fan], protocol=5)

        for h, row in zip(table.hashes, table.rows, strict=True):
            spill(h, *row)
        del table
        for record in records:
            spill(*record)
        for f in files:
            f.close()
        for k in range(fan):
            with open(f"{d}/{k}", "rb") as f:
                yield from grace(_unpickled(f), limit, level + 1, fan)


def _unpickled(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _rows(batches) -> Iterator[tuple]:
    for docs, numbers, points, texts in batches_of(batches, ["doc", "row", "points", "content"]):
        for doc, number, p, text in zip(docs, numbers, points, texts, strict=True):
            yield doc, number, p, text.translate(None, SPACE)


def fold_local(limit: int):
    def run(batches):
        table = ContentTable()
        for doc, number, p, norm in _rows(batches):
            table.put(xxhash.xxh3_64_intdigest(norm), norm, 1, p, doc, number)
            if table.bytes > limit:
                yield from _parts(table)
                table = ContentTable()
        yield from _parts(table)

    return run


def _parts(table: ContentTable):
    names = ["content", "n", "points", "doc", "row"]
    for i in range(0, len(table.rows), 2000):
        h = np.array(table.hashes[i : i + 2000], np.uint64).view(np.int64)
        columns = [pa.array(c, pa.binary() if k == "content" else pa.int64()) for k, c in zip(names, zip(*table.rows[i : i + 2000], strict=True), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(h), *columns], ["h", *names])


def fold_global(limit: int):
    def run(batches):
        records = ((h % 2**64, *rest) for cols in batches_of(batches, ["h", "content", "n", "points", "doc", "row"]) for h, *rest in zip(*cols, strict=True))
        out: list = []

        def batch():
            sha, *rest = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(sha), *(pa.array(c, pa.int64()) for c in rest)], ["sha", "n", "keep", "keep_row"])

        for content, n, _, doc, number in grace(records, limit):
            out.append((hashlib.sha256(content).digest(), n, doc, number))
            if len(out) == 5000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return run


def _digest(batches):
    for docs, numbers, texts in batches_of(batches, ["doc", "row", "content"]):
        sha = [hashlib.sha256(t.translate(None, SPACE)).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(sha)], ["doc", "row", "sha"])


def _classed(docs: DataFrame, row: Column, combine_bytes: int, bucket_bytes: int) -> DataFrame:
    """(doc, row, sha, n, keep, keep_row) of each row: its class's size and the id and row number of the copy that stays.
    Classes are written as a table; those with many rows come by broadcast, so no task gets a large class whole."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), row.cast("long").alias("row"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("points"), utf8("text").alias("content"))
    parts = d.mapInArrow(fold_local(combine_bytes), _PART).repartition("h")
    classes = materialize(parts.mapInArrow(fold_global(bucket_bytes), "sha binary, n long, keep long, keep_row long").withColumn("rows", F.col("n")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return with_facts(d.mapInArrow(_digest, "doc long, row long, sha binary"), classes, ["sha"], total)


def exact_groups(docs: DataFrame, combine_bytes: int = 32 << 20, bucket_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal without white space; null counts as empty, so all null, empty and blank texts are one
    group. The row with the most code points stays, then the smallest doc_id; a null doc_id sorts last and comes back as
    null. Rows that repeat a doc_id count in group_size and are marked like each other. Other columns of docs are left
    out whatever their names; an empty table gives no rows. combine_bytes and bucket_bytes bound the memory of one task.
    """
    out = _classed(docs, F.lit(0), combine_bytes, bucket_bytes)
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("doc").alias("doc_id"), back("keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("doc") == F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, combine_bytes: int = 32 << 20, bucket_bytes: int = 64 << 20) -> DataFrame:
    """docs with one row of each group of equal texts: the one with the most code points, then the smallest doc_id (null
    last). Rows are told apart by a number of their own, so rows without a doc_id, of one doc_id and repeated rows count
    each for itself."""
    d, row = numbered_rows(docs)
    gone = _classed(d, F.col(row), combine_bytes, bucket_bytes).where("row <> keep_row").select(F.col("row").alias(row))
    return semi_by_size(d, materialize(gone, "copies"), row, "left_anti").select(*docs.columns)
