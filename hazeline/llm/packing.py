"""Packing into optimal length buckets.

A dynamic programme over the global length histogram chooses the bucket boundaries that minimise padding; inside a bucket
documents are numbered and cut into batches whose padded size stays within a token budget.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hazeline.session import materialize

def word_count(text: str = "text") -> Column:
    """Words between white space; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def histogram(lengths: DataFrame) -> list[tuple[int, int]]:
    """(length, documents) of every length that occurs, ascending; lengths has the column n_tokens. It holds one row a
    distinct length, so at most as many as the longest document has tokens, and at most the root of twice all tokens."""
    rows = lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))
    return sorted((r["n_tokens"], r["docs"]) for r in rows.toLocalIterator())


def boundaries(hist: list[tuple[int, int]], buckets: int) -> list[int]:
    """Bucket lengths, ascending, with the least total padding; at most that many, fewer when fewer do as well.

    Padding and tokens together are the sum of bucket length times documents, so best[k][j], the least for the first j
    lengths in k buckets, is the minimum over i of best[k-1][i] + length[j] * (docs[j] - docs[i]). For each i that is a line
    in length[j] with slope -docs[i]. Slopes fall and lengths rise, so the lower hull of the lines is walked once: a layer
    takes time in proportion to the number of lengths, in exact whole numbers.
    """
    if not hist:
        return []
    n = len(hist)
    top, docs = [0, *(h[0] for h in hist)], [0]
    for _, count in hist:
        docs.append(docs[-1] + count)
    best: list[int | None] = [0] + [None] * n
    came = []
    for _ in range(min(buckets, n)):
        new, back = best[:], [-1] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope, value at length 0, i
        at = 0
        for j in range(1, n + 1):
            if (before := best[j - 1]) is not None:
                m, c = -docs[j - 1], before
                # the line in the middle goes when the new one undercuts it before it undercuts the one before
                while len(hull) >= 2 and (c - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, c, j - 1))
            at = min(at, len(hull) - 1)
            if hull:
                x = top[j]
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                    at += 1
                cost = hull[at][0] * x + hull[at][1] + x * docs[j]
                if new[j] is None or cost < new[j]:
                    new[j], back[j] = cost, hull[at][2]
        best = new
        came.append(back)
    out, j = [], n
    for back in reversed(came):
        if back[j] >= 0:
            out.append(top[j])
            j = back[j]
        if j == 0:
            break
    return out[::-1]


def packed(docs: DataFrame, buckets: int = 8, token_budget: int = 65_536, tokens: Column | None = None, shard_rows: int = 4096) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_tokens, bucket, bucket_len, batch, slot.

    tokens counts a document's tokens; words between white space by default. bucket_len is the padded length; a batch
    holds as many documents as fit the budget at that length, and one where a single document exceeds it. Only the last
    batch of a bucket is short. Null and empty texts have 0 tokens and pack like any length. Ties in length are numbered
    in doc_id order, null first; rows that repeat are packed as often as they occur. Other columns are left out whatever
    their names; an empty table gives no rows.

    Numbers within a bucket come in two steps, so that a bucket with a third of all rows isn't ordered in one task: rows
    are dealt to shards of about shard_rows by a hash of id and length (of row number where there is no id), ordered there, and start at the sum of the shards before.
    """
    n = (word_count() if tokens is None else tokens).cast("long")
    lengths = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "lengths")
    hist = histogram(lengths)
    ends = boundaries(hist, buckets)
    if not ends:
        return lengths.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_len"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    counts = [0] * len(ends)
    for length, docs_ in hist:
        counts[bisect_left(ends, length)] += docs_
    bucket = F.lit(len(ends) - 1)
    for k in reversed(range(len(ends) - 1)):
        bucket = F.when(F.col("n_tokens") <= ends[k], k).otherwise(bucket)
    pick = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("bucket") + 1)
    shards = [max(1, -(-c // shard_rows)) for c in counts]
    x = lengths.withColumn("bucket", bucket.cast(T.IntegerType())).withColumn("shard", F.pmod(F.xxhash64(F.coalesce("doc_id", "row"), "n_tokens"), pick(shards)))
    sizes = x.groupBy("bucket", "shard").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("start"))
    x = x.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("n_tokens", "doc_id")).cast("long") - 1)
    x = x.join(starts, ["bucket", "shard"]).withColumn("index", F.col("start") + F.col("at"))
    fit = pick([max(1, token_budget // max(1, e)) for e in ends])
    return x.select("doc_id", "n_tokens", "bucket", pick(ends).alias("bucket_len"), F.floor(F.col("index") / fit).cast("long").alias("batch"), F.pmod(F.col("index"), fit).alias("slot"))
