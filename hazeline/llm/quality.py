"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)); the last term is every pairwise
interaction at rank f, in time linear in the number of features.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import NO_ID, batches_of, utf8

HASHED, RANK = 1 << 13, 8
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"!", b"|", b"#$%&*@^~", b".", b",", b"?;:\"'()", b"<>{}[]\\/=_+`", bytes(range(128, 256))]
_SHARE = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES):
    _SHARE[list(_c), _k] = 1
STATS = len(_CLASSES) + 8
DIM = HASHED + STATS


class WordCells(dict):
    """Cell of each word; bounded as WordHashes is."""

    def __missing__(self, w: bytes) -> int:
        cell = xxhash.xxh3_64_intdigest(w) % HASHED
        if len(w) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[w] = cell
        return cell


def features(text: bytes, cells: WordCells) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values: words by damped counts of unit length, then the statistics."""
    words = text.split()
    counts = Counter(words)
    n, distinct = len(words), len(counts)
    idx = np.fromiter(map(cells.__getitem__, counts), np.int64, distinct)
    val = np.log1p(np.fromiter(counts.values(), float, distinct))
    norm = np.sqrt((val * val).sum()) or 1.0
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _SHARE / max(1, len(text))
    lines = text.split(b"\n")
    top = max(counts.values(), default=0)
    stats = np.concatenate([
        np.sqrt(share),
        [
            np.log1p(len(text)) / 10, np.log1p(n) / 10, np.log1p(len(lines)) / 10, distinct / max(1, n), top / max(1, n),
            len(set(lines)) / len(lines), min(len(text) / max(1, n), 40) / 10, float(n == 0),
        ],
    ])
    return np.concatenate([idx, np.arange(HASHED, DIM)]), np.concatenate([val / norm, stats])


class Machine:
    """Parameters; without usable labels every score is 0.5."""

    def __init__(self):
        self.w0, self.w, self.v = 0.0, np.zeros(DIM), np.zeros((DIM, RANK))

    def logit(self, idx: np.ndarray, val: np.ndarray) -> float:
        x = self.v[idx] * val[:, None]
        s = x.sum(axis=0)
        return float(self.w0 + self.w[idx] @ val + 0.5 * (s @ s - (x * x).sum()))

    def score(self, text: bytes, cells: WordCells) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(*features(text, cells)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on log loss with weight decay; the same rows in the same order give the same machine."""
    m = Machine()
    if len(rows) == 0 or labels.min() == labels.max():
        return m
    rng = np.random.default_rng(seed)
    m.w0 = float(np.log(labels.mean() / (1 - labels.mean())))
    m.v = rng.normal(0, 0.02, (DIM, RANK))
    theta = np.concatenate([m.w[:, None], m.v], axis=1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), batch):
            own = order[b : b + batch]
            sizes = np.array([len(rows[i][0]) for i in own])
            idx, val = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
            at = np.cumsum(sizes) - sizes
            who = np.repeat(np.arange(len(own)), sizes)
            x = theta[idx] * val[:, None]
            s = np.add.reduceat(x, at)
            out = m.w0 + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(1) - np.add.reduceat((x[:, 1:] ** 2).sum(1), at))
            err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[own]) / len(own)
            g = np.empty_like(x)
            g[:, 0] = val
            g[:, 1:] = val[:, None] * (s[who, 1:] - x[:, 1:])
            g *= err[who][:, None]
            cells, back = np.unique(idx, return_inverse=True)
            total = np.zeros((len(cells), 1 + RANK))
            np.add.at(total, back, g)
            total += decay * theta[cells]
            step += 1
            first[cells] = 0.9 * first[cells] + 0.1 * total
            second[cells] = 0.99 * second[cells] + 0.01 * total**2
            theta[cells] -= rate * (first[cells] / (1 - 0.9**step)) / (np.sqrt(second[cells] / (1 - 0.99**step)) + 1e-8)
            m.w0 -= rate * float(err.sum())
    m.w, m.v = theta[:, 0].copy(), theta[:, 1:].copy()
    return m


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no classifier may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _featurize(batches):
    cells = WordCells()
    for docs, labels, texts in batches_of(batches, ["doc", "label", "content"]):
        found = [features(t, cells) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(labels, pa.int32()), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["doc", "label", "idx", "val"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000) -> Machine:
    """A machine fitted on at most sample labelled rows that aren't held out, those with the smallest hashes of their ids.

    Only the features of the sample reach the driver. Rows without an id or a label are left out."""
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc"), F.col(label).cast("int").alias("label")).dropDuplicates(["doc"])
    own = own.orderBy(F.xxhash64("doc"), "doc").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), utf8("text").alias("content")).join(F.broadcast(own), "doc").select("doc", "label", "content").mapInArrow(_featurize, "doc long, label int, idx binary, val binary")
    got = sorted((r["doc"], r["label"], bytes(r["idx"]), bytes(r["val"])) for r in rows.toLocalIterator())
    return fit([(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float)) for _, _, i, v in got], np.array([g[1] for g in got], float))


def _score(machine):
    def run(batches):
        cells, m = WordCells(), machine.value
        for docs, texts in batches_of(batches, ["doc", "content"]):
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([m.score(t, cells) for t in texts], pa.float64())], ["doc", "score"])

    return run


def scored(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score, predicted (1 from the threshold on).

    The whole text is scored; null counts as empty, which has a score of its own. A null doc_id comes back as null and
    isn't held out; rows that repeat score alike. Other columns are left out whatever their names; an empty table gives
    no rows."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), utf8("text").alias("content"))
    out = d.mapInArrow(_score(spark.sparkContext.broadcast(machine)), "doc long, score double").withColumn("doc_id", F.when(F.col("doc") != NO_ID, F.col("doc")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _judge(machine, threshold: float, schema):
    def run(batches):
        cells, m = WordCells(), machine.value
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
            yield b.filter(pa.array([m.score(t or b"", cells) >= threshold for t in texts], pa.bool_()))

    return run


def keep_good(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """docs without those that the machine scores below the threshold, with all their columns."""
    return docs.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(machine), threshold, docs.schema), docs.schema)
