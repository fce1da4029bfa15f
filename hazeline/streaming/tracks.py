"""Linking detections to tracks: one state machine for a sequence, fed by sorted partitions or by a stream."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from hazeline.session import materialize, task_count

#: Least overlap, misses that a track survives, reach in sizes of its last box.
IOU, MISSES, FACTOR = 0.10, 2, 1.5
BOX = ["x1", "y1", "x2", "y2"]
OUT = "seq_id long, frame_index int, track_id long, det_id long, missed int"
Box = tuple[float, float, float, float]


def affinity(track: Box, box: Box) -> float:
    """1 + IoU where boxes overlap enough, else 1 - distance / limit within the limit of the track's size, else 0. The distance is
    written as in SQL: hypot() differs in the last bit, which decides between pairs that are alike."""
    ax1, ay1, ax2, ay2 = track
    bx1, by1, bx2, by2 = box
    size = max(ax2 - ax1, 0.0) * max(ay2 - ay1, 0.0)
    common = max(min(ax2, bx2) - max(ax1, bx1), 0.0) * max(min(ay2, by2) - max(ay1, by1), 0.0)
    union = size + max(bx2 - bx1, 0.0) * max(by2 - by1, 0.0) - common
    if union > 0 and common / union >= IOU:
        return 1 + common / union
    limit = FACTOR * max(math.sqrt(size), 1.0)
    far = math.sqrt(math.pow((ax1 + ax2 - bx1 - bx2) / 2, 2) + math.pow((ay1 + ay2 - by1 - by2) / 2, 2))
    return 1 - far / limit if far <= limit else 0.0


class Sequence:
    """Open tracks of one sequence, oldest first: id, last box, misses in a row."""

    def __init__(self, tracks: Iterable[tuple[int, Box, int]] = (), next_id: int = 0, last: int | None = None):
        self.tracks, self.next_id, self.last = [tuple(t) for t in tracks], next_id, last

    def frame(self, dets: list[tuple[int, Box]]) -> list[tuple[int, int | None, int]]:
        """(track, detection or none, misses) of every track that is open after a frame with these detections.

        The best pair of a free track and a free detection is taken until none has an affinity; of equal ones that of the
        later track, then of the later detection. A track ends at its third miss in a row."""
        ranked = sorted((-a, -i, -j) for i, (_, box, _) in enumerate(self.tracks) for j, (_, own) in enumerate(dets) if (a := affinity(box, own)) > 0)
        chosen: dict[int, int] = {}
        free = set(range(len(dets)))
        for _, i, j in ranked:
            if -j in free and -i not in chosen:
                chosen[-i] = -j
                free.discard(-j)
        old = [(t, dets[chosen[i]][1], 0, dets[chosen[i]][0]) if i in chosen else (t, box, misses + 1, None) for i, (t, box, misses) in enumerate(self.tracks)]
        new = [(self.next_id + k, dets[j][1], 0, dets[j][0]) for k, j in enumerate(sorted(free))]
        self.next_id += len(new)
        now = [x for x in old if x[2] <= MISSES] + new
        self.tracks = [(t, box, misses) for t, box, misses, _ in now]
        return [(t, det, misses) for t, _, misses, det in now]

    def upto(self, frame: int, dets: list[tuple[int, Box]]) -> list[tuple[int, int, int | None, int]]:
        """Rows with their frame, for the frames without detections since the last one and then for this one."""
        rows = []
        for gap in range(frame if self.last is None else self.last + 1, frame):
            if not self.tracks:
                break
            rows += [(gap, *r) for r in self.frame([])]
        self.last = frame
        return rows + [(frame, *r) for r in self.frame(dets)]


    def ended(self) -> list[tuple[int, int, int | None, int]]:
        """Rows of the frames after the last one until no track is open."""
        rows, frame = [], self.last
        while self.tracks:
            frame += 1
            rows += [(frame, *r) for r in self.frame([])]
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    s, run, f, t, d, m = zip(*rows, strict=True)
    types = {"seq_id": pa.int64(), "run": pa.int32(), "frame_index": pa.int32(), "track_id": pa.int64(), "det_id": pa.int64(), "missed": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip((s, run, f, t, d, m), types.values(), strict=True)], list(types))


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by sequence, run, frame and detection: only the open tracks and one frame are held."""
    key = frame = state = end = None
    dets: list[tuple[int, Box]] = []
    rows: list[tuple] = []

    def close(over: bool) -> None:
        if dets:
            rows.extend((*key, *r) for r in state.upto(frame, dets))
            if over and frame < end:
                rows.extend((*key, *r) for r in state.ended())

    for b in batches:
        for s, run, until, f, d, *box in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (s, run) != key or f != frame:
                close((s, run) != key)
                if (s, run) != key:
                    state = Sequence()
                key, frame, end, dets = (s, run), f, until, []
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows.clear()
            dets.append((d, tuple(box)))
    close(True)
    if rows:
        yield _batch(rows)


def runs(d: DataFrame, block: int = 1024) -> DataFrame:
    """(seq_id, frame_index, run, end) of each frame of d that has detections: the first frame of its run and the last frame of
    its sequence. A run starts where none of the frames before it that a track survives has a detection: no track reaches over
    that, so runs are independent. Starts are an anti-join on (sequence, frame); the latest of them is a maximum within blocks
    of frames and over one row a block, so no task gets all frames of a long sequence."""
    key = ["seq_id", "frame_index"]
    frames = materialize(d.select(*key).distinct(), "frames")
    reached = frames.select("seq_id", F.explode(F.sequence(F.col("frame_index") + 1, F.col("frame_index") + MISSES + 1)).alias("frame_index")).distinct()
    starts = frames.join(reached, key, "left_anti").withColumn("start", F.col("frame_index"))
    x = frames.join(starts, key, "left").withColumn("block", F.floor(F.col("frame_index") / block).cast("int"))
    x = materialize(x, "run-starts")
    own = Window.partitionBy("seq_id", "block").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    blocks = x.groupBy("seq_id", "block").agg(F.max("start").alias("start"), F.max("frame_index").alias("last"))
    every = Window.partitionBy("seq_id")
    before = every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("seq_id", "block", F.max("start").over(before).alias("_start"), F.max("last").over(every).alias("end"))
    x = x.withColumn("run", F.max("start").over(own)).join(blocks, ["seq_id", "block"])
    return x.select(*key, F.coalesce("run", "_start").alias("run"), "end")


def linked(d: DataFrame, few: int = 100_000) -> DataFrame:
    """Batch replay of d(seq_id, frame_index, det_id, x1, y1, x2, y2): one row for every open track at every frame of its
    sequence, det_id null where it misses. A run of frames is one task's work, since every frame needs the one before, and
    streams through it; a sequence is cut where no track can go on (see runs), and its track ids follow from the number of
    tracks in the runs before. Those counts are broadcast if there are at most `few`."""
    columns = d.select(F.col("seq_id").cast("long"), F.col("frame_index").cast("int"), F.col("det_id").cast("long"), *(F.col(c).cast("double") for c in BOX))
    order = ["seq_id", "run", "frame_index", "det_id"]
    x = columns.join(runs(columns), ["seq_id", "frame_index"]).select("seq_id", "run", "end", "frame_index", "det_id", *BOX)
    links = x.repartition(task_count(d.sparkSession), "seq_id", "run").sortWithinPartitions(*order).mapInArrow(_replay, "seq_id long, run int, frame_index int, track_id long, det_id long, missed int")
    links = materialize(links, "links")
    made = links.groupBy("seq_id", "run").agg((F.max("track_id") + 1).alias("made"))
    before = Window.partitionBy("seq_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    later = materialize(made.select("seq_id", "run", F.sum("made").over(before).alias("before")).where("before > 0"), "link-runs")
    out = links.join(F.broadcast(later) if later.count() <= few else later, ["seq_id", "run"], "left")
    return out.select("seq_id", "frame_index", (F.col("track_id") + F.coalesce("before", F.lit(0))).alias("track_id"), "det_id", "missed")


def all_tracks(links: DataFrame) -> DataFrame:
    """(seq_id, track_id, hits, first_frame, last_frame, frame_span, finished): every track of linked rows, ended or open at
    the end of its sequence."""
    end = F.max("frame_index").over(Window.partitionBy("seq_id"))
    seen = F.col("det_id").isNotNull()
    x = links.withColumn("end", end).groupBy("seq_id", "track_id").agg(
        F.count_if(seen).alias("hits"), F.min("frame_index").alias("first_frame"), F.max(F.when(seen, F.col("frame_index"))).alias("last_frame"), (F.max("end") > F.max("frame_index")).alias("finished")
    )
    return x.withColumn("frame_span", F.col("last_frame") - F.col("first_frame") + 1)


STREAM = OUT + ", status string"


def linked_stream(d: DataFrame, lateness: int = 1, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream, with a status. Frames wait until one `lateness` frames later is seen, so that a frame split over
    micro-batches is linked whole; a detection of a frame that has been linked comes out once, as status late, without a
    track. A row with a null frame_index closes its sequence, as does idle_ms without rows, if given: what waits is linked and
    the state goes. With idle_ms the query runs batches for ever, so availableNow doesn't end."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, waiting = Sequence(), []
        if state.exists:
            tracks, next_id, last, held = state.get
            sequence, waiting = Sequence(json.loads(tracks), next_id, last), [tuple(w) for w in json.loads(held)]
        rows, closing = [], state.hasTimedOut
        for pdf in frames:
            for f, det, *box in pdf[["frame_index", "det_id", *BOX]].itertuples(index=False, name=None):
                if f is None or f != f:
                    closing = True
                elif sequence.last is not None and f <= sequence.last:
                    rows.append((key[0], int(f), None, int(det), 0, "late"))
                else:
                    waiting.append((int(f), int(det), *map(float, box)))
        horizon = max((w[0] for w in waiting), default=0) - (0 if closing else lateness)
        ready: dict[int, list] = {}
        for f, det, *box in sorted(w for w in waiting if w[0] <= horizon):
            ready.setdefault(f, []).append((det, tuple(box)))
        for f, dets in ready.items():
            rows += [(key[0], *r, "linked") for r in sequence.upto(f, dets)]
        if closing:
            state.remove()
        else:
            state.update((json.dumps(sequence.tracks), sequence.next_id, sequence.last, json.dumps([w for w in waiting if w[0] > horizon])))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        s, f, t, det, m, status = zip(*rows, strict=True) if rows else ((),) * 6
        yield pd.DataFrame({"seq_id": pd.array(s, "int64"), "frame_index": pd.array(f, "int32"), "track_id": pd.array(t, "Int64"), "det_id": pd.array(det, "Int64"), "missed": pd.array(m, "int32"), "status": pd.array(status, "object")})

    columns = d.select("seq_id", "frame_index", "det_id", *BOX)
    return columns.groupBy("seq_id").applyInPandasWithState(update, STREAM, "tracks string, next_id long, last int, waiting string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
