"""The run as a stream: detections to linked tracks, features so far, verdicts and events.

State is of constant size for each open track: its last box and detection, its misses, and running sums from which the least
squares slopes and means follow. Detections wait until the watermark has passed their frame, so a frame that is split over
micro-batches is linked whole; a frame without detections may come as a row of its own, with null det_id. What a track's
sums don't hold (place, box and confidence of its last detection) rides along. Criteria, score, tier and event are columns on
what comes out, the same as in a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hazeline.plans import run
from hazeline.streaming.tracks import BOX, Sequence

#: Columns of a detection's place, null where it has none.
FIX = {"depression": "double", "reason": "string", "lat": "double", "lon": "double", "elevation_m": "double", "range_m": "double", "cep50_m": "double", "cep90_m": "double"}
_DETECTION = {"det_id": "long", "offset_s": "double", **dict.fromkeys(BOX, "double"), "confidence": "double", **FIX}
#: Optional columns of a detection: flow statistics, and brightness and softness of its image patch.
_MORE = ["divergence", "upward_ratio", "translation_mag", "brightness", "softness"]
_SERIES = ["log_area", "cx", "cy", "aspect", "confidence"]
_DTYPES = {"long": "Int64", "int": "Int32", "double": "Float64", "string": "object", "boolean": "boolean"}
#: The state store that keeps the state of transformWithState.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sums:
    """Running sums of one track, a list of 38 numbers whatever its length."""

    def __init__(self, values: list[float] | None = None):
        self.v = values or [0.0] * 38

    def add(self, t: float, box: tuple, confidence: float, more: dict[str, float | None]) -> None:
        x1, y1, x2, y2 = box
        area, aspect = max((x2 - x1) * (y2 - y1), 1.0), math.log(max(y2 - y1, 1.0) / max(x2 - x1, 1.0))
        ys = (math.log(area), (x1 + x2) / 2, (y1 + y2) / 2, aspect, confidence)
        v = self.v
        if v[0] == 0:
            v[1] = t
            v[9:24:3] = ys
        v[6] += v[0] > 0 and area > v[5]
        d = t - v[1]
        v[0], v[2], v[3], v[4], v[5] = v[0] + 1, max(t, v[2]) if v[0] else t, v[3] + d, v[4] + d * d, area
        v[7], v[8] = v[7] + math.sqrt(area), v[8] + confidence
        for k, y in enumerate(ys):
            v[10 + 3 * k] += y - v[9 + 3 * k]
            v[11 + 3 * k] += d * (y - v[9 + 3 * k])
        flow = [more.get(c) for c in _MORE[:3]]
        if any(f is not None for f in flow):
            v[24] += 1
            for k, f in enumerate(flow):
                v[25 + k] += f or 0.0
        if more.get("brightness") is not None:
            if v[28] == 0:
                v[31] = more["brightness"]
            b = more["brightness"] - v[31]
            v[28], v[29], v[30] = v[28] + 1, v[29] + b, v[30] + b * b
            v[32], v[33:38] = min(5.0, v[32] + 1), [*v[34:38], more.get("softness") or 0.0]

    def features(self, interval: float) -> dict[str, float]:
        """The figures of rules.features, flow_features and appearance for what has been added."""
        v = self.v
        n, span = v[0], v[2] - v[1]
        spread = v[4] - v[3] * v[3] / n
        slope = dict.fromkeys(_SERIES, 0.0)
        if n >= 2 and spread >= 1e-12:
            slope = {s: (v[11 + 3 * k] - v[3] * v[10 + 3 * k] / n) / spread for k, s in enumerate(_SERIES)}
        scale = max(v[7] / n, 1.0)
        mean = v[31] + v[29] / v[28] if v[28] else 0.0
        deviation = math.sqrt(max(0.0, v[30] / v[28] - (v[29] / v[28]) ** 2)) if v[28] else 0.0
        seen = int(v[32])
        return {
            "n": int(n), "duration": span, "persistence": min(1.0, n / max(1.0, span / max(interval, 1e-6) + 1)),
            "area_growth_rate": slope["log_area"], "area_monotonicity": v[6] / (n - 1) if n >= 2 else 0.0, "centroid_rise_rate": -slope["cy"] / scale, "drift_rate": abs(slope["cx"]) / scale,
            "translation_over_growth": math.hypot(slope["cx"], slope["cy"]) / scale / (abs(slope["log_area"]) + 1e-3) if n >= 2 else 0.0, "aspect_growth_rate": slope["aspect"],
            "confidence_mean": v[8] / n, "confidence_slope": slope["confidence"],
            "flow_divergence": v[25] / v[24] if v[24] else 0.0, "flow_upward_ratio": v[26] / v[24] if v[24] else 0.0, "flow_translation_mag": v[27] / v[24] if v[24] else 0.0,
            "intensity_flicker": deviation / mean if v[28] >= 2 and mean > 1e-6 else 0.0, "edge_softness": sum(v[38 - seen : 38]) / seen if seen else 0.0,
        }


_FEATURES = {"n": "long", **{f: "double" for f in [*run._FEATURES, "flow_divergence", "flow_upward_ratio", "flow_translation_mag", "intensity_flicker", "edge_softness"] if f != "n"}}
_OUT = {"seq_id": "long", "frame_index": "int", "track_id": "long", "missed": "int", **_DETECTION, **_FEATURES}
_ddl = lambda columns: ", ".join(f"{c} {t}" for c, t in columns.items())


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.array([r[c] for r in rows], _DTYPES[t]) for c, t in _OUT.items()})


class Judge(StatefulProcessor):
    """Of one sequence: how far it has been linked, its open tracks, and the detections of frames that may still get more."""

    def __init__(self, interval: float, forget_s: float):
        self.interval, self.forget_ms = interval, int(1000 * forget_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "next_id long, last int, forget long")
        self.tracks = handle.getMapState("tracks", "track_id long", f"box array<double>, misses int, sums array<double>, {_ddl(_DETECTION)}")
        self.waiting = handle.getListState("waiting", f"at long, frame_index int, {_ddl(_DETECTION)}, {_ddl(dict.fromkeys(_MORE, 'double'))}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, names = [], ["frame_index", *_DETECTION, *_MORE]
        for pdf in rows:
            at = (pdf["at"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            columns = [[None if v is None or v != v else v for v in pdf[c].tolist()] if c in pdf else [None] * len(at) for c in names]
            held += [(a, int(f), None if d is None else int(d), *rest) for a, f, d, *rest in zip(at, *columns, strict=True)]
        if held:
            self.waiting.appendList(held)
            next_id, last, forget = self.clock.get() or (0, None, None)
            for at in {r[0] for r in held}:
                self.handle.registerTimer(at)
            until = max(r[0] for r in held) + self.forget_ms
            if forget is None or until > forget:
                if forget is not None:
                    self.handle.deleteTimer(forget)
                self.handle.registerTimer(until)
                self.clock.update((next_id, last, until))
        yield _frame([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        next_id, last, forget = self.clock.get() or (0, None, None)
        waiting = list(self.waiting.get())
        ready = sorted((r for r in waiting if r[0] <= now and (last is None or r[1] > last)), key=lambda r: (r[1], r[2] is None, r[2]))
        if ready:
            yield _frame(self._linked(int(key[0]), ready, next_id, last, forget))
        else:
            yield _frame([])
        rest = [tuple(r) for r in waiting if r[0] > now]
        if len(rest) < len(waiting):
            self.waiting.put(rest) if rest else self.waiting.clear()
        if now == forget and not rest:
            self.tracks.clear()
            self.clock.clear()

    def _linked(self, seq: int, ready: list, next_id: int, last: int | None, forget: int | None) -> list[dict]:
        state = {int(k[0]): v for k, v in self.tracks.iterator()}
        sequence = Sequence([(t, tuple(state[t][0]), state[t][1]) for t in sorted(state)], next_id, last)
        held = {t: (Sums(list(v[2])), dict(zip(_DETECTION, v[3:], strict=True))) for t, v in state.items()}
        frames: dict[int, list] = {}
        for r in ready:
            frames.setdefault(r[1], []).append(r)
        out = []
        for frame, found in frames.items():
            seen = {r[2]: r for r in found if r[2] is not None}
            dets = [(d, tuple(r[4:8])) for d, r in seen.items()]
            for f, track, det, missed in sequence.upto(frame, dets):
                if det is not None:
                    own = dict(zip([*_DETECTION, *_MORE], seen[det][2:], strict=True))
                    sums = held[track][0] if track in held else Sums()
                    sums.add(own["offset_s"], tuple(own[c] for c in BOX), own["confidence"], own)
                    held[track] = (sums, {c: own[c] for c in _DETECTION})
                sums, carried = held[track]
                out.append({"seq_id": seq, "frame_index": f, "track_id": track, "missed": missed, **carried, **sums.features(self.interval)})
        for t, box, misses in sequence.tracks:
            self.tracks.updateValue((t,), ([float(b) for b in box], misses, held[t][0].v, *held[t][1].values()))
        for t in state.keys() - {t for t, *_ in sequence.tracks}:
            self.tracks.removeKey((t,))
        self.clock.update((sequence.next_id, sequence.last, forget))
        return out

    def close(self) -> None:
        pass


def tracked_stream(d: DataFrame, interval: float = 60.0, delay: str = "60 seconds", forget_s: float = 86_400.0) -> DataFrame:
    """A row for every open track at every frame, with the features of its detections so far and the place of the last one.

    d is a stream of (seq_id, frame_index, det_id, offset_s, box, confidence, columns of FIX, and at: the frame's event time),
    with flow statistics, brightness and softness if there are any. A frame is linked when the watermark, `delay` behind the
    latest event time, has passed it; later rows are dropped by the watermark. A sequence without rows for forget_s of event
    time is over: its state goes, and tracks of that name start anew. Needs the ROCKSDB state store.
    """
    columns = ["seq_id", "frame_index", *_DETECTION, *(c for c in _MORE if c in d.columns), "at"]
    marked = d.select(*columns).withWatermark("at", delay)
    return marked.groupBy("seq_id").transformWithStateInPandas(Judge(interval, forget_s), _ddl(_OUT), "append", "eventTime")


def verdicts_stream(d: DataFrame, interval: float = 60.0, mode: str = "sparse", weights: dict[str, float] | None = None, delay: str = "60 seconds", forget_s: float = 86_400.0) -> DataFrame:
    """The rows of run.verdicts over a stream; see tracked_stream."""
    x = tracked_stream(d, interval, delay, forget_s)
    patches = "brightness" in d.columns
    drop = [c for c, there in (("flow_divergence", mode == "dense"), ("flow_upward_ratio", mode == "dense"), ("flow_translation_mag", mode == "dense"), ("intensity_flicker", patches), ("edge_softness", patches)) if not there]
    return run.judged(x.drop(*drop), mode, weights, patches)


