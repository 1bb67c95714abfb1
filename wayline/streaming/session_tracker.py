"""The session tracker on Structured Streaming.

One keyed stream carries ticks and commands (``schemas.SESSION_INPUT``). Per tick
the order is: stale-source check, gate, median, zone lock, motion filter, shown
distance. The steps are those of ``operators.tracker``; nothing is re-stated here.
Event-time timers announce lost tracks and expired zone grace when no data comes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayline import schemas
from wayline.functions.zones import zones_match_local
from wayline.operators.tracker import (FilterState, GateState, Tuning, filter_step, gate_step,
                                       nullable_list)
from wayline.operators.tracks import COMMANDS, FLIP_DEG, GRACE_S, RECOVER_S, UNAVAILABLE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Session:
    gate: GateState = field(default_factory=GateState)
    motion: FilterState = field(default_factory=FilterState)
    target: dict | None = None
    epoch: int = 0
    t_set: float | None = None
    locked: bool = False
    source_epoch: int = 0
    t: float = 0.0
    wall_ms: int | None = None
    shown: str = "LOST"
    was_in_zone: bool = False
    heading: float | None = None
    unsteady_until: float | None = None

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> Session:
        raw = json.loads(text)
        gate = GateState(**raw.pop("gate"))
        gate.at = tuple(gate.at) if gate.at else None
        gate.reads = [tuple(p) for p in gate.reads]
        motion = FilterState(**raw.pop("motion"))
        motion.cov, motion.offsets = tuple(motion.cov), tuple(motion.offsets) if motion.offsets else None
        return cls(gate=gate, motion=motion, **raw)


def in_zone(s: Session, t: float, grace_s: float) -> bool:
    if s.target is None:
        return False
    if s.target["ooc"] is None or s.locked:
        return True
    return t - s.t_set <= grace_s


def command(s: Session, row: dict) -> None:
    """Apply a set, clear, reset or source command."""
    event, t = row["event"], row["t_capture"]
    s.was_in_zone = False  # until the next tick says otherwise
    if event in ("source", "reset"):
        s.heading = s.unsteady_until = None
        s.shown = "LOST"
    if event == "source":
        s.gate, s.motion = GateState(), FilterState(epoch=s.motion.epoch)
        s.source_epoch, s.locked = int(row["source_epoch"]), False
        s.t_set = t if s.target is not None else None
        return
    s.epoch += 1
    s.locked, s.t_set, s.target = False, None, None
    if event == "set":
        s.target = {"name": row["t_name"], "at": (row["tx"], row["ty"], row["tz"]), "ooc": row["t_ooc"], "kind": row["kind"]}
        s.t_set = t
    elif event == "reset":
        s.motion.clear_motion()


def steady(s: Session, t: float, heading: float | None) -> bool:
    """False for a while after a large swing between headings, as ``tracks.heading_confidence``."""
    if heading is not None:
        if s.heading is not None and abs((heading - s.heading + 180.0) % 360.0 - 180.0) > FLIP_DEG:
            s.unsteady_until = t + RECOVER_S
        s.heading = heading
    return s.unsteady_until is None or t >= s.unsteady_until


def tick(s: Session, row: dict, tuning: Tuning, grace_s: float) -> dict | None:
    """One tick; None when it was captured under an earlier source, or not at all."""
    if row["error"] == UNAVAILABLE or int(row["source_epoch"] or 0) != s.source_epoch:
        return None
    t, zone = row["t_capture"], row["ooc"]
    failed = bool(row["error"])
    fix = None if failed or row["x"] is None else (row["x"], row["y"], row["z"])
    reason, smoothed, zone_reset = gate_step(s.gate, t, fix, zone, tuning)
    if smoothed is not None and s.target is not None and not s.locked:
        s.locked = zones_match_local(zone, s.target["ooc"])
    inside = in_zone(s, t, grace_s)
    target = s.target["at"] if s.target else None
    took, px, py, pz, vx, vy, vz, speed, moving, age, state, dist, yaw, pitch, heading = filter_step(
        s.motion, t, smoothed, zone_reset, target, s.target["kind"] if s.target else None, inside, s.epoch, tuning)
    s.t, s.shown, s.was_in_zone = t, state, inside
    status = "no_read" if fix is None else "rejected" if reason else "ok"
    why = "ocr_error" if failed else "no_coords" if fix is None else "implausible_velocity" if reason else None
    return {"event": "tick", "t_capture": t, "seq": row["seq"], "status": status, "reason": why,
            "x": row["x"], "y": row["y"], "z": row["z"], "ooc": zone,
            "target": s.target["name"] if s.target else None, "in_zone": inside, "measured": took,
            "px": px, "py": py, "pz": pz, "vx": vx, "vy": vy, "vz": vz, "speed_km_s": speed, "moving": moving,
            "coast_age_s": age, "integrity": state, "dist_km": dist, "yaw_off": yaw, "pitch_off": pitch, "confident": steady(s, t, heading),
            "coord_age_s": s.gate.read_age(t), "location": row["location"], "ts": row["ts"]}


def notice(s: Session, event: str, **values) -> dict:
    """A row that reports a change no tick brought."""
    base = {f.name: None for f in schemas.SESSION_OUTPUT.fields if f.name != "sid"}
    return {**base, "event": event, "t_capture": s.t, "target": s.target["name"] if s.target else None, **values}


def column(kind: str, values: list) -> pd.Series | np.ndarray:
    """The values of one column, of its Spark type; None is null."""
    if kind == "double":
        return np.array([np.nan if v is None else v for v in values], np.float64)
    if kind == "boolean":
        return pd.array(values, dtype="boolean")
    if kind == "long":
        return pd.array(values, dtype="Int64")
    return pd.to_datetime(pd.Series(values)) if kind == "timestamp" else pd.Series(values, dtype=object)


#: Columns of the output without the key, and their types.
KINDS = {f.name: f.dataType.typeName() for f in schemas.SESSION_OUTPUT.fields if f.name != "sid"}


def frame(sid, rows: list[dict]) -> pd.DataFrame:
    """Rows of one key. Made of whole columns, as a session has few rows and a conversion costs more than its values."""
    return pd.DataFrame({"sid": [sid] * len(rows)} | {name: column(kind, [r[name] for r in rows]) for name, kind in KINDS.items()}, copy=False)


RANK = {e: k for k, e in enumerate(COMMANDS)}


def in_order(row: dict) -> tuple:
    """By capture time, commands before ticks, then by number; what is missing comes last."""
    t, seq = row["t_capture"], row["seq"]
    return t is None, t or 0.0, RANK.get(row["event"], len(COMMANDS)), seq is None, seq or 0


class SessionTracker(StatefulProcessor):
    def __init__(self, tuning: Tuning = Tuning(), grace_s: float = GRACE_S):
        self.tuning, self.grace_s = tuning.bounded(), grace_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "body string")

    def _session(self) -> Session:
        return Session.load(self.state.get()[0]) if self.state.exists() else Session()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One key's rows of one micro-batch; the trigger's rate limit bounds them.
        batch = [dict(zip(part.columns, values)) for part in rows for values in zip(*[nullable_list(part[c]) for c in part.columns])]
        batch.sort(key=in_order)
        known = self.state.exists()
        s, out = self._session() if known else Session(), []
        for row in batch:
            if row["event"] != "tick":
                command(s, row)
                continue
            result = tick(s, row, self.tuning, self.grace_s)
            if result is not None:
                out.append(result)
            if row["ts"] is not None:
                s.wall_ms = max(s.wall_ms or 0, int(pd.Timestamp(row["ts"]).value // 1_000_000))
        self._schedule(s, known)
        self.state.update((s.dump(),))
        if out:
            yield frame(key[0], out)

    def _schedule(self, s: Session, known: bool) -> None:
        """Wake up when the track goes stale and when the zone grace ends. A session not known before has no timers yet."""
        for timer in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(timer)
        if s.wall_ms is None:
            return
        if s.shown != "LOST":
            left = self.tuning.coast_s - (s.motion.coast_age or 0.0)
            self.handle.registerTimer(s.wall_ms + int(left * 1000) + 1)
        if s.was_in_zone and not s.locked and s.target is not None and s.target["ooc"] is not None:
            self.handle.registerTimer(s.wall_ms + int((s.t_set + self.grace_s - s.t) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = self._session(), []
        at_ms = expiredTimerInfo.getExpiryTimeInMs()
        waited = (at_ms - (s.wall_ms or at_ms)) / 1000.0
        now = pd.Timestamp(at_ms, unit="ms")
        age = (s.motion.coast_age or 0.0) + waited
        if s.shown != "LOST" and age > self.tuning.coast_s:
            s.shown = "LOST"
            out.append(notice(s, "integrity", integrity="LOST", coast_age_s=age, ts=now))
        if s.was_in_zone and not in_zone(s, s.t + waited, self.grace_s):
            s.was_in_zone = False
            out.append(notice(s, "zone", in_zone=False, ts=now))
        self.state.update((s.dump(),))
        if out:
            yield frame(key[0], out)

    def close(self) -> None:
        pass


def track_sessions(events: DataFrame, tuning: Tuning = Tuning(), grace_s: float = GRACE_S,
                   watermark: str = "10 seconds") -> DataFrame:
    """Tracker results for a stream of session inputs. Needs the RocksDB state store."""
    return (events.withWatermark("ts", watermark).groupBy("sid")
            .transformWithStateInPandas(statefulProcessor=SessionTracker(tuning, grace_s),
                                        outputStructType=schemas.SESSION_OUTPUT,
                                        outputMode="Append", timeMode="EventTime"))
