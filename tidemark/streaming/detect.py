"""The fold over a stream: one state a session, windows released in order.

Rows of a micro-batch come in any order and may come late. Without an event
time, a session's rows are held until a row of it is newer by the delay, and the
session ends when it was silent for the idle time of the clock. With one, rows
are held until the stream's watermark has passed them, timers on event time let
them go, and a session ends when the watermark is past its last row by the idle
time; then batches may be run again, or be months late, with the same result.

What is released is stepped by time; a row whose window is before one that was
stepped is late and is marked, not stepped. When a session ends, what still
waits is stepped, a mute is taken back, and its state is dropped, but for a
tombstone that knows late rows for what they are. Output is appended as
decisions, the same as the batch fold's.

State is typed: a value, a list and maps of plain columns, read by name, so a
column may be added (see `STATE`) and a query goes on from its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import Config
from tidemark.operators import detect, fold, rules
from tidemark.streaming import causal

OUTPUT = f"session_id {{}}, window_index long, timestamp double, {detect.DECISION}, {detect.STATES}, late boolean, changed boolean, at_end boolean"
_COLUMNS = [x.split()[0] for x in OUTPUT.split(", ")]
_KINDS = {"baseline_count": "Int32", "pending": "Int32"} | {c: "boolean" for c in ("ad_profile", "cue_active", "muted")}
#: The fold's state and the stream's memory, the last window stepped and the newest row. New columns go to the end; old states have none.
STATE = (
    "base_rms double, base_crest double, base_centroid double, base_count int, in_ad boolean, ad_started_at double, cue_at double, streak int, state string, pending int, "
    "muted_at double, believed_muted boolean, unmute_pending boolean, own_mute boolean, held double, voiced_rms double, voiced_centroid double, armed boolean, checked_at double, app string, "
    "last long, newest double"
)
_BASE = ("rms", "crest", "centroid", "count")
_PLAIN = [f.name for f in fields(fold.State) if f.name not in ("baseline", "own")]
_REMEMBERED = [f.name for f in fields(causal.Memory) if f.name != "recent"]
_DECIDED = attrgetter(*(f.name for f in fields(fold.Decision)))


@dataclass
class Session:
    """What is known of a session between its rows."""

    state: fold.State = field(default_factory=fold.State)
    memory: causal.Memory = field(default_factory=causal.Memory)
    last: int = -1
    newest: float = float("-inf")
EVENT = "event_millis"


class Fold(StatefulProcessor):
    """One session's fold, and the rows that wait for it."""

    def __init__(self, config: Config, delay: float, idle: float | None, tombstone: float, detector: fold.Detector, row: str, event: bool, columns: str) -> None:
        self.config, self.delay, self.idle, self.tombstone, self.detector, self.row, self.event = config, delay, idle, tombstone, detector, row, event
        self.names, self.typed = [x.split()[0] for x in row.split(", ")], columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.columns = handle, [x.split()[0] for x in self.typed.split(", ")]
        self.fold = handle.getValueState("fold", self.typed)
        self.recent = handle.getListState("recent", "level double")
        self.own = handle.getMapState("own", "name string", "value string")
        self.waiting = handle.getMapState("waiting", "window_index long", self.row)
        # On the clock a tombstone goes by itself; on event time a timer takes it away.
        ttl = int(1000 * self.tombstone) if self.idle is not None and not self.event else None
        self.ended = handle.getValueState("ended", "last long, until long", ttl)

    def _stored(self) -> Session:
        own = Session(fold.State.at_start(self.config))
        if not self.fold.exists():
            own.last = self.ended.get()[0] if self.ended.exists() else -1
            return own
        got = {n: v for n, v in zip(self.columns, self.fold.get()) if v is not None}
        own.state.baseline = fold.Baseline(*(got.get(f"base_{n}") for n in _BASE[:3]), got.get("base_count", 0))
        for part, names in ((own.state, _PLAIN), (own.memory, _REMEMBERED), (own, ("last", "newest"))):
            for n in names:
                setattr(part, n, got.get(n, getattr(part, n)))
        own.memory.recent = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        own.state.own = {k[0]: json.loads(v[0]) for k, v in self.own.iterator()} if self.own.exists() else {}
        return own

    def _store(self, own: Session) -> None:
        known = {f"base_{n}": getattr(own.state.baseline, n) for n in _BASE} | {n: getattr(own.state, n) for n in _PLAIN}
        known |= {n: getattr(own.memory, n) for n in _REMEMBERED} | {"last": own.last, "newest": float(own.newest)}
        self.fold.update(tuple(known.get(n) for n in self.columns))
        self.recent.put([(None if x is None else float(x),) for x in own.memory.recent]) if own.memory.recent else self.recent.clear()
        if own.state.own or self.own.exists():
            self.own.clear()
            for name, value in own.state.own.items():
                self.own.updateValue((name,), (json.dumps(value),))

    def _held(self) -> list[tuple[int, dict]]:
        return sorted(((int(k[0]), dict(zip(self.names, v), window_index=int(k[0]))) for k, v in self.waiting.iterator()), key=lambda x: x[0])

    def _stepped(self, rows: list[tuple[int, dict]], own: Session) -> list[tuple]:
        """Output rows of the windows, stepped in order; they no longer wait."""
        out = []
        for i, w in rows:
            self.waiting.removeKey((i,))
            before, t = own.state.believed_muted, w["timestamp"]
            d = fold.step(own.state, own.memory.seen(w, t, self.config), t, self.config, self.detector)
            own.last, muted = i, own.state.believed_muted
            out.append((i, t, *_DECIDED(d), own.state.state, muted, own.state.pending, False, muted != before, False))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own, late = self._stored(), []
        for part in rows:
            for w in detect.records(part):
                if w["window_index"] <= own.last:
                    late.append(w)
                else:
                    self.waiting.updateValue((int(w["window_index"]),), tuple(w[n] for n in self.names))
                    own.newest = max(own.newest, w[EVENT] if self.event else w["timestamp"])
        if not self.event:
            ready = [(i, w) for i, w in self._held() if w["timestamp"] <= own.newest - self.delay]
            if ready:
                yield self._rows(key, self._stepped(ready, own))
        if late:
            none = (None,) * (len(_COLUMNS) - 6)
            yield self._rows(key, [(w["window_index"], w["timestamp"], *none, True, False, False) for w in late])
        if own.newest > float("-inf"):
            self._store(own)
            if self.event:
                self._wake_at(self._held(), own.newest)
            elif self.idle is not None:
                self._only_timer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle))

    def _only_timer(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _wake_at(self, held: list[tuple[int, dict]], newest: float) -> None:
        """The watermark's next mark: the first row that waits, or the session's end."""
        if held:
            self._only_timer(int(min(w[EVENT] for _, w in held)))
        elif self.idle is not None:
            self._only_timer(int(newest) + int(1000 * self.idle))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.fold.exists():  # the timer of a tombstone
            self.ended.clear()
            return
        own, held = self._stored(), self._held()
        if self.event:
            passed = timerValues.getCurrentWatermarkInMs()
            # A row that came after a later one of its session waits behind it no longer.
            upto = max((i for i, w in held if w[EVENT] <= passed), default=-1)
            ready, held = [x for x in held if x[0] <= upto], [x for x in held if x[0] > upto]
            if ready:
                yield self._rows(key, self._stepped(ready, own))
            if held or self.idle is None or own.newest + 1000 * self.idle > passed:
                self._store(own)
                self._wake_at(held, own.newest)
                return
        out = self._stepped(held, own)
        at = held[-1][1]["timestamp"] if held else own.newest / 1000 if self.event else own.newest
        if fold.shut_down(own.state):
            none = (None,) * (len(_COLUMNS) - 9)
            out.append((own.last, at, *none, own.state.state, False, 0, False, True, True))
        if out:
            yield self._rows(key, out)
        for one in (self.fold, self.recent, self.own, self.waiting):
            one.clear()
        until = int(own.newest) + int(1000 * ((self.idle or 0) + self.tombstone)) if self.event else 0
        self.ended.update((own.last, until))
        if self.event:
            self._only_timer(until)

    @staticmethod
    def _rows(key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=_COLUMNS).astype(_KINDS)

    def close(self) -> None:
        pass


def decisions(
    windows: DataFrame, config: Config, delay_seconds: float = 10.0, idle_seconds: float | None = None, detector: fold.Detector = rules.RULES,
    event_time: str | None = None, tombstone_seconds: float = 3600.0, state: str = STATE,
) -> DataFrame:
    """The stream of decisions of a stream of windows (session_id, window_index, timestamp, features).

    Rows wait until a window of their session is `delay_seconds` newer, or
    until none has come for `idle_seconds` of processing time (null: for ever,
    and state is kept). With `event_time`, a column of time stamps on a clock
    that all sessions share, both are counted on it: rows wait until the
    watermark, `delay_seconds` behind the newest row of all, has passed them.
    `changed` says where the wanted state changes; a row with `at_end` takes
    back the mute of a session that ended. Its rows that come later are `late`
    for `tombstone_seconds`; rows past its last window begin a session anew.
    `state` may have columns after those of `STATE`; a store that is encoded as
    Avro goes on with them from a checkpoint that has none.
    """
    more = [c for c in detect.OPTIONAL if c in windows.columns]
    names = ["timestamp", *detect.READ, *more]
    read = windows.select("session_id", "window_index", *names)
    mode = "None" if idle_seconds is None else "ProcessingTime"
    if event_time is not None:
        marked = windows.withWatermark(event_time, f"{int(1000 * delay_seconds)} milliseconds")
        read, mode = marked.select("session_id", "window_index", *names, F.unix_millis(event_time).alias(EVENT), event_time), "EventTime"
        names.append(EVENT)
    row = ", ".join(f"{n} {read.schema[n].dataType.simpleString()}" for n in names)
    step = Fold(config, delay_seconds, idle_seconds, tombstone_seconds, detector, row, event_time is not None, state)
    return read.groupBy("session_id").transformWithStateInPandas(step, OUTPUT.format(read.schema["session_id"].dataType.simpleString()), "Append", mode)


def write_commands(decided: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends each change of the wanted state, keyed by session and window.

    Batches are written under their number and replace themselves when they
    run again, so a command is never doubled.
    """

    def apply(batch: DataFrame, number: int) -> None:
        wanted = batch.filter("changed and not late").selectExpr("session_id", "window_index", "timestamp", "muted as want_muted", "at_end", "event", "state")
        wanted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return decided.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append").start()
