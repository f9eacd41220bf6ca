"""The fold over whole tables: decisions, states, mute spans and commands."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields
from operator import attrgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import Config, Log
from tidemark.operators import fold, rules, sequence

FEATURES = (
    "rms_dbfs", "peak", "peak_dbfs", "crest_factor", "crest_db", "spectral_centroid_hz", "zero_crossing_rate", "is_silence", "silence_ratio",
    "max_silence_run_seconds", "leading_silence_seconds", "trailing_silence_seconds", "interior_silence_seconds", "duration_seconds",
)
#: Features that the fold reads, or what it reads is made of.
READ = (
    "rms_dbfs", "crest_db", "spectral_centroid_hz", "is_silence", "silence_ratio", "leading_silence_seconds", "trailing_silence_seconds",
    "interior_silence_seconds", "duration_seconds",
)
OPTIONAL = ("stream_restarted", "app_id", "app_name", "armed", "app_switched", "command_ok", "ad_score")
DECISION = (
    "event string, ad_profile boolean, confidence double, reason string, gap_seconds double, cue_gap_seconds double, cue_active boolean, "
    "loudness_threshold_db double, loudness_delta_db double, crest_delta_db double, smoothed_rms_dbfs double, baseline_rms_dbfs double, "
    "baseline_crest_db double, baseline_centroid_hz double, baseline_count int, ad_elapsed_seconds double"
)
STATES = "state string, muted boolean, pending int"
#: Of these, what the fold itself reads.
FOLDED = ("stream_restarted", "armed", "app_switched", "command_ok", "ad_score")
PART = "_part"
_NAMES = [f.name for f in fields(fold.Decision)]
_TYPES = dict(x.split() for x in f"{DECISION}, {STATES}".split(", "))
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}


def records(rows: pd.DataFrame) -> Iterator[dict]:
    """Each row as a mapping; missing values of optional columns and of what the baseline is made of are None (pandas doesn't tell NaN from them)."""
    known = (*OPTIONAL, "rms_dbfs", "crest_db", "spectral_centroid_hz")
    columns = [rows[c].astype(object).where(rows[c].notna(), None).tolist() if c in known else rows[c].tolist() for c in rows.columns]
    names = list(rows.columns)
    return (dict(zip(names, values)) for values in zip(*columns))


def seen(windows: DataFrame, tried: list[Config]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Windows with gap_seconds and, for each config, the columns that say what is a cue and how loud it has been; and these columns' names.

    Window functions over session and epoch, which the stream's restarts and
    the app's switches begin; windows that aren't armed take no part. Configs
    that are alike in this share columns.
    """
    asking = {(c.gate, c.controller.app_check_seconds) for c in tried if c.gate.armed_apps_only}
    if len(asking) > 1:
        raise ValueError("configs that are folded together must ask for the same apps at the same times")
    rows = windows
    if asking and "armed" not in rows.columns:
        asks = next(c for c in tried if c.gate.armed_apps_only)
        missing = {c: F.lit(None).cast("string") for c in ("app_id", "app_name") if c not in rows.columns}
        rows = sequence.gated(rows.withColumns(missing), asks)
    rows = sequence.epochs(rows)
    if asking:
        rows = rows.withColumn("epoch", F.when(F.col("armed"), F.col("epoch")))
    rows = sequence.last_voiced(sequence.gap_stitch(rows))
    made: dict[tuple, str] = {}
    names = []
    for config in tried:
        d = config.detection
        cue = ("cue", d.require_transition_cue, d.min_gap_seconds, d.max_gap_seconds, d.loudness_jump_db, d.centroid_shift_ratio)
        level = ("level", d.loudness_median_windows)
        if cue not in made:
            made[cue] = f"cue_{len(made)}"
            rows = rows.withColumn(made[cue], sequence.cue(d))
        if level not in made:
            made[level] = f"level_{len(made)}"
            rows = sequence.trailing_median(rows, d.loudness_median_windows).withColumnRenamed("smoothed_rms_dbfs", made[level])
        names.append((made[cue], made[level]))
    return rows, names


def restart_parts(windows: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Adds the number of restarts before or at each window: parts of a session that know nothing of each other."""
    anew = (F.coalesce(F.col("stream_restarted"), F.lit(False)) & (F.col("window_index") > 0)).cast("int")
    return windows.withColumn(PART, F.sum(anew).over(Window.partitionBy(*keys).orderBy("window_index").rowsBetween(Window.unboundedPreceding, 0)))


def decisions(
    windows: DataFrame, config: Config | list[Config], detector: fold.Detector = rules.RULES, columns: tuple[str, ...] = tuple(_TYPES)
) -> DataFrame:
    """session_id, window_index, timestamp and `columns` (of decision and state) of every window.

    What depends on features alone is found by window functions first (`seen`).
    Sessions are then folded in parallel, each in the order of window_index.
    Rows stream through a task in order and only the fold's state is kept from
    one batch to the next, so a session may have any length. Of several configs,
    each window is folded once for each, and config_id says which. Only the
    scalars that the fold reads are shuffled.

    After a restart of the stream nothing is left of what went before, if the
    actuator obeys (no command_ok): sessions are then split there, and their
    parts are folded apart.

    Levels may be endless (no sound at all); rows go through Arrow, which tells
    a value that isn't known from NaN, the difference of two endless levels.
    """
    several, keys = not isinstance(config, Config), ("session_id",)
    tried = list(config) if several else [config]
    rows, names = seen(windows, tried)
    more = [c for c in FOLDED if c in rows.columns]
    own = sorted({n for pair in names for n in pair})
    ids = [*keys, "window_index", "timestamp"]
    read = rows.select(*ids, "rms_dbfs", "crest_db", "spectral_centroid_hz", "is_silence", "gap_seconds", *own, *more)
    split = "stream_restarted" in more and "command_ok" not in more
    if split:
        read, keys = restart_parts(read, keys), (*keys, PART)
    shown = attrgetter(*(c for c in columns if c in _NAMES)) if any(c in _NAMES for c in columns) else None
    held = attrgetter(*({"muted": "believed_muted"}.get(c, c) for c in columns if c not in _NAMES)) if any(c not in _NAMES for c in columns) else None
    order = [c for c in columns if c in _NAMES] + [c for c in columns if c not in _NAMES]
    both = lambda got: got if isinstance(got, tuple) else (got,)
    types = {c: read.schema[c].dataType.simpleString() for c in ids} | ({"config_id": "int"} if several else {}) | {c: _TYPES[c] for c in order}

    def folded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = None, []
        for rows in parts:
            found: list[list[tuple]] = [[] for _ in tried]
            values = {c: rows.column(c).to_pylist() for c in rows.schema.names}
            for key, one in zip(zip(*(values[k] for k in keys)), zip(*values.values())):
                w, key = dict(zip(values, one)), tuple(None if k != k else k for k in key)
                t = float("nan") if w["timestamp"] is None else w["timestamp"]
                if now is None or key != now:
                    begins = not split or key[-1] == 0
                    now, states = key, [fold.State.at_start(c) if begins else fold.State() for c in tried]
                for own, (cue, level), state, out in zip(tried, names, states, found):
                    w["is_cue"], w["smoothed_rms_dbfs"] = w[cue], w[level]
                    d = fold.step(state, w, t, own, detector)
                    out.append((*(both(shown(d)) if shown else ()), *(both(held(state)) if held else ())))
            for k, out in enumerate(found):
                which = [pa.array([k] * len(out), pa.int32())] if several else []
                got = [pa.array(x, _ARROW[_TYPES[c]]) for c, x in zip(order, zip(*out) if out else [()] * len(order))]
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in ids] + which + got, list(types))

    return sequence.in_order(read, keys).mapInArrow(folded, ", ".join(f"`{c}` {t}" for c, t in types.items()))


def edges(decided: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Adds changed: did the belief about muting change at this window (or start muted)?"""
    spec = Window.partitionBy(*keys).orderBy("window_index")
    return decided.withColumn("changed", F.col("muted") != F.lag("muted", 1, False).over(spec))


def commands(decided: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """The wanted state (muted or not) at each change, keyed by session and window.

    States, not toggles: applying one twice does no harm. A session that ends
    muted is unmuted at its last window.
    """
    last = F.lead("window_index").over(Window.partitionBy(*keys).orderBy("window_index")).isNull()
    rows = edges(decided, keys).withColumn("_last", last)
    change = rows.filter("changed").select(*keys, "window_index", "timestamp", F.col("muted").alias("want_muted"), F.lit(False).alias("at_end"))
    close = rows.filter("_last and muted").select(*keys, "window_index", "timestamp", F.lit(False).alias("want_muted"), F.lit(True).alias("at_end"))
    return change.unionByName(close)


def mute_spans(decided: DataFrame, duration: Column | None = None, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """keys, span, start and end of every muted stretch.

    A stretch open at the end is closed at the last window's start; one that
    begins there is extended to the session's duration (by default the last
    window's start and one second).
    """
    by = Window.partitionBy(*keys).orderBy("window_index")
    whole = Window.partitionBy(*keys)
    rows = edges(decided, keys).withColumn("_until", F.max("timestamp").over(whole)).filter("changed")
    ends = F.coalesce(F.lead("timestamp").over(by), F.col("_until"))
    spans = rows.withColumn("_end", ends).filter("muted").withColumn("span", F.row_number().over(by) - 1)
    total = F.col("_until") + 1.0 if duration is None else duration
    return spans.select(*keys, "span", F.col("timestamp").alias("start"), F.when(F.col("_end") > F.col("timestamp"), F.col("_end")).otherwise(total).alias("end"))


def feature_log(windows: DataFrame, decided: DataFrame) -> DataFrame:
    """A row for each window: state, features as they are, decision; fixed columns, null where not armed."""
    both = windows.select("session_id", "window_index", *FEATURES).join(decided, ["session_id", "window_index"])
    return both.select(
        "session_id", F.col("window_index").alias("index"), F.round("timestamp", 3).alias("timestamp"), "state", "muted", *FEATURES, *_NAMES
    )


def decision_log(decided: DataFrame, log: Log, by: str = "reason") -> DataFrame:
    """Adds level to the windows that were armed: INFO for what is new, DEBUG for what goes on.

    New is an event, or another `by` than at the armed window before; every
    `decision_heartbeat_windows`-th window of a session is told anyway, and all
    are with `verbose_decisions`.
    """
    order = Window.partitionBy("session_id").orderBy("window_index")
    armed = F.col("event") != ""
    before = F.last(F.when(armed, F.col(by)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = F.col("event").isin(fold.STARTED, fold.ENDED) | ~F.col(by).eqNullSafe(before) | F.lit(log.verbose_decisions)
    if log.decision_heartbeat_windows:
        told = told | (F.row_number().over(order) % log.decision_heartbeat_windows == 0)
    return decided.withColumn("level", F.when(told, "INFO").otherwise("DEBUG")).filter(armed)


def replay_changes(decided: DataFrame) -> DataFrame:
    return decided.filter(F.col("event").isin(fold.STARTED, fold.ENDED)).select("session_id", "window_index", "timestamp", "event", "state", "confidence")


def replay_summary(spans: DataFrame, decided: DataFrame) -> DataFrame:
    """session_id, mutes, muted_seconds, duration and muted_share of every session."""
    total = decided.groupBy("session_id").agg((F.max("timestamp") + 1.0).alias("duration"))
    muted = spans.groupBy("session_id").agg(F.count("*").alias("mutes"), F.sum(F.col("end") - F.col("start")).alias("muted_seconds"))
    both = total.join(muted, "session_id", "left").na.fill({"mutes": 0, "muted_seconds": 0.0})
    return both.withColumn("muted_share", F.col("muted_seconds") / F.col("duration"))
