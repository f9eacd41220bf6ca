"""From recorded sessions to scores and training rows: WAV windows, features, one clock, labels, fold, scores.

A session is a folder of WAV files (its chunks, in the order of their names)
with a label file for each, and may be named by a session.json (`named`). Chunks are cut by the recorder, so a session's
windows are numbered and timed over all of them and only its first one starts a
stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import kernels
from tidemark.operators import dataset, detect, fold, intervals, rules, sequence
from tidemark.sources import files, tables
from tidemark.sources.wav import WavSource

KEPT = ("session_id", "chunk", "window_index", "sample_rate")


def named(spark: SparkSession, folders: Iterable[str]) -> dict[str, str]:
    """Folders by session: the name that a folder's session.json gives, else the folder's own. Two sessions of one name are an error."""
    out: dict[str, str] = {}
    for folder in folders:
        told = files.session_metadata(spark, f"{folder.rstrip('/')}/session.json").first()
        name = (told.session_id if told else None) or folder.rstrip("/").rsplit("/", 1)[-1]
        if name in out:
            raise ValueError(f"{folder} and {out[name]} are both the session {name}")
        out[name] = folder
    return out


def windows(spark: SparkSession, sessions: Mapping[str, str], config: Config) -> DataFrame:
    """The feature windows of sessions (folders by id) on each session's clock, as a table.

    Samples are measured where they are read; each file has its own rate.
    """
    spark.dataSource.register(WavSource)
    audio = config.audio
    read = spark.read.format("wav_windows").option("sessions", json.dumps(dict(sessions))).option("windowSeconds", str(audio.window_seconds)).load()
    measured = kernels.window_features(read, "sample_rate", config.detection.silence_dbfs, audio.frame_seconds, KEPT)
    clocked = sequence.session_clock(measured).drop("window_index")
    out = clocked.select(
        "session_id", F.lit(0).alias("epoch"), F.col("session_index").cast("long").alias("window_index"), F.col("session_seconds").alias("timestamp"), "chunk",
        *detect.FEATURES, (F.col("session_index") == 0).alias("stream_restarted"),
    )
    return tables.written(out, "windows")


def spans(spark: SparkSession, sessions: Mapping[str, str]) -> DataFrame:
    """The label spans of sessions, on their chunks' clocks; every chunk must have a good label file."""
    lines = None
    for session, folder in sessions.items():
        files.paired(files.listed(spark, folder, "*.[wW][aA][vV]"), files.listed(spark, folder, "*.txt"))
        own = files.label_lines(spark, folder, session)
        lines = own if lines is None else lines.unionByName(own)
    return files.labels(lines)


def _parts(rows: DataFrame, labels: DataFrame, config: Config, detector: fold.Detector) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions with their durations, mutes and breaks. Recordings have no device to ask, so the app gate is off."""
    chunks = rows.groupBy("session_id", "chunk").agg(F.sum("duration_seconds").alias("duration"))
    on_clock = intervals.session_spans(labels, chunks)
    breaks = intervals.merge(on_clock.filter(F.col("label").isin(*intervals.AD_LABELS)))
    free = config.override({"gate.armed_apps_only": "false"})
    decided = detect.decisions(rows, free, detector=detector, columns=("muted",))
    mutes = tables.written(detect.mute_spans(decided, F.col("_until") + config.audio.window_seconds), "mutes")
    return rows.groupBy("session_id").agg(F.sum("duration_seconds").alias("duration")), mutes, breaks


def scores(
    spark: SparkSession, sessions: Mapping[str, str], config: Config, detector: fold.Detector = rules.RULES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of each session, totals over all, and each break with its first mute."""
    labels = spans(spark, sessions)
    known, mutes, breaks = _parts(windows(spark, sessions, config), labels, config, detector)
    by_session, by_break = intervals.score_sessions(known, mutes, breaks), intervals.break_latency(mutes, breaks)
    return by_session, intervals.score_totals(by_session, by_break), by_break


def training_rows(spark: SparkSession, sessions: Mapping[str, str], config: Config) -> DataFrame:
    """The training rows of sessions."""
    labels = spans(spark, sessions)
    return dataset.training_rows(windows(spark, sessions, config), labels, config.detection)
