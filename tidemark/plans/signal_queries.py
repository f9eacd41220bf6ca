"""Registered queries of the signal operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config, Control, Detection, Gate, Log
from tidemark.functions import kernels, signal
from tidemark.operators import dataset, detect, intervals, recut, sequence, trained
from tidemark.operators import sweep as sweeps
from tidemark.plans import signal_sql
from tidemark.sources import adapters, tables

CONFIG = Config(
    detection=Detection(
        min_gap_seconds=0.15, max_gap_seconds=2.55, cue_grace_seconds=6.5, loudness_jump_db=0.503, centroid_shift_ratio=0.1003, ad_loudness_delta_db=1.937,
        ad_crest_delta_db=-99.0, loudness_median_windows=3, baseline_alpha=0.0503, baseline_min_windows=8, ad_end_windows=2, min_ad_seconds=1.5, max_ad_seconds=30.5,
    ),
    controller=Control(confirm_windows=2, max_mute_seconds=40.5),
)
SWEPT = "detection.ad_loudness_delta_db"
SWEEP_VALUES = tuple(f"{0.137 + 0.31 * k:.3f}" for k in range(12))
GRID = {"detection.min_gap_seconds": ("0.15", "0.45", "2.75"), "detection.ad_loudness_delta_db": ("0.757", "1.997")}
GRID_STAY = -0.063
#: Fixed values of the app gate query.
APP_IDS, APP_NAMES = ("12", "7"), ("click",)

#: Windows between two lines of the log at most.
HEARTBEAT = 13
#: The gate is on, and asked often; several apps are armed.
GATED = replace(
    CONFIG.with_detection(baseline_min_windows=2, ad_loudness_delta_db=0.137, ad_stay_loudness_delta_db=-6.063, max_ad_seconds=12.5),
    controller=Control(confirm_windows=2, max_mute_seconds=12.5, app_check_seconds=3.5), gate=Gate(armed_apps_only=True, armed_app_ids=("0", "2"), armed_app_names=APP_NAMES),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = signal_sql.statements(CONFIG, SWEEP_VALUES, APP_IDS, APP_NAMES, GATED, HEARTBEAT, GRID, GRID_STAY)


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that engines' last bits don't count."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _of_buffers(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return _rounded(adapters.buffers(spark, sf_dir).select("vec_id", *(c.alias(n) for n, c in columns.items())))


@_query
def downmix(spark, sf_dir):
    pairs = adapters.buffers(spark, sf_dir).select("vec_id", signal.mono(F.transform("samples", lambda x: F.round(x * 32768)), 2, 32768.0).alias("m"))
    return _rounded(pairs.select("vec_id", F.size("m").alias("n_frames"), signal.rms(F.col("m")).alias("rms"), signal.peak(F.col("m")).alias("peak")))


@_query
def sig_rms(spark, sf_dir):
    return _of_buffers(spark, sf_dir, rms=signal.rms(F.col("samples")))


@_query
def sig_level_db(spark, sf_dir):
    return _of_buffers(spark, sf_dir, rms_dbfs=signal.decibels(signal.rms(F.col("samples"))))


@_query
def sig_peak(spark, sf_dir):
    return _of_buffers(spark, sf_dir, peak=signal.peak(F.col("samples")))


@_query
def sig_crest(spark, sf_dir):
    crest = signal.crest_factor(signal.peak(F.col("samples")), signal.rms(F.col("samples")))
    return _of_buffers(spark, sf_dir, crest_factor=crest, crest_db=signal.decibels(crest))


@_query
def sig_zcr(spark, sf_dir):
    return _of_buffers(spark, sf_dir, zero_crossing_rate=signal.zero_crossing_rate(F.col("samples")))


@_query
def sig_centroid(spark, sf_dir):
    rows = kernels.window_features(adapters.buffers(spark, sf_dir), adapters.BUFFER_RATE, frame_seconds=adapters.FRAME / adapters.BUFFER_RATE)
    return rows.select("vec_id", F.round("spectral_centroid_hz", 5).alias("spectral_centroid_hz"))


@_query
def sig_frame_rms(spark, sf_dir):
    rows = adapters.buffers(spark, sf_dir).select("vec_id", F.posexplode(signal.frame_rms(F.col("samples"), adapters.FRAME)).alias("frame", "rms"))
    return _rounded(rows)


def _runs(spark, sf_dir):
    silent = F.transform(signal.frame_rms(F.col("samples"), adapters.FRAME), lambda x: signal.decibels(x) < -60)
    return adapters.buffers(spark, sf_dir).select("vec_id", silent.alias("mask")).select("vec_id", "mask", signal.true_runs(F.col("mask")).alias("runs"))


@_query
def silence_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("vec_id", F.explode("runs").alias("r")).select("vec_id", F.col("r.start").alias("start"), F.col("r.stop").alias("stop"))


@_query
def silence_profile(spark, sf_dir):
    profile = signal.silence_profile(F.col("runs"), F.size("mask"), F.lit(adapters.FRAME / adapters.BUFFER_RATE))
    return _rounded(_runs(spark, sf_dir).select("vec_id", profile.alias("p")).select("vec_id", "p.*"))


@_query
def window_features(spark, sf_dir):
    rows = kernels.window_features(adapters.buffers(spark, sf_dir), adapters.BUFFER_RATE, frame_seconds=adapters.FRAME / adapters.BUFFER_RATE)
    return _rounded(rows.withColumn("spectral_centroid_hz", F.round("spectral_centroid_hz", 5)))


def _at(df: DataFrame, *columns: str) -> DataFrame:
    return _rounded(df.select("session_id", "window_index", *columns))


@_query
def session_clock(spark, sf_dir):
    return _at(sequence.session_clock(adapters.windows(spark, sf_dir)), "session_index", "session_seconds")


@_query
def gap_stitch(spark, sf_dir):
    return _at(sequence.gap_stitch(adapters.windows(spark, sf_dir)), "gap_seconds")


@_query
def last_voiced(spark, sf_dir):
    return _at(sequence.last_voiced(adapters.windows(spark, sf_dir)), "voiced_rms_dbfs", "voiced_centroid_hz")


@_query
def cue_candidates(spark, sf_dir):
    return _at(sequence.cue_candidates(adapters.windows(spark, sf_dir), CONFIG.detection), "is_cue", "cue_gap_seconds")


@_query
def cue_active(spark, sf_dir):
    return _at(sequence.cue_active(adapters.windows(spark, sf_dir), CONFIG.detection), "cue_active")


@_query
def trailing_median(spark, sf_dir):
    return _at(sequence.trailing_median(adapters.windows(spark, sf_dir), 9), "smoothed_rms_dbfs")


BASELINE = ("baseline_rms_dbfs", "baseline_crest_db", "baseline_centroid_hz", "baseline_count")


@_query
def ema_baseline(spark, sf_dir):
    return _at(sequence.ema_baseline(adapters.windows(spark, sf_dir), CONFIG.detection.baseline_alpha), *BASELINE)


@_query
def feature_deltas(spark, sf_dir):
    rows = sequence.ema_baseline(adapters.windows(spark, sf_dir), CONFIG.detection.baseline_alpha)
    return _at(sequence.feature_deltas(rows), "delta_rms_db", "delta_crest_db", "delta_centroid_ratio")


@_query
def seconds_since_gap(spark, sf_dir):
    rows = sequence.session_clock(adapters.windows(spark, sf_dir))
    return _at(sequence.seconds_since_gap(rows, CONFIG.detection), "seconds_since_gap")


@_query
def app_gate(spark, sf_dir):
    """Every tenth window polls; the polled app is the event's, null for one type."""
    polled = F.when((F.col("window_index") % 10 == 0) & (F.col("event_type") != "view"), (F.col("event_id") % 20).cast("string"))
    rows = adapters.windows(spark, sf_dir).withColumn("app_id", polled).withColumn("app_name", F.upper("event_type"))
    return _at(sequence.app_gate(rows, APP_IDS, APP_NAMES), "active_app", "armed")


@_query
def app_asof(spark, sf_dir):
    """Windows with the last poll of a second table, asked for at intervals; polls that failed are told from those that found no app."""
    rows = adapters.windows(spark, sf_dir)
    gated = sequence.gated(sequence.as_of(rows, adapters.app_polls(rows)), GATED)
    return _at(gated, "poll", "app_id", "checked", "armed", "app_switched")


@_query
def epoch_features(spark, sf_dir):
    """Sequence features that begin anew where the stream does."""
    rows = sequence.epochs(adapters.restarts(adapters.windows(spark, sf_dir)))
    found = sequence.ema_baseline(sequence.trailing_median(sequence.last_voiced(sequence.gap_stitch(rows)), 9), CONFIG.detection.baseline_alpha)
    return _at(found, "epoch", "gap_seconds", "voiced_rms_dbfs", "smoothed_rms_dbfs", *BASELINE)


@_query
def restarted_states(spark, sf_dir):
    """Streams that begin anew, with the app of the second table: sessions are folded in parts."""
    rows = adapters.restarts(adapters.windows(spark, sf_dir))
    gated = sequence.gated(sequence.as_of(rows, adapters.app_polls(rows)), GATED)
    columns = ("event", "state", "muted", "pending")
    return _at(detect.decisions(gated, GATED, columns=columns), *columns)


@_query
def trained_states(spark, sf_dir):
    """A model learned on three sessions of four takes the rules' place in the others."""
    rows = adapters.windows(spark, sf_dir)
    learned, held = rows.filter("session_id % 4 <> 3"), rows.filter("session_id % 4 = 3")
    model = trained.fit(dataset.training_rows(learned, adapters.chunk_spans(learned), CONFIG.detection))
    scored = tables.written(trained.scored(held, model, CONFIG.detection), "scored")
    decided = detect.decisions(scored, CONFIG, detector=trained.Scored(0.5, 0.45), columns=("event", "state", "muted"))
    return _at(decided.join(scored.select("session_id", "window_index", trained.SCORE), ["session_id", "window_index"]), "event", "state", "muted", trained.SCORE)


@_query
def recut_blocks(spark, sf_dir):
    """Windows cut from blocks of any lengths, some of which are lost."""
    rows = recut.windows(adapters.blocks(spark, sf_dir), adapters.RECUT)
    level = signal.rms(F.col("samples"))
    return _rounded(rows.select("session_id", "window_index", "first_frame", F.size("samples").alias("n"), "whole", F.col("samples")[0].alias("first"), level.alias("rms")))


@_query
def label_parse(spark, sf_dir):
    rows = intervals.parse_labels(adapters.label_lines(adapters.windows(spark, sf_dir)))
    return _rounded(rows)


@_query
def label_overlap_check(spark, sf_dir):
    return _rounded(intervals.overlaps(adapters.raw_spans(adapters.windows(spark, sf_dir))))


def _session_spans(rows: DataFrame) -> DataFrame:
    return intervals.session_spans(adapters.chunk_spans(rows), adapters.chunks(rows))


def _breaks(rows: DataFrame) -> DataFrame:
    spans = _session_spans(rows)
    return intervals.merge(spans.filter(F.col("label").isin(*intervals.AD_LABELS)))


@_query
def session_spans(spark, sf_dir):
    return _rounded(_session_spans(adapters.windows(spark, sf_dir)))


@_query
def label_windows(spark, sf_dir):
    rows = adapters.windows(spark, sf_dir)
    return _at(intervals.label_windows(rows, _session_spans(rows)), "label")


@_query
def class_balance(spark, sf_dir):
    rows = adapters.windows(spark, sf_dir)
    return dataset.class_balance(intervals.label_windows(rows, _session_spans(rows)))


@_query
def unlabelled_chunks(spark, sf_dir):
    """Documents without a row in `labels`, as chunks without a label file."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return intervals.unlabelled(docs.select("doc_id", "source"), labels.select("doc_id"), "doc_id")


@_query
def merge_breaks(spark, sf_dir):
    return _rounded(_breaks(adapters.windows(spark, sf_dir)))


@_query
def training_rows(spark, sf_dir):
    rows = adapters.windows(spark, sf_dir)
    return dataset.training_rows(rows, adapters.chunk_spans(rows), CONFIG.detection)


@_query
def dataset_stats(spark, sf_dir):
    rows = adapters.windows(spark, sf_dir)
    return _rounded(dataset.stats(dataset.training_rows(rows, adapters.chunk_spans(rows), CONFIG.detection), CONFIG.detection))


def _decided(spark, sf_dir, *columns: str):
    return detect.decisions(adapters.windows(spark, sf_dir), CONFIG, columns=columns)


@_query
def detector_decisions(spark, sf_dir):
    columns = ("event", "ad_profile", "confidence", "gap_seconds", "cue_active", "smoothed_rms_dbfs", *BASELINE)
    return _at(_decided(spark, sf_dir, *columns), *columns)


@_query
def detector_events(spark, sf_dir):
    return _rounded(_decided(spark, sf_dir, "event").filter("event <> 'NO_CHANGE'").select("session_id", "window_index", "timestamp", "event"))


@_query
def controller_states(spark, sf_dir):
    return _at(_decided(spark, sf_dir, "state", "muted", "pending"), "state", "muted", "pending")


@_query
def gated_states(spark, sf_dir):
    """The app is asked for, the stream starts anew at times, and the actuator does not always obey."""
    rows = adapters.windows(spark, sf_dir)
    polled = rows.withColumns({
        "stream_restarted": F.col("window_index") % 23 == 0, "command_ok": F.col("event_id") % 7 != 3,
        "app_id": F.when(F.col("event_type") != "view", F.floor((F.col("window_index") + F.col("session_id")) / 17 % 4).cast("string")), "app_name": F.upper("event_type"),
    })
    columns = ("event", "state", "muted", "pending")
    return _at(detect.decisions(polled, GATED, columns=columns), *columns)


@_query
def mute_spans(spark, sf_dir):
    return _rounded(detect.mute_spans(_decided(spark, sf_dir, "muted")))


@_query
def mute_commands(spark, sf_dir):
    return _rounded(detect.commands(_decided(spark, sf_dir, "muted")))


@_query
def feature_log_rows(spark, sf_dir):
    rows = adapters.windows(spark, sf_dir)
    log = detect.feature_log(rows, detect.decisions(rows, CONFIG))
    # The bar is a setting, given as it is.
    return log.select("session_id", "index", "timestamp", "state", "muted", F.round("rms_dbfs", 6).alias("rms_dbfs"), "crest_db", "event", "loudness_threshold_db", "ad_elapsed_seconds")


@_query
def decision_log(spark, sf_dir):
    """The log's level of every window, by changes of state."""
    rows = detect.decision_log(_decided(spark, sf_dir, "event", "state"), Log(decision_heartbeat_windows=HEARTBEAT), "state")
    return rows.select("session_id", "window_index", "event", "state", "level")


@_query
def replay_changes(spark, sf_dir):
    return _rounded(detect.replay_changes(_decided(spark, sf_dir, "event", "state", "confidence")))


@_query
def replay_summary(spark, sf_dir):
    decided = tables.written(_decided(spark, sf_dir, "muted"), "decided")
    return _rounded(detect.replay_summary(detect.mute_spans(decided), decided))


def _scored(spark, sf_dir):
    """Sessions, mutes and breaks, as tables: each is read several times."""
    rows = tables.written(adapters.windows(spark, sf_dir), "windows")
    sessions = rows.groupBy("session_id").agg(F.sum("duration_seconds").alias("duration"))
    mutes = tables.written(detect.mute_spans(detect.decisions(rows, CONFIG, columns=("muted",))), "mutes")
    return sessions, mutes, tables.written(_breaks(rows), "breaks")


@_query
def break_latency(spark, sf_dir):
    _, mutes, breaks = _scored(spark, sf_dir)
    return _rounded(intervals.break_latency(mutes, breaks).select("session_id", "break_id", "first_mute", "latency"))


@_query
def ad_coverage(spark, sf_dir):
    _, mutes, breaks = _scored(spark, sf_dir)
    return _rounded(intervals.break_latency(mutes, breaks).select("session_id", "break_id", "start", "end", "covered_seconds"))


@_query
def false_mute(spark, sf_dir):
    _, mutes, breaks = _scored(spark, sf_dir)
    return _rounded(intervals.false_mute(mutes, breaks))


@_query
def spurious_mutes(spark, sf_dir):
    _, mutes, breaks = _scored(spark, sf_dir)
    return _rounded(intervals.spurious(mutes, breaks))


@_query
def score_session(spark, sf_dir):
    return _rounded(intervals.score_sessions(*_scored(spark, sf_dir)))


@_query
def score_totals(spark, sf_dir):
    sessions, mutes, breaks = _scored(spark, sf_dir)
    return _rounded(intervals.score_totals(intervals.score_sessions(sessions, mutes, breaks), intervals.break_latency(mutes, breaks)))


@_query
def param_sweep(spark, sf_dir):
    rows = adapters.windows(spark, sf_dir)
    tried, _ = sweeps.configs(CONFIG.with_detection(ad_stay_loudness_delta_db=-0.063), SWEPT, SWEEP_VALUES)
    sessions = rows.groupBy("session_id").agg(F.sum("duration_seconds").alias("duration"))
    return _rounded(sweeps.sweep(rows, tried, _breaks(rows), sessions))


@_query
def param_grid(spark, sf_dir):
    """Two settings together: cues and bars differ, so configs share window functions where they can."""
    rows = tables.written(adapters.windows(spark, sf_dir), "windows")
    tried, settings, _ = sweeps.grid(CONFIG, GRID, {"detection.ad_stay_loudness_delta_db": str(GRID_STAY)})
    sessions = rows.groupBy("session_id").agg(F.sum("duration_seconds").alias("duration"))
    scores = sweeps.named(spark, sweeps.sweep(rows, tried, tables.written(_breaks(rows), "breaks"), sessions), settings)
    return _rounded(scores.withColumnsRenamed({k: k.split(".")[1] for k in GRID}).drop("config_id"))


@_query
def clock_format(spark, sf_dir):
    rows = adapters.windows(spark, sf_dir)
    return rows.select("session_id", "window_index", signal.clock(F.col("window_index") * 61.25 + 0.5).alias("clock"))


@_query
def device_spec_parse(spark, sf_dir):
    """Sources of documents as device specifications; some name a card."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spec = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("plughw:CARD="), "source", F.lit(",DEV=0"))).when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise(F.lit("hw:CARD=,x"))
    return docs.select("doc_id", spec.alias("spec")).select("doc_id", "spec", F.coalesce(signal.card_name(F.col("spec")), "spec").alias("device"))


@_query
def device_candidates(spark, sf_dir):
    """What each specification is looked up by, in order; some are an index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    card = F.concat(F.lit("plughw:CARD="), "source", F.lit(",DEV=0"))
    spec = F.when(F.col("doc_id") % 3 == 0, card).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), "source")).otherwise((F.col("doc_id") % 10).cast("string"))
    return docs.select("doc_id", F.array_join(signal.device_candidates(spec), "|").alias("candidates"))
