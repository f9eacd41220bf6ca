"""Causal sequence features by window functions: what depends on features alone.

Input rows have session_id, epoch (counts the detector's resets, see `epochs`),
window_index and the features. Every frame ends at the current row or before it.
One epoch of a session is one ordered sequence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log10

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.config import Config, Detection

FULLY_SILENT = 0.999
#: A relative change is taken only of values over this.
LEAST_CENTROID = 1.0


def _ordered(*more: str) -> WindowSpec:
    return Window.partitionBy("session_id", *more).orderBy("window_index")


def _before(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def _sofar(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, 0)


def session_clock(windows: DataFrame, order: tuple[str, ...] = ("chunk", "window_index")) -> DataFrame:
    """Adds session_index and session_seconds: rows and audio before each row."""
    spec = Window.partitionBy("session_id").orderBy(*order)
    return windows.withColumn("session_index", F.row_number().over(spec) - 1).withColumn(
        "session_seconds", F.coalesce(F.sum("duration_seconds").over(_before(spec)), F.lit(0.0))
    )


def gap_stitch(windows: DataFrame) -> DataFrame:
    """Adds gap_seconds: the silence that ends in a window, joined over windows.

    Fully silent windows after an opener form an island with it; what an opener
    carries on is its trailing silence and theirs.
    """
    spec = _ordered("epoch")
    silent = F.col("silence_ratio") >= FULLY_SILENT
    island = F.coalesce(F.sum(F.when(silent, 0).otherwise(1)).over(_before(spec)), F.lit(0))
    held = F.when(silent, F.col("duration_seconds")).otherwise(F.col("trailing_silence_seconds"))
    # Islands are counted before the row, so the opener is the last row of the island before.
    shifted = windows.withColumn("_island", island).withColumn("_held", F.coalesce(F.lag(held).over(spec), F.lit(0.0)))
    carry = F.sum("_held").over(_sofar(_ordered("epoch", "_island")))
    gap = F.when(silent, F.lit(0.0)).otherwise(F.greatest(carry + F.col("leading_silence_seconds"), F.col("interior_silence_seconds")))
    return shifted.withColumn("gap_seconds", gap).drop("_island", "_held")


def last_voiced(windows: DataFrame) -> DataFrame:
    """Adds voiced_rms_dbfs and voiced_centroid_hz of the last window before that was not silent."""
    before = _before(_ordered("epoch"))
    voiced = lambda c: F.last(F.when(~F.col("is_silence"), F.col(c)), ignorenulls=True).over(before)
    return windows.withColumn("voiced_rms_dbfs", voiced("rms_dbfs")).withColumn("voiced_centroid_hz", voiced("spectral_centroid_hz"))


def abrupt(cfg: Detection) -> Column:
    """No voiced window before, or a jump of level or centroid against it."""
    rms, centroid = F.col("voiced_rms_dbfs"), F.col("voiced_centroid_hz")
    jump = F.abs(F.col("rms_dbfs") - rms) >= cfg.loudness_jump_db
    shift = F.when(centroid > LEAST_CENTROID, F.abs(F.col("spectral_centroid_hz") - centroid) / centroid).otherwise(0.0) >= cfg.centroid_shift_ratio
    return rms.isNull() | jump | shift


def cue(cfg: Detection) -> Column:
    """A gap of the right length with an abrupt change, of windows with gaps and last voiced ones."""
    if not cfg.require_transition_cue:
        return F.lit(True)
    return F.col("gap_seconds").between(cfg.min_gap_seconds, cfg.max_gap_seconds) & abrupt(cfg)


def cue_candidates(windows: DataFrame, cfg: Detection) -> DataFrame:
    """Adds is_cue and cue_gap_seconds."""
    rows = last_voiced(gap_stitch(windows))
    return rows.withColumn("is_cue", cue(cfg)).withColumn("cue_gap_seconds", F.when(F.col("is_cue"), F.col("gap_seconds")).otherwise(0.0))


def cue_active(windows: DataFrame, cfg: Detection) -> DataFrame:
    """Adds cue_active: a cue within the grace, as if none was ever cleared."""
    armed = F.max(F.when(F.col("is_cue"), F.col("timestamp"))).over(_sofar(_ordered("epoch")))
    return cue_candidates(windows, cfg).withColumn("cue_active", F.coalesce(F.col("timestamp") - armed <= cfg.cue_grace_seconds, F.lit(False)))


def trailing_median(windows: DataFrame, n: int) -> DataFrame:
    """Adds smoothed_rms_dbfs: the median of the last n levels, this one included."""
    frame = _ordered("epoch").rowsBetween(-(n - 1), 0)
    return windows.withColumn("smoothed_rms_dbfs", F.percentile("rms_dbfs", F.lit(0.5)).over(frame))


def in_order(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each session's windows together and in order, sessions dealt over an explicit number of tasks.

    A fold is much work for few bytes, so tasks must not be merged by size.
    """
    spark = windows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = [c for c in ("window_index", "timestamp") if c in windows.columns]
    return windows.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)


def _joined(rows: DataFrame, more: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """`rows` with the other columns of `more`, by keys that may be null."""
    own = more.select(*(F.col(k).alias(f"_on_{k}") for k in keys), *(c for c in more.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return rows.join(own, same, how).drop(*(f"_on_{k}" for k in keys))


#: Windows of a session that are counted together, whatever its length.
CHUNK = 4096
#: What is left of a value after a block's steps: far below a double's last bit.
FADED = 1e-20


def _steps(windows: DataFrame) -> DataFrame:
    """Adds _n: the windows before that were not silent, of a session and epoch. Sums of chunks first, so a session is many tasks."""
    keys = ("session_id", "epoch", "_chunk")
    rows = windows.withColumn("_chunk", F.floor(F.col("window_index") / CHUNK))
    voiced = F.when(F.col("is_silence"), 0).otherwise(1)
    sums = rows.groupBy(*keys).agg(F.sum(voiced).alias("_voiced"))
    earlier = sums.select(*keys, F.coalesce(F.sum("_voiced").over(Window.partitionBy("session_id", "epoch").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    own = F.coalesce(F.sum(voiced).over(_before(Window.partitionBy(*keys).orderBy("window_index"))), F.lit(0))
    return _joined(rows, earlier, keys).withColumn("_n", F.col("_earlier") + own).drop("_chunk", "_earlier")


def ema_baseline(windows: DataFrame, alpha: float) -> DataFrame:
    """Adds the baseline before each window: an exponential mean over windows that were not silent, and their number.

    A blocked scan. Blocks have as many voiced windows as make a value fade by
    1e-20, so within one a sum with powers of 1 - alpha can't overflow, whatever
    the session's length; at a block's start the mean is what the block before
    it has summed, and the faded rest of the one before that. A value that is
    not finite never fades, so what it leaves goes on to all later blocks.
    Blocks and chunks of a session are tasks of their own. Rows without
    session_id are a session.
    """
    keep = 1.0 - alpha
    size = max(1, ceil(log10(FADED) / log10(keep))) if 0 < keep < 1 else 1
    values = {"baseline_rms_dbfs": "rms_dbfs", "baseline_crest_db": "crest_db", "baseline_centroid_hz": "spectral_centroid_hz"}
    keys = ("session_id", "epoch", "_block")
    rows = _steps(windows).withColumns({"_block": F.floor(F.col("_n") / size), "_at": F.col("_n") % size})
    voiced, share = ~F.col("is_silence"), F.when(F.col("_n") == 0, 1.0).otherwise(alpha)
    power = lambda exponent: F.pow(F.lit(keep), exponent)
    narrow = rows.select(*keys, "_n", "_at", "is_silence", *values.values()).filter(voiced)
    sums = narrow.groupBy(*keys).agg(*(F.sum(share * F.col(x) * power(size - 1 - F.col("_at"))).alias(f"_{b}") for b, x in values.items()))
    # A block is begun by the sums of the two before it; a session's first one by nothing.
    after = sums.withColumn("_block", F.col("_block") + 1)
    sofar = Window.partitionBy("session_id", "epoch").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    endless = lambda b: F.sum(F.when(~(F.abs(f"_{b}") < float("inf")), F.col(f"_{b}"))).over(sofar)
    rest = lambda b: F.coalesce(endless(b) * keep, F.col(f"_{b}") * keep**size).alias(f"_{b}")
    later = sums.select("session_id", "epoch", (F.col("_block") + 2).alias("_block"), *(rest(b) for b in values))
    begun = after.unionByName(later).groupBy(*keys).agg(*(F.sum(f"_{b}").alias(f"_{b}") for b in values))
    inside = _before(Window.partitionBy(*keys).orderBy("window_index"))
    faded = lambda b: power(F.col("_at")) * F.coalesce(F.col(f"_{b}"), F.lit(0.0))
    own = lambda x: F.when(F.col("_at") > 0, power(F.col("_at") - 1) * F.sum(F.when(voiced, share * F.col(x) * power(-F.col("_at")))).over(inside)).otherwise(0.0)
    found = {b: F.when(F.col("_n") > 0, faded(b) + own(x)) for b, x in values.items()}
    out = _joined(rows, begun, keys, "left").withColumns(found).withColumn("baseline_count", F.col("_n").cast("int"))
    return out.select(*windows.columns, *values, "baseline_count")


def feature_deltas(baselined: DataFrame) -> DataFrame:
    """Adds the differences from the baseline; a positive crest difference is a squashed signal."""
    base = F.col("baseline_centroid_hz")
    return (
        baselined.withColumn("delta_rms_db", F.col("rms_dbfs") - F.col("baseline_rms_dbfs"))
        .withColumn("delta_crest_db", F.col("baseline_crest_db") - F.col("crest_db"))
        .withColumn("delta_centroid_ratio", F.when(base > LEAST_CENTROID, (F.col("spectral_centroid_hz") - base) / base))
    )


def seconds_since_gap(windows: DataFrame, cfg: Detection) -> DataFrame:
    """Adds seconds_since_gap: since a window had a silent run of some length, on the session's clock."""
    at = F.max(F.when(F.col("max_silence_run_seconds") >= cfg.min_gap_seconds, F.col("session_seconds"))).over(
        _sofar(Window.partitionBy("session_id").orderBy("session_seconds", "window_index"))
    )
    return windows.withColumn("seconds_since_gap", F.col("session_seconds") - at)


def app_gate(windows: DataFrame, ids: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """Adds active_app, the last known one (app_id, app_name; null: not known), and armed."""
    sofar = _sofar(_ordered())
    polled = F.last(F.when(F.col("app_id").isNotNull(), F.struct("app_id", "app_name")), ignorenulls=True).over(sofar)
    match = F.col("_app.app_id").isin(*ids) | F.lower(F.trim("_app.app_name")).isin(*(n.strip().lower() for n in names))
    return windows.withColumn("_app", polled).withColumn("active_app", F.col("_app.app_id")).withColumn("armed", F.coalesce(match, F.lit(False))).drop("_app")


def epochs(windows: DataFrame) -> DataFrame:
    """Sets epoch: how often the detector has been reset before or at each window, by restarts of the stream and switches of the app.

    Restarts are in stream_restarted (a session's first window is none), app
    switches in app_switched (see `gated`); without either column there is one epoch.
    """
    if not {"stream_restarted", "app_switched"} & set(windows.columns):
        return windows.withColumn("epoch", F.lit(0))
    resets = F.lit(False)
    if "stream_restarted" in windows.columns:
        resets = resets | (F.coalesce(F.col("stream_restarted"), F.lit(False)) & (F.col("window_index") > 0))
    if "app_switched" in windows.columns:
        resets = resets | F.coalesce(F.col("app_switched"), F.lit(False))
    return windows.withColumn("epoch", F.sum(resets.cast("int")).over(_sofar(_ordered())).cast("int"))


def latest(windows: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds to each window (session_id, timestamp) the columns of the last fact (session_id, at, ...) of its session at or before it; null without one.

    Of facts at one time the last by their other columns counts (nulls first).
    Windows and facts are one sequence by time, so nothing is compared pair by
    pair, and a session's windows need no partner.
    """
    told = [c for c in facts.columns if c not in ("session_id", "at")]
    kept = windows.drop(*told)
    fact = F.struct(*told)
    kinds = {"_row": kept.select(F.struct(*kept.columns)).schema[0].dataType, "_fact": facts.select(fact).schema[0].dataType}
    rows = kept.select("session_id", F.col("timestamp").cast("double").alias("_at"), F.lit(1).alias("_kind"), F.struct(*kept.columns).alias("_row"), F.lit(None).cast(kinds["_fact"]).alias("_fact"))
    known = facts.select("session_id", F.col("at").cast("double").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(kinds["_row"]).alias("_row"), fact.alias("_fact"))
    order = _sofar(Window.partitionBy("session_id").orderBy("_at", "_kind", "_fact"))
    found = rows.unionByName(known).withColumn("_last", F.last("_fact", ignorenulls=True).over(order)).filter("_kind = 1")
    return found.select("_row.*", "_last.*")


def as_of(windows: DataFrame, polls: DataFrame) -> DataFrame:
    """Adds what the last poll at or before each window found: app_id, app_name and poll (failed, no app, app; null: none yet).

    `polls` has session_id, at, app_id and app_name; a null id is a poll that
    failed, an empty one no app.
    """
    kind = F.when(F.col("app_id").isNull(), "failed").when(F.trim("app_id") == "", "no app").otherwise("app")
    return latest(windows, polls.select("session_id", "at", F.col("app_id").cast("string"), F.col("app_name").cast("string"), kind.alias("poll")))


def sampled(windows: DataFrame, every: float) -> DataFrame:
    """Adds checked: is the app asked for at this window? At a session's first one, then at the first that is so many seconds after the last check.

    Each check depends on the one before it, so sessions are read in order;
    only the last check's time is kept, and a batch is skipped from check to check.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, due = None, 0.0
        for rows in parts:
            at, checked = rows["timestamp"].to_numpy(), np.zeros(len(rows), bool)
            bounds = np.flatnonzero((rows["session_id"] != rows["session_id"].shift()).to_numpy()).tolist() + [len(rows)]
            for start, stop in zip(bounds, bounds[1:]):
                if (own := rows["session_id"].iat[start]) != session:
                    session, due = own, -np.inf
                while start < stop:
                    late = np.flatnonzero(at[start:stop] - due >= (every if due != -np.inf else 0))
                    if not len(late):
                        break
                    start += int(late[0])
                    checked[start], due = True, at[start]
                    start += 1
            yield rows.assign(checked=checked)

    keys = windows.select("session_id", "window_index", "timestamp")
    kind = {c: t for c, t in keys.dtypes}
    found = in_order(keys, ("session_id",)).mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in kind.items()) + ", checked boolean")
    return _joined(windows, found.drop("timestamp"), ("session_id", "window_index"))


def gated(windows: DataFrame, config: Config) -> DataFrame:
    """Adds checked, armed and app_switched by the app (app_id, app_name) that each check finds.

    A check without an answer (null id) keeps what was known. The detector is
    reset where an armed app is found that is not the one found before; going
    through an app that isn't armed is such a switch. With the gate off every
    window is armed.
    """
    if not config.gate.armed_apps_only:
        return windows.withColumns({"checked": F.lit(False), "armed": F.lit(True), "app_switched": F.lit(False)})
    rows = sampled(windows, config.controller.app_check_seconds)
    ids, names = config.gate.armed_app_ids, [n.strip().lower() for n in config.gate.armed_app_names]
    fits = F.coalesce(F.col("app_id").isin(*ids) | F.lower(F.trim("app_name")).isin(*names), F.lit(False))
    own = F.when(fits, F.when(F.col("app_id") != "", F.col("app_id")).otherwise(F.col("app_name"))).otherwise("")
    known = F.when(F.col("checked") & F.col("app_id").isNotNull(), F.struct(fits.alias("armed"), own.alias("app")))
    told = rows.withColumn("_known", known)
    before = F.last("_known", ignorenulls=True).over(_before(_ordered()))
    found = told.withColumns({"_before": before, "_now": F.last("_known", ignorenulls=True).over(_sofar(_ordered()))})
    switched = F.col("_known.armed") & (F.col("_known.app") != F.coalesce(F.col("_before.app"), F.lit("")))
    return found.withColumns({"armed": F.coalesce(F.col("_now.armed"), F.lit(False)), "app_switched": F.coalesce(switched, F.lit(False))}).drop("_known", "_before", "_now")
