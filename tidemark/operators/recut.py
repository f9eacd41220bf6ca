"""Blocks of samples of any lengths, cut anew into windows: batch and stream alike.

A block's place on its session's sample clock says which windows it has samples
of. It is split at their bounds, and the splits of a window are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

WINDOW = ("session_id", "window_index")


def _splits(blocks: DataFrame, size: int) -> DataFrame:
    """session_id, window_index, first_frame and samples of each block's share of each window that it touches."""
    first, n = F.col("first_frame"), F.size("samples")
    windows = F.sequence(F.floor(first / size), F.floor((first + n - 1) / size))
    each = blocks.filter(n > 0).select("session_id", "first_frame", "samples", F.explode(windows).alias("window_index"))
    start = F.greatest(F.col("window_index") * size, first)
    stop = F.least((F.col("window_index") + 1) * size, first + F.size("samples"))
    cut = F.slice("samples", (start - first + 1).cast("int"), (stop - start).cast("int"))
    return each.select(*WINDOW, start.alias("first_frame"), cut.alias("samples"))


def _joined(grouped: GroupedData) -> DataFrame:
    splits = F.sort_array(F.collect_list(F.struct("first_frame", "samples")))
    got = grouped.agg(splits.alias("_splits"))
    samples = F.flatten(F.transform("_splits", lambda x: x["samples"]))
    first, last = F.col("_splits")[0]["first_frame"], F.element_at("_splits", -1)
    span = last["first_frame"] + F.size(last["samples"]) - first
    return got.select(*WINDOW, first.alias("first_frame"), samples.alias("samples"), (span == F.size(samples)).alias("whole"))


def windows(blocks: DataFrame, size: int) -> DataFrame:
    """session_id, window_index, first_frame, samples and whole of the windows of `size` samples that blocks (session_id, first_frame, samples) fill.

    Windows lie on the grid of the session's clock. One that lacks samples at
    an end is shorter, and kept; `whole` says that none lacks between its first
    and last (blocks must not overlap, or it is false). Empty and null blocks
    have no windows. A window's samples, and no more, come together in a task.
    """
    return _joined(_splits(blocks, size).groupBy(*WINDOW))


def stream(blocks: DataFrame, size: int, sample_rate: int, delay_seconds: float) -> DataFrame:
    """The same of a stream: a window comes when one that starts so much later has samples; what comes for it after that is lost.

    Sessions share one clock, and its watermark bounds the state: the windows of
    the last `delay_seconds`.
    """
    # A stream's first watermark is the start of 1970, so the clock begins a day later.
    at = F.timestamp_micros((F.lit(86_400_000_000) + F.col("window_index") * (1_000_000 * size / sample_rate)).cast("long"))
    splits = _splits(blocks, size).withColumn("_at", at)
    return _joined(splits.withWatermark("_at", f"{int(1000 * delay_seconds)} milliseconds").groupBy(*WINDOW, "_at"))
