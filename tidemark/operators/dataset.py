"""Training rows: features, labels and causal baselines of every window that counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Detection
from tidemark.operators import detect, intervals, sequence

ROUNDED = 6


def training_rows(windows: DataFrame, spans: DataFrame, cfg: Detection) -> DataFrame:
    """29 columns a window. Skipped windows still move the baseline and the clock, then go."""
    clocked = sequence.session_clock(windows)
    state = sequence.feature_deltas(sequence.ema_baseline(sequence.seconds_since_gap(clocked, cfg), cfg.baseline_alpha))
    chunked = state.withColumn("timestamp", F.col("timestamp") - F.min("timestamp").over(sequence.Window.partitionBy("session_id", "chunk")))
    by_chunk = spans.withColumnsRenamed({"chunk": "_chunk", "session_id": "_session"})
    middle = F.col("timestamp") + F.col("duration_seconds") / 2
    held = chunked.join(
        by_chunk.withColumnRenamed("label", "_label"),
        (F.col("session_id") == F.col("_session")) & (F.col("chunk") == F.col("_chunk")) & (middle >= F.col("start")) & (middle < F.col("end")), "left",
    )
    label = F.when(F.col("_label").isin(*intervals.AD_LABELS), "ad").when(F.col("_label").isNotNull(), "skip").otherwise("content")
    rounded = lambda *names: [F.round(n, ROUNDED).alias(n) for n in names]
    return held.withColumn("label", label).filter("label <> 'skip'").select(
        "session_id", "chunk", "window_index", F.round("timestamp", 3).alias("timestamp"), F.round("session_seconds", 3).alias("session_seconds"),
        "label", (F.col("label") == "ad").cast("int").alias("is_ad"),
        *(F.col(n).cast("int").alias(n) if n == "is_silence" else F.round(n, ROUNDED).alias(n) for n in detect.FEATURES),
        *rounded("baseline_rms_dbfs", "baseline_crest_db", "baseline_centroid_hz"), "baseline_count",
        *rounded("delta_rms_db", "delta_crest_db", "delta_centroid_ratio", "seconds_since_gap"),
    )


def class_balance(labelled: DataFrame) -> DataFrame:
    """Windows of each label by chunk, session and in all (-1 marks the sums)."""
    count = lambda name: F.count_if(F.col("label") == name).alias(name)
    return labelled.rollup("session_id", "chunk").agg(count("ad"), count("content"), count("skip")).na.fill(-1, ["session_id", "chunk"])


def stats(rows: DataFrame, cfg: Detection) -> DataFrame:
    """Rows, share of ads and rows with a cold baseline, by session."""
    return rows.groupBy("session_id").agg(
        F.count("*").alias("n_rows"), F.avg("is_ad").alias("ad_share"), F.count_if(F.col("baseline_count") < cfg.baseline_min_windows).alias("cold_rows")
    )


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    """The rows as CSV; no rows is an error, not an empty file."""
    if rows.isEmpty():
        raise ValueError("no usable windows")
    rows.write.mode("append" if append else "overwrite").csv(path, header=True)
