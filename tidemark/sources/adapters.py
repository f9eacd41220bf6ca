"""The test tables as signals: embeddings as sample buffers, events as windows and labels.

All values are exact functions of the tables, so DuckDB can derive the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUFFER_RATE, FRAME = 64, 8
#: Windows of one chunk of a session.
CHUNK_WINDOWS = 30


def buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and 64 samples a second: scaled by vec_id, with a stretch of silence that depends on it."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    first, length = F.col("vec_id") * 5 % 56, F.col("vec_id") * 11 % 40
    scale = (1 + F.col("vec_id") % 7) / 8
    samples = F.transform("embedding", lambda x, i: F.when((i >= first) & (i < first + length), F.lit(0.0)).otherwise(x.cast("double") * scale))
    return rows.select("vec_id", samples.alias("samples"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user: one-second windows in the order of events, features from value and props."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    index = F.row_number().over(order) - 1
    own = rows.select(F.col("user_id").alias("session_id"), "event_id", "event_type", "value", F.coalesce(k, F.lit(0)).alias("k"), index.cast("long").alias("window_index"))
    silent = F.col("k") % 10 == 0
    part = F.col("k") % 10 == 5
    peak = F.col("value") / 500
    # Spark's logarithm is null where there is none: at 0 the level is endless, below it not a number.
    decibels = F.when(peak == 0, float("-inf")).when(peak < 0, float("nan")).otherwise(20 * F.log10(peak))
    level = F.when(silent, F.lit(-90.0)).otherwise(decibels)
    return own.select(
        "session_id", F.lit(0).alias("epoch"), "window_index", F.col("window_index").cast("double").alias("timestamp"),
        F.floor(F.col("window_index") / CHUNK_WINDOWS).cast("int").alias("chunk"), "event_id", "event_type", "value",
        level.alias("rms_dbfs"), peak.alias("peak"), level.alias("peak_dbfs"), F.lit(1.0).alias("crest_factor"),
        (6.0 + F.col("k") % 13).cast("double").alias("crest_db"), (500.0 + 7 * F.col("k") + F.col("value")).alias("spectral_centroid_hz"),
        (F.col("k") / 1000).alias("zero_crossing_rate"), silent.alias("is_silence"),
        F.when(silent, 1.0).when(part, 0.4).otherwise(0.0).alias("silence_ratio"),
        F.when(silent, 1.0).when(part, 0.3).otherwise(0.0).alias("max_silence_run_seconds"),
        F.when(silent, 1.0).when(F.col("k") % 10 == 1, 0.15).otherwise(0.0).alias("leading_silence_seconds"),
        F.when(silent, 1.0).when(F.col("k") % 10 == 9, 0.1).otherwise(0.0).alias("trailing_silence_seconds"),
        F.when(part, 0.3).otherwise(0.0).alias("interior_silence_seconds"), F.lit(1.0).alias("duration_seconds"),
    )


def raw_spans(windows: DataFrame) -> DataFrame:
    """Label spans that may overlap: a purchase starts one, its length follows the event's id."""
    length = 2.0 + F.col("event_id") % 9
    kind = F.when(F.col("event_id") % 5 == 0, "skip").when(F.col("event_id") % 5 == 1, "advert").otherwise("ad")
    return windows.filter("event_type = 'purchase'").select(
        "session_id", "chunk", (F.col("timestamp") - CHUNK_WINDOWS * F.col("chunk")).alias("start"),
        (F.col("timestamp") - CHUNK_WINDOWS * F.col("chunk") + length).alias("end"), kind.alias("label"),
    )


def chunk_spans(windows: DataFrame) -> DataFrame:
    """`raw_spans` clipped where the next one of the chunk starts and where the chunk ends."""
    following = F.lead("start").over(Window.partitionBy("session_id", "chunk").orderBy("start", "end"))
    return raw_spans(windows).withColumn("end", F.least("end", F.coalesce(following, F.col("end")), F.lit(float(CHUNK_WINDOWS))))


def chunks(windows: DataFrame) -> DataFrame:
    """session_id, chunk and duration."""
    return windows.groupBy("session_id", "chunk").agg(F.sum("duration_seconds").alias("duration"))


def label_lines(windows: DataFrame) -> DataFrame:
    """The raw spans as lines of label files, with comments and faults among them."""
    place = Window.partitionBy("session_id", "chunk").orderBy("start", "end")
    spans = raw_spans(windows).withColumn("line", F.row_number().over(place))
    start, end = F.format_string("%.2f", F.col("start")), F.format_string("%.2f", F.col("end"))
    turn = (F.col("session_id") + F.col("line")) % 8
    text = (
        F.when(turn == 0, F.concat_ws("\t", start, end))
        .when(turn == 1, F.concat_ws("\t", F.lit("x1"), end, F.col("label")))
        .when(turn == 2, F.concat_ws("\t", end, start, F.col("label")))
        .when(turn == 3, F.concat_ws("\t", start, end, F.lit("Music")))
        .when(turn == 4, F.lit("# a comment"))
        .otherwise(F.concat_ws("\t", start, end, F.upper("label")))
    )
    return spans.select("session_id", "chunk", "line", text.alias("text"))


def app_polls(windows: DataFrame) -> DataFrame:
    """Polls of the active app: every third event, some seconds off its window; some fail, some find no app."""
    app = F.when(F.col("event_id") % 7 == 2, F.lit(None)).when(F.col("event_id") % 7 == 3, "").otherwise(F.floor((F.col("window_index") + F.col("session_id")) / 17 % 4).cast("string"))
    at = F.col("timestamp") + F.col("event_id") % 4 * 0.5 - 1.0
    return windows.filter("event_id % 3 = 0").select("session_id", at.alias("at"), app.alias("app_id"), F.upper("event_type").alias("app_name"))


def restarts(windows: DataFrame) -> DataFrame:
    """The windows of streams that begin anew at times."""
    return windows.withColumn("stream_restarted", F.col("window_index") % 23 == 0)


#: Samples of a window that is cut from blocks.
RECUT = 50


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of samples of any lengths, in sessions of every 16th vector; first_frame is a block's place in its session, and some are lost."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    n = (20 + F.col("vec_id") * 7 % 45).cast("int")
    own = rows.select("vec_id", (F.col("vec_id") % 16).alias("session_id"), n.alias("n"), F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double")).alias("samples"))
    before = Window.partitionBy("session_id").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("first_frame", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.filter("vec_id % 29 <> 5").select("session_id", "first_frame", "samples")
