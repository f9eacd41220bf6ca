"""Label spans and mute spans: parsing, merging, joining and scoring intervals.

Spans are half-open. Joins are by session and bin of time, with the bounds as the
residual condition: a span is repeated into the bins that it touches, and a pair
is kept in one of them, so a session's spans are compared with what is near them
alone, and a long session is many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Label texts by what they mean.
AD_LABELS = ("ad", "ad-cont", "advert", "commercial")
SKIP_LABELS = ("ignore", "skip", "unknown", "?")
MERGE_SECONDS = 2.0
GRACE_SECONDS = 2.0
#: Width of a bin of time, about that of an ad break.
BIN_SECONDS = 60.0


def parse_labels(lines: DataFrame) -> DataFrame:
    """session_id, chunk, line, start, end, label and error of label lines (`text`).

    Blank lines and comments are left out. A line that is not good keeps its
    error; other lines have none.
    """
    parts = F.split("text", "\t")
    rows = lines.filter(~F.trim("text").startswith("#") & (F.trim("text") != "")).select(
        "session_id", "chunk", "line", F.size(parts).alias("_n"),
        F.trim(F.get(parts, 0)).try_cast("double").alias("start"), F.trim(F.get(parts, 1)).try_cast("double").alias("end"),
        F.lower(F.trim(F.get(parts, 2))).alias("label"),
    )
    error = (
        F.when(F.col("_n") < 3, "fewer than three columns")
        .when(F.col("start").isNull() | F.col("end").isNull(), "not a number")
        .when(F.col("end") < F.col("start"), "ends before it starts")
        .when(~F.col("label").isin(*AD_LABELS, *SKIP_LABELS), "unknown label")
    )
    return rows.withColumn("error", error).drop("_n")


def overlaps(spans: DataFrame) -> DataFrame:
    """Spans that begin before the one before them (by start) in their chunk ends."""
    by = Window.partitionBy("session_id", "chunk").orderBy("start", "end")
    return spans.withColumn("previous_end", F.lag("end").over(by)).filter("start < previous_end")


def _bin(at: Column) -> Column:
    return F.floor(at / BIN_SECONDS)


def binned(spans: DataFrame, pad: float = 0.0, start: str = "start", end: str = "end") -> DataFrame:
    """Each span once for every bin of time that it touches, padded on both sides; `_bin` is null without bounds, and the start's where it ends before."""
    first, last = _bin(F.col(start) - pad), _bin(F.col(end) + pad)
    return spans.select("*", F.explode_outer(F.sequence(first, F.greatest(first, last))).alias("_bin"))


def label_windows(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds label (ad, skip or content) by the span that holds a window's middle."""
    middle = F.col("timestamp") + F.col("duration_seconds") / 2
    s = binned(spans.select(F.col("session_id").alias("_session"), "start", "end", F.col("label").alias("_label"))).withColumnRenamed("_bin", "_span_bin")
    near = (F.col("session_id") == F.col("_session")) & (_bin(F.col("_middle")) == F.col("_span_bin"))
    held = windows.withColumn("_middle", middle).join(s, near & (F.col("_middle") >= F.col("start")) & (F.col("_middle") < F.col("end")), "left")
    kind = F.when(F.col("_label").isin(*AD_LABELS), "ad").when(F.col("_label").isNotNull(), "skip").otherwise("content")
    return held.withColumn("label", kind).drop("_session", "_middle", "_label", "_span_bin", "start", "end")


def unlabelled(chunks: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """Chunks without a label file: what a job must refuse to read as free of ads."""
    return chunks.join(labels, on, "left_anti")


def session_spans(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans of chunks on their session's clock; `chunks` has session_id, chunk and duration."""
    by = Window.partitionBy("session_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("session_id", "chunk", F.coalesce(F.sum("duration").over(by), F.lit(0.0)).alias("_offset"))
    shifted = spans.join(offsets, ["session_id", "chunk"])
    return shifted.withColumn("start", F.col("start") + F.col("_offset")).withColumn("end", F.col("end") + F.col("_offset")).drop("_offset")


def merge(spans: DataFrame, within: float = MERGE_SECONDS) -> DataFrame:
    """session_id, break_id, start and end: spans less than `within` apart become one.

    A merged span ends where its last one does.
    """
    by = Window.partitionBy("session_id").orderBy("start", "end")
    opens = F.coalesce(F.col("start") - F.lag("end").over(by) >= within, F.lit(True)).cast("int")
    islands = spans.withColumn("_opens", opens).withColumn("break_id", F.sum("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return islands.groupBy("session_id", "break_id").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"))


def overlap(a: str, b: str) -> Column:
    """Seconds that both spans share; null if `a` is missing (least and greatest would skip it)."""
    shared = F.least(F.col(f"{a}.end"), F.col(f"{b}.end")) - F.greatest(F.col(f"{a}.start"), F.col(f"{b}.start"))
    return F.when(F.col(f"{a}.start").isNotNull(), F.greatest(F.lit(0.0), shared))


def _meet(mutes: DataFrame, breaks: DataFrame, keys: tuple[str, ...], pad: float, how: str) -> DataFrame:
    """Breaks with the mutes that overlap them, padded on both sides; each pair once, breaks without any (`how` left) once a bin."""
    same = F.col("b._bin") == F.col("m._bin")
    for k in keys:
        same = same & (F.col(f"b.{k}") == F.col(f"m.{k}"))
    near = (F.col("m.start") < F.col("b.end") + pad) & (F.col("m.end") > F.col("b.start") - pad)
    once = F.col("b._bin") == _bin(F.greatest(F.col("m.start"), F.col("b.start") - pad))
    return binned(breaks, pad).alias("b").join(binned(mutes).alias("m"), same & near & once, how)


def break_latency(mutes: DataFrame, breaks: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Each break with first_mute (null: missed), latency (may be negative) and covered_seconds."""
    met = _meet(mutes, breaks, keys, 0.0, "left").groupBy(*(f"b.{k}" for k in keys), "b.break_id", "b.start", "b.end")
    found = met.agg(F.min("m.start").alias("first_mute"), F.coalesce(F.sum(overlap("m", "b")), F.lit(0.0)).alias("covered_seconds"))
    return found.withColumn("latency", F.col("first_mute") - F.col("start"))


def false_mute(mutes: DataFrame, breaks: DataFrame, keys: tuple[str, ...] = ("session_id",), grace: float = GRACE_SECONDS) -> DataFrame:
    """keys, muted_seconds and false_seconds: muted beyond the padded breaks, at least 0.

    Padded breaks may overlap and then count twice, as in the score's definition.
    """
    inside = F.greatest(F.lit(0.0), F.least(F.col("m.end"), F.col("b.end") + grace) - F.greatest(F.col("m.start"), F.col("b.start") - grace))
    met = _meet(mutes, breaks, keys, grace, "inner").groupBy(*(f"m.{k}" for k in keys)).agg(F.sum(inside).alias("inside_seconds"))
    total = mutes.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("muted_seconds"))
    both = total.join(met, list(keys), "left")
    return both.select(*keys, "muted_seconds", F.greatest(F.lit(0.0), F.col("muted_seconds") - F.coalesce("inside_seconds", F.lit(0.0))).alias("false_seconds"))


def spurious(mutes: DataFrame, breaks: DataFrame) -> DataFrame:
    """Mutes that overlap no break."""
    met = _meet(mutes, breaks, ("session_id",), 0.0, "inner").select("m.session_id", "m.start", "m.end").distinct()
    return mutes.join(met, ["session_id", "start", "end"], "left_anti").select(*mutes.columns)


def score_sessions(sessions: DataFrame, mutes: DataFrame, breaks: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """keys, duration, breaks, caught, mutes, and seconds of ads, muted, covered and false.

    `sessions` has the keys and duration; one without mutes or breaks keeps zeros.
    """
    hit = break_latency(mutes, breaks, keys).groupBy(*keys).agg(
        F.count("*").alias("breaks"), F.count("first_mute").alias("caught"),
        F.sum(F.col("end") - F.col("start")).alias("ad_seconds"), F.sum("covered_seconds").alias("covered_seconds"),
    )
    n = mutes.groupBy(*keys).agg(F.count("*").alias("mutes"))
    out = sessions
    for part in (hit, n, false_mute(mutes, breaks, keys)):
        out = out.join(part, list(keys), "left")
    counts, seconds = ("breaks", "caught", "mutes"), ("ad_seconds", "covered_seconds", "muted_seconds", "false_seconds")
    return out.select(*keys, "duration", *counts, *seconds).na.fill(0, list(counts)).na.fill(0.0, list(seconds))


def _one(keys: tuple[str, ...]) -> list[Column]:
    """A constant to group by where there are no keys."""
    return [] if keys else [F.lit(1).alias("_one")]


def exact_median(rows: DataFrame, value: str, keys: tuple[str, ...] = (), width: float = 0.25) -> DataFrame:
    """keys (or _one, a constant) and median_<value>: the middle value, or the mean of the two; null without values.

    By selection: equal values are counted, counts of bins of values tell which
    bins the middle lies in, and only their values are put in order. No task
    holds more than the bins' counts or one bin's different values, and no
    buffer grows with the rows.
    """
    by = [*keys] if keys else ["_one"]
    values = rows.groupBy(*keys, *_one(keys), F.col(value).alias("_value")).agg(F.count("*").alias("_n")).withColumn("_bin", F.floor(F.col("_value") / width))
    some = values.filter("_value is not null")
    sofar = lambda *more: Window.partitionBy(*by, *more).orderBy(*(["_value"] if more else ["_bin"])).rowsBetween(Window.unboundedPreceding, 0)
    bins = some.groupBy(*by, "_bin").agg(F.sum("_n").alias("_own"))
    placed = bins.withColumn("_before", F.sum("_own").over(sofar()) - F.col("_own")).withColumn("_all", F.sum("_own").over(Window.partitionBy(*by)))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1  # places of the two middle values, from 1
    holds = lambda start, n, place: (start < place) & (place <= start + n)
    near = placed.filter(holds(F.col("_before"), F.col("_own"), low) | holds(F.col("_before"), F.col("_own"), high)).drop("_own")
    inner = some.join(near, [*by, "_bin"]).withColumn("_before", F.col("_before") + F.sum("_n").over(sofar("_bin")) - F.col("_n"))
    middle = lambda place: F.max(F.when(holds(F.col("_before"), F.col("_n"), place), F.col("_value")))
    found = inner.groupBy(*by).agg(((middle(low) + middle(high)) / 2).alias(f"median_{value}"))
    return values.select(*by).distinct().join(found, by, "left")


def score_totals(scores: DataFrame, latencies: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums over sessions, false seconds per hour, median and largest latency of the breaks caught."""
    sums = [F.sum(c).alias(c) for c in ("duration", "breaks", "caught", "mutes", "ad_seconds", "covered_seconds", "muted_seconds", "false_seconds")]
    total = scores.groupBy(*keys).agg(F.count("*").alias("sessions"), *sums)
    by = [*keys] if keys else ["_one"]
    most = latencies.groupBy(*keys, *_one(keys)).agg(F.max("latency").alias("max_latency"))
    late = exact_median(latencies, "latency", keys).join(most, by)
    both = total.select("*", *_one(keys)).join(late, by, "left").drop("_one")
    return both.withColumn("false_per_hour", F.when(F.col("duration") > 0, 3600 * F.col("false_seconds") / F.col("duration")).otherwise(0.0))
