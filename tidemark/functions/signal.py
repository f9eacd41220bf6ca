"""Column functions on sample buffers (arrays of floats): levels, runs, profiles.

All are built-in higher-order functions, so they stay in the JVM. Squares are
taken in double precision. Levels have a floor of -120 dB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR_DB = -120.0


def decibels(amplitude: Column) -> Column:
    """20 log10, at least the floor, which NaN has as well; null only for null."""
    level = F.greatest(20 * F.log10(F.when((amplitude > 0) & ~F.isnan(amplitude), amplitude)), F.lit(FLOOR_DB))
    return F.when(amplitude.isNotNull(), level)


def mono(interleaved: Column, channels: int, scale: float) -> Column:
    """The mean over channels of interleaved integer samples, scaled to -1..1 first."""
    frames = F.sequence(F.lit(0), F.floor(F.size(interleaved) / channels).cast("int") - 1)
    one = lambda i, c: F.get(interleaved, i * channels + c).cast("double") / scale

    def mean(i: Column) -> Column:
        total = one(i, 0)
        for c in range(1, channels):
            total = total + one(i, c)
        return total / channels

    return F.when(F.size(interleaved) >= channels, F.transform(frames, mean)).otherwise(F.array().cast("array<double>"))


def rms(samples: Column) -> Column:
    squares = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(squares / F.size(samples))).otherwise(F.when(samples.isNotNull(), F.lit(0.0)))


def peak(samples: Column) -> Column:
    most = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    return F.when(F.size(samples) > 0, most).otherwise(F.when(samples.isNotNull(), F.lit(0.0)))


def crest_factor(peak: Column, level: Column) -> Column:
    return F.when(level <= 0, F.lit(1.0)).otherwise(peak / level)


def zero_crossing_rate(samples: Column) -> Column:
    """Changes of the sign bit between neighbours (-0 has it), by their number; 0 for fewer than two samples."""
    n = F.size(samples)
    # Zeros compare as equal, so only their text tells their signs.
    signs = F.transform(samples, lambda x: (x < 0) | ((x == 0) & x.cast("string").startswith("-")))
    pairs = F.zip_with(F.slice(signs, 1, F.greatest(n - 1, F.lit(0))), F.slice(signs, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a != b)
    changes = F.size(F.filter(pairs, lambda x: x)).cast("double")
    return F.when(n >= 2, changes / (n - 1)).otherwise(F.when(samples.isNotNull(), F.lit(0.0)))


def frame_rms(samples: Column, frame: int) -> Column:
    """Levels of the complete frames; a buffer shorter than one is a single frame."""
    n = F.floor(F.size(samples) / frame).cast("int")
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: rms(F.slice(samples, i * frame + 1, frame)))
    return F.when(n >= 1, many).otherwise(F.array(rms(samples)))


def true_runs(mask: Column) -> Column:
    """(start, stop) of every run of true, the stop not included."""
    n = F.size(mask)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    here = lambda i: F.coalesce(F.get(mask, i), F.lit(False))
    starts = F.filter(at, lambda i: here(i) & ~here(i - 1))
    stops = F.filter(at, lambda i: here(i) & ~here(i + 1))
    return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))


def silence_profile(runs: Column, n_frames: Column, frame_seconds: Column) -> Column:
    """Struct of ratio, longest, leading, trailing and interior silence in seconds."""
    longest = lambda keep: F.coalesce(F.array_max(F.transform(F.filter(runs, keep), lambda r: r["stop"] - r["start"])), F.lit(0)) * frame_seconds
    silent = F.aggregate(runs, F.lit(0), lambda a, r: a + r["stop"] - r["start"])
    return F.struct(
        F.when(n_frames > 0, silent / n_frames).otherwise(0.0).alias("silence_ratio"),
        longest(lambda r: F.lit(True)).alias("max_silence_run_seconds"),
        longest(lambda r: r["start"] == 0).alias("leading_silence_seconds"),
        longest(lambda r: r["stop"] == n_frames).alias("trailing_silence_seconds"),
        longest(lambda r: (r["start"] > 0) & (r["stop"] < n_frames)).alias("interior_silence_seconds"),
    )


def clock(seconds: Column) -> Column:
    """Minutes and seconds with one decimal; minutes go beyond 59."""
    tenths = F.round(seconds * 10).cast("long")
    return F.format_string("%02d:%02d.%d", F.floor(tenths / 600).cast("long"), F.floor(tenths % 600 / 10).cast("long"), tenths % 10)


def card_name(device: Column) -> Column:
    """The card that a device specification names, else null."""
    found = F.regexp_extract(device, "CARD=([^,]+)", 1)
    return F.when(found != "", found)


def device_candidates(device: Column) -> Column:
    """What to look a device up by, in order: an index alone, else the specification and then the card that it names."""
    spec = F.trim(device)
    return F.when(spec.rlike("^[0-9]+$"), F.array(spec)).otherwise(F.array_compact(F.array(spec, card_name(spec))))
