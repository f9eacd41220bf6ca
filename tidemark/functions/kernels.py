"""Window features of sample buffers in numpy: buffers of equal length together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR_DB = -120.0
#: A spectrum of a smaller sum has no centroid.
LEAST_SPECTRUM = 1e-12
FEATURES = (
    "rms_dbfs double, peak double, peak_dbfs double, crest_factor double, crest_db double, spectral_centroid_hz double, zero_crossing_rate double, "
    "is_silence boolean, silence_ratio double, max_silence_run_seconds double, leading_silence_seconds double, trailing_silence_seconds double, "
    "interior_silence_seconds double, duration_seconds double"
)
NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def mono(buffer: np.ndarray) -> np.ndarray:
    """Integer samples to -1..1, then the mean over channels (frames, channels)."""
    scale = {np.dtype(np.int16): 32768.0, np.dtype(np.int32): 2147483648.0}.get(buffer.dtype)
    out = buffer.astype(np.float32) / scale if scale else buffer.astype(np.float32)
    return out.mean(axis=1, dtype=np.float32) if out.ndim == 2 else out


def decibels(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        level = 20 * np.log10(x)
    return np.where(level > FLOOR_DB, level, FLOOR_DB)


def rms(x: np.ndarray) -> np.ndarray:
    """Along the last axis, in double precision; 0 for no samples."""
    return np.sqrt(np.square(x, dtype=np.float64).mean(axis=-1)) if x.shape[-1] else np.zeros(x.shape[:-1])


def centroid(x: np.ndarray, rate: float) -> np.ndarray:
    if not x.shape[-1]:
        return np.zeros(x.shape[:-1])
    sizes = np.abs(np.fft.rfft(x * np.hanning(x.shape[-1]), axis=-1))
    total = sizes.sum(axis=-1)
    places = np.fft.rfftfreq(x.shape[-1], 1 / rate)
    return np.where(total > LEAST_SPECTRUM, sizes @ places / np.maximum(total, LEAST_SPECTRUM), 0.0)


def frame_levels(x: np.ndarray, frame: int) -> np.ndarray:
    """Levels of the complete frames of each row; a row shorter than one is a single frame."""
    n = x.shape[1] // frame
    return rms(x[:, : n * frame].reshape(len(x), n, frame)) if n else rms(x)[:, None]


def silence(mask: np.ndarray, seconds: float) -> np.ndarray:
    """Ratio, longest, leading, trailing and interior run of each row of frames."""
    n = mask.shape[1]
    run = np.zeros(mask.shape, np.int64)  # length of the run that ends here
    for j in range(n):
        run[:, j] = np.where(mask[:, j], (run[:, j - 1] if j else 0) + 1, 0)
    longest = run.max(axis=1, initial=0)
    trailing = run[:, -1] if n else longest
    leading = np.where(mask.all(axis=1), n, np.argmin(mask, axis=1)) if n else longest
    places = np.arange(n)
    # A run that goes on to the last frame is trailing up to its end, so what precedes it there isn't interior.
    edge = n - trailing
    inner = np.where((run < places + 1) & (places < edge[:, None]), run, 0).max(axis=1, initial=0)
    ratio = mask.mean(axis=1) if n else np.zeros(len(mask))
    return np.stack([ratio, *(k * seconds for k in (longest, leading, trailing, inner))], axis=1)


def features(x: np.ndarray, rate: float, silence_dbfs: float = -60.0, frame_seconds: float = 0.05) -> pd.DataFrame:
    """The 14 features of each row of (buffers, samples)."""
    x = np.asarray(x, np.float64)
    n = x.shape[1]
    level = rms(x)
    top = np.abs(x).max(axis=1, initial=0.0)
    crest = np.where(level > 0, top / np.where(level > 0, level, 1), 1.0)
    signs = np.signbit(x)
    crossings = (signs[:, 1:] != signs[:, :-1]).sum(axis=1) / (n - 1) if n > 1 else np.zeros(len(x))
    frame = max(1, round(rate * frame_seconds))
    levels = frame_levels(x, frame)
    runs = silence(decibels(levels) < silence_dbfs, frame / rate if levels.shape[1] > 1 else n / rate)
    columns = [decibels(level), top, decibels(top), crest, decibels(crest), centroid(x, rate), crossings, decibels(level) < silence_dbfs, *runs.T, np.full(len(x), n / rate)]
    return pd.DataFrame(dict(zip(NAMES, columns)))


def window_features(
    buffers: DataFrame, rate: float | str, silence_dbfs: float = -60.0, frame_seconds: float = 0.05, keep: tuple[str, ...] = ("vec_id",)
) -> DataFrame:
    """The columns `keep` and the 14 features of every row's `samples`; samples go no further.

    `rate` is that of all rows, or the column that has each row's. Buffers of
    equal length and rate are measured together.
    """
    by_row = isinstance(rate, str)

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            lengths = pdf["samples"].map(len).to_numpy()
            rates = pdf["_rate"].to_numpy() if by_row else np.full(len(pdf), rate)
            out: list[pd.DataFrame] = []
            for n, own_rate in sorted(set(zip(lengths.tolist(), rates.tolist()))):
                own = np.flatnonzero((lengths == n) & (rates == own_rate))
                x = np.stack(pdf["samples"].iloc[own].to_numpy()) if n else np.zeros((len(own), 0))
                out.append(features(x, own_rate, silence_dbfs, frame_seconds).set_index(pdf.index[own]))
            if out:
                yield pd.concat([pdf[list(keep)], pd.concat(out)], axis=1)

    ids = ", ".join(f"`{c}` {buffers.schema[c].dataType.simpleString()}" for c in keep)
    read = buffers.select(*keep, "samples", *([F.col(rate).cast("double").alias("_rate")] if by_row else []))
    return read.filter(F.col("samples").isNotNull()).mapInPandas(measured, f"{ids}, {FEATURES}")
