import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels, signal

RATE = 48_000


def sine(f, seconds=1.0, a=0.5):
    return a * np.sin(2 * np.pi * f * np.arange(int(RATE * seconds)) / RATE)


def one(x, **options):
    return kernels.features(np.asarray(x)[None, :], RATE, **options).iloc[0]


def test_sine_and_square():
    f = one(sine(1000))
    assert f.rms_dbfs == pytest.approx(-9.03, abs=0.01) and f.crest_db == pytest.approx(3.01, abs=0.01)
    assert f.spectral_centroid_hz == pytest.approx(1000, rel=0.1) and f.zero_crossing_rate == pytest.approx(2000 / RATE, rel=0.01)
    assert one(np.sign(sine(440) + 1e-9)).crest_db == pytest.approx(0, abs=0.01)
    noise = np.random.default_rng(1).normal(size=RATE) * 0.1
    assert one(noise).crest_db > 5


def test_silence_and_empty():
    f = one(np.zeros(RATE))
    assert (f.rms_dbfs, f.crest_db, f.spectral_centroid_hz, f.is_silence, f.silence_ratio) == (-120, 0, 0, True, 1)
    assert f.leading_silence_seconds == f.trailing_silence_seconds == f.max_silence_run_seconds == pytest.approx(1) and f.interior_silence_seconds == 0
    e = one(np.zeros(0))
    assert (e.peak, e.spectral_centroid_hz, e.zero_crossing_rate, e.duration_seconds) == (0, 0, 0, 0)


def test_gaps():
    f = one(np.concatenate([sine(500, 0.35), np.zeros(int(0.3 * RATE)), sine(500, 0.35)]))
    assert f.interior_silence_seconds == pytest.approx(0.3, abs=0.06) and f.leading_silence_seconds == f.trailing_silence_seconds == 0
    f = one(np.concatenate([np.zeros(int(0.2 * RATE)), sine(500, 0.5), np.zeros(int(0.3 * RATE))]))
    assert f.leading_silence_seconds == pytest.approx(0.2) and f.trailing_silence_seconds == pytest.approx(0.3) and f.interior_silence_seconds == 0
    mask = np.array([[True, True, False, True, False, False, True]])
    assert kernels.silence(mask, 0.1)[0] == pytest.approx([4 / 7, 0.2, 0.2, 0.1, 0.1])


def test_mono():
    stereo = np.array([[16384, -16384], [32767, 32767]], np.int16)
    assert kernels.mono(stereo) == pytest.approx([0, 32767 / 32768])


def test_columns_agree_with_kernels(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate((0, 1, 2, 7, 8, 64, 65))] + [(90, [0.0] * 64), (91, None)]
    frame = spark.createDataFrame(rows, "vec_id long, samples array<float>")
    s = F.col("samples")
    got = {r.vec_id: r for r in frame.select("vec_id", signal.rms(s).alias("rms"), signal.peak(s).alias("peak"), signal.zero_crossing_rate(s).alias("zcr"), signal.frame_rms(s, 8).alias("frames")).collect()}
    assert got[91].rms is None and got[91].peak is None
    kernel = {r.vec_id: r for r in kernels.window_features(frame, 64, frame_seconds=8 / 64).collect()}
    assert 91 not in kernel
    for i, x in rows[:-1]:
        assert got[i].peak == pytest.approx(kernel[i].peak) and got[i].zcr == pytest.approx(kernel[i].zero_crossing_rate)
        assert max(20 * np.log10(got[i].rms) if got[i].rms else -120, -120) == pytest.approx(kernel[i].rms_dbfs)
        assert got[i].frames == pytest.approx(kernels.frame_levels(np.array([x], np.float32), 8)[0].tolist())


def test_small_columns(spark):
    row = spark.range(1).select(
        signal.clock(F.lit(3725.94)).alias("a"), signal.clock(F.lit(59.96)).alias("b"), signal.card_name(F.lit("plughw:CARD=USB,DEV=0")).alias("c"), signal.card_name(F.lit("3")).alias("d"),
        signal.decibels(F.lit(0.0)).alias("e"), signal.decibels(F.lit(None).cast("double")).alias("f"), signal.true_runs(F.array(*map(F.lit, (True, True, False, True)))).alias("g"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("62:05.9", "01:00.0", "USB", None, -120.0, None)
    assert [tuple(x) for x in row.g] == [(0, 2), (3, 4)]


def test_levels_of_no_number_and_signed_zero(spark):
    rows = spark.createDataFrame([(float("nan"), [0.0, -0.0, 0.0, 1.0]), (0.0, [-1.0, -0.0]), (-1.0, [1.0]), (None, None)], "a double, s array<double>")
    got = rows.select(signal.decibels(F.col("a")).alias("db"), signal.zero_crossing_rate(F.col("s")).alias("z")).collect()
    assert [r.db for r in got] == [-120.0, -120.0, -120.0, None] and [r.z for r in got] == [2 / 3, 0.0, 0.0, None]


def test_device_candidates(spark):
    rows = spark.createDataFrame([(" 3 ",), ("plughw:CARD=Receiver,DEV=0",), ("USB",)], "d string")
    assert [r.c for r in rows.select(signal.device_candidates(F.col("d")).alias("c")).collect()] == [["3"], ["plughw:CARD=Receiver,DEV=0", "Receiver"], ["USB"]]
