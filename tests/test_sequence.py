"""Sequence operators at lengths and cases that the queries' tables don't have."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import Config, Gate
from tidemark.operators import intervals, sequence

FEATURES = "rms_dbfs double, crest_db double, spectral_centroid_hz double"
BASE = ["baseline_rms_dbfs", "baseline_crest_db", "baseline_centroid_hz"]


def plain_baseline(rows, alpha):
    """Before each row, (three means, count), by the recursion."""
    out, base, count = [], None, 0
    for silent, *x in rows:
        out.append((*(base or (None,) * 3), count))
        if not silent:
            base = x if base is None else [(1 - alpha) * b + alpha * v for b, v in zip(base, x)]
            count += 1
    return out


@pytest.mark.parametrize("alpha", [0.05, 0.0007, 0.9, 1.0])
def test_baseline_of_short_sessions(spark, alpha):
    rng = np.random.default_rng(4)
    parts = []
    for session, n in enumerate((1, 2, 500, 3000, 5000)):
        silent = rng.random(n) < (0.0, 1.0, 0.9, 0.3, 0.1)[session]
        parts.append(pd.DataFrame({"session_id": session, "epoch": np.arange(n) // 2200, "window_index": np.arange(n), "is_silence": silent,
                                   "rms_dbfs": rng.normal(-20, 9, n), "crest_db": rng.normal(9, 3, n), "spectral_centroid_hz": rng.normal(2000, 300, n)}))
    pdf = pd.concat(parts)
    got = sequence.ema_baseline(spark.createDataFrame(pdf), alpha).toPandas().sort_values(["session_id", "window_index"])
    for (session, epoch), own in got.groupby(["session_id", "epoch"]):
        want = plain_baseline(own[["is_silence", "rms_dbfs", "crest_db", "spectral_centroid_hz"]].itertuples(index=False, name=None), alpha)
        assert own.baseline_count.tolist() == [w[3] for w in want]
        assert np.allclose(own[BASE].to_numpy(float), np.array([w[:3] for w in want], float), rtol=1e-11, atol=1e-9, equal_nan=True)


def test_baseline_of_a_million_windows(spark):
    """One session, no Python: as the recursion, at every window."""
    n, alpha = 1_000_000, 0.05
    level = (F.pmod(F.hash("id"), F.lit(1000)) / 10 - 80).alias("rms_dbfs")
    rows = spark.range(n).select(
        F.lit("s").alias("session_id"), F.lit(0).alias("epoch"), F.col("id").alias("window_index"), (F.pmod(F.hash("id", F.lit(1)), F.lit(7)) == 0).alias("is_silence"),
        level, (F.lit(5.0) + F.pmod(F.col("id"), F.lit(9))).alias("crest_db"), (F.lit(500.0) + F.pmod(F.col("id"), F.lit(97))).alias("spectral_centroid_hz"),
    )
    out = sequence.ema_baseline(rows, alpha)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
    got = out.select("window_index", "is_silence", "rms_dbfs", "baseline_rms_dbfs", "baseline_count").toPandas().sort_values("window_index")
    base, want = None, np.empty(n)
    for i, (silent, x) in enumerate(zip(got.is_silence.tolist(), got.rms_dbfs.tolist())):
        want[i] = np.nan if base is None else base
        if not silent:
            base = x if base is None else (1 - alpha) * base + alpha * x
    assert np.allclose(got.baseline_rms_dbfs.to_numpy(float), want, rtol=0, atol=1e-9, equal_nan=True)
    assert got.baseline_count.iloc[-1] == (~got.is_silence.iloc[:-1]).sum()


def test_checks_at_intervals(spark):
    rng = np.random.default_rng(2)
    parts = [pd.DataFrame({"session_id": s, "window_index": np.arange(n), "timestamp": np.cumsum(rng.choice([0.25, 1.0, 1.0, 7.5], n))}) for s, n in enumerate((1, 40, 20_000))]
    pdf = pd.concat(parts)
    for every in (0.0, 3.5, 100.0):
        got = sequence.sampled(spark.createDataFrame(pdf), every).toPandas().sort_values(["session_id", "window_index"])
        for _, own in got.groupby("session_id"):
            last, want = None, []
            for t in own.timestamp:
                want.append(last is None or t - last >= every)
                last = t if want[-1] else last
            assert own.checked.tolist() == want


def test_polls_as_of(spark):
    windows = spark.createDataFrame([("a", i, float(i), "old") for i in range(6)] + [("b", 0, 0.0, "old")], "session_id string, window_index long, timestamp double, app_id string")
    polls = spark.createDataFrame(
        [("a", 0.5, "12", "Films"), ("a", 2.0, None, None), ("a", 3.0, "", ""), ("a", 3.0, None, "x"), ("a", 4.5, "9", "B"), ("a", 4.5, "7", "A"), ("a", 99.0, "1", ""), ("c", 0.0, "1", "")],
        "session_id string, at double, app_id string, app_name string",
    )
    got = {(r.session_id, r.window_index): (r.poll, r.app_id) for r in sequence.as_of(windows, polls).collect()}
    assert got == {("a", 0): (None, None), ("a", 1): ("app", "12"), ("a", 2): ("failed", None), ("a", 3): ("no app", ""), ("a", 4): ("no app", ""), ("a", 5): ("app", "9"), ("b", 0): (None, None)}


def test_a_failed_poll_keeps_what_was_known(spark):
    found = ["12", None, "", None, "12", "7", "12"]
    rows = spark.createDataFrame([("a", i, float(i), x, "") for i, x in enumerate(found)], "session_id string, window_index long, timestamp double, app_id string, app_name string")
    config = Config(gate=Gate(armed_apps_only=True, armed_app_ids=("12", "7"))).override({"controller.app_check_seconds": "1.0"})
    got = sorted((r.window_index, r.armed, r.app_switched) for r in sequence.gated(rows, config).collect())
    assert [x[1:] for x in got] == [(True, True), (True, False), (False, False), (False, False), (True, True), (True, True), (True, True)]
    epochs = sequence.epochs(sequence.gated(rows, config).withColumn("stream_restarted", F.col("window_index").isin(0, 3)))
    assert [r.epoch for r in epochs.orderBy("window_index").collect()] == [1, 1, 1, 2, 3, 4, 5]


def test_long_sessions_are_compared_in_bins(spark):
    """100,000 windows and 10,000 spans of one session: the pairs that meet in a bin grow with both, not with their product."""
    n, every = 100_000, 10
    windows = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("window_index"), F.col("id").cast("double").alias("timestamp"), F.lit(1.0).alias("duration_seconds"))
    spans = spark.range(n // every).select(F.lit("s").alias("session_id"), (F.col("id") * every).cast("double").alias("start"), (F.col("id") * every + 4).cast("double").alias("end"), F.lit("ad").alias("label"))
    got = intervals.label_windows(windows, spans).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"ad": 4 * n // every, "content": n - 4 * n // every}
    pairs = intervals.binned(spans).groupBy("_bin").count().withColumnRenamed("count", "m").join(windows.groupBy(intervals._bin(F.col("timestamp") + 0.5).alias("_bin")).count(), "_bin")
    assert pairs.agg(F.sum(F.col("m") * F.col("count"))).first()[0] < 10 * n
    # Each pair of overlapping spans is met once, whatever bins they share.
    mutes = spark.createDataFrame([("s", 0, 5.0, 400.0), ("s", 1, 399.0, 401.0), ("s", 2, 900.0, 900.5), ("s", 3, -70.0, -65.0)], "session_id string, span int, start double, end double")
    breaks = spark.createDataFrame([("s", 0, 10.0, 350.0), ("s", 1, 360.0, 500.0), ("s", 2, 700.0, 800.0), ("s", 3, -66.0, 20.0)], "session_id string, break_id long, start double, end double")
    found = {r.break_id: (r.first_mute, r.covered_seconds) for r in intervals.break_latency(mutes, breaks).collect()}
    assert found == {0: (5.0, 340.0), 1: (5.0, 42.0), 2: (None, 0.0), 3: (-70.0, 16.0)}
    assert [r.span for r in intervals.spurious(mutes, breaks).collect()] == [2]


def test_exact_median(spark):
    rng = np.random.default_rng(7)
    for values in ([1.0], [1.0, 2.0], [3.0] * 500 + [4.0], [None, 5.0, None], rng.normal(0, 30, 1001).tolist(), rng.normal(0, 3, 1000).tolist(), [-2.0, -1.0, 0.25, 0.25]):
        rows = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "x double, k int")
        series = pd.Series(values, dtype=float)
        assert intervals.exact_median(rows, "x").first().median_x == pytest.approx(series.median())
        want = series.groupby(np.arange(len(values)) % 2).median()
        got = {r.k: r.median_x for r in intervals.exact_median(rows, "x", ("k",)).collect()}
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want.dropna().to_dict())
    assert intervals.exact_median(spark.createDataFrame([], "x double"), "x").count() == 0
